"""The frozen scaler: fitted once on masked training rows, applied everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clipped, finite

LEAST_STD = 1e-6


def long_tensor(df: DataFrame, keys: list[str], array: str = "features") -> DataFrame:
    """keys, feature_index, x: one row per component."""
    return df.select(*keys, F.posexplode(array).alias("feature_index", "x"))


def fit_scaler(rows: DataFrame, mask: Column | None = None) -> DataFrame:
    """feature_index, n, mean, std from long rows of 32-bit values, summed in 64 bits; deviations below 1e-6 are one."""
    rows = rows if mask is None else rows.filter(mask)
    x = F.col("x").cast("float").cast("double")
    out = rows.groupBy("feature_index").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    return out.withColumn("std", F.when(F.col("std") < LEAST_STD, 1.0).otherwise(F.col("std")))


def apply_scaler(rows: DataFrame, scaler: DataFrame, limit: float | None = None) -> DataFrame:
    """rows with x scaled; missing values take the mean, so they are zero. The scaler has one row a feature, so it is broadcast."""
    z = (F.when(finite(F.col("x").cast("double")), F.col("x").cast("double")).otherwise(F.col("mean")) - F.col("mean")) / F.col("std")
    z = clipped(z, limit) if limit is not None else z
    return rows.join(F.broadcast(scaler.select("feature_index", "mean", "std")), "feature_index").withColumn("z", z).drop("mean", "std")


def unscaled(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean


def masked_rows(df: DataFrame, keys: list[str], features: str = "features", mask: str = "mask", limit: float = 10.0) -> DataFrame:
    """Unmasked rows with every component clipped: a flattened tensor."""
    return df.filter(F.col(mask) == 1).withColumn(features, F.transform(features, lambda x: clipped(x, limit)))
