"""How the driver's tables stand in for telemetry: the same views for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.scalars import epoch_seconds
from ..operators.series import horizon_label

WEEK, SCALE = 604800, 500.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, s, ts, x, kind: an event is a reading of its user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("asset_id"), epoch_seconds(F.col("ts")).alias("s"), "ts", F.col("value").alias("x"), F.col("event_type").alias("kind"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id (a user's week), asset_id, window_end, hours_to_fault, label, probability, farm.

    The fault of a week is its last error; what comes after it is left out. Weeks without one are normal.
    """
    e = table(spark, sf_dir, "events").select("user_id", "ts", epoch_seconds(F.col("ts")).alias("s"), "value", "event_type")
    e = e.withColumn("week", F.floor(F.col("s") / WEEK))
    fault = F.max(F.when(F.col("event_type") == "error", F.col("s"))).over(Window.partitionBy("user_id", "week"))
    e = e.withColumn("fault", fault).filter("fault is null or s <= fault")
    hours = (F.col("fault") - F.col("s")) / 3600.0
    return e.select(
        (F.col("user_id") * 100000 + F.col("week")).alias("event_id"), F.col("user_id").cast("string").alias("asset_id"), F.col("ts").alias("window_end"), hours.alias("hours_to_fault"),
        horizon_label(F.col("fault").isNotNull(), hours).alias("label"), F.least(F.col("value") / SCALE, F.lit(1.0)).alias("probability"), farm(F.col("user_id")).alias("farm"),
    )


def farm(user):
    return F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.pmod(user, F.lit(3)) + 1).cast("int"))


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item's quantity, discount and tax as three phases; price as power."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_quantity").alias("p1"), (F.col("l_discount") * 100 + 0.0).alias("p2"), (F.col("l_tax") * 100 + 0.0).alias("p3"), F.col("l_quantity").alias("wind"),
        F.col("l_extendedprice").alias("power"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("flag"),
    )


EPOCH_SQL = "epoch(date_trunc('second', ts))::BIGINT"
READINGS_SQL = f"readings AS (SELECT user_id::VARCHAR AS asset_id, {EPOCH_SQL} AS s, ts, value AS x, event_type AS kind FROM events)"
PREDICTIONS_SQL = f"""e0 AS (SELECT user_id, ts, {EPOCH_SQL} AS s, value, event_type, ({EPOCH_SQL}) // {WEEK} AS week FROM events),
e1 AS (SELECT *, max(CASE WHEN event_type = 'error' THEN s END) OVER (PARTITION BY user_id, week) AS fault FROM e0),
pred AS (SELECT user_id * 100000 + week AS event_id, user_id::VARCHAR AS asset_id, ts AS window_end, (fault - s) / 3600.0::DOUBLE AS hours_to_fault,
    CASE WHEN fault - s > 0 AND fault - s <= 172800 THEN 1 ELSE 0 END AS label, least(value / {SCALE}, 1.0) AS probability,
    CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS farm FROM e1 WHERE fault IS NULL OR s <= fault)"""
PHASES_SQL = """phases AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity AS p1, l_discount * 100 + 0.0 AS p2, l_tax * 100 + 0.0 AS p3, l_quantity AS wind,
    l_extendedprice AS power, l_shipdate AS ts, l_returnflag AS flag FROM lineitem)"""
