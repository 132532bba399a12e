"""Readers and writers. Paths go to Spark's own readers, so they may be in any store that Spark reaches."""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.physics import PowerCurve

DELIMITERS = (",", ";", "\t")
EVENT_FILE = r"comma_([0-9]+)\.csv$"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the application ends.

    It is below spark.checkpoint.dir; where none is set, below the warehouse, in local mode alone.
    """
    found, context = spark.sparkContext.getConf().get("spark.checkpoint.dir", None), spark.sparkContext
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{found}/table-{uuid.uuid4().hex}"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settled_rows(df: DataFrame) -> DataFrame:
    """df, written once and read again, so that later plans neither repeat its work nor depend on where its rows were."""
    path = shared_folder(df.sparkSession)
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that the first line has most of."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0].lstrip("﻿") if first else ""
    counts = {d: line.count(d) for d in DELIMITERS}
    best = max(DELIMITERS, key=counts.get)
    if not counts[best]:
        raise ValueError(f"no delimiter found in {path}")
    return best


def _csv(spark: SparkSession, path: str, delimiter: str | None) -> DataFrame:
    """Text columns, with the names of one header. Left to find them, Spark's reader lists each file of a folder as a path of its own."""
    reader = spark.read.options(header=True, sep=delimiter or detect_delimiter(spark, path))
    first = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    if not first:
        return reader.csv(path)
    return reader.schema(reader.csv(spark.sparkContext.parallelize([first[0][0]], 1)).schema).csv(path)


def csv_columns(spark: SparkSession, path: str, delimiter: str | None = None) -> list[str]:
    """The header's names; no data is read."""
    return _csv(spark, path, delimiter).columns


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, delimiter: str | None = None) -> DataFrame:
    """Text columns; of a file with other columns too, the given ones are parsed alone."""
    df = _csv(spark, path, delimiter)
    if columns is None:
        return df
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} has no columns {missing}")
    return df.select(*columns)


def read_positions(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Files of a folder with event_id (from the file's name) and row_pos: a row's number from 0 in its file.

    Blocks of a file come in order of their start, and rows of a block in order of their ids, so large files may be split.
    """
    df = _csv(spark, path, delimiter)
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    order = Window.partitionBy("_file").orderBy("_block", "_id")
    rows = rows.filter(event_of(F.col("_file")).isNotNull()).withColumn("row_pos", (F.row_number().over(order) - 1).cast("long"))
    return rows.withColumn("event_id", event_of(F.col("_file"))).drop("_file", "_block", "_id")


def event_of(name: Column) -> Column:
    """The event's number in a file name comma_<number>.csv, else null."""
    found = F.regexp_extract(name, EVENT_FILE, 1)
    return F.when(found != "", found.cast("long"))


def event_files(spark: SparkSession, path: str) -> DataFrame:
    """event_id, path of the event files of a folder; files with other names don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "comma_*.csv").load(path).select("path")
    # No contents are read, so few tasks do for many files.
    files = files.coalesce(4 * spark.sparkContext.defaultParallelism)
    return files.select(event_of(F.col("path")).alias("event_id"), "path").filter("event_id is not null")


def write_event_files(df: DataFrame, event: str, order: Sequence, path: str) -> None:
    """One comma_<event>.csv for each event that isn't null, with the other columns in an order, after a header."""
    names = [c for c in df.columns if c != event]
    rows = df.filter(F.col(event).isNotNull()).withColumn("_event", F.col(event).cast("long")).repartition("_event").sortWithinPartitions("_event", *order).drop(event)
    if folder := _mounted(df.sparkSession, path):
        head = df.sparkSession.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(c) for c in names)))).first()[0]
        _event_lines(rows.select("_event", F.to_csv(F.struct(*names)).alias("value")), folder, head)
    else:
        _named_files(df.sparkSession, rows.write.partitionBy("_event").option("header", True).csv, path)


def fetch_events(spark: SparkSession, source: str, target: str, wanted: DataFrame | None = None) -> DataFrame:
    """event_id, fetched of the wanted events (all, if None): files of one folder are copied to another, and present ones skipped.

    Both folders may be in any store that Spark reaches. An event that the source has no file of is an error, and then
    nothing is copied. Copies are made by executors, one file at a time, and appear whole.
    """
    there = settled_rows(event_files(spark, source))
    if wanted is not None:
        wanted = settled_rows(wanted.select("event_id").distinct())
        unknown = without_file(wanted, there).orderBy("event_id").limit(10).collect()
        if unknown:
            raise ValueError(f"there are no files of events {[r['event_id'] for r in unknown]}, and maybe others")
        there = there.join(wanted, "event_id", "left_semi")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(target))
    present = event_files(spark, target).select("event_id", F.lit(True).alias("present"))
    chosen = settled_rows(there.join(present, "event_id", "left").select("event_id", "path", F.col("present").isNull().alias("fetched")))
    folder = _mounted(spark, target)
    if folder and _mounted(spark, source):
        parts = 4 * spark.sparkContext.defaultParallelism
        chosen.filter("fetched").repartition(parts, "path").select("path").mapInArrow(_copies(folder), "path string").write.format("noop").mode("overwrite").save()
        return chosen.drop("path")
    lines = spark.read.option("pathGlobFilter", "comma_*.csv").text(source).select(F.monotonically_increasing_id().alias("n"), "value", event_of(F.col("_metadata.file_path")).alias("event_id"), F.col("_metadata.file_block_start").alias("at"))
    lines = lines.join(chosen.filter("fetched"), "event_id", "left_semi")
    _named_files(spark, lines.repartition("event_id").sortWithinPartitions("event_id", "at", "n").select(F.col("event_id").alias("_event"), "value").write.partitionBy("_event").text, target)
    return chosen.drop("path")


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder as all nodes have it mounted, if its store is files; None where only Spark reaches it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    uri = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop(path)).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _appear(part: str, folder: str, name: str) -> None:
    """A whole file gets its name; a checksum that Hadoop left of an earlier one goes."""
    if os.path.exists(f"{folder}/.{name}.crc"):
        os.remove(f"{folder}/.{name}.crc")
    os.replace(part, f"{folder}/{name}")


def _copies(folder: str):
    """Paths of mounted files -> each copied to the folder, under its name."""

    def run(batches):
        part = f"{folder}/_{uuid.uuid4().hex}"
        for batch in batches:
            for path in batch.column(0).to_pylist():
                shutil.copyfile(path.removeprefix("file:"), part)
                _appear(part, folder, path.rsplit("/", 1)[1])
        yield from ()

    return run


def _event_lines(lines: DataFrame, folder: str, head: str) -> None:
    """Lines (_event, value), sorted and an event's in one partition, become comma_<event>.csv of a mounted folder, after a head.

    Tasks write a file under a hidden name and then rename it. Spark's writer would make a folder for each event, and the
    driver would commit and rename them one by one.
    """

    def run(batches):
        now, out, part = None, None, f"{folder}/_{uuid.uuid4().hex}"
        for batch in batches:
            for event, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if event != now:
                    if out:
                        out.close()
                        _appear(part, folder, f"comma_{now}.csv")
                    now, out = event, open(part, "w", encoding="utf-8", newline="")
                    out.write(head + "\n")
                out.write(value + "\n")
        if out:
            out.close()
            _appear(part, folder, f"comma_{now}.csv")
        yield from ()

    os.makedirs(folder, exist_ok=True)
    lines.mapInArrow(run, "_event long").write.format("noop").mode("overwrite").save()


def _named_files(spark: SparkSession, write, path: str) -> None:
    """What write(folder) puts below _event=<n> becomes comma_<n>.csv of path, in any store."""
    part = f"{path}-{uuid.uuid4().hex}"
    write(part)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(path))
    for found in fs.globStatus(hadoop(f"{part}/_event=*/part-*")):
        source = found.getPath()
        fs.rename(source, hadoop(f"{path}/comma_{source.getParent().getName().removeprefix('_event=')}.csv"))
    fs.delete(hadoop(part), True)


def without_file(events: DataFrame, files: DataFrame) -> DataFrame:
    """Events that no file is there for."""
    return events.join(files.select("event_id"), "event_id", "left_anti")


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.option("compression", "zstd").partitionBy(*partition_by).mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.options(header=True, sep=delimiter).mode("overwrite").csv(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON text a row, with its columns in order and nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def load_yaml(spark: SparkSession, path: str) -> dict:
    """A small configuration file."""
    import yaml

    return yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small frame as a table; an error if it has more rows than a report should."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report's table has {most} rows at most")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *([cell(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def numpy_schema(dims: int) -> str:
    return "path string, row long, " + ("x double" if dims == 1 else "x array<double>")


def read_numpy(spark: SparkSession, path: str) -> DataFrame:
    """path, row, x (a row's values, flattened) of .npy files of numbers."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInArrow(_numpy_rows, numpy_schema(2))


def _numpy_rows(batches: Iterable):
    import ast

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            wide = raw[6] >= 2
            size = struct.unpack_from("<I" if wide else "<H", raw, 8)[0]
            start = 12 if wide else 10
            head = ast.literal_eval(raw[start : start + size].decode("latin-1"))
            x = np.frombuffer(raw, head["descr"], offset=start + size).reshape(head["shape"], order="F" if head["fortran_order"] else "C")
            x = x.reshape(len(x), -1).astype(np.float64)
            yield pa.RecordBatch.from_pydict({"path": [path] * len(x), "row": list(range(len(x))), "x": pa.array(list(x), pa.list_(pa.float64()))})


SCALER = "names array<string>, mean array<float>, std array<float>, source_site string, source_split string"


def save_scaler(scaler: DataFrame, names: Sequence[str], path: str, site: str, split: str) -> None:
    """A scaler's rows (feature_index, mean, std) as one row with where they come from."""
    ordered = F.array_sort(F.collect_list(F.struct("feature_index", "mean", "std")))
    one = scaler.agg(ordered.alias("s")).select(
        F.array(*map(F.lit, names)).alias("names"), F.col("s.mean").cast("array<float>").alias("mean"), F.col("s.std").cast("array<float>").alias("std"), F.lit(site).alias("source_site"), F.lit(split).alias("source_split")
    )
    one.coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str, names: Sequence[str], site: str, split: str = "train") -> DataFrame:
    """feature_index, name, mean, std; an error if names, site or split aren't what is asked for."""
    df = spark.read.schema(SCALER).parquet(path)
    row = df.first()
    if list(row["names"]) != list(names) or row["source_site"] != site or row["source_split"] != split:
        raise ValueError("the scaler is of other features, another site or another split")
    return df.select(F.posexplode(F.arrays_zip("names", "mean", "std")).alias("feature_index", "s")).select("feature_index", F.col("s.names").alias("name"), F.col("s.mean").cast("double").alias("mean"), F.col("s.std").cast("double").alias("std"))


AUDIT = "site string, frequency struct<plausible: long, implausible: long, median_hz: double, passed: boolean>"


def write_audits(df: DataFrame, path: str) -> None:
    """One JSON object a site: site, and the columns of audit.frequency_check as `frequency`."""
    write_json(df.select("site", F.struct("plausible", "implausible", "median_hz", "passed").alias("frequency")), path)


def read_audits(spark: SparkSession, path: str) -> DataFrame:
    """site, plausible, implausible, median_hz, passed of audit files."""
    return read_json(spark, path, AUDIT).select("site", "frequency.*")


def passing_audit(spark: SparkSession, path: str, site: str) -> dict:
    """A site's frequency audit; an error if there is none of that site, or it didn't pass."""
    rows = read_audits(spark, path).filter(F.col("site") == site).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} frequency audits are of site {site}")
    if not rows[0]["passed"]:
        raise ValueError(f"site {site} failed its frequency audit")
    return rows[0].asDict()


CURVE = "wind array<double>, power array<double>, scale double, provenance map<string, string>"


def save_curve(spark: SparkSession, curve: PowerCurve, path: str) -> None:
    write_json(spark.createDataFrame([(curve.wind, curve.power, curve.scale, curve.provenance)], CURVE).coalesce(1), path)


def load_curve(spark: SparkSession, path: str, site: str) -> PowerCurve:
    """A power curve from JSON; an error if it is another site's."""
    row = read_json(spark, path, CURVE).first()
    if row is None or row["provenance"].get("site") != site:
        raise ValueError(f"the power curve isn't site {site}'s")
    return PowerCurve(list(row["wind"]), list(row["power"]), row["scale"], dict(row["provenance"]))


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    """asset_id, split of a split file, one JSON object {"assignments": {asset: split}, ...}."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    found = json.loads(text)["assignments"]
    return spark.createDataFrame(sorted(found.items()), "asset_id string, split string")


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """One text, such as a model, in a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def load_text(spark: SparkSession, path: str) -> str:
    found = spark.read.option("wholetext", True).text(path).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{path} must hold one text")
    return found[0][0].removesuffix("\n")
