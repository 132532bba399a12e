"""The registered queries: one for each operator of the inventory that the driver's tables can show."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics, scalars
from ..operators import audit, boosting, logistic, metrics, models, priority, scaling, series, shift, training
from ..sources import files
from .registry import query
from .views import PHASES_SQL, PREDICTIONS_SQL, READINGS_SQL, farm, phases, predictions, readings, table

TAU = 0.1
GRID = metrics.thresholds(*metrics.COST_GRID)
GRID_SQL = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in GRID) + ") g(threshold)"
WITH = f"WITH {PREDICTIONS_SQL}"
READ = f"WITH {READINGS_SQL}"
PHASE = f"WITH {PHASES_SQL}"


# Sources and sinks


@query("s1_delimiters", f"{READ} SELECT ';' AS delimiter, count(*) AS rows, sum(x) AS total FROM readings UNION ALL SELECT chr(9), count(*), sum(x) FROM readings", "total")
def s1_delimiters(spark, sf_dir):
    out = None
    for d in (";", "\t"):
        path = files.shared_folder(spark)
        files.write_csv(readings(spark, sf_dir).select("asset_id", "s", "x"), path, d)
        found = files.detect_delimiter(spark, path)
        one = files.read_csv(spark, path, ["x"]).agg(F.lit(found).alias("delimiter"), F.count("*").alias("rows"), F.sum(F.col("x").cast("double")).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("s2_csv_columns", f"{READ} SELECT asset_id, count(*) AS rows, max(x) AS most FROM readings GROUP BY asset_id", "most")
def s2_csv_columns(spark, sf_dir):
    path = files.shared_folder(spark)
    files.write_csv(readings(spark, sf_dir), path)
    return files.read_csv(spark, path, ["asset_id", "x"]).groupBy("asset_id").agg(F.count("*").alias("rows"), F.max(scalars.number(F.col("x"))).alias("most"))


@query("s3_schema_probe", "SELECT unnest(['asset_id', 's', 'ts', 'x', 'kind']) AS name")
def s3_schema_probe(spark, sf_dir):
    path = files.shared_folder(spark)
    files.write_csv(readings(spark, sf_dir), path)
    return spark.createDataFrame([(c,) for c in files.csv_columns(spark, path)], "name string")


def _event_folder(spark, sf_dir):
    """One comma_<user>.csv for each user, as event files are laid out."""
    path = files.shared_folder(spark)
    files.write_event_files(readings(spark, sf_dir).select(F.col("asset_id").cast("long").alias("event_id"), "asset_id", "s", "x"), "event_id", [F.desc("s"), "x"], path)
    return path


@query("s5_event_files", "SELECT DISTINCT user_id AS event_id FROM events")
def s5_event_files(spark, sf_dir):
    return files.event_files(spark, _event_folder(spark, sf_dir)).select("event_id")


@query("s6_events_without_file", "SELECT c_custkey AS event_id FROM customer EXCEPT SELECT user_id FROM events")
def s6_events_without_file(spark, sf_dir):
    events = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"))
    return files.without_file(events, files.event_files(spark, _event_folder(spark, sf_dir)))


@query("s18_fetched_events", "SELECT DISTINCT user_id AS event_id, user_id % 3 <> 0 AS fetched, count(*) OVER (PARTITION BY user_id) AS rows FROM events WHERE user_id % 2 = 0")
def s18_fetched_events(spark, sf_dir):
    """A subset of events by id is the feature: every other event is fetched, and those that were fetched before are skipped."""
    source, target = _event_folder(spark, sf_dir), files.shared_folder(spark)
    even = files.settled_rows(files.event_files(spark, source).select("event_id").filter("event_id % 2 = 0"))
    files.fetch_events(spark, source, target, even.filter("event_id % 3 = 0"))
    fetched = files.fetch_events(spark, source, target, even)
    rows = files.read_positions(spark, target).groupBy("event_id").agg(F.count("*").alias("rows"))
    return fetched.join(rows, "event_id").select("event_id", "fetched", "rows")


@query("s7_parquet_round_trip", f"{READ} SELECT kind, count(*) AS rows, sum(x) AS total FROM readings GROUP BY kind", "total")
def s7_parquet_round_trip(spark, sf_dir):
    path = files.shared_folder(spark)
    files.write_parquet(readings(spark, sf_dir), path, ["kind"])
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("rows"), F.sum("x").alias("total"))


@query("s9_scaler_round_trip", "SELECT (i - 1)::INTEGER AS feature_index, 'f' || (i - 1) AS name, avg(embedding[i]::DOUBLE)::FLOAT::DOUBLE AS mean, stddev_pop(embedding[i]::DOUBLE)::FLOAT::DOUBLE AS std FROM embeddings, range(1, 65) t(i) GROUP BY i", "mean std")
def s9_scaler_round_trip(spark, sf_dir):
    path, names = files.shared_folder(spark), [f"f{i}" for i in range(64)]
    files.save_scaler(_scaler(spark, sf_dir), names, path, "C", "train")
    return files.load_scaler(spark, path, names, "C")


@query("s11_json_sink", f"{READ} SELECT asset_id, count(*) AS rows FROM readings GROUP BY asset_id")
def s11_json_sink(spark, sf_dir):
    path = files.shared_folder(spark)
    files.write_json(readings(spark, sf_dir).groupBy("asset_id").agg(F.count("*").alias("rows")), path)
    return files.read_json(spark, path, "asset_id string, rows long")


FREQUENCY_SQL = "SELECT CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS site, 40 + value % 20 AS v FROM events"


@query("s12_json_sources", f"SELECT site, count(*) FILTER (v BETWEEN 45 AND 55) AS plausible, count(*) FILTER (NOT v BETWEEN 45 AND 55) AS implausible, median(v) FILTER (v BETWEEN 45 AND 55) AS median_hz, coalesce(abs(median(v) FILTER (v BETWEEN 45 AND 55) - 50) <= 0.5, FALSE) AS passed FROM ({FREQUENCY_SQL}) GROUP BY site", "median_hz")
def s12_json_sources(spark, sf_dir):
    """Frequency audits written as JSON and read again."""
    path, e = files.shared_folder(spark), table(spark, sf_dir, "events")
    rows = e.select(farm(F.col("user_id")).alias("site"), (40 + F.col("value") % 20).alias("v"))
    files.write_audits(audit.frequency_check(rows, F.col("v"), ["site"]), path)
    return files.read_audits(spark, path)


@query("s13_csv_sink", f"{READ} SELECT kind, count(*) AS rows FROM readings GROUP BY kind")
def s13_csv_sink(spark, sf_dir):
    path = files.shared_folder(spark)
    files.write_csv(readings(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("rows")), path)
    return files.read_csv(spark, path).select("kind", F.col("rows").cast("long").alias("rows"))


@query("s15_json_lines_append", f"{READ} SELECT kind, month(ts) AS month, count(*) AS rows, sum(x) AS total FROM readings GROUP BY 1, 2", "total")
def s15_json_lines_append(spark, sf_dir):
    """Each kind's months, appended to one log kind by kind."""
    path, months = files.shared_folder(spark), readings(spark, sf_dir).groupBy("kind", F.month("ts").alias("month")).agg(F.count("*").alias("rows"), F.sum("x").alias("total"))
    for kind in ("click", "error", "purchase", "signup", "view"):
        files.append_json_lines(months.filter(F.col("kind") == kind), path)
    files.append_json_lines(months.filter(~F.col("kind").isin("click", "error", "purchase", "signup", "view")), path)
    return files.read_json(spark, path, "kind string, month int, rows long, total double")


@query("s19_fingerprint", "SELECT item_id, sha256(text || chr(10)) AS sha256, strlen(text)::BIGINT + 1 AS length FROM benchmark")
def s19_fingerprint(spark, sf_dir):
    """Each item in a file of its own."""
    path = files.shared_folder(spark)
    table(spark, sf_dir, "benchmark").repartition("item_id").write.partitionBy("item_id").text(path)
    found = files.fingerprints(spark, path)
    return found.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "sha256", "length")


@query("s20_row_positions", f"{READ} SELECT asset_id::BIGINT AS event_id, row_number() OVER (PARTITION BY asset_id ORDER BY s DESC, x) - 1 AS row_pos, s FROM readings")
def s20_row_positions(spark, sf_dir):
    return files.read_positions(spark, _event_folder(spark, sf_dir)).select("event_id", "row_pos", F.col("s").cast("long").alias("s"))


# Projection, filter, deduplication


@query("p1_resolved_columns", "SELECT event_id, value AS sensor_1, value * 2 AS sensor_2 FROM events", "sensor_1 sensor_2")
def p1_resolved_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("sensor_1_avg"), F.col("value").alias("sensor_1"), (F.col("value") * 2).alias("sensor_2_average"), (F.col("value") * 9).alias("sensor_2_max"))
    return physics.by_sensor(raw, ["sensor_1", "sensor_2"], ["event_id"])


@query("p6_numbers", "SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'bad' WHEN event_id % 7 = 0 THEN ' ' || value ELSE value::VARCHAR END AS DOUBLE) AS x FROM events", "x")
def p6_numbers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, "bad").when(F.col("event_id") % 7 == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    return e.select("event_id", scalars.number(text).alias("x"))


@query("p7_timestamps", "SELECT event_id, ts FROM events WHERE event_id % 4 <> 0")
def p7_timestamps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 4 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    return e.select("event_id", text.try_cast("timestamp_ntz").alias("ts")).filter("ts is not null")


@query("p8_first_per_time", f"{READ} SELECT asset_id, s // 86400 * 86400 AS s, arg_min(x, ts) AS x FROM readings GROUP BY 1, 2", "x")
def p8_first_per_time(spark, sf_dir):
    days = readings(spark, sf_dir).withColumn("s", F.floor(F.col("s") / 86400) * 86400)
    return series.first_per_time(days, ["asset_id"], "s", "ts").select("asset_id", "s", "x")


@query("p9_filters", f"{READ} SELECT asset_id, s, x FROM readings WHERE kind = 'error' AND x BETWEEN 10 AND 60", "x")
def p9_filters(spark, sf_dir):
    return readings(spark, sf_dir).filter((F.col("kind") == "error") & F.col("x").between(10, 60)).select("asset_id", "s", "x")


@query("p10_same_word", "SELECT event_id FROM events WHERE lower(trim('  ' || upper(event_type) || ' ')) = 'view'")
def p10_same_word(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
    return e.filter(scalars.same_word(F.col("t"), "View")).select("event_id")


@query("p11_plausible", "SELECT count(*) FILTER (value BETWEEN 45 AND 55) AS plausible, count(*) FILTER (NOT value BETWEEN 45 AND 55) AS implausible, median(value) FILTER (value BETWEEN 45 AND 55) AS median_hz, abs(median(value) FILTER (value BETWEEN 45 AND 55) - 50) <= 0.5 AS passed FROM events", "median_hz")
def p11_plausible(spark, sf_dir):
    return audit.frequency_check(table(spark, sf_dir, "events"), F.col("value"))


@query("p12_prepared", f"{WITH} SELECT event_id, asset_id, window_end, probability FROM pred WHERE farm = 'B' AND label = 0", "probability")
def p12_prepared(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumns({"split": F.col("farm"), "mask": 1 - F.col("label")})
    return metrics.prepare(p, split="B").select("event_id", "asset_id", "window_end", "probability")


@query("p13_membership", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def p13_membership(spark, sf_dir):
    some = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(some, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("p14_systematic", f"""{READ}, n AS (SELECT asset_id, ts, x, row_number() OVER (PARTITION BY asset_id ORDER BY ts) - 1 AS n, count(*) OVER (PARTITION BY asset_id) AS c FROM readings),
k AS (SELECT *, greatest(1, c // 10) AS step FROM n) SELECT asset_id, ts, x FROM k WHERE n % step = 0 AND n // step < 10""", "x")
def p14_systematic(spark, sf_dir):
    return audit.systematic(readings(spark, sf_dir), "asset_id", "ts", 10).filter("_picked").select("asset_id", "ts", "x")


@query("p15_clipped", "SELECT event_id, greatest(-10, least(10, (value - 50) / 4)) AS z, abs((value - 50) / 4) > 10 AS was_clipped FROM events", "z")
def p15_clipped(spark, sf_dir):
    z = (F.col("value") - 50) / 4
    return table(spark, sf_dir, "events").select("event_id", scalars.clipped(z).alias("z"), (F.abs(z) > 10).alias("was_clipped"))


@query("p16_masked_rows", "SELECT vec_id, (i - 1)::INTEGER AS feature_index, greatest(-10, least(10, embedding[i]::DOUBLE * 50)) AS x FROM embeddings, range(1, 65) t(i) WHERE vec_id % 3 <> 0", "x")
def p16_masked_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 50).alias("features"), (F.col("vec_id") % 3 != 0).cast("int").alias("mask"))
    return scaling.long_tensor(scaling.masked_rows(e, ["vec_id"]), ["vec_id"])


# Joins


EVENTS_SQL = f"{READ}, ev AS (SELECT asset_id, min(s) // 3600 * 3600 AS start_s0, min(s) // 3600 * 3600 + 259200 AS end_s0 FROM readings GROUP BY asset_id)"
#: Coarser than the contract, as events are hours apart: 24 h windows of 600 s steps with at least three readings, gaps of 15 h.
COARSE = {"coverage": 3 / 144, "gap": 54000}


def event_bounds(spark, sf_dir):
    r = readings(spark, sf_dir)
    start = F.floor(F.min("s") / 3600) * 3600
    return r.groupBy("asset_id").agg(start.alias("start_s0"), (start + 259200).alias("end_s0"))


@query("j1_dense_grid", f"""{EVENTS_SQL}, w AS (SELECT asset_id, unnest(generate_series(start_s0, end_s0 - 600, 3600)) AS end_s FROM ev),
g AS (SELECT asset_id, end_s, unnest(generate_series(end_s - 85800, end_s, 600)) AS s FROM w), r AS (SELECT asset_id, s // 600 * 600 AS s, max(x) AS x FROM readings GROUP BY 1, 2)
SELECT g.asset_id, g.end_s, ((g.s - g.end_s + 85800) // 600)::INTEGER AS timestep_idx, g.s, r.x FROM g LEFT JOIN r ON g.asset_id = r.asset_id AND g.s = r.s""", "x")
def j1_dense_grid(spark, sf_dir):
    r = readings(spark, sf_dir).groupBy("asset_id", (F.floor(F.col("s") / 600) * 600).alias("s")).agg(F.max("x").alias("x"))
    return series.grid(series.candidates(event_bounds(spark, sf_dir)), "asset_id", r).select("asset_id", "end_s", "timestep_idx", "s", "x")


@query("j2_endpoint_semi", f"{EVENTS_SQL}, w AS (SELECT asset_id, unnest(generate_series(start_s0, end_s0 - 600, 3600)) AS end_s FROM ev) SELECT asset_id, end_s FROM w WHERE (asset_id, end_s) IN (SELECT (asset_id, s // 3600 * 3600) FROM readings)")
def j2_endpoint_semi(spark, sf_dir):
    hours = readings(spark, sf_dir).select("asset_id", (F.floor(F.col("s") / 3600) * 3600).alias("end_s"))
    return series.candidates(event_bounds(spark, sf_dir)).select("asset_id", "end_s").join(hours, ["asset_id", "end_s"], "left_semi")


@query("j3_window_slice", f"""{EVENTS_SQL}, w AS (SELECT asset_id, unnest(generate_series(start_s0, end_s0 - 600, 3600)) AS end_s FROM ev)
SELECT w.asset_id, w.end_s, count(r.s) AS n_rows FROM w LEFT JOIN readings r ON w.asset_id = r.asset_id AND r.s BETWEEN w.end_s - 85800 AND w.end_s GROUP BY 1, 2""")
def j3_window_slice(spark, sf_dir):
    return series.judged_windows(readings(spark, sf_dir), event_bounds(spark, sf_dir), "asset_id").select("asset_id", "end_s", "n_rows")


@query("j4_row_lookup", f"""{READ}, r AS (SELECT asset_id, ts, row_number() OVER (PARTITION BY asset_id ORDER BY x, ts) - 1 AS row_pos FROM readings)
SELECT a.asset_id, a.ts AS start_ts, b.ts AS end_ts FROM r a JOIN r b ON a.asset_id = b.asset_id AND a.row_pos = 3 AND b.row_pos = 9""")
def j4_row_lookup(spark, sf_dir):
    w = Window.partitionBy("asset_id").orderBy("x", "ts")
    r = readings(spark, sf_dir).withColumn("row_pos", F.row_number().over(w) - 1).filter("row_pos in (3, 9)")
    both = r.groupBy("asset_id").agg(F.max(F.when(F.col("row_pos") == 3, F.col("ts"))).alias("start_ts"), F.max(F.when(F.col("row_pos") == 9, F.col("ts"))).alias("end_ts"))
    return both.filter("start_ts is not null and end_ts is not null")


@query("j5_dimension_lookup", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j5_dimension_lookup(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dims = n.join(r, n["n_regionkey"] == r["r_regionkey"])
    c = table(spark, sf_dir, "customer")
    return c.join(dims, c["c_nationkey"] == dims["n_nationkey"]).select("c_custkey", "n_name", "r_name")


@query("j6_split_lookup", f"{READ}, sp AS (SELECT DISTINCT asset_id, CASE WHEN asset_id::BIGINT % 5 = 0 THEN 'test' WHEN asset_id::BIGINT % 5 < 4 THEN 'train' END AS split FROM readings) SELECT split, count(*) AS rows, count(*) FILTER (split IS NULL) AS unmapped FROM readings JOIN sp USING (asset_id) GROUP BY split")
def j6_split_lookup(spark, sf_dir):
    r = readings(spark, sf_dir)
    n = F.col("asset_id").cast("long") % 5
    splits = r.select("asset_id").distinct().withColumn("split", F.when(n == 0, "test").when(n < 4, "train")).filter("split is not null")
    return r.join(splits, "asset_id", "left").groupBy("split").agg(F.count("*").alias("rows"), F.count_if(F.col("split").isNull()).alias("unmapped"))


@query("j7_cost_map", f"{WITH} SELECT farm, sum(CASE farm WHEN 'A' THEN 1.0 ELSE 1.5 END::DOUBLE) AS cost FROM pred WHERE label = 0 AND probability > {TAU} GROUP BY farm", "cost")
def j7_cost_map(spark, sf_dir):
    costs = F.create_map(*[F.lit(x) for f, c in (("A", 1.0), ("B", 1.5), ("C", 1.5)) for x in (f, c)])
    return predictions(spark, sf_dir).filter((F.col("label") == 0) & (F.col("probability") > TAU)).groupBy("farm").agg(F.sum(costs[F.col("farm")]).alias("cost"))


@query("j8_alignment", "SELECT (SELECT count(*) FROM events) + 1 AS rows, 1::BIGINT AS only_right, 0::BIGINT AS only_left, (SELECT count(*) FROM events WHERE event_id % 100 = 7) AS different")
def j8_alignment(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "value")
    other = e.withColumn("value", F.when(F.col("event_id") % 100 == 7, F.col("value") + 1).otherwise(F.col("value")))
    return audit.aligned(e, other.unionByName(spark.createDataFrame([(-1, 0.0)], "event_id long, value double")), ["event_id"], "value")


ODD_WIND = "CASE l_orderkey % 97 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN '-inf'::DOUBLE ELSE wind END"


@query("j11_power_interpolation", f"""{PHASE}, odd AS (SELECT l_orderkey, l_linenumber, l_suppkey, {ODD_WIND} AS wind, power FROM phases),
b AS (SELECT floor(wind / 5) AS bin, median(wind) AS x, median(power) AS y FROM odd WHERE isfinite(wind) GROUP BY 1 HAVING count(*) >= 20),
s AS (SELECT x AS x0, lead(x) OVER (ORDER BY x) AS x1, y AS y0, lead(y) OVER (ORDER BY x) AS y1, row_number() OVER (ORDER BY x) AS n FROM b),
seg AS (SELECT x0, coalesce(x1, 'inf'::DOUBLE) AS x1, y0, coalesce(y1, y0) AS y1 FROM s UNION ALL SELECT '-inf'::DOUBLE, x0, y0, y0 FROM s WHERE n = 1)
SELECT l_orderkey, l_linenumber, l_suppkey, power, coalesce(isnan(wind), FALSE) AS undefined, CASE WHEN isnan(wind) THEN NULL WHEN y0 = y1 THEN y0 ELSE y0 + (wind - x0) / (x1 - x0) * (y1 - y0) END AS expected
FROM odd LEFT JOIN seg ON NOT isnan(wind) AND wind >= x0 AND (wind < x1 OR (wind = 'inf'::DOUBLE AND x1 = wind))""", "expected")
def j11_power_interpolation(spark, sf_dir):
    """Rows without a wind speed, and with one that isn't finite, among them."""
    n = F.col("l_orderkey") % 97
    odd = F.when(n == 0, None).when(n == 1, float("nan")).when(n == 2, float("inf")).when(n == 3, float("-inf")).otherwise(F.col("wind"))
    p = phases(spark, sf_dir).withColumn("wind", odd)
    curve = shift.binned_power_curve(p, "wind", "power", 5.0)
    out = shift.interpolate(p, curve, "wind", "wind_median", "power_median")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "power", F.coalesce(F.isnan("expected"), F.lit(False)).alias("undefined"), scalars.present(F.col("expected")).alias("expected"))


@query("j12_by_farm", f"{WITH} SELECT label, avg(probability) FILTER (farm = 'A') AS A, avg(probability) FILTER (farm = 'B') AS B, avg(probability) FILTER (farm = 'C') AS C FROM pred GROUP BY label", "A B C")
def j12_by_farm(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("label").pivot("farm", ["A", "B", "C"]).agg(F.avg("probability"))


@query("j13_split_leaks", "SELECT user_id::VARCHAR AS asset_id, count(DISTINCT event_type) AS splits FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def j13_split_leaks(spark, sf_dir):
    r = readings(spark, sf_dir).filter("kind in ('view', 'error')")
    return audit.stays_apart(r.withColumnRenamed("kind", "split"))


# Windows, sequences, gaps


WINDOWS_SQL = f"""{EVENTS_SQL}, w AS (SELECT asset_id, unnest(generate_series(start_s0, end_s0 - 600, 3600)) AS end_s FROM ev), h AS (SELECT asset_id, s // 3600 * 3600 AS s, x FROM readings),
i AS (SELECT w.asset_id, w.end_s, h.s, h.x, h.s - lag(h.s) OVER (PARTITION BY w.asset_id, w.end_s ORDER BY h.s) AS step FROM w JOIN h ON w.asset_id = h.asset_id AND h.s BETWEEN w.end_s - 85800 AND w.end_s),
a AS (SELECT asset_id, end_s, count(*) AS n_rows, coalesce(max(step), 0) AS max_gap, count(x) FILTER ((end_s - s) % 600 = 0) AS n_valid, max((s = end_s)::INT) AS e FROM i GROUP BY 1, 2),
o AS (SELECT w.asset_id, w.end_s, coalesce(n_rows, 0) AS n_rows, coalesce(max_gap, 0) AS max_gap, coalesce(n_valid, 0) AS n_valid, coalesce(e, 0) AS e FROM w LEFT JOIN a USING (asset_id, end_s)),
judged AS (SELECT *, CASE WHEN e = 0 THEN 'endpoint' WHEN n_rows < 3 THEN 'coverage' WHEN max_gap > 54000 THEN 'gap' WHEN n_valid = 0 THEN 'valid' ELSE 'keep' END AS reason FROM o)"""


def _judged(spark, sf_dir):
    r = readings(spark, sf_dir).withColumn("s", F.floor(F.col("s") / 3600) * 3600)
    return series.judged_windows(r, event_bounds(spark, sf_dir), "asset_id", **COARSE)


@query("wn1_eligible_windows", f"{WINDOWS_SQL} SELECT asset_id, end_s, end_s - 85800 AS start_s, n_rows, max_gap, n_valid, reason FROM judged")
def wn1_eligible_windows(spark, sf_dir):
    return _judged(spark, sf_dir)


@query("wn1_rejections", f"{WINDOWS_SQL} SELECT reason, count(*) AS windows FROM judged GROUP BY reason")
def wn1_rejections(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("windows"))


@query("wn2_time_steps", f"{READ} SELECT asset_id, ts, s - lag(s) OVER (PARTITION BY asset_id ORDER BY ts) AS step FROM readings")
def wn2_time_steps(spark, sf_dir):
    return readings(spark, sf_dir).select("asset_id", "ts", (F.col("s") - F.lag("s").over(Window.partitionBy("asset_id").orderBy("ts"))).alias("step"))


HOLES = "CASE WHEN kind IN ('error', 'view') THEN x END"


@query("wn3_bounded_fill", f"""{READ}, f AS (SELECT asset_id, ts, last_value({HOLES} IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS y FROM readings)
SELECT asset_id, ts, first_value(y IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS x FROM f""", "x")
def wn3_bounded_fill(spark, sf_dir):
    r = readings(spark, sf_dir).withColumn("x", F.when(F.col("kind").isin("error", "view"), F.col("x")))
    return series.filled(r, ["asset_id"], "ts", "x").select("asset_id", "ts", "x")


@query("wn4_full_fill", f"""{READ}, f AS (SELECT asset_id, ts, last_value(CASE WHEN kind = 'error' THEN x END IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM readings)
SELECT asset_id, ts, first_value(y IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM f""", "x")
def wn4_full_fill(spark, sf_dir):
    r = readings(spark, sf_dir).withColumn("x", F.when(F.col("kind") == "error", F.col("x")))
    return series.filled(r, ["asset_id"], "ts", "x", None).select("asset_id", "ts", "x")


@query("wn5_trailing_mean", f"{WITH} SELECT asset_id, window_end, avg(probability) OVER (PARTITION BY asset_id ORDER BY window_end ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS smoothed FROM pred", "smoothed", 11)
def wn5_trailing_mean(spark, sf_dir):
    return series.trailing_mean(predictions(spark, sf_dir), ["asset_id"], "window_end", "probability").select("asset_id", "window_end", "smoothed")


def runs_sql(source: str, key: str, order: str, flag: str, where: str = "TRUE") -> str:
    return f"""rn AS (SELECT {key}, {flag} AS f, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM {source} WHERE {where}),
    lit AS (SELECT *, n - row_number() OVER (PARTITION BY {key} ORDER BY n) AS g FROM rn WHERE f), runs AS (SELECT {key}, min(n) - 1 AS first, count(*) AS size FROM lit GROUP BY {key}, g)"""


@query("wn6_first_run", f"{READ}, {runs_sql('readings', 'asset_id', 'ts', 'x > 40')} SELECT asset_id, min(first) AS first FROM runs WHERE size >= 2 GROUP BY asset_id")
def wn6_first_run(spark, sf_dir):
    return series.runs(readings(spark, sf_dir), ["asset_id"], ["ts"], F.col("x") > 40).filter("size >= 2").groupBy("asset_id").agg(F.min("first").cast("long").alias("first"))


@query("wn7_count_runs", f"{READ}, {runs_sql('readings', 'asset_id', 'ts', 'x > 40')} SELECT asset_id, count(*) AS runs FROM runs WHERE size >= 2 GROUP BY asset_id")
def wn7_count_runs(spark, sf_dir):
    return series.runs(readings(spark, sf_dir), ["asset_id"], ["ts"], F.col("x") > 40).filter("size >= 2").groupBy("asset_id").agg(F.count("*").alias("runs"))


@query("wn8_longest_zero_run", f"""{READ}, z AS (SELECT asset_id, ts, CASE WHEN kind = 'error' THEN NULL WHEN x < 30 THEN 0 ELSE x END AS x FROM readings), {runs_sql('z', 'asset_id', 'ts', 'coalesce(x = 0, FALSE)')}
SELECT a.asset_id, coalesce(max(size), 0) AS longest FROM (SELECT DISTINCT asset_id FROM z) a LEFT JOIN runs USING (asset_id) GROUP BY 1""")
def wn8_longest_zero_run(spark, sf_dir):
    z = readings(spark, sf_dir).withColumn("x", F.when(F.col("kind") == "error", None).when(F.col("x") < 30, 0.0).otherwise(F.col("x")))
    return audit.longest_zero_runs(z, "asset_id", "ts", "x")


@query("wn9_first_last_change", f"{READ} SELECT asset_id, arg_min(x, ts) AS first, arg_max(x, ts) AS last, arg_max(x, ts) - arg_min(x, ts) AS change FROM readings GROUP BY asset_id", "first last change")
def wn9_first_last_change(spark, sf_dir):
    first, last = F.min_by("x", "ts"), F.max_by("x", "ts")
    return readings(spark, sf_dir).groupBy("asset_id").agg(first.alias("first"), last.alias("last"), (last - first).alias("change"))


@query("wn11_sequence_index", f"{WINDOWS_SQL} SELECT split, asset_id, end_s, row_number() OVER (PARTITION BY split ORDER BY asset_id, end_s) - 1 AS sequence_idx FROM (SELECT *, CASE WHEN asset_id::BIGINT % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM judged WHERE reason = 'keep')")
def wn11_sequence_index(spark, sf_dir):
    kept = _judged(spark, sf_dir).filter("reason = 'keep'").withColumn("split", F.when(F.col("asset_id").cast("long") % 2 == 0, "train").otherwise("test"))
    return models.numbered_sequences(kept, "split", ["asset_id", "end_s"]).select("split", "asset_id", "end_s", "sequence_idx")


@query("wn12_labels", f"{WITH} SELECT event_id, window_end, hours_to_fault, label FROM pred", "hours_to_fault")
def wn12_labels(spark, sf_dir):
    return predictions(spark, sf_dir).select("event_id", "window_end", "hours_to_fault", "label")


@query("wn13_window_features", f"""{WINDOWS_SQL} SELECT i.asset_id, i.end_s, count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, first(x ORDER BY s DESC, x DESC) AS last, first(x ORDER BY s DESC, x DESC) - first(x ORDER BY s, x) AS change
FROM (SELECT w.asset_id, w.end_s, r.s, r.x FROM judged w JOIN readings r ON w.reason = 'keep' AND w.asset_id = r.asset_id AND r.s BETWEEN w.end_s - 85800 AND w.end_s) i GROUP BY 1, 2""", "mean std min max last change")
def wn13_window_features(spark, sf_dir):
    kept = _judged(spark, sf_dir).filter("reason = 'keep'")
    return series.window_features(readings(spark, sf_dir), event_bounds(spark, sf_dir), kept, "asset_id")


# Aggregates


def _scaler(spark, sf_dir):
    return scaling.fit_scaler(scaling.long_tensor(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding"))


TENSOR_SQL = "x AS (SELECT vec_id, (i - 1)::INTEGER AS feature_index, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)), sc AS (SELECT feature_index, count(*) AS n, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS std FROM x GROUP BY 1)"


@query("a1_scaler", f"WITH {TENSOR_SQL} SELECT * FROM sc", "mean std")
def a1_scaler(spark, sf_dir):
    return _scaler(spark, sf_dir)


SUMMARY_SQL = "count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, median(x) AS median, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99, min(x) AS min, max(x) AS max"


@query("a2_feature_summary", f"WITH {TENSOR_SQL} SELECT feature_index, {SUMMARY_SQL} FROM x GROUP BY feature_index", "mean std median q01 q99 min max")
def a2_feature_summary(spark, sf_dir):
    return shift.summary(scaling.long_tensor(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding").withColumn("x", F.col("x").cast("double")), ["feature_index"])


@query("a3_compression", f"{WITH} SELECT farm, 1 / nullif(stddev_pop(probability), 0) AS compression, row_number() OVER (ORDER BY round(1 / stddev_pop(probability), 6) DESC, farm) AS rank FROM pred GROUP BY farm", "compression")
def a3_compression(spark, sf_dir):
    c = predictions(spark, sf_dir).groupBy("farm").agg(shift.compression(F.stddev_pop("probability")).alias("compression"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("compression", 6)), "farm")).cast("long"))


@query("a4_power_curve", f"{PHASE} SELECT floor(wind / 5)::BIGINT AS bin, median(wind) AS wind_median, median(power) AS power_median, count(*) AS count FROM phases WHERE wind >= 0 GROUP BY 1 HAVING count(*) >= 20", "wind_median power_median")
def a4_power_curve(spark, sf_dir):
    return shift.binned_power_curve(phases(spark, sf_dir), "wind", "power", 5.0)


@query("a4_power_scale", f"{PHASE} SELECT quantile_cont(abs(power), 0.99) AS power_scale FROM phases", "power_scale")
def a4_power_scale(spark, sf_dir):
    return shift.power_scale(phases(spark, sf_dir), "power")


@query("a5_curve_population", f"{WITH} SELECT count(*) AS rows, sum(probability) AS total FROM pred WHERE hours_to_fault IS NULL AND asset_id IN (SELECT user_id::VARCHAR FROM events WHERE user_id % 5 < 3)", "total")
def a5_curve_population(spark, sf_dir):
    train = table(spark, sf_dir, "events").filter("user_id % 5 < 3").select(F.col("user_id").cast("string").alias("asset_id"))
    return predictions(spark, sf_dir).filter("hours_to_fault is null").join(train, "asset_id", "left_semi").agg(F.count("*").alias("rows"), F.sum("probability").alias("total"))


@query("a6_label_shift", f"""{WITH}, d AS (SELECT farm, asset_id, event_id, count(*) AS d FROM pred WHERE label = 1 GROUP BY ALL), r AS (SELECT farm, count(*) AS rows, avg(label) AS positive_rate FROM pred GROUP BY farm),
s AS (SELECT farm, count(*) AS fault_events, avg(d) AS mean_duration, median(d) AS median_duration, min(d) AS min_duration, max(d) AS max_duration FROM d GROUP BY farm)
SELECT r.farm, rows, positive_rate, coalesce(fault_events, 0) AS fault_events, mean_duration, median_duration, min_duration, max_duration FROM r LEFT JOIN s USING (farm)""", "positive_rate mean_duration median_duration")
def a6_label_shift(spark, sf_dir):
    return shift.label_shift(predictions(spark, sf_dir))


CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a7_channel_audit", "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS channel, {c} + 0.0 AS x FROM lineitem" for c in CHANNELS) + """) SELECT channel, count(*) AS rows, count(*) - count(x) AS missing, 0::BIGINT AS infinite, count(*) FILTER (x = 0) AS zeros,
count(*) FILTER (x < 0) AS negatives, min(x) AS min, max(x) AS max, min(x) = max(x) AS constant, median(x) AS median, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM x GROUP BY channel""", "min max median q01 q99")
def a7_channel_audit(spark, sf_dir):
    return audit.channel_audit(table(spark, sf_dir, "lineitem").select(*(F.col(c) + 0.0 for c in CHANNELS)).toDF(*CHANNELS), CHANNELS)


@query("a8_validity", f"{PHASE} SELECT avg((p2 > 0)::INT) AS valid_fraction, min(CASE WHEN p2 > 0 THEN p1 / p2 END) AS min, median(CASE WHEN p2 > 0 THEN p1 / p2 END) AS median, max(CASE WHEN p2 > 0 THEN p1 / p2 END) AS max FROM phases", "valid_fraction min median max")
def a8_validity(spark, sf_dir):
    p = phases(spark, sf_dir).withColumn("v", F.when(F.col("p2") > 0, F.try_divide("p1", "p2")))
    return audit.validity(p, "v")


@query("a9_continuity", f"""{READ}, t AS (SELECT asset_id, CASE WHEN kind = 'error' THEN NULL ELSE s // 7200 * 7200 END AS s FROM readings), d AS (SELECT asset_id, s, count(*) AS c FROM t GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN s IS NOT NULL THEN s - lag(s) OVER (PARTITION BY asset_id ORDER BY s NULLS FIRST) END AS step FROM d)
SELECT asset_id, sum(c)::BIGINT AS rows, coalesce(sum(c) FILTER (s IS NULL), 0)::BIGINT AS invalid_times, (sum(c) - count(*))::BIGINT AS duplicates, count(*) FILTER (step > 7200) AS gaps, coalesce(max(step), 0) AS max_gap FROM l GROUP BY 1""")
def a9_continuity(spark, sf_dir):
    hours = F.floor(F.col("s") / 7200) * 2
    t = F.when(F.col("kind") != "error", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), hours.cast("int")))
    return series.continuity(readings(spark, sf_dir).select("asset_id", t.alias("t")), ["asset_id"], "t", 7200)


@query("a10_missing_share", "SELECT unnest(['event_id', 'ts', 'value']) AS channel, unnest([avg((event_id IS NULL)::INT), avg((ts IS NULL)::INT), avg((event_type = 'error')::INT)]) * 100 AS missing_pct FROM events", "missing_pct")
def a10_missing_share(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return audit.missing_share(e, e.columns)


@query("a12_single_asset", f"{WITH} SELECT event_id, count(DISTINCT asset_id) AS assets, count(DISTINCT asset_id) = 1 AS ok FROM pred GROUP BY event_id")
def a12_single_asset(spark, sf_dir):
    return audit.single_asset(predictions(spark, sf_dir))


@query("a13_crosstab", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority <> '1-URGENT') AS other, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def a13_crosstab(spark, sf_dir):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(urgent).alias("urgent"), F.count_if(~urgent).alias("other"), F.count_distinct("o_custkey").alias("customers"))


def counts_sql(op: str = ">") -> str:
    return f"count(*) FILTER (label = 0 AND NOT probability {op} {TAU}) AS tn, count(*) FILTER (label = 0 AND probability {op} {TAU}) AS fp, count(*) FILTER (label = 1 AND NOT probability {op} {TAU}) AS fn, count(*) FILTER (label = 1 AND probability {op} {TAU}) AS tp"


RATES_SQL = "coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1"


@query("a14_confusion", f"{WITH}, c AS (SELECT farm, {counts_sql()}, avg((probability - label) ** 2) AS brier FROM pred GROUP BY farm) SELECT farm, tn, fp, fn, tp, (tp + tn) / (tn + fp + fn + tp) AS accuracy, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy, {RATES_SQL}, brier FROM c", "accuracy balanced_accuracy precision recall f1 brier")
def a14_confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), TAU, True, ["farm"])


RANK_SQL = """h AS (SELECT {by}, probability, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} GROUP BY ALL),
r AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY probability) - neg / 2 AS below, sum(pos) OVER (PARTITION BY {by} ORDER BY probability DESC) AS tp, sum(neg) OVER (PARTITION BY {by} ORDER BY probability DESC) AS fp FROM h),
ranked AS (SELECT {by}, sum(pos + neg)::BIGINT AS n, sum(pos)::BIGINT AS n_positive, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN (sum(pos * below) / (sum(pos)::DOUBLE * sum(neg)))::DOUBLE END AS roc_auc, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN (sum(pos * (tp::DOUBLE / (tp + fp))) / sum(pos))::DOUBLE END AS pr_auc FROM r GROUP BY {by})"""


@query("a15_roc_auc", f"{WITH}, {RANK_SQL.format(by='farm', source='pred')} SELECT farm, roc_auc FROM ranked", "roc_auc")
def a15_roc_auc(spark, sf_dir):
    return metrics.ranking(predictions(spark, sf_dir), ["farm"]).select("farm", "roc_auc")


LABELLED_SQL = "q AS (SELECT 'all' AS one, least(n_chars / 20000.0, 1.0)::DOUBLE AS probability, quality AS label FROM labels JOIN documents USING (doc_id))"


def _labelled(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("probability"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("label", F.col("quality"))


@query("a16_average_precision", f"WITH {LABELLED_SQL}, {RANK_SQL.format(by='one', source='q')} SELECT n, n_positive, roc_auc, pr_auc FROM ranked", "roc_auc pr_auc")
def a16_average_precision(spark, sf_dir):
    return metrics.ranking(_labelled(spark, sf_dir))


CURVE_SQL = f"""{WITH}, g AS (SELECT 0.01 + i * ((0.99 - 0.01) / 98::DOUBLE) AS threshold FROM range(98) t(i) UNION ALL SELECT 0.99::DOUBLE),
curve AS (SELECT threshold, count(*) FILTER (label = 1 AND NOT probability > threshold) AS n_fn, count(*) FILTER (label = 0 AND probability > threshold) AS n_fp,
count(*) FILTER (label = 1 AND probability > threshold) AS n_tp, count(*) FILTER (label = 0 AND NOT probability > threshold) AS n_tn FROM pred, g GROUP BY threshold)"""


@query("a17_cost_curve", f"{CURVE_SQL} SELECT threshold, n_fn, n_fp, n_tp, n_tn, n_fn * 10.0::DOUBLE AS cost_fn_total, n_fp * 1.0::DOUBLE AS cost_fp_total, n_fn * 10.0::DOUBLE + n_fp AS total_cost FROM curve", "threshold cost_fn_total cost_fp_total total_cost")
def a17_cost_curve(spark, sf_dir):
    return metrics.cost_curve(predictions(spark, sf_dir))


@query("a17_asset_costs", f"{WITH}, g AS (SELECT * FROM {GRID_SQL}), k AS (SELECT threshold, count(*) FILTER (label = 1 AND NOT probability > threshold) AS n_fn, count(*) FILTER (label = 0 AND probability > threshold) AS n_fp, coalesce(sum(CASE WHEN asset_id::BIGINT % 2 = 0 THEN 1.0 ELSE 1.5 END::DOUBLE) FILTER (label = 0 AND probability > threshold), 0) AS w FROM pred, g GROUP BY 1) SELECT threshold, n_fn, n_fp, n_fn * 10.0::DOUBLE + w AS total_cost FROM k", "threshold total_cost")
def a17_asset_costs(spark, sf_dir):
    p = predictions(spark, sf_dir)
    rows = metrics.swept(p, GRID, True, F.when(F.col("asset_id").cast("long") % 2 == 0, 1.0).otherwise(1.5))
    return rows.select("threshold", "n_fn", "n_fp", (F.col("n_fn") * 10.0 + F.col("fp_weight")).alias("total_cost"))


@query("a18_optimal_threshold", f"{CURVE_SQL} SELECT threshold, n_fn * 10.0::DOUBLE + n_fp AS total_cost FROM curve ORDER BY total_cost, threshold LIMIT 1", "threshold total_cost")
def a18_optimal_threshold(spark, sf_dir):
    return metrics.optimal_threshold(metrics.cost_curve(predictions(spark, sf_dir))).select("threshold", "total_cost")


@query("a19_most_f1", f"""{WITH}, g AS (SELECT 0.01 + i * ((0.99 - 0.01) / 196::DOUBLE) AS threshold FROM range(196) t(i) UNION ALL SELECT 0.99::DOUBLE),
c AS (SELECT threshold, count(*) FILTER (label = 1 AND probability >= threshold) AS tp, count(*) FILTER (label = 0 AND probability >= threshold) AS fp, count(*) FILTER (label = 1 AND probability < threshold) AS fn FROM pred, g GROUP BY 1)
SELECT threshold, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c ORDER BY f1 DESC, threshold LIMIT 1""", "threshold f1")
def a19_most_f1(spark, sf_dir):
    return metrics.threshold_of_most_f1(predictions(spark, sf_dir))


def most_f1_sql(source: str) -> str:
    """The observed score with most F1, the lowest of ties."""
    return f"""oh AS (SELECT probability, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM {source} GROUP BY 1),
    orun AS (SELECT probability, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p FROM oh WINDOW w AS (ORDER BY probability DESC)),
    best AS (SELECT probability AS threshold, round(coalesce((2.0::DOUBLE * tp / nullif(tp + fp + p, 0))::DOUBLE, 0), 12) AS f1 FROM orun ORDER BY f1 DESC, threshold LIMIT 1)"""


@query("a20_observed_threshold", f"{WITH}, {most_f1_sql('pred')} SELECT * FROM best", "threshold f1")
def a20_observed_threshold(spark, sf_dir):
    return metrics.threshold_among_scores(predictions(spark, sf_dir))


@query("a21_policy_costs", f"{WITH} SELECT count(*) FILTER (label = 1) AS n_positive_windows, count(*) FILTER (label = 0) AS n_negative_windows, count(*) FILTER (label = 1) * 10.0::DOUBLE AS reactive_only_cost, count(*) FILTER (label = 0) * 1.0::DOUBLE AS always_alarm_cost FROM pred", "reactive_only_cost always_alarm_cost")
def a21_policy_costs(spark, sf_dir):
    return metrics.policy_costs(predictions(spark, sf_dir))


@query("a22_cost_ratios", f"""{CURVE_SQL}, k AS (SELECT r::DOUBLE AS cost_ratio, threshold, n_fn * r::DOUBLE + n_fp AS cost, n_fn, n_fp, (n_fn + n_tp) * r::DOUBLE AS reactive, (n_fp + n_tn)::DOUBLE AS always FROM curve, (VALUES (2), (5), (10), (20), (50)) v(r)),
b AS (SELECT *, row_number() OVER (PARTITION BY cost_ratio ORDER BY cost, threshold) AS n FROM k)
SELECT cost_ratio, threshold AS model_optimal_threshold, cost AS model_cost, n_fn AS model_n_fn, n_fp AS model_n_fp, reactive AS reactive_only_cost, always AS always_alarm_cost, (reactive - cost) * 100 / nullif(reactive, 0) AS reduction_vs_reactive_only_pct, (always - cost) * 100 / nullif(always, 0) AS reduction_vs_always_alarm_pct FROM b WHERE n = 1""",
       "cost_ratio model_optimal_threshold model_cost reactive_only_cost always_alarm_cost reduction_vs_reactive_only_pct reduction_vs_always_alarm_pct")
def a22_cost_ratios(spark, sf_dir):
    return metrics.cost_ratio_sensitivity(predictions(spark, sf_dir))


KEY = "asset_id, event_id"


def lead_sql(tau: float, least: int, window: float | None = None) -> str:
    where = "hours_to_fault IS NOT NULL" + (f" AND hours_to_fault <= {window}" if window else "")
    order = "hours_to_fault DESC, window_end"
    return f"""f AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY {order}) - 1 AS at FROM pred WHERE {where}),
    {runs_sql('pred', KEY, order, f'probability > {tau}', where)}, al AS (SELECT {KEY}, min(first) AS alarm FROM runs WHERE size >= {least} GROUP BY {KEY}),
    {runs_sql('pred', KEY, order, f'probability > {tau}', where + ' AND hours_to_fault <= 48').replace('rn AS', 'rn2 AS').replace('lit AS', 'lit2 AS').replace('runs AS', 'runs2 AS').replace('FROM rn', 'FROM rn2').replace('FROM lit', 'FROM lit2')},
    inside AS (SELECT DISTINCT {KEY} FROM runs2 WHERE size >= {least}),
    per AS (SELECT {KEY}, count(*) AS n_windows, max(probability) AS max_probability, max(probability) FILTER (hours_to_fault <= 48) AS max_probability_in_horizon FROM f GROUP BY {KEY}),
    hit AS (SELECT f.asset_id, f.event_id, f.hours_to_fault AS lead_time_hours FROM f JOIN al USING ({KEY}) WHERE f.at = al.alarm),
    lead AS (SELECT per.asset_id, per.event_id, n_windows, lead_time_hours IS NOT NULL AS detected, lead_time_hours, coalesce(lead_time_hours <= 48, FALSE) AS within_label_horizon, inside.asset_id IS NOT NULL AS alarmed_in_horizon, max_probability, max_probability_in_horizon
    FROM per LEFT JOIN hit USING ({KEY}) LEFT JOIN inside ON per.asset_id = inside.asset_id AND per.event_id = inside.event_id)"""


@query("a23_lead_time", f"{WITH}, {lead_sql(TAU, 1)} SELECT * FROM lead", "lead_time_hours max_probability max_probability_in_horizon")
def a23_lead_time(spark, sf_dir):
    return metrics.lead_time(predictions(spark, sf_dir), TAU)


@query("a23_lead_time_runs", f"{WITH}, {lead_sql(TAU, 2, 72.0)} SELECT * FROM lead", "lead_time_hours max_probability max_probability_in_horizon")
def a23_lead_time_runs(spark, sf_dir):
    return metrics.lead_time(predictions(spark, sf_dir), TAU, 2, 72.0)


LEAD_SUMMARY_SQL = "count(*) AS n_fault_events, count(*) FILTER (detected) AS n_detected, avg(detected::INT) AS detection_rate, avg(lead_time_hours) AS mean_lead_time_hours, median(lead_time_hours) AS median_lead_time_hours, min(lead_time_hours) AS min_lead_time_hours, max(lead_time_hours) AS max_lead_time_hours, count(*) FILTER (detected AND NOT within_label_horizon) AS n_beyond_label_horizon"


@query("a24_lead_time_summary", f"{WITH}, {lead_sql(TAU, 1)} SELECT {LEAD_SUMMARY_SQL} FROM lead", "detection_rate mean_lead_time_hours median_lead_time_hours min_lead_time_hours max_lead_time_hours")
def a24_lead_time_summary(spark, sf_dir):
    return metrics.lead_time_summary(metrics.lead_time(predictions(spark, sf_dir), TAU))


def alarms_sql(tau: float, least: int, name: str = "alarms") -> str:
    return f"""{runs_sql('pred', KEY, 'window_end', f'probability > {tau}', 'hours_to_fault IS NULL')}, ep AS (SELECT {KEY}, count(*) AS e FROM runs WHERE size >= {least} GROUP BY {KEY}),
    nw AS (SELECT {KEY}, count(*) AS w, count(*) FILTER (probability > {tau}) AS a FROM pred WHERE hours_to_fault IS NULL GROUP BY {KEY}), np AS (SELECT *, coalesce(e, 0) AS ee FROM nw LEFT JOIN ep USING ({KEY})),
    {name} AS (SELECT count(*) AS n_normal_events, coalesce(sum(w), 0)::BIGINT AS n_normal_windows, coalesce(sum(a), 0)::BIGINT AS n_alarm_windows, (sum(a)::DOUBLE / nullif(sum(w), 0))::DOUBLE AS window_alarm_rate, coalesce(sum(ee), 0)::BIGINT AS n_alarm_episodes,
    (sum(ee) * 1000.0::DOUBLE / nullif(sum(w), 0))::DOUBLE AS episodes_per_1000h, count(*) FILTER (ee > 0) AS n_events_with_alarm, (count(*) FILTER (ee > 0))::DOUBLE / nullif(count(*), 0) AS event_alarm_rate FROM np)"""


@query("a25_false_alarms", f"{WITH}, {alarms_sql(0.02, 2)} SELECT * FROM alarms", "window_alarm_rate episodes_per_1000h event_alarm_rate")
def a25_false_alarms(spark, sf_dir):
    return metrics.false_alarm_rate(predictions(spark, sf_dir), 0.02, 2)


OPERATING = metrics.thresholds(0.05, 0.95, 19)


def _operating_sql(tau: float) -> str:
    return f"SELECT {tau}::DOUBLE AS threshold, 1::INTEGER AS min_consecutive, n_fault_events, detection_rate, median_lead_time_hours, mean_lead_time_hours, window_alarm_rate, episodes_per_1000h, event_alarm_rate FROM (WITH {lead_sql(tau, 1)} SELECT {LEAD_SUMMARY_SQL} FROM lead), (WITH {alarms_sql(tau, 1)} SELECT * FROM alarms)"


@query("a26_operating_points", f"{WITH} " + " UNION ALL ".join(f"({_operating_sql(t)})" for t in OPERATING), "threshold detection_rate median_lead_time_hours mean_lead_time_hours window_alarm_rate episodes_per_1000h event_alarm_rate")
def a26_operating_points(spark, sf_dir):
    return metrics.operating_points(predictions(spark, sf_dir), OPERATING)


@query("a27_breakdown", f"{WITH}, b AS (SELECT farm, probability, label FROM pred UNION ALL SELECT 'ALL', probability, label FROM pred), {RANK_SQL.format(by='farm', source='b')}, c AS (SELECT farm, {counts_sql()} FROM b GROUP BY farm) SELECT farm, n, n_positive, n_positive / n AS positive_rate, roc_auc, pr_auc, {RATES_SQL} FROM ranked JOIN c USING (farm)", "positive_rate roc_auc pr_auc precision recall f1")
def a27_breakdown(spark, sf_dir):
    return metrics.breakdown(predictions(spark, sf_dir), TAU, "farm")


@query("a28_brier", f"{WITH} SELECT avg((probability - label) ** 2) AS brier_score FROM pred", "brier_score")
def a28_brier(spark, sf_dir):
    return metrics.brier_score(predictions(spark, sf_dir))


INNER = [i * 0.1 for i in range(1, 10)]
BINS_SQL = f"""edges AS (SELECT i AS bin, [{', '.join(repr(e) for e in [0.0, *INNER])}][i + 1]::DOUBLE AS bin_lower, [{', '.join(repr(e) for e in [*INNER, 1.0])}][i + 1]::DOUBLE AS bin_upper FROM range(10) t(i)),
bin AS (SELECT {' + '.join(f'(probability >= {e!r}::DOUBLE)::INT' for e in INNER)} AS bin, probability, label FROM pred), agg AS (SELECT bin, count(*) AS count, avg(probability) AS mean_predicted, avg(label) AS observed_rate FROM bin GROUP BY 1),
rel AS (SELECT bin_lower, bin_upper, coalesce(count, 0) AS count, mean_predicted, observed_rate FROM edges LEFT JOIN agg USING (bin))"""


@query("a29_reliability", f"{WITH}, {BINS_SQL} SELECT * FROM rel", "bin_lower bin_upper mean_predicted observed_rate")
def a29_reliability(spark, sf_dir):
    return metrics.reliability_table(predictions(spark, sf_dir))


@query("a30_calibration_error", f"{WITH}, {BINS_SQL} SELECT (sum(count * abs(mean_predicted - observed_rate)) / sum(count))::DOUBLE AS ece, count(*) FILTER (count > 0) AS n_bins_populated FROM rel", "ece")
def a30_calibration_error(spark, sf_dir):
    return metrics.calibration_error(metrics.reliability_table(predictions(spark, sf_dir)))


@query("a31_event_report", f"{WITH} SELECT event_id, count(*) AS windows, count(*) FILTER (probability >= {TAU}) AS predicted, count(*) FILTER (probability >= {TAU} AND label = 1) AS tp, count(*) FILTER (probability >= {TAU} AND label = 0) AS fp, max(probability) AS max_probability, max(hours_to_fault) FILTER (probability >= {TAU} AND label = 1) AS earliest_warning FROM pred GROUP BY 1", "max_probability earliest_warning")
def a31_event_report(spark, sf_dir):
    hit, yes = F.col("probability") >= TAU, F.col("label") == 1
    return predictions(spark, sf_dir).groupBy("event_id").agg(
        F.count("*").alias("windows"), F.count_if(hit).alias("predicted"), F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.max("probability").alias("max_probability"), F.max(F.when(hit & yes, F.col("hours_to_fault"))).alias("earliest_warning")
    )


@query("a32_split_counts", f"{WITH} SELECT farm, count(*) AS rows, count(DISTINCT event_id) AS events, count(*) FILTER (label = 1) AS positives, list_sort(list(DISTINCT label))::VARCHAR AS labels FROM pred GROUP BY farm")
def a32_split_counts(spark, sf_dir):
    labels = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("label")).cast("array<string>"), ", "), F.lit("]"))
    return predictions(spark, sf_dir).groupBy("farm").agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("events"), F.count_if(F.col("label") == 1).alias("positives"), labels.alias("labels"))


@query("a33_degradation", f"{WITH}, n AS (SELECT asset_id, probability, (row_number() OVER (PARTITION BY asset_id ORDER BY window_end) - 1) / 6::DOUBLE AS h FROM pred) SELECT asset_id, regr_slope(probability, h) AS slope FROM n GROUP BY asset_id HAVING count(*) > 1", "slope")
def a33_degradation(spark, sf_dir):
    h = (F.row_number().over(Window.partitionBy("asset_id").orderBy("window_end")) - 1) / 6.0
    return predictions(spark, sf_dir).withColumn("h", h).groupBy("asset_id").agg(F.count("*").alias("n"), priority.degradation_rate("probability", F.col("h")).alias("slope")).filter("n > 1").select("asset_id", "slope")


@query("a34_positive_weight", f"{WITH} SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) AS pos_weight FROM pred", "pos_weight")
def a34_positive_weight(spark, sf_dir):
    return models.positive_weight(predictions(spark, sf_dir))


@query("a35_balanced_weights", f"{WITH} SELECT event_id, window_end, label, (SELECT count(*) FROM pred) / (2.0::DOUBLE * count(*) OVER (PARTITION BY label)) AS weight FROM pred", "weight")
def a35_balanced_weights(spark, sf_dir):
    return models.balanced_weights(predictions(spark, sf_dir)).select("event_id", "window_end", "label", "weight")


# Scalar functions


@query("f1_wrapped_angles", "SELECT event_id, ((value * 30 - 700) + 180) - 360 * floor(((value * 30 - 700) + 180) / 360) - 180 AS angle FROM events", "angle")
def f1_wrapped_angles(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.wrap_to_180(F.col("value") * 30 - 700).alias("angle"))


ROW = "l_orderkey, l_linenumber, l_suppkey, wind, power"
ROWS = ROW.split(", ")


@query("f2_phase_imbalance", f"{PHASE} SELECT {ROW}, greatest(abs(p1 - (p1 + p2 + p3) / 3), abs(p2 - (p1 + p2 + p3) / 3), abs(p3 - (p1 + p2 + p3) / 3)) / (abs((p1 + p2 + p3) / 3) + 1e-6) AS imbalance FROM phases", "imbalance")
def f2_phase_imbalance(spark, sf_dir):
    return phases(spark, sf_dir).select(*ROWS, physics.phase_imbalance(F.col("p1"), F.col("p2"), F.col("p3")).alias("imbalance"))


@query("f3_power_factor", f"{PHASE} SELECT {ROW}, abs(p2) / nullif(sqrt(p2 * p2 + p3 * p3), 0) AS factor FROM phases", "factor")
def f3_power_factor(spark, sf_dir):
    return phases(spark, sf_dir).select(*ROWS, physics.power_factor(F.col("p2"), F.col("p3")).alias("factor"))


@query("f4_probe_extremes", f"{PHASE} SELECT {ROW}, CASE WHEN p2 <> 0 THEN greatest(p1, p2, p3) END AS most, CASE WHEN p2 <> 0 THEN (p1 + p2 + p3) / 3 END AS mean FROM phases", "most mean")
def f4_probe_extremes(spark, sf_dir):
    cs = F.col("p1"), F.when(F.col("p2") != 0, F.col("p2")), F.col("p3")
    return phases(spark, sf_dir).select(*ROWS, physics.most_of(*cs).alias("most"), physics.mean_of(*cs).alias("mean"))


SITE = physics.Site("p1", ("p2",), ("p1", "p3"), ("p2", "p3"), "p1", ("p1", "p2"), "p1", ("p3",), "power", "p1", ("p1", "p2", "p3"), ("p3", "p1", "p2"), "wind", True)


def _imbalance_sql(a: str, b: str, c: str, least: float) -> str:
    m = f"(({a} + {b} + {c}) / 3)"
    return f"CASE WHEN abs({m}) >= {least} THEN greatest(abs({a} - {m}), abs({b} - {m}), abs({c} - {m})) / (abs({m}) + 1e-6) END"


@query(
    "f6_physical_features",
    f"""{PHASE} SELECT {ROW}, CASE WHEN p1 >= 0 THEN p1 END AS wind_speed_mps, p2 AS pitch_angle_deg, abs((p1 - p3 + 180) - 360 * floor((p1 - p3 + 180) / 360) - 180) AS yaw_misalignment_deg, (p2 + p3) / 2 - p1 AS gearbox_oil_rise_C,
    greatest(p1, p2) - (p2 + p3) / 2 AS gearbox_bearing_hotspot_over_oil_C, CASE WHEN p3 >= 0.5 THEN p1 * (60 / (2 * pi())) / p3 END AS generator_rotor_speed_ratio,
    CASE WHEN sqrt(power * power + p1 * p1) >= 0.02 THEN abs(power) / sqrt(power * power + p1 * p1) END AS grid_power_factor,
    {_imbalance_sql('p1', 'p2', 'p3', 0.1)} AS grid_current_imbalance, {_imbalance_sql('p3', 'p1', 'p2', 1.0)} AS grid_voltage_imbalance, abs(wind - 50) AS grid_frequency_deviation_Hz FROM phases""",
    " ".join(physics.FEATURES),
)
def f6_physical_features(spark, sf_dir):
    return phases(spark, sf_dir).select(*ROWS, *(v.alias(k) for k, v in physics.physical_features(SITE).items()))


KNOTS = ([10.0, 20.0, 40.0], [1000.0, 30000.0, 60000.0], 500.0)


@query("f6_residual", f"""{PHASE} SELECT {ROW}, (power - CASE WHEN wind <= 10 THEN 1000 WHEN wind < 20 THEN 1000 + (wind - 10) * 2900 WHEN wind < 40 THEN 30000 + (wind - 20) * 1500 ELSE 60000 END) / 500 AS power_residual, NULL::DOUBLE AS grid_frequency_deviation_Hz FROM phases""", "power_residual grid_frequency_deviation_Hz")
def f6_residual(spark, sf_dir):
    """With a power curve, at a site whose frequency audit failed."""
    site = replace(SITE, wind="wind", frequency_passed=False)
    made = physics.physical_features(site, KNOTS)
    return phases(spark, sf_dir).select(*ROWS, *(made[n].cast("double").alias(n) for n in ("power_residual", "grid_frequency_deviation_Hz")))


@query("f7_scaled", f"WITH {TENSOR_SQL} SELECT vec_id, feature_index, x.x, (x.x - mean) / std AS z FROM x JOIN sc USING (feature_index)", "x z")
def f7_scaled(spark, sf_dir):
    rows = scaling.long_tensor(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding").withColumn("x", F.col("x").cast("double"))
    return scaling.apply_scaler(rows, _scaler(spark, sf_dir)).select("vec_id", "feature_index", "x", "z")


@query("f8_mean_filled", f"WITH {TENSOR_SQL} SELECT vec_id, feature_index, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE greatest(-2, least(2, (x - mean) / std)) END AS z FROM x JOIN sc USING (feature_index)", "z")
def f8_mean_filled(spark, sf_dir):
    rows = scaling.long_tensor(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding").withColumn("x", F.when(F.col("vec_id") % 4 != 0, F.col("x").cast("double")))
    return scaling.apply_scaler(rows, _scaler(spark, sf_dir), 2.0).select("vec_id", "feature_index", "z")


@query("f9_unscaled", f"WITH {TENSOR_SQL} SELECT vec_id, feature_index, x FROM x", "x")
def f9_unscaled(spark, sf_dir):
    rows = scaling.long_tensor(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    scaler = _scaler(spark, sf_dir)
    z = scaling.apply_scaler(rows, scaler).drop("x").join(F.broadcast(scaler), "feature_index")
    return z.select("vec_id", "feature_index", scaling.unscaled(F.col("z"), F.col("mean"), F.col("std")).alias("x"))


@query("f11_integer_ids", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_id END AS id FROM events")
def f11_integer_ids(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit(".0"))).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise(F.lit("0.5"))
    return table(spark, sf_dir, "events").select("event_id", scalars.integer_like(text).alias("id"))


@query("f13_boundaries", f"""{READ}, r AS (SELECT asset_id::BIGINT AS event_id, ts, kind, row_number() OVER (PARTITION BY asset_id ORDER BY x, ts) - 1 AS row_pos FROM readings), v AS (SELECT DISTINCT event_id, event_id % 60 AS start_id, 45::BIGINT AS end_id FROM r)
SELECT v.event_id, v.start_id, v.end_id, a.ts AS start_ts, b.ts AS end_ts, CASE WHEN v.start_id > v.end_id THEN 'order' WHEN a.ts IS NULL OR b.ts IS NULL THEN 'range' WHEN a.ts > b.ts THEN 'time' WHEN NOT (a.kind = 'view' AND b.kind = 'view') THEN 'split' END AS failure
FROM v LEFT JOIN r a ON v.event_id = a.event_id AND v.start_id = a.row_pos LEFT JOIN r b ON v.event_id = b.event_id AND v.end_id = b.row_pos""")
def f13_boundaries(spark, sf_dir):
    w = Window.partitionBy("asset_id").orderBy("x", "ts")
    kind = F.when(F.col("kind") == "view", " Prediction ").otherwise("train")
    r = readings(spark, sf_dir).select(F.col("asset_id").cast("long").alias("event_id"), "ts", kind.alias("train_test"), (F.row_number().over(w) - 1).cast("long").alias("row_pos"))
    events = r.select("event_id").distinct().select("event_id", (F.col("event_id") % 60).alias("start_id"), F.lit(45).cast("long").alias("end_id"))
    return audit.resolved_boundaries(r, events)


@query("f15_date_ranges", "SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + INTERVAL 3 DAY, INTERVAL 1 DAY)) AS day FROM orders")
def f15_date_ranges(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.expr("sequence(o_orderdate, o_orderdate + interval 3 day, interval 1 day)")).alias("day"))


@query("f16_hours", "SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice, (epoch(l_shipdate) - epoch(o_orderdate)) / 3600 AS hours FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "hours l_extendedprice")
def f16_hours(spark, sf_dir):
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", scalars.hours_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("hours"))


@query("f20_access_cost", "SELECT DISTINCT user_id, CASE WHEN user_id % 3 = 0 THEN 1.0 ELSE 1.5 END::DOUBLE AS access_cost FROM events", "access_cost")
def f20_access_cost(spark, sf_dir):
    kind = F.when(F.col("user_id") % 3 == 0, "onshore").otherwise(" OFFSHORE ")
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", priority.access_cost(kind).alias("access_cost"))


@query("f21_criticality", "SELECT user_id, count(*) / 100.0::DOUBLE + sum(value) / 5000 AS criticality FROM events GROUP BY user_id", "criticality")
def f21_criticality(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("v"))
    config = priority.Criticality(reference_capacity=100.0, reference_output=5000.0)
    return e.select("user_id", priority.criticality(F.col("n"), F.col("v"), config).alias("criticality"))


FLEET_SQL = f"""{READ}, h AS (SELECT asset_id, s // 3600 AS hour, least(avg(x) / 500, 1.0) AS p FROM readings GROUP BY 1, 2), sm AS (SELECT asset_id, hour, avg(p) OVER (PARTITION BY asset_id ORDER BY hour ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS sm, row_number() OVER (PARTITION BY asset_id ORDER BY hour) - 1 AS h FROM h),
sig AS (SELECT asset_id, count(*) AS n, arg_max(sm, hour) AS fault_risk, regr_slope(sm, h) AS degradation_rate FROM sm GROUP BY 1 HAVING count(*) > 1), ev AS (SELECT asset_id, count(*) AS events FROM readings GROUP BY 1),
terms AS (SELECT asset_id, fault_risk, degradation_rate, CASE WHEN asset_id::BIGINT % 3 = 0 THEN 1.0 ELSE 1.5 END::DOUBLE AS access_cost, events / 100.0::DOUBLE AS criticality FROM sig JOIN ev USING (asset_id)),
scored AS (SELECT *, round(fault_risk + degradation_rate - access_cost + criticality, 6) AS priority_score FROM terms)"""


def _fleet(spark, sf_dir):
    r = readings(spark, sf_dir)
    hourly = r.groupBy("asset_id", F.floor(F.col("s") / 3600).alias("hour")).agg(F.least(F.avg("x") / 500, F.lit(1.0)).alias("probability"))
    signals = priority.fleet_signals(hourly, "asset_id", "hour", "probability", 6.0, 1.0)
    events = r.groupBy("asset_id").agg(F.count("*").cast("double").alias("events"))
    kind = F.when(farm(F.col("asset_id").cast("long")) == "A", "onshore").otherwise("offshore")
    terms = signals.join(events, "asset_id").withColumns({"access_cost": priority.access_cost(kind), "criticality": priority.criticality(F.col("events"), config=priority.Criticality(reference_capacity=100.0))})
    return priority.with_priority(terms)


@query("f17_fleet_priority", f"{FLEET_SQL} SELECT asset_id, fault_risk, degradation_rate, access_cost, criticality, priority_score, row_number() OVER (ORDER BY priority_score DESC, asset_id) AS rank FROM scored", "fault_risk degradation_rate access_cost criticality priority_score")
def f17_fleet_priority(spark, sf_dir):
    return priority.ranked(_fleet(spark, sf_dir)).select("asset_id", "fault_risk", "degradation_rate", "access_cost", "criticality", "priority_score", F.col("rank").cast("long").alias("rank"))


@query("f18_weighted_priority", f"{FLEET_SQL} SELECT asset_id, 2.0 * fault_risk + 1.5 * degradation_rate - 0.5 * access_cost + 3.0 * criticality AS weighted FROM scored", "weighted")
def f18_weighted_priority(spark, sf_dir):
    return priority.with_priority(_fleet(spark, sf_dir), out="weighted", weights=priority.Weights(2.0, 1.5, 0.5, 3.0)).select("asset_id", "weighted")


@query("f24_strings", "SELECT c_custkey, upper(trim(c_mktsegment)) AS segment, starts_with(c_name, 'Customer') AS named, regexp_extract(c_name, '([0-9]+)', 1) AS number FROM customer")
def f24_strings(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper(F.trim("c_mktsegment")).alias("segment"), F.startswith("c_name", F.lit("Customer")).alias("named"), F.regexp_extract("c_name", "([0-9]+)", 1).alias("number"))


@query("f25_math", "SELECT event_id, floor(value)::BIGINT AS whole, sqrt(value) AS root, 1 / (1 + exp(-value / 50)) AS sigmoid FROM events", "root sigmoid")
def f25_math(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.floor("value").alias("whole"), F.sqrt("value").alias("root"), scalars.sigmoid(F.col("value") / 50).alias("sigmoid"))


@query("f26_packed_sequences", f"{READ} SELECT asset_id, array_to_string(list(kind ORDER BY ts), ',') AS kinds, count(*) AS n FROM readings GROUP BY asset_id")
def f26_packed_sequences(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "kind"))), lambda x: x["kind"])
    return readings(spark, sf_dir).groupBy("asset_id").agg(F.array_join(ordered, ",").alias("kinds"), F.count("*").alias("n"))


@query("f27_json_values", "SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events")
def f27_json_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# Sorting and sets


@query("o2_top_three", f"{READ} SELECT asset_id, sum(x) AS total FROM readings GROUP BY asset_id ORDER BY round(total, 6) DESC, asset_id LIMIT 3", "total")
def o2_top_three(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("asset_id").agg(F.sum("x").alias("total")).orderBy(F.desc(F.round("total", 6)), "asset_id").limit(3)


@query("o3_first_tie", "SELECT l_returnflag, l_quantity AS most, min(l_orderkey) AS first_key FROM lineitem WHERE (l_returnflag, l_quantity) IN (SELECT (l_returnflag, max(l_quantity)) FROM lineitem GROUP BY l_returnflag) GROUP BY 1, 2", "most")
def o3_first_tie(spark, sf_dir):
    best = F.max(F.struct(F.col("l_quantity").alias("q"), (-F.col("l_orderkey")).alias("k")))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(best.alias("b")).select("l_returnflag", F.col("b.q").alias("most"), (-F.col("b.k")).alias("first_key"))


@query("o4_union_all", "SELECT 'supplier' AS kind, s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 2 UNION ALL SELECT 'customer', c_nationkey, count(*) FROM customer GROUP BY 2")
def o4_union_all(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    return s.unionByName(c).groupBy("kind", "nation").agg(F.count("*").alias("n"))


@query("o5_difference", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def o5_difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key", "left_anti")


@query("o6_intersection", "SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def o6_intersection(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")).intersect(table(spark, sf_dir, "customer").select("c_nationkey"))


# Contracts


@query("q1_violations", f"{WITH} SELECT 'binary_label' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'probability', count(*) FILTER (NOT probability BETWEEN 0 AND 1) FROM pred UNION ALL SELECT 'horizon', count(*) FILTER ((label = 1) <> coalesce(hours_to_fault > 0 AND hours_to_fault <= 48, FALSE)) FROM pred UNION ALL SELECT 'fault', count(*) FILTER (hours_to_fault IS NULL) FROM pred")
def q1_violations(spark, sf_dir):
    h = F.col("hours_to_fault")
    rules = {"binary_label": F.col("label").isin(0, 1), "probability": F.col("probability").between(0, 1), "horizon": (F.col("label") == 1) == F.coalesce((h > 0) & (h <= 48), F.lit(False)), "fault": h.isNotNull()}
    return audit.violations(predictions(spark, sf_dir), rules)


@query("q2_scaled_moments", "SELECT feature_index, abs(m) <= 2e-4 AS mean_ok, abs(s - 1) <= 2e-4 AS std_ok FROM (WITH " + TENSOR_SQL + " SELECT feature_index, avg((x - mean) / std) AS m, stddev_pop((x - mean) / std) AS s FROM x JOIN sc USING (feature_index) GROUP BY 1)")
def q2_scaled_moments(spark, sf_dir):
    rows = scaling.long_tensor(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding")
    z = scaling.apply_scaler(rows, _scaler(spark, sf_dir)).groupBy("feature_index").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"))
    return z.select("feature_index", (F.abs("m") <= 2e-4).alias("mean_ok"), (F.abs(F.col("s") - 1) <= 2e-4).alias("std_ok"))


@query("q3_exact_shape", "SELECT count(*) AS rows, count(*) FILTER (len(embedding) = 64) AS full_rows, count(DISTINCT label) > 1 AS both_classes FROM embeddings")
def q3_exact_shape(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("rows"), F.count_if(F.size("embedding") == 64).alias("full_rows"), (F.count_distinct("label") > 1).alias("both_classes"))


# Models


COLUMNS = ["p", "n_chars"]


def quality_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.log1p("n_chars").alias("n_chars"), (F.size(F.split("text", " ")) / F.greatest(F.lit(1.0), F.col("n_chars"))).alias("p"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("label"), *COLUMNS)


def sequences(spark, sf_dir):
    """vec_id, features, labels, mask, part: embeddings as sequences of eight steps, every fourth one for validation."""
    e = table(spark, sf_dir, "embeddings")
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)))
    yes = (F.col("label") > 4).cast("int")
    return e.select("vec_id", steps.alias("features"), F.array_repeat(yes, 8).alias("labels"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: (t != F.col("vec_id") % 8).cast("int")).alias("mask"), F.when(F.col("vec_id") % 4 == 0, "val").otherwise("train").alias("part"))


def trained(spark, sf_dir, **how):
    s = sequences(spark, sf_dir)
    return training.train_recurrent(s.filter("part = 'train'"), s.filter("part = 'val'"), 8, **how)


@query("m1_recurrent_scores", None)
def m1_recurrent_scores(spark, sf_dir):
    """A trained recurrent network's probabilities at every step."""
    out = models.recurrent_scores(sequences(spark, sf_dir), training.of_flat(trained(spark, sf_dir).best))
    return out.select("vec_id", F.posexplode("probabilities").alias("timestep_idx", "probability"))


@query("m1_both_ways", None)
def m1_both_ways(spark, sf_dir):
    """Probabilities of a network that goes over the steps in both directions."""
    out = models.recurrent_scores(sequences(spark, sf_dir), training.of_flat(trained(spark, sf_dir, both_ways=True).best))
    return out.select("vec_id", F.posexplode("probabilities").alias("timestep_idx", "probability"))


@query("m2_training", None)
def m2_training(spark, sf_dir):
    """The losses of each epoch."""
    return spark.createDataFrame(trained(spark, sf_dir).history, "epoch long, train_loss double, val_loss double")


QUALITY_SQL = """rows AS (SELECT doc_id, quality AS label, ln(1 + n_chars) AS n_chars, len(string_split(text, ' ')) / greatest(1.0::DOUBLE, n_chars) AS p FROM labels JOIN documents USING (doc_id))"""
LOGISTIC_SQL = f"WITH {QUALITY_SQL}, {logistic.solution_sql('rows', COLUMNS)}, odds AS (SELECT doc_id, label, 1 / (1 + exp(-(b0 * (coalesce(p, q0) - m0) / d0 + b1 * (coalesce(n_chars, q1) - m1) / d1 + b2))) AS probability FROM rows, solved)"


@query("m5_logistic", f"{LOGISTIC_SQL} SELECT doc_id, label, probability, (probability >= 0.5)::INTEGER AS prediction FROM odds", "probability")
def m5_logistic(spark, sf_dir):
    rows = quality_rows(spark, sf_dir)
    return models.scored(logistic.fit(rows, COLUMNS), rows, 0.5).select("doc_id", "label", "probability", "prediction")


@query("m6_boosted", None)
def m6_boosted(spark, sf_dir):
    """All rounds of boosting; the model is the same on any number of executors, and is tested against a plain version."""
    rows = quality_rows(spark, sf_dir)
    return models.scored(boosting.fit(rows, COLUMNS), rows, 0.5).select("doc_id", "label", "probability", "prediction")


@query("m7_frozen_threshold", f"""{WITH}, t AS (SELECT g.probability AS threshold, 2.0::DOUBLE * count(*) FILTER (p.label = 1 AND p.probability >= g.probability) / (count(*) FILTER (p.probability >= g.probability) + count(*) FILTER (p.label = 1)) AS f1
FROM (SELECT DISTINCT probability FROM pred WHERE farm = 'A') g, pred p WHERE p.farm = 'A' GROUP BY 1 ORDER BY round(f1, 12) DESC, threshold LIMIT 1)
SELECT farm, count(*) AS rows, count(*) FILTER (probability >= threshold) AS predicted FROM pred, t WHERE farm <> 'A' GROUP BY farm""")
def m7_frozen_threshold(spark, sf_dir):
    p = predictions(spark, sf_dir)
    tau = metrics.threshold_among_scores(p.filter("farm = 'A'")).first()["threshold"]
    return p.filter("farm <> 'A'").groupBy("farm").agg(F.count("*").alias("rows"), F.count_if(F.col("probability") >= tau).alias("predicted"))


@query("o8_asset_splits", None)
def o8_asset_splits(spark, sf_dir):
    """All trials over all assets; the winner is that of a plain loop over the trials."""
    per = predictions(spark, sf_dir).groupBy("asset_id").agg(F.count("*").alias("rows"), F.sum("label").alias("positives"))
    n = per.count()
    return models.asset_splits(per, {"train": n - 2 * (n // 5), "val": n // 5, "test": n // 5})
