"""Registered queries for the inventory's smaller rows: formats, contracts, audits and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import physics, scalars
from ..operators import audit, logistic, metrics, models, priority, scaling, series, training
from ..sources import files, tensors
from ..streaming import stateful
from .catalog import COLUMNS, EVENTS_SQL, GRID, GRID_SQL, LOGISTIC_SQL, RATES_SQL, READ, TAU, WITH, event_bounds, most_f1_sql, quality_rows, sequences, trained
from .registry import ORACLE, query
from .views import farm, predictions, readings, table


@query("s4_plain_csv", f"{READ} SELECT asset_id, s, x FROM readings", "x")
def s4_plain_csv(spark, sf_dir):
    path = files.shared_folder(spark)
    files.write_csv(readings(spark, sf_dir).select("asset_id", "s", "x"), path)
    return spark.read.schema("asset_id string, s long, x double").option("header", True).csv(path)


@query("s8_numpy_tensor", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, list_sum(embedding::DOUBLE[]) AS total, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings", "total first last")
def s8_numpy_tensor(spark, sf_dir):
    """The embeddings as a tensor of 8 x 8 a row, in the order of their ids, written as parts and read back by ranges."""
    path = files.shared_folder(spark)
    rows = table(spark, sf_dir, "embeddings").repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    tensors.write_tensor(rows, "embedding", path, (8, 8))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return tensors.read_tensor(spark, path).select("row", total.alias("total"), F.col("x")[0].alias("first"), F.col("x")[63].alias("last"))


def contract_text() -> str:
    """The built-in sites as a YAML contract."""
    import yaml

    sites = {k: {f: list(v) if isinstance(v, tuple) else v for f, v in vars(s).items()} for k, s in physics.SITES.items()}
    return yaml.safe_dump({"version": "physical-v1", "features": list(physics.FEATURES), "sites": sites})


SITE_SQL = "CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END"
#: Readings of the sensors that events stand for, by site and number.
SENSORS_SQL = f"seen AS (SELECT {SITE_SQL} AS site, 'sensor_' || (user_id % 200) AS sensor, count(*) AS readings, avg(value) AS mean FROM events GROUP BY 1, 2)"


def sensor_readings(spark, sf_dir):
    n = F.col("user_id")
    return table(spark, sf_dir, "events").groupBy(farm(n).alias("site"), F.concat(F.lit("sensor_"), (n % 200).cast("string")).alias("sensor")).agg(F.count("*").alias("readings"), F.avg("value").alias("mean"))


def _contract(spark) -> dict:
    """The built-in contract, written as YAML and read again."""
    path = files.shared_folder(spark)
    spark.createDataFrame([(contract_text(),)], "value string").coalesce(1).write.text(path)
    return files.load_yaml(spark, path)


@query("s10_contract", f"WITH {SENSORS_SQL}, required AS ({{REQUIRED}}) SELECT r.site, count(*) AS sensors, count(readings) AS with_readings, coalesce(sum(readings), 0)::BIGINT AS readings FROM required r LEFT JOIN seen s ON r.site = s.site AND r.sensor = s.sensor GROUP BY r.site")
def s10_contract(spark, sf_dir):
    """How much of each site's contract the events cover."""
    sites = physics.load_sites(_contract(spark))
    asked = spark.createDataFrame([(k, s) for k, site in sites.items() for s in site.sensors()], "site string, sensor string")
    met = asked.join(sensor_readings(spark, sf_dir), ["site", "sensor"], "left")
    return met.groupBy("site").agg(F.count("*").alias("sensors"), F.count("readings").alias("with_readings"), F.coalesce(F.sum("readings"), F.lit(0)).alias("readings"))


@query("s14_markdown_report", f"{WITH}, t AS (SELECT farm, count(*) AS rows FROM pred GROUP BY farm) SELECT '| ' || farm || ' | ' || rows || ' |' AS line FROM t UNION ALL SELECT '| farm | rows |' UNION ALL SELECT '| --- | --- |'")
def s14_markdown_report(spark, sf_dir):
    t = predictions(spark, sf_dir).groupBy("farm").agg(F.count("*").alias("rows")).orderBy("farm")
    return spark.createDataFrame([(line,) for line in files.markdown(t).split("\n")], "line string")


@query("s17_model_round_trip", f"{LOGISTIC_SQL} SELECT 'logistic' AS model, doc_id, probability FROM odds", "probability")
def s17_model_round_trip(spark, sf_dir):
    """A model saved as JSON, loaded, and applied."""
    rows, path = quality_rows(spark, sf_dir), files.shared_folder(spark)
    files.save_text(spark, logistic.fit(rows, COLUMNS).dumps(), path)
    model = logistic.Logistic.loads(files.load_text(spark, path))
    return models.scored(model, rows).select(F.lit("logistic").alias("model"), "doc_id", "probability")


@query("p2_renamed_sensors", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity AS quantity, l_tax AS tax FROM lineitem", "quantity tax")
def p2_renamed_sensors(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_quantity": "quantity_avg", "l_tax": "tax"})
    return physics.by_sensor(raw, ["quantity", "tax"], ["l_orderkey", "l_linenumber", "l_suppkey"])


def _sensors_sql(site: str, named: str, *ranges: tuple[int, int]) -> str:
    numbers = ", ".join(str(n) for a, b in ranges for n in range(a, b + 1))
    return f"SELECT '{site}' AS site, unnest(list_concat([{named}], list_transform([{numbers}], lambda n: 'sensor_' || n))) AS sensor"


REQUIRED_SQL = " UNION ALL ".join((
    _sensors_sql("A", "'wind_speed_3', 'power_30'", (0, 0), (2, 2), (5, 5), (11, 12), (18, 18), (23, 26), (31, 34), (52, 52)),
    _sensors_sql("B", "'wind_speed_61', 'power_62', 'reactive_power_11'", (4, 4), (8, 8), (10, 10), (13, 19), (21, 21), (23, 23), (25, 25), (34, 37), (39, 39)),
    _sensors_sql("C", "'wind_speed_236', 'power_6', 'reactive_power_122'", (7, 8), (47, 47), (103, 105), (124, 124), (127, 129), (139, 141), (144, 145), (151, 166), (186, 187)),
))


ORACLE["s10_contract"] = ORACLE["s10_contract"].replace("{REQUIRED}", REQUIRED_SQL)


@query("p4_required_sensors", f"WITH {SENSORS_SQL}, required AS ({REQUIRED_SQL}) SELECT r.site, r.sensor, coalesce(readings, 0) AS readings, mean FROM required r LEFT JOIN seen s ON r.site = s.site AND r.sensor = s.sensor", "mean")
def p4_required_sensors(spark, sf_dir):
    """The readings of every sensor that the contract names somewhere."""
    sites = _contract(spark)["sites"]
    asked = spark.createDataFrame([(k, s) for k, site in sites.items() for s in physics.required_sensors({"site": [site]})], "site string, sensor string")
    return asked.join(sensor_readings(spark, sf_dir), ["site", "sensor"], "left").select("site", "sensor", F.coalesce("readings", F.lit(0)).alias("readings"), "mean")


@query("p3_legacy_columns", "SELECT event_id, value * 1431 AS total, 54::BIGINT AS sensors FROM events", "total")
def p3_legacy_columns(spark, sf_dir):
    """54 sensors, every other one bare, with extremes and deviations beside them."""
    names = [f"sensor_{i}" for i in range(54)]
    columns = {c: F.col("value") * f for i, n in enumerate(names) for c, f in ((f"{n}_avg" if i % 2 else n, i), (f"{n}_max", 9 * i), (f"{n}_std", 7))}
    raw = table(spark, sf_dir, "events").withColumns(columns)
    picked = physics.legacy_columns(raw.columns, [*names, "sensor_99"])
    total = F.aggregate(F.array(*(F.col(c) for c in picked.values())), F.lit(0.0), lambda a, b: a + b)
    return raw.select("event_id", total.alias("total"), F.lit(len(picked)).cast("long").alias("sensors"))


FEATURES_SQL = "[" + ", ".join(f"'{f}'" for f in physics.FEATURES) + ", 'power_residual']"


@query("p5_feature_order", f"SELECT (i - 1)::INTEGER AS feature_index, ({FEATURES_SQL})[i] AS feature, avg(embedding[i]::DOUBLE) AS mean FROM embeddings, range(1, 12) t(i) GROUP BY i", "mean")
def p5_feature_order(spark, sf_dir):
    """Means of a tensor's features, named in the contract's order."""
    names = spark.createDataFrame(list(enumerate(physics.feature_order(True, _contract(spark)))), "feature_index int, feature string")
    means = scaling.long_tensor(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding").groupBy("feature_index").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.join(F.broadcast(names), "feature_index").select("feature_index", "feature", "mean")


def _listed(*numbers: int) -> str:
    return "[" + ", ".join(f'"sensor_{n}"' for n in numbers) + "]"


#: Each feature's sources at the sites A, B and C.
MANIFEST = (
    ('{"wind": "wind_speed_3"}', '{"wind": "wind_speed_61"}', '{"wind": "wind_speed_236"}'),
    (f'{{"pitch": {_listed(5)}}}', f'{{"pitch": {_listed(10)}}}', f'{{"pitch": {_listed(103, 104, 105)}}}'),
    (f'{{"yaw": {_listed(2)}}}', f'{{"yaw": {_listed(4, 21)}}}', f'{{"yaw": {_listed(124)}}}'),
    (f'{{"ambient": "sensor_0", "oil": {_listed(12)}}}', f'{{"ambient": "sensor_8", "oil": {_listed(39)}}}', f'{{"ambient": "sensor_7", "oil": {_listed(186, 187)}}}'),
    (f'{{"bearings": {_listed(11)}, "oil": {_listed(12)}}}', f'{{"bearings": {_listed(34, 35, 36, 37)}, "oil": {_listed(39)}}}', f'{{"bearings": {_listed(*range(151, 167))}, "oil": {_listed(186, 187)}}}'),
    (f'{{"generator": "sensor_18", "rotor": {_listed(52)}}}', f'{{"generator": "sensor_19", "rotor": {_listed(25)}}}', f'{{"generator": "sensor_8", "rotor": {_listed(144, 145)}}}'),
    ('{"active": "power_30", "reactive": "sensor_31"}', '{"active": "power_62", "reactive": "reactive_power_11"}', '{"active": "power_6", "reactive": "reactive_power_122"}'),
    (f'{{"currents": {_listed(23, 24, 25)}}}', f'{{"currents": {_listed(16, 17, 18)}}}', f'{{"currents": {_listed(127, 128, 129)}}}'),
    (f'{{"voltages": {_listed(32, 33, 34)}}}', f'{{"voltages": {_listed(13, 14, 15)}}}', f'{{"voltages": {_listed(139, 140, 141)}}}'),
    ('{"frequency": "sensor_26"}', '{"frequency": "sensor_23"}', '{"frequency": "sensor_47"}'),
)
MANIFEST_SQL = ", ".join(f"({i}, '{physics.FEATURES[i]}', '{site}', '{sources}')" for i, row in enumerate(MANIFEST) for site, sources in zip("ABC", row, strict=True))


@query("p17_manifest", f"SELECT m.*, c.readings, c.assets FROM (VALUES {MANIFEST_SQL}) m(feature_index, feature, site, sources) JOIN (SELECT {SITE_SQL} AS site, count(*) AS readings, count(DISTINCT user_id) AS assets FROM events GROUP BY 1) c ON m.site = c.site")
def p17_manifest(spark, sf_dir):
    """Each feature's sources at each site, with the site's readings and assets."""
    m = spark.createDataFrame(physics.manifest(physics.SITES), "feature_index int, feature string, site string, sources string")
    sites = table(spark, sf_dir, "events").groupBy(farm(F.col("user_id")).alias("site")).agg(F.count("*").alias("readings"), F.count_distinct("user_id").alias("assets"))
    return sites.join(F.broadcast(m), "site").select("feature_index", "feature", "site", "sources", "readings", "assets")


@query("p18_renamed_probability", f"{WITH} SELECT event_id, window_end, probability FROM pred", "probability")
def p18_renamed_probability(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumnRenamed("probability", "prob")
    return (p.withColumnRenamed("prob", "probability") if "probability" not in p.columns else p).select("event_id", "window_end", "probability")


@query("j9_attached_predictions", f"{WITH} SELECT event_id, asset_id, window_end, label, (probability >= {TAU})::INTEGER AS prediction FROM pred")
def j9_attached_predictions(spark, sf_dir):
    return predictions(spark, sf_dir).select("event_id", "asset_id", "window_end", "label", (F.col("probability") >= TAU).cast("int").alias("prediction"))


@query("j10_threshold_grid", f"{WITH}, g AS (SELECT * FROM {GRID_SQL}) SELECT farm, threshold, count(*) FILTER (label = 1 AND probability > threshold) AS n_tp, count(*) FILTER (label = 0 AND probability > threshold) AS n_fp, count(*) FILTER (label = 1 AND NOT probability > threshold) AS n_fn FROM pred, g GROUP BY farm, threshold", "threshold")
def j10_threshold_grid(spark, sf_dir):
    return metrics.swept(predictions(spark, sf_dir), GRID, True, None, ["farm"]).select("farm", "threshold", "n_tp", "n_fp", "n_fn")


@query("wn10_stable_rank", "SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY round(s_acctbal, 6) DESC, s_suppkey) AS rank FROM supplier", "s_acctbal")
def wn10_stable_rank(spark, sf_dir):
    s = priority.ranked(table(spark, sf_dir, "supplier"), "s_acctbal", "s_suppkey")
    return s.select("s_suppkey", "s_acctbal", F.col("rank").cast("long").alias("rank"))


@query("a11_frequency", "SELECT farm, count(*) FILTER (v BETWEEN 45 AND 55) AS plausible, count(*) FILTER (NOT v BETWEEN 45 AND 55) AS implausible, median(v) FILTER (v BETWEEN 45 AND 55) AS median_hz, coalesce(abs(median(v) FILTER (v BETWEEN 45 AND 55) - 50) <= 0.5, FALSE) AS passed FROM (SELECT user_id % 3 AS farm, 40 + value % 20 AS v FROM events) GROUP BY farm", "median_hz")
def a11_frequency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("farm"), (40 + F.col("value") % 20).alias("v"))
    return audit.frequency_check(e, F.col("v"), ["farm"])


@query("f5_finite", "SELECT event_id, event_id % 4 NOT IN (1, 2, 3) AS ok FROM events")
def f5_finite(spark, sf_dir):
    n = F.col("event_id") % 4
    x = F.when(n == 1, float("nan")).when(n == 2, float("-inf")).when(n == 0, F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", scalars.finite(x).alias("ok"))


METADATA_SQL = f"""{EVENTS_SQL}, an AS (SELECT asset_id, count(*) FILTER (kind = 'error') > 0 AS anomaly FROM readings GROUP BY 1), w AS (SELECT asset_id, end_s0, unnest(generate_series(start_s0, end_s0 - 600, 3600)) AS end_s FROM ev),
q AS (SELECT *, CASE WHEN asset_id::BIGINT % 4 = 0 THEN 'val' ELSE 'train' END AS split, row_number() OVER (PARTITION BY asset_id::BIGINT % 4 = 0 ORDER BY asset_id::BIGINT, end_s) - 1 AS sequence_idx FROM w),
g AS (SELECT *, unnest(range(144))::INTEGER AS timestep_idx FROM q), t AS (SELECT *, end_s - 85800 + timestep_idx * 600 AS s FROM g), r AS (SELECT DISTINCT asset_id, s // 600 * 600 AS s FROM readings),
m AS (SELECT t.*, anomaly, r.s IS NOT NULL AS seen FROM t JOIN an USING (asset_id) LEFT JOIN r ON t.asset_id = r.asset_id AND t.s = r.s)
SELECT CASE asset_id::BIGINT % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS farm, split, sequence_idx, timestep_idx, asset_id, asset_id::BIGINT AS event_id, make_timestamp(s * 1000000) AS window_end, make_timestamp(end_s0 * 1000000) AS event_end,
CASE WHEN anomaly THEN make_timestamp(end_s0 * 1000000) END AS fault_time, CASE WHEN anomaly THEN (end_s0 - s) / 3600.0::DOUBLE END AS hours_to_fault, (anomaly AND end_s0 - s > 0 AND end_s0 - s <= 172800)::INTEGER AS label, seen::INTEGER AS mask FROM m"""


@query("f10_metadata", METADATA_SQL, "hours_to_fault")
def f10_metadata(spark, sf_dir):
    """Steps of a window each hour of every asset's event; assets with an error are anomalies."""
    r = readings(spark, sf_dir)
    anomaly = r.groupBy("asset_id").agg((F.count_if(F.col("kind") == "error") > 0).alias("anomaly"))
    seen = r.select("asset_id", (F.floor(F.col("s") / 600) * 600).alias("s")).distinct().withColumn("x", F.lit(1))
    n, windows = F.col("asset_id").cast("long"), series.candidates(event_bounds(spark, sf_dir).join(anomaly, "asset_id"))
    split = F.when(n % 4 == 0, "val").otherwise("train")
    windows = series.numbered_windows(windows, "asset_id", split, n)
    steps = series.grid(windows, "asset_id", seen, keep=["anomaly", "end_s0", "split", "event_id", "sequence_idx"])
    return series.timestep_metadata(steps, None, "asset_id", farm(n), split, n, F.col("x").isNotNull())


@query("f12_required_times", "SELECT count(*) FILTER (event_id % 9 <> 0) AS valid, count(*) FILTER (event_id % 9 = 0) AS invalid FROM events")
def f12_required_times(spark, sf_dir):
    text = F.when(F.col("event_id") % 9 != 0, F.col("ts").cast("string")).otherwise("2024-13-45")
    t = table(spark, sf_dir, "events").select(text.try_cast("timestamp_ntz").alias("t"))
    return t.agg(F.count("t").alias("valid"), F.count_if(F.col("t").isNull()).alias("invalid"))


def _boundaries(spark, sf_dir):
    w = Window.partitionBy("asset_id").orderBy("ts")
    r = readings(spark, sf_dir).select(F.col("asset_id").cast("long").alias("event_id"), "ts", F.lit("prediction").alias("train_test"), (F.row_number().over(w) - 1).cast("long").alias("row_pos"))
    events = r.select("event_id").distinct().select("event_id", F.lit(2).cast("long").alias("start_id"), F.lit(20).cast("long").alias("end_id"))
    return r, audit.resolved_boundaries(r, events)


BOUNDS_SQL = f"{READ}, r AS (SELECT asset_id::BIGINT AS event_id, ts, row_number() OVER (PARTITION BY asset_id ORDER BY ts) - 1 AS row_pos FROM readings), v AS (SELECT DISTINCT event_id FROM r), b AS (SELECT v.event_id, a.ts AS st, z.ts AS et, CASE WHEN a.ts IS NULL OR z.ts IS NULL THEN 'range' END AS failure FROM v LEFT JOIN r a ON v.event_id = a.event_id AND a.row_pos = 2 LEFT JOIN r z ON v.event_id = z.event_id AND z.row_pos = 20)"


@query("f14_boundary_audit", f"{BOUNDS_SQL} SELECT event_id, failure, CASE WHEN failure IS NULL THEN CASE WHEN event_id % 2 = 0 THEN 'event_end' ELSE '' END END AS mismatch FROM b")
def f14_boundary_audit(spark, sf_dir):
    _, resolved = _boundaries(spark, sf_dir)
    end = F.when(F.col("event_id") % 2 == 0, "garbage").otherwise(F.col("end_ts").cast("string"))
    return audit.boundary_audit(resolved, resolved.select("event_id", F.col("start_ts").cast("string").alias("event_start"), end.alias("event_end")))


INPUT_SQL = "CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'no number' WHEN 2 THEN 'NaN' WHEN 3 THEN '-Infinity' WHEN 4 THEN '' ELSE value::VARCHAR END"
RULES_SQL = "text IS NULL|text IS NOT NULL AND try_cast(nullif(text, '') AS DOUBLE) IS NULL|coalesce(isnan(try_cast(nullif(text, '') AS DOUBLE)), FALSE)|coalesce(isinf(try_cast(nullif(text, '') AS DOUBLE)), FALSE)".split("|")


@query("f19_input_checks", f"WITH e AS (SELECT {INPUT_SQL} AS text FROM events) " + " UNION ALL ".join(f"SELECT 'fault_risk' AS column, '{rule}' AS rule, count(*) FILTER ({sql}) AS violations FROM e" for rule, sql in zip(("missing", "number", "nan", "infinite"), RULES_SQL, strict=True))
       + " UNION ALL SELECT 'fault_risk', 'empty', (count(*) = 0)::BIGINT FROM e UNION ALL " + " UNION ALL ".join(f"SELECT 'criticality', '{rule}', 0::BIGINT" for rule in ("missing", "number", "nan", "infinite", "empty")))
def f19_input_checks(spark, sf_dir):
    n, x = F.col("event_id") % 11, F.col("value").cast("string")
    text = F.when(n == 0, None).when(n == 1, "no number").when(n == 2, "NaN").when(n == 3, "-Infinity").when(n == 4, "").otherwise(x)
    return audit.input_violations(table(spark, sf_dir, "events").select(text.alias("fault_risk"), F.col("value").alias("criticality")), ["fault_risk", "criticality"])


@query("f22_guards", "WITH e AS (SELECT value - 20 AS x FROM events) SELECT 'positive' AS rule, count(*) FILTER (NOT x > 0) AS violations FROM e UNION ALL SELECT 'non_negative', count(*) FILTER (x < 0) FROM e UNION ALL SELECT 'measurement', 0::BIGINT UNION ALL SELECT 'probability', count(*) FILTER (NOT x BETWEEN 0 AND 1) FROM e")
def f22_guards(spark, sf_dir):
    x = F.col("x")
    rules = {"positive": scalars.finite(x) & (x > 0), "non_negative": scalars.finite(x) & (x >= 0), "measurement": scalars.finite(x), "probability": x.between(0, 1)}
    return audit.violations(table(spark, sf_dir, "events").select((F.col("value") - 20).alias("x")), rules)


@query("q7_calibration_guard", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN NULL WHEN c_custkey % 3 < 2 AND c_custkey % 5 < 2 THEN 'not allowed' WHEN c_custkey % 7 < 3 THEN NULL WHEN c_custkey % 11 = 0 THEN 'other site' WHEN c_custkey % 3 = 2 AND c_custkey % 13 = 0 THEN 'setting' END AS failure FROM customer""")
def q7_calibration_guard(spark, sf_dir):
    """A customer is an export: of which site, with a residual or not, with a curve of which site and setting, allowed or not."""
    n = F.col("c_custkey")
    site = farm(n)
    failure = audit.calibration_failure(site, n % 2 != 0, n % 7 >= 3, n % 5 >= 2, F.when(n % 11 != 0, site).otherwise("X"), F.when(n % 13 != 0, "train-normal").otherwise("calibrated"))
    return table(spark, sf_dir, "customer").select("c_custkey", failure.alias("failure"))


@query("f23_risk_and_slope", f"""{WITH}, sm AS (SELECT asset_id, window_end, avg(probability) OVER (PARTITION BY asset_id ORDER BY window_end ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS sm, (row_number() OVER (PARTITION BY asset_id ORDER BY window_end) - 1) / 6::DOUBLE AS h FROM pred)
SELECT asset_id, count(*) AS n, arg_max(sm, window_end) AS fault_risk, regr_slope(sm, h) AS degradation_rate FROM sm GROUP BY asset_id HAVING count(*) > 1""", "fault_risk degradation_rate", 9)
def f23_risk_and_slope(spark, sf_dir):
    return priority.fleet_signals(predictions(spark, sf_dir), time="window_end")


@query("o1_sorted", "SELECT n_nationkey, n_name FROM nation ORDER BY n_name, n_nationkey")
def o1_sorted(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_name", "n_nationkey")


@query("o7_binary_values", "SELECT count(*) FILTER (quality NOT IN (0, 1)) = 0 AS quality_ok, count(*) FILTER (toxic NOT IN (0, 1)) = 0 AS toxic_ok FROM labels")
def o7_binary_values(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(*((F.count_if(~F.col(c).isin(0, 1)) == 0).alias(f"{c}_ok") for c in ("quality", "toxic")))


@query("q4_replay", f"{WITH} SELECT count(*) AS rows, 0::BIGINT AS only_right, count(*) FILTER (minute(window_end) = 13) AS only_left, count(*) FILTER (minute(window_end) = 7) AS different FROM pred")
def q4_replay(spark, sf_dir):
    """Labels regenerated from hours, against stored ones of which some were changed and some are missing in the replay."""
    p, at = predictions(spark, sf_dir), F.minute("window_end")
    stored = p.withColumn("label", F.when(at == 7, 1 - F.col("label")).otherwise(F.col("label")))
    again = p.filter(at != 13).select("event_id", "window_end", series.horizon_label(F.col("hours_to_fault").isNotNull(), F.col("hours_to_fault")).alias("label"))
    return audit.aligned(stored, again, ["event_id", "window_end"], "label")


@query("q5_dimensions", "SELECT len(embedding)::INTEGER AS features, count(*) AS rows FROM embeddings GROUP BY 1")
def q5_dimensions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    audit.require_dimension(e, "embedding", 64)
    return e.groupBy(F.size("embedding").alias("features")).agg(F.count("*").alias("rows"))


@query("q6_export_ready", f"{BOUNDS_SQL}, f AS (SELECT coalesce(abs(median(50 + x / 1000) - 50) <= 0.5, FALSE) AS passed FROM readings) SELECT 0::BIGINT AS missing, count(failure) AS failed, passed, count(failure) = 0 AND passed AS ready FROM b, f GROUP BY passed")
def q6_export_ready(spark, sf_dir):
    r, resolved = _boundaries(spark, sf_dir)
    lacking = files.without_file(resolved.select("event_id"), r.select("event_id").distinct())
    return audit.export_ready(lacking, resolved, audit.frequency_check(readings(spark, sf_dir), 50 + F.col("x") / 1000))


@query("m4_evaluated_scores", None)
def m4_evaluated_scores(spark, sf_dir):
    """A trained network on the sequences that it didn't learn from, step by step, without masked ones."""
    val = sequences(spark, sf_dir).filter("part = 'val'")
    out = models.recurrent_scores(val, training.of_flat(trained(spark, sf_dir).best))
    steps = out.select(F.inline(F.arrays_zip("labels", "mask", "probabilities"))).filter("mask = 1")
    return metrics.ranking(steps.select(F.col("labels").alias("label"), F.round("probabilities", 6).cast("double").alias("probability")))


@query("m8_frozen_threshold", f"""{WITH}, val AS (SELECT * FROM pred WHERE farm = 'C' AND asset_id::BIGINT % 2 = 0), {most_f1_sql('val')},
c AS (SELECT farm, threshold, count(*) FILTER (label = 1 AND probability >= threshold) AS tp, count(*) FILTER (label = 0 AND probability >= threshold) AS fp, count(*) FILTER (label = 1 AND probability < threshold) AS fn, count(*) AS rows
FROM pred, best WHERE NOT (farm = 'C' AND asset_id::BIGINT % 2 = 0) GROUP BY 1, 2) SELECT farm, rows, threshold, {RATES_SQL} FROM c""", "threshold precision recall f1")
def m8_frozen_threshold(spark, sf_dir):
    """The threshold is chosen on one site's validation assets, and applied to its other assets and to the other sites."""
    p = predictions(spark, sf_dir)
    val = (F.col("farm") == "C") & (F.col("asset_id").cast("long") % 2 == 0)
    tau = metrics.threshold_among_scores(p.filter(val)).first()["threshold"]
    c = metrics.confusion(p.filter(~val), tau, False, ["farm"])
    return c.select("farm", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("rows"), F.lit(tau).alias("threshold"), "precision", "recall", "f1")


@query("f7_frozen_scaler", "WITH sc AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE user_id % 3 = 2) SELECT event_id, (value - m) / s AS z FROM events, sc WHERE user_id % 3 <> 2", "z")
def f7_frozen_scaler(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.lit(0).alias("feature_index"), F.col("value").alias("x"))
    fitted = e.filter("user_id % 3 = 2").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).withColumn("feature_index", F.lit(0))
    return scaling.apply_scaler(e.filter("user_id % 3 <> 2"), fitted).select("event_id", "z")


@query("m9_parameters", "SELECT len(embedding)::INTEGER AS features, h::INTEGER AS hidden, (3 * h * (len(embedding) + h + 2) + 3 * h * (h + h + 2) + h + 1)::BIGINT AS parameters, count(*) AS sequences FROM embeddings, (VALUES (8), (32)) t(h) GROUP BY 1, 2, 3")
def m9_parameters(spark, sf_dir):
    """How many numbers networks of two layers have, for each number of features that the table's rows have."""
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("features")).agg(F.count("*").alias("sequences"))
    rows = [(r["features"], h, models.RecurrentWeights.random(r["features"], h).parameters(), r["sequences"]) for r in sizes.limit(100).collect() for h in (8, 32)]
    return spark.createDataFrame(rows, "features int, hidden int, parameters long, sequences long")


@query("a36_latency", None)
def a36_latency(spark, sf_dir):
    """Milliseconds of inference over the table's sequences, by size of batch, where the rows are: 50 repeats of each batch."""
    return training.table_latency(sequences(spark, sf_dir), models.RecurrentWeights.random(8))


LIVE_SQL = f"""{READ}, o AS (SELECT asset_id, ts, x, row_number() OVER w AS n, avg(x) OVER (w ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) AS smoothed, x > 40 AS above,
    row_number() OVER w - row_number() OVER (PARTITION BY asset_id, x > 40 ORDER BY ts, x) AS island FROM readings WINDOW w AS (PARTITION BY asset_id ORDER BY ts, x)),
wm AS (SELECT (epoch_ms(max(ts)) - 1800000) * 1000 AS passed FROM readings)
SELECT asset_id, ts, x, smoothed, CASE WHEN above THEN row_number() OVER (PARTITION BY asset_id, above, island ORDER BY n) ELSE 0 END AS run, above AND row_number() OVER (PARTITION BY asset_id, above, island ORDER BY n) = 2 AS alarm FROM o QUALIFY epoch_us(ts) <= (SELECT passed FROM wm)"""


@query("x1_live_scan", LIVE_SQL, "x smoothed", 9)
def x1_live_scan(spark, sf_dir):
    """Events replayed as a stream: trailing means, open runs and episodes, of all that the watermark (half an hour behind the last event) has passed."""
    path = f"{sf_dir}/events.parquet"
    kind = spark.read.parquet(path).schema
    stream = spark.readStream.schema(kind).parquet(path.replace("events.parquet", "events*.parquet"))
    live = stateful.live_scan(stream.select(F.col("user_id").cast("string").alias("asset_id"), "ts", F.col("value").alias("x")), threshold=40, least=2)
    out = stateful.replayed(live, files.shared_folder(spark), files.shared_folder(spark))
    return out.select("asset_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "x", "smoothed", "run", "alarm")
