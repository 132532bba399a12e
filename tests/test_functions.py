"""Physics and scalar functions against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from galewatch.functions import physics as P
from galewatch.functions import scalars as S


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_wrap_to_180(spark):
    got = values(spark, [(float(x),) for x in (-725, -200.5, -90, 0, 95.25, 270, 1000)], "x double", y=S.wrap_to_180(F.col("x")))
    assert [r[0] for r in got] == [-5, 159.5, -90, 0, 95.25, -90, -80]


def test_column_resolution():
    available = ["sensor_1", "sensor_1_avg", "sensor_1_max", "sensor_2_average"]
    assert P.resolve_columns(available, ["sensor_1", "sensor_2"]) == {"sensor_1": "sensor_1_avg", "sensor_2": "sensor_2_average"}
    with pytest.raises(ValueError):
        P.resolve_columns(["sensor_3_max", "sensor_3_std"], ["sensor_3"])


def test_imbalance_and_power_factor(spark):
    got = values(spark, [(2.0, 5.0, 8.0), (7.5, 7.5, 7.5), (-30.0, -42.0, -48.0), (None, 3.0, 1.0)], "a double, b double, c double", y=P.phase_imbalance(F.col("a"), F.col("b"), F.col("c")))
    assert [r[0] for r in got] == [pytest.approx(3 / (5 + 1e-6)), 0, pytest.approx(10 / (40 + 1e-6)), None]
    got = values(spark, [(-3.0, 4.0), (0.0, 0.0)], "p double, q double", y=P.power_factor(F.col("p"), F.col("q")))
    assert [r[0] for r in got] == [pytest.approx(0.6), None]


def site_rows(spark, site, **changes):
    base = dict.fromkeys(P.SITES[site].sensors(), 1.0)
    rows = [base | {k: v[i] if isinstance(v, tuple) else v for k, v in changes.items()} for i in range(2)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} double" for k in base))


def test_site_a(spark):
    df = site_rows(spark, "A", sensor_0=10.0, sensor_12=50.0, sensor_11=60.0, sensor_18=20.0, sensor_52=(0.0, 2.0), power_30=3.0, sensor_31=4.0, sensor_23=9.0, sensor_24=10.0, sensor_25=11.0, sensor_32=220.0, sensor_33=230.0, sensor_34=240.0, sensor_26=50.0, wind_speed_3=(-1.0, 5.0))
    one, two = P.with_features(df, P.SITES["A"], []).collect()
    assert (one.generator_rotor_speed_ratio, two.generator_rotor_speed_ratio) == (None, 10)
    assert (one.gearbox_oil_rise_C, one.gearbox_bearing_hotspot_over_oil_C, one.grid_power_factor) == (40, 10, pytest.approx(0.6))
    assert (one.wind_speed_mps, one.valid_wind_speed_mps, two.wind_speed_mps) == (None, False, 5)
    assert one.grid_current_imbalance == pytest.approx(1 / (10 + 1e-6)) and one.grid_voltage_imbalance == pytest.approx(10 / (230 + 1e-6)) and one.grid_frequency_deviation_Hz == 0


def test_sites_b_and_c(spark):
    (b, _) = P.with_features(site_rows(spark, "B", sensor_4=350.0, sensor_21=10.0), P.SITES["B"], []).collect()
    (c, _) = P.with_features(site_rows(spark, "C", sensor_124=-190.0, sensor_8=2 * math.pi, sensor_144=2.0, sensor_145=2.0), P.SITES["C"], []).collect()
    assert (b.yaw_misalignment_deg, c.yaw_misalignment_deg) == (20, 170)
    assert c.generator_rotor_speed_ratio == pytest.approx(30)
    missing = site_rows(spark, "C", sensor_151=None)
    assert P.with_features(missing, P.SITES["C"], []).first().gearbox_bearing_hotspot_over_oil_C is None


def test_interpolation_is_constant_beyond_its_knots(spark):
    got = values(spark, [(x,) for x in (-1.0, 0.2, 0.7, 1.2, 9.0, None)], "x double", y=P.interpolated(F.col("x"), [0.2, 1.2], [2.0, 12.0]))
    assert [r[0] for r in got] == [2, 2, pytest.approx(7), 12, 12, None]


def test_numbers_and_ids(spark):
    got = values(spark, [("1.0",), ("2",), ("0.5",), ("bad",), (None,), (" 3 ",), ("NaN",)], "x string", i=S.integer_like(F.col("x")), n=S.number(F.col("x")))
    assert got == [(1, 1.0), (2, 2.0), (None, 0.5), (None, None), (None, None), (3, 3.0), (None, None)]


@pytest.mark.parametrize("bad", [None, True, "1", float("nan"), float("inf"), 0, -1])
def test_guards(bad):
    with pytest.raises(ValueError):
        S.require_positive(bad, "x")


def test_feature_order():
    assert len(P.feature_order()) == 10 and P.feature_order(True)[-1] == P.RESIDUAL


def test_contract_round_trip():
    import yaml

    from galewatch.plans.reports import contract_text

    contract = yaml.safe_load(contract_text())
    assert P.load_sites(contract) == P.SITES
    with pytest.raises(ValueError):
        P.load_sites(contract | {"version": "physical-v2"})
    with pytest.raises(ValueError):
        P.load_sites(contract | {"features": contract["features"][::-1]})
    with pytest.raises(ValueError):
        P.site_from_mapping({"wind": "w", "unknown": 1})
    with pytest.raises(ValueError):
        P.site_from_mapping({"wind": "w"})
