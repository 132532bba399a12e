"""The ten physical features, as column expressions generated from a site's sensor mapping.

Every feature is a pair of value and validity; an invalid value is null.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import finite, wrap_to_180

#: The feature order of the contract, and its thresholds.
FEATURES = (
    "wind_speed_mps",
    "pitch_angle_deg",
    "yaw_misalignment_deg",
    "gearbox_oil_rise_C",
    "gearbox_bearing_hotspot_over_oil_C",
    "generator_rotor_speed_ratio",
    "grid_power_factor",
    "grid_current_imbalance",
    "grid_voltage_imbalance",
    "grid_frequency_deviation_Hz",
)
RESIDUAL = "power_residual"
EPS, ROTOR_RPM, APPARENT, CURRENT, VOLTAGE, FREQUENCY = 1e-6, 0.5, 0.02, 0.1, 1.0, 50.0


@dataclass(frozen=True)
class Site:
    """Which sensors a site measures each feature with."""

    wind: str
    pitch: tuple[str, ...]
    yaw: tuple[str, ...]  # one relative angle, or wind direction and nacelle direction
    oil: tuple[str, ...]
    ambient: str
    bearings: tuple[str, ...]
    generator: str
    rotor: tuple[str, ...]
    active: str
    reactive: str
    currents: tuple[str, ...]
    voltages: tuple[str, ...]
    frequency: str
    generator_in_radians: bool = False
    frequency_passed: bool = True

    def sensors(self) -> list[str]:
        """All sensors needed, each once, sorted."""
        found = set()
        for value in vars(self).values():
            found.update([value] if isinstance(value, str) else value if isinstance(value, tuple) else [])
        return sorted(found)


def _s(*numbers: int) -> tuple[str, ...]:
    return tuple(f"sensor_{n}" for n in numbers)


#: The sites' sensors.
SITES = {
    "A": Site("wind_speed_3", _s(5), _s(2), _s(12), "sensor_0", _s(11), "sensor_18", _s(52), "power_30", "sensor_31", _s(23, 24, 25), _s(32, 33, 34), "sensor_26"),
    "B": Site("wind_speed_61", _s(10), _s(4, 21), _s(39), "sensor_8", _s(*range(34, 38)), "sensor_19", _s(25), "power_62", "reactive_power_11", _s(16, 17, 18), _s(13, 14, 15), "sensor_23"),
    "C": Site("wind_speed_236", _s(103, 104, 105), _s(124), _s(186, 187), "sensor_7", _s(*range(151, 167)), "sensor_8", _s(144, 145), "power_6", "reactive_power_122", _s(127, 128, 129), _s(139, 140, 141), "sensor_47", True),
}


#: The fields of a site that each feature is made from.
SOURCES = (("wind",), ("pitch",), ("yaw",), ("ambient", "oil"), ("bearings", "oil"), ("generator", "rotor"), ("active", "reactive"), ("currents",), ("voltages",), ("frequency",))
#: What sensors' names start with.
PREFIXES = ("sensor_", "wind_speed_", "power_", "reactive_power_")
#: Fixed value: how many sensors a legacy table has.
LEGACY = 54


def feature_order(with_residual: bool = False, contract: dict | None = None) -> list[str]:
    """The contract's order of features, which is the engine's own without one, and the residual after them if asked for."""
    return [*(FEATURES if contract is None else contract["features"]), *([RESIDUAL] if with_residual else [])]


def required_sensors(mapping: object) -> list[str]:
    """All sensors named anywhere in a nested configuration, each once, sorted."""
    found, left = set(), [mapping]
    while left:
        value = left.pop()
        if isinstance(value, str):
            found.update([value] if value.startswith(PREFIXES) else [])
        elif isinstance(value, dict):
            left += value.values()
        elif isinstance(value, (list, tuple)):
            left += value
    return sorted(found)


def manifest(sites: dict[str, Site]) -> list[tuple[int, str, str, str]]:
    """(feature_index, feature, site, sources): each feature's sensors by field as JSON, keys sorted."""
    plain = lambda v: list(v) if isinstance(v, tuple) else v
    return [(i, name, k, json.dumps({f: plain(getattr(s, f)) for f in fields}, sort_keys=True)) for i, (name, fields) in enumerate(zip(FEATURES, SOURCES, strict=True)) for k, s in sorted(sites.items())]


def legacy_columns(available: list[str], sensors: list[str], expected: int = LEGACY, also_long: bool = False) -> dict[str, str]:
    """Sensor -> its column in a legacy table: with _avg (or _average, if also_long), else bare; sensors with neither are left out.

    There have to be `expected` of them.
    """
    endings = ("_avg", "_average", "") if also_long else ("_avg", "")
    found = {s: next((s + e for e in endings if s + e in available), None) for s in sensors}
    found = {s: c for s, c in found.items() if c is not None}
    if len(found) != expected:
        raise ValueError(f"{len(found)} sensors found where {expected} are needed")
    return found


def resolve_columns(available: list[str], sensors: list[str]) -> dict[str, str]:
    """Sensor -> its column of averages: with _avg, else with _average, else bare; never a minimum, maximum or deviation."""
    found = {}
    for s in sensors:
        column = next((c for c in (f"{s}_avg", f"{s}_average", s) if c in available), None)
        if column is None:
            raise ValueError(f"no average column for {s}")
        found[s] = column
    return found


def by_sensor(df: DataFrame, sensors: list[str], keep: list[str]) -> DataFrame:
    """keep, and each sensor's averages under its own name."""
    return df.select(*keep, *(F.col(c).alias(s) for s, c in resolve_columns(df.columns, sensors).items()))


def mean_of(*cs: Column) -> Column:
    """The mean; null if any is."""
    return reduce(add, cs) / float(len(cs))


def most_of(*cs: Column) -> Column:
    """The largest; null if any is."""
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cs]), F.greatest(*cs) if len(cs) > 1 else cs[0])


def phase_imbalance(*phases: Column, eps: float = EPS) -> Column:
    mean = mean_of(*phases)
    return most_of(*(F.abs(p - mean) for p in phases)) / (F.abs(mean) + eps)


def power_factor(active: Column, reactive: Column) -> Column:
    return F.try_divide(F.abs(active), F.sqrt(active * active + reactive * reactive))


def _valid(value: Column, *conditions: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in (finite(value), *conditions)]), value)


def physical_features(site: Site, curve: tuple[list[float], list[float], float] | None = None) -> dict[str, Column]:
    """Feature -> value, null where it isn't valid. curve: knots, expected powers and scale, for the residual."""
    c = lambda name: F.col(name)
    many = lambda names: [F.col(n) for n in names]
    wind, oil = c(site.wind), mean_of(*many(site.oil))
    yaw = wrap_to_180(c(site.yaw[0]) - c(site.yaw[1]) if len(site.yaw) == 2 else c(site.yaw[0]))
    rotor = mean_of(*many(site.rotor))
    generator = c(site.generator) * (60.0 / (2.0 * math.pi)) if site.generator_in_radians else c(site.generator)
    active, reactive = c(site.active), c(site.reactive)
    out = {
        "wind_speed_mps": _valid(wind, wind >= 0),
        "pitch_angle_deg": _valid(mean_of(*many(site.pitch))),
        "yaw_misalignment_deg": _valid(F.abs(yaw)),
        "gearbox_oil_rise_C": _valid(oil - c(site.ambient)),
        "gearbox_bearing_hotspot_over_oil_C": _valid(most_of(*many(site.bearings)) - oil),
        "generator_rotor_speed_ratio": _valid(F.try_divide(generator, rotor), rotor >= ROTOR_RPM),
        "grid_power_factor": _valid(power_factor(active, reactive), F.sqrt(active * active + reactive * reactive) >= APPARENT),
        "grid_current_imbalance": _valid(phase_imbalance(*many(site.currents)), F.abs(mean_of(*many(site.currents))) >= CURRENT),
        "grid_voltage_imbalance": _valid(phase_imbalance(*many(site.voltages)), F.abs(mean_of(*many(site.voltages))) >= VOLTAGE),
        "grid_frequency_deviation_Hz": _valid(F.abs(c(site.frequency) - FREQUENCY), F.lit(site.frequency_passed)),
    }
    if curve is not None:
        knots, powers, scale = curve
        out[RESIDUAL] = _valid((active - interpolated(wind, knots, powers)) / scale, wind >= 0)
    return out


def with_features(df: DataFrame, site: Site, keep: list[str], curve=None) -> DataFrame:
    """keep, the features, and valid_ columns, in one projection."""
    made = physical_features(site, curve)
    return df.select(*keep, *(v.alias(k) for k, v in made.items()), *(v.isNotNull().alias(f"valid_{k}") for k, v in made.items()))


def interpolated(x: Column, knots: list[float], values: list[float]) -> Column:
    """Piecewise linear between sorted knots, and constant beyond them: a chain of conditions, so no join is needed."""
    out = F.when(x <= knots[0], F.lit(float(values[0])))
    for x0, x1, y0, y1 in zip(knots, knots[1:], values, values[1:], strict=False):
        out = out.when(x < x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(x.isNotNull(), out.otherwise(F.lit(float(values[-1]))))


@dataclass(frozen=True)
class PowerCurve:
    """Median power by wind speed, its scale, and where it comes from."""

    wind: list[float]
    power: list[float]
    scale: float
    provenance: dict[str, str] = field(default_factory=dict)


def site_from_mapping(mapping: dict) -> Site:
    """A Site from a configuration's tree: its fields by name, lists as tuples. Unknown or missing fields are errors."""
    known = Site.__dataclass_fields__
    if unknown := mapping.keys() - known.keys():
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    try:
        return Site(**{k: tuple(v) if isinstance(v, list) else v for k, v in mapping.items()})
    except TypeError as error:
        raise ValueError(str(error)) from error


def load_sites(mapping: dict) -> dict[str, Site]:
    """Sites of a contract {"version": "physical-v1", "features": [...], "sites": {name: fields}}; the feature order is fixed."""
    if mapping.get("version") != "physical-v1" or list(mapping.get("features", ())) != list(FEATURES):
        raise ValueError("the contract's version or feature order isn't the engine's")
    return {name: site_from_mapping(fields) for name, fields in mapping["sites"].items()}
