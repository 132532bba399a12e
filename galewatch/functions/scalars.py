"""Scalar building blocks: missing values, angles, durations, ids, guards. All are column expressions or driver checks."""

from __future__ import annotations

import math
from numbers import Real

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01"


def present(c: Column) -> Column:
    """A number with NaN and infinities as null: both mean missing."""
    return F.when(finite(c), c)


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def number(c: Column) -> Column:
    """Text as a number; what isn't one is null."""
    return present(c.cast("string").try_cast("double"))


def wrap_to_180(c: Column) -> Column:
    """An angle in [-180, 180), with the remainder of floor division."""
    return F.pmod(c + 180.0, F.lit(360.0)) - 180.0


def epoch_seconds(c: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.datediff(c.cast("date"), F.lit(EPOCH).cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c)).cast("long")


def from_epoch(c: Column) -> Column:
    """Whole seconds since 1970 as a timestamp without time zone."""
    days = F.floor(c / 86400)
    return F.expr(f"TIMESTAMP_NTZ '{EPOCH} 00:00:00'") + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), (c - days * 86400).cast("decimal(18,6)"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (epoch_seconds(later) - epoch_seconds(earlier)) / 3600.0


def integer_like(c: Column) -> Column:
    """An id given as 1, "1.0" or 2.0; anything with a fraction or no number is null."""
    d = c.cast("string").try_cast("decimal(38,9)")
    return F.when(d == F.floor(d), d.try_cast("long"))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def same_word(c: Column, word: str) -> Column:
    """Equality after trimming and lower-casing."""
    return F.lower(F.trim(c)) == word.lower()


def number_or_null(c: Column) -> Column:
    """A number for JSON: not finite becomes null."""
    return present(c)


def clipped(c: Column, limit: float = 10.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), c))


def require_positive(value: object, name: str) -> float:
    """A finite positive number, or ValueError."""
    return _required(value, name, lambda v: v > 0, "positive")


def require_non_negative(value: object, name: str) -> float:
    return _required(value, name, lambda v: v >= 0, "non-negative")


def _required(value: object, name: str, ok, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, Real) or not math.isfinite(value) or not ok(value):
        raise ValueError(f"{name} must be a finite {what} number")
    return float(value)
