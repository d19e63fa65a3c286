"""Numbers: rounding, limits and safe division, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_up(x: Column | str, places: int = 3) -> Column:
    """Round half up, towards plus infinity: -2.5 becomes -2."""
    scale = float(10**places)
    return F.floor(_c(x) * scale + 0.5) / scale


def clamp(x: Column | str, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _c(x)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return _c(a) / F.nullif(_c(b), F.lit(0.0))


def six(x: Column | str) -> Column:
    """Six places, for comparison across engines."""
    return F.round(_c(x), 6)


def log_or_minus(x: Column | str) -> Column:
    """The natural logarithm, minus infinity at 0, where Spark's is null."""
    return F.when(_c(x) == 0, float("-inf")).otherwise(F.ln(_c(x)))


def decay(age: Column | str, half_life: Column | str, floor: float = 0.01) -> Column:
    return F.greatest(F.lit(floor), F.pow(F.lit(0.5), _c(age) / _c(half_life)))


def band_score(value: Column, dovish: Column, hawkish: Column) -> Column:
    """Place of a value between two bounds: linear inside, just under 1 far outside."""
    middle = (hawkish + dovish) / 2
    x = (value - middle) / F.greatest(F.abs(hawkish - dovish), F.lit(1.0))
    return clamp(F.when(F.abs(x) > 1, F.signum(x) * (1 - 0.05 / F.abs(x))).otherwise(x))


def five_levels(x: Column | str) -> Column:
    """Label of an aggregate; the bounds are not symmetric in strictness."""
    x = _c(x)
    return F.when(x <= -0.5, "very dovish").when(x < -0.1, "dovish").when(x >= 0.5, "very hawkish").when(x > 0.1, "hawkish").otherwise("neutral")


def three_levels(x: Column | str, band: float = 0.1) -> Column:
    x = _c(x)
    return F.when(x > band, "hawkish").when(x < -band, "dovish").otherwise("neutral")


def points(x: Column | str, sign: int) -> Column:
    """Strength from 0 to 10 on one side."""
    x = _c(x) * sign
    return F.when(x > 0, F.floor(x * 10 + 0.5)).otherwise(0).cast("int")


def market_weight(days: Column | str) -> Column:
    """Weight of the market: a quarter a month ahead, three quarters at the end, linear between."""
    d = _c(days)
    return F.when(d >= 30, 0.25).when(d <= 3, 0.75).otherwise(round_up(0.75 - (d - 3) / 27.0 * 0.5, 2))
