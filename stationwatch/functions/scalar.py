"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EARTH_RADIUS_KM, SEVERITY_SCORES, STATION, TIME


def by_time():
    """The window of a station's rows in time order."""
    return Window.partitionBy(STATION).orderBy(TIME)


def r6(value: Column | str) -> Column:
    """Six decimals: below that, engines differ in the order of their sums."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


def r4(value: Column | str) -> Column:
    """Four decimals, for means of a few readings of six decimals: at six they would often stand on a tie, which engines break differently."""
    return F.round(F.col(value) if isinstance(value, str) else value, 4)


def units(value: Column | str) -> Column:
    """A number in millionths, as a whole one: sums of these are exact in any order."""
    return F.round((F.col(value) if isinstance(value, str) else value) * 1e6).cast("decimal(19,0)")


def mean6(value: str) -> Column:
    """The mean to six decimals, halves upwards, from exact sums: no tie hangs on the order of rows."""
    n = F.count(value).cast("double")
    return F.floor((2 * F.sum(units(value)).cast("double") + n) / F.nullif(2 * n, F.lit(0.0))).cast("double") / 1e6


def is_finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite(value: Column) -> Column:
    """The value, or null where it is not finite."""
    return F.when(is_finite(value), value)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def flag(condition: Column) -> Column:
    """False where the condition is null."""
    return F.coalesce(condition, F.lit(False))


def clip(value: Column, low: float, high: float) -> Column:
    """Null stays null, unlike with least and greatest alone."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def count_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (f.cast("int") for f in flags))


def any_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def to_number(value: Column) -> Column:
    """The number that a text says; null for any other text, NaN and null."""
    return nan_to_null(value.try_cast("double"))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the md5 of the key's parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(a))


def severity_score(label: Column) -> Column:
    out = F
    for name, score in SEVERITY_SCORES.items():
        out = out.when(label == name, F.lit(score))
    return out.otherwise(F.when(label.isNotNull(), F.lit(0.5)))


def sorted_median(values: Column) -> Column:
    """Median of an array without nulls; null of an empty one."""
    ordered, n = F.sort_array(values), F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def with_medians(df: DataFrame, arrays: dict[str, Column]) -> DataFrame:
    """``{name}_med`` and ``{name}_mad``, median and median absolute deviation of arrays without nulls.

    Step by step, so that the median is found once for each row and not once for each element.
    """
    df = df.withColumns({f"_{name}_values": values for name, values in arrays.items()})
    df = df.withColumns({f"{name}_med": sorted_median(F.col(f"_{name}_values")) for name in arrays})
    def gaps(name: str) -> Column:
        return F.transform(f"_{name}_values", lambda x: F.abs(x - F.col(f"{name}_med")))

    df = df.withColumns({f"_{name}_gaps": gaps(name) for name in arrays})
    return df.withColumns({f"{name}_mad": sorted_median(F.col(f"_{name}_gaps")) for name in arrays}).drop(*(f"_{name}_{k}" for name in arrays for k in ("values", "gaps")))


def hour_label(offset: Column) -> Column:
    """An offset in hours with its sign, as in ``+3h``."""
    return F.concat(F.when(offset >= 0, "+").otherwise(""), offset.cast("string"), F.lit("h"))
