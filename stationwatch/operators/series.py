"""Comparisons of every two stations' series without a join of all readings at one time.

Stations fall into blocks and times into spans. A task gets the readings of two
blocks in one span as a table of times by stations, and says of all their pairs
what matrix products tell: how many times they share, their sums, squares and
products. Sums over spans give correlations. A reading travels once for each
block of stations, not once for each station. Whole series are told apart by
fingerprints: sums of hashes over their times and values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import STATION, TIME
from ..functions.scalar import r6

#: Stations of a block, and readings that a task holds of two of them, more or less.
BLOCK, SPAN_ROWS = 256, 1 << 20

_MOMENTS = ("n", "m", "sx", "sy", "sxx", "syy", "sxy", "differ")


def _table(group: pd.DataFrame, stations: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Times by stations: which rows there are, which values, the values with 0 for none, and codes that are equal for equal values or nulls."""
    row, column = np.searchsorted(times, group["t"].to_numpy()), np.searchsorted(stations, group["s"].to_numpy())
    there, known = np.zeros((2, len(times), len(stations)))
    values, codes = np.zeros((len(times), len(stations))), np.zeros((len(times), len(stations)), np.int64)
    x, null = group["x"].to_numpy(float), group["none"].to_numpy(bool)
    there[row, column] = 1
    known[row, column] = ~null & ~np.isnan(x)
    values[row, column] = np.where(null | np.isnan(x), 0.0, x)
    codes[row, column] = np.where(null, -1, np.where(np.isnan(x), -2, (group["raw"].to_numpy(float) + 0.0).view(np.int64)))
    return there, known, values, codes


def _pair_moments(group: pd.DataFrame) -> pd.DataFrame:
    """(a, b, ...) of the pairs a < b between two blocks, or within one, that share a time."""
    low, high = group["low"].iloc[0], group["high"].iloc[0]
    times = np.unique(group["t"].to_numpy())
    sides = []
    for block in (low, high):
        mine = group[group["mine"] == block]
        stations = np.unique(mine["s"].to_numpy())
        sides.append((stations, *_table(mine, stations, times)))
    (sa, pa, ka, xa, ca), (sb, pb, kb, xb, cb) = sides
    n = pa.T @ pb
    out = {"n": n, "m": ka.T @ kb, "sx": xa.T @ kb, "sy": ka.T @ xb, "sxx": (xa * xa).T @ kb, "syy": ka.T @ (xb * xb), "sxy": xa.T @ xb}
    differ = np.stack([((ca[:, i : i + 1] != cb) & (pa[:, i : i + 1] * pb > 0)).sum(0) for i in range(len(sa))]) if len(sa) else n
    a, b = np.meshgrid(np.arange(len(sa)), np.arange(len(sb)), indexing="ij")
    keep = (n > 0) & ((sa[a] < sb[b]) if low == high else np.ones_like(n, bool))
    swap = sa[a[keep]] > sb[b[keep]]
    first, second = np.where(swap, sb[b[keep]], sa[a[keep]]), np.where(swap, sa[a[keep]], sb[b[keep]])
    flat = {k: v[keep] for k, v in out.items()}
    for x, y in (("sx", "sy"), ("sxx", "syy")):
        flat[x], flat[y] = np.where(swap, flat[y], flat[x]), np.where(swap, flat[x], flat[y])
    return pd.DataFrame({"a": first, "b": second, **flat, "differ": differ[keep].astype(float)})


def pair_moments(obs: DataFrame, variable: str) -> DataFrame:
    """a < b and of the times that both have rows for: n, how many have both values (m), their sums, squares and products less the stations' means, and how many differ.

    A station has one row for each time.
    """
    means = obs.groupBy(F.col(STATION).alias("s")).agg(F.coalesce(F.avg(variable), F.lit(0.0)).alias("mean"), F.count("*").alias("rows"))
    blocks = F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int")
    size = means.agg(blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil(F.sum("rows") * 2 / blocks / SPAN_ROWS)).cast("int").alias("spans"))
    x = F.col(variable).cast("double")
    rows = obs.select(F.col(STATION).alias("s"), F.unix_micros(F.col(TIME).cast("timestamp")).alias("t"), x.alias("raw"), x.isNull().alias("none")).join(means.select("s", "mean"), "s").crossJoin(F.broadcast(size))  # one row
    mine, span = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("t"), F.col("spans")).cast("int")
    rows = rows.select("s", "t", "none", F.coalesce(F.col("raw"), F.lit(0.0)).alias("raw"), F.coalesce(F.col("raw") - F.col("mean"), F.lit(0.0)).alias("x"), mine.alias("mine"), span.alias("span"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")}).drop("other")
    parts = rows.groupBy("span", "low", "high").applyInPandas(_pair_moments, "a string, b string, " + ", ".join(f"{k} double" for k in _MOMENTS))
    return parts.groupBy("a", "b").agg(*(F.sum(k).alias(k) for k in _MOMENTS))


def correlations(obs: DataFrame, variable: str) -> DataFrame:
    """Pearson correlation of every two stations over the times they share; NaN for a series that stands still."""
    m, scale = F.col("m"), F.lit(1e-12)
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / m, F.col("syy") - F.col("sy") * F.col("sy") / m
    still = (vx <= scale * F.greatest("sxx", F.lit(1e-9))) | (vy <= scale * F.greatest("syy", F.lit(1e-9)))
    corr = F.when(m < 2, None).when(still, F.lit(float("nan"))).otherwise((F.col("sxy") - F.col("sx") * F.col("sy") / m) / F.sqrt(vx * vy))
    return pair_moments(obs, variable).select("a", "b", F.col("n").cast("long").alias("n"), r6(corr).alias("correlation"))


def identical_series(obs: DataFrame, variable: str) -> DataFrame:
    """For every two stations whether their series agree wherever both have rows."""
    return pair_moments(obs, variable).select("a", "b", (F.col("differ") == 0).alias("identical"))


def fingerprints(obs: DataFrame, variable: str) -> DataFrame:
    """station_id, rows, fingerprint: equal for stations with the same values at the same times, by two sums of 64-bit hashes."""
    x = F.col(variable).cast("double")
    both = [F.sum(F.xxhash64(F.lit(k), F.unix_micros(F.col(TIME).cast("timestamp")), x, x.isNull()).cast("decimal(20,0)")).cast("string") for k in (1, 2)]
    return obs.groupBy(STATION).agg(F.count("*").alias("rows"), F.concat_ws(":", *both).alias("fingerprint"))


def twins(obs: DataFrame, variable: str) -> DataFrame:
    """station_id, rows, twins, first: how many stations share its whole series, itself included, and the first of them by name. One aggregation, no pair of stations meets."""
    found = fingerprints(obs, variable)
    groups = found.groupBy("rows", "fingerprint").agg(F.count("*").alias("twins"), F.min(STATION).alias("first"))
    return found.join(groups, ["rows", "fingerprint"]).select(STATION, "rows", "twins", "first")
