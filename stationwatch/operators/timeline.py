"""Windows over a station's rows that don't need the station in one task.

Rows get a position within their station by two passes: rows are dealt into
spans of time, each span is numbered by itself, and the counts of the spans
before it are added. Positions are cut into chunks of equal numbers of rows.
An operator that looks some rows back or ahead gets copies of so many rows from
the neighbouring chunks; one that carries a state along (a running number, the
last row of a kind) sums it up by chunk, and chunks, which are few, hand it on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import STATION, TIME

#: Rows of a chunk.
CHUNK_ROWS = 1 << 17
POSITION, CHUNK, OWN = "_pos", "_chunk", "_own"


def _micros() -> Column:
    return F.unix_micros(F.col(TIME).cast("timestamp"))


def positions(rows: DataFrame, repeated: str | None = None) -> DataFrame:
    """``_pos``: each station's rows from 0 on, by time; rows that have it keep it.

    A table cut by time keeps its positions, as only their differences count;
    one with holes must drop them. With ``repeated`` a column of that name is true
    where a station's row has the time of the one before.
    """
    if POSITION in rows.columns:
        return rows if repeated is None else rows.withColumn(repeated, F.lit(False))
    spans = rows.groupBy(STATION).agg(F.count("*").alias("_n"), F.min(_micros()).alias("_from"), F.max(_micros()).alias("_to"))
    parts = F.ceil(F.col("_n") / CHUNK_ROWS)
    spans = spans.select(F.col(STATION).alias("_s"), "_from", parts.alias("_parts"), F.greatest(F.ceil((F.col("_to") - F.col("_from") + 1) / parts), F.lit(1)).alias("_width"))
    dealt = rows.join(spans, F.col(STATION).eqNullSafe(F.col("_s"))).withColumn("_span", F.coalesce(F.floor((_micros() - F.col("_from")) / F.col("_width")), F.lit(0)))
    counts = dealt.groupBy("_s", "_span").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("_s").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each CHUNK_ROWS rows
    counts = counts.select(F.col("_s").alias("_cs"), F.col("_span").alias("_cspan"), before.alias("_before"))
    within = Window.partitionBy("_s", "_span").orderBy(TIME)
    out = dealt.withColumn("_nth", F.row_number().over(within))
    if repeated is not None:
        out = out.withColumn(repeated, F.coalesce(F.lag(TIME).over(within) == F.col(TIME), F.lit(False)))
    out = out.join(counts, F.col("_s").eqNullSafe(F.col("_cs")) & (F.col("_span") == F.col("_cspan")))
    return out.select(*rows.columns, *([repeated] if repeated else []), (F.col("_before") + F.col("_nth") - 1).alias(POSITION))


def chunked(rows: DataFrame, back: int = 0, ahead: int = 0) -> DataFrame:
    """``_chunk``, and ``_own``: false for copies of rows that up to ``back`` rows later or ``ahead`` rows earlier ones look at."""
    rows = positions(rows)
    at = lambda c: F.floor(c / CHUNK_ROWS)
    if not back and not ahead:
        return rows.withColumns({CHUNK: at(F.col(POSITION)), OWN: F.lit(True)})
    chunks = F.sequence(F.greatest(at(F.col(POSITION) - ahead), F.lit(0)), at(F.col(POSITION) + back))
    return rows.withColumn(CHUNK, F.explode(chunks)).withColumn(OWN, F.col(CHUNK) == at(F.col(POSITION)))


def local(*more: str) -> WindowSpec:
    """The window of a chunk's rows in time order."""
    return Window.partitionBy(STATION, CHUNK, *more).orderBy(POSITION)


def own(rows: DataFrame) -> DataFrame:
    """Without copies and chunks."""
    return rows.where(OWN).drop(CHUNK, OWN)


def carried(rows: DataFrame, totals: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """Chunked rows with what the other chunks of their station hand on: ``carry`` are windows over the table of chunks, which has ``totals`` by chunk.

    The table has a row for each CHUNK_ROWS rows, and is ordered by ``earlier()`` or ``later()``.
    """
    chunks = rows.where(OWN).groupBy(F.col(STATION).alias("_ks"), F.col(CHUNK).alias("_kc")).agg(*(c.alias(name) for name, c in totals.items()))
    chunks = chunks.withColumns(carry).drop(*(name for name in totals if name not in carry))
    return rows.join(chunks, F.col(STATION).eqNullSafe(F.col("_ks")) & (F.col(CHUNK) == F.col("_kc")), "left").drop("_ks", "_kc")


def earlier() -> WindowSpec:
    return Window.partitionBy("_ks").orderBy("_kc").rowsBetween(Window.unboundedPreceding, -1)


def later() -> WindowSpec:
    return Window.partitionBy("_ks").orderBy("_kc").rowsBetween(1, Window.unboundedFollowing)
