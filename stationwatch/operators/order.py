"""Exact order statistics of a whole table: no task ever holds its distinct values.

The wanted ranks are followed through cells, ranges of values that hold some of
them. A pass counts the values of each large cell in SPLITS parts, evenly wide or
evenly wide in logarithms by turns, and goes on with the parts that hold a wanted
rank; a cell of one value is done. When the cells are small, their distinct
values are numbered and the wanted ones fetched. Tasks send counts, the driver
gets a few numbers for each wanted rank, and a value that a third of all rows
have is one count.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage

#: Rows of a cell that is sorted, and parts of one that isn't.
CELL_ROWS, SPLITS = 1 << 18, 4096


@dataclass(frozen=True)
class _Cell:
    group: tuple
    low: float
    high: float
    below: int
    rows: int
    ranks: tuple[int, ...]


def _inside(cell: _Cell, by: tuple[str, ...]) -> Column:
    here = F.col("x").between(F.lit(cell.low), F.lit(cell.high))
    for name, value in zip(by, cell.group, strict=True):
        here = here & F.col(name).eqNullSafe(F.lit(value))
    return here


def _numbered(data: DataFrame, cells: list[_Cell], by: tuple[str, ...]) -> DataFrame:
    """The values that lie in some cell, with the cell's number."""
    number = F
    for k, cell in enumerate(cells):
        number = number.when(_inside(cell, by), F.lit(k))
    return data.select("x", number.otherwise(None).alias("cell")).where("cell IS NOT NULL")


def _split(data: DataFrame, cells: list[_Cell], by: tuple[str, ...], logarithmic: bool) -> list[_Cell]:
    """The parts of large cells that hold wanted ranks. The part's number never falls as the value grows."""
    def part(cell: _Cell) -> Column:
        x = F.col("x")
        if math.isinf(cell.low) or math.isinf(cell.high):
            return F.when(x == -math.inf, 0).when(x == math.inf, 2).otherwise(1)
        if logarithmic or not math.isfinite(cell.high - cell.low):
            x, ends = F.signum(x) * F.log1p(F.abs(x)), [math.copysign(math.log1p(abs(v)), v) for v in (cell.low, cell.high)]
        else:
            ends = [cell.low, cell.high]
        at = F.floor((x - ends[0]) / (ends[1] - ends[0]) * SPLITS) if ends[1] > ends[0] else F.lit(0)
        return F.least(F.greatest(at, F.lit(0)), F.lit(SPLITS - 1))

    number = F
    for k, cell in enumerate(cells):
        number = number.when(F.col("cell") == k, part(cell).cast("int"))
    counts = _numbered(data, cells, by).groupBy("cell", number.alias("part")).agg(F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"))
    before = F.sum("rows").over(Window.partitionBy("cell").orderBy("part")) - F.col("rows")  # of SPLITS rows
    counts = counts.withColumn("before", before)
    wanted = F.array(*(F.array(*(F.lit(r - cell.below).cast("long") for r in cell.ranks)) for cell in cells))
    mine = F.filter(F.get(wanted, F.col("cell")), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("rows")))
    out = []
    for r in counts.withColumn("ranks", mine).where(F.size("ranks") > 0).collect():  # at most a row for each wanted rank
        old = cells[r["cell"]]
        out.append(_Cell(old.group, r["low"], r["high"], old.below + r["before"], r["rows"], tuple(k + old.below for k in r["ranks"])))
    return out


def _fetch(data: DataFrame, cells: list[_Cell], by: tuple[str, ...]) -> dict[tuple[tuple, int], float]:
    """The values at the wanted ranks of small cells."""
    counts = _numbered(data, cells, by).groupBy("cell", "x").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("cell").orderBy("x"))  # of CELL_ROWS rows
    wanted = F.array(*(F.array(*(F.lit(r - cell.below).cast("long") for r in cell.ranks)) for cell in cells))
    mine = F.filter(F.get(wanted, F.col("cell")), lambda r: (r >= F.col("upto") - F.col("rows")) & (r < F.col("upto")))
    found = counts.withColumn("upto", upto).withColumn("ranks", mine).where(F.size("ranks") > 0).collect()  # at most a row for each wanted rank
    return {(cells[r["cell"]].group, k + cells[r["cell"]].below): r["x"] for r in found for k in r["ranks"]}


def order_statistics(rows: DataFrame, value: Column | str, shares: Mapping[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each group of ``by``: ``n``, and for each name its quantile, exact and interpolated between neighbours; one row without ``by``.

    Nulls and NaN don't count; without values quantiles are null. The driver holds a few
    numbers for each group and share, so ``by`` is for few groups; any of them may hold most rows.
    """
    spark = rows.sparkSession
    data = stage(rows.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)"), "values")
    kinds = dict(data.dtypes)
    seen = {tuple(r[c] for c in by): (r["n"], r["low"], r["high"]) for r in data.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()}
    ranks = {g: {name: q * (n - 1) for name, q in shares.items()} for g, (n, *_) in seen.items() if n}
    found: dict[tuple[tuple, int], float] = {}
    cells = [_Cell(g, seen[g][1], seen[g][2], 0, seen[g][0], tuple(sorted({k for p in at.values() for k in (math.floor(p), math.ceil(p))}))) for g, at in ranks.items()]
    turn = 0
    while cells:
        for cell in cells:
            if cell.low == cell.high:
                found |= {(cell.group, k): cell.low for k in cell.ranks}
        open_ = [c for c in cells if c.low < c.high]
        small = [c for c in open_ if c.rows <= CELL_ROWS]
        if small:
            found |= _fetch(data, small, by)
        large = [c for c in open_ if c.rows > CELL_ROWS]
        cells = _split(data, large, by, turn % 2 == 1) if large else []
        turn += 1

    def at(group: tuple, place: float) -> float:
        low, high = found[group, math.floor(place)], found[group, math.ceil(place)]
        return low if low == high else low * (math.ceil(place) - place) + high * (place - math.floor(place))

    out = [(*g, n, *(at(g, ranks[g][name]) if n else None for name in shares)) for g, (n, *_) in seen.items()]
    return spark.createDataFrame(out, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n long", *(f"`{name}` double" for name in shares)]))
