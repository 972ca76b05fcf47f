"""Mixing sources to target weights by Pfair scheduling.

Each source's documents stand in a fixed random order and are cut into blocks of
``block_chars`` characters. With a target weight of w, the source's k-th block
may be placed from slot floor((k - 1) / w) on and must be placed before slot
ceil(k / w); the earliest deadline goes first. So after any number of slots every
source is less than one block from its target. Weights are exact fractions.

The schedule is laid out in chunks of slots, side by side. A chunk's start is known
without its predecessors: one chunk earlier, take of each source the blocks that
are due in full and, of those under way, the ones with the earliest deadlines.
From any such state every deadline ahead can be met, and two schedules of earliest
deadline first agree once every block that was under way where they differed has
been due. A chunk is no shorter than the longest window of a block, so going from
that state to the chunk's start gives the state of the one schedule from slot 0.
When a source is used up, the others go on in proportion to their weights: a new
phase.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Slots of a chunk at least, and rows of a table that a task hands on at once.
CHUNK, BATCH = 4096, 1 << 16
#: The table of sources is broadcast up to this count (some 100 bytes each).
BROADCAST_SOURCES = 200_000
#: Rows of one sorted piece of a source's order, and pieces that are summed before the sources are.
PIECE_ROWS, SHELF = 4096, 4096


@dataclass(frozen=True)
class Phase:
    """Slots ``start .. start + length`` in which the sources of ``parts`` (whole parts of ``total``) go on from ``done`` blocks each."""

    start: int
    length: int
    parts: dict[str, int]
    total: int
    done: dict[str, int]

    def rule(self, slot: int) -> dict[str, int]:
        """Blocks of each source before a slot: those due in full, and the earliest deadlines of those under way."""
        counts = {s: slot * e // self.total for s, e in self.parts.items()}
        under_way = [(-(-(counts[s] + 1) * self.total // e), s) for s, e in self.parts.items() if slot * e % self.total]
        for _, s in heapq.nsmallest(slot - sum(counts.values()), under_way):
            counts[s] += 1
        return counts

    @property
    def step(self) -> int:
        """Slots of a chunk: no fewer than the longest window of a block."""
        return max(CHUNK, -(-self.total // min(self.parts.values())) + 1)

    def run(self, begin: int, end: int, counts: dict[str, int]) -> Iterator[str]:
        """The sources of the slots begin .. end by earliest deadline first, from ``counts`` blocks on, which are kept up to date."""
        total, parts = self.total, self.parts
        release, deadline = [(counts[s] * total // e, s) for s, e in parts.items()], []
        heapq.heapify(release)
        for slot in range(begin, end):
            while release and release[0][0] <= slot:
                s = heapq.heappop(release)[1]
                heapq.heappush(deadline, (-(-(counts[s] + 1) * total // parts[s]), s))
            due, s = heapq.heappop(deadline)
            if due <= slot:
                raise AssertionError("a deadline was missed")
            yield s
            counts[s] += 1
            heapq.heappush(release, (counts[s] * total // parts[s], s))

    def chunks(self) -> int:
        return -(-self.length // self.step)

    def border(self, chunk: int) -> dict[str, int]:
        """Blocks of each source before a chunk, or at the end of the phase."""
        begin = max(chunk - 1, 0) * self.step
        counts = self.rule(begin)
        for _ in self.run(begin, min(chunk * self.step, self.length), counts):
            pass
        return counts

    def schedule(self, chunk: int) -> Iterator[tuple[str, int, int]]:
        """(source, block, slot) of a chunk."""
        counts, begin = self.border(chunk), chunk * self.step
        for slot, s in enumerate(self.run(begin, min(begin + self.step, self.length), counts), begin):
            yield s, self.done[s] + counts[s], self.start + slot


def phases(blocks: Mapping[str, int], weights: Mapping[str, float | Fraction]) -> list[Phase]:
    """Until every block has its slot: each phase ends when its first source is used up."""
    exact = {s: Fraction(weights[s]) for s, n in blocks.items() if n > 0}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    scale = lcm(*(w.denominator for w in exact.values())) if exact else 1
    parts = {s: int(w * scale) for s, w in exact.items()}
    left, done, start, out = {s: blocks[s] for s in exact}, dict.fromkeys(exact, 0), 0, []
    while left:
        own = {s: parts[s] for s in left}
        total = sum(own.values())
        length = min(n * total // own[s] for s, n in left.items())
        phase = Phase(start, length, own, total, {s: done[s] for s in left})
        counts = phase.border(phase.chunks())
        # of a source whose share ends within the next slot one block may be left; deadlines allow one such source, whose block takes that slot
        last = [s for s in left if counts[s] < left[s] and left[s] * total < (length + 1) * own[s]]
        out.append(phase)
        start += length
        for s in left:
            done[s] += counts[s]
        for s in last:
            out.append(Phase(start, 1, {s: 1}, 1, {s: done[s]}))
            start, done[s] = start + 1, done[s] + 1
        left = {s: blocks[s] - done[s] for s in left if blocks[s] > done[s]}
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float | Fraction] | None = None, block_chars: int = 1 << 16, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` with ``block`` (within its source), ``slot`` (over all) and ``offset`` (characters of the source before it).

    Reading by slot and offset is the mixture. ``weights`` gives a target for
    every source that occurs; by default targets follow the square roots of the
    sources' characters. The driver holds the sources as it holds the weights: a
    phase has a number for each source that is left. A null source is a source of
    its own, a null text has no characters, repeated rows and null ids are placed
    like others. Columns named like the results are replaced.
    """
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c not in ("block", "slot", "offset")]
    named = docs.select(  # own columns travel as one, so that no name of theirs is in the way
        F.struct(*keep).alias("_row"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("_chars"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")), 1).alias("_draw"))
    sizes = named.groupBy("_source").agg(F.sum("_chars").alias("chars"), F.count("*").alias("rows")).collect()  # one row for each source
    if not sizes:
        return docs.select(*keep, *(F.lit(0).cast("long").alias(c) for c in ("block", "slot", "offset")))
    given = {"" if s is None else f"={s}": w for s, w in weights.items()} if weights else {r["_source"]: max(r["chars"], 1) ** 0.5 for r in sizes}
    plan = phases({r["_source"]: r["chars"] // block_chars + 1 for r in sizes}, given)
    pieces = spark.createDataFrame([(r["_source"], -(-r["rows"] // PIECE_ROWS)) for r in sizes], "_source string, _pieces long")

    # running characters: sums of shelves of pieces first, then of pieces, then within each piece
    few = len(sizes) <= BROADCAST_SOURCES
    placed = named.join(F.broadcast(pieces) if few else pieces, "_source").withColumn("_piece", F.floor(F.col("_draw") / F.lit(2.0**63) * F.col("_pieces"))).drop("_pieces")
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda what, by, order: F.coalesce(F.sum(what).over(earlier(by, order)), F.lit(0))
    sums = placed.groupBy("_source", "_piece").agg(F.sum("_chars").alias("_sum"), F.max("_chars").alias("_most")).withColumn("_shelf", F.floor(F.col("_piece") / SHELF))
    sums = stage(sums, "pieces")
    shelves = sums.groupBy("_source", "_shelf").agg(F.sum("_sum").alias("_whole")).select("_source", "_shelf", before("_whole", ["_source"], "_shelf").alias("_below"))
    sums = sums.withColumn("_beside", before("_sum", ["_source", "_shelf"], "_piece")).join(shelves, ["_source", "_shelf"])
    sums = sums.select("_source", "_piece", "_sum", (F.col("_below") + F.col("_beside")).alias("_before"))

    # the slots of each piece's blocks
    def lay_out(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups:
            for k, chunk in zip(group["phase"], group["chunk"], strict=True):
                rows = plan[k].schedule(chunk)
                while part := list(islice(rows, BATCH)):
                    yield pd.DataFrame(part, columns=["_source", "block", "slot"])

    work = spark.createDataFrame([(k, c) for k, phase in enumerate(plan) for c in range(phase.chunks())], "phase int, chunk int")
    slots = stage(work.repartition(max(1, min(work.count(), 4 * spark.sparkContext.defaultParallelism))).mapInPandas(lay_out, "_source string, block long, slot long"), "slots")
    first, last = (F.floor(F.col("_before") / block_chars), F.floor((F.col("_before") + F.col("_sum")) / block_chars))
    wanted = sums.select("_source", "_piece", F.explode(F.sequence(first, last)).alias("block")).join(slots, ["_source", "block"])
    wanted = wanted.groupBy("_source", "_piece").agg(F.array_sort(F.collect_list(F.struct("block", "slot"))).alias("_slots"))  # a piece has PIECE_ROWS rows on average
    wanted = sums.select("_source", "_piece", "_before").join(wanted, ["_source", "_piece"])

    within = Window.partitionBy("_source", "_piece").orderBy("_draw", "_row.doc_id", "_chars").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_within", F.coalesce(F.sum("_chars").over(within), F.lit(0))).join(wanted, ["_source", "_piece"])
    placed = placed.withColumn("offset", F.col("_before") + F.col("_within")).withColumn("block", F.floor(F.col("offset") / block_chars))
    at = (F.col("block") - F.get("_slots", F.lit(0))["block"]).cast("int")
    return placed.select("_row.*", "block", F.get("_slots", at)["slot"].cast("long").alias("slot"), "offset")
