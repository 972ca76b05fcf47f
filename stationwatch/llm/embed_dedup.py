"""Near-duplicate embeddings by sorted projection passes.

Each pass orders all vectors by KEY_BITS concatenated sign bits of random
projections and compares every vector with its WINDOW successors, in blocks of
ranks that carry the next block's first rows along. Pairs are judged by their
exact cosine. Equal vectors become one class first. Vectors that share a key's
first bits are a cell; where a cell holds more than WINDOW vectors, the window
can't reach all of them: there the rest of the cell is compared in pairs of
blocks. So any two vectors of one cell are compared, however crowded it is, and
the number of passes is the one at which two vectors at the least cosine share a
cell of some pass with probability RECALL. How many bits make a cell follows the
table: the length for which passes and cell sizes cost least. A pair counts in the first pass that
compares it, which both vectors' ranks and keys tell, so degrees add up over
tasks and no pair is written; only a spanning label for each vector is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, stage

#: PASSES is the least number; more are made where RECALL needs them.
PASSES, KEY_BITS, WINDOW, BLOCK = 12, 24, 64, 512
COSINE = 0.95
#: The share of pairs at exactly the least cosine that are compared; closer pairs are compared more surely.
RECALL = 0.999


def _projections(dim: int, passes: int) -> np.ndarray:
    return np.random.default_rng([97, dim]).normal(size=(passes * KEY_BITS, dim))


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, k1, k2, dim) of each row, dim 0 if it links with nothing; and one row for each distinct vector with its single-precision numbers."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, dims, raw = batch.column("vec_id").cast(pa.int64()), [], [], []
            for i, value in enumerate(batch.column("embedding")):
                x = np.array(value.as_py(), np.float64) if value.is_valid and value.values.null_count == 0 else np.zeros(0)
                if len(x) and np.isfinite(x).all() and x.any():
                    code = (x + 0.0).tobytes()
                    keys.append(hashlib.blake2b(code, digest_size=16).digest())
                    dims.append(len(x))
                    raw.append(code)
                else:
                    keys.append(i.to_bytes(8, "little") + b"\0" * 8)
                    dims.append(0)
                    raw.append(None)
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({"vec_id": ids, "k1": halves[:, 0].copy(), "k2": halves[:, 1].copy(), "dim": pa.array(dims, pa.int32()), "x": pa.array(raw, pa.binary())})

    rows = stage(vectors.select("vec_id", "embedding").mapInArrow(check, "vec_id long, k1 long, k2 long, dim int, x binary"), "vectors")
    good = rows.where("dim > 0 AND vec_id IS NOT NULL")
    classes = good.groupBy("k1", "k2", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("x").alias("x"))
    return rows.drop("x"), stage(classes, "classes")


def passes_for(bits: int, cosine: float) -> int:
    """The passes after which two vectors at this cosine shared the first ``bits`` signs of a key with probability RECALL."""
    both = (1 - np.arccos(min(max(cosine, -1.0), 1.0)) / np.pi) ** bits
    return int(np.ceil(np.log1p(-RECALL) / np.log1p(-both))) if 0 < both < 1 else 1


def _cells(classes: DataFrame, least: int, cosine: float) -> tuple[int, int]:
    """(bits of a cell, passes) that copy the fewest rows: in each pass a row goes to about two windows and to every block of its cell."""
    if cosine <= -1:
        raise ValueError("every pair has this cosine")
    counts = stage(_keyed(classes, 1).groupBy("dim", "key").agg(F.count("*").alias("n")), "cells")
    cells = counts.select("dim", "n", "key", F.explode(F.sequence(F.lit(1), F.lit(KEY_BITS))).alias("bits"))
    cells = cells.groupBy("dim", "bits", F.expr(f"shiftright(key, {KEY_BITS} - bits)").alias("cell")).agg(F.sum("n").cast("double").alias("n"))
    crowd = cells.groupBy("bits").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"), F.sum("n").alias("n")).collect()  # KEY_BITS rows
    cost = {r["bits"]: max(least, passes_for(r["bits"], cosine)) * (2 + r["pairs"] / r["n"] / BLOCK) for r in crowd}
    bits = min(cost, key=lambda b: (cost[b], b), default=KEY_BITS)
    return bits, max(least, passes_for(bits, cosine)) if cost else least


def _keyed(classes: DataFrame, passes: int) -> DataFrame:
    """(k1, k2, dim, pass, key) of every class and pass."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(KEY_BITS - 1, -1, -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column("dim").to_numpy()
            out = np.zeros((batch.num_rows, passes), np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                x = np.frombuffer(b"".join(batch.column("x")[int(i)].as_py() for i in rows), np.float64).reshape(len(rows), -1)
                normals = _projections(int(dim), passes)
                for t in range(passes):  # signs of one pass at a time
                    out[rows, t] = (x @ normals[t * KEY_BITS : (t + 1) * KEY_BITS].T > 0) @ weights
            n = batch.num_rows
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            yield pa.RecordBatch.from_pydict({
                "k1": np.repeat(k1, passes), "k2": np.repeat(k2, passes), "dim": np.repeat(dims, passes),
                "pass": np.tile(np.arange(passes, dtype=np.int32), n), "key": out.reshape(-1),
            })

    return classes.select("k1", "k2", "dim", "x").mapInArrow(keys, "k1 long, k2 long, dim int, pass int, key long")


def _ranked(classes: DataFrame, passes: int, bits: int) -> DataFrame:
    """The classes with their cell and their rank in every pass; ranks go by whole keys and run on over the passes."""
    order = ["dim", "pass", "key", "k1", "k2"]
    rows = _keyed(classes, passes)
    rows = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "keys")
    rows = rows.withColumns({"part": F.shiftright("place", 33), "place": F.col("place").bitwiseAND((1 << 33) - 1)})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = rows.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranks = rows.join(offsets, "part").select("k1", "k2", "dim", F.struct("pass", (F.col("place") + F.col("offset")).alias("rank"), F.shiftright("key", KEY_BITS - bits).alias("key")).alias("at"))
    ranks = ranks.groupBy("k1", "k2", "dim").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return stage(classes.join(ranks, ["k1", "k2", "dim"]).select("rep", "n", "dim", "x", F.col("at.rank").alias("ranks"), F.col("at.key").alias("keys")), "ranked")


def _local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row number that each of n rows reaches over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(group: pd.DataFrame, first: np.ndarray, second: np.ndarray, nearest: int, farthest: int | None, at: int, cosine: float) -> pd.DataFrame:
    """Degrees to add and spanning labels from the pairs of ``first`` and ``second`` rows whose ranks differ by nearest..farthest and that no earlier pass compares."""
    x = np.frombuffer(b"".join(group["x"]), np.float64).reshape(len(group), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    ranks, keys = np.stack(group["ranks"].to_numpy()), np.stack(group["keys"].to_numpy())
    i, j = np.nonzero(x[first] @ x[second].T >= cosine)
    i, j = first[i], second[j]
    gap = ranks[j, at] - ranks[i, at]
    fits = (gap >= nearest) & (gap <= farthest) if farthest is not None else gap >= nearest
    i, j = i[fits], j[fits]
    new = np.ones(len(i), bool)
    for t in range(at):
        new &= ~((np.abs(ranks[i, t] - ranks[j, t]) <= WINDOW) | (keys[i, t] == keys[j, t]))
    i, j = i[new], j[new]
    rep, n = group["rep"].to_numpy(), group["n"].to_numpy()
    add = np.zeros(len(group), np.int64)
    np.add.at(add, i, n[j])
    np.add.at(add, j, n[i])
    label = rep[_local_labels(len(group), i, j)]
    rows = np.flatnonzero(add)
    return pd.DataFrame({"rep": rep[rows], "links": add[rows], "label": label[rows]})


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite numbers link
    with nothing, as do vectors of different lengths with each other. A null
    vec_id takes part in nothing: no links, a null component, kept. Repeated
    rows are copies of one another. ``passes`` is the least number of passes.
    """
    rows, classes = _classes(vectors)
    bits, passes = _cells(classes, passes, cosine)
    ranked = _ranked(classes, passes, bits)
    each = ranked.select("*", F.posexplode("ranks").alias("pass", "rank")).withColumn("key", F.get("keys", F.col("pass")))
    columns = ["dim", "pass", "rep", "n", "x", "ranks", "keys", "rank"]

    block = F.floor(F.col("rank") / BLOCK)
    reach = F.when((F.col("rank") % BLOCK < WINDOW) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    windows = each.select(*columns, F.explode(reach).alias("block"))

    def by_window(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        own = np.flatnonzero((group["rank"] // BLOCK == group["block"].iloc[0]).to_numpy())
        return _compare(group, own, np.arange(len(group)), 1, WINDOW, int(group["pass"].iloc[0]), cosine)

    schema = "rep long, links long, label long"
    found = windows.groupBy("dim", "pass", "block").applyInPandas(by_window, schema)

    cells = each.groupBy("dim", "pass", "key").agg(F.min("rank").alias("start"), F.count("*").alias("size")).where(F.col("size") > WINDOW)
    spread = each.join(cells, ["dim", "pass", "key"]).withColumn("mine", F.floor((F.col("rank") - F.col("start")) / BLOCK))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK))))
    spread = spread.select(*columns, "key", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))

    def by_cell(group: pd.DataFrame) -> pd.DataFrame:
        mine, low, high = group["mine"].to_numpy(), group["low"].iloc[0], group["high"].iloc[0]
        return _compare(group, np.flatnonzero(mine == low), np.flatnonzero(mine == high), WINDOW + 1, None, int(group["pass"].iloc[0]), cosine)

    found = stage(found.unionByName(spread.groupBy("dim", "pass", "key", "low", "high").applyInPandas(by_cell, schema)), "found")
    groups = components(found.where("rep <> label").select(F.col("rep").alias("a"), F.col("label").alias("b")).distinct())
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = (
        classes.select("k1", "k2", "rep", "n").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    known = F.col("vec_id").isNotNull()
    linked = known & (F.col("dim") > 0)
    return rows.join(by_class, ["k1", "k2"], "left").select(
        "vec_id", F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
