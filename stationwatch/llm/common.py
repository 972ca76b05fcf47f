"""What the corpus operators share: stage tables, components, text buffers and hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents with this remainder are never learned from.
HELD_OUT_REMAINDER = 2
FOLDS = 4

# ---------------------------------------------------------------- stage tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: executors of a cluster need a shared folder")
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: computed once, lineage cut, lost executors harmless."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_is_held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT_REMAINDER, F.lit(False))


def may_learn_from(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).isNotNull() & ~fold_is_held_out(doc_id)


# ------------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge ``(a, b)``; component is the smallest node reachable.

    All nodes of one label take the least label among their neighbours, or their
    label's own label if that is less; so whole basins are hooked at once and
    chains of labels shorten by doubling. Labels only fall, and where none does
    every edge joins equal ones: the rounds go on until then, whatever their
    number. Each round is a stage table.
    """
    both = stage(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        )
        hook = labels.join(near, "node").groupBy("label").agg(F.min("near").alias("hook"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        lower = hook.join(jump, "label").select("label", F.least("label", "hook", "further").alias("new"))
        new = stage(labels.join(lower, "label").select("node", F.col("label").alias("old"), F.col("new").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            break
    return labels.select("node", F.col("label").alias("component"))


# ---------------------------------------------------------------- text buffers


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one uint8 array and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 512 << 10, max_rows: int = 1024
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Arrow batches cut to about ``max_bytes`` of text each, so that copies and temporary arrays stay small; one longer row is a slice of its own."""
    for batch in batches:
        for at in range(0, batch.num_rows, max_rows):
            part = batch.slice(at, max_rows)
            data, offsets = utf8(part.column(column))
            first = 0
            while first < part.num_rows:
                last = int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1
                last = min(max(last, first + 1), part.num_rows)
                yield part.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                first = last


# --------------------------------------------------------------------- hashing

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _MULTIPLIER) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; the table is kept and grows by doubling."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return table[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums of byte codes times powers, modulo 2**64: differences hash any substring."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers(len(data)), dtype=np.uint64, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), _INVERSE)[starts])


# ----------------------------------------------------------------------- words


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without separator bytes, none across texts, and the n + 1 offsets of the texts in them."""
    inside = ~separator[data]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[first] = inside[first]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def inside(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in spans [start, stop), which are in order and don't overlap; a byte each, no index."""
    edges = np.zeros(n + 1, np.int8)
    edges[starts] += 1
    edges[stops] -= 1
    return np.cumsum(edges[:n], dtype=np.int8).astype(bool)


def word_codes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """For words [start, stop), which don't overlap, the place of each in the list of distinct words, and that list: by bytes, not by hash."""
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside(len(data), starts, stops)])])
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def keyed_hash(values: pa.Array) -> np.ndarray:
    """64-bit SipHash of byte strings: a keyed hash, in which no structure of the input survives."""
    if not len(values):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array([v.decode("utf-8", "surrogateescape") for v in values.to_pylist()], dtype=object), encoding="utf8", hash_key="0f1e2d3c4b5a6978", categorize=False)
