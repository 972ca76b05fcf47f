"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A document is its set of distinct five-word shingles. Its signature has SLOTS
minima of BITS bits. The slots are split into CHUNKS; by pigeonhole two
signatures that differ in at most ``MAX_DIFFERENT`` slots have a chunk with at
most one differing slot. So each chunk is indexed under SLOTS / CHUNKS keys,
each with one slot left out, and all such pairs meet under some key. (At a
similarity of 0.85 the chance that no chunk meets is below one in a million.)
Pairs that meet are confirmed on their full sets.

Buckets are never expanded into all pairs. Equal sets become one class first.
Then each bucket links its members to one leader, and once more to another,
drawn for each bucket; what is linked by then is one component. Buckets that
still hold more than one component form families, which are compared in pairs
of blocks: a task counts a member's intersections with a whole block at once and
writes one spanning label for each member, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, keyed_hash, mix, slices, stage, word_bounds, word_codes

WORDS = 5
SLOTS, BITS, CHUNKS = 60, 16, 10
WIDTH = SLOTS // CHUNKS
#: Guaranteed to meet: fewer than two errors in some chunk.
MAX_DIFFERENT = 2 * CHUNKS - 1
#: Pairs that met are confirmed up to this distance: 4.9 standard deviations beyond the mean at a similarity of 0.85.
CONFIRM_UP_TO = 22
#: The closest leaders that a member is confirmed with in the second round; what they leave is up to the families.
NEAREST = 4
#: Members and bytes of sets in a block of a family.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Classes whose SLOTS keys each one task makes.
CLASSES_A_TASK = 8192
#: Ids are broadcast up to this count (some 100 bytes each as a hash table).
BROADCAST_IDS = 200_000

_RANDOM = np.random.default_rng(605)
_FACTORS = _RANDOM.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(1, 1 << 63, SLOTS, dtype=np.uint64)
_PLACES = _RANDOM.integers(1, 1 << 63, max(SLOTS, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keyed hashes of the words of all texts in order, and the n + 1 offsets of the texts in them."""
    data = _LOWER[data]
    starts, stops, bounds = word_bounds(data, offsets, _SEPARATOR)
    codes, names = word_codes(data, starts, stops)
    return keyed_hash(names)[codes], bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than five words are one shingle, none are an empty set."""
    words, bounds = word_hashes(data, offsets)
    n = len(words)
    full = np.zeros(max(n - WORDS + 1, 0), np.uint64)
    for place in range(WORDS):
        full += words[place : place + len(full)] * _PLACES[place]
    full = mix(full)
    out = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if last - first >= WORDS:
            out.append(np.unique(full[first : last - WORDS + 1]))
        elif last > first:
            short = (words[first:last] * _PLACES[: last - first]).sum(dtype=np.uint64) + np.uint64(last - first)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low BITS bits of SLOTS minima."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * _FACTORS + _OFFSETS).min(0), out=least)
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint16)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    one, two = mix(hashes ^ np.uint64(0x1234567)).sum(dtype=np.uint64), mix(hashes ^ np.uint64(0x89ABCDE)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the two halves of the set's key and the signature (null for an empty set, whose key is its row's own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            sets = shingle_sets(data, offsets)
            keys = [set_key(s) if len(s) else (i, -1) for i, s in enumerate(sets)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "k1": pa.array([k for k, _ in keys], pa.int64()), "k2": pa.array([k for _, k in keys], pa.int64()),
                "sig": pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): for each chunk one key for each slot that may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                reps = part.column("rep").to_numpy()
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS).astype(np.uint64)
                terms = mix((sig + np.uint64(1)) * _PLACES[:SLOTS]).reshape(-1, CHUNKS, WIDTH)
                keys = terms.sum(2, dtype=np.uint64)[:, :, None] - terms + np.arange(1, SLOTS + 1, dtype=np.uint64).reshape(CHUNKS, WIDTH) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_pydict({"key": mix(keys).reshape(-1).view(np.int64), "rep": np.repeat(reps, SLOTS)})

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def close_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those (a, b), with their distance, whose signatures differ in at most CONFIRM_UP_TO slots and whose set sizes allow the similarity."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
                far = (x != y).sum(1)
                near = far <= CONFIRM_UP_TO
                yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(pa.array(near)), "b": batch.column("b").filter(pa.array(near)), "far": pa.array(far[near], pa.int64())})

    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * F.lit(PERCENT)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(sizes).select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, far long")


PERCENT = 85


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (a, b) with 100 * intersection >= 85 * union on full sets."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("hashes").alias(f"set_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= PERCENT * (len(both) - common))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(pa.array(linked, pa.bool_())), "b": batch.column("b").filter(pa.array(linked, pa.bool_()))})

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


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


def _ranked(hashes: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all members as places in the list of distinct ones, and their number by member; the column's own buffers are read, not copied."""
    values, sizes = [], []
    for chunk in hashes.chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        values.append(pa.array(np.frombuffer(chunk.buffers()[2], np.int64)[at[0] // 8 : at[-1] // 8]))
        sizes.append(np.diff(at) // 8)
    found = pa.chunked_array(values).dictionary_encode()
    return np.concatenate([c.indices.to_numpy() for c in found.chunks]), np.concatenate(sizes).astype(np.int64)


def _compare_blocks(group: pa.Table) -> pa.Table:
    """Spanning labels (a, b) for the links between members of different components of two blocks (or of one).

    Members of the commonest component are compared with the others only. Beside
    the group itself about as much memory is taken as its sets have.
    """
    rep, component, mine = (group.column(c).to_numpy() for c in ("rep", "component", "mine"))
    low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
    flat, sizes = _ranked(group.column("hashes"))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    names, counts = np.unique(component, return_counts=True)
    marked = np.zeros(int(flat.max()) + 1, np.int32)
    a, b = [], []
    for i in np.flatnonzero(component != names[counts.argmax()]):
        other = (component != component[i]) & ((sig != sig[i]).sum(1) <= CONFIRM_UP_TO)
        other &= mine == (high if mine[i] == low else low)
        if not other.any():
            continue
        own = flat[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        common = np.add.reduceat(marked[flat], starts).astype(np.int64)
        marked[own] = 0
        linked = np.flatnonzero(other & (100 * common >= PERCENT * (sizes + sizes[i] - common)))
        a.append(np.full(len(linked), i))
        b.append(linked)
    label = _local_labels(len(rep), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(rep))
    rows = np.flatnonzero(rep != rep[label])
    return pa.table({"a": rep[rows], "b": rep[label[rows]]})


def _across_families(rows: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between different components of members (key, rep, component) that share a bucket, through their families' blocks."""
    leaders = rows.groupBy("key").agg(F.min("rep").alias("leader"))
    families = components(rows.join(leaders, "key").where("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    members = rows.select("rep", "component").distinct().join(families.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep")
    members = stage(members.join(classes.select("rep", "n_shingles", "sig"), "rep"), "families")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") * 8 / BLOCK_BYTES))
    sizes = members.groupBy("family").agg(blocks.cast("int").alias("blocks"))
    placed = (
        members.join(sizes, "family").join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("family", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "rep", "component", "sig", "hashes")
    )
    return placed.groupBy("family", "low", "high").applyInArrow(_compare_blocks, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (which needs doc_id and text).

    A null, empty or blank text has no shingles and links with nothing. Rows
    with one doc_id count as one document. A null doc_id takes part in nothing:
    its component is null and it is kept.
    """
    docs = docs.select("doc_id", "text")
    sketches = stage(sketch(docs), "sketches")
    nodes = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stage(
        nodes.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes"
    )
    keys = index_keys(classes.repartition(max(1, -(-classes.count() // CLASSES_A_TASK))))
    crowded = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1").select("key", "leader")
    members = stage(keys.join(crowded, "key"), "members")
    first = members.where("leader <> rep").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    involved = stage(members.select(F.col("rep").alias("doc_id")).distinct(), "involved")
    ids = F.broadcast(involved) if involved.count() <= BROADCAST_IDS else involved
    sets = stage(_full_sets(docs.join(ids, "doc_id", "left_semi")), "sets")
    edges = stage(confirm(close_pairs(first, classes), sets), "links")

    rows = _unjoined(members, edges)
    drawn = F.xxhash64("key", "rep")
    leaders = rows.groupBy("key").agg(F.min_by("rep", drawn).alias("leader"), F.min_by("component", drawn).alias("leads"))
    second = rows.join(leaders, "key").where("component <> leads").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    nearest = F.row_number().over(Window.partitionBy("b").orderBy("far", "a"))
    second = close_pairs(second, classes).withColumn("nearest", nearest).where(F.col("nearest") <= NEAREST)
    edges = stage(edges.unionByName(confirm(second, sets)), "links")

    edges = stage(edges.unionByName(_across_families(_unjoined(members, edges), classes, sets)), "links")
    found = components(edges)
    by_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return sketches.join(by_class, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _unjoined(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The members, with their components, of buckets that hold more than one component."""
    found = components(edges).withColumnRenamed("node", "rep")
    rows = members.select("key", "rep").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return stage(rows.join(mixed, "key"), "unjoined")


def _full_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "hashes": pa.array(sets, pa.binary())})

    return docs.mapInArrow(run, "doc_id long, hashes binary")
