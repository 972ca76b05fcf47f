"""Collocations: phrases of two to four words that are used together, mined by SON partitioning.

The corpus falls into SHARDS shards, which are whole partitions of the input. A
phrase with SUPPORT occurrences in all has, in some shard, at least a SHARDS-th
of them: each shard is mined completely at that lowered support, level by level,
and what is frequent in some shard is a candidate. Phrases are counted by key, a part
of a 64-bit hash: tasks add up what they read and send it as blocks, sorted keys
of one range as packed differences, and each range's blocks are merged with the
shards side by side, so candidates that miss the support in all shards together
go at once. The union of the others is
a table of bits of a fixed size, which travels to all tasks; it lets some more
phrases through, as sets of bits do, but holds none back. Then the texts are read
once more and all that passes is counted exactly, by its words. A level only
looks at phrases whose parts passed the level below, so that rare phrases, which
are most of a corpus, hardly reach a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_hash, mix, slices, stage, word_bounds, word_codes

LONGEST, SUPPORT, PERCENT_INSIDE, TOP = 4, 30, 80, 2000
#: Shards are mined at this part of the support.
SHARDS = 4
#: Bits of the tables of frequent words, and of candidates: 2 MB and 16 MB, whatever the size of the corpus.
WORD_BITS, PHRASE_BITS = 24, 27
#: Bits of a key that travel when candidates are mined. Phrases that share one are candidates sooner, never later.
KEY_BITS = 40
#: Keys that a task holds before it sends them, and ranges of keys for each of the input's partitions, in which blocks meet:
#: a range's keys are as many as a part of a task's, whatever the size of the corpus.
HELD_KEYS, RANGES = 1 << 21, 4
#: Text that is counted in one go; longer texts are cut between pieces.
SLICE_BYTES = 2 << 20
#: Groups in which each language is ranked before its first phrases meet.
RANK_GROUPS = 32
UNKNOWN = "und"

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATOR = _BREAKS.copy()
_SEPARATOR[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PLACES = np.random.default_rng(1101).integers(1, 1 << 63, LONGEST + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Words:
    """The words of some texts in order: codes by their bytes, hashes with their language, and whether the next one follows in the same piece."""

    codes: np.ndarray
    hashes: np.ndarray
    langs: np.ndarray
    follows: np.ndarray
    text: bytes
    starts: np.ndarray
    stops: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, salts: np.ndarray) -> Words:
        """``langs`` has a number for each text, ``salts`` a hash for each such number."""
        data = _LOWER[data]
        starts, stops, bounds = word_bounds(data, offsets, _SEPARATOR)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        codes, names = word_codes(data, starts, stops)
        breaks = np.cumsum(_BREAKS[data], dtype=np.int32)[starts]
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])
        sizes = stops - starts
        ends = np.cumsum(sizes + 1)  # words with one space behind each
        spaced = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        lettered = np.ones(len(spaced), bool)
        lettered[ends - 1] = False
        spaced[lettered] = data[~_SEPARATOR[data]]
        lang = langs[row]
        return cls(codes, keyed_hash(names)[codes] * _PLACES[LONGEST] + salts[lang], lang, follows, spaced.tobytes(), ends - sizes - 1, ends - 1)

    def whole(self, size: int) -> np.ndarray:
        """Where a phrase of ``size`` words starts."""
        out = np.ones(len(self.codes), bool)
        out[max(len(out) - size + 1, 0) :] = False
        for k in range(size - 1):
            out[: len(out) - k] &= self.follows[k:]
        return out

    def keys(self, at: np.ndarray, size: int) -> np.ndarray:
        """64-bit keys of the phrases of ``size`` words at given places; a language's own."""
        total = np.full(len(at), size, np.uint64)
        for k in range(size):
            total += self.hashes[at + k] * _PLACES[k]
        return mix(total)

    def counted(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of distinct phrases among those at ``at``, their keys and counts. Words decide; phrases of one key but other words come apart."""
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys = self.keys(at, size)
        order = np.argsort(keys)
        at, keys = at[order], keys[order]
        opens = np.concatenate([[True], (keys[1:] != keys[:-1]) | (self.langs[at][1:] != self.langs[at][:-1])])
        for k in range(size):
            code = self.codes[at + k]
            opens[1:] |= code[1:] != code[:-1]
        first = np.flatnonzero(opens)
        return at[first], keys[first], np.diff(np.concatenate([first, [len(at)]]))

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        return pa.array([self.text[a:b] for a, b in zip(self.starts[at].tolist(), self.stops[at + size - 1].tolist(), strict=True)], pa.binary()).cast(pa.string())


class Bits:
    """A set of keys as bits under their lowest digits: no key of the set is ever missing."""

    def __init__(self, n_bits: int):
        self.n_bits, self.words = n_bits, np.zeros(1 << (n_bits - 6), np.uint64)

    @classmethod
    def of(cls, keys: DataFrame, n_bits: int) -> Bits:
        """From the column ``key``: at most 2**(n_bits - 6) rows of 64 bits each come to the driver."""
        place = F.col("key").bitwiseAND((1 << n_bits) - 1)
        rows = keys.select(F.shiftright(place, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
        found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        out = cls(n_bits)
        out.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return out

    def has(self, keys: np.ndarray) -> np.ndarray:
        place = keys & np.uint64((1 << self.n_bits) - 1)
        return (self.words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words, list[str]]]:
    """Slices of the texts as words, with the names of their languages; a text of over SLICE_BYTES comes in parts that end between pieces."""
    for batch, data, offsets in slices(batches, "text", SLICE_BYTES, 1 << 20):
        names = batch.column("lang").dictionary_encode()
        langs, known = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary.to_pylist()
        salts = keyed_hash(pa.array([k.encode() for k in known], pa.large_binary()))
        if len(offsets) > 2 or len(data) <= SLICE_BYTES:
            yield batch, Words.of(data, offsets, langs, salts), known
            continue
        at = 0
        while at < len(data):  # one long text
            end = min(at + SLICE_BYTES, len(data))
            if end < len(data):
                cuts = np.flatnonzero(_BREAKS[data[at:end]])
                while not len(cuts) and end < len(data):  # no piece ends here
                    step = min(end + SLICE_BYTES, len(data))
                    cuts, end = np.flatnonzero(_BREAKS[data[end:step]]) + (end - at), step
                end = at + int(cuts[-1]) + 1 if len(cuts) else end
            yield batch, Words.of(data[at:end], np.array([0, end - at]), langs, salts), known
            at = end


def _named(known: list[str], words: Words, at: np.ndarray) -> pa.Array:
    return pa.array(known, pa.string()).take(pa.array(words.langs[at])) if len(at) else pa.array([], pa.string())


@dataclass(frozen=True)
class Passed:
    """What passed the levels so far: tables of single words, of pairs and of longer phrases."""

    words: Bits | None = None
    pairs: Bits | None = None
    longer: Bits | None = None

    def places(self, words: Words, size: int) -> np.ndarray:
        """Where phrases of ``size`` words start whose parts, and which themselves where that is known, passed."""
        at = np.flatnonzero(words.whole(size))
        part, table = (2, self.pairs) if self.pairs is not None and size > 1 else (1, self.words)
        if table is not None:
            inner = words.whole(part)
            inner[inner] = table.has(words.keys(np.flatnonzero(inner), part))
            for k in range(size - part + 1):
                at = at[inner[at + k]]
        if self.longer is not None and size > 2:
            at = at[self.longer.has(words.keys(at, size))]
        return at


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts, of which what exceeds the support doesn't matter and goes."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.minimum(np.add.reduceat(n[order], first, axis=0), SUPPORT) if len(keys) else n


def _blocks(keys: np.ndarray, n: np.ndarray, bits: int, shard: int) -> pa.RecordBatch:
    """A row for each range of the sorted ``keys``, 2**bits ranges in all: differences and counts by planes of bytes, packed."""
    tops = (keys >> np.uint64(KEY_BITS - bits)).astype(np.int32)
    starts = np.flatnonzero(np.diff(tops, prepend=-1))
    codec, blocks = pa.Codec("zstd", compression_level=1), []
    for a, b in zip(starts.tolist(), np.append(starts, len(keys))[1:].tolist(), strict=True):
        planes = np.stack([np.diff(keys[a:b], prepend=np.uint64(0)), n[a:b].astype(np.uint64)]).view(np.uint8).reshape(2, b - a, 8)
        blocks.append((b - a).to_bytes(4, "little") + codec.compress(planes.transpose(0, 2, 1).tobytes(), asbytes=True))
    return pa.RecordBatch.from_pydict({"range": pa.array(tops[starts]), "shard": pa.array(np.full(len(starts), shard, np.int32)), "block": pa.array(blocks, pa.binary())})


def _unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = int.from_bytes(block[:4], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(block[4:], 16 * size, asbytes=True), np.uint8).reshape(2, 8, size)
    steps, n = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    return np.cumsum(steps, dtype=np.uint64), n.astype(np.int64)


def mined(texts: DataFrame, sizes: tuple[int, ...], passed: Passed) -> DataFrame:
    """(key) of phrases that reach the lowered support in some shard, and the support in all of them; KEY_BITS of each."""
    shared = texts.sparkSession.sparkContext.broadcast(passed)  # tables of fixed sizes

    bits = min((RANGES * texts.rdd.getNumPartitions() - 1).bit_length(), 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], 0
        for batch, words, _ in _texts(batches):
            shard = batch.column("shard")[0].as_py()  # one for all of a task
            for size in sizes:
                _, keys, n = words.counted(shared.value.places(words, size), size)
                held.append((keys & np.uint64((1 << KEY_BITS) - 1), np.minimum(n, SUPPORT)))
            if sum(len(keys) for keys, _ in held) > HELD_KEYS:
                held = [_added(held)]
                if len(held[0][0]) > HELD_KEYS // 2:
                    yield _blocks(*held.pop(), bits, shard)
        if held:
            yield _blocks(*_added(held), bits, shard)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, parts, waiting = [], [], 0
        for batch in batches:
            for shard, block in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist(), strict=True):
                keys, n = _unpacked(block)
                side = np.zeros((len(n), SHARDS), np.int64)
                side[:, shard] = n
                parts.append((keys, side))
                waiting += len(keys)
                if waiting > max(HELD_KEYS // 4, sum(len(keys) for keys, _ in whole)):
                    whole, parts, waiting = [_added(whole + parts)], [], 0
        keys, n = _added(whole + parts)
        keys = keys[(n.max(1, initial=0) >= -(-SUPPORT // SHARDS)) & (n.sum(1) >= SUPPORT)]
        yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64)})

    return texts.mapInArrow(count, "range int, shard int, block binary").groupBy("range").applyInArrow(merge, "key long")


def phrase_counts(texts: DataFrame, passed: Passed) -> DataFrame:
    """(lang, phrase, size, a): words and phrases with at least SUPPORT occurrences, counted by their words, and for each language all its words together as size 0."""
    shared = texts.sparkSession.sparkContext.broadcast(passed)  # tables of fixed sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, known in _texts(batches):
            every = np.bincount(words.langs, minlength=len(known))
            yield pa.RecordBatch.from_pydict({"lang": pa.array(known, pa.string()), "phrase": pa.array([""] * len(known), pa.string()), "size": pa.array([0] * len(known), pa.int32()), "n": pa.array(every, pa.int64())})
            for size in range(1, LONGEST + 1):
                at, _, n = words.counted(shared.value.places(words, size), size)
                yield pa.RecordBatch.from_pydict({"lang": _named(known, words, at), "phrase": words.phrases(at, size), "size": pa.array(np.full(len(at), size), pa.int32()), "n": pa.array(n, pa.int64())})

    counts = texts.mapInArrow(run, "lang string, phrase string, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a"))
    return counts.where((F.col("size") == 0) | (F.col("a") >= SUPPORT))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of the phrases of two words or more at their lowest-scoring cut; ``counts`` has their parts too."""
    known = counts.where("size > 0").select("lang", "phrase", F.col("a").alias("f"))
    cuts = counts.where("size > 1").select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - size)")})
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def _contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, longest): phrases inside longer ones, with the highest count of those."""
    w = F.split("phrase", " ")

    def inner(size: int) -> Column:
        return F.array(*(F.array_join(F.slice(w, start, n), " ") for n in range(2, size) for start in range(1, size - n + 2)))

    subs = F.when(F.col("size") == 3, inner(3)).when(F.col("size") == 4, inner(4))
    rows = phrases.where("size > 2").select("lang", F.explode(F.array_distinct(subs)).alias("phrase"), "a")
    return rows.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first TOP phrases of each language of ``docs`` (lang, text).

    A null language is ``und``; a null, empty or wordless text adds nothing;
    repeated rows count each; other columns play no part. Equal scores go by
    count, then by the phrase's bytes.
    """
    shard = (F.spark_partition_id() % SHARDS).cast("int")
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").withColumn("shard", shard)
    words = Passed(Bits.of(mined(texts, (1,), Passed()), WORD_BITS))
    pairs = replace(words, pairs=Bits.of(mined(texts, (2,), words), PHRASE_BITS))
    passed = replace(pairs, longer=Bits.of(mined(texts, tuple(range(3, LONGEST + 1)), pairs), PHRASE_BITS))
    counts = stage(phrase_counts(texts, passed), "phrases")
    totals = counts.where("size = 0").select("lang", F.col("a").alias("n"))
    hidden = F.expr(f"100 * cast(longest as decimal(19,0)) >= {PERCENT_INSIDE} * cast(a as decimal(19,0))")
    left = scored(counts).join(_contained(counts), ["lang", "phrase"], "left").where(~F.coalesce(hidden, F.lit(False)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    first = left.withColumn("g", group).withColumn("place", F.row_number().over(Window.partitionBy("lang", "g").orderBy(*order))).where(F.col("place") <= TOP)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= TOP)  # of RANK_GROUPS * TOP rows at most
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
