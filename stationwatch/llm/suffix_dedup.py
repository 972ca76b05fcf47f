"""Removal of repeated passages: every byte covered by a LEAST-byte string that also starts elsewhere goes.

All substrings of LEAST bytes are dealt into shards by their minimiser, the
lowest hash of a GRAM-byte gram in them: equal substrings have the same one at
the same place. Neighbouring substrings with one minimiser travel as one run of
text, about two runs in LEAST bytes. Equal runs, told by BLAKE2 of their bytes,
become one class that repeats throughout. Unequal runs with a common gram can
only share LEAST bytes if they also share the SIDE bytes before it or the SIDE
bytes behind it, for a string of LEAST bytes around a gram holds one of the two.
So a gram, however common, falls apart into groups by what stands beside it;
runs that are alone in theirs go no further. The texts of the others are cut
into shards of whole groups and given to external induced suffix sorting, whose
neighbours with a common prefix of LEAST bytes are the repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, prefix_hash, slices, span_hash, stage, _INVERSE
from .induced_sort import repeated_starts

LEAST, GRAM = 400, 16
SIDE = (LEAST - GRAM) // 2
#: A shard takes whole groups until it holds so many bytes.
SHARD_BYTES = 2 << 20
#: Longer texts are read in pieces that overlap by LEAST - 1 bytes.
PIECE = 4 << 20
#: Keys of texts are broadcast up to this count (some 100 bytes each as a hash table).
BROADCAST_KEYS = 200_000

_SPANS = "array<struct<start: long, end: long>>"
_PLACE_BITS = np.uint64(24)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by running minima forwards and backwards in blocks of ``width``."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of substring starts with one minimiser: row, first start within the row, bytes of the run's text, gram hash, the halves of the text's
    digest, hashes of the SIDE bytes before and behind the gram (0 where the run has fewer).

    Gram and sides only choose which runs are compared. The digest alone says that two runs are equal, so no structure of the text may survive in it.
    """
    none = (np.zeros(0, np.int64),) * 8
    if len(data) < LEAST:
        return none
    prefix = prefix_hash(data)
    n_grams = len(data) - GRAM + 1
    grams = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(n_grams, _INVERSE))
    keyed = (mix(grams) >> _PLACE_BITS << _PLACE_BITS) | np.arange(n_grams, dtype=np.uint64)
    least = (_window_minima(keyed, LEAST - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.arange(len(least))
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + LEAST <= offsets[row + 1]
    starts, row, least = starts[inside], row[inside], least[inside]
    if not len(starts):
        return none
    opens = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([opens[1:], [len(starts)]]) - 1
    first, end = starts[opens], starts[last] + LEAST
    raw = memoryview(np.ascontiguousarray(data))
    digests = b"".join(blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist(), strict=True))
    c1, c2 = np.frombuffer(digests, np.int64).reshape(-1, 2).T
    at = least[opens]
    before = np.where(at - SIDE >= first, span_hash(prefix, np.maximum(at - SIDE, 0), at) | np.uint64(1), np.uint64(0))
    behind = np.where(at + GRAM + SIDE <= end, span_hash(prefix, at + GRAM, np.minimum(at + GRAM + SIDE, len(data))) | np.uint64(1), np.uint64(0))
    return row[opens], first - offsets[row[opens]], end - first, grams[at].view(np.int64), c1, c2, before.view(np.int64), behind.view(np.int64)


def _keys() -> list[Column]:
    """Two 64-bit hashes of a text's SHA-256 stand for it (xxhash64 of the text itself has pairs that are equal under any seed); spans are a matter of texts, not of ids."""
    digest = F.sha2("text", 256)
    return [F.xxhash64(digest).alias("t1"), F.xxhash64(F.lit(7), digest).alias("t2")]


def _all_runs(texts: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
            for at in range(0, max(len(data) - LEAST + 1, 1), PIECE):  # one piece unless one text is very long
                piece = data[at : at + PIECE + LEAST - 1]
                row, first, size, gram, c1, c2, before, behind = runs(piece, np.clip(offsets - at, 0, len(piece)))
                inner = first + np.maximum(at - offsets[row], 0)
                yield pa.RecordBatch.from_pydict({
                    "t1": t1[row], "t2": t2[row], "first": inner, "size": size.astype(np.int32), "gram": gram, "c1": c1, "c2": c2, "before": before, "behind": behind})

    return texts.mapInArrow(find, "t1 long, t2 long, first long, size int, gram long, c1 long, c2 long, before long, behind long")


def _compare(run_texts: DataFrame) -> DataFrame:
    """(c1, c2, spans) of the runs with repeated substrings, by induced sorting of shards that arrive sorted by side and group.

    A run is in at most one group of each side, and no shard holds both sides, so none meets itself.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held, last = [], [], 0, None

        def result() -> pa.RecordBatch:
            spans = []
            for starts in repeated_starts(texts, LEAST):
                cuts = np.flatnonzero(np.diff(starts) > LEAST)
                spans.append([{"start": int(a), "end": int(b) + LEAST} for a, b in zip(
                    starts[np.concatenate([[0], cuts + 1])], starts[np.concatenate([cuts, [len(starts) - 1]])], strict=True)] if len(starts) else [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_pydict({"c1": pa.array([k[0] for k in keys], pa.int64()), "c2": pa.array([k[1] for k in keys], pa.int64()), "spans": pa.array(spans, kind)})

        for batch in batches:
            for side, gram, key, c1, c2, text in zip(*(batch.column(c).to_pylist() for c in ("side", "gram", "key", "c1", "c2", "body")), strict=True):
                if last is not None and (side != last[0] or held >= SHARD_BYTES and (side, gram, key) != last):
                    yield result()
                    keys, texts, held = [], [], 0
                last = side, gram, key
                keys.append((c1, c2))
                texts.append(text)
                held += len(text)
        if texts:
            yield result()

    return run_texts.repartition("side", "gram", "key").sortWithinPartitions("side", "gram", "key", "c1", "c2").mapInArrow(shards, f"c1 long, c2 long, spans {_SPANS}")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(t1, t2, spans) of every text with repeats, spans in bytes, not yet merged."""
    texts = docs.where(F.col("text").isNotNull()).select("text", *_keys())
    found = stage(_all_runs(texts), "runs")
    classes = found.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "first", "size", "gram", "before", "behind")).alias("at"))
    classes = stage(classes, "classes")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("at.before").alias("key")), F.struct(F.lit(1).alias("side"), F.col("at.behind").alias("key"))))
    placed = classes.select("c1", "c2", "at", "at.gram", sides.alias("s")).select("c1", "c2", "at", "gram", "s.side", "s.key").where("key <> 0")
    groups = placed.groupBy("gram", "side", "key").agg(F.count("*").alias("members")).where("members > 1").select("gram", "side", "key")
    unequal = placed.join(groups, ["gram", "side", "key"]).select("at.t1", "at.t2", "at.first", "at.size", "gram", "c1", "c2", "side", "key")
    wanted = stage(unequal.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "size", "gram", "c1", "c2", "side", "key")).alias("cuts")), "wanted")
    keys = wanted.select("t1", "t2")
    few = keys.count() <= BROADCAST_KEYS
    holders = texts.join(F.broadcast(keys) if few else keys, ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                raw = text.encode()
                yield pa.RecordBatch.from_pydict({
                    "side": pa.array([c["side"] for c in cuts], pa.int32()), **{k: pa.array([c[k] for c in cuts], pa.int64()) for k in ("gram", "key", "c1", "c2")},
                    "body": pa.array([raw[c["first"] : c["first"] + c["size"]] for c in cuts], pa.binary()),
                })

    bodies = holders.join(wanted, ["t1", "t2"]).mapInArrow(cut, "side int, gram long, key long, c1 long, c2 long, body binary")
    compared = _compare(bodies).where(F.size("spans") > 0)
    whole = classes.where("n > 1").select("c1", "c2", F.lit(True).alias("whole"))
    repeats = whole.join(compared, ["c1", "c2"], "full_outer")
    here = F.when(F.col("whole"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end")))).otherwise(F.col("spans"))
    spans = F.transform(here, lambda s: F.struct((s["start"] + F.col("first")).alias("start"), (s["end"] + F.col("first")).alias("end")))
    placed = found.join(repeats, ["c1", "c2"]).select("t1", "t2", F.explode(spans).alias("span"))
    return placed.groupBy("t1", "t2").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``removed array<struct<start, end>>`` (maximal runs, in bytes) and ``kept binary``.

    The text is treated as UTF-8 bytes, so ``kept`` need not be valid UTF-8. A
    null text is empty. Ids play no part: a repeated row repeats all its
    substrings. Columns named like the results are replaced.
    """
    keep = [c for c in docs.columns if c not in ("removed", "kept")]
    rows = docs.select(F.struct(*keep).alias("row"), *_keys())
    joined = rows.join(repeated_spans(docs), ["t1", "t2"], "left").select("row", "spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for text, spans in zip(batch.column("row").field("text"), batch.column("spans").to_pylist(), strict=True):
                raw = text.as_py().encode() if text.is_valid else b""
                merged: list[list[int]] = []
                for s in sorted(spans or (), key=lambda s: s["start"]):
                    if merged and s["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s["end"])
                    else:
                        merged.append([s["start"], s["end"]])
                edges = [0, *(x for m in merged for x in m), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": a, "end": b} for a, b in merged])
            yield pa.RecordBatch.from_pydict({"row": batch.column("row")} | {"removed": pa.array(removed, span), "kept": pa.array(kept, pa.binary())})

    schema = joined.select("row", F.col("spans").alias("removed"), F.lit(b"").alias("kept")).schema
    return joined.mapInArrow(strip, schema).select("row.*", "removed", "kept")


def digest(stripped: DataFrame) -> DataFrame:
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return stripped.select(
        "doc_id", (lost + F.octet_length("kept")).alias("n_bytes"), lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
