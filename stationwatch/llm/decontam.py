"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are folded: lower case, all but letters, digits and
non-ASCII characters to single spaces. A window is any WINDOW bytes of an item.
A window that stands in a text with at most ``k`` edits shares at least
``m + 1 - (k + 1) q`` of its q-grams with it, all on diagonals at most ``k`` apart.
So shared q-grams are counted by item and overlapping diagonal bands; in bands
that reach the bound, windows are looked at one by one; those that reach it are
aligned within the band, best first, and decide by their edit distance. Items too
short for that must stand whole, between word borders.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, powers, prefix_hash, slices, span_hash, stage, utf8, _INVERSE

Q, WINDOW, EDITS = 10, 90, 6
#: Shorter items (folded bytes) must match exactly.
LEAST_FUZZY = 30
#: Bands of 16 diagonals, each over half of the next, hold any spread of up to 9.
BAND_BITS = 4
#: Items are indexed in blocks of about so many characters; each block is one pass over the texts. Longer items come in overlapping pieces.
BLOCK_CHARS, PIECE_CHARS = 4 << 20, 1 << 16
_FILTER_BITS = 22

_FOLD = np.full(256, 0x20, np.uint8)
for _first, _last, _to in ((0x30, 0x39, 0x30), (0x61, 0x7A, 0x61), (0x41, 0x5A, 0x61), (0x80, 0xFF, 0x80)):
    _FOLD[_first : _last + 1] = np.arange(_to, _to + _last - _first + 1)


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and offsets; no text begins with a space."""
    data = _FOLD[data]
    blank = data == 0x20
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    keep[first] = ~blank[first]
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    prefix = prefix_hash(data)
    return mix((prefix[Q:] - prefix[:-Q]) * powers(len(data) - Q + 1, _INVERSE))


def budget(length: int) -> tuple[int, int]:
    """The edits allowed to a window of this length (one in fifteen) and the q-grams it must then share."""
    edits = min(EDITS, length // 15)
    while edits and length + 1 - (edits + 1) * Q < 1:
        edits -= 1
    return edits, length + 1 - (edits + 1) * Q


@dataclass
class Index:
    """The q-grams of a block of items with where they stand."""

    ids: np.ndarray
    texts: list[np.ndarray]
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    mark: np.ndarray
    bound: np.ndarray
    exact: dict[int, dict[bytes, list[int]]]

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None]) -> Index:
        folded, offsets = fold(*utf8(pc.utf8_lower(pa.array(texts, pa.string()))))
        pieces = [folded[a:b][: b - a - 1] if b > a and folded[b - 1] == 0x20 else folded[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        exact: dict[int, dict[bytes, list[int]]] = {}
        for i, piece in enumerate(pieces):
            if 0 < len(piece) < LEAST_FUZZY:
                exact.setdefault(len(piece), {}).setdefault(piece.tobytes(), []).append(ids[i])
        rows = [i for i, piece in enumerate(pieces) if len(piece) >= LEAST_FUZZY]
        pieces = [pieces[i] for i in rows]
        hashes = [gram_hashes(p) for p in pieces]
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(pieces)), [len(h) for h in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        mark = np.zeros(1 << _FILTER_BITS, bool)
        mark[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        bound = np.array([budget(min(len(p), WINDOW))[1] for p in pieces], np.int64)
        return cls(np.array([ids[i] for i in rows], np.int64), pieces, grams, np.append(first, len(flat)), item[order], place[order], mark, bound, exact)

    def quoted(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text row, item id) of the short items that stand whole between word borders."""
        out: set[tuple[int, int]] = set()
        if not self.exact:
            return out
        blank = data == 0x20
        opens, closes = np.ones(len(data), bool), np.ones(len(data), bool)
        opens[1:], closes[:-1] = blank[:-1], blank[1:]
        filled = offsets[:-1] < offsets[1:]
        opens[offsets[:-1][filled]] = closes[offsets[1:][filled] - 1] = True
        prefix = prefix_hash(data)
        for size, items in self.exact.items():
            if len(data) < size:
                continue
            at = np.flatnonzero(opens[: len(data) - size + 1] & closes[size - 1 :])
            wanted = np.unique([span_hash(prefix_hash(np.frombuffer(x, np.uint8)), np.array([0]), np.array([size]))[0] for x in items])
            at = at[np.isin(span_hash(prefix, at, at + size), wanted)]
            row = np.searchsorted(offsets, at, "right") - 1
            for r, k in zip(row.tolist(), at.tolist(), strict=True):
                if k + size <= offsets[r + 1]:
                    out |= {(r, i) for i in items.get(data[k : k + size].tobytes(), ())}
        return out

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """text row, place in ``data``, item and place in the item of every shared q-gram."""
        hashes = gram_hashes(data)
        at = np.flatnonzero(self.mark[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        found = np.searchsorted(self.grams, hashes[at])
        same = found < len(self.grams)
        same[same] = self.grams[found[same]] == hashes[at[same]]
        at, found = at[same], found[same]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[row + 1]
        at, found, row = at[inside], found[inside], row[inside]
        times = self.first[found + 1] - self.first[found]
        which = np.repeat(self.first[found] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum())) if len(times) else np.zeros(0, np.int64)
        return np.repeat(row, times), np.repeat(at, times), self.item[which], self.place[which]

    def match(self, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text row, item) pairs of which some window is confirmed."""
        row, at, item, place = self.hits(data, offsets)
        out: set[tuple[int, int]] = set()
        if not len(row):
            return out
        diagonal = at - place + (1 << 24)
        rounds: list[list[tuple[tuple[int, int], int, int, int]]] = []  # (pair, start, length, first text place), each band's best windows first
        for shift in (0, 1):
            band = (diagonal + shift * (1 << (BAND_BITS - 1))) >> BAND_BITS
            key = (row.astype(np.int64) << 53) | (item.astype(np.int64) << 27) | band  # texts come in slices of up to 1024 rows
            order = np.argsort(key, kind="stable")
            key = key[order]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            counts = np.diff(cuts)
            for k in np.flatnonzero(counts >= self.bound[item[order[cuts[:-1]]]]):
                rows = order[cuts[k] : cuts[k + 1]]
                r, i, low = int(row[rows[0]]), int(item[rows[0]]), (int(band[rows[0]]) << BAND_BITS) - shift * (1 << (BAND_BITS - 1)) - (1 << 24)
                places = np.unique(place[rows])
                length = min(len(self.texts[i]), WINDOW)
                starts = np.arange(len(self.texts[i]) - length + 1)
                shared = np.searchsorted(places, starts + length - Q, "right") - np.searchsorted(places, starts)
                fits = np.flatnonzero(shared >= budget(length)[1] - EDITS)  # repeated grams count once here
                for rank, start in enumerate(starts[fits[np.argsort(-shared[fits], kind="stable")]].tolist()):
                    turn = rank.bit_length()
                    rounds += [[] for _ in range(turn + 1 - len(rounds))]
                    rounds[turn].append(((r, i), start, length, low + start))
        for jobs in rounds:
            out |= self._confirm([job for job in jobs if job[0] not in out], data, offsets)
        return out

    def _confirm(self, flat: list, data: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """Align each window with the text beside its band: offsets 0 .. width - 1 from the band's first diagonal less the edits."""
        out: set[tuple[int, int]] = set()
        width = (1 << BAND_BITS) + 2 * EDITS
        for length in sorted({job[2] for job in flat}):
            group = [job for job in flat if job[2] == length]
            edits = budget(length)[0]
            for i in range(0, len(group), 4096):
                part = group[i : i + 4096]
                pattern = np.stack([self.texts[pair[1]][start : start + length] for pair, start, _, _ in part])
                text = np.zeros((len(part), length + width), np.uint8)  # 0 stands in no folded text
                for k, ((r, _), _, _, low) in enumerate(part):
                    a, b = max(low - EDITS, offsets[r]), min(low - EDITS + length + width, offsets[r + 1])
                    if b > a:
                        text[k, a - (low - EDITS) : b - (low - EDITS)] = data[a:b]
                steps = np.arange(width, dtype=np.int32)
                cost = np.zeros((len(part), width), np.int32)
                for row in range(length):
                    skip = np.concatenate([cost[:, 1:] + 1, np.full((len(part), 1), 1 << 20, np.int32)], 1)
                    cost = np.minimum(cost + (text[:, row : row + width] != pattern[:, row : row + 1]), skip)
                    cost = np.minimum.accumulate(cost - steps, 1) + steps
                out |= {part[k][0] for k in np.flatnonzero(cost.min(1) <= edits)}
        return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``items array<long>``: the sorted ids of the benchmark items of which a window stands in its text.

    Items under LEAST_FUZZY folded bytes match where they stand whole between
    word borders. Null and empty items and null ids match nothing; a null or
    empty text has no items. Repeated rows are judged one by one; several items
    with one id count as one. A column named ``items`` is replaced. The benchmark
    is read in blocks; where there are several, the texts are staged after each.
    """
    word = F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), word.alias("text"))
    step = PIECE_CHARS - WINDOW  # so that every window is whole in some piece
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - WINDOW), F.lit(step)))
    items = items.withColumn("first", first).select("item_id", "first", F.expr(f"substring(text, first + 1, {PIECE_CHARS})").alias("text"))
    blocks = max(1, -(-items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // BLOCK_CHARS))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "first"), F.lit(blocks)))
    items = stage(items, "items") if blocks > 1 else items
    keep = [c for c in docs.columns if c != "items"]
    out = docs.select(*keep, F.array().cast("array<long>").alias("items"))
    for block in range(blocks):
        rows = items.where(F.col("block") == block).orderBy("item_id", "first", "text").toArrow()  # about BLOCK_CHARS, in pieces of PIECE_CHARS at most
        index = docs.sparkSession.sparkContext.broadcast(Index.of(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()))
        out = out.mapInArrow(_finder(index, keep), out.schema)
        if block < blocks - 1:
            out = stage(out, "block")
            index.destroy()
    return out


def _finder(index, keep: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text"):
            found: list[set[int]] = [set(x) for x in batch.column("items").to_pylist()]
            folded, places = fold(*utf8(pc.utf8_lower(batch.column("text"))))
            for row, item in index.value.match(folded, places):
                found[row].add(int(index.value.ids[item]))
            for row, item_id in index.value.quoted(folded, places):
                found[row].add(int(item_id))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"items": pa.array([sorted(f) for f in found], pa.list_(pa.int64()))})

    return find


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item stands, with their columns."""
    return contamination(docs, benchmark).where(F.size("items") == 0).select(*docs.columns)
