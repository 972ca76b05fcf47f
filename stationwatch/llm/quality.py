"""Quality rules: how much of a document repeats itself, by its suffix array.

The words of a document are sorted as suffixes by doubling: each round ranks
twice the length, and only suffixes that are still tied take part. The ranks of
all rounds give the common prefix of two neighbours in the order. Intervals of
neighbours with a common prefix are the repeated substrings; those that neither
more words on the right nor on the left would share are maximal. Their spans are
united, and a document is turned down if too many of its words lie in one or if
one of them is too long. Beside that stand plain counts: symbols, repeated
lines, words in windows of eight that occur again.

Many documents are sorted at once: a word counts as another one in each
document, so no prefix is common to two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, word_bounds, word_codes

#: The base rules: words of a window, fewest words, percent of words in repeated windows.
WINDOW, LEAST_WORDS, WINDOW_PERCENT = 8, 20, 30
#: The method's rules: words of a repeat that counts, percent of words in such, words of the longest one.
REPEAT, COVERED_PERCENT, LONGEST = 4, 50, 200

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_LINE_END = np.zeros(256, bool)
_LINE_END[0x0A] = True
_REPEAT_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of the suffixes of ``symbols`` (whole numbers), and their ranks by the first 1, 2, 4, ... symbols as far as there were ties.

    A suffix that ends is smaller than one that goes on. Equal ranks are equal prefixes of that length.
    """
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    rank = np.searchsorted(rank[order], rank).astype(np.int64)  # the place of the first of equals
    levels, step = [rank], 1
    while True:
        placed = rank[order]
        tied = np.zeros(n, bool)
        same = placed[1:] == placed[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at) or step >= n:
            return order, levels
        rows = order[at]
        ahead = np.where(rows + step < n, rank[np.minimum(rows + step, n - 1)] + 1, 0)
        again = np.lexsort((ahead, rank[rows]))
        rows, ahead = rows[again], ahead[again]
        order = order.copy()
        order[at] = rows
        own = rank[rows]
        opens = np.concatenate([[True], (own[1:] != own[:-1]) | (ahead[1:] != ahead[:-1])])
        rank = rank.copy()
        rank[rows] = at[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]
        levels.append(rank)
        step *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each place of the order but the first the length of the common prefix with its neighbour before; 0 at the first."""
    n = len(order)
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1 if n else np.zeros(0, np.int64)
    a, b = order[at - 1].copy(), order[at].copy()
    total = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        equal = inside.copy()
        equal[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        total[equal] += 1 << k
        a[equal] += 1 << k
        b[equal] += 1 << k
    out[at] = total
    return out


def maximal_repeats(symbols: np.ndarray, order: np.ndarray, prefixes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of each maximal repeated substring of ``least`` symbols or more: its occurrences are order[first : last + 1].

    An interval of neighbours with a common prefix goes as far as no shorter one
    comes between; it is maximal unless the same symbol stands before all.
    """
    before = np.where(order > 0, symbols[np.maximum(order, 1) - 1], -1)
    changes = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))]) if len(order) else np.zeros(0, np.int64)
    out, open_ = [], []
    where = np.flatnonzero(prefixes >= least)
    lengths = prefixes[where].tolist()
    last = -2

    def close(down_to: int, end: int) -> int:
        first = end
        while open_ and open_[-1][0] > down_to:
            length, first = open_.pop()
            if changes[end] > changes[first]:
                out.append((length, first, end))
        return first

    for place, length in zip(where.tolist(), lengths, strict=True):
        if place != last + 1:
            close(0, last)
        first = close(length, place - 1) if open_ and open_[-1][0] > length else place - 1
        if not open_ or open_[-1][0] < length:
            open_.append((length, first))
        last = place
    close(0, last)
    return out


def _deepest(intervals: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """For each of n places the length of the longest repeat whose interval holds it, or 0. Intervals are nested or apart, and inner ones are longer."""
    places, lengths, open_ = [0], [0], []

    def leave(before: int) -> None:
        while open_ and open_[-1][1] < before:
            places.append(open_.pop()[1] + 1)
            lengths.append(open_[-1][0] if open_ else 0)

    for length, first, last in sorted(intervals, key=lambda i: (i[1], -i[2])):
        leave(first)
        open_.append((length, last))
        places.append(first)
        lengths.append(length)
    leave(n)
    changes = np.full(n + 1, -1)
    changes[places] = np.arange(len(places))  # the last of several at one place holds
    return np.array(lengths)[np.maximum.accumulate(changes[:n])]


def _united(starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as spans that neither touch nor overlap within a text; ``row`` has the text of each word."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    opens = np.concatenate([[True], (starts[1:] > ends[:-1]) | (row[starts[1:]] != row[starts[:-1]])])
    return starts[opens], ends[np.concatenate([np.flatnonzero(opens)[1:] - 1, [len(ends) - 1]])]


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Running count of the words, of n, that lie in some span."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.concatenate([[0], np.cumsum(np.cumsum(edges)[:n] > 0)])


def measure(data: np.ndarray, offsets: np.ndarray, repeat: int = REPEAT) -> dict[str, np.ndarray | list]:
    """The measures of each text: counts, the united spans of its maximal repeats (in words) and the longest of those."""
    rows = len(offsets) - 1
    starts, stops, bounds = word_bounds(data, offsets, _SEPARATOR)
    n, n_words = len(starts), np.diff(bounds)
    row = np.repeat(np.arange(rows), n_words)
    codes, _ = word_codes(data, starts, stops)
    symbols = row * (int(codes.max()) + 1 if n else 1) + codes
    order, levels = suffix_array(symbols) if n else (np.zeros(0, np.int64), [np.zeros(0, np.int64)])
    prefixes = common_prefixes(order, levels)
    shared = np.maximum(prefixes, np.concatenate([prefixes[1:], [0]])) if n else prefixes
    windows = np.sort(order[shared >= WINDOW])
    in_windows = _covered(windows, windows + WINDOW, n)
    # maximal repeats
    found = maximal_repeats(symbols, order, prefixes, repeat)
    longest = np.zeros(rows, np.int64)
    if found:
        length, first, _ = (np.array(x) for x in zip(*found, strict=True))
        np.maximum.at(longest, row[order[first]], length)
        reach = np.zeros(n, np.int64)
        reach[order] = _deepest(found, n)
        at = np.flatnonzero(reach)
        spans = _united(at, at + reach[at], row)
    else:
        spans = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    in_repeats = _covered(*spans, n)
    each = lambda running: running[bounds[1:]] - running[bounds[:-1]]
    cuts = np.searchsorted(spans[0], bounds)
    repeats = [
        [{"start": int(a), "end": int(b)} for a, b in zip(spans[0][i:j] - bounds[k], spans[1][i:j] - bounds[k], strict=True)] for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    running = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    by_text = lambda flags: (r := running(flags))[offsets[1:]] - r[offsets[:-1]]
    return {
        "n_words": n_words, "word_chars": by_text(~_SEPARATOR[data] & ((data & 0xC0) != 0x80)), "n_symbols": by_text(_SYMBOL[data]), "n_dup_lines": _repeated_lines(data, offsets),
        "n_repeat_words": each(in_windows), "n_covered_words": each(in_repeats), "longest_repeat": longest, "repeats": repeats}


def _repeated_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    rows = len(offsets) - 1
    starts, stops, bounds = word_bounds(data, offsets, _LINE_END)  # lines without a byte have no word
    worded = np.concatenate([[0], np.cumsum(~_SEPARATOR[data])])
    full = worded[stops] > worded[starts]
    row = np.repeat(np.arange(rows), np.diff(bounds))[full]
    codes, _ = word_codes(data, starts[full], stops[full])
    key = row * (int(codes.max()) + 1 if len(codes) else 1) + codes
    _, first = np.unique(key, return_index=True)
    return np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def assess(docs: DataFrame, covered_percent: int = COVERED_PERCENT, longest: int = LONGEST, repeat: int = REPEAT) -> DataFrame:
    """Every row of ``docs`` with counts, ``repeats array<struct<start, end>>`` (united spans of maximal repeats, in words), ``base_failed`` and ``kept``.

    A document is kept if it passes the base rules, at most ``covered_percent`` of
    its words lie in maximal repeats of ``repeat`` words or more, and the longest
    of these has at most ``longest`` words. A null text is empty, and has too few
    words. Each row is judged by itself: ids, other documents and other columns
    play no part; columns named like the results are replaced. Memory grows with
    the longest text, not with their number.
    """
    results = (*_COUNTS, "repeats")
    keep = [c for c in docs.columns if c not in (*results, "base_failed", "kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            found = measure(data, offsets, repeat)
            yield pa.RecordBatch.from_pydict(
                {c: batch.column(c) for c in keep} | {c: pa.array(found[c], pa.int64()) for c in _COUNTS} | {"repeats": pa.array(found["repeats"], _REPEAT_TYPE)})

    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    schema = docs.select(*keep, *(F.lit(0).cast("long").alias(c) for c in _COUNTS), empty.alias("repeats")).schema
    found = docs.select(*keep).mapInArrow(run, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * WINDOW_PERCENT)
    passed = (F.col("n_covered_words") * 100 <= F.col("n_words") * covered_percent) & (F.col("longest_repeat") <= longest)
    return found.withColumns({"base_failed": failed, "kept": ~failed & passed})
