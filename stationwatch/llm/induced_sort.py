"""External induced suffix sorting of one shard.

Suffixes are sorted by induction from their leftmost-S suffixes, recursively
over the string of substring names. The queues of an induction pass hold suffix
tuples by leading symbol and arrival; they keep their newest blocks in memory
and put the rest on disk in the task's own temporary folder, so a pass needs
memory for the text but not for the order of its suffixes.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

from .common import prefix_hash, span_hash

#: Suffix tuples of one queue held in memory; 8 bytes each.
IN_MEMORY = 8_000_000
#: Reduced strings with more symbols than this are ranked by doubling, not by one more induction.
LARGEST_ALPHABET = 4096


class TupleQueue:
    """A monotone priority queue of suffix positions: first by symbol, then first in, first out; blocks beyond ``IN_MEMORY`` go to disk."""

    def __init__(self, in_memory: int = IN_MEMORY):
        self.blocks: dict[int, list] = defaultdict(list)
        self.free, self.file, self.end = in_memory, None, 0

    def push(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, positions = symbols[order], positions[order]
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for symbol, block in zip(symbols[np.concatenate([[0], cuts])], np.split(positions, cuts), strict=True):
            self.append(int(symbol), block)

    def append(self, symbol: int, block: np.ndarray) -> None:
        if len(block) <= self.free:
            self.free -= len(block)
            self.blocks[symbol].append(block)
            return
        self.file = self.file or tempfile.TemporaryFile(prefix="suffixes-")
        self.file.seek(self.end)
        self.file.write(block.tobytes())
        self.blocks[symbol].append((self.end, len(block)))
        self.end += block.nbytes

    def pop(self, symbol: int) -> np.ndarray | None:
        """All positions queued for a symbol, in order of arrival; None if there are none."""
        blocks = self.blocks.pop(symbol, None)
        if blocks is None:
            return None
        out = []
        for block in blocks:
            if isinstance(block, tuple):
                self.file.seek(block[0])
                block = np.frombuffer(self.file.read(block[1] * 8), np.int64)
            else:
                self.free += len(block)
            out.append(block)
        return out[0] if len(out) == 1 else np.concatenate(out)


def _s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last one, the sentinel, is S."""
    rises = np.ones(len(text), bool)
    differs = np.flatnonzero(text[1:] != text[:-1])
    rises[differs] = text[differs] < text[differs + 1]
    decides = np.full(len(text), len(text) - 1)
    decides[differs] = differs
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    return rises[decides]


def _induce(text: np.ndarray, s_type: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, given the leftmost-S suffixes in order within each leading symbol."""
    seeds = TupleQueue()
    seeds.push(text[leftmost], leftmost)
    queue, falling, rising = TupleQueue(), TupleQueue(), TupleQueue()

    def before(block: np.ndarray, wanted: bool) -> np.ndarray:
        block = block[block > 0] - 1
        return block[s_type[block] == wanted]

    seen = {}
    for symbol in range(symbols):
        while (block := queue.pop(symbol)) is not None:
            falling.append(symbol, block)
            previous = before(block, False)
            queue.push(text[previous], previous)
        if (block := seeds.pop(symbol)) is not None:
            previous = before(block, False)
            queue.push(text[previous], previous)
    queue = TupleQueue()
    for symbol in range(symbols - 1, -1, -1):
        while (block := queue.pop(symbol)) is not None:
            rising.append(symbol, block)
            previous = before(block, True)
            queue.push(text[previous], previous)
        if (block := falling.pop(symbol)) is not None:
            seen[symbol] = block
            previous = before(block[::-1], True)
            queue.push(text[previous], previous)
    out = [np.array([len(text) - 1])]
    for symbol in range(symbols):
        if symbol in seen:
            out.append(seen[symbol])
        if (block := rising.pop(symbol)) is not None:
            out.append(block[::-1])
    return np.concatenate(out)


def _rank_by_doubling(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string in order, by ranks of twice the length each time."""
    rank, n, step = names.astype(np.int64), len(names), 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1
        key = rank * (int(ahead.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, 2 * step


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of the suffixes of ``text`` in order. Its last symbol is 0 and no other is."""
    if len(text) < 3:
        return np.arange(len(text))[::-1].copy()
    s_type = _s_types(text)
    leftmost = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(leftmost) < 2:
        return _induce(text, s_type, leftmost, symbols)
    order = _induce(text, s_type, leftmost, symbols)
    is_leftmost = np.zeros(len(text), bool)
    is_leftmost[leftmost] = True
    order = order[is_leftmost[order]]
    ends = np.empty(len(text), np.int64)
    ends[leftmost] = np.concatenate([leftmost[1:] + 1, [len(text)]])
    prefix = prefix_hash(text.astype(np.uint8)) if symbols <= 256 else None
    if prefix is None:
        prefix = np.zeros(len(text) + 1, np.uint64)
        from .common import mix, powers

        np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * powers(len(text)), dtype=np.uint64, out=prefix[1:])
    content = span_hash(prefix, order, ends[order])
    length = ends[order] - order
    new_name = np.concatenate([[0], np.cumsum((content[1:] != content[:-1]) | (length[1:] != length[:-1]))])
    count = int(new_name[-1]) + 1
    if count < len(leftmost):
        name_at = np.empty(len(text), np.int64)
        name_at[order] = new_name
        names = name_at[leftmost]
        reduced = suffix_order(names, count) if count <= LARGEST_ALPHABET else _rank_by_doubling(names)
        order = leftmost[reduced]
    return _induce(text, s_type, order, symbols)


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, step: int = 1 << 14) -> np.ndarray:
    """Whether ``length`` bytes from a and from b are the same: bytes decide, hashes only choose whom to compare."""
    view = np.lib.stride_tricks.sliding_window_view(raw, length) if len(raw) >= length else np.zeros((0, length), np.uint8)
    return np.concatenate([np.zeros(0, bool), *((view[a[i : i + step]] == view[b[i : i + step]]).all(1) for i in range(0, len(a), step))])


def repeated_starts(rows: list[bytes], least: int) -> list[np.ndarray]:
    """For each row the positions of its substrings of ``least`` bytes that stand at another place of any row too."""
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.full(int(starts[-1]) + 1, 1, np.int16)
    valid = np.zeros(len(text), bool)
    raw = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    text[: len(raw)] = raw.astype(np.int16) + 2
    text[starts[1:] - 1] = 1  # between rows
    text[-1] = 0
    for start, size in zip(starts[:-1], sizes, strict=True):
        valid[start : start + max(0, size - least + 1)] = True
    order = suffix_order(text, 258)
    order = order[valid[order]]
    prefix = prefix_hash(raw)
    content = span_hash(prefix, order, order + least)
    same = np.flatnonzero(content[1:] == content[:-1])  # the common prefix of neighbours seems to reach ``least``
    same = same[_equal(raw, order[same], order[same + 1], least)]
    repeated = np.zeros(len(text), bool)
    repeated[order[same + 1]] = True
    repeated[order[same]] = True
    return [np.flatnonzero(repeated[start : start + size]) for start, size in zip(starts[:-1], sizes, strict=True)]
