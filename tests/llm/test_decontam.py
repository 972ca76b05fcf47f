"""Decontamination against a plain alignment of every window with every text, and of cases at the edges of blocks and lengths."""

import random

import numpy as np
import pytest

from stationwatch.llm import decontam


def words(rng, n, syllables):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


A, B = "ba be bi bo bu da de di do du".split(), "xa xe xi zo zu ka ke ki".split()


def folded(text):
    out = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.lower())
    return " ".join(out.split()).encode()


def plain_match(text, item):
    """Semi-global edit distance of every window of the item in the text."""
    t, m = np.frombuffer(folded(text), np.uint8), np.frombuffer(folded(item), np.uint8)
    if len(m) < decontam.LEAST_FUZZY:
        return len(m) > 0 and f" {folded(item).decode()} " in f" {folded(text).decode()} "
    length = min(len(m), decontam.WINDOW)
    edits = decontam.budget(length)[0]
    for start in range(len(m) - length + 1):
        cost, steps = np.zeros(len(t) + 1, int), np.arange(len(t) + 1)
        for c in m[start : start + length]:
            new = np.minimum(cost[:-1] + (t != c), cost[1:] + 1)
            cost = np.minimum.accumulate(np.concatenate([[cost[0] + 1], new]) - steps) + steps
        if cost.min() <= edits:
            return True
    return False


def test_matches_plain_alignment(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, words(rng, n, B)) for i, n in enumerate([30, 20, 12, 9, 60])] + [(5, "xa xe"), (6, "zz-top"), (4, "ki"), (7, None), (8, ""), (9, "?!"), (None, "xa")]
    rows = []
    for i in range(60):
        text, k = words(rng, 30, A), rng.randrange(5)
        quote = items[k][1]
        at = rng.randrange(max(1, len(quote) - 60))
        quote = list(quote[at : at + rng.choice([60, 95, 110, 130, 400])])
        for _ in range(rng.choice([0, 2, 5, 6, 7, 9])):
            quote[rng.randrange(len(quote))] = rng.choice("qwy ") + rng.choice(["", "", "v"])
        rows.append((i, f"{text}. {''.join(quote)} {words(rng, 10, A)}"))
    rows += [(70, "Xa, XE"), (71, "xaxe xa"), (72, "a zz top b"), (73, None), (74, ""), (75, "zztop"), (76, items[0][1]), (76, items[1][1])]
    wanted = [(d, tuple(sorted({i for i, item in items if i is not None and item and plain_match(text or "", item)}))) for d, text in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS block", "2 AS first")
    for size in (decontam.BLOCK_CHARS, 200):  # many blocks find the same
        monkeypatch.setattr(decontam, "BLOCK_CHARS", size)
        found = [(r.doc_id, tuple(r["items"])) for r in decontam.contamination(df, benchmark).collect()]
        assert sorted(found) == sorted(wanted)
    assert sum(len(x) for _, x in wanted) > 30


def test_long_items_and_texts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_CHARS", 1000)
    rng = random.Random(6)
    item = words(rng, 2000, B)
    cuts = [0, 905, 950, 1815, len(item) - 120]
    rows = [(i, f"{words(rng, 30, A)} {item[c : c + 120]} {words(rng, 30, A)}") for i, c in enumerate(cuts)] + [(9, words(rng, 300_000, A) + item[300:420])]
    found = {r.doc_id: r["items"] for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {**{i: [1] for i in range(len(cuts))}, 9: [1]}


@pytest.mark.parametrize("n", [70_000])
def test_many_items_in_one_block(n):
    """More items than the old key had room for."""
    texts = [f"{i:06d} is the number of this item here" for i in range(n)] + ["a very special sentence that stands nowhere else at all in here"]
    index = decontam.Index.of(list(range(n + 1)), texts)
    data = np.frombuffer(b"we say a very special sentence that stands nowhere else at all in here", np.uint8)
    assert (0, n) in {(r, int(index.ids[i])) for r, i in index.match(data, np.array([0, len(data)]))}
