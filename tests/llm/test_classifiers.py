"""Toxicity against its definition in plain Python; both classifiers on very long texts, repeated rows and ties."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stationwatch.llm import lang_id, toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def plain_tokens(text):
    return [m.encode() for m in re.findall(r"[0-9a-z\u0080-\U0010FFFF]+", (text or "").lower())]


def plain_odds(rows):
    """Significant tokens and their log-odds from (text, toxic) rows, by the formulas as they stand in the literature."""
    y = {0: Counter(), 1: Counter()}
    for text, toxic in rows:
        y[toxic].update(set(plain_tokens(text)))
    n = {k: sum(c.values()) for k, c in y.items()}
    out = {}
    for token in y[1]:
        prior = toxicity.PRIOR_WEIGHT * (y[1][token] + y[0][token]) / (n[1] + n[0]) + toxicity.LEAST_PRIOR
        logit = [math.log((y[k][token] + prior) / (n[k] + toxicity.PRIOR_WEIGHT - y[k][token] - prior)) for k in (0, 1)]
        odds = logit[1] - logit[0]
        z = odds / math.sqrt(1 / (y[1][token] + prior) + 1 / (y[0][token] + prior))
        if z >= toxicity.LEAST_Z and odds >= toxicity.LEAST_ODDS:
            out[token] = odds
    return out


def plain_segments(gains):
    """The best segment, the shortest of equals, then those to its left and right, as maximal segments are defined."""
    best = max(((sum(gains[a : b + 1]), a - b, a, b) for a in range(len(gains)) for b in range(a, len(gains))), default=(0,))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return plain_segments(gains[:a]) + [best[0]] + plain_segments(gains[b + 1 :])


def hash_of(token):
    return int(toxicity.tokens(pa.array([token.decode()]))[0][0])


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(12)
    rows = []
    for i in range(360):
        w = [rng.choice("la le lo ÉTÉ lu Da di do x1 du".split()) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.choice([1, 2, 5]) if i % 3 == 0 else i % 23 == 0):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["Grunk", "slorp", "BLECH", "ñack"]))
        rows.append((i, rng.choice([" ", ", ", "--"]).join(w), int(i % 3 == 0)))
    return rows


def test_toxicity_matches_its_definition(spark, spoken):
    docs = spark.createDataFrame([(i, t) for i, t, _ in spoken], "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in spoken], "doc_id long, toxic int"))
    odds = plain_odds([(t, y) for i, t, y in spoken if not held_out(i)])
    assert dict(zip(model.hashes.tolist(), model.gains.tolist(), strict=True)) == pytest.approx({hash_of(t): g for t, g in odds.items()}) and len(odds) == 4
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for i, text, _ in spoken:
        words = plain_tokens(text)
        parts = plain_segments([odds.get(w, toxicity.FILLER) for w in words])
        x = [0.0] * 4
        if parts:
            chance = -math.log(max(model.size * len(words) * math.exp(-model.rate * max(parts)), 1e-30))
            x = [1.0, max(chance, -5.0), math.log1p(max(parts)), math.log1p(sum(parts))]
        wanted = 1 / (1 + math.exp(-(float(np.dot(x, model.weights[:-1])) + model.weights[-1])))
        assert found[i].score == pytest.approx(wanted, abs=1e-9) and found[i].held_out == held_out(i)


def test_toxic_passages_of_very_long_texts_and_repeated_rows(spark, spoken):
    labels = spark.createDataFrame([(i, y) for i, _, y in spoken], "doc_id long, toxic int")
    clean, passage = "la le lo du " * 120_000, "grunk slorp blech grunk slorp blech grunk slorp"
    more = [(1000, clean + passage + " " + clean), (1001, clean), (1002, passage), (1002, passage), (1003, passage)]
    rows = [(i, t) for i, t, _ in spoken] + more
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).where("doc_id >= 1000").collect()
    assert sorted(r.doc_id for r in found) == [1000, 1001, 1002, 1002, 1003]
    long, quiet = (next(r for r in found if r.doc_id == i) for i in (1000, 1001))
    assert [(p.start, p.end) for p in long.passages] == [(len(clean), len(clean) + len(passage))]
    assert quiet.passages == [] and quiet.score < 0.3 <= long.score
    assert len({r.score for r in found if r.doc_id >= 1002}) == 1  # equal texts, one score


def test_languages_of_very_long_texts_repeated_rows_and_ties(spark):
    rng = random.Random(3)
    tongues = {"en": "the and of to in that is".split(), "de": "der die und in den von zu".split(), "fr": "le la et les des en un".split()}
    rows = [(i, " ".join(rng.choice(tongues[lang]) for _ in range(40)), lang) for i, lang in enumerate(rng.choices(list(tongues), k=180))]
    whole = " ".join(rng.choice(tongues["fr"]) for _ in range(400_000))
    digits = "1 " * 600_000
    more = [(1000, whole, None), (1001, digits + "le la et les des en un la et les", None), (1002, digits, None), (1003, rows[0][1], None), (1003, rows[0][1], None), (1004, "qqq", None), (1005, "qqq", None)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string").repartition(3)
    found = [r for r in lang_id.identify(docs).collect() if r.doc_id >= 1000]
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(more) and all(0 <= r.score <= 1 for r in found)
    assert by_id[1000].lang_pred == by_id[1001].lang_pred == "fr" and by_id[1002].lang_pred == "und"  # letters behind a megabyte without any count
    assert len({(r.lang_pred, r.score) for r in found if r.doc_id == 1003}) == 1 and by_id[1003].lang_pred == rows[0][2]
    assert by_id[1004].lang_pred == by_id[1005].lang_pred and by_id[1004].lang_pred in tongues  # nothing speaks for any: the same one each time
