"""Toxic passages by maximum-scoring segment search.

Tokens that are significantly commoner in toxic training texts carry their
log-odds under an informative Dirichlet prior; every other token costs a little.
One linear scan finds all maximal scoring segments of a text. The chance of a
segment in clean text follows an extreme-value law whose parameters come from
clean training texts; segments beyond it are the significant passages. A text's
score is a logistic curve over that significance, fitted to the labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_is_held_out, may_learn_from, prefix_hash, slices, span_hash, stage, utf8, word_bounds

PRIOR_WEIGHT = 500.0
#: Added to each token's share of the prior, so that one that clean texts never show has a bounded variance.
LEAST_PRIOR = 0.5
LEAST_Z = 3.5
#: Tokens must also be this much likelier (log-odds): a common word of a language with more toxic text is no sign.
LEAST_ODDS = 1.5
#: One learnable document in so many is kept back from the tokens, to set the curves; at most SAMPLE of those.
KEPT_BACK, SAMPLE = 4, 100_000
FILLER = -0.12
SIGNIFICANT = 0.01
#: Labels are broadcast up to this count (some 120 bytes each as a hash table).
BROADCAST_LABELS = 200_000

_SEPARATOR = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _SEPARATOR[_first : _last + 1] = False


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends in lower-cased bytes of all texts' tokens (runs of letters, digits, non-ASCII), and the texts' offsets in them."""
    data, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    starts, ends, bounds = word_bounds(data, offsets, _SEPARATOR)
    return span_hash(prefix_hash(data), starts, ends), starts - offsets[np.searchsorted(bounds, np.arange(len(starts)), "right") - 1], ends - starts, bounds


def segments(at: np.ndarray, gain: np.ndarray, filler: float = FILLER) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) of a text whose tokens at ``at`` score ``gain`` and all others ``filler``.

    The scan keeps candidates with the cumulative score before and after each;
    a new one joins back to the last candidate that starts lower and ends lower.
    Each candidate knows the last one before it that starts lower, so the search
    jumps over those in between and the scan is linear.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, score before and after, candidate that starts lower
    total, previous = 0.0, -1
    for place, score in zip(at.tolist(), gain.tolist(), strict=True):
        total += filler * (place - previous - 1)
        first, low = place, total
        total, previous = total + score, place
        k = len(kept) - 1
        while k >= 0 and kept[k][2] >= low:
            k = kept[k][4]
        while k >= 0 and kept[k][3] < total:
            first, low, k, size = kept[k][0], kept[k][2], kept[k][4], k
            del kept[size:]
        kept.append((first, place, low, total, k))
    return [(first, last, high - low) for first, last, low, high, _ in kept]


@dataclass
class ToxicityModel:
    """Scored tokens by sorted hash, the extreme-value law's rate and size, and the logistic curve."""

    hashes: np.ndarray
    gains: np.ndarray
    rate: float = 1.0
    size: float = 1.0
    weights: np.ndarray | None = None

    def find(self, hashes: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, float]]]:
        where = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        hit = np.flatnonzero(self.hashes[where] == hashes) if len(self.hashes) else np.zeros(0, np.int64)
        edges = np.searchsorted(hit, bounds)
        out = []
        for first, a, b in zip(bounds[:-1], edges[:-1], edges[1:], strict=True):
            out.append(segments(hit[a:b] - first, self.gains[where[hit[a:b]]]) if b > a else [])
        return out

    def expected(self, score: float, length: int) -> float:
        """How many segments of this score clean text of this many tokens has on average."""
        return self.size * max(length, 1) * float(np.exp(-self.rate * score))

    def features(self, found: list[tuple[int, int, float]], length: int) -> list[float]:
        if not found:
            return [0.0, 0.0, 0.0, 0.0]
        best = max(s for _, _, s in found)
        chance = -np.log(max(self.expected(best, length), 1e-30))
        return [1.0, max(float(chance), -5.0), float(np.log1p(best)), float(np.log1p(sum(s for _, _, s in found)))]

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """draw, text, toxic, kept_back of the rows that may be learned from; a document with several labels is toxic if one says so."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(may_learn_from())
    few = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(known) if few else known, "doc_id")
    draw = F.xxhash64("doc_id")
    return rows.select(draw.alias("draw"), "text", F.col("toxic").cast("int").alias("toxic"), (F.pmod(draw, F.lit(KEPT_BACK)) == 0).alias("kept_back"))


def _counts(rows: DataFrame) -> DataFrame:
    """One row for each token: texts that hold it (d) and occurrences in clean ones (n), by label and over all rows and those not kept back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text"):
            hashes, _, _, bounds = tokens(batch.column("text"))
            if not len(hashes):
                continue
            kind = batch.column("toxic").to_numpy() * 2 + batch.column("kept_back").to_numpy(zero_copy_only=False)
            row = np.searchsorted(bounds, np.arange(len(hashes)), "right") - 1
            order = np.lexsort((row, kind[row], hashes))
            h, r = hashes[order], row[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (kind[r[1:]] != kind[r[:-1]])]))
            yield pa.RecordBatch.from_pydict({
                "token": h[first].view(np.int64), "toxic": pa.array(kind[r[first]] // 2, pa.int32()), "kept_back": pa.array(kind[r[first]] % 2 == 1),
                "n": pa.array(np.diff(np.append(first, len(h))), pa.int64()), "d": pa.array(np.add.reduceat(new.astype(np.int64), first), pa.int64())})

    found = rows.select("text", "toxic", "kept_back").mapInArrow(count, "token long, toxic int, kept_back boolean, n long, d long")
    some = lambda what, toxic, part: F.sum(F.when((F.col("toxic") == toxic) & (F.lit(part == "all") | ~F.col("kept_back")), F.col(what)).otherwise(0))
    return found.groupBy("token").agg(*(some("d", toxic, part).alias(f"{name}_{part}") for toxic, name in ((1, "toxic"), (0, "clean")) for part in ("all", "fit")),
                                      *(some("n", 0, part).alias(f"n_{part}") for part in ("all", "fit")))


def _tokens(counts: DataFrame, totals: dict[str, int], part: str) -> ToxicityModel:
    """The significant tokens of a part with their log-odds; texts count a token once, so none is significant by one text's repetitions."""
    y_toxic, y_clean, prior = F.col(f"toxic_{part}"), F.col(f"clean_{part}"), F.col("prior")
    n_toxic, n_clean = totals[f"toxic_{part}"], totals[f"clean_{part}"]
    if not n_toxic or not n_clean:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0))
    tested = counts.where(y_toxic > 0).withColumn("prior", PRIOR_WEIGHT * (y_toxic + y_clean) / (n_toxic + n_clean) + LEAST_PRIOR)
    share_of = lambda y, n: F.log((y + prior) / (n + PRIOR_WEIGHT - y - prior))
    tested = tested.withColumn("odds", share_of(y_toxic, n_toxic) - share_of(y_clean, n_clean))
    tested = tested.withColumn("z", F.col("odds") / F.sqrt(1 / (y_toxic + prior) + 1 / (y_clean + prior)))
    telling = tested.where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).select("token", "odds", F.col(f"n_{part}").alias("n")).toPandas()  # only the significant ones
    hashes = telling["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = ToxicityModel(hashes[order], telling["odds"].to_numpy(float)[order])
    # extreme values: the rate solves sum p exp(rate score) = 1 over clean tokens
    share = (telling["n"].to_numpy(float)[order] + 0.5) / max(totals[f"n_{part}"], 1)
    low, high = 1e-6, 10.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (share * np.exp(np.minimum(mid * model.gains, 50))).sum() + max(1 - share.sum(), 0) * np.exp(mid * FILLER) < 1 else (low, mid)
    model.rate = low
    return model


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from the labelled rows that may be learned from; without both labels every score is 0.

    Tokens come from all of these rows. The curves come from rows kept back
    (one document in KEPT_BACK), judged by tokens of the others only.
    """
    rows = _labelled(docs, labels)
    counts = stage(_counts(rows), "counts")
    names = [c for c in counts.columns if c != "token"]
    totals = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first().asDict()
    model, half = _tokens(counts, totals, "all"), _tokens(counts, totals, "fit")
    if not totals["toxic_all"] or not totals["clean_all"]:
        return model
    best = _best(rows.where("kept_back"), half)
    length, score, truth = best["length"].to_numpy(float), best["best"].to_numpy(float), best["toxic"].to_numpy(float)
    model.size = half.size = extreme_size(score[truth == 0], length[truth == 0], half.rate, float(half.gains.min()) if len(half.gains) else 1.0)
    x = np.array([half.features([(0, 0, b)] if b > 0 else [], int(n)) for b, n in zip(score, length, strict=True)]).reshape(-1, 4)
    x[:, 3] = np.where(score > 0, np.log1p(best["total"].to_numpy(float)), 0)
    model.weights = _logistic(x, truth)
    return model


def extreme_size(best: np.ndarray, length: np.ndarray, rate: float, least: float) -> float:
    """The likeliest size, given the best scores of clean texts; those without a segment are known to stay below ``least``."""
    there = length > 0
    reached = int((best[there] > 0).sum())
    exposure = float((length[there] * np.exp(-rate * np.where(best[there] > 0, best[there], least))).sum())
    return (reached + 0.5) / exposure if exposure > 0 else 1.0


def _best(rows: DataFrame, model: ToxicityModel) -> "pd.DataFrame":  # noqa: F821
    """length, best and total of the SAMPLE rows whose ids hash lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches, "text"):
            hashes, _, _, bounds = tokens(batch.column("text"))
            found = model.find(hashes, bounds)
            yield pa.RecordBatch.from_pydict({
                "draw": batch.column("draw"), "toxic": batch.column("toxic"), "length": pa.array(np.diff(bounds), pa.int64()),
                "best": pa.array([max((s for _, _, s in f), default=0.0) for f in found], pa.float64()), "total": pa.array([sum(s for _, _, s in f) for f in found], pa.float64()),
            })

    found = rows.select("draw", "toxic", "text").mapInArrow(run, "draw long, toxic int, length long, best double, total double")
    return found.orderBy("draw", "toxic", "length", "best", "total").limit(SAMPLE).toPandas()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and, last, the bias by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every row of ``docs`` with ``held_out``, ``score`` and ``passages array<struct<start, end, expected>>``.

    Passages are the significant ones, in bytes of the lower-cased text. Null and
    empty texts have none and the score of a text without findings; null ids
    count as not held out. Columns named like the results are replaced.
    """
    keep = [c for c in docs.columns if c not in ("held_out", "score", "passages")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the significant tokens, 16 bytes each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expected", pa.float64())]))
        for batch, _, _ in slices(batches, "text"):
            hashes, starts, sizes, bounds = tokens(batch.column("text"))
            found = fitted.find(hashes, bounds)
            x = np.array([fitted.features(f, int(n)) for f, n in zip(found, np.diff(bounds), strict=True)]).reshape(-1, 4)
            passages = [
                [{"start": int(starts[first + a]), "end": int(starts[first + b] + sizes[first + b]), "expected": e} for a, b, s in f if (e := fitted.expected(s, int(n))) <= SIGNIFICANT]
                for f, first, n in zip(found, bounds[:-1], np.diff(bounds), strict=True)
            ]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in [*keep, "held_out"]} | {
                "score": pa.array(fitted.probability(x), pa.float64()), "passages": pa.array(passages, kind)})

    narrowed = docs.select(*keep).withColumn("held_out", fold_is_held_out())
    empty = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0.0).alias("expected")))
    return narrowed.mapInArrow(run, narrowed.select("*", F.lit(0.0).alias("score"), empty.alias("passages")).schema)
