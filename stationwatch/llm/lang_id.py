"""Language identification in two levels.

A first set of linear support vector machines, one for each pair of language
families, votes for the family; a second set, one for each pair of languages
inside that family, separates the close relatives. Features are hashed byte
1-, 2- and 3-grams of the whole text with everything but letters folded to a
space, as square roots of relative frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_is_held_out, may_learn_from, slices, stage

#: ISO 639-1 codes by family. A code not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "bn", "mr", "ur", "ne", "pa", "gu"),
    "semitic": ("ar", "he", "mt", "am"),
}
UNDETERMINED = "und"
DIMENSIONS = 8192
#: Keys of sampled rows are broadcast up to this count (some 100 bytes each).
BROADCAST_ROWS = 200_000


def family_of(lang: str) -> str:
    return next((name for name, codes in FAMILIES.items() if lang in codes), f"only:{lang}")


# -------------------------------------------------------------------- features

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def gram_frequencies(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of DIMENSIONS square roots of relative n-gram frequencies for each text; what stands between letters counts as one space, however long."""
    codes = _FOLD[data]
    keep = codes != 0x20
    keep[1:] |= codes[:-1] != 0x20
    keep[offsets[:-1][offsets[:-1] < len(keep)]] = True
    codes, offsets = codes[keep].astype(np.uint32), np.concatenate([[0], np.cumsum(keep)])[offsets]
    n = len(codes)
    grams = [codes * np.uint32(2654435761)]
    if n > 1:
        two = codes[:-1] * np.uint32(257) + codes[1:] + np.uint32(70001)
        grams.append(two * np.uint32(2654435761))
    if n > 2:
        three = (codes[:-2] * np.uint32(66049) + codes[1:-1] * np.uint32(257) + codes[2:]) + np.uint32(91000001)
        grams.append(three * np.uint32(2654435761))
    grams = [(g >> np.uint32(19)).astype(np.int64) for g in grams]
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    for row, (first, last) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        total = 0
        for size, gram in enumerate(grams, 1):
            if last - first >= size:
                out[row] += np.bincount(gram[first : last - size + 1], minlength=DIMENSIONS)
                total += last - first - size + 1
        if total:
            out[row] /= total
    return np.sqrt(out, out=out)


# -------------------------------------------------------------------- learning


@dataclass(frozen=True)
class Machine:
    """A linear separator of two labels with a logistic curve over its margin."""

    positive: str
    negative: str
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


@dataclass(frozen=True)
class SparseRows:
    """Rows of DIMENSIONS numbers of which only those that aren't 0 are held."""

    slots: np.ndarray
    values: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, slots: list[bytes], values: list[bytes]) -> SparseRows:
        ends = np.cumsum([len(v) // 4 for v in values])
        return cls(np.frombuffer(b"".join(slots), np.uint16).astype(np.int64), np.frombuffer(b"".join(values), np.float32), ends)

    def of_rows(self, rows: np.ndarray) -> SparseRows:
        counts = np.diff(self.ends, prepend=0)
        keep = np.repeat(rows, counts)
        return SparseRows(self.slots[keep], self.values[keep], np.cumsum(counts[rows]))

    def times(self, weights: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.values * weights[self.slots], dtype=np.float64)])[self.ends]
        return np.diff(sums, prepend=0.0)

    def transposed_times(self, factors: np.ndarray) -> np.ndarray:
        return np.bincount(self.slots, self.values * np.repeat(factors, np.diff(self.ends, prepend=0)), DIMENSIONS)


def train_machine(x: SparseRows, y: np.ndarray, names: tuple[str, str], cost: float = 50.0, steps: int = 250) -> Machine:
    """Squared-hinge support vector machine by accelerated gradient descent; every fifth row only calibrates."""
    rows = np.arange(len(y))
    fit, hold = rows % 5 != 4, rows % 5 == 4
    if len(set(y[fit])) < 2 or not hold.any():
        fit = hold = np.ones(len(y), bool)
    a, t = x.of_rows(fit), np.where(y[fit], 1.0, -1.0)
    share = np.where(t > 0, 0.5 / max((t > 0).sum(), 1), 0.5 / max((t < 0).sum(), 1)) * cost
    w, b = np.zeros(DIMENSIONS), 0.0
    vw, vb = w.copy(), 0.0
    rate = 1.0 / (1.0 + 4.0 * cost)
    for step in range(1, steps + 1):
        gap = np.maximum(0, 1 - t * (a.times(vw) + vb)) * t * share
        nw, nb = vw - rate * (vw - 2 * a.transposed_times(gap)), vb + rate * 2 * float(gap.sum())
        pull = (step - 1) / (step + 2)
        vw, vb = nw + pull * (nw - w), nb + pull * (nb - b)
        w, b = nw, nb
    margin, truth = x.of_rows(hold).times(w) + b, y[hold].astype(float)
    truth = (truth * truth.sum() + 1) / (truth.sum() + 2) if truth.all() else np.where(truth > 0, 1 - 0.5 / max(len(truth), 2), 0.5 / max(len(truth), 2))
    slope, shift = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        slope -= 0.5 * float(((p - truth) * margin).mean())
        shift -= 0.5 * float((p - truth).mean())
    return Machine(*names, w.astype(np.float32), float(b), max(slope, 0.1), shift)


def votes(machines: list[Machine], labels: list[str], x: np.ndarray) -> np.ndarray:
    """For each row and label the mean probability over the machines that know the label; a lone label has 1."""
    out = np.zeros((len(x), len(labels)))
    if len(labels) == 1:
        return np.ones_like(out)
    for m in machines:
        p = 1 / (1 + np.exp(-np.clip(m.slope * (x @ m.weights + m.bias) + m.shift, -30, 30)))
        out[:, labels.index(m.positive)] += p
        out[:, labels.index(m.negative)] += 1 - p
    return out / (len(labels) - 1)


@dataclass(frozen=True)
class LanguageModel:
    families: list[str]
    members: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each row and the product of its two levels' probabilities."""
        family = votes(self.between, self.families, x)
        best = family.argmax(1)
        lang, score = np.empty(len(x), object), family.max(1)
        for k, name in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            if len(rows):
                inner = votes(self.within[name], self.members[name], x[rows])
                lang[rows] = np.array(self.members[name], object)[inner.argmax(1)]
                score[rows] = score[rows] * inner.max(1)
        return lang, np.clip(score, 0.0, 1.0)


def fit(docs: DataFrame, per_language: int = 300) -> LanguageModel | None:
    """Learn from a bounded sample: of each language the ``per_language`` different texts whose ids hash lowest, out of
    the rows that may be learned from. Every language that occurs can be predicted. Each machine is trained in a task
    of its own on the rows of its two sides; the driver gets only weights. None if there is nothing to learn."""
    spark = docs.sparkSession
    known = docs.where(may_learn_from() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "lang", "text", F.xxhash64("doc_id").alias("draw"), F.xxhash64("text").alias("same"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "same"))
    drawn = stage(known.select("lang", "draw", "doc_id", "same").withColumn("rank", rank).where(F.col("rank") <= per_language).drop("rank"), "drawn")
    drawn = F.broadcast(drawn) if drawn.count() <= BROADCAST_ROWS else drawn

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in slices(batches, "text"):
            for first in range(0, batch.num_rows, 128):
                part = offsets[first : first + 129]
                x = gram_frequencies(data[part[0] : part[-1]], part - part[0])
                slots = [np.flatnonzero(r).astype(np.uint16) for r in x]
                yield pa.RecordBatch.from_pydict({c: batch.column(c).slice(first, len(x)) for c in ("lang", "draw", "doc_id", "same")} | {
                    "slots": pa.array([s.tobytes() for s in slots], pa.binary()), "values": pa.array([r[s].tobytes() for r, s in zip(x, slots, strict=True)], pa.binary())})

    kind = "lang string, draw long, doc_id long, same long, slots binary, values binary"
    sample = known.join(drawn, ["lang", "draw", "doc_id", "same"], "left_semi").select("lang", "draw", "doc_id", "same", "text").mapInArrow(features, kind)
    sample = stage(sample.dropDuplicates(["lang", "draw", "doc_id", "same"]), "sample")
    names = sorted(r["lang"] for r in sample.select("lang").distinct().collect())  # the labels to be told apart
    if not names:
        return None
    members: dict[str, list[str]] = {}
    for lang in names:
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    sides = [("family", p, q, lang, lang in members[p]) for p, q in combinations(families, 2) for lang in members[p] + members[q]]
    sides += [("lang", p, q, lang, lang == p) for f in families for p, q in combinations(members[f], 2) for lang in (p, q)]
    if not sides:
        return LanguageModel(families, members, [], {f: [] for f in families})

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "draw", "doc_id", "same"])
        level, p, q = (group[c].iloc[0] for c in ("level", "positive", "negative"))
        m = train_machine(SparseRows.of(list(group["slots"]), list(group["values"])), group["side"].to_numpy(bool), (p, q))
        return pd.DataFrame({"level": [level], "positive": [p], "negative": [q], "weights": [m.weights.tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    tasks = spark.createDataFrame(sides, "level string, positive string, negative string, lang string, side boolean")
    rows = sample.join(tasks, "lang").groupBy("level", "positive", "negative").applyInPandas(
        learn, "level string, positive string, negative string, weights binary, bias double, slope double, shift double").orderBy("level", "positive", "negative").collect()
    machines = [(r["level"], Machine(r["positive"], r["negative"], np.frombuffer(r["weights"], np.float32), r["bias"], r["slope"], r["shift"])) for r in rows]
    within: dict[str, list[Machine]] = {f: [] for f in families}
    for level, m in machines:
        if level == "lang":
            within[family_of(m.positive)].append(m)
    return LanguageModel(families, members, [m for level, m in machines if level == "family"], within)


# ------------------------------------------------------------------ prediction


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``doc_id, text, lang, source, ... + held_out, lang_pred, score`` for every row of ``docs``.

    A null text or one without a letter is ``und`` with score 0, as is every text
    when nothing could be learned. Null ids are kept and count as not held out.
    Repeated rows are judged one by one; columns named like the results are replaced.
    """
    model = fit(docs) if model is None else model
    keep = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")]
    held = fold_is_held_out()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers for each pair of families and of languages in one family

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch, data, offsets in slices(batches, "text"):
            texts = batch.column("text")
            n = batch.num_rows
            lang, score = np.full(n, UNDETERMINED, object), np.zeros(n)
            if fitted is not None:
                step = 256
                for first in range(0, n, step):
                    last = min(n, first + step)
                    part = offsets[first : last + 1]
                    lang[first:last], score[first:last] = fitted.predict(gram_frequencies(data[part[0] : part[-1]], part - part[0]))
            for i in range(n):
                text = texts[i].as_py()
                if text is None or not any(c.isalpha() for c in text):
                    lang[i], score[i] = UNDETERMINED, 0.0
            columns = {name: batch.column(name) for name in [*keep, "held_out"]}
            yield pa.RecordBatch.from_pydict(columns | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    narrowed = docs.select(*keep).withColumn("held_out", held)
    schema = narrowed.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return narrowed.mapInArrow(predict, schema)
