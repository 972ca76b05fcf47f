"""Fusion of the detectors: joins, the two-of-three vote, strategies over a registry, boolean variants."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STATION, TIME, VARIABLES, FusionConfig
from ..functions.scalar import count_true, flag, r6, severity_score
from ..sources.tables import check_keys, require_columns

ALERTS = ("statistical_alert", "spatial_alert", "lstm_ae_alert")


def validated(obs: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """The observations, if they have the detectors' columns and one row for each station and time."""
    require_columns(obs, [STATION, TIME, *variables])
    return check_keys(obs)


def join_outputs(base: DataFrame, *outputs: DataFrame, check: bool = True) -> DataFrame:
    """Left joins on (station_id, timestamp), one to one; of columns with one name the first stays.

    Null and repeated keys are refused. Without ``check`` that is up to the
    caller, who can look at the joined table once: a repeated key repeats there.
    """
    out = check_keys(base) if check else base
    for other in outputs:
        new = [c for c in other.columns if c not in out.columns]
        out = out.join((check_keys(other) if check else other).select(STATION, TIME, *new), [STATION, TIME], "left")
    return out


def severity_of_votes(votes: Column, config: FusionConfig = FusionConfig()) -> Column:
    """The label of a number of votes; any other number is an error."""
    out = F
    for n, name in enumerate(config.severity_by_votes):
        out = out.when(votes == n, F.lit(name))
    return out.otherwise(F.raise_error(F.concat(F.lit("votes outside 0..3: "), F.coalesce(votes.cast("string"), F.lit("null")))))


def vote(rows: DataFrame, config: FusionConfig = FusionConfig(), alerts: tuple[str, ...] = ALERTS) -> DataFrame:
    """Alert where enough detectors agree; a missing vote is no vote."""
    rows = rows.withColumns({a: flag(F.col(a)) for a in alerts})
    rows = rows.withColumn("detector_votes", count_true([F.col(a) for a in alerts]))
    return rows.withColumns({
        "final_alert": F.col("detector_votes") >= config.least_votes, "final_severity": severity_of_votes(F.col("detector_votes"), config),
        "final_confidence": r6(F.col("detector_votes") / len(alerts))})


# -------------------------------------------------------------------- registry


@dataclass(frozen=True)
class Detector:
    """Where a detector's results stand, and what it weighs."""

    name: str
    alert: str
    score: str | None = None
    severity: str | None = None
    normalise: Callable[[Column], Column] = field(default=lambda c: c)
    weight: float = 1.0


REGISTRY: dict[str, Detector] = {}


def register(detector: Detector, registry: dict[str, Detector] = REGISTRY) -> None:
    if detector.name in registry:
        raise ValueError(f"{detector.name} is registered")
    registry[detector.name] = detector


for _detector in (
    Detector("statistical", "statistical_alert", "statistical_severity", "statistical_severity_label"),
    Detector("spatial", "spatial_alert", "spatial_severity_level", "spatial_severity_level", severity_score),
    Detector("reconstruction", "lstm_ae_alert", "lstm_ae_severity_score", "lstm_ae_severity_label"),
):
    register(_detector)


def evidence(rows: DataFrame, registry: dict[str, Detector] = REGISTRY) -> DataFrame:
    """``evidence``: a struct for each detector of score, alert and severity; null where the detector has no vote."""
    structs = []
    for name in sorted(registry):
        d = registry[name]
        has = lambda c: c is not None and c in rows.columns
        if d.alert not in rows.columns:
            structs.append(F.lit(None).cast("struct<score: double, alert: boolean, severity: double>").alias(name))
            continue
        fallback = F.when(F.col(d.alert), 1.0).otherwise(0.0)
        score = F.coalesce(d.normalise(F.col(d.score)).cast("double"), fallback) if has(d.score) else fallback
        severity = severity_score(F.col(d.severity)) if has(d.severity) else score
        structs.append(F.when(F.col(d.alert).isNotNull(), F.struct(r6(score).alias("score"), F.col(d.alert).alias("alert"), severity.alias("severity"))).alias(name))
    return rows.withColumn("evidence", F.struct(*structs))


@dataclass(frozen=True)
class CountTier:
    """By how many detectors alert."""

    suspicious: int = 1
    anomaly: int = 2
    name: str = "count_tier"

    def fuse(self, detectors: list[Detector]) -> tuple[Column, Column]:
        each = [F.col(f"evidence.{d.name}") for d in detectors]
        n = reduce(lambda a, b: a + b, (F.coalesce(e["alert"].cast("int"), F.lit(0)) for e in each))
        there = reduce(lambda a, b: a + b, (e.isNotNull().cast("int") for e in each))
        label = F.when(n >= self.anomaly, "anomaly").when(n >= self.suspicious, "suspicious").otherwise("normal")
        return label, F.coalesce(n / F.nullif(there, F.lit(0)), F.lit(0.0))


@dataclass(frozen=True)
class WeightedTier:
    """By the weighted mean of scores over the detectors that have a vote."""

    suspicious: float = 0.33
    anomaly: float = 0.66
    name: str = "weighted_tier"

    def fuse(self, detectors: list[Detector]) -> tuple[Column, Column]:
        each = [(F.col(f"evidence.{d.name}"), d.weight) for d in detectors]
        total = reduce(lambda a, b: a + b, (F.when(e.isNotNull(), F.lit(w)).otherwise(0.0) for e, w in each))
        score = reduce(lambda a, b: a + b, (F.coalesce(e["score"] * w, F.lit(0.0)) for e, w in each))
        score = r6(F.coalesce(score / F.nullif(total, F.lit(0.0)), F.lit(0.0)))
        return F.when(score >= self.anomaly, "anomaly").when(score >= self.suspicious, "suspicious").otherwise("normal"), score


@dataclass(frozen=True)
class LogisticMeta:
    """By a logistic regression on the scores (missing ones 0), detectors in order of name; L2 with unit cost on the summed loss."""

    weights: Mapping[str, float]
    intercept: float
    suspicious: float = 0.3
    anomaly: float = 0.6
    name: str = "logistic_meta"

    @staticmethod
    def scores(names: Iterable[str]) -> dict[str, Column]:
        return {n: F.coalesce(F.col(f"evidence.{n}.score"), F.lit(0.0)) for n in sorted(names)}

    @classmethod
    def fit(cls, rows: DataFrame, truth: str, registry: dict[str, Detector] = REGISTRY) -> LogisticMeta:
        scores = cls.scores(registry)
        named = rows.select(*(c.alias(f"_{n}") for n, c in scores.items()), F.col(truth).cast("double").alias("label"))
        data = VectorAssembler(inputCols=[f"_{n}" for n in scores], outputCol="_features").transform(named).select("_features", "label")
        regression = LogisticRegression(featuresCol="_features", labelCol="label", maxIter=1000, tol=1e-9, regParam=1.0 / max(data.count(), 1), standardization=False)
        model = regression.fit(data)
        return cls(dict(zip(scores, map(float, model.coefficients), strict=True)), float(model.intercept))

    def apply(self, rows: DataFrame, registry: dict[str, Detector] = REGISTRY) -> DataFrame:
        """A few numbers of the model in a column expression."""
        scores = self.scores(self.weights)
        margin = reduce(lambda a, b: a + b, (F.lit(w) * scores[n] for n, w in self.weights.items()), F.lit(self.intercept))
        p = 1 / (1 + F.exp(-margin))
        name = F.when(p >= self.anomaly, "anomaly").when(p >= self.suspicious, "suspicious").otherwise("normal")
        return rows.withColumns({f"fusion_{self.name}_label": name, f"fusion_{self.name}_score": r6(p)})


def run_strategies(rows: DataFrame, strategies: list, registry: dict[str, Detector] = REGISTRY) -> DataFrame:
    """``fusion_{name}_label`` and ``_score`` of each strategy; other columns stay."""
    out = evidence(rows, registry)
    detectors = [registry[n] for n in sorted(registry)]
    for s in strategies:
        if hasattr(s, "apply"):
            out = s.apply(out, registry)
            continue
        label, score = s.fuse(detectors)
        out = out.withColumns({f"fusion_{s.name}_label": label, f"fusion_{s.name}_score": r6(score)})
    return out.drop("evidence")


def variants(rows: DataFrame, bounds: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """Boolean combinations, those with reconstruction at several multiples of its p99 limit."""
    s, p = flag(F.col("statistical_alert")), flag(F.col("spatial_alert"))
    rows = rows.crossJoin(F.broadcast(bounds.select(F.col("p99").alias("_p99"))))  # one row
    columns = {"statistical_or_spatial": s | p, "statistical_and_spatial": s & p}
    for m in config.multipliers:
        tag = f"{m:g}".replace(".", "p")
        r = flag(F.col("lstm_ae_score") > F.col("_p99") * m)
        votes = count_true([s, p, r])
        columns |= {f"reconstruction_{tag}x": r, f"any_{tag}x": s | p | r, f"baseline_and_reconstruction_{tag}x": (s | p) & r, f"two_of_three_{tag}x": votes >= 2, f"all_three_{tag}x": votes == 3}
    return rows.withColumns(columns).drop("_p99")
