"""Reconstruction detector: sliding windows of normalised readings, their reconstruction error, and what it means for each reading.

The default model is a linear autoencoder: principal components of the flattened
window. ``window_mean`` is a second model, in plain SQL terms, that rebuilds each
reading by its window's mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STATION, TIME, ReconstructionConfig
from ..functions.scalar import clip, flag, r6
from ..sources.tables import stage
from . import timeline
from .order import order_statistics

GLOBAL = "__global__"


def cutoff(history: DataFrame, share: float) -> DataFrame:
    """One row: the time before which the training part ends."""
    seconds = F.unix_micros(F.col(TIME).cast("timestamp"))
    return history.agg(F.min(seconds).alias("low"), F.max(seconds).alias("high")).select(
        F.timestamp_micros(F.round(F.col("low") + (F.col("high") - F.col("low")) * (1 - share)).cast("long")).alias("cutoff"))


def normalisation(train: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    """Mean and population deviation for each station and over all (station_id ``__global__``); a deviation of zero counts as 1."""
    def statistics(groups: list) -> DataFrame:
        sd = lambda v: r6(F.stddev_pop(v))
        return train.groupBy(*groups).agg(F.count("*").alias("n"), *(F.coalesce(r6(F.avg(v)), F.lit(0.0)).alias(f"{v}_mean") for v in config.variables), *(
            F.when(sd(v) > 1e-6, sd(v)).otherwise(1.0).alias(f"{v}_std") for v in config.variables))

    return statistics([STATION]).where(F.col("n") >= config.own_statistics_rows).unionByName(statistics([F.lit(GLOBAL).alias(STATION)]))


def normalise(obs: DataFrame, stats: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    """``{v}_z`` clipped to the limits, by the station's own statistics or else the global ones; null stays null."""
    names = [f"{v}_{k}" for v in config.variables for k in ("mean", "std")]
    own = stats.where(F.col(STATION) != GLOBAL).select(STATION, F.struct(*names).alias("_own"))
    everyone = stats.where(F.col(STATION) == GLOBAL).select(F.struct(*names).alias("_all"))
    joined = obs.join(own, STATION, "left").join(F.broadcast(everyone), how="left")  # one row
    use = F.coalesce("_own", "_all")
    return joined.withColumns({name: use[name] for name in names}).withColumns({
        f"{v}_z": r6(clip((F.col(v) - F.col(f"{v}_mean")) / F.col(f"{v}_std"), -config.clip, config.clip)) for v in config.variables}).drop("_own", "_all")


def modal_step(obs: DataFrame) -> DataFrame:
    """station_id, step: the commonest gap in seconds, the earliest seen of equals; an hour for a station of one row."""
    at = F.unix_timestamp(F.col(TIME).cast("timestamp"))
    rows = timeline.chunked(obs.select(STATION, TIME, *(c for c in obs.columns if c == timeline.POSITION)), back=1)
    gaps = timeline.own(rows.withColumn("gap", at - F.lag(at).over(timeline.local())))
    counted = gaps.where("gap IS NOT NULL").groupBy(STATION, "gap").agg(F.count("*").alias("n"), F.min(TIME).alias("first"))
    best = counted.groupBy(STATION).agg(F.min_by("gap", F.struct(-F.col("n"), "first")).alias("step"))
    return obs.select(STATION).distinct().join(best, STATION, "left").select(STATION, F.coalesce("step", F.lit(3600)).cast("long").alias("step"))


def segments(obs: DataFrame, steps: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    """``segment`` counts the gaps so far that are longer than the tolerance; ``pos`` numbers the rows of a segment."""
    at = F.unix_timestamp(F.col(TIME).cast("timestamp"))
    gap = at - F.lag(at).over(timeline.local())
    rows = timeline.chunked(obs, back=1).join(steps, STATION)
    rows = rows.withColumn("_opens", flag(gap > F.col("step") * config.gap_tolerance).cast("long")).drop("step").where(timeline.OWN)
    opened = F.when(F.col("_opens") == 1, F.col(timeline.POSITION))
    # chunks hand on how many gaps there were and where the last one ended
    rows = timeline.carried(
        rows, {"_gaps": F.sum("_opens"), "_last": F.max(opened), "_first": F.min(timeline.POSITION)},
        {"_gaps": F.coalesce(F.sum("_gaps").over(timeline.earlier()), F.lit(0)), "_last": F.max("_last").over(timeline.earlier()), "_first": F.min("_first").over(timeline.earlier().rowsBetween(Window.unboundedPreceding, 0))})
    so_far = timeline.local().rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce(F.max(opened).over(so_far), F.col("_last"), F.col("_first"))
    rows = rows.withColumns({"segment": F.sum("_opens").over(so_far) + F.col("_gaps"), "pos": (F.col(timeline.POSITION) - start).cast("int")})
    return timeline.own(rows.drop("_opens", "_gaps", "_last", "_first"))


def _filled(cells: Column, run: int) -> Column:
    """Gaps filled forwards from at most ``run`` cells back, then what is left backwards in the same way."""
    forward = F.transform(cells, lambda x, i: F.coalesce(x, *(F.when(i >= k, F.get(cells, i - k)) for k in range(1, run + 1))))
    return F.transform(forward, lambda x, i: F.coalesce(x, *(F.get(forward, i + k) for k in range(1, run + 1))))


def sliding_windows(rows: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    """station_id, segment, start, times, and a filled array ``{v}_cells`` for each variable, for every whole window with enough readings."""
    rows = timeline.chunked(rows, ahead=config.window - 1)
    ahead = timeline.local("segment").rowsBetween(0, config.window - 1)
    cells = F.collect_list(F.struct(F.col(TIME), *(F.col(f"{v}_z") for v in config.variables))).over(ahead)
    found = rows.select(STATION, "segment", F.col("pos").alias("start"), timeline.OWN, cells.alias("_cells")).where(timeline.OWN).drop(timeline.OWN)
    found = found.where((F.size("_cells") == config.window) & (F.col("start") % config.stride == 0))
    def present(v: str) -> Column:
        return F.size(F.filter("_cells", lambda c: c[f"{v}_z"].isNotNull()))

    valid = sum((present(v) for v in config.variables), F.lit(0))
    found = found.where(valid / (config.window * len(config.variables)) >= config.least_valid)
    found = found.select(STATION, "segment", "start", F.col(f"_cells.{TIME}").alias("times"), *(
        _filled(F.col(f"_cells.{v}_z"), config.fill_run).alias(f"{v}_cells") for v in config.variables))
    for v in config.variables:
        found = found.where(~F.exists(f"{v}_cells", lambda x: x.isNull()))
    return found


# ---------------------------------------------------------------------- models


def window_mean(windows: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    """``{v}_rebuilt``: each cell rebuilt by the window's mean."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    means = windows.withColumns({f"_{v}_mean": mean(F.col(f"{v}_cells")) for v in config.variables})
    rebuilt = means.withColumns({f"{v}_rebuilt": F.array_repeat(F.col(f"_{v}_mean"), config.window) for v in config.variables})
    return rebuilt.drop(*(f"_{v}_mean" for v in config.variables))


@dataclass(frozen=True)
class LinearAutoencoder:
    """Mean and principal directions of flattened windows."""

    mean: np.ndarray
    directions: np.ndarray

    @classmethod
    def fit(cls, windows: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> LinearAutoencoder | None:
        """From sums of outer products, added up over partitions; None without windows."""
        size = config.window * len(config.variables)
        columns = [f"{v}_cells" for v in config.variables]

        def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, square = 0, np.zeros(size), np.zeros((size, size))
            for batch in batches:
                x = _matrix(batch, columns)
                n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
            yield pa.RecordBatch.from_pydict({"place": np.arange(size * size + size + 1), "x": np.concatenate([[n], total, square.reshape(-1)])})

        sums = windows.select(*columns).mapInArrow(moments, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).orderBy("place").toPandas()["x"].to_numpy()
        if not len(sums) or sums[0] < 2:
            return None
        n, mean = sums[0], sums[1 : size + 1] / sums[0]
        covariance = sums[size + 1 :].reshape(size, size) / n - np.outer(mean, mean)
        _, vectors = np.linalg.eigh(covariance)
        return cls(mean, vectors[:, ::-1][:, : config.components])

    def rebuild_matrix(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.directions @ self.directions.T + self.mean

    def rebuild(self, windows: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
        columns = [f"{v}_cells" for v in config.variables]
        mean, directions = self.mean, self.directions

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, columns) - mean
                rebuilt = (x @ directions) @ directions.T + mean
                parts = rebuilt.reshape(len(x), len(columns), -1)
                arrays = {c: batch.column(c) for c in batch.schema.names}
                yield pa.RecordBatch.from_pydict(arrays | {f"{v}_rebuilt": pa.array(list(parts[:, i]), pa.list_(pa.float64())) for i, v in enumerate(config.variables)})

        schema = windows.select("*", *(F.col(f"{v}_cells").alias(f"{v}_rebuilt") for v in config.variables)).schema
        return windows.mapInArrow(run, schema)


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    n = batch.num_rows
    return np.concatenate([batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in columns], 1) if n else np.zeros((0, 0))


# --------------------------------------------------------------------- scoring


def observation_scores(rebuilt: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    """station_id, timestamp, coverage and for each variable the error (mean or maximum over windows) and mean reconstruction."""
    zipped = F.arrays_zip("times", *(f"{v}_{k}" for v in config.variables for k in ("cells", "rebuilt")))
    cells = rebuilt.select(STATION, F.explode(zipped).alias("c")).select(STATION, F.col("c.times").alias(TIME), "c")
    gather = F.max if config.aggregation == "max" else F.avg
    return cells.groupBy(STATION, TIME).agg(
        F.count("*").alias("lstm_ae_coverage"),
        *(r6(gather(F.pow(F.col(f"c.{v}_cells") - F.col(f"c.{v}_rebuilt"), 2))).alias(f"{v}_lstm_ae_error") for v in config.variables),
        *(F.avg(f"c.{v}_rebuilt").alias(f"_{v}_rebuilt") for v in config.variables))


def score_of(config: ReconstructionConfig) -> Column:
    return r6(sum((F.col(f"{v}_lstm_ae_error") for v in config.variables), F.lit(0.0)) / len(config.variables))


def limits(scores: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    """One row: the limits p95 and p99 of the score and of each variable's error."""
    columns = {"": score_of(config)} | {f"{v}_": F.col(f"{v}_lstm_ae_error") for v in config.variables}
    long = scores.select(*(c.alias(f"{name}error") for name, c in columns.items())).unpivot([], [f"{name}error" for name in columns], "name", "x")
    found = order_statistics(long, "x", dict(zip(("p95", "p99"), config.quantiles, strict=True)), by=("name",))
    return found.agg(*(r6(F.max(F.when(F.col("name") == f"{name}error", F.col(p)))).alias(f"{name}{p}") for name in columns for p in ("p95", "p99")))


def severity_of(score: Column, p95: Column, p99: Column) -> Column:
    """Piecewise linear: 0 to .33 up to p95, to .67 up to p99, to 1 beyond."""
    span = F.greatest(p99 - p95, F.lit(1e-9))
    low = F.least(F.greatest(0.33 * score / F.greatest(p95, F.lit(1e-9)), F.lit(0.0)), F.lit(0.33))
    high = F.least(F.greatest(0.67 + 0.33 * (score - p99) / span, F.lit(0.67)), F.lit(1.0))
    return F.when(score.isNull(), F.lit(0.0)).when(score <= p95, low).when(score <= p99, 0.33 + 0.34 * (score - p95) / span).otherwise(high)


def label(obs: DataFrame, scores: DataFrame, bounds: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    """Every row of ``obs`` (with its normalisation columns) with score, label, alert, severity, top contributor, expectation and residual."""
    rows = obs.join(scores, [STATION, TIME], "left").join(F.broadcast(bounds.select("p95", "p99")), how="left")  # one row of bounds
    rows = rows.withColumns({"lstm_ae_scored": F.col("lstm_ae_coverage").isNotNull(), "lstm_ae_score": score_of(config), "lstm_ae_coverage": F.coalesce("lstm_ae_coverage", F.lit(0))})
    score = F.col("lstm_ae_score")
    name = F.when(~F.col("lstm_ae_scored"), "unscored").when(score > F.col("p99"), "anomaly").when(score > F.col("p95"), "suspicious").otherwise("normal")
    errors = {v: F.col(f"{v}_lstm_ae_error") for v in config.variables}
    top = F
    for v in config.variables:
        top = top.when(errors[v] >= F.greatest(*errors.values()), v)
    out = rows.withColumns({
        "lstm_ae_severity_label": name, "lstm_ae_suspicious": flag(score > F.col("p95")), "lstm_ae_alert": flag(score > F.col("p99")),
        "lstm_ae_severity_score": r6(severity_of(score, F.col("p95"), F.col("p99"))), "lstm_ae_top_contributor": top.otherwise(None),
    } | {f"{v}_lstm_ae_expected": r6(F.col(f"_{v}_rebuilt") * F.col(f"{v}_std") + F.col(f"{v}_mean")) for v in config.variables})
    out = out.withColumns({f"{v}_lstm_ae_residual": r6(F.col(v) - F.col(f"{v}_lstm_ae_expected")) for v in config.variables})
    drop = [f"_{v}_rebuilt" for v in config.variables] + [f"{v}_{k}" for v in config.variables for k in ("mean", "std", "z")] + ["p95", "p99"]
    return out.drop(*drop)


class Model(Protocol):
    """Anything that adds ``{v}_rebuilt`` to windows, and rebuilds flattened ones."""

    def rebuild(self, windows: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame: ...

    def rebuild_matrix(self, x: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class ReconstructionTables:
    """What calibration leaves: statistics, score limits and the model (None: window means)."""

    stats: DataFrame
    bounds: DataFrame
    model: Model | None

    def rebuild(self, windows: DataFrame, config: ReconstructionConfig) -> DataFrame:
        return window_mean(windows, config) if self.model is None else self.model.rebuild(windows, config)


def windows_of(obs: DataFrame, stats: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    return sliding_windows(segments(normalise(obs, stats, config), modal_step(obs), config), config)


def calibrate(history: DataFrame, config: ReconstructionConfig = ReconstructionConfig(), linear: bool = True, refine: Callable[[DataFrame, DataFrame, LinearAutoencoder], Model] | None = None) -> ReconstructionTables:
    """Statistics and model from the part before the cutoff, limits from the part after it (from all if that has no windows).

    ``refine`` makes another model of the staged training and held-out windows and the linear model.
    """
    end = F.broadcast(cutoff(history, config.validation_share))  # one row
    split = history.crossJoin(end)
    train = split.where(F.col(TIME) < F.col("cutoff")).drop("cutoff")
    stats = stage(normalisation(train, config), "normalisation")
    held = split.where(F.col(TIME) >= F.col("cutoff")).drop("cutoff")
    windows = windows_of(train, stats, config) if linear else None
    if refine is not None:
        windows = stage(windows, "windows")
    model: Model | None = LinearAutoencoder.fit(windows, config) if linear else None
    if refine is not None and model is not None:
        model = refine(windows, stage(windows_of(held, stats, config), "held-windows"), model)
    tables = ReconstructionTables(stats, stats, model)
    scores = observation_scores(tables.rebuild(windows_of(held, stats, config), config), config)
    if scores.isEmpty():
        scores = observation_scores(tables.rebuild(windows_of(history, stats, config), config), config)
    return ReconstructionTables(stats, stage(limits(scores, config), "bounds"), model)


def detect(obs: DataFrame, tables: ReconstructionTables, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    normal = normalise(obs, tables.stats, config)
    windows = sliding_windows(segments(normal, modal_step(obs), config), config)
    return label(normal, observation_scores(tables.rebuild(windows, config), config), tables.bounds, config)
