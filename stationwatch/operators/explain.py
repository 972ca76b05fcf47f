"""Explanations of fused rows: the decision, each detector's evidence, the diagnosis, and attribution of reconstruction errors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STATION, TIME, VARIABLES, FusionConfig, ReconstructionConfig
from ..functions.scalar import count_true, finite, r6
from ..sources.tables import InvalidData, check_keys, stage
from . import timeline
from .fusion import ALERTS, severity_of_votes
from .reconstruct import Model, modal_step, normalise, segments

#: What to do about each diagnosis.
RECOMMENDATIONS = {
    "DATA_DROPOUT": "Check power, logger and transmission.", "STUCK_SENSOR": "Inspect the sensor; it may be frozen or jammed.", "NOISY_SENSOR": "Check wiring, shielding and grounding.",
    "SPIKE": "Discard the reading and watch for more.", "SENSOR_DRIFT": "Plan a recalibration.", "SENSOR_OFFSET": "Compare with a reference and correct the offset.",
    "RATE_CHANGE": "Watch the next readings before acting.", "UNCLASSIFIED_ANOMALY": "Look at the readings by hand.",
}


def decision(rows: DataFrame, config: FusionConfig = FusionConfig()) -> DataFrame:
    """``decision`` struct; rows whose votes, alert and detector flags contradict each other raise an error."""
    for name in (*ALERTS, "final_alert"):
        if dict(rows.dtypes).get(name) != "boolean":
            raise InvalidData(f"{name} must be boolean")
    votes = count_true([F.col(a) for a in ALERTS])
    sound = (votes == F.col("detector_votes")) & (F.col("final_alert") == (votes >= config.least_votes))
    agreeing = F.array_compact(F.array(*(F.when(F.col(a), F.lit(a.removesuffix("_alert"))) for a in ALERTS)))
    struct = F.struct(
        F.col("final_alert").alias("alert"), F.col("detector_votes").alias("votes"), F.lit(config.least_votes).alias("needed"), severity_of_votes(votes, config).alias("severity"), agreeing.alias("agreeing"),
        F.concat(F.col("detector_votes").cast("string"), F.lit(f" of {len(ALERTS)} detectors agree; {config.least_votes} are needed.")).alias("text"))
    return rows.withColumn("decision", F.when(sound, struct).otherwise(F.raise_error(F.lit("votes, alert and detector flags contradict each other")).cast(rows.select(struct).schema[0].dataType)))


def _first_largest(scores: dict[str, Column]) -> Column:
    out = F
    top = F.greatest(*scores.values())
    for name, score in scores.items():
        out = out.when((score > 0) & (score == top), name)
    return out.otherwise(None)


def detector_evidence(rows: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """``detectors``: for each detector alert, severity, primary variable and the observations behind it, from an allow-list of columns.

    The statistical primary is the variable with most flags; the spatial one the
    first of temperature and pressure that is anomalous, never humidity; the
    reconstruction one its top contributor.
    """
    has = rows.columns
    col = lambda name, kind="double": F.col(name) if name in has else F.lit(None).cast(kind)
    checks = ["range", "roc", "zscore_24h", "zscore_168h", "persistence"]
    fired = {v: count_true([F.coalesce(col(f"{v}_{c}_anomaly", "boolean"), F.lit(False)) for c in checks]) for v in variables}
    notes = F.array_compact(F.array(*(F.when(col(f"{v}_{c}_anomaly", "boolean"), F.lit(f"{v.title()}: {c.replace('_', ' ')}")) for v in variables for c in checks)))
    statistical = F.struct(
        F.col("statistical_alert").alias("alert"), col("statistical_severity_label", "string").alias("severity"), _first_largest(fired).alias("primary"), notes.alias("observations"))
    movers = {v: F.coalesce(col(f"{v}_spatial_anomaly", "boolean"), F.lit(False)) for v in ("temperature", "pressure")}
    away = F.array_compact(F.array(*(F.when(col(f"{v}_spatial_suspicious", "boolean"), F.format_string(
        f"{v.title()} is %+.2f from its %d neighbours", finite(col(f"{v}_spatial_residual")), col(f"{v}_spatial_neighbor_count", "int"))) for v in variables)))
    spatial = F.struct(
        F.col("spatial_alert").alias("alert"), col("spatial_severity_level", "string").alias("severity"),
        F.when(movers["temperature"], "temperature").when(movers["pressure"], "pressure").alias("primary"), away.alias("observations"))
    errors = F.array(*(F.struct(F.lit(v).alias("variable"), r6(finite(col(f"{v}_lstm_ae_error"))).alias("error"), r6(finite(col(f"{v}_lstm_ae_expected"))).alias("expected")) for v in variables))
    rebuilt = F.struct(
        F.col("lstm_ae_alert").alias("alert"), col("lstm_ae_severity_label", "string").alias("severity"), col("lstm_ae_top_contributor", "string").alias("primary"),
        F.coalesce(col("lstm_ae_scored", "boolean"), F.lit(False)).alias("available"), errors.alias("errors"))
    return rows.withColumn("detectors", F.struct(statistical.alias("statistical"), spatial.alias("spatial"), rebuilt.alias("reconstruction")))


def unavailable(reason: str) -> Column:
    """The attribution of a row that has none."""
    return F.struct(F.lit(False).alias("available"), F.lit(reason).alias("reason"))


def explain(rows: DataFrame, config: FusionConfig = FusionConfig(), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """All columns and rows, with ``explanation`` as JSON; refuses repeated keys and tables that are explained already."""
    if "explanation" in rows.columns:
        raise InvalidData("there is an explanation column already")
    check_keys(rows)
    out = detector_evidence(decision(rows, config), variables)
    advice = F.create_map(*(F.lit(x) for item in RECOMMENDATIONS.items() for x in item))
    has = rows.columns
    col = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    diagnosis = F.struct(
        col("diagnosis", "string").alias("kind"), col("operational_class", "string").alias("operational_class"), F.element_at(advice, F.coalesce(col("diagnosis", "string"), F.lit(""))).alias("recommendation"),
        col("diagnosis_variable", "string").alias("variable"))
    model = col("attribution", "string") if "attribution" in has else F.to_json(unavailable("not asked for"))
    readings = F.struct(*(finite(F.col(v)).alias(v) for v in variables))
    whole = F.struct(
        F.col("decision"), F.col("detectors"), diagnosis.alias("diagnosis"), model.alias("model"), readings.alias("readings"), F.col(STATION),
        F.date_format(TIME, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    return out.withColumn("explanation", F.to_json(whole, {"ignoreNullFields": "false"})).drop("decision", "detectors")


def integrity(fused: DataFrame, config: FusionConfig = FusionConfig(), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """One row of checks on the explanations of a fused table: that no row is lost, repeated or changed, that poisoned
    truth columns change nothing, and how many rows have an explanation, all detectors and a model attribution."""
    told = explain(fused, config, variables)
    truth = [c for c in fused.columns if c.startswith("anomaly_") or c == "is_anomaly" or c.endswith("_original")]
    poisoned = fused.withColumns({c: F.lit("true" if kind == "boolean" else "-999").cast(kind) for c, kind in fused.dtypes if c in truth})
    again = explain(poisoned, config, variables).select(STATION, TIME, F.col("explanation").alias("_again"))
    before = fused.select(STATION, TIME, F.xxhash64(*sorted(fused.columns)).alias("_before"))
    rows = before.join(told.withColumn("_after", F.xxhash64(*sorted(fused.columns))), [STATION, TIME], "left").join(again, [STATION, TIME], "left")
    parsed = F.from_json("explanation", "detectors struct<reconstruction: struct<available: boolean>>, model struct<available: boolean>")
    rows = rows.withColumn("_e", parsed)
    return rows.agg(
        F.count("*").alias("fused_rows"), F.count_if("final_alert").alias("alerts"), F.count("explanation").alias("explained"),
        F.count_if(F.coalesce(F.col("_e.detectors.reconstruction.available"), F.lit(False))).alias("complete"), F.count_if(F.coalesce(F.col("_e.model.available"), F.lit(False))).alias("attributed"),
        (F.count("*") == F.count("explanation")).alias("no_row_lost"), F.bool_and(F.col("_before").eqNullSafe(F.col("_after"))).alias("columns_unchanged"),
        F.bool_and(F.col("explanation").eqNullSafe(F.col("_again"))).alias("truth_plays_no_part"))


# ----------------------------------------------------------------- attribution


@dataclass(frozen=True)
class AttributionConfig:
    #: Alerts that are explained, the earliest first; the others are told so.
    rows: int = 1000
    background: int = 25
    permutations: int = 2
    seed: int = 42
    #: Windows that one alert may cost, and seconds that one of its paths may take.
    windows: int = 500_000
    seconds: float = 30.0


Rebuild = Callable[[np.ndarray], np.ndarray]


def row_score(context: np.ndarray, window: int, target: int, rebuild: Rebuild) -> np.ndarray:
    """Scores of many contexts (n, length, variables): the mean squared error at ``target`` over all windows that cover it."""
    n, length, k = context.shape
    starts = range(max(0, target - window + 1), min(target, length - window) + 1)
    total = np.zeros(n)
    for s in starts:
        x = context[:, s : s + window]
        flat = x.transpose(0, 2, 1).reshape(n, -1)
        total += ((flat - rebuild(flat)) ** 2).reshape(n, k, window)[:, :, target - s].mean(1)
    return total / max(len(starts), 1)


def contexts(obs: DataFrame, stats: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
    """Every row of ``obs`` with ``near``, the normalised rows up to a window's length before and after it, and ``parts``, how many segments these come from."""
    reach = config.window - 1
    rows = timeline.chunked(segments(normalise(obs, stats, config), modal_step(obs), config), back=reach, ahead=reach)
    around = timeline.local().rowsBetween(-reach, reach)
    near = F.collect_list(F.struct(TIME, *(F.col(f"{v}_z") for v in config.variables))).over(around)
    same = F.collect_list("segment").over(around)
    return rows.select(STATION, TIME, near.alias("near"), F.size(F.array_distinct(same)).alias("parts"), timeline.OWN).where(timeline.OWN).drop(timeline.OWN)


def requests(obs: DataFrame, alerted: DataFrame, stats: DataFrame, background_end: datetime | None, config: ReconstructionConfig = ReconstructionConfig(), budget: AttributionConfig = AttributionConfig()) -> DataFrame:
    """The alerted rows (with ``lstm_ae_score``) with their contexts, the place of the row in it, and ``reason`` where it can't be explained."""
    first = alerted.select(STATION, TIME).orderBy(TIME, STATION).limit(budget.rows).withColumn("_chosen", F.lit(True))
    asked = alerted.select(STATION, TIME, F.col("lstm_ae_score").alias("stored")).join(first, [STATION, TIME], "left").join(contexts(obs, stats, config), [STATION, TIME], "left")
    target = F.array_position(F.transform("near", lambda c: c[TIME]), F.col(TIME)) - 1
    broken = F.exists("near", lambda c: reduce(lambda a, b: a | b, (c[f"{v}_z"].isNull() for v in config.variables)))
    length, covering = F.size("near"), F.least(target, F.size("near") - config.window) - F.greatest(target - config.window + 1, F.lit(0)) + 1
    cost = (length * len(config.variables) + 1) * 2 * budget.permutations * covering
    late = F.lit(False) if background_end is None else F.col(TIME) <= F.lit(background_end).cast(dict(alerted.dtypes)[TIME])
    reason = (
        F.when(F.col("_chosen").isNull(), "row budget exceeded").when(F.lit(background_end is None), "no background").when(late, "background must precede the row")
        .when(F.col("near").isNull() | target.isNull(), "missing row key").when((F.col("parts") > 1) | broken, "the context has gaps").when(length < config.window, "the context is too short")
        .when(cost > budget.windows, "window budget exceeded"))
    return asked.select(STATION, TIME, "stored", "near", target.cast("int").alias("target"), reason.alias("reason"))


def coalition_steps(asked: DataFrame, ground: np.ndarray, rebuild: Rebuild, config: ReconstructionConfig = ReconstructionConfig(), budget: AttributionConfig = AttributionConfig()) -> DataFrame:
    """(station_id, timestamp, path, step, cell, score): along each path the cells of a context replace the background's one by one, and after each step the row's score stands.

    A path is a permutation of the cells or its reverse; paths are rows and are dealt
    over all tasks. One that takes too long has a single step with a null score.
    """
    width = len(config.variables)
    paths = asked.where("reason IS NULL").select(STATION, TIME, "near", "target", F.explode(F.sequence(F.lit(0), F.lit(2 * budget.permutations - 1))).alias("path"))
    spread = paths.repartition(paths.sparkSession.sparkContext.defaultParallelism * 4, STATION, TIME, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                began, near = time.perf_counter(), row.column("near")[0].as_py()
                x = np.array([[c[f"{v}_z"] for v in config.variables] for c in near], float)
                base = np.concatenate([ground] * -(-len(x) // len(ground)))[: len(x)].reshape(-1)
                path, target = row.column("path")[0].as_py(), row.column("target")[0].as_py()
                order = np.random.default_rng([budget.seed, path // 2]).permutation(x.size)
                order = order[::-1] if path % 2 else order
                steps = np.repeat(base[None], x.size + 1, 0)
                place = np.empty(x.size, np.int64)
                place[order] = np.arange(1, x.size + 1)
                steps = np.where(np.arange(x.size + 1)[:, None] >= place[None], x.reshape(1, -1), steps)
                scores = row_score(steps.reshape(-1, len(x), width), config.window, target, rebuild)
                if time.perf_counter() - began > budget.seconds:
                    order, scores = order[:0], np.array([np.nan])
                n = len(scores)
                yield pa.RecordBatch.from_pydict({
                    STATION: pa.array(row.column(STATION).to_pylist() * n, pa.string()), TIME: pa.chunked_array([row.column(TIME)] * n).combine_chunks(),
                    "path": pa.array([path] * n, pa.int32()), "step": pa.array(np.arange(n), pa.int32()), "cell": pa.array([-1, *order.tolist()], pa.int32()),
                    "score": pa.array([None if np.isnan(s) else float(s) for s in scores], pa.float64())})

    kinds = dict(asked.dtypes)
    return spread.mapInArrow(run, f"{STATION} string, {TIME} {kinds[TIME]}, path int, step int, cell int, score double")


def attribute(obs: DataFrame, alerted: DataFrame, stats: DataFrame, model: Model, background: DataFrame, config: ReconstructionConfig = ReconstructionConfig(),
              budget: AttributionConfig = AttributionConfig()) -> DataFrame:
    """One row for each alerted row (with ``lstm_ae_score``): available, reason, score, base, ``{v}_share``, top_variable, top_offset, uses_future, shares.

    Shapley values of the cells of the row's context, by permutations and their
    reverses, against the mean of ``budget.background`` windows of ``background``
    (normalised windows of strictly earlier times). ``shares`` has a value for each
    variable and offset in hours; they add up to score - base. A variable's share is
    the sum of their magnitudes. A row isn't explained beyond the budgets, with
    gaps in its context, where the stored score isn't reproduced or shares don't add up.
    """
    samples = background.orderBy("times", STATION).select(F.element_at("times", -1).alias("end"), *(f"{v}_cells" for v in config.variables)).limit(budget.background).toPandas()  # a fixed number
    # mean background window: window x variables
    ground = np.stack([np.mean(np.stack(samples[f"{v}_cells"]), 0) for v in config.variables], 1) if len(samples) else np.zeros((config.window, len(config.variables)))
    latest = background.agg(F.max(F.element_at("times", -1)).alias("end")).first()["end"]
    asked = stage(requests(obs, alerted, stats, latest, config, budget), "asked")
    steps = stage(coalition_steps(asked, ground, model.rebuild_matrix, config, budget), "steps")
    path = Window.partitionBy(STATION, TIME, "path").orderBy("step")
    moved = steps.withColumn("gain", F.col("score") - F.lag("score").over(path))
    cells = moved.where("cell >= 0").groupBy(STATION, TIME, "cell").agg((F.sum("gain") / (2 * budget.permutations)).alias("share"))
    ends = steps.groupBy(STATION, TIME).agg(
        F.avg(F.when(F.col("step") == 0, F.col("score"))).alias("base"), F.max_by("score", "step").alias("score"), F.count_if(F.col("score").isNull()).alias("_late"))
    width = len(config.variables)
    by_row = cells.groupBy(STATION, TIME).agg(F.sort_array(F.collect_list(F.struct("cell", "share"))).alias("_cells"))  # as many as a context has cells
    rows = asked.join(ends, [STATION, TIME], "left").join(by_row, [STATION, TIME], "left")
    hours = lambda at: (F.unix_timestamp(at.cast("timestamp")) - F.unix_timestamp(F.col(TIME).cast("timestamp"))) / 3600.0
    names = F.array(*map(F.lit, config.variables))
    shares = F.transform("_cells", lambda c: F.struct(
        F.get(names, c["cell"] % width).alias("variable"), hours(F.get(F.col("near"), F.floor(c["cell"] / width).cast("int"))[TIME]).alias("offset_hours"), c["share"].alias("share")))
    rows = rows.withColumn("shares", shares)
    total = F.aggregate("shares", F.lit(0.0), lambda a, s: a + s["share"])
    gap = F.abs(F.col("score") - F.col("stored"))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason")).when((F.col("_late") > 0) | F.col("score").isNull(), "time budget exceeded")
        .when(gap > 1e-5 + 1e-3 * F.abs("stored"), F.format_string("the stored score is not reproduced: %.9g, not %.9g", "score", "stored"))
        .when(F.abs(F.col("base") + total - F.col("score")) > 1e-7 + 1e-5 * F.abs("score"), "the shares do not add up"))
    rows = rows.withColumn("reason", reason).withColumn("available", F.col("reason").isNull())
    mine = lambda v: F.filter("shares", lambda s: s["variable"] == v)
    sums = {f"{v}_share": F.aggregate(mine(v), F.lit(0.0), lambda a, s: a + F.abs(s["share"])) for v in config.variables}
    rows = rows.withColumns(sums)
    largest = F.array_max(F.transform("shares", lambda s: F.struct(F.abs(s["share"]).alias("size"), (-F.abs(s["offset_hours"])).alias("near"), s["offset_hours"].alias("offset"))))
    top = F.array_max(F.array(*(F.struct(F.col(f"{v}_share").alias("size"), F.lit(-i).alias("place"), F.lit(v).alias("name")) for i, v in enumerate(config.variables))))
    told = lambda c, name: F.when(F.col("available"), c).alias(name)
    return rows.select(
        STATION, TIME, "available", "reason", told(F.col("score"), "score"), told(F.col("base"), "base"), *(told(F.col(name), name) for name in sums), told(top["name"], "top_variable"),
        told(largest["offset"], "top_offset"), told(F.exists("shares", lambda s: s["offset_hours"] > 0), "uses_future"), told(F.col("shares"), "shares"))
