"""Diagnosis of alerted rows by the shape of the last six hours' residuals against the neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STATION, TIME, VARIABLES
from ..functions.scalar import finite, flag, is_finite, r6, with_medians
from ..sources.tables import InvalidData, check_keys, require_columns, stage
from . import spatial, timeline

# Kinds by precedence, with the confidence of each.
KINDS = (
    ("DATA_DROPOUT", 0.95), ("STUCK_SENSOR", 0.85), ("NOISY_SENSOR", 0.7), ("SPIKE", 0.8), ("SENSOR_DRIFT", 0.65), ("SENSOR_OFFSET", 0.65), ("RATE_CHANGE", 0.55),
    ("UNCLASSIFIED_ANOMALY", 0.0),
)
PRECEDENCE = tuple(k for k, _ in KINDS)
CONFIDENCE = dict(KINDS)
REASONS = {
    "DATA_DROPOUT": "The reading is missing or not finite.", "STUCK_SENSOR": "The reading stands still while its neighbours move.",
    "NOISY_SENSOR": "Residual steps vary widely and keep changing direction.", "SPIKE": "One large residual between calm ones.",
    "SENSOR_DRIFT": "A bias of one sign that keeps growing.", "SENSOR_OFFSET": "A steady bias of one sign.", "RATE_CHANGE": "The residual's step is beyond its historical limit.",
    "UNCLASSIFIED_ANOMALY": "No shape is borne out.",
}
PARAMETERS = ("residual_center", "residual_scale", "rate_center", "rate_scale", "rate_threshold")
RATE_THRESHOLD, LEAST_ROWS = 3.0, 30
#: The features of a shape that its evidence tells, by name.
SHAPE = ("mad", "median", "monotonic", "noise", "peer_count", "peer_span", "rate", "rate_threshold", "ready", "reversal", "same_sign", "slope", "span", "spike", "z")


def check_reference(reference: DataFrame) -> DataFrame:
    """Refuse repeated keys, numbers that are not finite and scales that are not positive."""
    require_columns(reference, [STATION, "variable", *PARAMETERS])
    good = F.lit(True)
    for p in PARAMETERS:
        good = good & is_finite(F.col(p))
    for p in ("residual_scale", "rate_scale", "rate_threshold"):
        good = good & (F.col(p) > 0)
    if not reference.where(~flag(good)).isEmpty() or not reference.groupBy(STATION, "variable").count().where("count > 1").isEmpty():
        raise InvalidData("the reference has repeated keys or unusable scales")
    return reference


def check_input(df: DataFrame, reference_end: str | None) -> DataFrame:
    """Refuse missing columns, non-boolean alerts, bad keys, times off the hour, and data that the reference already covers."""
    require_columns(df, [STATION, TIME, "final_alert", *VARIABLES])
    if dict(df.dtypes)["final_alert"] != "boolean" or not df.where("final_alert IS NULL").isEmpty():
        raise InvalidData("final_alert must be boolean")
    check_keys(df)
    if not df.where(F.date_trunc("hour", TIME) != F.col(TIME)).isEmpty():
        raise InvalidData("timestamps must be whole hours")
    if reference_end is not None and not df.where(F.col(TIME) <= F.lit(reference_end).cast("timestamp")).isEmpty():
        raise InvalidData("the reference must strictly precede the data")
    return df


def build_reference(history: DataFrame, graph: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """Centre and deviation of residuals against neighbours and of their hourly steps, for each station and variable with enough of both."""
    rows = timeline.chunked(spatial.with_residuals(history, graph, variables=variables), back=1)
    at, by_chunk = F.unix_timestamp(F.col(TIME).cast("timestamp")), timeline.local()
    rows = rows.withColumn("_step", at - F.lag(at).over(by_chunk))
    columns = {}
    for v in variables:
        columns[f"_{v}"] = F.when(F.col(f"{v}_spatial_neighbor_count") >= 2, finite(F.col(v)) - F.col(f"{v}_spatial_expected"))
    rows = rows.withColumns(columns)
    rows = rows.withColumns({f"_d_{v}": F.when(F.col("_step") == 3600, F.col(f"_{v}") - F.lag(f"_{v}").over(by_chunk)) for v in variables}).where(timeline.OWN)
    long = None
    for v in variables:
        part = rows.select(STATION, F.lit(v).alias("variable"), F.col(f"_{v}").alias("r"), F.col(f"_d_{v}").alias("d"))
        long = part if long is None else long.unionByName(part)
    found = long.groupBy(STATION, "variable").agg(
        r6(F.avg("r")).alias("residual_center"), r6(F.stddev_samp("r")).alias("residual_scale"), r6(F.avg("d")).alias("rate_center"), r6(F.stddev_samp("d")).alias("rate_scale"),
        F.count("r").alias("_r"), F.count("d").alias("_d"))
    enough = (F.col("_r") >= LEAST_ROWS) & (F.col("_d") >= LEAST_ROWS) & (F.col("residual_scale") > 0) & (F.col("rate_scale") > 0)
    return found.where(enough).select(STATION, "variable", *PARAMETERS[:4], F.lit(RATE_THRESHOLD).alias("rate_threshold"))


def features(df: DataFrame, reference: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """``{v}_f``: a struct of the shape features of each variable, all windows over one sort of each chunk of a station's rows."""
    wide = reference.groupBy(STATION).pivot("variable", list(variables)).agg(F.first(F.struct(*PARAMETERS)))
    by_chunk = timeline.local()
    rows = timeline.chunked(df, back=8, ahead=1).join(wide.withColumnsRenamed({v: f"_p_{v}" for v in variables}), STATION, "left")
    at = F.unix_timestamp(F.col(TIME).cast("timestamp"))
    rows = rows.withColumn("_contiguous", flag(at - F.lag(at).over(by_chunk) == 3600))
    first = {}
    for v in variables:
        p = F.col(f"_p_{v}")
        known = p.isNotNull()
        expected = F.col(f"behavior_peer_expected_{v}") if f"behavior_peer_expected_{v}" in df.columns else F.lit(None).cast("double")
        count = F.col(f"behavior_peer_count_{v}") if f"behavior_peer_count_{v}" in df.columns else F.lit(0)
        first |= {
            f"_{v}_x": F.when(known, finite(F.col(v).cast("double"))), f"_{v}_n": F.when(known, F.coalesce(count.cast("int"), F.lit(0))),
            f"_{v}_peer": F.when(known & (count >= 2), finite(expected)),
        }
    rows = rows.withColumns(first)
    rows = rows.withColumns({f"_{v}_z": r6((F.col(f"_{v}_x") - F.col(f"_{v}_peer") - F.col(f"_p_{v}.residual_center")) / F.col(f"_p_{v}.residual_scale")) for v in variables})
    second = {"_c_last": flag(F.lag("_contiguous").over(by_chunk)), "_c_next": flag(F.lead("_contiguous").over(by_chunk)),
              "_c5": F.sum(F.col("_contiguous").cast("int")).over(by_chunk.rowsBetween(-4, 0))}
    for v in variables:
        z, x, peer, p = (F.col(f"_{v}_{k}") for k in ("z", "x", "peer", "z"))
        step = lambda c: F.when(F.col("_contiguous"), r6(c - F.lag(c).over(by_chunk)))
        second |= {
            f"_{v}_dx": step(x), f"_{v}_dp": step(peer), f"_{v}_dz": step(z),
            f"_{v}_rate": F.when(F.col("_contiguous"), r6(((x - peer) - F.lag(x - peer).over(by_chunk) - F.col(f"_p_{v}.rate_center")) / F.col(f"_p_{v}.rate_scale"))),
            f"_{v}_z1": F.lag(z).over(by_chunk), f"_{v}_z2": F.lag(z, 2).over(by_chunk), f"_{v}_zn": F.lead(z).over(by_chunk),
        }
    rows = rows.withColumns(second)
    rows = rows.withColumns({f"_{v}_turn": flag(F.col(f"_{v}_dz") * F.lag(f"_{v}_dz").over(by_chunk) < 0) for v in variables})
    third = {}
    for v in variables:
        z, dz, x, peer, rate = (F.col(f"_{v}_{k}") for k in ("z", "dz", "x", "peer", "rate"))
        w = lambda n: by_chunk.rowsBetween(1 - n, 0)
        share = lambda c, n: F.when(F.count(F.lit(1)).over(w(n)) == n, F.avg(flag(c).cast("double")).over(w(n)))
        whole = lambda c, n, e: F.when(F.count(c).over(w(n)) == n, e)
        third[f"{v}_f"] = F.struct(
            z.alias("z"), rate.alias("rate"), F.col(f"_{v}_dx").alias("dx"), F.col(f"_{v}_dp").alias("peer_dx"), F.col(f"_{v}_n").alias("peer_count"),
            whole(peer, 6, r6(F.max(peer).over(w(6)) - F.min(peer).over(w(6)))).alias("peer_span"), whole(x, 6, r6(F.max(x).over(w(6)) - F.min(x).over(w(6)))).alias("span"),
            whole(z, 6, F.collect_list(z).over(w(6))).alias("zs"), whole(dz, 5, F.collect_list(dz).over(w(5))).alias("dzs"), whole(rate, 5, F.collect_list(rate).over(w(5))).alias("rates"),
            F.greatest(share(z > 0, 6), share(z < 0, 6)).alias("same_sign"), F.greatest(share(dz > 0, 5), share(dz < 0, 5)).alias("monotonic"),
            share(F.col(f"_{v}_turn"), 4).alias("reversal"),
            flag((F.abs(z) >= 3) & (F.abs(f"_{v}_z1") < 2) & (F.abs(f"_{v}_z2") < 2) & (F.abs(f"_{v}_zn") < 2) & F.col("_contiguous") & F.col("_c_last") & F.col("_c_next")).alias("spike"),
            flag((F.count(z).over(w(6)) == 6) & (F.col("_c5") == 5)).alias("ready"))
    rows = rows.withColumns(third).where(timeline.OWN)
    rows = with_medians(rows, {f"_{v}_{k}": F.col(f"{v}_f.{k}") for v in variables for k in ("zs", "dzs", "rates")})
    rows = rows.withColumns({f"{v}_f": F.struct(
        *(F.col(f"{v}_f.{k}").alias(k) for k in ("z", "rate", "dx", "peer_dx", "peer_count", "peer_span", "span", "same_sign", "monotonic", "reversal", "spike", "ready")),
        r6(F.col(f"_{v}_zs_med")).alias("median"), r6(F.col(f"_{v}_zs_mad")).alias("mad"), r6(F.col(f"_{v}_dzs_med")).alias("slope"), r6(F.col(f"_{v}_rates_mad")).alias("noise"),
        F.col(f"_p_{v}.rate_threshold").alias("rate_threshold"), F.col(f"_p_{v}.rate_scale").alias("rate_scale")) for v in variables})
    return rows.select(*df.columns, *(f"{v}_f" for v in variables))


def _kind(f: Column, reading: Column) -> Column:
    ready = f["ready"]
    sustained = ready & (F.abs(f["median"]) >= 3) & (f["same_sign"] >= 0.8)
    kind = F.when(~is_finite(reading), "DATA_DROPOUT")
    kind = kind.when(ready & (f["span"] <= 0.05) & (f["peer_span"] >= 0.2) & (f["peer_span"] >= 4 * f["span"]), "STUCK_SENSOR")
    kind = kind.when(ready & (f["noise"] >= 3) & (f["reversal"] >= 0.6), "NOISY_SENSOR").when(f["spike"], "SPIKE")
    kind = kind.when(sustained & (F.abs(f["slope"]) > 0.25) & (f["monotonic"] >= 0.8), "SENSOR_DRIFT")
    kind = kind.when(sustained & (F.abs(f["slope"]) <= 0.25) & (f["mad"] <= 1), "SENSOR_OFFSET")
    return kind.when(F.abs(f["rate"]) >= f["rate_threshold"], "RATE_CHANGE")


def band_counts(steps: DataFrame, low: float = 0.75, high: float = 1.25) -> DataFrame:
    """(station_id, timestamp, variable, alike): for each asking row how many steps of its time and variable go the same way, between ``low`` and ``high`` times its size.

    ``steps`` has station_id, timestamp, variable, dx and ``asks``. Each step is a point on a
    line for its time, variable and direction, each question the two ends of a
    band; one sort runs over them, and what an end needs is the number of points
    before it. So a time costs memory for no station but the current one.
    """
    size = F.abs("dx")
    mark = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    # of equal places a band begins before the points and ends behind them
    ends = F.when(F.col("asks"), F.array(mark(low * size, 0), mark(size, 1), mark(high * size, 2))).otherwise(F.array(mark(size, 1)))
    marks = steps.where("dx IS NOT NULL AND dx <> 0").select(STATION, TIME, "variable", (F.col("dx") > 0).alias("up"), F.explode(ends).alias("m")).select("*", "m.at", "m.kind").drop("m")
    line = Window.partitionBy(TIME, "variable", "up").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.withColumn("seen", F.sum((F.col("kind") == 1).cast("long")).over(line)).where("kind <> 1")
    return counted.groupBy(STATION, TIME, "variable").agg((F.max(F.when(F.col("kind") == 2, F.col("seen"))) - F.max(F.when(F.col("kind") == 0, F.col("seen")))).alias("alike"))


def diagnose(df: DataFrame, reference: DataFrame, reference_end: str | None = None, check: bool = True) -> DataFrame:
    """Every row with diagnosis, diagnosis_variable, diagnosis_confidence, operational_class, diagnosis_reason and diagnosis_evidence (JSON).

    Rows without alert keep a null diagnosis. A spike looks one row ahead, so the newest hour of a station can't be one yet.
    """
    if check:
        check_reference(reference)
        check_input(df, reference_end)
    variables = tuple(v for v in (*VARIABLES, "surface_pressure") if v in df.columns)
    rows = features(df, reference, variables)
    same_time = Window.partitionBy(TIME)
    calm = {f"_{v}_calm": flag((F.abs(F.col(f"{v}_f.z")) < 2) & is_finite(F.col(v).cast("double"))).cast("int") for v in variables}
    rows = rows.withColumns(calm)
    rows = rows.withColumns({f"_{v}_normal": (F.sum(f"_{v}_calm").over(same_time) - F.col(f"_{v}_calm")).cast("int") for v in variables})
    # stations that move alike at the same time
    asks = {}
    for v in variables:
        f = F.col(f"{v}_f")
        asks[v] = flag((F.abs(f["dx"]) > 0.05) & (F.abs(f["z"]) < 2) & (f["peer_count"] >= 2) & (F.abs(f["dx"]) / f["rate_scale"] >= 3) & (F.abs(f["peer_dx"] - f["dx"]) <= 0.25 * F.abs(f["dx"])))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"{v}_f.dx").alias("dx"), asks[v].alias("asks")) for v in variables)))
    rows = stage(rows.drop(*(f"_{v}_calm" for v in variables)), "features")
    alike_by = band_counts(rows.select(STATION, TIME, each.alias("e")).select(STATION, TIME, "e.*")).groupBy(STATION, TIME).agg(
        *(F.max(F.when(F.col("variable") == v, F.col("alike"))).alias(f"_{v}_alike") for v in variables))
    rows = rows.join(alike_by, [STATION, TIME], "left")
    candidates, movers = [], []
    for i, v in enumerate(variables):
        f, kind = F.col(f"{v}_f"), _kind(F.col(f"{v}_f"), F.col(v).cast("double"))
        order = F.array_position(F.array(*map(F.lit, PRECEDENCE)), kind)
        candidates.append(F.when(kind.isNotNull(), F.struct(
            order.alias("order"), (-F.coalesce(F.abs(f["z"]), F.lit(0.0))).alias("weaker"), F.lit(i).alias("place"), kind.alias("diagnosis"), F.lit(v).alias("variable"),
            f["z"].alias("z"), F.coalesce(f["peer_count"], F.lit(0)).alias("peer_count"), F.col(f"_{v}_normal").alias("normal_peers"))))
        dx, alike = f["dx"], (F.col(f"_{v}_alike") - 1).cast("int")
        moves = alike >= 2
        movers.append(F.when(flag(moves), F.struct(F.lit(v).alias("variable"), alike.alias("stations"), dx.alias("step"), f["peer_dx"].alias("peer_step"))))
    rows = rows.withColumns({"_candidates": F.array_sort(F.array_compact(F.array(*candidates))), "_mover": F.coalesce(*movers)})
    best = F.get("_candidates", 0)
    kind = F.coalesce(best["diagnosis"], F.lit("UNCLASSIFIED_ANOMALY"))
    fault = flag((F.abs(best["z"]) >= 3) & (best["peer_count"] >= 2) & (best["normal_peers"] >= 2))
    environment = ~fault & (kind != "DATA_DROPOUT") & F.col("_mover").isNotNull()
    lookup = lambda table, default: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for item in table.items() for x in item)), kind), F.lit(default))
    alerted = F.col("final_alert")
    reason = F.concat(lookup(REASONS, ""), F.when(environment, " Other stations and the neighbours' mean move alike.").otherwise(""))
    # the shape of the variable that decided
    shape = F
    for v in variables:
        shape = shape.when(best["variable"] == v, F.struct(*(F.col(f"{v}_f")[k].alias(k) for k in SHAPE)))
    evidence = F.to_json(F.struct(
        F.transform("_candidates", lambda c: F.struct(c["diagnosis"].alias("diagnosis"), c["normal_peers"].alias("normal_peers"), c["variable"].alias("variable"), c["z"].alias("z"))).alias("candidates"),
        F.lit(False).alias("confidence_is_probability"), F.when(environment, F.col("_mover")).alias("movement"), F.array(*map(F.lit, PRECEDENCE)).alias("precedence"), shape.otherwise(None).alias("shape"), F.lit(1).alias("spike_lookahead_hours")))
    return rows.select(
        *df.columns, F.when(alerted, kind).alias("diagnosis"), F.when(alerted, best["variable"]).alias("diagnosis_variable"), F.when(alerted, lookup(CONFIDENCE, 0.0)).alias("diagnosis_confidence"),
        F.when(alerted & fault, "SENSOR_FAULT").when(alerted & environment, "POSSIBLE_ENVIRONMENTAL_EVENT").otherwise("UNCERTAIN").alias("operational_class"),
        F.when(alerted, reason).otherwise("Without an alert nothing is diagnosed.").alias("diagnosis_reason"), F.when(alerted, evidence).otherwise("{}").alias("diagnosis_evidence"))


def diagnose_fused(fused: DataFrame, reference: DataFrame | None, reference_end: str | None = None, check: bool = True) -> DataFrame:
    """Diagnosis of fused detector output: the spatial expectations are the neighbours' view. Without a reference all shapes abstain.

    Columns of truth (``is_anomaly``, ``anomaly_*``, ``*_original``) pass by and play no part.
    """
    peers = {f"behavior_peer_{name}_{v}": F.col(f"{v}_spatial_{column}") for v in VARIABLES for name, column in (("expected", "expected"), ("count", "neighbor_count"))
             if f"{v}_spatial_{column}" in fused.columns}
    spark = fused.sparkSession
    empty = reference is None
    if empty:
        reference = spark.createDataFrame([], f"{STATION} string, variable string, " + ", ".join(f"{p} double" for p in PARAMETERS))
    out = diagnose(fused.withColumns(peers), reference, reference_end, check)
    return out.drop(*peers).withColumn("diagnosis_reference_status", F.lit("missing: shape rules abstain" if empty else "available"))
