"""Synthetic faults with known truth.

Where the faults go is decided by hashes of (seed, station, variable, slot): the
time of each station and variable is cut into slots of ``slot`` rows, and a slot
holds at most one fault, wholly inside it. So faults never overlap, the plan needs
no sequential pass, and it is the same on any cluster.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAD_FACTOR, STATION, TIME, VARIABLES
from ..functions.scalar import is_finite, r6, uniform, with_medians
from ..sources.tables import InvalidData, require_columns
from . import timeline

# Shares of fault types and severities, and the strength bands (low, high) by type and severity.
TYPE_SHARES = (("spike", 0.20), ("offset", 0.20), ("drift", 0.15), ("stuck", 0.15), ("noise", 0.10), ("dropout", 0.05), ("rate_change", 0.15))
SEVERITY_SHARES = (("low", 0.25), ("medium", 0.50), ("high", 0.25))
STRENGTHS = {
    "spike": {"low": (2.0, 3.0), "medium": (3.5, 5.0), "high": (5.5, 8.0)}, "offset": {"low": (1.5, 2.5), "medium": (3.0, 5.0), "high": (5.5, 8.0)},
    "drift": {"low": (1.5, 2.5), "medium": (3.0, 5.0), "high": (5.5, 8.0)}, "noise": {"low": (2.0, 3.0), "medium": (3.5, 5.5), "high": (6.0, 9.0)},
    "rate_change": {"low": (2.0, 3.0), "medium": (3.5, 5.0), "high": (5.5, 8.0)},
}
FALLBACK_SCALES = {"temperature": 0.5, "humidity": 3.0, "pressure": 0.5}


@dataclass(frozen=True)
class InjectionConfig:
    rate: float = 0.02
    seed: int = 42
    slot: int = 36
    longest: int = 12
    context: int = 72
    least_context: int = 12
    bounds: Mapping[str, tuple[float, float]] | None = None

    @property
    def chance(self) -> float:
        """Of a fault in a slot: gives ``rate`` of all rows when lengths average half of ``longest``, over three variables."""
        return min(1.0, self.rate * self.slot / (0.5 * self.longest) / 3)


def _choice(u: Column, shares) -> Column:
    total, out = 0.0, F
    for name, share in shares[:-1]:
        total += share
        out = out.when(u < round(total, 10), name)
    return out.otherwise(shares[-1][0])


def positions(obs: DataFrame) -> DataFrame:
    """``pos``: each station's rows from 0 on, by time."""
    return timeline.positions(obs).withColumn("pos", F.col(timeline.POSITION))


def plan(numbered: DataFrame, config: InjectionConfig = InjectionConfig(), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """event_id, station_id, variable, anomaly_type, severity, first_pos, last_pos, strength, sign."""
    slots = numbered.groupBy(STATION).agg(F.count("*").alias("n")).select(
        STATION, F.explode(F.array(*map(F.lit, variables))).alias("variable"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.col("n") / config.slot) - 1))).alias("slot"), "n")
    slots = slots.where((F.col("slot") + 1) * config.slot <= F.col("n"))
    u = lambda what: uniform(F.lit(str(config.seed)), F.col(STATION), F.col("variable"), F.col("slot").cast("string"), F.lit(what))
    events = slots.where(u("place") < config.chance).withColumns({"anomaly_type": _choice(u("type"), TYPE_SHARES), "severity": _choice(u("severity"), SEVERITY_SHARES)})
    length = F.when(F.col("anomaly_type") == "spike", 1).otherwise(2 + F.floor(u("length") * (config.longest - 1)).cast("int"))
    events = events.withColumn("duration", length)
    first = F.col("slot") * config.slot + F.floor(u("start") * (config.slot - F.col("duration") + 1))
    band = F
    for kind, levels in STRENGTHS.items():
        for level, (low, high) in levels.items():
            band = band.when((F.col("anomaly_type") == kind) & (F.col("severity") == level), low + (high - low) * u("strength"))
    return events.select(
        F.concat_ws("-", F.lit("event"), F.col(STATION), F.col("variable"), F.lpad(F.col("slot").cast("string"), 6, "0")).alias("event_id"), STATION, "variable", "anomaly_type", "severity",
        first.cast("long").alias("first_pos"), (first + F.col("duration") - 1).cast("long").alias("last_pos"), r6(band.otherwise(0.0)).alias("strength"),
        F.when(u("sign") < 0.5, -1.0).otherwise(1.0).alias("sign"))


def local_scales(numbered: DataFrame, events: DataFrame, config: InjectionConfig = InjectionConfig(), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """The events with ``local_scale`` (robust deviation), ``local_delta_scale`` (95th percentile of steps) and ``local_noise_scale`` of the rows before them."""
    value = F
    for v in variables:
        value = value.when(F.col("variable") == v, F.col(v))
    before = events.select("event_id", STATION, "variable", F.explode(F.sequence(F.greatest(F.lit(0), F.col("first_pos") - config.context), F.col("first_pos") - 1)).alias("pos"))
    seen = before.join(numbered, [STATION, "pos"]).withColumn("x", value.otherwise(None)).where(is_finite(F.col("x")))
    series = seen.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("xs"))
    deltas = F.transform(F.sequence(F.lit(1), F.size("xs") - 1), lambda i: F.get("xs", i) - F.get("xs", i - 1))
    series = series.withColumn("ds", F.when(F.size("xs") >= 2, deltas).otherwise(F.array().cast("array<double>")))
    fallback = F
    for v in variables:
        fallback = fallback.when(F.col("variable") == v, F.lit(FALLBACK_SCALES.get(v, 1.0)))
    fallback = fallback.otherwise(1.0)
    floor = F.greatest(fallback * 0.1, F.lit(1e-6))

    def robust(name: str) -> Column:
        xs, scale = F.col(name), MAD_FACTOR * F.col(f"{name}_mad")
        mean = F.col(f"{name}_mean")
        sd = F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(xs))
        return F.greatest(F.coalesce(F.when(scale > 1e-12, scale), F.when(sd > 1e-12, sd), fallback), floor)

    ordered = F.sort_array(F.transform("ds", lambda x: F.abs(x)))
    at = 0.95 * (F.size("ds") - 1)
    low = F.get(ordered, F.floor(at).cast("int"))
    q95 = low + (F.get(ordered, F.ceil(at).cast("int")) - low) * (at - F.floor(at))
    rows = events.join(series, "event_id", "left").withColumns({"xs": F.coalesce("xs", F.array().cast("array<double>")), "ds": F.coalesce("ds", F.array().cast("array<double>"))})
    rows = with_medians(rows, {"xs": F.col("xs"), "ds": F.col("ds")})
    rows = rows.withColumns({f"{c}_mean": F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(c), F.lit(0)) for c in ("xs", "ds")})
    return rows.select(
        *events.columns, r6(F.when(F.size("xs") > 0, robust("xs")).otherwise(fallback)).alias("local_scale"),
        r6(F.when(F.size("ds") > 0, F.greatest(F.when(q95 > 1e-12, q95).otherwise(fallback), floor)).otherwise(fallback)).alias("local_delta_scale"),
        r6(F.when(F.size("ds") >= 2, robust("ds")).otherwise(fallback)).alias("local_noise_scale"))


def inject(obs: DataFrame, config: InjectionConfig = InjectionConfig(), variables: tuple[str, ...] = VARIABLES, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The observations with faults and truth columns, and the log of the faults.

    Truth: ``{v}_original``, ``is_anomaly``, and ``anomaly_id``, ``anomaly_type``, ``anomaly_variable``, ``anomaly_severity``, joined with ``|``
    where several variables fail at once. A stuck fault that would hardly show (natural range under half of the local scale) is left out.
    Missing columns, variables without a known scale and empty tables are refused.
    """
    require_columns(obs, [STATION, TIME, *variables])
    unknown = sorted(set(variables) - set(FALLBACK_SCALES))
    if unknown or not variables:
        raise InvalidData(f"no faults are known for {unknown}" if unknown else "no variables")
    if obs.isEmpty():
        raise InvalidData("no observations")
    numbered = positions(obs)
    events = local_scales(numbered, plan(numbered, config, variables) if events is None else events, config, variables)
    rows = events.select("*", F.explode(F.sequence("first_pos", "last_pos")).alias("pos")).join(numbered.select(STATION, "pos", TIME, *variables), [STATION, "pos"])
    value = F
    for v in variables:
        value = value.when(F.col("variable") == v, F.col(v))
    rows = rows.withColumn("x", value.otherwise(None))
    whole = Window.partitionBy("event_id")
    spread = F.max("x").over(whole) - F.min("x").over(whole)
    start = F.first("x").over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumns({"_spread": spread, "_start": start, "k": F.col("pos") - F.col("first_pos")})
    rows = rows.where((F.col("anomaly_type") != "stuck") | (F.col("_spread") >= F.greatest(0.5 * F.col("local_scale"), F.lit(1e-6))))
    kind, x, push = F.col("anomaly_type"), F.col("x"), F.col("sign") * F.col("strength")
    wobble = 2 * uniform(F.lit(str(config.seed)), F.col("event_id"), F.col("k").cast("string"), F.lit("noise")) - 1
    new = (
        F.when(kind == "spike", x + push * F.col("local_delta_scale")).when(kind == "offset", x + push * F.col("local_scale"))
        .when(kind.isin("drift", "rate_change"), x + push * F.col("local_delta_scale") * F.col("k")).when(kind == "stuck", F.col("_start"))
        .when(kind == "noise", x + F.col("strength") * F.col("local_noise_scale") * F.sqrt(F.lit(3.0)) * wobble)
    )
    if config.bounds:
        for v, (low, high) in config.bounds.items():
            new = F.when((F.col("variable") == v) & new.isNotNull(), F.least(F.greatest(new, F.lit(low)), F.lit(high))).otherwise(new)
    rows = rows.withColumn("new", r6(new))
    named = F.sort_array(F.collect_list(F.struct("variable", "event_id", "anomaly_type", "severity", "new")))
    hit = rows.groupBy(STATION, "pos").agg(named.alias("_hit"))
    packed = {"anomaly_id": "event_id", "anomaly_type": "anomaly_type", "anomaly_variable": "variable", "anomaly_severity": "severity"}
    here = lambda v: F.get(F.filter("_hit", lambda h: h["variable"] == v), 0)
    out = numbered.select(*obs.columns, "pos").join(hit, [STATION, "pos"], "left").withColumns({f"{v}_original": F.col(v) for v in variables} | {"is_anomaly": F.col("_hit").isNotNull()})
    out = out.withColumns({v: F.when(here(v).isNotNull(), here(v)["new"]).otherwise(F.col(v)) for v in variables} | {
        name: F.array_join(F.col(f"_hit.{field}"), "|") for name, field in packed.items()}).drop("_hit", "pos")
    log = rows.groupBy("event_id", "anomaly_type", "severity", STATION, "variable").agg(
        F.min(TIME).alias("start_time"), F.max(TIME).alias("end_time"), F.count("*").cast("int").alias("duration_rows"), F.first("strength").alias("normalized_strength"),
        F.first("local_scale").alias("local_scale"), F.first("local_delta_scale").alias("local_delta_scale"),
        r6(F.coalesce(F.max(F.abs(F.col("new") - F.col("x"))), F.lit(0.0))).alias("total_displacement"))
    return out, log


def summary(log: DataFrame) -> DataFrame:
    """Events, rows and medians by fault type."""
    return log.groupBy("anomaly_type").agg(
        F.count("*").alias("events"), F.sum("duration_rows").alias("rows"), r6(F.percentile("duration_rows", F.lit(0.5))).alias("median_rows"),
        r6(F.percentile("normalized_strength", F.lit(0.5))).alias("median_strength"))


def counts_by(log: DataFrame) -> DataFrame:
    """Events by type, severity and variable: kind, value, events."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("anomaly_type", "severity", "variable"))))
    return log.select(each.alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("events"))


def achieved_rate(rows: DataFrame, log: DataFrame) -> DataFrame:
    """One row: observations, anomalous ones and their rate in percent, events, median length and strength."""
    seen = rows.agg(F.count("*").alias("observations"), F.count_if("is_anomaly").alias("anomalous")).withColumn("rate_percent", F.round(100 * F.col("anomalous") / F.nullif(F.col("observations"), F.lit(0)), 4))
    told = log.agg(F.count("*").alias("events"), r6(F.percentile("duration_rows", F.lit(0.5))).alias("median_rows"), r6(F.percentile("normalized_strength", F.lit(0.5))).alias("median_strength"))
    return seen.crossJoin(told)  # one row each


def stable_ids(log: DataFrame) -> DataFrame:
    """``stable_id``: event-000001 and so on by start, station and variable."""
    order = Window.orderBy("start_time", STATION, "variable")  # the log holds a row for each event
    return log.withColumn("stable_id", F.format_string("event-%06d", F.row_number().over(order)))
