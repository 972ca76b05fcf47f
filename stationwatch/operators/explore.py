"""Profiles, correlations, snapshots and the dashboard's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import STATION, TIME, VARIABLES
from ..sources.tables import stage
from ..functions.scalar import by_time, flag, r6
from . import timeline
from .order import order_statistics
from .series import correlations



def profile(obs: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    return obs.agg(F.count("*").alias("rows"), F.count_distinct(STATION).alias("stations"), F.min(TIME).alias("first"), F.max(TIME).alias("last"), *(F.count_if(F.col(v).isNull()).alias(f"{v}_nulls") for v in variables))


def table_profile(obs: DataFrame) -> DataFrame:
    """One row for each column: its type and how many values are there."""
    counted = obs.agg(F.count("*").alias("_rows"), *(F.count(c).alias(c) for c in obs.columns)).unpivot(["_rows"], obs.columns, "column", "present")
    kinds = F.create_map(*(F.lit(x) for item in obs.dtypes for x in item))
    return counted.select("column", F.element_at(kinds, F.col("column")).alias("type"), "present", r6(F.coalesce(F.col("present") / F.nullif(F.col("_rows"), F.lit(0)), F.lit(0.0))).alias("coverage"))


def rows_by_station(obs: DataFrame) -> DataFrame:
    return obs.groupBy(STATION).agg(F.count("*").alias("rows"), F.min(TIME).alias("first"), F.max(TIME).alias("last"))


def describe(obs: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, one row for each variable."""
    long = obs.unpivot([], list(variables), "variable", "x")
    told = long.groupBy("variable").agg(
        F.count("x").alias("n"), r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x")).alias("std"), r6(F.min("x")).alias("low"), r6(F.max("x")).alias("high"))
    quartiles = order_statistics(long, "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by=("variable",))
    return told.join(quartiles.select("variable", *(r6(q).alias(q) for q in ("q25", "q50", "q75"))), "variable", "left")


def daily_means(obs: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    return obs.groupBy(STATION, F.date_trunc("day", TIME).alias("day")).agg(*(F.avg(v).alias(v) for v in variables))


def wide(obs: DataFrame, variable: str, stations: list[str]) -> DataFrame:
    """Times by stations."""
    return obs.groupBy(TIME).pivot(STATION, stations).agg(F.first(variable))


def correlation_summary(obs: DataFrame, variable: str) -> DataFrame:
    """One row: least, greatest and mean correlation of two different stations."""
    found = correlations(obs, variable)
    return found.agg(F.count("*").alias("pairs"), F.min("correlation").alias("low"), F.max("correlation").alias("high"), F.round(F.avg("correlation"), 4).alias("mean"))


def spread_by_time(obs: DataFrame, variable: str) -> DataFrame:
    x = F.col(variable)
    return obs.groupBy(TIME).agg(F.count(x).alias("n"), r6(F.min(x)).alias("low"), r6(F.max(x)).alias("high"), r6(F.avg(x)).alias("mean"), r6(F.stddev_samp(x)).alias("std"), r6(F.max(x) - F.min(x)).alias("range"))


def spread_percentiles(obs: DataFrame, variable: str, percents: tuple[float, ...] = (25, 50, 75, 90, 95, 99)) -> DataFrame:
    """One row: how the range over the stations of one time is distributed over the times."""
    x, spread = F.col("range"), spread_by_time(obs, variable)
    told = spread.agg(F.count(x).alias("times"), r6(F.avg(x)).alias("mean"), r6(F.stddev_samp(x)).alias("std"), r6(F.min(x)).alias("low"), r6(F.max(x)).alias("high"))
    found = order_statistics(spread, x, {f"p{p:g}": p / 100 for p in percents})
    return told.crossJoin(found.select(*(r6(f"p{p:g}").alias(f"p{p:g}") for p in percents)))  # one row each


def snapshot(obs: DataFrame, at: str) -> DataFrame:
    return obs.where(F.col(TIME) == F.lit(at).cast(dict(obs.dtypes)[TIME]))


def busiest_station(obs: DataFrame) -> DataFrame:
    """The station with most rows: a top-1 report."""
    return obs.groupBy(STATION).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), STATION).limit(1)


def first_rows(obs: DataFrame, n: int) -> DataFrame:
    """The first n rows by station and time: a head report."""
    return obs.orderBy(STATION, TIME).limit(n)


def split_by_position(obs: DataFrame, share: float = 0.8) -> DataFrame:
    """``part``: train for the first rows of each station, test for the others."""
    n = F.count("*").over(Window.partitionBy(STATION))
    return obs.withColumn("part", F.when(F.row_number().over(by_time()) <= F.floor(n * share), "train").otherwise("test"))


def scaled(obs: DataFrame, variables: tuple[str, ...] = VARIABLES, share: float = 0.8) -> DataFrame:
    """``part`` and ``{v}_scaled``: readings by mean and population deviation of their station's training part; a deviation of 0 counts as 1."""
    rows = split_by_position(obs, share)
    own = rows.where("part = 'train'").groupBy(STATION).agg(*(c for v in variables for c in (F.avg(v).alias(f"_{v}_mean"), F.stddev_pop(v).alias(f"_{v}_std"))))
    by = lambda v: F.when(F.col(f"_{v}_std") > 0, F.col(f"_{v}_std")).otherwise(1.0)
    out = rows.join(own, STATION, "left").withColumns({f"{v}_scaled": F.round((F.col(v) - F.col(f"_{v}_mean")) / by(v), 4) for v in variables})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def window_counts(obs: DataFrame, sizes: tuple[int, ...] = (12, 24, 48), share: float = 0.8) -> DataFrame:
    """How many whole windows of each size a station's training and test parts hold."""
    counted = split_by_position(obs, share).groupBy(STATION, "part").agg(F.count("*").alias("n"))
    return counted.select(STATION, "part", F.explode(F.array(*map(F.lit, sizes))).alias("size"), "n").select(STATION, "part", "size", F.greatest(F.col("n") - F.col("size") + 1, F.lit(0)).alias("windows"))


def window_errors(rebuilt: DataFrame, variables: tuple[str, ...], quantile: float = 0.99) -> DataFrame:
    """One row: mean squared error of whole windows, its quantile, and how many windows exceed that."""
    gap = lambda v: F.aggregate(F.zip_with(f"{v}_cells", f"{v}_rebuilt", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x) / F.size(f"{v}_cells")
    errors = rebuilt.select(r6(sum((gap(v) for v in variables), F.lit(0.0)) / len(variables)).alias("mse"))
    errors = stage(errors, "window-errors")
    limit = order_statistics(errors, "mse", {"_limit": quantile}).select("_limit")
    return errors.crossJoin(F.broadcast(limit)).agg(F.count("*").alias("windows"), F.round(F.avg("mse"), 4).alias("mean"), r6(F.first("_limit")).alias("threshold"), F.count_if(F.col("mse") > F.col("_limit")).alias("flagged"))  # one row


def window_labels(rows: DataFrame, size: int = 24) -> DataFrame:
    """Whole windows of ``size`` rows by station: whether they hold an anomaly and whether one is predicted (``predicted`` column)."""
    ahead = by_time().rowsBetween(0, size - 1)
    found = rows.select(
        STATION, TIME, F.count("*").over(ahead).alias("n"), F.max(flag(F.col("is_anomaly")).cast("int")).over(ahead).alias("truth"), F.max(flag(F.col("predicted")).cast("int")).over(ahead).alias("hit"))
    return found.where(F.col("n") == size).groupBy("truth", "hit").agg(F.count("*").alias("windows"))


def latest_status(rows: DataFrame, index: int | None = None) -> DataFrame:
    """Each station's row at ``index`` (its newest if none): colour, agreeing detectors, readings."""
    numbered = rows.withColumns({"idx": F.row_number().over(by_time()) - 1, "_n": F.count("*").over(Window.partitionBy(STATION))})
    here = numbered.where(F.col("idx") == (F.lit(index) if index is not None else F.col("_n") - 1))
    colour = F.when(F.col("final_alert"), "red").when(F.col("final_severity") == "suspicious", "yellow").otherwise("green")
    agreeing = F.array_join(F.array_compact(F.array(*(F.when(flag(F.col(a)), F.lit(a.removesuffix("_alert"))) for a in ("statistical_alert", "spatial_alert", "lstm_ae_alert")))), ",")
    return here.select(STATION, TIME, "idx", colour.alias("colour"), agreeing.alias("agreeing"), *(F.round(v, 2).alias(v) for v in VARIABLES), "final_severity")


def station_coordinates(rows: DataFrame) -> DataFrame:
    """The place in each station's first row."""
    return rows.groupBy(STATION).agg(F.min_by("latitude", TIME).alias("latitude"), F.min_by("longitude", TIME).alias("longitude"))


def shared_length(rows: DataFrame) -> DataFrame:
    """One row: how many steps a replay has, the rows of the shortest station."""
    return rows.groupBy(STATION).count().agg(F.coalesce(F.min("count"), F.lit(0)).alias("n_points"))


def map_table(status: DataFrame, places: DataFrame) -> DataFrame:
    """Current status by station with its place, readings to one digit, and the map's centre in every row."""
    centre = places.agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    joined = status.join(places, STATION).crossJoin(F.broadcast(centre))  # one row
    return joined.select(STATION, "colour", "latitude", "longitude", *((F.floor(F.col(v) * 10 + 0.5) / 10).alias(v) for v in VARIABLES), F.round("lat", 4).alias("centre_latitude"), F.round("lon", 4).alias("centre_longitude"))


def newest_alerts(log: DataFrame, n: int) -> DataFrame:
    """The last n entries of an alert log, newest first, with their place: a top-n report."""
    newest = log.orderBy(F.desc(TIME), STATION).limit(n)
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.desc(TIME), STATION)))  # n rows


def alert_totals(status: DataFrame, log: DataFrame) -> DataFrame:
    """Status counts of the current rows, and how many alerts were logged in all."""
    return status_counts(status).crossJoin(log.agg(F.count("*").alias("alerts_logged")))  # one row each


def stale_explanations(current: DataFrame, stored: DataFrame) -> DataFrame:
    """station_id, timestamp and ``state`` of each current row's stored explanation (JSON column ``explanation``): fresh, missing, other decision or other readings."""
    kind = "decision struct<alert: boolean, votes: int, severity: string>, readings struct<" + ", ".join(f"{v}: double" for v in VARIABLES) + ">"
    told = stored.select(STATION, TIME, F.from_json("explanation", kind).alias("_told"))
    d, r = F.col("_told.decision"), F.col("_told.readings")
    decision = d["alert"].eqNullSafe(F.col("final_alert")) & d["votes"].eqNullSafe(F.col("detector_votes")) & d["severity"].eqNullSafe(F.col("final_severity"))
    readings = F.lit(True)
    for v in VARIABLES:
        readings = readings & r[v].eqNullSafe(F.col(v))
    state = F.when(F.col("_told").isNull(), "missing").when(~decision, "other decision").when(~readings, "other readings").otherwise("fresh")
    return current.join(told, [STATION, TIME], "left").select(STATION, TIME, state.alias("state"))


def status_counts(status: DataFrame) -> DataFrame:
    return status.agg(*(F.count_if(F.col("colour") == c).alias(c) for c in ("green", "yellow", "red")))


def alert_log(rows: DataFrame) -> DataFrame:
    """Suspicious and alerted rows with their index within the station, which counts times: a repeated row is logged once, as its first severity by name says."""
    once = rows.groupBy(STATION, TIME).agg(F.min(F.struct("final_severity", "detector_votes")).alias("_first")).select(STATION, TIME, "_first.*")
    numbered = timeline.positions(once).withColumn("idx", F.col(timeline.POSITION).cast("int"))
    return numbered.where((F.col("final_severity") != "normal")).select(STATION, TIME, "idx", "final_severity", "detector_votes")


def station_history(rows: DataFrame, station: str, until: int) -> DataFrame:
    numbered = rows.where(F.col(STATION) == station).withColumn("idx", F.row_number().over(by_time()) - 1)
    return numbered.where(F.col("idx") <= until)


def traffic_light(rows: DataFrame, limits: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """Worst of the variables' lights: red outside the outer limits, yellow outside the inner ones."""
    grade = lambda v, a, b, c, d: F.when((F.col(v) < a) | (F.col(v) > d), 2).when((F.col(v) < b) | (F.col(v) > c), 1).otherwise(0)
    worst = F.greatest(F.lit(0), F.lit(0), *(grade(v, *bounds) for v, bounds in limits.items()))
    return rows.withColumn("light", F.element_at(F.array(F.lit("green"), F.lit("yellow"), F.lit("red")), worst + 1))
