"""Spatial detector: each reading against a robust distance-weighted mean of its neighbours'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAD_FACTOR, STATION, TIME, VARIABLES, SpatialConfig
from ..functions.scalar import any_true, count_true, flag, haversine_km, is_finite, r6, with_medians
from ..sources.tables import stage

#: A cell of the grid should hold no more stations than so many times the neighbours wanted.
CROWD = 32
#: Halvings of the cell that an even spread of stations would need.
FINER = 12
#: Chords closer than this (on a sphere of radius 1) count as equal; it is below the last digit of a distance.
SLACK = 1e-9


def neighbours(stations: DataFrame, config: SpatialConfig = SpatialConfig()) -> DataFrame:
    """station_id, neighbor_id, rank, distance_km, weight: the nearest stations with inverse-distance weights that sum to 1.

    ``stations`` has one row for each station; ties go by name. Stations lie in the cells
    of a grid in space, where neither poles nor the date line are special: those
    in the cells around a station are all that are closer than a cell is wide.
    Where these are enough they are final; the other stations look again in
    cells of twice the width, until the cells hold the whole globe.
    """
    lat, lon = F.radians("latitude"), F.radians("longitude")
    points = stage(stations.select(
        STATION, "latitude", "longitude", (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z")), "points")
    width = _cell_width(points, config.neighbours)
    open_, found = points, None
    while True:
        near = stage(_candidates(open_, points, width, config.neighbours), "near")
        whole_globe = width >= 2.0
        enough = near.groupBy(STATION).agg(F.count("*").alias("n"), F.max("chord").alias("far")).where((F.col("n") >= config.neighbours) & (F.col("far") + SLACK <= width)).select(STATION)
        final = near if whole_globe else near.join(enough, STATION, "left_semi")
        found = final if found is None else found.unionByName(final)
        if whole_globe:
            break
        open_ = stage(open_.join(enough, STATION, "left_anti"), "open")
        if open_.isEmpty():
            break
        width *= 2
    kept = found.withColumn("_w", 1 / F.pow(F.greatest("distance_km", F.lit(1e-6)), F.lit(config.power)))
    return kept.select(STATION, "neighbor_id", "rank", "distance_km", (F.col("_w") / F.sum("_w").over(Window.partitionBy(STATION))).alias("weight"))


def _cell(width: float) -> list[Column]:
    return [F.floor(F.col(c) / F.lit(width)).cast("long") for c in ("x", "y", "z")]


def _cell_width(points: DataFrame, neighbours: int) -> float:
    """The widest cell, of those an even spread would need and its halvings, that holds no crowd; the finest if all do."""
    n = points.count()
    even = min(2.0, 2 * (neighbours / max(n, 1)) ** 0.5)
    if n <= CROWD * neighbours:
        return 2.0
    sizes = points.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), *(c.alias(f"c{i}") for i, c in enumerate(_cell(even / 2**k)))) for k in range(FINER)))).alias("c")).select("c.*")
    most = {r["k"]: r["most"] for r in sizes.groupBy("k", "c0", "c1", "c2").count().groupBy("k").agg(F.max("count").alias("most")).collect()}  # FINER rows
    return even / 2 ** next((k for k in range(FINER) if most[k] <= CROWD * neighbours), FINER - 1)


def _candidates(open_: DataFrame, points: DataFrame, width: float, neighbours: int) -> DataFrame:
    """The nearest stations of each open one among those in its cell and the 26 around, ranked."""
    mine = open_.select("*", F.struct(*(c.alias(f"c{i}") for i, c in enumerate(_cell(width)))).alias("c"))
    moves = F.explode(F.array(*(F.struct(*((F.col(f"c.c{i}") + d).alias(f"c{i}") for i, d in enumerate((a, b, c)))) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1))))
    mine = mine.withColumn("around", moves).select(STATION, "latitude", "longitude", "x", "y", "z", "around.*")
    other = points.select(
        F.col(STATION).alias("neighbor_id"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), *(F.col(c).alias(f"_{c}") for c in "xyz"), *(c.alias(f"c{i}") for i, c in enumerate(_cell(width))))
    chord = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_{c}"), 2) for c in "xyz"), F.lit(0.0)))
    met = mine.join(other, ["c0", "c1", "c2"]).where(F.col(STATION) != F.col("neighbor_id"))
    distance = haversine_km(F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))
    order = Window.partitionBy(STATION).orderBy("distance_km", "neighbor_id")
    ranked = met.select(STATION, "neighbor_id", r6(distance).alias("distance_km"), chord.alias("chord")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= neighbours)


def expected(obs: DataFrame, graph: DataFrame, config: SpatialConfig = SpatialConfig(), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """station_id, timestamp and for each variable expected, neighbor_count and neighbor_mad from the neighbours' readings of that time.

    Every reading travels to its neighbours by the graph and meets
    theirs in one shuffle on (timestamp, station); at most ``neighbours`` values gather there.
    """
    averaged = obs.groupBy(STATION, TIME).agg(*(F.avg(F.when(is_finite(F.col(v)), F.col(v))).alias(v) for v in variables))
    sent = averaged.withColumnRenamed(STATION, "neighbor_id").join(graph, "neighbor_id")
    met = sent.groupBy(STATION, TIME).agg(F.sort_array(F.collect_list(F.struct("rank", "weight", *variables))).alias("near"))
    def pairs(v: str):
        return F.transform(F.filter("near", lambda p: p[v].isNotNull()), lambda p: F.struct(p[v].alias("x"), p["weight"].alias("w")))

    def close(v: str):
        middle, scale = F.col(f"_{v}_med"), F.col(f"_{v}_scale")
        limit = F.when(scale > config.least_scale, config.robust_limit * scale).otherwise(F.greatest(F.lit(1e-6), F.abs(middle) * 1e-6))
        return F.when(F.size(f"_{v}") >= 3, F.filter(f"_{v}", lambda p: F.abs(p["x"] - middle) <= limit)).otherwise(F.col(f"_{v}"))

    rows = met.withColumns({f"_{v}": pairs(v) for v in variables})
    rows = with_medians(rows, {f"_{v}": F.col(f"_{v}.x") for v in variables})
    rows = rows.withColumns({f"_{v}_scale": MAD_FACTOR * F.col(f"_{v}_mad") for v in variables})
    rows = rows.withColumns({f"_{v}_kept": close(v) for v in variables})
    out = []
    for v in variables:
        total = F.aggregate(f"_{v}_kept", F.lit(0.0), lambda a, p: a + p["w"])
        weighted = F.aggregate(f"_{v}_kept", F.lit(0.0), lambda a, p: a + p["x"] * p["w"])
        out += [r6(weighted / F.nullif(total, F.lit(0.0))).alias(f"{v}_spatial_expected"), F.size(f"_{v}_kept").alias(f"{v}_spatial_neighbor_count"), r6(F.col(f"_{v}_scale")).alias(f"{v}_spatial_neighbor_mad")]
    return rows.select(STATION, TIME, *out)


def with_residuals(obs: DataFrame, graph: DataFrame, config: SpatialConfig = SpatialConfig(), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    joined = obs.join(expected(obs, graph, config, variables), [STATION, TIME], "left")
    return joined.withColumns({f"{v}_spatial_residual": r6(F.col(v) - F.col(f"{v}_spatial_expected")) for v in variables} | {
        f"{v}_spatial_neighbor_count": F.coalesce(f"{v}_spatial_neighbor_count", F.lit(0)) for v in variables})


def calibrate(history: DataFrame, graph: DataFrame, config: SpatialConfig = SpatialConfig(), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """station_id and for each variable the suspicious and anomalous limits of |residual|; null below the least number of rows."""
    rows = with_residuals(history, graph, config, variables)
    aggregates = []
    for v in variables:
        usable = F.col(f"{v}_spatial_neighbor_count") >= config.least_neighbours
        residual = F.when(usable, F.abs(f"{v}_spatial_residual"))
        quantiles = config.humidity_quantiles if v == "humidity" else config.quantiles
        for name, q in zip(("suspicious", "anomaly"), quantiles, strict=True):
            aggregates.append(F.when(F.count_if(usable) >= config.least_calibration_rows, r6(F.percentile(residual, F.lit(q)))).alias(f"{v}_{name}_limit"))
    return rows.groupBy(STATION).agg(*aggregates)


def detect(obs: DataFrame, graph: DataFrame, limits: DataFrame, config: SpatialConfig = SpatialConfig(), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """Expectation, residual, flags, severity and alert of every row. Humidity counts as a family but never decides severity."""
    rows = with_residuals(obs, graph, config, variables).join(limits, STATION, "left")
    rows = rows.withColumns({
        f"{v}_spatial_{name}": flag((F.col(f"{v}_spatial_neighbor_count") >= config.least_neighbours) & (F.abs(f"{v}_spatial_residual") > F.col(f"{v}_{name}_limit")))
        for v in variables for name in ("suspicious", "anomaly")})
    deciding = [v for v in variables if v != "humidity"]
    label = (
        F.when(any_true([F.col(f"{v}_spatial_anomaly") for v in deciding]), "anomaly")
        .when(any_true([F.col(f"{v}_spatial_suspicious") for v in deciding]), "suspicious").otherwise("normal")
    )
    out = rows.withColumns({"spatial_family_count": count_true([F.col(f"{v}_spatial_suspicious") for v in variables]), "spatial_severity_level": label})
    return out.withColumn("spatial_alert", F.col("spatial_severity_level") == "anomaly").drop(*(f"{v}_{name}_limit" for v in variables for name in ("suspicious", "anomaly")))


def regional_shift(obs: DataFrame, at: str, amount: float, variables: tuple[str, ...] = ("temperature",)) -> DataFrame:
    """All stations moved alike at one time: a spatial detector should stay silent."""
    return obs.withColumns({v: F.when(F.col(TIME) == F.lit(at).cast("timestamp"), F.col(v) + amount).otherwise(F.col(v)) for v in variables})
