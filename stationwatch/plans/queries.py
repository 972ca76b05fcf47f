"""Registered queries: every operator over the whole test tables, with the same result in SQL where SQL can say it."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..config import STATION, TIME, VARIABLES, FusionConfig, ReconstructionConfig, SpatialConfig, StatisticalConfig
from ..functions import scalar
from ..functions.scalar import flag, hour_label, r6, severity_score
from ..operators import diagnosis, evaluate, explain, explore, fusion, inject, neural, order, reconstruct, series, spatial, statistical, timeline
from ..sources import tables
from . import sql
from .calibration import model_of, model_table

V = VARIABLES
#: Columns of the wide table.
EVENT_STATIONS = ("click", "error", "purchase", "signup", "view")
EVENT_CUT, LINE_CUT = "2024-01-21 00:00:00", "1999-01-01 00:00:00"
EVENT_STAT = StatisticalConfig(ranges={"temperature": (0.5, 200.0), "humidity": (1.0, 8.0), "pressure": (1.0, 300.0)})
LINE_STAT = StatisticalConfig(windows=(24, 168), persistence_tolerance=0.001, ranges={"temperature": (2.0, 49.0), "humidity": (0.0, 0.1), "pressure": (2000.0, 102000.0)})
SPATIAL, RECON, FUSE, INJECT = SpatialConfig(), ReconstructionConfig(), FusionConfig(), inject.InjectionConfig()

#: What is kept under a fingerprint depends on the code that makes it.
VERSION = hashlib.sha256("".join(inspect.getsource(m) for m in (config, scalar, fusion, inject, reconstruct, spatial, statistical, timeline, order, tables)).encode()).hexdigest()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle is not None:
            ORACLES[function.__name__] = oracle
        return function

    return add


def out(df: DataFrame, *columns) -> DataFrame:
    """The columns, times as text so that time zones of engines don't matter."""
    df = df.select(*columns) if columns else df
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c, kind in df.dtypes if kind.startswith("timestamp")})


def before(df: DataFrame, cut: str) -> DataFrame:
    return df.where(F.col(TIME) < F.lit(cut).cast(dict(df.dtypes)[TIME]))


class Network:
    """One test network with its calibrated tables.

    The raw table is read, reduced to observations, checked, numbered and staged in one
    pass, which also sums up its contents. Every table that is learned from these
    is kept under that fingerprint and the settings: the first query that needs
    it makes it, later ones, of later runs with the same shared folder too, read it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, lines: bool, faults: bool = False):
        self.spark, self.lines, self.faults = spark, lines, faults
        loaded = tables.load(tables.daily_lines(spark, sf_dir) if lines else tables.hourly_events(spark, sf_dir), "observations")
        self.clean, self.rows = loaded.rows, loaded.count
        self.cut, self.config = LINE_CUT if lines else EVENT_CUT, LINE_STAT if lines else EVENT_STAT
        self.history = before(self.clean, self.cut)
        self.store = tables.Store(spark, [VERSION, loaded.digest, self.cut, self.config, SPATIAL, RECON, INJECT])
        self.obs = self.store.table("faulty", lambda: inject.inject(self.clean, INJECT)[0]) if faults else self.clean

    @cached_property
    def places(self) -> DataFrame:
        return self.store.table("places", lambda: tables.station_places(self.clean))

    @cached_property
    def graph(self) -> DataFrame:
        return self.store.table("graph", lambda: spatial.neighbours(self.places, SPATIAL))

    @cached_property
    def hourly(self) -> DataFrame:
        return self.store.table("hourly", lambda: statistical.calibrate(self.history, self.config))

    @cached_property
    def limits(self) -> DataFrame:
        return self.store.table("limits", lambda: spatial.calibrate(self.history, self.graph, SPATIAL))

    def recon_tables(self, linear: bool = False) -> reconstruct.ReconstructionTables:
        return self._linear_tables if linear else self._mean_tables

    @cached_property
    def _linear_tables(self) -> reconstruct.ReconstructionTables:
        return self._reconstruction("linear")

    @cached_property
    def _mean_tables(self) -> reconstruct.ReconstructionTables:
        return self._reconstruction("means")

    def _reconstruction(self, kind: str) -> reconstruct.ReconstructionTables:
        names = [f"{kind}-{part}" for part in ("normalisation", "bounds", "model")]
        found = [self.store.find(name) for name in names]
        if any(f is None for f in found):
            made = reconstruct.calibrate(self.history, RECON, kind == "linear")
            parts = made.stats, made.bounds, model_table(self.spark, made.model)
            found = [self.store.table(name, lambda part=part: part) for name, part in zip(names, parts, strict=True)]
        return reconstruct.ReconstructionTables(found[0], found[1], model_of(found[2]) if kind == "linear" else None)

    def statistical(self) -> DataFrame:
        return statistical.detect(self.obs, self.hourly, self.config)

    def spatial(self) -> DataFrame:
        return spatial.detect(self.obs, self.graph, self.limits, SPATIAL)

    def reconstruction(self, linear: bool = False) -> DataFrame:
        return reconstruct.detect(self.obs, self.recon_tables(linear), RECON)

    def fused(self, linear: bool = False) -> DataFrame:
        """The joined outputs, kept with the calibrations: evaluations, here and in later queries, aggregate them several times over."""
        name = f"fused-{'faulty' if self.faults else 'clean'}-{'linear' if linear else 'means'}"
        return fusion.vote(self.store.table(name, lambda: self._joined(linear)))

    def _joined(self, linear: bool) -> DataFrame:
        joined = fusion.join_outputs(self.obs, self.statistical(), self.spatial(), self.reconstruction(linear), check=False)
        return tables.stage_joined(joined, "fused", self.rows)


# ------------------------------------------------------------ parts of the SQL

EV = sql.EVENTS + sql.history("ev", EVENT_CUT)
EV_HOURLY = EV + sql.hourly("ev_hist", "ev_hourly", EVENT_STAT)
EV_STAT = EV_HOURLY + sql.statistical("ev", "ev_hourly", "ev_stat", EVENT_STAT)
EV_GRAPH = sql.graph("ev", "ev_graph", SPATIAL)
EV_RES = EV + EV_GRAPH + sql.residuals("ev", "ev_graph", "ev_res", SPATIAL)
EV_HRES = EV + EV_GRAPH + sql.residuals("ev_hist", "ev_graph", "ev_hres", SPATIAL)
EV_LIMITS = EV_HRES + sql.spatial_limits("ev_hres", "ev_limits", SPATIAL)
EV_SPAT = EV_RES + EV_LIMITS + sql.spatial("ev_res", "ev_limits", "ev_spat", SPATIAL)
LN = sql.LINES + sql.history("ln", LINE_CUT)
LN_NORM = LN + sql.normalisation("ln_hist", "ln_norm", RECON)
LN_WIN = LN_NORM + sql.windows("ln", "ln_norm", "ln_win", RECON)
LN_HELD = LN_NORM + sql.windows("ln_norm_held", "ln_norm", "ln_hwin", RECON) + sql.mean_scores("ln_hwin", "ln_held", RECON)
LN_BOUNDS = LN_HELD + sql.score_limits("ln_held", "ln_bounds", RECON)
LN_RECON = LN_WIN + LN_BOUNDS + sql.mean_scores("ln_win", "ln_scores", RECON) + sql.reconstruction("ln_win", "ln_scores", "ln_bounds", "ln_recon", RECON)
LN_INJ = LN + sql.injection("ln", "inj", INJECT)


def _all_detectors(obs: str, tag: str) -> sql.Part:
    return (
        LN_INJ + sql.hourly("ln_hist", "ln_hourly", LINE_STAT) + sql.statistical(obs, "ln_hourly", f"{tag}_stat", LINE_STAT) + sql.graph("ln", "ln_graph", SPATIAL)
        + sql.residuals(obs, "ln_graph", f"{tag}_res", SPATIAL) + sql.residuals("ln_hist", "ln_graph", "ln_hres", SPATIAL) + sql.spatial_limits("ln_hres", "ln_limits", SPATIAL)
        + sql.spatial(f"{tag}_res", "ln_limits", f"{tag}_spat", SPATIAL) + LN_BOUNDS + sql.windows(obs, "ln_norm", f"{tag}_win", RECON) + sql.mean_scores(f"{tag}_win", f"{tag}_scores", RECON)
        + sql.reconstruction(f"{tag}_win", f"{tag}_scores", "ln_bounds", f"{tag}_recon", RECON)
    )


TRUTH = ", s.is_anomaly, s.anomaly_id, s.anomaly_type, s.anomaly_variable, s.anomaly_severity"
CLEAN_FUSED = _all_detectors("ln", "cln") + sql.fused("cln_stat", "cln_spat", "cln_recon", "cfused")
FUSED = _all_detectors("inj", "flt") + sql.fused("flt_stat", "flt_spat", "flt_recon", "fused", TRUTH)
S = sql.STAMP


# ------------------------------------------------------------ ingest and scalars


@query(sql.with_(sql.EVENTS) + f"SELECT station_id, {S}, temperature, humidity, pressure FROM ev")
def obs_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(tables.detector_input(tables.hourly_events(spark, sf_dir)))


@query(sql.with_(sql.LINES) + f"SELECT station_id, {S}, temperature, humidity, pressure FROM ln")
def obs_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(tables.daily_lines(spark, sf_dir))


@query(sql.with_(sql.EVENTS) + "SELECT count(*) AS rows, count(DISTINCT station_id) AS stations, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last, "
       + sql.join(f"count(*) FILTER ({v} IS NULL) AS {v}_nulls" for v in V) + " FROM ev")
def ingest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(explore.profile(tables.hourly_events(spark, sf_dir)))


@query(sql.with_(sql.LINES) + "SELECT station_id, count(*) AS rows, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last FROM ln GROUP BY 1")
def rows_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(explore.rows_by_station(tables.daily_lines(spark, sf_dir)))


@query(sql.with_(sql.EVENTS) + f"""SELECT station_id, {S}, hour(timestamp)::INTEGER AS hour, month(timestamp)::INTEGER AS month, year(timestamp)::INTEGER AS year, date_trunc('hour', timestamp) = timestamp AS on_grid,
    CASE WHEN hour(timestamp) - 12 >= 0 THEN '+' ELSE '' END || CAST(hour(timestamp) - 12 AS VARCHAR) || 'h' AS noon_offset, round(CASE WHEN humidity >= 6 THEN 1.0 WHEN humidity >= 4 THEN 0.33 ELSE 0.0 END, 6)::DOUBLE AS score FROM ev""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.hourly_events(spark, sf_dir)
    label = F.when(F.col("humidity") >= 6, "critical").when(F.col("humidity") >= 4, "suspicious").otherwise("normal")
    return out(
        obs, STATION, TIME, F.hour(TIME).alias("hour"), F.month(TIME).alias("month"), F.year(TIME).alias("year"), (F.date_trunc("hour", TIME) == F.col(TIME)).alias("on_grid"),
        hour_label(F.hour(TIME) - 12).alias("noon_offset"), severity_score(label).alias("score"))


# ------------------------------------------------------------------ statistical


@query(sql.with_(EV_HOURLY) + "SELECT station_id, CAST(hour AS INTEGER) AS hour, " + sql.join(f"{v}_baseline, {v}_roc_limit" for v in V) + " FROM ev_hourly")
def hourly_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Network(spark, sf_dir, False).hourly


RANGE = [f"{v}_range_anomaly" for v in V]
RATES = [f"{v}_{k}" for v in V for k in ("rate_of_change", "roc_anomaly")]
RESIDUALS = [f"{v}_hourly_residual" for v in V]
SCORES = [f"{v}_zscore_{w}h{k}" for v in V for w in (24, 168) for k in ("", "_anomaly")]
STUCK = [f"{v}_persistence_anomaly" for v in V]
LADDER = [*(f"evidence_{f}" for f in statistical.FAMILIES), "statistical_flag_count", "statistical_family_count", "statistical_raw_alert", "statistical_severity_label", "statistical_severity", "statistical_alert"]


def _statistical(columns: list[str]) -> Query:
    return lambda spark, sf_dir: out(Network(spark, sf_dir, False).statistical(), STATION, TIME, *columns)


for _name, _columns in {"range_flags": RANGE, "rate_of_change": RATES, "hourly_residual": RESIDUALS, "rolling_zscore": SCORES, "persistence_flags": STUCK, "statistical_severity": LADDER}.items():
    QUERIES[_name] = _statistical(_columns)
    ORACLES[_name] = sql.with_(EV_STAT) + f"SELECT station_id, {S}, {sql.join(_columns)} FROM ev_stat"


@query(sql.with_(EV_STAT) + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, '{c}' AS check, count(*) FILTER ({v}_{c}_anomaly) AS alerts, round(count(*) FILTER ({v}_{c}_anomaly) / nullif(count(*), 0), 6) AS rate FROM ev_stat"
    for v in V for c in ("range", "roc", "zscore_24h", "zscore_168h", "persistence")))
def alert_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistical.alert_summary(Network(spark, sf_dir, False).statistical())


# ---------------------------------------------------------------------- spatial


@query(sql.with_(EV, EV_GRAPH) + "SELECT g.station_id, g.neighbor_id, g.rank, g.distance_km, round(g.weight, 6) AS weight, n.rows FROM ev_graph g JOIN (SELECT station_id, count(*) AS rows FROM ev GROUP BY 1) n ON g.neighbor_id = n.station_id")
def knn_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, False)
    seen = net.obs.groupBy(F.col(STATION).alias("neighbor_id")).agg(F.count("*").alias("rows"))
    return net.graph.withColumn("weight", r6("weight")).join(seen, "neighbor_id")


SPATIAL_COLUMNS = [f"{v}_spatial_{k}" for v in V for k in ("expected", "residual", "neighbor_count", "neighbor_mad")]
SPATIAL_FLAGS = [*(f"{v}_spatial_{k}" for v in V for k in ("suspicious", "anomaly")), "spatial_family_count", "spatial_severity_level", "spatial_alert"]


@query(sql.with_(EV_RES) + f"SELECT station_id, {S}, {sql.join(SPATIAL_COLUMNS)} FROM ev_res")
def idw_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, False)
    return out(spatial.with_residuals(net.obs, net.graph, SPATIAL), STATION, TIME, *SPATIAL_COLUMNS)


@query(sql.with_(EV_LIMITS) + "SELECT * FROM ev_limits")
def spatial_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, False)
    return net.limits


@query(sql.with_(EV_SPAT) + f"SELECT station_id, {S}, {sql.join(SPATIAL_FLAGS)} FROM ev_spat")
def spatial_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(Network(spark, sf_dir, False).spatial(), STATION, TIME, *SPATIAL_FLAGS)


SHIFT_AT = "2024-01-25 12:00:00"
SHIFTED = [("shifted", f"SELECT station_id, timestamp, CASE WHEN timestamp = TIMESTAMP '{SHIFT_AT}' THEN temperature + 6 ELSE temperature END AS temperature, humidity, pressure FROM ev")]


@query(sql.with_(EV, SHIFTED, EV_GRAPH, sql.residuals("shifted", "ev_graph", "sh_res", SPATIAL), EV_LIMITS, sql.spatial("sh_res", "ev_limits", "sh_spat", SPATIAL))
       + f"SELECT station_id, temperature_spatial_residual, temperature_spatial_anomaly FROM sh_spat WHERE timestamp = TIMESTAMP '{SHIFT_AT}'")
def regional_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, False)
    moved = spatial.regional_shift(net.obs, SHIFT_AT, 6.0)
    found = spatial.detect(moved, net.graph, net.limits, SPATIAL)
    return explore.snapshot(found, SHIFT_AT).select(STATION, "temperature_spatial_residual", "temperature_spatial_anomaly")


# --------------------------------------------------------------- reconstruction

NORM = [f"{v}_{k}" for v in RECON.variables for k in ("mean", "std")]


@query(sql.with_(LN_NORM) + f"SELECT station_id, n, {sql.join(NORM)} FROM ln_norm")
def norm_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, True)
    end = reconstruct.cutoff(net.history, RECON.validation_share)
    return reconstruct.normalisation(net.history.crossJoin(F.broadcast(end)).where(F.col(TIME) < F.col("cutoff")), RECON).select(STATION, "n", *NORM)


def _normal(net: Network) -> DataFrame:
    return reconstruct.normalise(net.obs, net.recon_tables().stats, RECON)


@query(sql.with_(LN_WIN) + f"SELECT station_id, {S}, {sql.join(f'{v}_z' for v in V)} FROM ln_win_n")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_normal(Network(spark, sf_dir, True)), STATION, TIME, *(f"{v}_z" for v in V))


@query(sql.with_(LN_WIN) + "SELECT station_id, step FROM ln_win_step")
def modal_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconstruct.modal_step(tables.daily_lines(spark, sf_dir))


@query(sql.with_(LN_WIN) + f"SELECT station_id, {S}, segment, pos FROM ln_win_s")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = tables.daily_lines(spark, sf_dir)
    return out(reconstruct.segments(obs, reconstruct.modal_step(obs), RECON), STATION, TIME, "segment", "pos")


@query(sql.with_(LN_WIN) + "SELECT station_id, segment, start, " + sql.join(f"round(list_aggregate({v}_cells, 'sum'), 6) AS {v}_sum, {v}_cells[24] AS {v}_last" for v in V) + " FROM ln_win")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, True)
    found = reconstruct.windows_of(net.obs, net.recon_tables().stats, RECON)
    total = lambda v: r6(F.aggregate(f"{v}_cells", F.lit(0.0), lambda a, x: a + x))
    return found.select(STATION, "segment", "start", *(c for v in V for c in (total(v).alias(f"{v}_sum"), F.get(f"{v}_cells", 23).alias(f"{v}_last"))))


GAPPY = [("gappy", "SELECT station_id, timestamp, CASE WHEN day(timestamp) IN (5, 6, 7) THEN NULL ELSE temperature END AS temperature, CASE WHEN day(timestamp) = 20 THEN NULL ELSE humidity END AS humidity, pressure FROM ln")]


@query(sql.with_(LN_NORM, GAPPY, sql.windows("gappy", "ln_norm", "gap_win", RECON)) + "SELECT station_id, segment, start, " + sql.join(f"round(list_aggregate({v}_cells, 'sum'), 6) AS {v}_sum" for v in V) + " FROM gap_win")
def window_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, True)
    day = F.dayofmonth(TIME)
    gappy = net.obs.withColumns({"temperature": F.when(~day.isin(5, 6, 7), F.col("temperature")), "humidity": F.when(day != 20, F.col("humidity"))})
    found = reconstruct.windows_of(gappy, net.recon_tables().stats, RECON)
    return found.select(STATION, "segment", "start", *(r6(F.aggregate(f"{v}_cells", F.lit(0.0), lambda a, x: a + x)).alias(f"{v}_sum") for v in V))


@query(sql.with_(LN_WIN, sql.mean_scores("ln_win", "ln_scores", RECON)) + f"SELECT station_id, {S}, coverage AS lstm_ae_coverage, {sql.join(f'{v}_lstm_ae_error' for v in V)} FROM ln_scores")
def window_to_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, True)
    rebuilt = reconstruct.window_mean(reconstruct.windows_of(net.obs, net.recon_tables().stats, RECON), RECON)
    return out(reconstruct.observation_scores(rebuilt, RECON), STATION, TIME, "lstm_ae_coverage", *(f"{v}_lstm_ae_error" for v in V))


@query(sql.with_(LN_BOUNDS) + "SELECT * FROM ln_bounds")
def recon_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Network(spark, sf_dir, True).recon_tables().bounds


RECON_COLUMNS = ["lstm_ae_scored", "lstm_ae_coverage", "lstm_ae_score", "lstm_ae_severity_label", "lstm_ae_severity_score", "lstm_ae_suspicious", "lstm_ae_alert", "lstm_ae_top_contributor",
                 *(f"{v}_lstm_ae_{k}" for v in V for k in ("error", "expected", "residual"))]


@query(sql.with_(LN_RECON) + f"SELECT station_id, {S}, {sql.join(RECON_COLUMNS)} FROM ln_recon")
def reconstruction_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(Network(spark, sf_dir, True).reconstruction(), STATION, TIME, *RECON_COLUMNS)


@query()
def reconstruction_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components aren't SQL; tests compare them with a direct computation."""
    return out(Network(spark, sf_dir, True).reconstruction(linear=True), STATION, TIME, *RECON_COLUMNS)


def _neural_tables(net: Network) -> reconstruct.ReconstructionTables:
    return reconstruct.calibrate(net.history, RECON, refine=lambda windows, held, linear: neural.NeuralAutoencoder.fit(windows, held, linear, RECON))


@query()
def reconstruction_neural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the nonlinear autoencoder."""
    net = Network(spark, sf_dir, True)
    return out(reconstruct.detect(net.obs, _neural_tables(net), RECON), STATION, TIME, *RECON_COLUMNS)


@query()
def autoencoder_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by epoch; epoch 0 is the linear model."""
    model = _neural_tables(Network(spark, sf_dir, True)).model
    return spark.createDataFrame(model.history if model else [], "epoch int, training_loss double, held_out_loss double")


# ----------------------------------------------------------------------- fusion

VOTES = ["statistical_alert", "spatial_alert", "lstm_ae_alert", "detector_votes", "final_alert", "final_severity", "final_confidence"]


@query(sql.with_(CLEAN_FUSED) + f"SELECT station_id, {S}, {sql.join(VOTES)} FROM cfused")
def fused_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: three detectors, calibrated on history, voting on every row."""
    return out(Network(spark, sf_dir, True).fused(), STATION, TIME, *VOTES)


_n = "CAST(statistical_alert AS INTEGER) + CAST(spatial_alert AS INTEGER) + CAST(lstm_ae_alert AS INTEGER)"
_w = "round((statistical_severity + CASE spatial_severity_level WHEN 'anomaly' THEN 0.67 WHEN 'suspicious' THEN 0.33 ELSE 0.0 END + lstm_ae_severity_score) / 3.0, 6)"
_TIERS = [("tiers", f"SELECT *, {_n} AS n, {_w}::DOUBLE AS w FROM cfused")]


@query(sql.with_(CLEAN_FUSED, _TIERS) + f"""SELECT station_id, {S}, CASE WHEN n >= 2 THEN 'anomaly' WHEN n >= 1 THEN 'suspicious' ELSE 'normal' END AS fusion_count_tier_label, round(n / 3.0, 6)::DOUBLE AS fusion_count_tier_score,
    CASE WHEN w >= 0.66 THEN 'anomaly' WHEN w >= 0.33 THEN 'suspicious' ELSE 'normal' END AS fusion_weighted_tier_label, w AS fusion_weighted_tier_score FROM tiers""")
def fusion_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fusion.run_strategies(Network(spark, sf_dir, True).fused(), [fusion.CountTier(), fusion.WeightedTier()])
    return out(rows, STATION, TIME, *(f"fusion_{n}_{k}" for n in ("count_tier", "weighted_tier") for k in ("label", "score")))


@query()
def logistic_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression isn't SQL. It learns from the rows before the cut and judges those from it on."""
    net = Network(spark, sf_dir, True, faults=True)
    rows = fusion.evidence(net.fused())
    cut = F.lit(net.cut).cast(dict(rows.dtypes)[TIME])
    return out(fusion.LogisticMeta.fit(rows.where(F.col(TIME) < cut), "is_anomaly").apply(rows.where(F.col(TIME) >= cut)), STATION, TIME, "fusion_logistic_meta_label", "fusion_logistic_meta_score")


METHODS = ["statistical_alert", "spatial_alert", "lstm_ae_alert", "final_alert", "statistical_or_spatial", "statistical_and_spatial"]
_VARIANTS = []
for _m in FUSE.multipliers:
    _t = f"{_m:g}".replace(".", "p")
    _VARIANTS += [f"reconstruction_{_t}x", f"any_{_t}x", f"baseline_and_reconstruction_{_t}x", f"two_of_three_{_t}x", f"all_three_{_t}x"]


def _variants_sql(source: str) -> sql.Part:
    columns = ["statistical_alert OR spatial_alert AS statistical_or_spatial", "statistical_alert AND spatial_alert AS statistical_and_spatial"]
    for m in FUSE.multipliers:
        t = f"{m:g}".replace(".", "p")
        r = f"coalesce(lstm_ae_score > p99 * {m}, false)"
        n = f"(CAST(statistical_alert AS INTEGER) + CAST(spatial_alert AS INTEGER) + CAST({r} AS INTEGER))"
        columns += [f"{r} AS reconstruction_{t}x", f"statistical_alert OR spatial_alert OR {r} AS any_{t}x", f"(statistical_alert OR spatial_alert) AND {r} AS baseline_and_reconstruction_{t}x",
                    f"{n} >= 2 AS two_of_three_{t}x", f"{n} = 3 AS all_three_{t}x"]
    return [("variants", f"SELECT f.*, {sql.join(columns)} FROM {source} f CROSS JOIN (SELECT p99 FROM ln_bounds)")]


@query(sql.with_(CLEAN_FUSED, _variants_sql("cfused")) + f"SELECT station_id, {S}, {sql.join(METHODS[4:] + _VARIANTS)} FROM variants")
def fusion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, True)
    return out(fusion.variants(net.fused(), net.recon_tables().bounds), STATION, TIME, *METHODS[4:], *_VARIANTS)


# -------------------------------------------------------------------- injection


@query(sql.with_(LN_INJ) + "SELECT * FROM inj_scaled")
def fault_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = inject.positions(tables.daily_lines(spark, sf_dir))
    return inject.local_scales(numbered, inject.plan(numbered, INJECT), INJECT)


TRUTHS = ["is_anomaly", "anomaly_id", "anomaly_type", "anomaly_variable", "anomaly_severity"]


@query(sql.with_(LN_INJ) + f"SELECT station_id, {S}, {sql.join(V)}, {sql.join(f'{v}_original' for v in V)}, {sql.join(TRUTHS)} FROM inj")
def faulty_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(inject.inject(tables.daily_lines(spark, sf_dir), INJECT)[0], STATION, TIME, *V, *(f"{v}_original" for v in V), *TRUTHS)


@query(sql.with_(LN_INJ) + "SELECT * EXCLUDE (start_time, end_time), strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time, "
       "printf('event-%06d', row_number() OVER (ORDER BY start_time, station_id, variable)) AS stable_id FROM inj_log")
def fault_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(inject.stable_ids(inject.inject(tables.daily_lines(spark, sf_dir), INJECT)[1]))


@query(sql.with_(LN_INJ) + "SELECT anomaly_type, count(*) AS events, CAST(sum(duration_rows) AS BIGINT) AS rows, round(quantile_cont(duration_rows, 0.5), 6) AS median_rows, round(quantile_cont(normalized_strength, 0.5), 6) AS median_strength FROM inj_log GROUP BY 1")
def fault_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.summary(inject.inject(tables.daily_lines(spark, sf_dir), INJECT)[1])


# ------------------------------------------------------------------- evaluation


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Network(spark, sf_dir, True, faults=True).fused()


DIST = FUSED + sql.distance("fused", "dist")


@query(sql.with_(FUSED, [("cm", f"SELECT {sql.confusion('final_alert')} FROM fused")]) + f"SELECT {sql.metric_columns()} FROM cm")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_faulty(spark, sf_dir), "final_alert")


_HITS = [("hits", "SELECT anomaly_id, max(CAST(final_alert AS INTEGER)) AS hit FROM fused WHERE anomaly_id IS NOT NULL GROUP BY 1")]


@query(sql.with_(FUSED, _HITS) + "SELECT count(*) AS events, CAST(coalesce(sum(hit), 0) AS BIGINT) AS detected, round(coalesce(avg(hit), 0.0), 6) AS event_recall FROM hits")
def event_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.event_recall(_faulty(spark, sf_dir), "final_alert")


@query(sql.with_(FUSED) + """SELECT anomaly_id, arg_min(anomaly_type, timestamp) AS anomaly_type, arg_min(anomaly_variable, timestamp) AS anomaly_variable, arg_min(anomaly_severity, timestamp) AS anomaly_severity, count(*) AS duration,
    bool_or(final_alert) AS detected, count(*) FILTER (final_alert) AS observations_detected FROM fused WHERE anomaly_id IS NOT NULL GROUP BY 1""")
def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.event_table(_faulty(spark, sf_dir), "final_alert")


@query(sql.with_(LN_INJ, sql.distance("inj", "dist")) + f"SELECT station_id, {S}, CAST(anomaly_distance AS INTEGER) AS anomaly_distance FROM dist")
def nearest_anomaly_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.distance_to_anomaly(inject.inject(tables.daily_lines(spark, sf_dir), INJECT)[0]), STATION, TIME, "anomaly_distance")


@query(sql.with_(DIST) + f"SELECT count(*) AS clear_rows, count(*) FILTER (final_alert) AS alerts, round(coalesce(avg(CAST(final_alert AS INTEGER)), 0.0), 6) AS buffer_clear_fpr FROM dist WHERE {sql.CLEAR}")
def buffer_clear_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.buffer_clear_fpr(_faulty(spark, sf_dir), "final_alert")


ALL_METHODS = METHODS + _VARIANTS
_METHOD_ROWS = DIST + _variants_sql("dist") + [("long", " UNION ALL ".join(f"SELECT '{m}' AS method, {m} AS predicted, is_anomaly, anomaly_id, anomaly_type, anomaly_distance FROM variants" for m in ALL_METHODS))]


@query(sql.with_(_METHOD_ROWS, [
    ("cm", f"SELECT method, {sql.confusion('predicted')} FROM long GROUP BY 1"),
    ("er", "SELECT method, round(avg(hit), 6) AS event_recall FROM (SELECT method, anomaly_id, max(CAST(predicted AS INTEGER)) AS hit FROM long WHERE anomaly_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1"),
    ("bc", f"SELECT method, round(avg(CAST(predicted AS INTEGER)), 6) AS buffer_clear_fpr FROM long WHERE {sql.CLEAR} GROUP BY 1"),
]) + f"SELECT cm.method, {sql.metric_columns()}, event_recall, buffer_clear_fpr FROM cm LEFT JOIN er USING (method) LEFT JOIN bc USING (method)")
def method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, True, faults=True)
    return evaluate.method_table(fusion.variants(net.fused(), net.recon_tables().bounds), ALL_METHODS)


@query(sql.with_(FUSED, _variants_sql("fused")) + "SELECT anomaly_type, " + sql.join(f"round(avg({m}), 6) AS {m}" for m in METHODS) + " FROM (SELECT anomaly_type, anomaly_id, "
       + sql.join(f"max(CAST({m} AS INTEGER)) AS {m}" for m in METHODS) + " FROM variants WHERE anomaly_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def recall_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, True, faults=True)
    return evaluate.recall_by_type(fusion.variants(net.fused(), net.recon_tables().bounds), METHODS)


def _recall_sql(by: str) -> str:
    return sql.with_(FUSED) + f"SELECT {by}, count(*) AS observations, count(*) FILTER (final_alert) AS detected, round(avg(CAST(final_alert AS INTEGER)), 6) AS recall FROM fused WHERE is_anomaly GROUP BY 1"


@query(_recall_sql("anomaly_type"))
def observation_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.observation_recall(_faulty(spark, sf_dir), "final_alert")


@query(_recall_sql("anomaly_variable"))
def recall_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.observation_recall(_faulty(spark, sf_dir), "final_alert", "anomaly_variable")


@query(sql.with_(FUSED) + "SELECT station_id, count(*) AS clean_rows, count(*) FILTER (final_alert) AS false_positives, round(avg(CAST(final_alert AS INTEGER)), 6) AS fpr FROM fused WHERE NOT is_anomaly GROUP BY 1")
def fp_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.false_positives_by_station(_faulty(spark, sf_dir), "final_alert")


SIGNALS = [*RANGE, *(f"{v}_roc_anomaly" for v in V), *(c for c in SCORES if c.endswith("anomaly")), *STUCK, *(f"evidence_{f}" for f in statistical.FAMILIES)]
INJ_STAT = LN_INJ + sql.hourly("ln_hist", "ln_hourly", LINE_STAT) + sql.statistical("inj", "ln_hourly", "flt_stat", LINE_STAT)


@query(sql.with_(INJ_STAT) + " UNION ALL ".join(
    f"SELECT '{s}' AS signal, count(*) FILTER ({s}) AS fired, round(avg(CAST({s} AS INTEGER)), 6) AS rate, count(*) FILTER ({s} AND is_anomaly) AS fired_on_anomalies FROM flt_stat" for s in SIGNALS))
def firing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.firing_rates(Network(spark, sf_dir, True, faults=True).statistical(), SIGNALS)


@query(sql.with_(FUSED) + "SELECT station_id, count(*) AS rows, count(*) FILTER (final_alert) AS alerts, round(avg(CAST(final_alert AS INTEGER)), 6) AS alert_rate FROM fused GROUP BY 1")
def station_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.station_alerts(_faulty(spark, sf_dir), "final_alert")


@query(sql.with_(FUSED) + "SELECT final_severity AS severity, count(*) AS observations, count(*) FILTER (is_anomaly) AS injected, count(*) FILTER (final_alert) AS alerts, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM fused GROUP BY 1")
def severity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.severity_distribution(_faulty(spark, sf_dir), "final_severity", "final_alert")


_BASE = [("two", "SELECT *, statistical_alert OR spatial_alert AS b, lstm_ae_alert AS a FROM fused")]


@query(sql.with_(FUSED, _BASE, [
    ("e", "SELECT anomaly_id, max(CAST(b AS INTEGER)) AS b, max(CAST(a AS INTEGER)) AS a FROM two WHERE anomaly_id IS NOT NULL GROUP BY 1"),
    ("x", "SELECT count(*) AS events, count(*) FILTER (b = 1) AS base_events, count(*) FILTER (b = 1 OR a = 1) AS combined_events, count(*) FILTER (b = 0 AND a = 1) AS added_events FROM e"),
    ("y", "SELECT count(*) FILTER (a AND is_anomaly AND NOT b) AS added_tp, count(*) FILTER (a AND NOT is_anomaly AND NOT b) AS added_fp, count(*) FILTER (b AND is_anomaly) AS base_tp, count(*) FILTER ((a OR b) AND is_anomaly) AS combined_tp FROM two"),
]) + "SELECT * FROM x CROSS JOIN y")
def complementarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _faulty(spark, sf_dir).withColumn("base", flag(F.col("statistical_alert")) | flag(F.col("spatial_alert")))
    return evaluate.complementarity(rows, "base", "lstm_ae_alert")


@query(sql.with_(FUSED, [("m", "SELECT CAST(statistical_alert AS INTEGER) + 2 * CAST(spatial_alert AS INTEGER) + 4 * CAST(lstm_ae_alert AS INTEGER) AS mask, count(*) AS rows, count(*) FILTER (is_anomaly) AS anomalies FROM fused GROUP BY 1")])
       + """SELECT combination, coalesce(rows, 0) AS rows, coalesce(anomalies, 0) AS anomalies, round(coalesce(anomalies / nullif(rows, 0), 0.0), 6) AS precision FROM (VALUES (0, 'none'), (1, 'first'), (2, 'second'), (3, 'first+second'),
       (4, 'third'), (5, 'first+third'), (6, 'second+third'), (7, 'all')) t(mask, combination) LEFT JOIN m USING (mask)""")
def detector_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.detector_overlap(_faulty(spark, sf_dir), "statistical_alert", "spatial_alert", "lstm_ae_alert")


PERCENTS = (90, 95, 97, 98, 99, 99.5, 99.9)
INJ_RECON = LN_INJ + LN_BOUNDS + sql.windows("inj", "ln_norm", "flt_win", RECON) + sql.mean_scores("flt_win", "flt_scores", RECON) + sql.reconstruction("flt_win", "flt_scores", "ln_bounds", "flt_recon", RECON)
_T = [("t", "SELECT DISTINCT round(t, 6) AS threshold FROM (" + " UNION ALL ".join(
    [f"SELECT quantile_cont(lstm_ae_score, {p / 100}) AS t FROM flt_recon {w}" for p in PERCENTS for w in ("", "WHERE NOT is_anomaly")] + ["SELECT p95 FROM ln_bounds", "SELECT p99 FROM ln_bounds"]) + ") WHERE t IS NOT NULL")]


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    net = Network(spark, sf_dir, True, faults=True)
    found = net.recon_tables()
    return reconstruct.detect(net.obs, found, RECON), found.bounds


@query(sql.with_(INJ_RECON, _T, [
    ("long", "SELECT threshold, coalesce(lstm_ae_score > threshold, false) AS predicted, is_anomaly, anomaly_id FROM flt_recon CROSS JOIN t"), ("cm", f"SELECT threshold, {sql.confusion('predicted')} FROM long GROUP BY 1"),
    ("er", "SELECT threshold, round(avg(hit), 6) AS event_recall FROM (SELECT threshold, anomaly_id, max(CAST(predicted AS INTEGER)) AS hit FROM long WHERE anomaly_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1"),
]) + f"SELECT threshold, {sql.metric_columns()}, event_recall FROM cm LEFT JOIN er USING (threshold)")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, bounds = _scored(spark, sf_dir)
    return evaluate.threshold_sweep(scores, evaluate.threshold_candidates(scores, bounds, PERCENTS))


_P = (1, 5, 25, 50, 75, 90, 95, 99, 99.9)
_G = [("g", "SELECT 'all' AS \"group\", lstm_ae_score AS s FROM flt_recon UNION ALL SELECT CASE WHEN is_anomaly THEN 'anomalous' ELSE 'clean' END, lstm_ae_score FROM flt_recon")]


@query(sql.with_(INJ_RECON, _G) + 'SELECT "group", count(*) AS n, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(min(s), 6) AS low, round(max(s), 6) AS high, '
       + sql.join(f"round(quantile_cont(s, {p / 100}), 6) AS p{f'{p:g}'.replace('.', '_')}" for p in _P) + " FROM g WHERE s IS NOT NULL GROUP BY 1")
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_distribution(_scored(spark, sf_dir)[0], _P)


def _score_by_sql(by: str, name: str) -> str:
    return sql.with_(INJ_RECON) + f"SELECT {by} AS {name}, count(*) AS n, round(avg(lstm_ae_score), 6) AS mean, round(quantile_cont(lstm_ae_score, 0.5), 6) AS median, round(quantile_cont(lstm_ae_score, 0.95), 6) AS p95 FROM flt_recon WHERE lstm_ae_score IS NOT NULL AND NOT is_anomaly GROUP BY 1"


@query(_score_by_sql("station_id", "station"))
def score_by_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.clean_score_by(_scored(spark, sf_dir)[0], F.col(STATION), "station")


@query(_score_by_sql("CAST(month(timestamp) AS INTEGER)", "month"))
def score_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.clean_score_by(_scored(spark, sf_dir)[0], F.month(TIME), "month")


@query(sql.with_(INJ_RECON, sql.distance("flt_recon", "dist")) + f"""SELECT CASE WHEN is_anomaly THEN 'anomalous' WHEN coalesce(anomaly_distance, {1 << 30}) <= {evaluate.BUFFER} THEN 'near' ELSE 'clear' END AS "group", count(*) AS n,
    round(avg(lstm_ae_score), 6) AS mean, round(quantile_cont(lstm_ae_score, 0.95), 6) AS p95, count(*) FILTER (lstm_ae_alert) AS alerts FROM dist WHERE lstm_ae_score IS NOT NULL GROUP BY 1""")
def overlap_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.overlap_contamination(_scored(spark, sf_dir)[0])


_CUTS = [("cuts", " UNION ALL ".join(
    f"SELECT '{c}' AS strategy, '{cut}' AS cut, {c} IN ({levels}) AS predicted, is_anomaly FROM fused" for c in ("statistical_severity_label", "spatial_severity_level", "final_severity")
    for cut, levels in (("anomaly", "'anomaly', 'critical'"), ("suspicious", "'suspicious', 'anomaly', 'critical'"))))]


@query(sql.with_(FUSED, _CUTS, [("cm", f"SELECT strategy, cut, {sql.confusion('predicted')} FROM cuts GROUP BY 1, 2")]) + f"SELECT strategy, cut, {sql.metric_columns()} FROM cm")
def strategy_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.two_cuts(_faulty(spark, sf_dir), ["statistical_severity_label", "spatial_severity_level", "final_severity"])


# -------------------------------------------------------------------- diagnosis

EV_INJ = EV + sql.injection("ev", "einj", INJECT)
EV_FAULTY = (
    EV_INJ + EV_HOURLY + sql.statistical("einj", "ev_hourly", "e_stat", EVENT_STAT) + EV_LIMITS + sql.residuals("einj", "ev_graph", "e_res", SPATIAL) + sql.spatial("e_res", "ev_limits", "e_spat", SPATIAL)
    + sql.reference("ev_hres", "ref") + [("alerted", f"SELECT p.*, s.statistical_alert OR p.spatial_alert AS final_alert FROM e_spat p JOIN e_stat s ON p.station_id = s.station_id AND p.timestamp = s.timestamp WHERE p.timestamp >= TIMESTAMP '{EVENT_CUT}'")]
    + sql.diagnosis("alerted", "ref", "diag"))
DIAGNOSIS = ["diagnosis", "diagnosis_variable", "diagnosis_confidence", "operational_class"]


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, False, faults=True)
    rows = net.spatial().join(net.statistical().select(STATION, TIME, "statistical_alert"), [STATION, TIME])
    rows = rows.withColumn("final_alert", F.col("statistical_alert") | F.col("spatial_alert")).where(F.col(TIME) >= F.lit(EVENT_CUT).cast(dict(rows.dtypes)[TIME]))
    reference = diagnosis.build_reference(net.history, net.graph)
    # the reference is of the history before these rows, whose keys were checked when they were read
    return diagnosis.diagnose_fused(tables.stage(rows, "alerted"), tables.stage(reference, "reference"), check=False)


@query(sql.with_(EV_HRES, sql.reference("ev_hres", "ref")) + "SELECT * FROM ref")
def diagnosis_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, False)
    return diagnosis.build_reference(net.history, net.graph)


@query(sql.with_(EV_FAULTY) + f"SELECT station_id, {S}, final_alert, {sql.join(DIAGNOSIS)} FROM diag")
def diagnosis_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(_diagnosed(spark, sf_dir), STATION, TIME, "final_alert", *DIAGNOSIS)


_SHAPES = {"median": "med", "mad": "mad", "slope": "slope", "noise": "noise", "same_sign": "same", "monotonic": "mono", "reversal": "rev", "span": "span", "peer_span": "pspan", "z": "z", "rate": "rate", "rate_threshold": "tt"}


@query(sql.with_(EV_FAULTY) + f"SELECT station_id, {S}, diagnosis, diagnosis_variable AS variable, " + sql.join(
    "round(CASE diagnosis_variable " + " ".join(f"WHEN '{v}' THEN {v}_{c}" for v in V) + f" END, 4) AS shape_{name}" for name, c in _SHAPES.items())
    + ", " + sql.join((f"CAST({v}_kind IS NOT NULL AS INTEGER)" for v in V), " + ") + " AS candidates, operational_class = 'POSSIBLE_ENVIRONMENTAL_EVENT' AS moved FROM diag WHERE final_alert")
def diagnosis_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of each alerted row, read back from its JSON."""
    rows = _diagnosed(spark, sf_dir).where("final_alert")
    kind = "candidates array<struct<diagnosis: string, variable: string>>, movement struct<variable: string>, shape struct<" + ", ".join(f"{name}: double" for name in _SHAPES) + ">"
    e = F.from_json("diagnosis_evidence", kind)
    rows = rows.withColumn("_e", e)
    return out(
        rows, STATION, TIME, "diagnosis", F.get(F.col("_e.candidates"), 0)["variable"].alias("variable"), *(F.round(F.col(f"_e.shape.{name}"), 4).alias(f"shape_{name}") for name in _SHAPES),
        F.size("_e.candidates").alias("candidates"), F.col("_e.movement").isNotNull().alias("moved"))


_PAIRS = [("pairs", f"SELECT {sql.expected_diagnosis()} AS t, diagnosis AS p FROM diag WHERE diagnosis IS NOT NULL AND anomaly_type IS NOT NULL AND NOT contains(anomaly_type, '|')")]


@query(sql.with_(EV_FAULTY, _PAIRS) + "SELECT t AS truth, p AS predicted, count(*) AS rows FROM pairs WHERE t IS NOT NULL GROUP BY 1, 2")
def diagnosis_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion_matrix(evaluate.with_expected_diagnosis(_diagnosed(spark, sf_dir)))


_p, _r = sql.ratio("hit", "hit + extra"), sql.ratio("hit", "hit + miss")


@query(sql.with_(EV_FAULTY, _PAIRS, [
    ("c", "SELECT class, count(*) FILTER (kind = 'hit') AS hit, count(*) FILTER (kind = 'miss') AS miss, count(*) FILTER (kind = 'extra') AS extra FROM (SELECT t AS class, CASE WHEN t = p THEN 'hit' ELSE 'miss' END AS kind FROM pairs WHERE t IS NOT NULL UNION ALL SELECT p, 'extra' FROM pairs WHERE t IS NOT NULL AND t <> p) GROUP BY 1"),
]) + f"SELECT class, round({_p}, 6) AS precision, round({_r}, 6) AS recall, round({sql.ratio(f'2 * {_p} * {_r}', f'{_p} + {_r}')}, 6) AS f1, hit + miss AS support FROM c")
def diagnosis_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_report(evaluate.with_expected_diagnosis(_diagnosed(spark, sf_dir)))


@query(sql.with_(EV_FAULTY, [("el", f"SELECT *, {sql.expected_diagnosis()} AS expected FROM diag WHERE final_alert AND is_anomaly AND NOT contains(anomaly_type, '|')")])
       + """SELECT count(*) AS eligible, round(coalesce(avg(CAST(diagnosis = expected AS INTEGER)), 0.0), 6) AS accuracy, round(coalesce(avg(CAST(diagnosis = expected AND diagnosis_variable IS NOT DISTINCT FROM anomaly_variable AS INTEGER)), 0.0), 6) AS joint_accuracy,
       round(coalesce(avg(CAST(diagnosis <> 'UNCLASSIFIED_ANOMALY' AS INTEGER)), 0.0), 6) AS coverage FROM el""")
def diagnosis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.diagnosis_summary(_diagnosed(spark, sf_dir))


_MEMBERS = [("members", "SELECT station_id, timestamp, diagnosis, final_alert, unnest(string_split(anomaly_id, '|')) AS anomaly_id, unnest(string_split(anomaly_type, '|')) AS anomaly_type, unnest(string_split(anomaly_variable, '|')) AS anomaly_variable, unnest(string_split(anomaly_severity, '|')) AS anomaly_severity FROM diag WHERE anomaly_id IS NOT NULL")]


@query(sql.with_(EV_FAULTY, _MEMBERS) + f"SELECT station_id, {S}, diagnosis, final_alert, anomaly_id, anomaly_type, anomaly_variable, anomaly_severity FROM members")
def label_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.label_membership(_diagnosed(spark, sf_dir)))


@query(sql.with_(EV_FAULTY, _MEMBERS, [("k", "SELECT anomaly_id, diagnosis, count(*) AS n FROM members WHERE diagnosis IS NOT NULL GROUP BY 1, 2")])
       + "SELECT anomaly_id, first(diagnosis ORDER BY n DESC, diagnosis) AS dominant, CAST(sum(n) AS BIGINT) AS diagnosed, count(*) AS kinds, round(max(n) / sum(n), 6) AS share, count(*) > 1 AS conflict FROM k GROUP BY 1")
def event_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.event_consistency(evaluate.label_membership(_diagnosed(spark, sf_dir)))


# ------------------------------------------------------------------ explanation


@query(sql.with_(FUSED) + f"""SELECT station_id, {S}, final_alert AS alert, detector_votes AS votes, final_severity AS severity, array_to_string(list_filter([CASE WHEN statistical_alert THEN 'statistical' END,
    CASE WHEN spatial_alert THEN 'spatial' END, CASE WHEN lstm_ae_alert THEN 'lstm_ae' END], lambda x: x IS NOT NULL), ',') AS agreeing, CAST(detector_votes AS VARCHAR) || ' of 3 detectors agree; 2 are needed.' AS text FROM fused""")
def vote_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = explain.decision(_faulty(spark, sf_dir))
    d = F.col("decision")
    return out(rows, STATION, TIME, d["alert"].alias("alert"), d["votes"].alias("votes"), d["severity"].alias("severity"), F.array_join(d["agreeing"], ",").alias("agreeing"), d["text"].alias("text"))


@query()
def explanation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON text; engines lay it out differently, so tests check its content."""
    return out(explain.explain(_faulty(spark, sf_dir)), STATION, TIME, "explanation")


_FIRED = {v: " + ".join(f"CAST(coalesce(t.{v}_{c}_anomaly, false) AS INTEGER)" for c in ("range", "roc", "zscore_24h", "zscore_168h", "persistence")) for v in V}
_TOP_FIRED = "CASE " + " ".join(f"WHEN ({_FIRED[v]}) > 0 AND ({_FIRED[v]}) = greatest({sql.join(_FIRED.values())}) THEN '{v}'" for v in V) + " END"


@query(sql.with_(FUSED) + f"""SELECT f.station_id, strftime(f.timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, f.final_alert AS alert, f.detector_votes AS votes, f.final_severity AS severity, f.statistical_severity_label AS statistical_severity,
    {_TOP_FIRED} AS statistical_primary, {" + ".join(_FIRED.values())} AS statistical_notes, f.spatial_severity_level AS spatial_severity,
    CASE WHEN p.temperature_spatial_anomaly THEN 'temperature' WHEN p.pressure_spatial_anomaly THEN 'pressure' END AS spatial_primary, {" + ".join(f"CAST(p.{v}_spatial_suspicious AS INTEGER)" for v in V)} AS spatial_notes,
    f.lstm_ae_severity_label AS reconstruction_severity, r.lstm_ae_top_contributor AS reconstruction_primary, f.lstm_ae_scored AS reconstruction_available, round(r.temperature_lstm_ae_error, 6) AS temperature_error, f.temperature, f.humidity, f.pressure
    FROM fused f JOIN flt_stat t ON f.station_id = t.station_id AND f.timestamp = t.timestamp JOIN flt_spat p ON f.station_id = p.station_id AND f.timestamp = p.timestamp JOIN flt_recon r ON f.station_id = r.station_id AND f.timestamp = r.timestamp""")
def explanation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each explanation says, read back from its JSON."""
    rows = explain.explain(_faulty(spark, sf_dir)).select(STATION, TIME, "explanation")
    detector = "struct<alert: boolean, severity: string, primary: string, observations: array<string>>"
    kind = (
        f"decision struct<alert: boolean, votes: int, severity: string>, detectors struct<statistical: {detector}, spatial: {detector}, reconstruction: struct<severity: string, primary: string, available: boolean, "
        "errors: array<struct<variable: string, error: double>>>>, readings struct<temperature: double, humidity: double, pressure: double>")
    rows = rows.withColumn("_e", F.from_json("explanation", kind)).select(STATION, TIME, "_e.*")
    d = F.col("detectors")
    error = F.get(F.filter(d["reconstruction"]["errors"], lambda e: e["variable"] == "temperature"), 0)["error"]
    return out(
        rows, STATION, TIME, "decision.alert", "decision.votes", "decision.severity", d["statistical"]["severity"].alias("statistical_severity"), d["statistical"]["primary"].alias("statistical_primary"),
        F.size(d["statistical"]["observations"]).alias("statistical_notes"), d["spatial"]["severity"].alias("spatial_severity"), d["spatial"]["primary"].alias("spatial_primary"), F.size(d["spatial"]["observations"]).alias("spatial_notes"),
        d["reconstruction"]["severity"].alias("reconstruction_severity"), d["reconstruction"]["primary"].alias("reconstruction_primary"), d["reconstruction"]["available"].alias("reconstruction_available"), r6(error).alias("temperature_error"), "readings.*")


@query()
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled Shapley values aren't SQL. The number of explained alerts is a report's limit; the others are listed as beyond it."""
    net = Network(spark, sf_dir, True, faults=True)
    found = net.recon_tables(linear=True)
    if found.model is None:
        return spark.createDataFrame([], f"{STATION} string, {TIME} string, available boolean, reason string")
    alerted = reconstruct.detect(net.obs, found, RECON).where("lstm_ae_alert")
    alerted = alerted.where(F.col(TIME) >= F.lit(net.cut).cast(dict(alerted.dtypes)[TIME]))
    return out(explain.attribute(net.obs, alerted, found.stats, found.model, reconstruct.windows_of(net.history, found.stats, RECON), RECON))


# ------------------------------------------------------ exploration, dashboard


@query(sql.with_(sql.EVENTS) + "SELECT station_id, strftime(date_trunc('day', timestamp), '%Y-%m-%d %H:%M:%S') AS day, round(avg(temperature), 4) AS temperature, round(avg(humidity), 4) AS humidity, round(avg(pressure), 6) AS pressure" + " FROM ev GROUP BY 1, 2")
def daily_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = explore.daily_means(tables.hourly_events(spark, sf_dir))
    return out(days, STATION, "day", *(F.round(v, 6 if v == "pressure" else 4).alias(v) for v in V))  # digits at which means of few readings seldom tie


@query(sql.with_(sql.EVENTS) + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, count({v}) AS n, round(avg({v}), 6) AS mean, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS low, round(max({v}), 6) AS high, "
    + sql.join(f"round(quantile_cont({v}, {q}), 6) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75)) + " FROM ev" for v in V))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.describe(tables.hourly_events(spark, sf_dir))


@query(sql.with_(sql.EVENTS) + f"SELECT {S}, " + sql.join(f"max(temperature) FILTER (station_id = '{s}') AS {s}" for s in EVENT_STATIONS) + " FROM ev GROUP BY ev.timestamp")
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(explore.wide(tables.hourly_events(spark, sf_dir), "temperature", list(EVENT_STATIONS)))


_TWO = [("two", "SELECT a.station_id AS a, o.station_id AS b, a.temperature AS x, o.temperature AS y FROM ev a JOIN ev o ON a.timestamp = o.timestamp AND a.station_id < o.station_id")]


@query(sql.with_(sql.EVENTS, _TWO) + "SELECT a, b, count(*) AS n, round(corr(x, y), 6) AS correlation FROM two GROUP BY 1, 2")
def station_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.correlations(tables.stage(tables.hourly_events(spark, sf_dir), "observations"), "temperature")


@query(sql.with_(sql.EVENTS, _TWO) + "SELECT a, b, bool_and(x IS NOT DISTINCT FROM y) AS identical FROM two GROUP BY 1, 2")
def identical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.identical_series(tables.stage(tables.hourly_events(spark, sf_dir), "observations"), "temperature")


@query(sql.with_(sql.LINES, [("doubled", "SELECT * FROM ln UNION ALL SELECT station_id || '2', timestamp, temperature, CASE WHEN station_id = 'NO' THEN humidity ELSE humidity + 1 END, pressure FROM ln"),
                             ("sized", "SELECT *, count(*) OVER (PARTITION BY station_id) AS rows FROM doubled"),
                             ("same", "SELECT a.station_id AS a, o.station_id AS b, any_value(a.rows) AS rows FROM sized a JOIN sized o ON a.timestamp = o.timestamp AND a.humidity IS NOT DISTINCT FROM o.humidity AND a.rows = o.rows GROUP BY 1, 2 HAVING count(*) = any_value(a.rows)")])
       + "SELECT a AS station_id, any_value(rows) AS rows, count(*) AS twins, min(b) AS first FROM same GROUP BY 1")
def twin_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each station twice, of which one pair is the same throughout."""
    lines = tables.stage(tables.daily_lines(spark, sf_dir), "observations")
    again = lines.withColumns({"humidity": F.when(F.col(STATION) == "NO", F.col("humidity")).otherwise(F.col("humidity") + 1), STATION: F.concat(STATION, F.lit("2"))})
    return series.twins(lines.unionByName(again), "humidity")


@query(sql.with_(sql.EVENTS) + f"SELECT {S}, count(temperature) AS n, round(min(temperature), 6) AS low, round(max(temperature), 6) AS high, round(avg(temperature), 6) AS mean, round(stddev_samp(temperature), 6) AS std, round(max(temperature) - min(temperature), 6) AS range FROM ev GROUP BY ev.timestamp")
def spatial_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(explore.spread_by_time(tables.hourly_events(spark, sf_dir), "temperature"))


@query(sql.with_(sql.EVENTS) + f"SELECT station_id, {S}, temperature, humidity, pressure FROM ev WHERE timestamp = TIMESTAMP '{SHIFT_AT}'")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(tables.hourly_events(spark, sf_dir, at=SHIFT_AT))


@query(sql.with_(sql.EVENTS) + "SELECT station_id, count(*) AS rows FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def busiest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.busiest_station(tables.hourly_events(spark, sf_dir))


@query(sql.with_(sql.LINES) + f"SELECT station_id, {S}, temperature, humidity, pressure FROM ln ORDER BY ln.station_id, ln.timestamp LIMIT 1440")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(explore.first_rows(tables.daily_lines(spark, sf_dir), 1440))


@query(sql.with_(sql.LINES, [("p", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY station_id ORDER BY timestamp) <= floor(count(*) OVER (PARTITION BY station_id) * 0.8) THEN 'train' ELSE 'test' END AS part FROM ln")])
       + "SELECT station_id, part, count(*) AS rows, round(avg(temperature), 6) AS mean, round(stddev_pop(temperature), 6) AS std FROM p GROUP BY 1, 2")
def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.split_by_position(tables.daily_lines(spark, sf_dir)).groupBy(STATION, "part").agg(F.count("*").alias("rows"), r6(F.avg("temperature")).alias("mean"), r6(F.stddev_pop("temperature")).alias("std"))


_W = "OVER (PARTITION BY station_id ORDER BY timestamp ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING)"


@query(sql.with_(FUSED, [("w", f"SELECT count(*) {_W} AS n, max(CAST(is_anomaly AS INTEGER)) {_W} AS truth, max(CAST(final_alert AS INTEGER)) {_W} AS hit FROM fused")]) + "SELECT truth, hit, count(*) AS windows FROM w WHERE n = 24 GROUP BY 1, 2")
def window_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.window_labels(_faulty(spark, sf_dir).withColumn("predicted", F.col("final_alert")))


_IDX = [("idx", "SELECT *, CAST(row_number() OVER (PARTITION BY station_id ORDER BY timestamp) - 1 AS INTEGER) AS idx, count(*) OVER (PARTITION BY station_id) AS n FROM fused")]
_COLOUR = "CASE WHEN final_alert THEN 'red' WHEN final_severity = 'suspicious' THEN 'yellow' ELSE 'green' END"
_AGREE = "array_to_string(list_filter([CASE WHEN statistical_alert THEN 'statistical' END, CASE WHEN spatial_alert THEN 'spatial' END, CASE WHEN lstm_ae_alert THEN 'lstm_ae' END], lambda x: x IS NOT NULL), ',')"


@query(sql.with_(FUSED, _IDX) + f"SELECT station_id, {S}, idx, {_COLOUR} AS colour, {_AGREE} AS agreeing, {sql.join(f'round({v}, 2) AS {v}' for v in V)}, final_severity FROM idx WHERE idx.idx = n - 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(explore.latest_status(_faulty(spark, sf_dir)))


@query(sql.with_(FUSED, _IDX) + "SELECT " + sql.join(f"count(*) FILTER ({_COLOUR} = '{c}') AS {c}" for c in ("green", "yellow", "red")) + " FROM idx WHERE idx = n - 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.status_counts(explore.latest_status(_faulty(spark, sf_dir)))


@query(sql.with_(FUSED, _IDX) + f"SELECT station_id, {S}, idx, final_severity, detector_votes FROM idx WHERE final_severity <> 'normal'")
def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(explore.alert_log(_faulty(spark, sf_dir)))


@query(sql.with_(FUSED, _IDX) + f"SELECT station_id, {S}, idx, temperature, humidity, pressure, final_severity FROM idx WHERE station_id = 'NO' AND idx <= 500")
def station_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(explore.station_history(_faulty(spark, sf_dir), "NO", 500), STATION, TIME, "idx", *V, "final_severity")


_GRADE = sql.join((f"CASE WHEN {v} < {a} OR {v} > {d} THEN 2 WHEN {v} < {b_} OR {v} > {c} THEN 1 ELSE 0 END" for v, a, b_, c, d in (("temperature", 5.0, 15.0, 90.0, 160.0), ("humidity", 1.0, 1.0, 6.0, 8.0), ("pressure", 5.0, 15.0, 200.0, 300.0))))


@query(sql.with_(sql.EVENTS) + f"SELECT station_id, {S}, ['green', 'yellow', 'red'][greatest({_GRADE}) + 1] AS light FROM ev")
def traffic_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"temperature": (5.0, 15.0, 90.0, 160.0), "humidity": (1.0, 1.0, 6.0, 8.0), "pressure": (5.0, 15.0, 200.0, 300.0)}
    return out(explore.traffic_light(tables.hourly_events(spark, sf_dir), limits), STATION, TIME, "light")


@query(sql.with_(EV_FAULTY, [("h", "SELECT station_id, first(diagnosis ORDER BY n DESC, diagnosis) AS dominant_issue FROM (SELECT station_id, diagnosis, count(*) AS n FROM diag WHERE diagnosis IS NOT NULL GROUP BY 1, 2) GROUP BY 1")])
       + "SELECT d.station_id, count(*) FILTER (final_alert) AS alerts, count(*) FILTER (spatial_severity_level = 'suspicious') AS suspicious, strftime(max(timestamp) FILTER (final_alert), '%Y-%m-%d %H:%M:%S') AS last_alert, any_value(h.dominant_issue) AS dominant_issue FROM diag d LEFT JOIN h USING (station_id) GROUP BY 1")
def sensor_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.sensor_health(_diagnosed(spark, sf_dir).withColumn("final_severity", F.col("spatial_severity_level"))))


@cache
def registered() -> tuple[str, ...]:
    return tuple(QUERIES)
