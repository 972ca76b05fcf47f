"""Further registered queries: reports of evaluation, exploration and the dashboard, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STATION, TIME, VARIABLES
from ..functions.scalar import to_number
from ..operators import evaluate, explain, explore, fusion, inject, reconstruct
from ..sources import tables
from . import sql
from .calibration import Calibration
from .queries import (
    _COLOUR, _IDX, _PAIRS, _diagnosed, _faulty, _scored, CLEAN_FUSED, EV_FAULTY, FUSED, INJ_RECON, INJECT, LN, LN_BOUNDS, LN_INJ, Network, RECON, S, SPATIAL, _n, _p, _r, _w, out, query,
)

V = VARIABLES

# ------------------------------------------------------------------- evaluation


@query(sql.with_(INJ_RECON) + """SELECT count(*) AS scored, count(*) FILTER (lstm_ae_suspicious) AS raw, count(*) FILTER (lstm_ae_alert) AS confirmed, round(coalesce(avg(CAST(lstm_ae_suspicious AS INTEGER)), 0.0), 6) AS raw_rate,
    round(coalesce(avg(CAST(lstm_ae_alert AS INTEGER)), 0.0), 6) AS confirmed_rate FROM flt_recon WHERE lstm_ae_scored""")
def alert_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.alert_policy(_scored(spark, sf_dir)[0])


@query(sql.with_(FUSED) + f"SELECT station_id, {S}, is_anomaly, anomaly_type, final_alert, final_severity FROM fused WHERE is_anomaly OR final_alert")
def anomalies_or_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(evaluate.anomalies_or_alerts(_faulty(spark, sf_dir), "final_alert"), STATION, TIME, "is_anomaly", "anomaly_type", "final_alert", "final_severity")


_METHODS = ("statistical_alert", "spatial_alert", "lstm_ae_alert", "final_alert")


@query(sql.with_(FUSED) + "SELECT anomaly_variable, " + sql.join(f"round(avg({m}), 6) AS {m}" for m in _METHODS) + " FROM (SELECT anomaly_variable, anomaly_id, "
       + sql.join(f"max(CAST({m} AS INTEGER)) AS {m}" for m in _METHODS) + " FROM fused WHERE anomaly_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def event_recall_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.recall_by_type(_faulty(spark, sf_dir), list(_METHODS), "anomaly_variable")


_VAR = [("vars", " UNION ALL ".join(f"SELECT '{v}' AS variable, {v}_spatial_anomaly AS p, is_anomaly AND coalesce(anomaly_variable = '{v}', false) AS t FROM flt_spat" for v in V))]


@query(sql.with_(FUSED, _VAR, [("cm", f"SELECT variable, {sql.confusion('p', 't')} FROM vars GROUP BY 1")]) + f"SELECT variable, {sql.metric_columns()} FROM cm")
def metrics_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics_by_variable(Network(spark, sf_dir, True, faults=True).spatial(), {v: f"{v}_spatial_anomaly" for v in V})


@query(sql.with_(INJ_RECON) + "SELECT CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS n, round(avg(lstm_ae_score), 6) AS mean, round(quantile_cont(lstm_ae_score, 0.5), 6) AS median, round(quantile_cont(lstm_ae_score, 0.95), 6) AS p95 FROM flt_recon WHERE lstm_ae_score IS NOT NULL AND NOT is_anomaly GROUP BY 1")
def score_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.clean_score_by(_scored(spark, sf_dir)[0], F.hour(TIME), "hour")


_CLEAR = INJ_RECON + sql.distance("flt_recon", "dist") + [("clear", f"SELECT * EXCLUDE (p95, p99) FROM dist WHERE lstm_ae_score IS NOT NULL AND {sql.CLEAR}")]
_Q = lambda p: f"round(quantile_cont(lstm_ae_score, {p}), 6)"


@query(sql.with_(_CLEAR) + f"""SELECT station_id, count(*) AS n, round(avg(lstm_ae_score), 6) AS mean, {_Q(0.5)} AS median, {_Q(0.95)} AS p95, {_Q(0.99)} AS p99, round({_Q(0.95)} / nullif(any_value(b.p95), 0), 4) AS p95_ratio,
    round({_Q(0.99)} / nullif(any_value(b.p99), 0), 4) AS p99_ratio FROM clear CROSS JOIN ln_bounds b GROUP BY 1""")
def stations_against_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.stations_against_calibration(*_scored(spark, sf_dir))


@query(sql.with_(_CLEAR) + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, count(*) AS n, round(avg({v}_lstm_ae_error), 6) AS mean, round(quantile_cont({v}_lstm_ae_error, 0.95), 6) AS p95, round(quantile_cont({v}_lstm_ae_error, 0.99), 6) AS p99, any_value(b.{v}_p95) AS calibrated_p95, any_value(b.{v}_p99) AS calibrated_p99 FROM clear CROSS JOIN ln_bounds b" for v in V))
def errors_by_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.errors_by_variable(*_scored(spark, sf_dir), V)


_COUNT = lambda anomaly: f"CASE WHEN n >= {anomaly} THEN 'anomaly' WHEN n >= 1 THEN 'suspicious' ELSE 'normal' END"
_TIERED = [("tiered", f"SELECT *, {_n} AS n, {_w}::DOUBLE AS w FROM fused"), ("labels", f"""SELECT is_anomaly, anomaly_id, {_COUNT(2)} AS count_tier, {_COUNT(3)} AS count_tier_strict_3of3,
    CASE WHEN w >= 0.66 THEN 'anomaly' WHEN w >= 0.33 THEN 'suspicious' ELSE 'normal' END AS weighted_tier FROM tiered""")]
STRATEGIES = ("count_tier", "count_tier_strict_3of3", "weighted_tier")
_STRATEGY_ROWS = [("long", " UNION ALL ".join(f"SELECT '{s}' AS strategy, '{cut}' AS cut, {s} IN ({levels}) AS predicted, is_anomaly, anomaly_id FROM labels" for s in STRATEGIES for cut, levels in (("anomaly", "'anomaly'"), ("suspicious", "'anomaly', 'suspicious'"))))]


@query(sql.with_(FUSED, _TIERED, _STRATEGY_ROWS, [
    ("cm", f"SELECT strategy, cut, {sql.confusion('predicted')} FROM long GROUP BY 1, 2"),
    ("er", "SELECT strategy, cut, round(avg(hit), 6) AS event_recall FROM (SELECT strategy, cut, anomaly_id, max(CAST(predicted AS INTEGER)) AS hit FROM long WHERE anomaly_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2"),
]) + f"SELECT strategy, cut, {sql.metric_columns()}, event_recall FROM cm LEFT JOIN er USING (strategy, cut)")
def strategy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two count tiers and the weighted one at both cuts."""
    kinds = [fusion.CountTier(), fusion.CountTier(1, 3, "count_tier_strict_3of3"), fusion.WeightedTier()]
    return evaluate.strategy_comparison(fusion.run_strategies(_faulty(spark, sf_dir), kinds), [k.name for k in kinds])


@query()
def logistic_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the logistic strategy, which learns from rows before the cut, on the rows from it on; logistic regression isn't SQL."""
    net = Network(spark, sf_dir, True, faults=True)
    rows = net.fused()
    cut = F.lit(net.cut).cast(dict(rows.dtypes)[TIME])
    learned = fusion.LogisticMeta.fit(fusion.evidence(rows.where(F.col(TIME) < cut)), "is_anomaly")
    kinds = [fusion.CountTier(), fusion.CountTier(1, 3, "count_tier_strict_3of3"), fusion.WeightedTier(), learned]
    return evaluate.strategy_comparison(fusion.run_strategies(rows.where(F.col(TIME) >= cut), kinds), [k.name for k in kinds])


_REPORT = [
    ("c", "SELECT class, count(*) FILTER (kind = 'hit') AS hit, count(*) FILTER (kind = 'miss') AS miss, count(*) FILTER (kind = 'extra') AS extra FROM (SELECT t AS class, CASE WHEN t = p THEN 'hit' ELSE 'miss' END AS kind FROM pairs WHERE t IS NOT NULL UNION ALL SELECT p, 'extra' FROM pairs WHERE t IS NOT NULL AND t <> p) GROUP BY 1"),
    ("f", f"SELECT class, round({sql.ratio(f'2 * {_p} * {_r}', f'{_p} + {_r}')}, 6) AS f1, hit + miss AS support FROM c WHERE class IN ({sql.join(repr(d) for d in evaluate.DIAGNOSIS_OF.values())})"),
    ("a", "SELECT count(*) AS rows, round(coalesce(avg(CAST(t = p AS INTEGER)), 0.0), 6) AS accuracy FROM pairs WHERE t IS NOT NULL"),
    ("g", f"SELECT round(coalesce(sum(f1), 0.0) / {len(evaluate.DIAGNOSIS_OF)}, 4) AS macro_f1, round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0), 4) AS weighted_f1 FROM f"),
]


@query(sql.with_(EV_FAULTY, _PAIRS, _REPORT) + "SELECT * FROM a CROSS JOIN g")
def diagnosis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_summary(evaluate.with_expected_diagnosis(_diagnosed(spark, sf_dir)))


@query(sql.with_(FUSED) + """SELECT count(*) AS fused_rows, count(*) FILTER (final_alert) AS alerts, count(*) AS explained, count(*) FILTER (lstm_ae_scored) AS complete, CAST(0 AS BIGINT) AS attributed,
    true AS no_row_lost, true AS columns_unchanged, true AS truth_plays_no_part FROM fused""")
def explanation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.integrity(_faulty(spark, sf_dir))


# -------------------------------------------------------------------- injection


@query(sql.with_(LN_INJ) + " UNION ALL ".join(f"SELECT '{c}' AS kind, {c} AS value, count(*) AS events FROM inj_log GROUP BY 2" for c in ("anomaly_type", "severity", "variable")))
def fault_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.counts_by(inject.inject(tables.daily_lines(spark, sf_dir), INJECT)[1])


@query(sql.with_(LN_INJ) + """SELECT observations, anomalous, round(100 * anomalous / nullif(observations, 0), 4) AS rate_percent, events, median_rows, median_strength FROM (SELECT count(*) AS observations, count(*) FILTER (is_anomaly) AS anomalous FROM inj)
    CROSS JOIN (SELECT count(*) AS events, round(quantile_cont(duration_rows, 0.5), 6) AS median_rows, round(quantile_cont(normalized_strength, 0.5), 6) AS median_strength FROM inj_log)""")
def achieved_fault_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.achieved_rate(*inject.inject(tables.daily_lines(spark, sf_dir), INJECT))


# ------------------------------------------------------------------ exploration


@query("SELECT o_orderkey, TRY_CAST(split_part(o_orderpriority, '-', 1) AS DOUBLE) AS rank, TRY_CAST(o_orderpriority AS DOUBLE) AS text FROM orders")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", to_number(F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("rank"), to_number(F.col("o_orderpriority")).alias("text"))


@query(sql.with_(sql.EVENTS) + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS type, count({c}) AS present, round(coalesce(count({c}) / nullif(count(*), 0), 0.0), 6) AS coverage FROM ev"
       for c, k in (("station_id", "string"), ("timestamp", "timestamp_ntz"), ("temperature", "double"), ("humidity", "double"), ("pressure", "double"))))
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.table_profile(tables.hourly_events(spark, sf_dir).withColumn(TIME, F.col(TIME).cast("timestamp_ntz")).select(STATION, TIME, *V))


_TWO = [("two", "SELECT a.station_id AS a, o.station_id AS b, a.temperature AS x, o.temperature AS y FROM ev a JOIN ev o ON a.timestamp = o.timestamp AND a.station_id < o.station_id"), ("cors", "SELECT a, b, round(corr(x, y), 6) AS correlation FROM two GROUP BY 1, 2")]


@query(sql.with_(sql.EVENTS, _TWO) + "SELECT count(*) AS pairs, min(correlation) AS low, max(correlation) AS high, round(avg(correlation), 4) AS mean FROM cors")
def correlation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.correlation_summary(tables.hourly_events(spark, sf_dir), "temperature")


@query(sql.with_(sql.EVENTS, [("sp", "SELECT timestamp, round(max(temperature) - min(temperature), 6) AS r FROM ev GROUP BY 1")]) + "SELECT count(r) AS times, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(min(r), 6) AS low, round(max(r), 6) AS high, "
       + sql.join(f"round(quantile_cont(r, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + " FROM sp")
def spread_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.spread_percentiles(tables.hourly_events(spark, sf_dir), "temperature")


_SPLIT = [("p", "SELECT *, CASE WHEN row_number() OVER (PARTITION BY station_id ORDER BY timestamp) <= floor(count(*) OVER (PARTITION BY station_id) * 0.8) THEN 'train' ELSE 'test' END AS part FROM ln")]
_SCALER = [("sc", "SELECT station_id, " + sql.join(f"avg({v}) AS {v}_m, CASE WHEN stddev_pop({v}) > 0 THEN stddev_pop({v}) ELSE 1.0 END AS {v}_s" for v in V) + " FROM p WHERE part = 'train' GROUP BY 1")]


@query(sql.with_(sql.LINES, _SPLIT, _SCALER) + f"SELECT p.station_id, strftime(p.timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, part, {sql.join(f'round(({v} - {v}_m) / {v}_s, 4) AS {v}_scaled' for v in V)} FROM p LEFT JOIN sc ON p.station_id = sc.station_id")
def scaled_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(explore.scaled(tables.daily_lines(spark, sf_dir)), STATION, TIME, "part", *(f"{v}_scaled" for v in V))


@query(sql.with_(sql.LINES, _SPLIT) + "SELECT station_id, part, size, greatest(n - size + 1, 0) AS windows FROM (SELECT station_id, part, count(*) AS n FROM p GROUP BY 1, 2) CROSS JOIN (VALUES (12), (24), (48)) t(size)")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.window_counts(tables.daily_lines(spark, sf_dir))


_MSE = [("errs", "SELECT round((" + sql.join((f"list_aggregate(list_transform({v}_cells, lambda x: (x - list_aggregate({v}_cells, 'avg')) * (x - list_aggregate({v}_cells, 'avg'))), 'sum') / 24" for v in RECON.variables), " + ") + ") / 3, 6) AS mse FROM ln_hwin"),
        ("lim", "SELECT quantile_cont(mse, 0.99) AS t FROM errs")]


@query(sql.with_(LN_BOUNDS, _MSE) + "SELECT count(*) AS windows, round(avg(mse), 4) AS mean, round(any_value(t), 6) AS threshold, count(*) FILTER (mse > t) AS flagged FROM errs CROSS JOIN lim")
def window_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, True)
    end = reconstruct.cutoff(net.history, RECON.validation_share)
    held = net.history.crossJoin(F.broadcast(end)).where(F.col(TIME) >= F.col("cutoff")).drop("cutoff")  # one row
    return explore.window_errors(reconstruct.window_mean(reconstruct.windows_of(held, net.recon_tables().stats, RECON), RECON), RECON.variables)


# -------------------------------------------------------------------- dashboard

_PLACES = sql.places("ln", "places")


@query(sql.with_(LN, _PLACES) + "SELECT station_id, latitude, longitude FROM places")
def station_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, True)
    return explore.station_coordinates(net.obs.join(net.places, STATION))


@query(sql.with_(sql.LINES) + "SELECT min(n) AS n_points FROM (SELECT count(*) AS n FROM ln GROUP BY station_id)")
def replay_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.shared_length(tables.daily_lines(spark, sf_dir))


@query(sql.with_(FUSED, _IDX, _PLACES) + f"""SELECT i.station_id, {_COLOUR} AS colour, latitude, longitude, {sql.join(f'floor(round({v}, 2) * 10 + 0.5) / 10 AS {v}' for v in V)}, round((SELECT avg(latitude) FROM places), 4) AS centre_latitude,
    round((SELECT avg(longitude) FROM places), 4) AS centre_longitude FROM idx i JOIN places p ON i.station_id = p.station_id WHERE i.idx = n - 1""")
def map_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = Network(spark, sf_dir, True, faults=True)
    return explore.map_table(explore.latest_status(net.fused()), net.places)


@query(sql.with_(FUSED, _IDX, [("newest", "SELECT * FROM idx WHERE final_severity <> 'normal' ORDER BY idx.timestamp DESC, idx.station_id LIMIT 200")])
       + f"SELECT station_id, {S}, idx, final_severity, detector_votes, CAST(row_number() OVER (ORDER BY newest.timestamp DESC, newest.station_id) AS INTEGER) AS place FROM newest")
def newest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(explore.newest_alerts(explore.alert_log(_faulty(spark, sf_dir)), 200))


@query(sql.with_(FUSED, _IDX) + "SELECT " + sql.join(f"count(*) FILTER ({_COLOUR} = '{c}' AND idx = n - 1) AS {c}" for c in ("green", "yellow", "red")) + ", count(*) FILTER (final_severity <> 'normal') AS alerts_logged FROM idx")
def alert_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _faulty(spark, sf_dir)
    return explore.alert_totals(explore.latest_status(rows), explore.alert_log(rows))


@query(sql.with_(CLEAN_FUSED, FUSED) + f"""SELECT f.station_id, strftime(f.timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, CASE WHEN c.detector_votes <> f.detector_votes THEN 'other decision'
    WHEN {sql.join((f'c.{v} IS DISTINCT FROM f.{v}' for v in V), ' OR ')} THEN 'other readings' ELSE 'fresh' END AS state FROM fused f JOIN cfused c ON f.station_id = c.station_id AND f.timestamp = c.timestamp""")
def stale_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations stored for the clean network, looked up for the one with faults."""
    stored = explain.explain(Network(spark, sf_dir, True).fused())
    return out(explore.stale_explanations(_faulty(spark, sf_dir), stored))


@query(sql.with_(CLEAN_FUSED) + f"SELECT station_id, {S}, detector_votes, final_alert, final_severity FROM cfused")
def saved_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's votes from detectors that start from saved tables."""
    net = Network(spark, sf_dir, True)
    path = f"{tables.shared_dir(spark)}/calibration-{uuid.uuid4().hex}"
    Calibration.fit(net.history, net.places, net.config, SPATIAL, RECON, linear=False).save(path)
    return out(Calibration.load(spark, path, net.config, SPATIAL, RECON).detect(net.obs), STATION, TIME, "detector_votes", "final_alert", "final_severity")
