"""Detectors, fusion, injection, diagnosis, explanation and evaluation on small tables."""

import json
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationwatch.config import ReconstructionConfig, SpatialConfig
from stationwatch.operators import diagnosis, evaluate, explain, explore, fusion, inject, reconstruct, spatial, statistical
from stationwatch.sources import rest, tables
from stationwatch.streaming import replay

START = datetime(2025, 1, 1)
PLACES = [("A", 28.61, 77.21), ("B", 28.46, 77.03), ("C", 28.54, 77.39), ("D", 28.41, 77.32)]


def series(hours=336, stations="ABC", noise=0.3):
    rng = np.random.default_rng(1)
    rows = []
    for k, s in enumerate(stations):
        for h in range(hours):
            day = np.sin(2 * np.pi * h / 24)
            rows.append([s, START + timedelta(hours=h), 20 + 5 * day + k * 0.2 + noise * rng.normal(), 50 + 10 * day + noise * rng.normal(), 1010 + day + noise * rng.normal()])
    return rows


def frame(spark, rows, extra=""):
    return spark.createDataFrame([tuple(None if isinstance(x, float) and np.isnan(x) else x for x in map(lambda x: float(x) if isinstance(x, np.floating) else x, r)) for r in rows],
                                 "station_id string, timestamp timestamp, temperature double, humidity double, pressure double" + extra)


def test_statistical_flags(spark):
    clean = series()
    rows = [list(r) for r in clean]
    rows[100][2] = 80.0
    rows[336 + 220][2] += 20
    for h in range(150, 158):
        rows[672 + h][2] = 21.0
    found = statistical.detect(frame(spark, rows), statistical.calibrate(frame(spark, clean))).toPandas().set_index(["station_id", "timestamp"])
    at = lambda s, h: found.loc[(s, START + timedelta(hours=h))]
    assert at("A", 100).evidence_range and at("A", 100).statistical_severity_label == "critical" and at("B", 220).statistical_alert
    assert at("C", 157).temperature_persistence_anomaly and at("C", 157).statistical_severity_label in ("anomaly", "critical")
    r = found.loc["A"].sort_index().temperature_hourly_residual
    want = ((r - r.rolling(24, min_periods=6).mean().shift(1)) / r.rolling(24, min_periods=6).std().shift(1)).abs()
    assert np.allclose(found.loc["A"].sort_index().temperature_zscore_24h.astype(float), want, atol=2e-3, equal_nan=True)
    assert len(found) == len(rows) and statistical.alert_summary(frame(spark, []).limit(0).transform(lambda d: statistical.detect(d, statistical.calibrate(frame(spark, clean))))).count() == 15


def test_spatial_isolated_and_regional(spark):
    config = SpatialConfig(neighbours=3)
    clean = series(720, "ABCD")
    graph = spatial.neighbours(spark.createDataFrame(PLACES, "station_id string, latitude double, longitude double"), config)
    assert graph.groupBy("station_id").agg(F.round(F.sum("weight"), 4).alias("w")).where("w <> 1").isEmpty()
    rows = [list(r) for r in clean]
    rows[500][2] += 15
    for k in range(4):
        rows[720 * k + 600][2] += 6
    found = spatial.detect(frame(spark, rows), graph, spatial.calibrate(frame(spark, clean), graph, config), config).toPandas().set_index(["station_id", "timestamp"])
    assert found.loc[("A", START + timedelta(hours=500))].spatial_alert
    assert not any(found.loc[(s, START + timedelta(hours=600))].spatial_alert for s in "ABCD")


def test_robust_consensus(spark):
    graph = spark.createDataFrame([("X", n, i + 1, 1.0, 1 / 3) for i, n in enumerate("ABC")], "station_id string, neighbor_id string, rank int, distance_km double, weight double")
    rows = [("A", START, 10.0, 1.0, None), ("B", START, 10.0, float("inf"), None), ("C", START, 50.0, 3.0, None)]
    got = spatial.expected(frame(spark, rows), graph).first()
    assert (got.temperature_spatial_expected, got.temperature_spatial_neighbor_count) == (10.0, 2)
    assert (got.humidity_spatial_expected, got.humidity_spatial_neighbor_count) == (2.0, 2) and got.pressure_spatial_neighbor_count == 0


@pytest.mark.parametrize(("gap", "kept"), [((10, 14), True), ((10, 15), False), ((0, 2), True), ((0, 3), False)])
def test_window_fill_limits(spark, gap, kept):
    rows = series(24, "A")
    for h in range(*gap):
        rows[h][2] = float("nan")
    obs = frame(spark, rows)
    stats = reconstruct.normalisation(frame(spark, series(48, "A")))
    assert (reconstruct.windows_of(obs, stats).count() == 1) == kept


def test_reconstruction(spark):
    config = ReconstructionConfig(own_statistics_rows=100)
    clean = series(400, "AB")
    rows = [list(r) for r in clean]
    rows[300][2] += 12
    tables_ = reconstruct.calibrate(frame(spark, clean), config)
    found = reconstruct.detect(frame(spark, rows), tables_, config).toPandas().set_index(["station_id", "timestamp"])
    hit = found.loc[("A", START + timedelta(hours=300))]
    assert hit.lstm_ae_alert and hit.lstm_ae_top_contributor == "temperature" and len(found) == len(rows)
    cells = reconstruct.windows_of(frame(spark, clean), tables_.stats, config).where("station_id = 'A'").limit(5)
    back = tables_.model.rebuild(cells, config).toPandas()
    x = np.stack([np.concatenate([r[f"{v}_cells"] for v in config.variables]) for _, r in back.iterrows()])
    y = np.stack([np.concatenate([r[f"{v}_rebuilt"] for v in config.variables]) for _, r in back.iterrows()])
    p = tables_.model.directions
    assert np.allclose(y, (x - tables_.model.mean) @ p @ p.T + tables_.model.mean)
    few = reconstruct.detect(frame(spark, series(5, "A")), tables_, config)
    assert few.where("lstm_ae_severity_label = 'unscored' AND NOT lstm_ae_alert").count() == 5


VOTE = "station_id string, timestamp timestamp, temperature double, humidity double, pressure double, statistical_alert boolean, spatial_alert boolean, lstm_ae_alert boolean"


@pytest.mark.parametrize("n", range(4))
def test_votes(spark, n):
    row = ("A", START, 1.0, 2.0, float("inf"), *[True] * n, *[None] * (3 - n))
    got = fusion.vote(spark.createDataFrame([row], VOTE))
    first = got.first()
    assert (first.detector_votes, first.final_alert, first.final_severity) == (n, n >= 2, ("normal", "suspicious", "anomaly", "critical")[n])
    text = json.loads(explain.explain(got).first().explanation)
    assert text["decision"]["votes"] == n and text["readings"]["pressure"] is None and text["timestamp"] == "2025-01-01T00:00:00Z"
    with pytest.raises(Exception, match="contradict"):
        explain.decision(got.withColumn("final_alert", ~F.col("final_alert"))).select("decision").collect()
    with pytest.raises(tables.InvalidData):
        explain.explain(got.unionAll(got))


def test_strategies(spark):
    rows = [(True, 1.0, "critical", False, "normal", None, None, None), (True, 0.67, "anomaly", True, "anomaly", True, 0.9, "anomaly")] * 20
    df = spark.createDataFrame(rows, "statistical_alert boolean, statistical_severity double, statistical_severity_label string, spatial_alert boolean, spatial_severity_level string, lstm_ae_alert boolean, lstm_ae_severity_score double, lstm_ae_severity_label string")
    got = fusion.run_strategies(df, [fusion.CountTier(), fusion.WeightedTier()]).distinct().orderBy("statistical_severity").collect()
    assert [(r.fusion_count_tier_label, r.fusion_count_tier_score) for r in got] == [("anomaly", 1.0), ("suspicious", 0.5)]
    assert [r.fusion_weighted_tier_label for r in got] == ["anomaly", "suspicious"]
    data = fusion.evidence(df.withColumn("truth", F.col("spatial_alert")))
    scored = fusion.LogisticMeta.fit(data, "truth").apply(data)
    assert scored.where("fusion_logistic_meta_score > 0.5 AND truth").count() == 20
    with pytest.raises(ValueError, match="registered"):
        fusion.register(fusion.REGISTRY["spatial"])


def test_injection_invariants(spark):
    obs = frame(spark, series(1440, "ABCD"))
    config = inject.InjectionConfig(rate=0.03)
    out, log = inject.inject(obs, config)
    p, events = out.toPandas(), log.toPandas()
    assert len(p) == 5760 and 0.01 < p.is_anomaly.mean() < 0.05 and set(events.anomaly_type) <= {k for k, _ in inject.TYPE_SHARES}
    members = evaluate.label_membership(out).toPandas()
    assert len(members) == events.duration_rows.sum() and (events[events.anomaly_type == "spike"].duration_rows == 1).all()
    p = p.set_index(["station_id", "timestamp"]).sort_index()
    for e in events.itertuples():
        v = p.loc[e.station_id].loc[e.start_time : e.end_time][e.variable]
        assert e.anomaly_type != "dropout" or v.isna().all()
        assert e.anomaly_type != "stuck" or v.nunique() == 1
    assert p[~p.is_anomaly].temperature.equals(p[~p.is_anomaly].temperature_original)


def shape(residuals, gap=None, peers=True):
    rows = []
    for i, r in enumerate(residuals):
        peer = 20 + 0.2 * i
        x = None if r is None else float(peer + r)
        rows.append(["a", START + timedelta(hours=i + (1 if gap is not None and i >= gap else 0)), x, 50.0, 1010.0, i, float(peer) if peers else None, 3])
    return rows


EXTRA = ", i int, behavior_peer_expected_temperature double, behavior_peer_count_temperature int"
PARAMETERS = "station_id string, variable string, residual_center double, residual_scale double, rate_center double, rate_scale double, rate_threshold double"


@pytest.mark.parametrize(("residuals", "alert", "kind", "gap", "peers"), [
    ([0, 0, 0, 0, 0, None], 5, "DATA_DROPOUT", None, True), ([0, 0, 0, 0, 0, float("inf")], 5, "DATA_DROPOUT", None, True), ([0, 0, 10, 0, 0, 0], 2, "SPIKE", None, True),
    ([6] * 6, 5, "SENSOR_OFFSET", None, True), ([6, 7, 8, 9, 10, 11], 5, "SENSOR_DRIFT", None, True), ([-8, 10, -15, 7, -5, 18], 5, "NOISY_SENSOR", None, True),
    ([0, 0, 0, 0, 0, 20], 5, "RATE_CHANGE", None, True), ([0] * 6, 5, "UNCLASSIFIED_ANOMALY", None, True), ([6] * 6, 5, "UNCLASSIFIED_ANOMALY", 3, True), ([6] * 6, 5, "UNCLASSIFIED_ANOMALY", None, False),
    ([-0.2 * i for i in range(6)], 5, "STUCK_SENSOR", None, True),
])
def test_diagnosis_shapes(spark, residuals, alert, kind, gap, peers):
    df = frame(spark, shape(residuals, gap, peers), EXTRA).withColumn("final_alert", F.col("i") == alert)
    reference = spark.createDataFrame([("a", "temperature", 0.0, 1.0, 0.0, 1.0, 3.0)], PARAMETERS)
    got = {r.i: r for r in diagnosis.diagnose(df.withColumn("is_anomaly", F.lit(True)), reference, "2024-12-31 23:00:00").collect()}
    assert got[alert].diagnosis == kind and len(got) == 6 and got[0].diagnosis is None and got[0].diagnosis_evidence == "{}"
    with pytest.raises(tables.InvalidData, match="strictly precede"):
        diagnosis.diagnose(df, reference, "2025-01-02 00:00:00")
    with pytest.raises(tables.InvalidData):
        diagnosis.diagnose(df.unionAll(df), reference)


def test_network_corroboration(spark):
    def station(name, residuals):
        return [[name, *r[1:]] for r in shape(residuals)]

    reference = spark.createDataFrame([(s, "temperature", 0.0, 1.0, 0.0, 1.0, 3.0) for s in "abc"], PARAMETERS)
    rows = station("a", [6] * 6) + station("b", [0] * 6) + station("c", [0] * 6)
    df = frame(spark, rows, EXTRA).withColumn("final_alert", (F.col("i") == 5) & (F.col("station_id") == "a"))
    assert diagnosis.diagnose(df, reference).where("final_alert").first().operational_class == "SENSOR_FAULT"
    assert diagnosis.diagnose(df.where("station_id = 'a'"), reference).where("final_alert").first().operational_class == "UNCERTAIN"
    moved = df.withColumns({c: F.when(F.col("i") == 5, F.lit(26.0)).otherwise(F.lit(20.0)) for c in ("temperature", "behavior_peer_expected_temperature")})
    assert diagnosis.diagnose(moved, reference).where("final_alert").first().operational_class == "POSSIBLE_ENVIRONMENTAL_EVENT"


def test_evaluation(spark):
    rows = [("A", START + timedelta(hours=i), i in (5, 6), i in (6, 9), "e" if i in (5, 6) else None) for i in range(40)]
    df = spark.createDataFrame(rows, "station_id string, timestamp timestamp, is_anomaly boolean, p boolean, anomaly_id string")
    m = evaluate.metrics(df, "p").first()
    assert (m.tp, m.fp, m.fn, m.tn, m.precision, m.recall) == (1, 1, 1, 37, 0.5, 0.5)
    assert evaluate.event_recall(df, "p").first().event_recall == 1.0
    far = {r.timestamp: r.anomaly_distance for r in evaluate.distance_to_anomaly(df).collect()}
    assert far[START] == 5 and far[START + timedelta(hours=9)] == 3
    empty = evaluate.metrics(df.where("false"), "p").first()
    assert (empty.tp, empty.precision, empty.fpr) == (0, 0.0, 0.0)
    with pytest.raises(tables.InvalidData):
        evaluate.align(df, df.where("p"), ["p"])
    assert evaluate.align(df, df, ["p"]).count() == 40


def test_sources(spark, tmp_path):
    obs = frame(spark, series(5, "A"))
    tables.write_parquet(obs, f"{tmp_path}/o", by_station=True)
    assert tables.read_observations(spark, f"{tmp_path}/o").count() == 5
    tables.write_csv(obs.select("timestamp", "station_id"), f"{tmp_path}/c")
    assert tables.read_observations(spark, f"{tmp_path}/missing", f"{tmp_path}/c").count() == 5
    hourly = statistical.calibrate(obs)
    tables.save_tables({"hourly": hourly}, {"variables": ["temperature", "humidity", "pressure"]}, f"{tmp_path}/m")
    loaded, manifest = tables.load_tables(spark, f"{tmp_path}/m")
    assert loaded["hourly"].count() == hourly.count() and manifest["variables"][0] == "temperature"
    with pytest.raises(tables.InvalidData):
        tables.load_tables(spark, f"{tmp_path}/m", ("pressure",))
    with pytest.raises(tables.InvalidData):
        tables.check_years(obs, 2026, 2026)
    answer = {"hourly": {"time": ["2025-01-01T00:00"], **{k: [1.0] for k in rest.HOURLY}}}
    assert next(rest.rows_of(answer, {"station_id": "A", "latitude": 1, "longitude": 2}))[5] == 1.0
    spark.dataSource.register(rest.HourlyArchive)
    options = {"url": f"file://{tmp_path}/nothing", "start": "2025-01-01", "end": "2025-01-01", "pause": "0", "retries": "0", "stations": json.dumps([{"station_id": "A", "latitude": 1, "longitude": 2}])}
    read = spark.read.format("hourly_archive").options(**options).load()
    assert rest.observations(read).count() == 0 and [r.station_id for r in rest.failures(read).collect()] == ["A"]


def test_replay_stream(spark, tmp_path):
    rows = [("A", START + timedelta(hours=i), "anomaly" if i % 3 == 0 else "normal") for i in range(9)]
    df = spark.createDataFrame(rows + rows[:1], "station_id string, timestamp timestamp, final_severity string")
    df.coalesce(1).write.parquet(f"{tmp_path}/s")
    stream = replay.alert_stream(replay.replay(spark, f"{tmp_path}/s", df.schema))
    q = stream.writeStream.format("memory").queryName("alerts").option("checkpointLocation", f"{tmp_path}/k").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT count(*) AS n FROM alerts").first().n == 3


def test_labels_and_order_change_nothing(spark):
    rows = series(100, "AB")
    hourly = statistical.calibrate(frame(spark, rows))
    one = statistical.detect(tables.detector_input(frame(spark, rows).withColumn("is_anomaly", F.lit(True))), hourly).toPandas()
    two = statistical.detect(frame(spark, rows[::-1]), hourly).toPandas()
    order = ["station_id", "timestamp"]
    pd.testing.assert_frame_equal(one.sort_values(order).reset_index(drop=True), two.sort_values(order).reset_index(drop=True))


def test_traffic_light_and_profile(spark):
    obs = frame(spark, series(3, "A"))
    assert explore.profile(obs).first().rows == 3
    assert {r.light for r in explore.traffic_light(obs, {"temperature": (0.0, 1.0, 2.0, 100.0)}).collect()} == {"yellow"}


@pytest.mark.parametrize("name", ["obs_hourly", "hourly_calibration", "statistical_severity", "spatial_severity", "fault_plan", "station_correlation", "segments"])
def test_queries_match_their_sql(spark, name):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns)
    text = lambda p: sorted(map(str, p[columns].round(4).astype(object).where(p[columns].notna(), None).values.tolist()))
    assert text(got.astype({c: float for c in got.select_dtypes("number")})) == text(want.astype({c: float for c in want.select_dtypes("number")}))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
