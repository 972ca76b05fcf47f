"""Guards, saved calibrations, pushed-down reads and the tables of evaluation, exploration and dashboard."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwatch.functions.scalar import to_number
from stationwatch.operators import evaluate, explain, explore, fusion, inject, statistical
from stationwatch.plans.calibration import Calibration
from stationwatch.sources import tables

START = datetime(2025, 1, 1)
OBS = "station_id string, timestamp timestamp, temperature double, humidity double, pressure double"


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(3)
    rows = [(s, START + timedelta(hours=h), 20 + 5 * float(np.sin(h / 4)) + float(rng.normal()) * 0.3, 50 + float(rng.normal()), 1010 + float(rng.normal())) for s in "ABCDE" for h in range(240)]
    return tables.stage(spark.createDataFrame(rows, OBS), "obs")


def test_inputs_are_checked(spark, obs):
    twice = obs.unionByName(obs.limit(1))
    with pytest.raises(tables.InvalidData, match="repeated"):
        fusion.join_outputs(obs, twice)
    with pytest.raises(tables.InvalidData, match="missing"):
        inject.inject(obs.drop("pressure"))
    with pytest.raises(tables.InvalidData, match="no faults are known"):
        inject.inject(obs.withColumn("wind", F.lit(1.0)), variables=("temperature", "wind"))
    with pytest.raises(tables.InvalidData, match="no observations"):
        inject.inject(obs.where("false"))
    with pytest.raises(tables.InvalidData, match="more than one place"):
        tables.check_coordinates(spark.createDataFrame([("A", 1.0, 2.0), ("A", 1.0, 3.0)], "station_id string, latitude double, longitude double"))


def test_numbers_from_text(spark):
    rows = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",), (" 2 ",), ("1e3",)], "t string")
    assert [r[0] for r in rows.select(to_number(F.col("t"))).collect()] == [1.5, None, None, None, 2.0, 1000.0]


def test_keys_reach_the_scan(spark, obs, tmp_path):
    tables.write_parquet(obs, f"{tmp_path}/obs")
    found = tables.read_station(spark, f"{tmp_path}/obs", "B", "2025-01-02 00:00:00", "2025-01-02 05:00:00")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(station_id,B)" in plan and "GreaterThanOrEqual(timestamp" in plan
    assert found.count() == 6
    tables.write_json_lines(found, f"{tmp_path}/json")
    assert {json.loads(r[0])["station_id"] for r in spark.read.text(f"{tmp_path}/json").collect()} == {"B"}


def test_readers_fall_back_only_on_missing_paths(spark, obs, tmp_path):
    tables.write_csv(obs.limit(3), f"{tmp_path}/csv")
    with pytest.raises(tables.InvalidData):
        tables.read_observations(spark)
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="(?i)footer|parquet|magic"):
        tables.read_observations(spark, f"{tmp_path}/broken", f"{tmp_path}/csv").count()


def test_saved_calibration_detects_the_same(spark, obs, tmp_path):
    fitted = Calibration.fit(obs, tables.station_places(obs))
    fitted.save(f"{tmp_path}/cal")
    loaded = Calibration.load(spark, f"{tmp_path}/cal")
    key = lambda df: sorted((r.station_id, r.timestamp, r.detector_votes, r.final_severity, r.lstm_ae_score) for r in df.collect())
    assert key(loaded.detect(obs)) == key(fitted.detect(obs))
    from stationwatch.config import ReconstructionConfig

    with pytest.raises(tables.InvalidData, match="window"):
        Calibration.load(spark, f"{tmp_path}/cal", reconstruction_config=ReconstructionConfig(window=12))


def test_deviations_from_running_totals(spark, obs):
    found = statistical.detect(obs, statistical.calibrate(obs)).toPandas().sort_values(["station_id", "timestamp"])
    for _, own in found.groupby("station_id"):
        r = own.temperature_hourly_residual
        for w in (24, 168):
            want = ((r - r.rolling(w, min_periods=6).mean().shift(1)) / r.rolling(w, min_periods=6).std().shift(1)).abs()
            assert np.allclose(own[f"temperature_zscore_{w}h"].astype(float), want, atol=1e-4, equal_nan=True)


def test_class_scores(spark):
    pairs = [("SPIKE", "SPIKE")] * 3 + [("SPIKE", "SENSOR_DRIFT")] + [("SENSOR_DRIFT", "SENSOR_DRIFT")] * 2 + [("STUCK_SENSOR", "UNCLASSIFIED_ANOMALY")] + [(None, "SPIKE"), ("SPIKE", None)]
    row = evaluate.class_summary(spark.createDataFrame(pairs, "expected string, diagnosis string")).first()
    spike, drift = 2 * 1 * 0.75 / 1.75, 2 * (2 / 3) * 1 / (5 / 3)
    assert row.rows == 7 and row.accuracy == round(5 / 7, 6)
    assert row.macro_f1 == round((spike + drift) / 7, 4) and row.weighted_f1 == round((4 * spike + 2 * drift) / 7, 4)
    empty = evaluate.class_summary(spark.createDataFrame([], "expected string, diagnosis string")).first()
    assert (empty.rows, empty.accuracy, empty.macro_f1, empty.weighted_f1) == (0, 0.0, 0.0, 0.0)


def test_dashboard_tables(spark):
    rows = spark.createDataFrame(
        [(s, START + timedelta(hours=h), 20.04, 50.0, 1010.0, h == 3 and s == "A", "anomaly" if h == 3 and s == "A" else "normal", 2 if h == 3 and s == "A" else 0, False, False, False) for s in "AB" for h in range(4 if s == "A" else 3)],
        OBS + ", final_alert boolean, final_severity string, detector_votes int, statistical_alert boolean, spatial_alert boolean, lstm_ae_alert boolean")
    status, log = explore.latest_status(rows), explore.alert_log(rows)
    assert explore.shared_length(rows).first().n_points == 3
    assert tuple(explore.alert_totals(status, log).first()) == (1, 0, 1, 1)
    assert [r.place for r in explore.newest_alerts(log, 5).collect()] == [1]
    table = {r.station_id: r for r in explore.map_table(status, tables.station_places(rows)).collect()}
    assert table["A"].colour == "red" and table["A"].temperature == 20.0 and table["A"].centre_latitude == table["B"].centre_latitude


def test_explanations_go_stale(spark):
    base = [("A", START, 1.0, 2.0, 3.0, True, True, False, 2, True, "anomaly"), ("A", START + timedelta(hours=1), 1.0, 2.0, 3.0, False, False, False, 0, False, "normal"), ("A", START + timedelta(hours=2), float("inf"), None, 3.0, False, False, False, 0, False, "normal")]
    kind = OBS + ", statistical_alert boolean, spatial_alert boolean, lstm_ae_alert boolean, detector_votes int, final_alert boolean, final_severity string"
    fused = spark.createDataFrame(base, kind)
    told = explain.explain(fused)
    changed = spark.createDataFrame([base[0][:2] + (9.0,) + base[0][3:], base[1][:5] + (True, True, False, 2, True, "anomaly"), ("B", *base[1][1:])], kind)
    assert [r.state for r in explore.stale_explanations(changed, told).orderBy("station_id", "timestamp").collect()] == ["other readings", "other decision", "missing"]
    row = explain.integrity(fused.withColumns({"is_anomaly": F.lit(True), "anomaly_type": F.lit("spike")})).first()
    assert row.no_row_lost and row.columns_unchanged and row.truth_plays_no_part and (row.fused_rows, row.explained, row.attributed) == (3, 3, 0)
