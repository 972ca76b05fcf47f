"""Logistic fusion against a direct computation, diagnosis of fused rows, planted failures of explanations, twins and pair moments."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stationwatch.operators import diagnosis, explain, explore, fusion, series
from stationwatch.sources import tables

START = datetime(2025, 1, 1)
OBS = "station_id string, timestamp timestamp, temperature double, humidity double, pressure double"


def test_logistic_weights_are_those_of_newtons_method(spark):
    rng = np.random.default_rng(0)
    n = 400
    x = rng.random((n, 3))
    y = (rng.random(n) < 1 / (1 + np.exp(-(4 * x[:, 0] - 3 * x[:, 1] + x[:, 2] - 0.5)))).astype(float)
    w = np.zeros(4)
    z = np.c_[x, np.ones(n)]
    ridge = np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    names = sorted(fusion.REGISTRY)
    score = "struct<score: double>"
    rows = spark.createDataFrame([(tuple((float(v),) for v in r), bool(t)) for r, t in zip(x, y)], f"evidence struct<{', '.join(f'{k}: {score}' for k in names)}>, truth boolean")
    found = fusion.LogisticMeta.fit(rows, "truth")
    assert np.allclose([*(found.weights[k] for k in names), found.intercept], w, atol=1e-3)
    got = np.array([r[0] for r in found.apply(rows).select("fusion_logistic_meta_score").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-z @ w)), atol=1e-3)


def _shape(station, residuals):
    return [(station, START + timedelta(hours=i), 20 + 0.2 * i + r, 50.0, 1010.0, i, 20 + 0.2 * i, 3) for i, r in enumerate(residuals)]


def test_fused_rows_are_diagnosed_by_their_neighbours(spark):
    rows = spark.createDataFrame(_shape("a", [6.0] * 6), f"{OBS}, i int, temperature_spatial_expected double, temperature_spatial_neighbor_count int").withColumn("final_alert", F.col("i") == 5)
    reference = spark.createDataFrame([("a", "temperature", 0.0, 1.0, 0.0, 1.0, 3.0)], "station_id string, variable string, residual_center double, residual_scale double, rate_center double, rate_scale double, rate_threshold double")
    found = diagnosis.diagnose_fused(rows, reference, "2024-12-31 23:00:00").where("i = 5").first()
    assert (found.diagnosis, found.diagnosis_variable, found.diagnosis_reference_status) == ("SENSOR_OFFSET", "temperature", "available")
    poisoned = rows.withColumns({"is_anomaly": F.lit(False), "anomaly_type": F.lit("noise"), "temperature_original": F.lit(3.0)})
    assert diagnosis.diagnose_fused(poisoned, reference).where("i = 5").first().diagnosis_evidence == found.diagnosis_evidence
    import json

    shape = json.loads(found.diagnosis_evidence)["shape"]
    assert shape["median"] == 6.0 and shape["same_sign"] == 1.0 and shape["ready"] and set(shape) <= set(diagnosis.SHAPE)
    without = diagnosis.diagnose_fused(rows, None).where("i = 5").first()
    assert without.diagnosis == "UNCLASSIFIED_ANOMALY" and "missing" in without.diagnosis_reference_status


@pytest.fixture(scope="module")
def fused(spark):
    rows = [("A", START + timedelta(hours=i), 1.0, 2.0, 3.0, i % 2 == 0, True, False, i % 3 == 0) for i in range(12)]
    return tables.stage(fusion.vote(spark.createDataFrame(rows, f"{OBS}, statistical_alert boolean, spatial_alert boolean, lstm_ae_alert boolean, is_anomaly boolean")), "fused")


def test_integrity_sees_planted_failures(fused, monkeypatch):
    good = explain.integrity(fused).first()
    assert good.no_row_lost and good.columns_unchanged and good.truth_plays_no_part and good.explained == 12
    real = explain.explain
    monkeypatch.setattr(explain, "explain", lambda rows, *a: real(rows, *a).where(F.hour("timestamp") != 3))
    lost = explain.integrity(fused).first()
    assert not lost.no_row_lost and lost.explained == 11 and not lost.columns_unchanged
    monkeypatch.setattr(explain, "explain", lambda rows, *a: real(rows, *a).withColumn("temperature", F.col("temperature") + 1))
    assert not explain.integrity(fused).first().columns_unchanged
    monkeypatch.setattr(explain, "explain", lambda rows, *a: real(rows, *a).withColumn("explanation", F.concat("explanation", F.col("is_anomaly").cast("string"))))
    assert not explain.integrity(fused).first().truth_plays_no_part


def test_repeated_rows_are_logged_once(spark):
    rows = [("A", START, "normal", 0), ("A", START + timedelta(hours=1), "anomaly", 2), ("A", START + timedelta(hours=1), "anomaly", 2), ("A", START + timedelta(hours=2), "suspicious", 1), ("B", START, "critical", 3)]
    found = explore.alert_log(spark.createDataFrame(rows, "station_id string, timestamp timestamp, final_severity string, detector_votes int"))
    assert sorted((r.station_id, r.idx, r.final_severity) for r in found.collect()) == [("A", 1, "anomaly"), ("A", 2, "suspicious"), ("B", 0, "critical")]


@pytest.mark.parametrize(("block", "rows"), [(256, 1 << 20), (2, 40)])
def test_pairs_of_series_match_a_direct_join(spark, monkeypatch, block, rows):
    monkeypatch.setattr(series, "BLOCK", block)
    monkeypatch.setattr(series, "SPAN_ROWS", rows)
    rng = np.random.default_rng(6)
    data = []
    for s in "ABCDEFG":
        for h in range(60):
            if rng.random() < 0.8:
                x = None if rng.random() < 0.1 else 5.0 if s == "F" else float(np.sin(h / 5) + (rng.normal() if s not in "CD" else 0) + 1000)
                data.append((s, START + timedelta(hours=h), x))
    data += [("Z", START + timedelta(days=99), 1.0)]
    obs = spark.createDataFrame(data, "station_id string, timestamp timestamp, v double")
    p = pd.DataFrame(data, columns=["s", "t", "v"])
    both = p.merge(p, on="t").query("s_x < s_y")
    same = lambda g: bool(((g.v_x == g.v_y) | (g.v_x.isna() & g.v_y.isna())).all())
    want = {key: (len(g), g.v_x.astype(float).corr(g.v_y.astype(float)), same(g)) for key, g in both.groupby(["s_x", "s_y"])}
    found = series.correlations(obs, "v").join(series.identical_series(obs, "v"), ["a", "b"]).collect()
    assert {(r.a, r.b) for r in found} == set(want)
    for r in found:
        n, c, same = want[r.a, r.b]
        assert (r.n, r.identical) == (n, same)
        assert r.correlation == pytest.approx(c, abs=2e-6, nan_ok=True) if "F" not in (r.a, r.b) else np.isnan(r.correlation)


def test_twins_have_the_same_values_at_the_same_times(spark):
    rows = [(s, START + timedelta(hours=h), None if h == 3 else float(h + (s == "C" and h == 5))) for s in "ABC" for h in range(9)] + [("D", START + timedelta(hours=h), None if h == 3 else float(h)) for h in range(8)]
    found = {r.station_id: (r.rows, r.twins, r["first"]) for r in series.twins(spark.createDataFrame(rows, "station_id string, timestamp timestamp, v double").repartition(5), "v").collect()}
    assert found == {"A": (9, 2, "A"), "B": (9, 2, "A"), "C": (9, 1, "C"), "D": (8, 1, "D")}
