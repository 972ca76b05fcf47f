"""Attribution of reconstruction scores: shares add up, budgets and contexts that can't be explained, nonlinear models too."""

from datetime import datetime, timedelta
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationwatch.config import ReconstructionConfig
from stationwatch.operators import explain, neural, reconstruct
from stationwatch.sources import tables

START = datetime(2025, 1, 1)
OBS = "station_id string, timestamp timestamp, temperature double, humidity double, pressure double"
CONFIG = ReconstructionConfig(own_statistics_rows=50, window=6, components=4)


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(2)

    def rows(station, start, hours):
        return [(station, start + timedelta(hours=h), 20 + 5 * float(np.sin(h / 4)) + float(rng.normal()) * 0.2, 50 + float(rng.normal()), 1010 + float(rng.normal())) for h in range(hours)]

    history = tables.stage(spark.createDataFrame(rows("A", START, 300) + rows("B", START, 300), OBS), "history")
    now = rows("A", START + timedelta(days=30), 60) + rows("B", START + timedelta(days=30), 60)
    now[20] = (*now[20][:2], 60.0, *now[20][3:])
    now[50] = (*now[50][:2], None, *now[50][3:])
    del now[95]
    obs = tables.stage(spark.createDataFrame(now, OBS), "now")
    calibrated = reconstruct.calibrate(history, CONFIG)
    scored = tables.stage(reconstruct.detect(obs, calibrated, CONFIG), "scored")
    return history, obs, calibrated, scored, tables.stage(reconstruct.windows_of(history, calibrated.stats, CONFIG), "background")


def explained(world, where="lstm_ae_scored", model=None, stored=None, background=None, **budget):
    _, obs, calibrated, scored, windows = world
    alerted = scored.where(where) if stored is None else scored.where(where).withColumn("lstm_ae_score", F.lit(stored))
    return explain.attribute(obs, alerted, calibrated.stats, model or calibrated.model, windows if background is None else background, CONFIG, explain.AttributionConfig(**budget)).collect()


def test_every_row_is_explained_or_told_why_not(world):
    found = explained(world, permutations=1)
    scored = {(r.station_id, r.timestamp): r.lstm_ae_score for r in world[3].where("lstm_ae_scored").collect()}
    assert {(r.station_id, r.timestamp) for r in found} == set(scored)
    good = [r for r in found if r.available]
    assert len(good) > 60 and {r.reason for r in found} == {None, "the context has gaps"}
    for r in good:
        assert r.base + sum(s.share for s in r.shares) == pytest.approx(r.score, rel=1e-6) and r.score == pytest.approx(scored[r.station_id, r.timestamp], rel=1e-3, abs=1e-5)
        for v in CONFIG.variables:
            assert r[f"{v}_share"] == pytest.approx(sum(abs(s.share) for s in r.shares if s.variable == v))
    hit = next(r for r in good if (r.station_id, r.timestamp) == ("A", START + timedelta(days=30, hours=20)))
    assert hit.top_variable == "temperature" and hit.top_offset == 0 and hit.uses_future and len(hit.shares) == 33
    assert {s.offset_hours for s in hit.shares} == set(range(-5, 6))


def test_values_of_a_small_context_are_the_exact_ones():
    """Over all permutations the estimate is the Shapley value; permutations and reverses estimate without bias towards order."""
    rng = np.random.default_rng(4)
    x, base, d = rng.normal(size=(4, 1)), rng.normal(size=(4, 1)), np.linalg.qr(rng.normal(size=(3, 1)))[0]
    score = lambda c: explain.row_score(c[None], 3, 1, lambda f: f @ d @ d.T)[0]
    values = np.zeros(4)
    for order in permutations(range(4)):
        now = base.copy()
        for i in order:
            before = score(now)
            now[i] = x[i]
            values[i] += score(now) - before
    assert values.sum() / 24 == pytest.approx(score(x) - score(base))


def test_budgets_and_reasons(world):
    reasons = lambda *a, **b: {r.reason for r in explained(world, *a, permutations=1, **b)}
    spike = f"station_id = 'A' AND timestamp = timestamp '{START + timedelta(days=30, hours=20)}'"
    assert reasons(spike) == {None}
    assert reasons(spike, rows=0) == {"row budget exceeded"} and reasons(spike, windows=1) == {"window budget exceeded"} and reasons(spike, seconds=0.0) == {"time budget exceeded"}
    assert "not reproduced" in reasons(spike, stored=9.0).pop()
    assert reasons(spike, background=world[4].where("false")) == {"no background"}
    late = world[4].withColumn("times", F.transform("times", lambda t: F.timestamp_add("YEAR", F.lit(1), t)))
    assert reasons(spike, background=late) == {"background must precede the row"}
    assert reasons("lstm_ae_scored", rows=3) == {None, "row budget exceeded"}
    assert explained(world, "false") == []


def test_nonlinear_models_are_explained_alike(world):
    _, obs, calibrated, _, windows = world
    model = neural.NeuralAutoencoder.fit(windows, windows, calibrated.model, CONFIG, neural.TrainingConfig(epochs=1, rounds=1))
    other = reconstruct.ReconstructionTables(calibrated.stats, calibrated.bounds, model)
    scored = tables.stage(reconstruct.detect(obs, other, CONFIG), "neural")
    found = explained((None, obs, other, scored, windows), "lstm_ae_scored AND station_id = 'A' AND temperature > 50", permutations=1)
    assert [r.available for r in found] == [True]
