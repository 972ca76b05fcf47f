"""What must not need a whole table, station or time in one task gives the same results in parts."""

import json
import threading
import urllib.parse
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stationwatch.config import ReconstructionConfig, SpatialConfig
from stationwatch.operators import diagnosis, evaluate, explore, neural, order, reconstruct, spatial, statistical, timeline
from stationwatch.plans import queries
from stationwatch.sources import rest, tables
from stationwatch.streaming import alerts, replay

START = datetime(2025, 1, 1)
OBS = "station_id string, timestamp timestamp, temperature double, humidity double, pressure double"


def observations(spark, hours=400, stations="AB", seed=1, holes=True):
    rng = np.random.default_rng(seed)
    rows = []
    for k, s in enumerate(stations):
        at = START
        for h in range(hours * (k + 1)):
            at += timedelta(hours=1 if not holes or rng.random() > 0.03 else int(rng.integers(2, 400)))
            x = [20 + 5 * np.sin(h / 4) + rng.normal(), 50 + rng.normal(), 1010 + rng.normal()]
            rows.append((s, at, *(None if rng.random() < 0.02 else float(v) for v in x)))
    return spark.createDataFrame(rows, OBS)


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


# ------------------------------------------------------------- order statistics


@pytest.mark.parametrize("cell", [1 << 18, 60, 3])
def test_order_statistics_match_numpy(spark, monkeypatch, cell):
    """Also with far more distinct values than a cell, a task's share, may hold."""
    monkeypatch.setattr(order, "CELL_ROWS", cell)
    monkeypatch.setattr(order, "SPLITS", 16)
    rng = np.random.default_rng(5)
    groups = {
        "even": rng.random(4000), "heavy": np.concatenate([np.zeros(1500), rng.standard_cauchy(2000) ** 3]), "near": 1010 + rng.normal(size=999) * 1e-9, "two": np.array([1.0, 2.0]), "one": np.array([-3.5]),
        None: np.array([1e308, -1e308, 0.0, 5.0]), "tiny": rng.random(50) * 1e-300}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v] + [("one", None), ("one", float("nan"))], "g string, x double").repartition(5)
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for r in order.order_statistics(df, "x", shares, by=("g",)).collect():
        v = np.sort(groups[r.g])
        at = [q * (len(v) - 1) for q in shares.values()]
        want = [v[int(np.floor(a))] if v[int(np.floor(a))] == v[int(np.ceil(a))] else v[int(np.floor(a))] * (np.ceil(a) - a) + v[int(np.ceil(a))] * (a - np.floor(a)) for a in at]
        assert r.n == len(v) and np.allclose([r[name] for name in shares], want, rtol=1e-12, atol=0)
    whole = order.order_statistics(df.where("g = 'even'"), F.col("x") * 2, {"m": 0.5}).first()
    assert whole.m == pytest.approx(2 * np.median(groups["even"]), rel=1e-12)
    none = order.order_statistics(df.where("false"), "x", {"m": 0.5}).first()
    assert (none.n, none.m) == (0, None) and order.order_statistics(df.where("false"), "x", {"m": 0.5}, by=("g",)).isEmpty()
    infinite = spark.createDataFrame([(x,) for x in [float("-inf")] * 80 + [0.5] * 90 + [2.0] * 90 + [float("inf")] * 80], "x double")
    found = order.order_statistics(infinite, "x", {"a": 0.1, "b": 0.4, "c": 0.6, "d": 0.9}).first()
    assert (found.a, found.b, found.c, found.d) == (float("-inf"), 0.5, 2.0, float("inf"))


def test_no_percentile_without_a_group():
    import inspect

    assert "percentile" not in inspect.getsource(reconstruct) and "percentile" not in inspect.getsource(order)


# ---------------------------------------------------------------------- timeline


def test_positions_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(timeline, "CHUNK_ROWS", 37)
    obs = observations(spark)
    want = obs.withColumn("w", F.row_number().over(Window.partitionBy("station_id").orderBy("timestamp")) - 1)
    found = timeline.positions(obs).join(want.select("station_id", "timestamp", "w"), ["station_id", "timestamp"])
    assert found.count() == obs.count() and found.where("w <> _pos").isEmpty()
    twice = obs.unionAll(obs.orderBy("timestamp").limit(3))
    assert timeline.positions(twice, repeated="r").where("r").count() == 3
    with pytest.raises(tables.InvalidData, match="repeated"):
        tables.load(twice, "o")
    with pytest.raises(tables.InvalidData, match="null"):
        tables.load(obs.unionAll(spark.createDataFrame([("A", None, 1.0, 1.0, 1.0)], OBS)), "o")
    with pytest.raises(tables.InvalidData, match="2026"):
        tables.load(obs, "o", (2026, 2026))


@pytest.mark.parametrize("rows", [29, 200])
def test_chunks_change_nothing(spark, monkeypatch, rows):
    """One station in many tasks: flags, rolling deviations, segments, windows, scores and distances are those of the whole."""
    obs = tables.stage(observations(spark), "obs")
    config = ReconstructionConfig(own_statistics_rows=50)

    def everything():
        hourly = statistical.calibrate(obs)
        stats = reconstruct.normalisation(obs, config)
        flagged = statistical.detect(obs, hourly)
        steps = reconstruct.modal_step(obs)
        marked = flagged.select("station_id", "timestamp", (F.crc32("station_id") % 7 == F.hour("timestamp") % 7).alias("odd"), (F.dayofmonth("timestamp") % 9 == 0).alias("is_anomaly"))
        return [rows_of(df) for df in (
            hourly, flagged, steps, reconstruct.segments(obs, steps, config).select("station_id", "timestamp", "segment", "pos"), reconstruct.windows_of(obs, stats, config), evaluate.distance_to_anomaly(marked))]

    whole = everything()
    monkeypatch.setattr(timeline, "CHUNK_ROWS", rows)
    for a, b in zip(everything(), whole, strict=True):
        assert a == b
    assert timeline.chunked(obs).select("station_id", "_chunk").distinct().count() >= 1200 // rows


def test_no_anomaly_no_distance(spark):
    rows = spark.createDataFrame([("A", START, False), ("B", START, True), ("B", START + timedelta(hours=1), None)], "station_id string, timestamp timestamp, is_anomaly boolean")
    assert {(r.station_id, r.anomaly_distance) for r in evaluate.distance_to_anomaly(rows).collect()} == {("A", None), ("B", 0), ("B", 1)}


# ------------------------------------------------------------------ calibrations


def test_the_second_query_reads_what_the_first_has_learned(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}")
    sf = "/root/testdata/sf0.001"
    first = rows_of(queries.QUERIES["confusion_metrics"](spark, sf))

    def fail(*_, **__):
        raise AssertionError("calibrated again")

    for module in (statistical, spatial, reconstruct):
        monkeypatch.setattr(module, "calibrate", fail)
    assert rows_of(queries.QUERIES["confusion_metrics"](spark, sf)) == first
    assert queries.QUERIES["event_recall"](spark, sf).count() == 1
    with pytest.raises(AssertionError, match="again"):  # other contents, nothing kept
        monkeypatch.setattr(queries, "VERSION", "other")
        queries.QUERIES["confusion_metrics"](spark, sf)


def test_other_contents_have_other_digests_and_stale_tables_are_refused(spark, tmp_path):
    obs = observations(spark, 30)
    digest = lambda df: tables.load(df, "o").digest
    assert digest(obs) == digest(obs.repartition(3)) != digest(obs.withColumn("pressure", F.col("pressure") + 1e-9))
    assert digest(obs) != digest(obs.limit(29))
    store = tables.Store(spark, ["a"], f"file://{tmp_path}")
    made = []
    assert store.find("t") is None
    for _ in range(2):
        assert store.table("t", lambda: made.append(1) or spark.range(3).toDF("x")).count() == 3
    assert made == [1]
    other = tables.Store(spark, ["b"], f"file://{tmp_path}")
    other.root = store.root
    with pytest.raises(tables.InvalidData, match="stale"):
        other.find("t")
    with pytest.raises(tables.InvalidData, match="repeated"):
        tables.stage_joined(spark.range(4), "j", 3)


def test_loaders_check_while_they_read(spark, tmp_path):
    obs = observations(spark, 30, holes=False)
    tables.write_parquet(obs, f"{tmp_path}/o")
    loaded = tables.load_history(spark, f"{tmp_path}/o")
    assert (loaded.count, loaded.first_year, loaded.last_year) == (90, 2025, 2025) and loaded.rows.count() == 90
    with pytest.raises(tables.InvalidData):
        tables.load_present(spark, f"{tmp_path}/o")


# ------------------------------------------------------------------- autoencoder


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    p = {"m": rng.normal(size=6), "D": rng.normal(size=(6, 2)), "A": rng.normal(size=(4, 6)), "a": rng.normal(size=4), "P": rng.normal(size=(2, 4)), "B": rng.normal(size=(4, 2)), "b": rng.normal(size=4), "Q": rng.normal(size=(6, 4))}
    x = rng.normal(size=(5, 6))
    _, g = neural.gradient(p, x)
    flat, step = neural.flat(p), 1e-6
    for i in rng.choice(len(flat), 40, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += step
        down[i] -= step
        slope = (neural.gradient(neural.shaped(up, p), x)[0] - neural.gradient(neural.shaped(down, p), x)[0]) / (2 * step)
        assert slope == pytest.approx(neural.flat(g)[i], rel=1e-4, abs=1e-4)


def test_nonlinear_windows_are_learned_better_than_linearly(spark):
    """Waves of any phase and two amplitudes lie on a curved surface, which two directions can't follow."""
    config = ReconstructionConfig(components=2)
    rng = np.random.default_rng(3)

    def windows(n):
        phase, size = rng.random(n) * 2 * np.pi, 1 + rng.integers(0, 2, n)
        t = np.arange(24) / 24 * 2 * np.pi
        cells = [[(s * np.sin(k * (t + f))).tolist() for f, s in zip(phase, size)] for k in (1, 2, 3)]
        return tables.stage(spark.createDataFrame(list(zip(*cells)), ", ".join(f"{v}_cells array<double>" for v in config.variables)), "w")

    train, held = windows(400), windows(120)
    linear = reconstruct.LinearAutoencoder.fit(train, config)
    model = neural.NeuralAutoencoder.fit(train, held, linear, config, neural.TrainingConfig(epochs=12, rounds=2, rate=1e-2))
    assert model.history[0][2] > 1.5 * min(h for _, _, h in model.history)
    assert model.losses(held, config) == pytest.approx(min(h for _, _, h in model.history))
    back = model.rebuild(held, config).collect()
    error = np.mean([(np.array(r[f"{v}_cells"]) - np.array(r[f"{v}_rebuilt"])) ** 2 for r in back for v in config.variables])
    assert error == pytest.approx(model.losses(held, config))
    assert model.rebuild(held.limit(0), config).count() == 0


# ---------------------------------------------------------------- grid and bands


def test_neighbours_at_poles_date_line_and_in_crowds(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWD", 1)
    rng = np.random.default_rng(8)
    places = [("north", 89.99, 10.0), ("over", 89.98, -170.0), ("south", -90.0, 0.0), ("east", 0.0, 179.99), ("west", 0.0, -179.99), ("twin1", 45.0, 7.0), ("twin2", 45.0, 7.0)]
    places += [(f"c{i}", 50 + float(rng.normal()) / 500, 8 + float(rng.normal()) / 500) for i in range(60)] + [(f"g{i}", float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for i in range(60)]
    df = spark.createDataFrame(places, "station_id string, latitude double, longitude double")
    other = df.toDF("neighbor_id", "b", "c")
    a = F.pow(F.sin(F.radians(F.col("b") - F.col("latitude")) / 2), 2) + F.cos(F.radians("latitude")) * F.cos(F.radians("b")) * F.pow(F.sin(F.radians(F.col("c") - F.col("longitude")) / 2), 2)
    ranked = df.join(other, F.col("station_id") != F.col("neighbor_id")).withColumn("distance_km", F.round(2 * 6371.0 * F.asin(F.sqrt(a)), 6))
    want = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("station_id").orderBy("distance_km", "neighbor_id"))).where("rank <= 4").select("station_id", "neighbor_id", "rank", "distance_km")
    found = spatial.neighbours(df, SpatialConfig())
    assert rows_of(found.select(*want.columns)) == rows_of(want)
    assert found.where("station_id = 'east' AND neighbor_id = 'west' AND rank = 1").count() == 1
    assert spatial.neighbours(df.limit(1)).count() == 0 and spatial.neighbours(df.limit(0)).count() == 0


def test_band_counts_match_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(f"s{i}", START + timedelta(hours=h), v, None if rng.random() < 0.05 else float(rng.choice([0.0, 0.75, 1.0, 1.25, -1.0, -0.75, round(rng.normal(), 6)])), bool(rng.random() < 0.7)) for i in range(60) for h in range(3) for v in ("temperature", "humidity")]
    found = {(r.station_id, r.timestamp, r.variable): r.alike for r in diagnosis.band_counts(spark.createDataFrame(rows, "station_id string, timestamp timestamp, variable string, dx double, asks boolean")).collect()}
    want = {}
    for s, t, v, d, asks in rows:
        if asks and d:
            want[s, t, v] = sum(1 for _, t2, v2, e, _ in rows if t2 == t and v2 == v and e is not None and e * d > 0 and 0.75 * abs(d) <= abs(e) <= 1.25 * abs(d))
    assert found == want


# ----------------------------------------------------------------------- streams


def test_the_streamed_log_is_the_batch_log_after_a_restart(spark, tmp_path):
    rng = np.random.default_rng(10)
    fused = "station_id string, timestamp timestamp, final_severity string, detector_votes int"
    rows = [(s, START + timedelta(hours=h), str(rng.choice(["normal", "suspicious", "anomaly"])), int(rng.integers(0, 4))) for s in "AB" for h in range(40) if rng.random() < 0.9]
    rows.sort(key=lambda r: r[1])
    late = [rows[i ^ 1] if i ^ 1 < len(rows) else rows[i] for i in range(len(rows))]  # neighbours swapped
    parts = [late[i : i + 12] + late[i : i + 1] for i in range(0, len(late), 12)]  # and one row of each file repeated
    end = [("Z", START + timedelta(days=9), "normal", 0)]
    for i, part in enumerate(parts[:3]):
        spark.createDataFrame(part, fused).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    log = lambda: alerts.alert_log_stream(replay.replay(spark, f"{tmp_path}/in", spark.createDataFrame([], fused).schema))
    alerts.write_log(log(), f"{tmp_path}/log", f"{tmp_path}/k").awaitTermination(120)
    before = spark.read.parquet(f"{tmp_path}/log").count()
    for part in (*parts[3:], end):
        spark.createDataFrame(part, fused).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    alerts.write_log(log(), f"{tmp_path}/log", f"{tmp_path}/k").awaitTermination(120)
    want = explore.alert_log(spark.createDataFrame([r for part in (*parts, end) for r in part], fused))
    found = spark.read.parquet(f"{tmp_path}/log")
    assert 0 < before < found.count() and rows_of(found) == rows_of(want)


def test_hourly_stream_and_micro_batches(spark, tmp_path):
    raw = "station_id string, ts timestamp, value double"
    spark.createDataFrame([("A", START + timedelta(minutes=20 * i), float(i)) for i in range(9)] + [("A", START + timedelta(days=1), 0.0)], raw).coalesce(1).write.parquet(f"{tmp_path}/raw")
    hours = replay.hourly_stream(replay.replay(spark, f"{tmp_path}/raw", spark.createDataFrame([], raw).schema), "value")
    hours.writeStream.format("parquet").option("path", f"{tmp_path}/hours").option("checkpointLocation", f"{tmp_path}/k1").trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.temperature, r.humidity, r.pressure) for r in spark.read.parquet(f"{tmp_path}/hours").orderBy("timestamp").collect()] == [(1.0, 3.0, 2.0), (4.0, 3.0, 5.0), (7.0, 3.0, 8.0)]
    obs = observations(spark, 60, "A", holes=False)
    hourly = statistical.calibrate(obs)
    old, new = obs.where("timestamp < '2025-01-02 12:00'"), obs.where("timestamp >= '2025-01-02 12:00'")
    new.repartition(2).write.parquet(f"{tmp_path}/new")
    seen = {}
    q = replay.score_micro_batches(
        replay.replay(spark, f"{tmp_path}/new", obs.schema, 10), lambda rows: statistical.detect(rows, hourly), lambda: old, lambda df, n: seen.update({n: rows_of(df)}), f"{tmp_path}/k2")
    q.processAllAvailable()
    q.stop()
    assert sorted(r for part in seen.values() for r in part) == rows_of(statistical.detect(obs, hourly).where("timestamp >= '2025-01-02 12:00'"))


class _Archive(BaseHTTPRequestHandler):
    """One good station, one that answers at the third time, one that is gone, one whose answer is broken."""

    asked: dict[str, int] = {}

    def do_GET(self):
        q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
        name = q["latitude"][0]
        self.asked[name] = self.asked.get(name, 0) + 1
        code = 404 if name == "3.0" else 503 if name == "2.0" and self.asked[name] < 3 else 200
        first, last = (datetime.fromisoformat(q[k][0]) for k in ("start_date", "end_date"))
        hours = [(first + timedelta(hours=h)).isoformat() for h in range(24 * ((last - first).days + 1))]
        hourly = {"time": hours} | {k: [None if h == 5 else float(h) for h in range(len(hours) - (name == "4.0"))] for k in rest.HOURLY}
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps({"hourly": hourly}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def archive():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Archive)
    _Archive.asked.clear()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield {"url": f"http://127.0.0.1:{server.server_port}", "start": "2025-01-01", "end": "2025-01-02", "pause": "0", "backoff": "0.01",
           "stations": json.dumps([{"station_id": f"S{i}", "latitude": float(i), "longitude": 2.0} for i in range(1, 5)])}
    server.shutdown()


def test_archive_with_failures_and_retries(spark, archive):
    spark.dataSource.register(rest.HourlyArchive)
    read = tables.stage(spark.read.format("hourly_archive").options(**archive).load(), "read")
    data = rest.observations(read)
    assert {r.station_id: r["count"] for r in data.groupBy("station_id").count().collect()} == {"S1": 48, "S2": 48}
    assert data.where("temperature IS NULL").count() == 2
    failed = {r.station_id: r.failure for r in rest.failures(read).collect()}
    assert set(failed) == {"S3", "S4"} and "404" in failed["S3"] and "unequal" in failed["S4"]
    assert _Archive.asked == {"1.0": 1, "2.0": 3, "3.0": 1, "4.0": 4}
    told = rest.coverage(read).first()
    assert (told.stations, told.failed, told.rows) == (2, 2, 96)
    with pytest.raises(Exception, match="S3|S4"):
        spark.read.format("hourly_archive").options(**archive, strict="true").load().collect()


def test_archive_stream_goes_on_where_it_stopped(spark, archive, tmp_path):
    spark.dataSource.register(rest.HourlyArchive)
    archive["stations"] = json.dumps(json.loads(archive["stations"])[:1])

    def run(end):
        stream = spark.readStream.format("hourly_archive").options(**(archive | {"end": end})).load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/k").start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(f"{tmp_path}/o").select("timestamp").distinct().count(), spark.read.parquet(f"{tmp_path}/o").count()

    assert run("2025-01-02") == (48, 48)
    assert run("2025-01-02") == (48, 48)
    assert run("2025-01-04") == (96, 96)
