"""Evaluation of flags against injected truth, by observation and by event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STATION, TIME
from ..functions.scalar import flag, r6, ratio
from ..sources.tables import InvalidData, check_keys
from . import timeline
from .order import order_statistics

BUFFER = 23
#: Diagnoses by the fault that causes them, and their families.
DIAGNOSIS_OF = {
    "spike": "SPIKE", "offset": "SENSOR_OFFSET", "drift": "SENSOR_DRIFT", "stuck": "STUCK_SENSOR", "noise": "NOISY_SENSOR", "dropout": "DATA_DROPOUT", "rate_change": "RATE_CHANGE",
}
FAMILY_OF = {
    "SPIKE": "transient", "RATE_CHANGE": "transient", "SENSOR_OFFSET": "bias", "SENSOR_DRIFT": "bias", "STUCK_SENSOR": "signal", "NOISY_SENSOR": "signal", "DATA_DROPOUT": "availability",
}


def _confusion(predicted: Column, truth: Column) -> list[Column]:
    p, t = flag(predicted), flag(truth)
    return [F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn")]


def _metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({
        "precision": r6(precision), "recall": r6(recall), "f1": r6(ratio(2 * precision * recall, precision + recall)), "fpr": r6(ratio(fp, fp + tn)),
        "alerts": tp + fp, "alert_rate": r6(ratio(tp + fp, tp + fp + fn + tn))})


def metrics(rows: DataFrame, predicted: str, truth: str = "is_anomaly", by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts with precision, recall, F1 and false positive rate, 0 on empty denominators; for each group of ``by``."""
    return _metrics(rows.groupBy(*by).agg(*_confusion(F.col(predicted), F.col(truth))))


def long_methods(rows: DataFrame, methods: list[str], keep: list[str]) -> DataFrame:
    """One row for each row and method: method, predicted."""
    return rows.select(*keep, *(flag(F.col(m)).alias(m) for m in methods)).unpivot(keep, methods, "method", "predicted")


def event_recall(rows: DataFrame, predicted: str) -> DataFrame:
    """Events, how many have an alert, and their share. A packed id is an event of its own."""
    events = rows.where("anomaly_id IS NOT NULL").groupBy("anomaly_id").agg(F.max(flag(F.col(predicted)).cast("int")).alias("hit"))
    return events.agg(F.count("*").alias("events"), F.coalesce(F.sum("hit"), F.lit(0)).alias("detected"), r6(F.coalesce(F.avg("hit"), F.lit(0.0))).alias("event_recall"))


def event_table(rows: DataFrame, predicted: str) -> DataFrame:
    """One row for each event: what it is, how long, and how much of it was found."""
    p = flag(F.col(predicted))
    return rows.where("anomaly_id IS NOT NULL").groupBy("anomaly_id").agg(
        *(F.min_by(c, TIME).alias(c) for c in ("anomaly_type", "anomaly_variable", "anomaly_severity")), F.count("*").alias("duration"),
        F.max(p.cast("int")).cast("boolean").alias("detected"), F.count_if(p).alias("observations_detected"))


def distance_to_anomaly(rows: DataFrame) -> DataFrame:
    """``anomaly_distance``: rows of the station to the nearest anomaly before or after; null if the station has none."""
    at = F.when(F.col("is_anomaly"), F.col(timeline.POSITION))
    # chunks hand on the last anomaly before them and the first one behind them
    numbered = timeline.carried(
        timeline.chunked(rows), {"_last": F.max(at), "_next": F.min(at)},
        {"_before": F.max("_last").over(timeline.earlier()), "_behind": F.min("_next").over(timeline.later())})
    last = F.coalesce(F.max(at).over(timeline.local().rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    following = F.coalesce(F.min(at).over(timeline.local().rowsBetween(0, Window.unboundedFollowing)), F.col("_behind"))
    here = F.col(timeline.POSITION)
    return numbered.withColumn("anomaly_distance", F.least(here - last, following - here).cast("int")).select(*rows.columns, "anomaly_distance")


def buffer_clear_fpr(rows: DataFrame, predicted: str, buffer: int = BUFFER) -> DataFrame:
    """Alert rate of clean rows farther than ``buffer`` rows from any anomaly."""
    clear = distance_to_anomaly(rows).where(~flag(F.col("is_anomaly")) & (F.coalesce("anomaly_distance", F.lit(1 << 30)) > buffer))
    return clear.agg(F.count("*").alias("clear_rows"), F.count_if(flag(F.col(predicted))).alias("alerts"), r6(F.coalesce(F.avg(flag(F.col(predicted)).cast("int")), F.lit(0.0))).alias("buffer_clear_fpr"))


def method_table(rows: DataFrame, methods: list[str], buffer: int = BUFFER) -> DataFrame:
    """Confusion metrics, event recall and buffer-clear false positive rate of each method, in one unpivot."""
    keep = ["is_anomaly", "anomaly_id", "anomaly_distance"]
    long = long_methods(distance_to_anomaly(rows), methods, keep)
    clear = ~flag(F.col("is_anomaly")) & (F.coalesce("anomaly_distance", F.lit(1 << 30)) > buffer)
    base = metrics(long, "predicted", by=("method",))
    events = long.where("anomaly_id IS NOT NULL").groupBy("method", "anomaly_id").agg(F.max(F.col("predicted").cast("int")).alias("hit")).groupBy("method").agg(r6(F.avg("hit")).alias("event_recall"))
    calm = long.where(clear).groupBy("method").agg(r6(F.avg(F.col("predicted").cast("int"))).alias("buffer_clear_fpr"))
    return base.join(events, "method", "left").join(calm, "method", "left")


def recall_by_type(rows: DataFrame, methods: list[str], by: str = "anomaly_type") -> DataFrame:
    """Event recall by fault type or variable, a column for each method."""
    long = long_methods(rows.where("anomaly_id IS NOT NULL"), methods, ["anomaly_id", by])
    events = long.groupBy(by, "anomaly_id", "method").agg(F.max(F.col("predicted").cast("int")).alias("hit"))
    return events.groupBy(by).pivot("method", methods).agg(r6(F.avg("hit")))


def metrics_by_variable(rows: DataFrame, predicted: dict[str, str]) -> DataFrame:
    """Confusion metrics of each variable's own flag against the faults of that variable alone."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), flag(F.col(c)).alias("p"), (flag(F.col("is_anomaly")) & flag(F.col("anomaly_variable") == v)).alias("t")) for v, c in predicted.items())))
    return metrics(rows.select(each.alias("e")).select("e.*"), "p", "t", by=("variable",))


def alert_policy(rows: DataFrame) -> DataFrame:
    """One row: of scored rows the sensitive alerts (over p95) and the confirmed ones (over p99), with their shares."""
    scored = rows.where(flag(F.col("lstm_ae_scored")))
    share = lambda c: r6(F.coalesce(F.avg(flag(F.col(c)).cast("int")), F.lit(0.0)))
    return scored.agg(
        F.count("*").alias("scored"), F.count_if(flag(F.col("lstm_ae_suspicious"))).alias("raw"), F.count_if(flag(F.col("lstm_ae_alert"))).alias("confirmed"),
        share("lstm_ae_suspicious").alias("raw_rate"), share("lstm_ae_alert").alias("confirmed_rate"))


def anomalies_or_alerts(rows: DataFrame, predicted: str) -> DataFrame:
    """The rows that are anomalous or alerted: what a person would look through."""
    return rows.where(flag(F.col("is_anomaly")) | flag(F.col(predicted)))


def observation_recall(rows: DataFrame, predicted: str, by: str = "anomaly_type") -> DataFrame:
    return rows.where("is_anomaly").groupBy(by).agg(F.count("*").alias("observations"), F.count_if(flag(F.col(predicted))).alias("detected"), r6(F.avg(flag(F.col(predicted)).cast("int"))).alias("recall"))


def false_positives_by_station(rows: DataFrame, predicted: str) -> DataFrame:
    clean = rows.where(~flag(F.col("is_anomaly")))
    return clean.groupBy(STATION).agg(F.count("*").alias("clean_rows"), F.count_if(flag(F.col(predicted))).alias("false_positives"), r6(F.avg(flag(F.col(predicted)).cast("int"))).alias("fpr"))


def firing_rates(rows: DataFrame, signals: list[str]) -> DataFrame:
    """How often each signal fires, overall and on anomalous rows."""
    long = long_methods(rows, signals, ["is_anomaly"])
    return long.groupBy(F.col("method").alias("signal")).agg(
        F.count_if("predicted").alias("fired"), r6(F.avg(F.col("predicted").cast("int"))).alias("rate"), F.count_if(F.col("predicted") & F.col("is_anomaly")).alias("fired_on_anomalies"))


def station_alerts(rows: DataFrame, predicted: str) -> DataFrame:
    return rows.groupBy(STATION).agg(F.count("*").alias("rows"), F.count_if(flag(F.col(predicted))).alias("alerts"), r6(F.avg(flag(F.col(predicted)).cast("int"))).alias("alert_rate"))


def severity_distribution(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    total = Window.partitionBy()  # a row for each label
    return rows.groupBy(F.col(label).alias("severity")).agg(
        F.count("*").alias("observations"), F.count_if("is_anomaly").alias("injected"), F.count_if(flag(F.col(predicted))).alias("alerts")).withColumn("percent", r6(100 * F.col("observations") / F.sum("observations").over(total)))


def complementarity(rows: DataFrame, base: str, added: str) -> DataFrame:
    """What a further detector adds: events and rows found by base, by both together, and by the addition alone."""
    b, a = flag(F.col(base)), flag(F.col(added))
    anomaly = flag(F.col("is_anomaly"))
    events = rows.where("anomaly_id IS NOT NULL").groupBy("anomaly_id").agg(F.max(b.cast("int")).alias("b"), F.max(a.cast("int")).alias("a"))
    by_event = events.agg(F.count("*").alias("events"), F.count_if(F.col("b") == 1).alias("base_events"), F.count_if((F.col("b") == 1) | (F.col("a") == 1)).alias("combined_events"), F.count_if((F.col("b") == 0) & (F.col("a") == 1)).alias("added_events"))
    by_row = rows.agg(F.count_if(a & anomaly & ~b).alias("added_tp"), F.count_if(a & ~anomaly & ~b).alias("added_fp"), F.count_if(b & anomaly).alias("base_tp"), F.count_if((a | b) & anomaly).alias("combined_tp"))
    return by_event.crossJoin(by_row)  # one row each


def detector_overlap(rows: DataFrame, first: str, second: str, third: str) -> DataFrame:
    """Rows, anomalies and precision of each of the eight combinations, those without rows too."""
    mask = flag(F.col(first)).cast("int") + 2 * flag(F.col(second)).cast("int") + 4 * flag(F.col(third)).cast("int")
    found = rows.groupBy(mask.alias("mask")).agg(F.count("*").alias("rows"), F.count_if(flag(F.col("is_anomaly"))).alias("anomalies"))
    names = ["none", "first", "second", "first+second", "third", "first+third", "second+third", "all"]
    every = rows.sparkSession.createDataFrame(list(enumerate(names)), "mask int, combination string")
    out = every.join(found, "mask", "left").fillna(0, ["rows", "anomalies"])
    return out.select("combination", "rows", "anomalies", r6(ratio(F.col("anomalies"), F.col("rows"))).alias("precision"))


def threshold_candidates(scores: DataFrame, bounds: DataFrame, percents: tuple[float, ...] = (90, 95, 97, 98, 99, 99.5, 99.9)) -> DataFrame:
    """Distinct thresholds: the calibrated ones and percentiles of all and of clean scores."""
    names = {f"p{i}": p / 100 for i, p in enumerate(percents)}
    group = F.explode(F.when(flag(F.col("is_anomaly")), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("clean"))))
    found = order_statistics(scores.select(group.alias("group"), "lstm_ae_score"), "lstm_ae_score", names, by=("group",))
    every = found.select(F.array(*names).alias("t")).unionByName(bounds.select(F.array("p95", "p99").alias("t")))
    return every.select(F.explode("t").alias("t")).select(r6("t").alias("threshold")).where("threshold IS NOT NULL").distinct()


def threshold_sweep(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics and event recall at each threshold. Thresholds are some tens of rows, so every row meets each of them by broadcast."""
    long = scores.crossJoin(F.broadcast(thresholds)).withColumn("predicted", flag(F.col("lstm_ae_score") > F.col("threshold")))
    base = metrics(long, "predicted", by=("threshold",))
    events = long.where("anomaly_id IS NOT NULL").groupBy("threshold", "anomaly_id").agg(F.max(F.col("predicted").cast("int")).alias("hit")).groupBy("threshold").agg(r6(F.avg("hit")).alias("event_recall"))
    return base.join(events, "threshold", "left")


def score_distribution(scores: DataFrame, percents: tuple[float, ...] = (1, 5, 25, 50, 75, 90, 95, 99, 99.9)) -> DataFrame:
    """Count, mean, population deviation, extremes and percentiles of all, clean and anomalous scores."""
    s = F.col("lstm_ae_score")
    group = F.explode(F.when(flag(F.col("is_anomaly")), F.array(F.lit("all"), F.lit("anomalous"))).otherwise(F.array(F.lit("all"), F.lit("clean"))))
    rows = scores.where(s.isNotNull()).select(group.alias("group"), s)
    told = rows.groupBy("group").agg(F.count("*").alias("n"), r6(F.avg(s)).alias("mean"), r6(F.stddev_pop(s)).alias("std"), r6(F.min(s)).alias("low"), r6(F.max(s)).alias("high"))
    return told.join(_quantiles(rows, s, {f"p{p:g}".replace(".", "_"): p / 100 for p in percents}, "group"), "group")


def _quantiles(rows: DataFrame, value: Column, shares: dict[str, float], by: str) -> DataFrame:
    """To six decimals, for each of a few groups."""
    found = order_statistics(rows, value, shares, by=(by,))
    return found.select(by, *(r6(name).alias(name) for name in shares))


def clean_score_by(scores: DataFrame, by: Column, name: str) -> DataFrame:
    """Clean scores by station, month or hour."""
    s = F.col("lstm_ae_score")
    if name != "station":  # few groups, any of which may hold most rows
        rows = scores.where(s.isNotNull() & ~flag(F.col("is_anomaly"))).select(by.alias(name), s)
        return rows.groupBy(name).agg(F.count("*").alias("n"), r6(F.avg(s)).alias("mean")).join(_quantiles(rows, s, {"median": 0.5, "p95": 0.95}, name), name)
    return scores.where(s.isNotNull() & ~flag(F.col("is_anomaly"))).groupBy(by.alias(name)).agg(F.count("*").alias("n"), r6(F.avg(s)).alias("mean"), r6(F.percentile(s, F.lit(0.5))).alias("median"), r6(F.percentile(s, F.lit(0.95))).alias("p95"))


def _clear(scores: DataFrame, buffer: int) -> DataFrame:
    return distance_to_anomaly(scores).where(F.col("lstm_ae_score").isNotNull() & ~flag(F.col("is_anomaly")) & (F.coalesce("anomaly_distance", F.lit(1 << 30)) > buffer))


def stations_against_calibration(scores: DataFrame, bounds: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """Scores of clear rows by station, and how their percentiles compare with the calibrated limits."""
    s = F.col("lstm_ae_score")
    found = _clear(scores, buffer).groupBy(STATION).agg(
        F.count("*").alias("n"), r6(F.avg(s)).alias("mean"), r6(F.percentile(s, F.lit(0.5))).alias("median"), r6(F.percentile(s, F.lit(0.95))).alias("p95"), r6(F.percentile(s, F.lit(0.99))).alias("p99"))
    limits = bounds.select(F.col("p95").alias("_p95"), F.col("p99").alias("_p99"))
    return found.crossJoin(F.broadcast(limits)).withColumns({f"{p}_ratio": F.round(F.col(p) / F.nullif(F.col(f"_{p}"), F.lit(0.0)), 4) for p in ("p95", "p99")}).drop("_p95", "_p99")  # one row


def errors_by_variable(scores: DataFrame, bounds: DataFrame, variables: tuple[str, ...], buffer: int = BUFFER) -> DataFrame:
    """Errors of clear rows by variable beside that variable's calibrated limits."""
    long = _clear(scores, buffer).unpivot([], [f"{v}_lstm_ae_error" for v in variables], "column", "x").where("x IS NOT NULL").withColumn("variable", F.regexp_replace("column", "_lstm_ae_error$", ""))
    found = long.groupBy("variable").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean")).join(_quantiles(long, F.col("x"), {"p95": 0.95, "p99": 0.99}, "variable"), "variable")
    limits = bounds.select(F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(f"{v}_p95").alias("calibrated_p95"), F.col(f"{v}_p99").alias("calibrated_p99")) for v in variables))).alias("l")).select("l.*")
    return limits.join(found, "variable", "left").fillna(0, ["n"])


def overlap_contamination(scores: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """Scores of anomalous rows, of clean ones whose windows touch an anomaly, and of clear ones."""
    near = F.coalesce("anomaly_distance", F.lit(1 << 30)) <= buffer
    group = F.when(flag(F.col("is_anomaly")), "anomalous").when(near, "near").otherwise("clear")
    s = F.col("lstm_ae_score")
    rows = distance_to_anomaly(scores).where(s.isNotNull()).select(group.alias("group"), s, "lstm_ae_alert")
    told = rows.groupBy("group").agg(F.count("*").alias("n"), r6(F.avg(s)).alias("mean"), F.count_if("lstm_ae_alert").alias("alerts"))
    return told.join(_quantiles(rows, s, {"p95": 0.95}, "group"), "group")


def strategy_comparison(rows: DataFrame, strategies: list[str]) -> DataFrame:
    """Each fusion strategy's label at two cuts, with metrics and event recall."""
    labels = [f"fusion_{s}_label" for s in strategies]
    cuts = {"anomaly": ("anomaly", "critical"), "suspicious": ("suspicious", "anomaly", "critical")}
    rows = rows.withColumns({f"{c}|{cut}": F.col(c).isin(*levels) for c in labels for cut, levels in cuts.items()})
    long = long_methods(rows, [f"{c}|{cut}" for c in labels for cut in cuts], ["is_anomaly", "anomaly_id"])
    events = long.where("anomaly_id IS NOT NULL").groupBy("method", "anomaly_id").agg(F.max(F.col("predicted").cast("int")).alias("hit")).groupBy("method").agg(r6(F.avg("hit")).alias("event_recall"))
    named = {"strategy": F.regexp_extract("method", r"^fusion_(.*)_label\|", 1), "cut": F.split_part("method", F.lit("|"), F.lit(2))}
    return metrics(long, "predicted", by=("method",)).join(events, "method", "left").withColumns(named).drop("method")


def two_cuts(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Each label column at two cuts: anomaly only, and suspicious or higher."""
    columns = {}
    for c in labels:
        columns[f"{c}|anomaly"] = F.col(c).isin("anomaly", "critical")
        columns[f"{c}|suspicious"] = F.col(c).isin("suspicious", "anomaly", "critical")
    long = long_methods(rows.withColumns(columns), list(columns), ["is_anomaly"])
    return metrics(long, "predicted", by=("method",)).withColumns({
        "strategy": F.split_part("method", F.lit("|"), F.lit(1)), "cut": F.split_part("method", F.lit("|"), F.lit(2))}).drop("method")


# ------------------------------------------------------------------- diagnoses


def with_expected_diagnosis(rows: DataFrame) -> DataFrame:
    """``expected``: the diagnosis of the injected type; null for clean rows and packed types."""
    table = F.create_map(*(F.lit(x) for item in DIAGNOSIS_OF.items() for x in item))
    return rows.withColumn("expected", F.when(F.col("anomaly_type").isNotNull() & ~F.col("anomaly_type").contains("|"), F.element_at(table, F.col("anomaly_type"))))


def class_report(rows: DataFrame, truth: str = "expected", predicted: str = "diagnosis") -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs on either side."""
    pairs = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).count()
    each = pairs.select(F.explode(F.when(F.col("t") == F.col("p"), F.array(F.struct(F.col("t").alias("class"), F.lit("hit").alias("kind")))).otherwise(F.array(
        F.struct(F.col("t").alias("class"), F.lit("miss").alias("kind")), F.struct(F.col("p").alias("class"), F.lit("extra").alias("kind"))))).alias("e"), "count").select("e.*", "count")
    by_class = each.groupBy("class").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("count"))), F.lit(0)).alias(k) for k in ("hit", "miss", "extra")))
    precision, recall = ratio(F.col("hit"), F.col("hit") + F.col("extra")), ratio(F.col("hit"), F.col("hit") + F.col("miss"))
    return by_class.select("class", r6(precision).alias("precision"), r6(recall).alias("recall"), r6(ratio(2 * precision * recall, precision + recall)).alias("f1"), (F.col("hit") + F.col("miss")).alias("support"))


def class_summary(rows: DataFrame, truth: str = "expected", predicted: str = "diagnosis") -> DataFrame:
    """One row: rows with both labels, accuracy, and F1 over all diagnoses that have a fault, plain (absent ones are 0) and weighted by support."""
    pairs = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).agg(F.count("*").alias("rows"), r6(F.coalesce(F.avg((F.col(truth) == F.col(predicted)).cast("int")), F.lit(0.0))).alias("accuracy"))
    each = class_report(rows, truth, predicted).where(F.col("class").isin(*DIAGNOSIS_OF.values()))
    means = each.agg(
        F.round(F.coalesce(F.sum("f1"), F.lit(0.0)) / len(DIAGNOSIS_OF), 4).alias("macro_f1"),
        F.round(F.coalesce(F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), F.lit(0.0)), 4).alias("weighted_f1"))
    return pairs.crossJoin(means)  # one row each


def confusion_matrix(rows: DataFrame, truth: str = "expected", predicted: str = "diagnosis") -> DataFrame:
    return rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("rows"))


def diagnosis_summary(rows: DataFrame) -> DataFrame:
    """Of alerted rows of single faults: accuracy of shape, of shape and variable, and the share that got a shape."""
    eligible = with_expected_diagnosis(rows).where("final_alert AND is_anomaly AND expected IS NOT NULL")
    shape = F.col("diagnosis") == F.col("expected")
    return eligible.agg(
        F.count("*").alias("eligible"), r6(F.coalesce(F.avg(shape.cast("int")), F.lit(0.0))).alias("accuracy"),
        r6(F.coalesce(F.avg((shape & F.col("diagnosis_variable").eqNullSafe(F.col("anomaly_variable"))).cast("int")), F.lit(0.0))).alias("joint_accuracy"),
        r6(F.coalesce(F.avg((F.col("diagnosis") != "UNCLASSIFIED_ANOMALY").cast("int")), F.lit(0.0))).alias("coverage"))


def label_membership(rows: DataFrame) -> DataFrame:
    """One row for each row and event it belongs to, from the packed columns; unequal lengths are an error."""
    parts = {c: F.split(c, r"\|") for c in ("anomaly_id", "anomaly_type", "anomaly_variable", "anomaly_severity")}
    packed = rows.where("anomaly_id IS NOT NULL").withColumns(parts)
    zipped = F.when(
        (F.size("anomaly_id") == F.size("anomaly_type")) & (F.size("anomaly_id") == F.size("anomaly_variable")) & (F.size("anomaly_id") == F.size("anomaly_severity")), F.arrays_zip(*parts))
    return packed.withColumn("_e", F.explode(F.coalesce(zipped, F.raise_error(F.lit("packed labels of unequal length")).cast(packed.select(F.arrays_zip(*parts)).schema[0].dataType)))).select(
        STATION, TIME, *(c for c in ("diagnosis", "final_alert") if c in rows.columns), *(F.col(f"_e.{c}").alias(c) for c in parts))


def event_consistency(members: DataFrame) -> DataFrame:
    """The commonest diagnosis of each event (ties by name), how many it has, and whether they conflict."""
    counted = members.where("diagnosis IS NOT NULL").groupBy("anomaly_id", "diagnosis").agg(F.count("*").alias("n"))
    return counted.groupBy("anomaly_id").agg(
        F.min_by("diagnosis", F.struct(-F.col("n"), "diagnosis")).alias("dominant"), F.sum("n").alias("diagnosed"), F.count("*").alias("kinds"),
        r6(F.max("n") / F.sum("n")).alias("share")).withColumn("conflict", F.col("kinds") > 1)


def align(reference: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """``other``'s columns beside ``reference``'s keys; refuses unequal key sets and unequal values."""
    check_keys(reference)
    check_keys(other)
    keys = [STATION, TIME]
    if not reference.select(*keys).join(other.select(*keys), keys, "left_anti").isEmpty() or not other.select(*keys).join(reference.select(*keys), keys, "left_anti").isEmpty():
        raise InvalidData("the tables have different keys")
    joined = reference.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns)).join(other, keys)
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    if not joined.where(differs).isEmpty():
        raise InvalidData("the tables differ in their values")
    return joined.drop(*(f"_{c}" for c in columns))


def sensor_health(rows: DataFrame) -> DataFrame:
    """For each station alerts, suspicious rows, the last alert and the commonest diagnosis."""
    counted = rows.where("diagnosis IS NOT NULL").groupBy(STATION, "diagnosis").count().groupBy(STATION).agg(F.min_by("diagnosis", F.struct(-F.col("count"), "diagnosis")).alias("dominant_issue"))
    base = rows.groupBy(STATION).agg(
        F.count_if("final_alert").alias("alerts"), F.count_if(F.col("final_severity") == "suspicious").alias("suspicious"), F.max(F.when(F.col("final_alert"), F.col(TIME))).alias("last_alert"))
    return base.join(counted, STATION, "left")
