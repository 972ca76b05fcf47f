"""Statistical detector: ranges, rates of change, rolling deviations from the hourly baseline, stuck readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STATION, TIME, VARIABLES, StatisticalConfig
from ..functions.scalar import any_true, count_true, flag, r6, severity_score, units
from . import timeline

FAMILIES = ("range", "roc", "level", "persistence")


def calibrate(history: DataFrame, config: StatisticalConfig = StatisticalConfig(), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """station_id, hour, and for each variable the mean and the rate-of-change limit of that hour."""
    rows = timeline.chunked(history.select(STATION, TIME, *variables, *(c for c in history.columns if c == timeline.POSITION)), back=1)
    steps = rows.select(STATION, F.hour(TIME).alias("hour"), *variables, timeline.OWN, *(F.abs(F.col(v) - F.lag(v).over(timeline.local())).alias(f"_{v}") for v in variables)).where(timeline.OWN)
    return steps.groupBy(STATION, "hour").agg(
        *(_mean4(v).alias(f"{v}_baseline") for v in variables), *(r6(F.percentile(f"_{v}", F.lit(config.roc_quantile))).alias(f"{v}_roc_limit") for v in variables))


def _spread(window: Column) -> Column:
    """n (n - 1) times the variance, in squared units; exact up to the last step."""
    total = window["sum"].cast("decimal(19,0)")
    return (window["n"].cast("decimal(10,0)") * window["squares"].cast("decimal(28,0)") - total * total).cast("double")


def _mean4(v: str) -> Column:
    """The mean to four decimals, halves upwards; whole numbers decide, so ties don't hang on the order of a sum."""
    n = F.count(v).cast("double")
    return F.floor((2 * F.sum(units(v)).cast("double") + 100 * n) / F.nullif(200 * n, F.lit(0.0))).cast("double") / 1e4


def detect(obs: DataFrame, hourly: DataFrame, config: StatisticalConfig = StatisticalConfig(), variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """All flags, their families, severity and alert of every row. One join with the calibration, one pass of windows over chunks of each station's rows.

    A station or hour without calibration has no baseline: its rate and level flags are false. Null readings raise no flag.
    """
    by_chunk = timeline.local()
    obs_columns = obs.columns
    back = max(1, config.persistence_rows, *(w + 1 for w in config.windows))
    joined = timeline.chunked(obs, back=back).withColumn("hour", F.hour(TIME)).join(hourly, [STATION, "hour"], "left")
    residual = joined.withColumns({f"{v}_hourly_residual": r6(F.col(v) - F.col(f"{v}_baseline")) for v in variables})
    rates = {f"{v}_rate_of_change": r6(F.abs(F.col(v) - F.lag(v).over(by_chunk))) for v in variables}
    # running totals, of which every window is a difference: a row costs the same for any length of window
    so_far = by_chunk.rowsBetween(Window.unboundedPreceding, 0)
    sources = {f"_{v}": F.col(v) for v in variables} | {f"_{v}_residual": F.col(f"{v}_hourly_residual") for v in variables}
    totals = {}
    for name, value in sources.items():
        own = F.coalesce(units(value), F.lit(0).cast("decimal(19,0)"))
        totals |= {f"{name}_sum": F.sum(own).over(so_far), f"{name}_squares": F.sum((own * own).cast("decimal(38,0)")).over(so_far), f"{name}_n": F.count(value).over(so_far)}
    joined = residual.withColumns(rates | totals)

    def between(name: str, first: int, last: int) -> Column:
        """Totals of the rows from ``first`` to ``last`` rows back."""
        cut = lambda c, k: F.col(c) if k == 0 else F.coalesce(F.lag(c, k).over(by_chunk), F.lit(0).cast(dict(joined.dtypes)[c]))
        return F.struct(*((cut(f"{name}_{k}", last) - cut(f"{name}_{k}", first + 1)).alias(k) for k in ("sum", "squares", "n")))

    out = joined.withColumns({f"_{v}_{w}": between(f"_{v}_residual", w, 1) for v in variables for w in config.windows} | {f"_{v}_recent": between(f"_{v}", config.persistence_rows - 1, 0) for v in variables})
    flags = {}
    for v in variables:
        low, high = config.ranges[v]
        flags[f"{v}_range_anomaly"] = flag((F.col(v) < low) | (F.col(v) > high))
        flags[f"{v}_roc_anomaly"] = flag(F.col(f"{v}_rate_of_change") > F.col(f"{v}_roc_limit"))
        for w in config.windows:
            past = F.col(f"_{v}_{w}")
            n, spread = past["n"].cast("double"), _spread(past)
            away = F.abs(F.round(F.col(f"{v}_hourly_residual") * 1e6) - past["sum"].cast("double") / n)
            flags[f"{v}_zscore_{w}h"] = r6(F.when((past["n"] >= max(2, min(config.least_rows, w))) & (spread >= 0.5), away / F.sqrt(F.greatest(spread, F.lit(0.5)) / (n * (n - 1)))))
        recent = F.col(f"_{v}_recent")
        flags[f"{v}_persistence_anomaly"] = flag((recent["n"] >= config.persistence_rows) & (_spread(recent) < (config.persistence_tolerance * 1e6) ** 2 * recent["n"] * (recent["n"] - 1)))
    out = out.withColumns(flags).withColumns({f"{v}_zscore_{w}h_anomaly": flag(F.col(f"{v}_zscore_{w}h") > config.z_limit) for v in variables for w in config.windows})
    families = {
        "range": [F.col(f"{v}_range_anomaly") for v in variables], "roc": [F.col(f"{v}_roc_anomaly") for v in variables],
        "level": [F.col(f"{v}_zscore_{w}h_anomaly") for v in variables for w in config.windows], "persistence": [F.col(f"{v}_persistence_anomaly") for v in variables],
    }
    out = out.withColumns({f"evidence_{name}": any_true(flags) for name, flags in families.items()} | {"statistical_flag_count": count_true(sum(families.values(), []))})
    out = out.where(timeline.OWN)
    return with_severity(out.drop("hour", *(c for c in out.columns if c.startswith("_") and c not in obs_columns)))


def with_severity(rows: DataFrame) -> DataFrame:
    """Family count, severity ladder and alert from the four evidence columns."""
    n = count_true([F.col(f"evidence_{name}") for name in FAMILIES])
    label = (
        F.when(F.col("evidence_range"), "critical").when(F.col("evidence_persistence"), "anomaly")
        .when(n >= 2, "anomaly").when(n == 1, "suspicious").otherwise("normal")
    )
    out = rows.withColumns({"statistical_family_count": n, "statistical_raw_alert": F.col("statistical_flag_count") > 0, "statistical_severity_label": label})
    return out.withColumns({
        "statistical_severity": severity_score(F.col("statistical_severity_label")), "statistical_alert": F.col("statistical_severity_label").isin("anomaly", "critical")})


def flag_columns(rows: DataFrame, variables: tuple[str, ...] = VARIABLES) -> list[str]:
    return [c for c in rows.columns if c.endswith("_anomaly") and c.startswith(tuple(f"{v}_" for v in variables)) and "_spatial_" not in c]


def alert_summary(rows: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """How often each flag fires, by variable and check."""
    columns = flag_columns(rows, variables)
    totals = rows.agg(F.count("*").alias("rows"), *(F.count_if(c).alias(c) for c in columns))
    long = totals.unpivot(["rows"], columns, "column", "alerts")
    return long.select(
        F.split_part("column", F.lit("_"), F.lit(1)).alias("variable"), F.regexp_replace(F.regexp_replace("column", "^[a-z]+_", ""), "_anomaly$", "").alias("check"),
        "alerts", r6(F.col("alerts") / F.nullif(F.col("rows"), F.lit(0))).alias("rate"))
