"""Readers, writers and checks of observation tables."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import STATION, TIME, VARIABLES
from ..functions.scalar import mean6, nan_to_null, r6, uniform
from ..operators import timeline

OBSERVATION = T.StructType([
    T.StructField(TIME, T.TimestampType()), T.StructField(STATION, T.StringType()), T.StructField("station_name", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    *(T.StructField(v, T.DoubleType()) for v in (*VARIABLES, "surface_pressure")),
])


class InvalidData(ValueError):
    """An input breaks its contract."""


def read_observations(spark: SparkSession, parquet: str | None = None, csv: str | None = None) -> DataFrame:
    """Parquet, or CSV if there is no Parquet at the path; NaN becomes null."""
    from pyspark.errors import AnalysisException

    found = None
    try:
        found = spark.read.parquet(parquet) if parquet is not None else None
    except AnalysisException as e:
        if csv is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
    if found is None:
        if csv is None:
            raise InvalidData("no path")
        found = spark.read.option("header", True).schema(OBSERVATION).csv(csv)
    doubles = [f.name for f in found.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return found.withColumns({c: nan_to_null(F.col(c)) for c in doubles})


def write_parquet(df: DataFrame, path: str, by_station: bool = False) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(STATION) if by_station else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small result tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_tables(tables: dict[str, DataFrame], manifest: dict, path: str) -> None:
    """Calibration tables as Parquet, with a JSON manifest that names them and their columns."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    text = json.dumps(manifest | {"tables": {name: table.columns for name, table in tables.items()}}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_tables(spark: SparkSession, path: str, variables: tuple[str, ...] = VARIABLES) -> tuple[dict[str, DataFrame], dict]:
    """What save_tables wrote; refuses other variables or columns than the manifest's."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if list(manifest.get("variables", variables)) != list(variables):
        raise InvalidData(f"calibrated for {manifest['variables']}, not {list(variables)}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}
    for name, columns in manifest["tables"].items():
        if tables[name].columns != columns:
            raise InvalidData(f"table {name} has other columns than the manifest")
    return tables, manifest


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise InvalidData("spark.checkpoint.dir is unset: executors of a cluster need a shared folder")
    if not path:
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write into the folder that driver and executors share and read back: a reduction of the raw table is computed once, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Loaded:
    """A table that was read, checked, numbered and staged in one pass, and what the pass saw."""

    rows: DataFrame
    count: int
    first_year: int | None
    last_year: int | None
    #: Two sums over the contents, the same for any order of rows.
    digest: str


def contents(columns: list[str]) -> list[Column]:
    """Aggregates that tell tables of other contents apart, in whatever order and parts the rows come."""
    return [F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("_sum"), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(20,0)")).alias("_other"), F.bit_xor(F.xxhash64(F.lit(2), *columns)).alias("_xor")]


def load(df: DataFrame, name: str, years: tuple[int, int] | None = None) -> Loaded:
    """Stage observations with their positions, checking them in the pass that writes them.

    Refused are null and repeated (station, time) keys, and with ``years`` empty
    tables and other years. The checks are observed metrics of the one job.
    """
    require_columns(df, [STATION, TIME])
    columns = sorted(c for c in df.columns if c != timeline.POSITION)
    seen = Observation(name)
    year = F.year(F.col(TIME))
    numbered = timeline.positions(df, repeated="_repeated").observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(STATION).isNull() | F.col(TIME).isNull()).alias("nulls"), F.count_if("_repeated").alias("repeated"),
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), *contents(columns))
    staged = stage(numbered.drop("_repeated"), name)
    found = seen.get
    if found["nulls"]:
        raise InvalidData("null station or timestamp")
    if found["repeated"]:
        raise InvalidData("repeated (station_id, timestamp)")
    if years and not (found["rows"] and years[0] <= found["first_year"] and found["last_year"] <= years[1]):
        raise InvalidData(f"not all timestamps are of {years[0]}..{years[1]}")
    digest = json.dumps([columns, found["rows"], *(str(found[c]) for c in ("_sum", "_other", "_xor"))])
    return Loaded(staged, found["rows"], found["first_year"], found["last_year"], digest)


def load_history(spark: SparkSession, parquet: str, csv: str | None = None, years: tuple[int, int] = (2023, 2025)) -> Loaded:
    """Observations to calibrate on: these years only, one row for each station and time."""
    return load(read_observations(spark, parquet, csv), "history", years)


def load_present(spark: SparkSession, parquet: str, csv: str | None = None, years: tuple[int, int] = (2026, 2026)) -> Loaded:
    """Observations to judge: this year only, one row for each station and time."""
    return load(read_observations(spark, parquet, csv), "present", years)


def stage_joined(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Stage a one-to-one join of a table of ``rows`` rows with unique keys, and refuse it if the pass that writes it sees more or fewer."""
    seen = Observation(name)
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    if seen.get["rows"] != rows:
        raise InvalidData(f"{seen.get['rows']} joined rows of {rows}: a key is repeated")
    return staged


class Store:
    """Tables that are made once for given contents, in the shared folder: a later run with the same fingerprint reads them.

    ``contents`` names everything a table depends on: the digest of its input and
    all settings. A table counts from when its manifest is written, which is
    last; the manifest repeats the contents, and one that says other than its
    name is refused. Two runs that make a table at once write it twice; either is right.
    """

    def __init__(self, spark: SparkSession, contents: object, root: str | None = None):
        self.spark, self.contents = spark, json.dumps(contents, sort_keys=True, default=str)
        self.root = f"{root or f'{shared_dir(spark)}/calibrations'}/{hashlib.sha256(self.contents.encode()).hexdigest()}"

    def find(self, name: str) -> DataFrame | None:
        """The table of this name, if it was made; refuses a manifest of other contents."""
        path = f"{self.root}/{name}-manifest"
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return None
        told = self.spark.read.schema("contents string, path string, columns string").json(path).orderBy("path").first()
        if told is None:
            return None
        if told["contents"] != self.contents:
            raise InvalidData(f"stale: {name} was made for other contents")
        kept = T.StructType.fromJson(json.loads(told["columns"]))
        return self.spark.read.schema(kept).parquet(told["path"])

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        found = self.find(name)
        if found is not None:
            return found
        path = f"{self.root}/{name}-{uuid.uuid4().hex}"
        made = make()
        made.write.parquet(path)
        row = [(self.contents, path, made.schema.json())]
        self.spark.createDataFrame(row, "contents string, path string, columns string").coalesce(1).write.mode("append").json(f"{self.root}/{name}-manifest")
        return self.spark.read.schema(made.schema).parquet(path)


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise InvalidData(f"missing columns: {missing}")


def check_keys(df: DataFrame) -> DataFrame:
    """Refuse null and repeated (station, time) keys."""
    require_columns(df, [STATION, TIME])
    if not df.where(F.col(STATION).isNull() | F.col(TIME).isNull()).isEmpty():
        raise InvalidData("null station or timestamp")
    if not df.groupBy(STATION, TIME).count().where("count > 1").isEmpty():
        raise InvalidData("repeated (station_id, timestamp)")
    return df


def check_years(df: DataFrame, first: int, last: int) -> DataFrame:
    """Refuse empty tables, null times and years outside first..last."""
    seen = df.agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.year(TIME).between(first, last), F.lit(False))).alias("within")).first()
    if not seen["n"] or not seen["within"]:
        raise InvalidData(f"not all timestamps are of {first}..{last}")
    return df


def check_coordinates(df: DataFrame) -> DataFrame:
    """One row for each station; refuses a station with two places."""
    places = df.select(STATION, "latitude", "longitude").distinct()
    if not places.groupBy(STATION).count().where("count > 1").isEmpty():
        raise InvalidData("a station has more than one place")
    return places


def detector_input(df: DataFrame, variables: tuple[str, ...] = VARIABLES) -> DataFrame:
    """Only keys and readings: no label column can reach a detector."""
    require_columns(df, [STATION, TIME, *variables])
    return df.select(STATION, TIME, *variables)


# --------------------------------------------------- the test tables as networks


def station_places(obs: DataFrame) -> DataFrame:
    """A place for each station that occurs, for networks whose tables have none: within a degree, by a hash of the name."""
    degree = lambda what, low: r6(low + uniform(F.col(STATION), F.lit(what))).alias(what)
    return obs.select(STATION).distinct().select(STATION, degree("latitude", 28), degree("longitude", 77))


def read_station(spark: SparkSession, path: str, station: str, first: str, last: str) -> DataFrame:
    """The rows of one station between two times, both included: the predicates reach the Parquet scan."""
    rows = spark.read.parquet(path)
    kind = dict(rows.dtypes)[TIME]
    return rows.where((F.col(STATION) == station) & F.col(TIME).between(F.lit(first).cast(kind), F.lit(last).cast(kind)))


def hourly_events(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """Event types as stations on an hourly grid: mean, number and maximum of values; with ``at`` of that hour only, which the scan is told."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if at is not None:
        hour = F.lit(at).cast(dict(events.dtypes)["ts"])
        events = events.where((F.col("ts") >= hour) & (F.col("ts") < hour + F.expr("INTERVAL 1 HOUR")))
    return events.groupBy(F.col("event_type").alias(STATION), F.date_trunc("hour", "ts").alias(TIME)).agg(
        mean6("value").alias("temperature"), F.count("*").cast("double").alias("humidity"), r6(F.max("value")).alias("pressure"))


def daily_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flag and line status as stations on a daily grid: mean quantity, discount and price."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    station: Column = F.concat("l_returnflag", "l_linestatus")
    return lines.groupBy(station.alias(STATION), F.col("l_shipdate").alias(TIME)).agg(
        mean6("l_quantity").alias("temperature"), mean6("l_discount").alias("humidity"), mean6("l_extendedprice").alias("pressure"))
