"""A data source for hourly archives that answer in JSON columns, as a batch and as a stream.

``spark.dataSource.register(HourlyArchive)``, then
``spark.read.format("hourly_archive").options(url=..., start=..., end=..., stations=<JSON list>)``
or ``spark.readStream`` with the same options. Each station is one partition. A
station that fails is asked again, with growing pauses; one that still fails
gives one row with its name and the reason in ``failure``, beside the others'
data, or ends the read if ``strict`` is true. A stream's offsets are days: a
trigger reads the days up to ``end`` (yesterday if there is none) that no
earlier one has read.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .tables import OBSERVATION

#: The archive's names of the variables, in the order of the schema's readings.
HOURLY = ("temperature_2m", "relative_humidity_2m", "pressure_msl", "surface_pressure")
SCHEMA = T.StructType([*OBSERVATION.fields, T.StructField("failure", T.StringType())])


class StationPartition(InputPartition):
    def __init__(self, station: dict, first: str, last: str):
        self.station, self.first, self.last = station, first, last


def rows_of(answer: dict, station: dict) -> Iterator[tuple]:
    """Rows of one answer, whose hourly arrays run side by side; ValueError if they don't."""
    hourly = answer["hourly"]
    if any(len(hourly[name]) != len(hourly["time"]) for name in HOURLY):
        raise ValueError("arrays of unequal length")
    for i, at in enumerate(hourly["time"]):
        readings = (hourly[name][i] for name in HOURLY)
        yield (
            datetime.fromisoformat(at).replace(tzinfo=UTC), station["station_id"], station.get("station_name"), float(station["latitude"]), float(station["longitude"]),
            *(None if x is None else float(x) for x in readings), None,
        )


def observations(read: DataFrame) -> DataFrame:
    """The data rows of what was read."""
    return read.where("failure IS NULL").drop("failure")


def failures(read: DataFrame) -> DataFrame:
    """The stations that failed, and why."""
    return read.where("failure IS NOT NULL").select("station_id", "failure")


def coverage(read: DataFrame) -> DataFrame:
    """One row: stations with data, stations that failed, rows, and the time they span."""
    return read.agg(
        F.count_distinct(F.when(F.col("failure").isNull(), F.col("station_id"))).alias("stations"), F.count_if(F.col("failure").isNotNull()).alias("failed"),
        F.count_if(F.col("failure").isNull()).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


class HourlyArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hourly_archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


class _Archive:
    """Asking one station, with retries."""

    def __init__(self, options: dict):
        self.options = options

    def stations(self, first: str, last: str) -> list[InputPartition]:
        return [StationPartition(s, first, last) for s in json.loads(self.options["stations"])]

    def _ask(self, partition: StationPartition) -> list[tuple]:
        station = partition.station
        query = urllib.parse.urlencode({
            "latitude": station["latitude"], "longitude": station["longitude"], "start_date": partition.first, "end_date": partition.last, "hourly": ",".join(HOURLY), "timezone": "UTC"})
        with urllib.request.urlopen(f"{self.options['url']}?{query}", timeout=float(self.options.get("timeout", 60))) as answer:
            return list(rows_of(json.load(answer), station))

    def read(self, partition: StationPartition) -> Iterator[tuple]:
        wait, failure = float(self.options.get("backoff", 1.0)), ""
        for attempt in range(int(self.options.get("retries", 3)) + 1):
            if attempt:
                time.sleep(wait * 2 ** (attempt - 1))
            try:
                rows = self._ask(partition)
                time.sleep(float(self.options.get("pause", 0.5)))  # the archive's other askers
                return iter(rows)
            except (OSError, ValueError, KeyError, TypeError) as e:
                failure = f"{type(e).__name__}: {e}"
                if isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code != 429:
                    break  # asking again won't help
        if str(self.options.get("strict", "false")).lower() == "true":
            raise RuntimeError(f"station {partition.station.get('station_id')}: {failure}")
        return iter([(None, partition.station.get("station_id"), partition.station.get("station_name"), None, None, *[None] * len(HOURLY), failure)])


class _Reader(_Archive, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.stations(self.options["start"], self.options["end"])


class _StreamReader(_Archive, DataSourceStreamReader):
    """Offsets name the first day that isn't read yet."""

    def initialOffset(self) -> dict:
        return {"day": self.options["start"]}

    def latestOffset(self) -> dict:
        last = date.fromisoformat(self.options["end"]) if "end" in self.options else datetime.now(UTC).date() - timedelta(days=1)
        return {"day": max(last + timedelta(days=1), date.fromisoformat(self.options["start"])).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["day"] >= end["day"]:
            return []
        return self.stations(start["day"], (date.fromisoformat(end["day"]) - timedelta(days=1)).isoformat())

    def commit(self, end: dict) -> None:
        """Days are kept by the archive; nothing is to be released."""
