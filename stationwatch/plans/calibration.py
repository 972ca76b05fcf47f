"""One run that calibrates all detectors on a history, and the saved tables with which they start."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..config import VARIABLES, ReconstructionConfig, SpatialConfig, StatisticalConfig
from ..operators import fusion, reconstruct, spatial, statistical
from ..sources import tables

NAMES = ("hourly", "graph", "limits", "normalisation", "bounds", "model")


def model_table(spark: SparkSession, model: reconstruct.LinearAutoencoder | None) -> DataFrame:
    """The model as a table: its mean, then its directions; empty for window means."""
    rows = [] if model is None else [(i, [float(x) for x in row]) for i, row in enumerate([model.mean, *model.directions.T])]
    return spark.createDataFrame(rows, "place int, x array<double>")


def model_of(table: DataFrame) -> reconstruct.LinearAutoencoder | None:
    rows = [r["x"] for r in table.orderBy("place").collect()]  # components + 1 rows
    return reconstruct.LinearAutoencoder(np.array(rows[0]), np.array(rows[1:]).T) if rows else None


@dataclass(frozen=True)
class Calibration:
    """Everything the three detectors learn from a history."""

    hourly: DataFrame
    graph: DataFrame
    limits: DataFrame
    reconstruction: reconstruct.ReconstructionTables
    statistical_config: StatisticalConfig = StatisticalConfig()
    spatial_config: SpatialConfig = SpatialConfig()
    reconstruction_config: ReconstructionConfig = ReconstructionConfig()

    @classmethod
    def fit(
        cls, history: DataFrame, places: DataFrame, statistical_config: StatisticalConfig = StatisticalConfig(), spatial_config: SpatialConfig = SpatialConfig(),
        reconstruction_config: ReconstructionConfig = ReconstructionConfig(), linear: bool = True,
    ) -> Calibration:
        """From observations with unique keys and one place for each station; refuses others."""
        fusion.validated(history)
        graph = spatial.neighbours(tables.check_coordinates(places), spatial_config)
        return cls(
            statistical.calibrate(history, statistical_config), graph, spatial.calibrate(history, graph, spatial_config), reconstruct.calibrate(history, reconstruction_config, linear),
            statistical_config, spatial_config, reconstruction_config)

    def _manifest(self) -> dict:
        r = self.reconstruction_config
        return {"variables": list(VARIABLES), "window": r.window, "stride": r.stride, "components": r.components if self.reconstruction.model is not None else 0, "neighbours": self.spatial_config.neighbours}

    def save(self, path: str) -> None:
        """Tables as Parquet and a manifest that says what they are for. The model is a table too: its mean, then its directions."""
        model = model_table(self.hourly.sparkSession, self.reconstruction.model)
        found = dict(zip(NAMES, (self.hourly, self.graph, self.limits, self.reconstruction.stats, self.reconstruction.bounds, model), strict=True))
        tables.save_tables(found, self._manifest(), path)

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, statistical_config: StatisticalConfig = StatisticalConfig(), spatial_config: SpatialConfig = SpatialConfig(),
        reconstruction_config: ReconstructionConfig = ReconstructionConfig(),
    ) -> Calibration:
        """What ``save`` wrote; refuses tables that were made for other variables, windows, model sizes or numbers of neighbours."""
        found, manifest = tables.load_tables(spark, path)
        missing = sorted(set(NAMES) - set(found))
        if missing:
            raise tables.InvalidData(f"no tables {missing}")
        out = cls(found["hourly"], found["graph"], found["limits"], reconstruct.ReconstructionTables(found["normalisation"], found["bounds"], model_of(found["model"])), statistical_config, spatial_config, reconstruction_config)
        for name, value in out._manifest().items():
            if manifest.get(name) != value:
                raise tables.InvalidData(f"calibrated for {name} {manifest.get(name)}, not {value}")
        return out

    def detect(self, obs: DataFrame) -> DataFrame:
        """The fused votes of new observations, without calibrating anything."""
        outputs = (
            statistical.detect(obs, self.hourly, self.statistical_config), spatial.detect(obs, self.graph, self.limits, self.spatial_config),
            reconstruct.detect(obs, self.reconstruction, self.reconstruction_config))
        return fusion.vote(fusion.validated(tables.stage(fusion.join_outputs(obs, *outputs, check=False), "fused")))
