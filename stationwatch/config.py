"""Settings of the detectors, with the values that results depend on."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType

STATION, TIME = "station_id", "timestamp"
VARIABLES = ("temperature", "humidity", "pressure")


def _frozen(values: dict) -> Mapping:
    return MappingProxyType(values)


@dataclass(frozen=True)
class StatisticalConfig:
    windows: tuple[int, ...] = (24, 168)
    least_rows: int = 6
    z_limit: float = 3.5
    roc_quantile: float = 0.99
    persistence_rows: int = 6
    persistence_tolerance: float = 0.05
    ranges: Mapping[str, tuple[float, float]] = field(
        default_factory=lambda: _frozen({"temperature": (-10.0, 55.0), "humidity": (0.0, 100.0), "pressure": (950.0, 1060.0)}))


@dataclass(frozen=True)
class SpatialConfig:
    neighbours: int = 4
    power: float = 2.0
    quantiles: tuple[float, float] = (0.95, 0.995)
    humidity_quantiles: tuple[float, float] = (0.99, 0.999)
    least_neighbours: int = 2
    robust_limit: float = 3.5
    least_scale: float = 1e-6
    least_calibration_rows: int = 30


@dataclass(frozen=True)
class ReconstructionConfig:
    window: int = 24
    stride: int = 1
    gap_tolerance: float = 1.5
    least_valid: float = 0.8
    fill_run: int = 2
    own_statistics_rows: int = 500
    clip: float = 8.0
    components: int = 16
    validation_share: float = 0.15
    quantiles: tuple[float, float] = (0.95, 0.99)
    aggregation: str = "mean"
    #: Order in which ties for the top contributor are broken.
    variables: tuple[str, ...] = ("temperature", "pressure", "humidity")


@dataclass(frozen=True)
class FusionConfig:
    least_votes: int = 2
    severity_by_votes: tuple[str, ...] = ("normal", "suspicious", "anomaly", "critical")
    count_tiers: tuple[int, int] = (1, 2)
    weighted_tiers: tuple[float, float] = (0.33, 0.66)
    logistic_tiers: tuple[float, float] = (0.3, 0.6)
    multipliers: tuple[float, ...] = (1.0, 1.5, 1.75)


#: The score of each severity label; anything else scores 0.5.
SEVERITY_SCORES = _frozen({"normal": 0.0, "suspicious": 0.33, "anomaly": 0.67, "critical": 1.0})
EARTH_RADIUS_KM = 6371.0
MAD_FACTOR = 1.4826
