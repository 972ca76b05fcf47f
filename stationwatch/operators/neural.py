"""A nonlinear sequence autoencoder whose gradients are summed over partitions.

A window of readings is flattened and squeezed through ``components`` numbers:

    code    = D' (x - m) + P tanh(A (x - m) + a)
    rebuilt = m + D code + Q tanh(B code + b)

It starts as the linear autoencoder (P and Q are zero), and every part is then
trained by Adam. A round is one job: each partition adds up the gradient over its
share of the round's windows, the sums meet in an aggregation by parameter, and
the driver takes a step. It holds parameters, never windows. After each epoch
the loss on held-out windows decides which state stays and when to stop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ReconstructionConfig
from .reconstruct import LinearAutoencoder, _matrix

Parameters = dict[str, np.ndarray]


@dataclass(frozen=True)
class TrainingConfig:
    hidden: int = 48
    epochs: int = 30
    #: Rounds of an epoch: each takes the windows whose hash has one remainder.
    rounds: int = 4
    rate: float = 2e-3
    patience: int = 5
    least_gain: float = 1e-6
    seed: int = 42


def forward(p: Parameters, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Centred windows, first and second hidden layers, code, and the rebuilt windows."""
    c = x - p["m"]
    h = np.tanh(c @ p["A"].T + p["a"])
    code = c @ p["D"] + h @ p["P"].T
    g = np.tanh(code @ p["B"].T + p["b"])
    return c, h, code, g, p["m"] + code @ p["D"].T + g @ p["Q"].T


def gradient(p: Parameters, x: np.ndarray) -> tuple[float, Parameters]:
    """Sum over windows of the squared error, and its gradient."""
    c, h, code, g, y = forward(p, x)
    e = 2 * (y - x)
    to_code = e @ p["D"] + ((e @ p["Q"]) * (1 - g * g)) @ p["B"]
    inner = (e @ p["Q"]) * (1 - g * g)
    outer = (to_code @ p["P"]) * (1 - h * h)
    return float(((y - x) ** 2).sum()), {
        "D": e.T @ code + c.T @ to_code, "Q": e.T @ g, "B": inner.T @ code, "b": inner.sum(0), "P": to_code.T @ h, "A": outer.T @ c, "a": outer.sum(0),
        "m": (e - to_code @ p["D"].T - outer @ p["A"]).sum(0)}


def flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[name].reshape(-1) for name in sorted(p)])


def shaped(values: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for name in sorted(like):
        out[name] = values[at : at + like[name].size].reshape(like[name].shape)
        at += like[name].size
    return out


def _sums(windows: DataFrame, columns: list[str], p: Parameters, with_gradient: bool) -> tuple[int, float, np.ndarray]:
    """Number of windows, squared error and gradient over all partitions: as many rows as there are parameters, for any table."""
    shared = windows.sparkSession.sparkContext.broadcast(p)  # of a fixed size
    size = sum(v.size for v in p.values()) if with_gradient else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, columns)
                if with_gradient:
                    loss, g = gradient(shared.value, x)
                    total[2:] += flat(g)
                else:
                    loss = float(((forward(shared.value, x)[-1] - x) ** 2).sum())
                total[:2] += len(x), loss
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(total)), "x": total})

    found = windows.select(*columns).mapInArrow(run, "place long, x double").groupBy("place").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size + 2)
    out[found.column("place").to_numpy()] = found.column("x").to_numpy()
    shared.destroy()
    return int(out[0]), float(out[1]), out[2:]


@dataclass(frozen=True)
class NeuralAutoencoder:
    parameters: Parameters
    #: (epoch, loss in training, loss on held-out windows) by epoch, both a mean over cells; epoch 0 is the linear start.
    history: list[tuple[int, float, float]] = field(default_factory=list)

    @classmethod
    def fit(
        cls, windows: DataFrame, held: DataFrame, linear: LinearAutoencoder, config: ReconstructionConfig = ReconstructionConfig(), training: TrainingConfig = TrainingConfig(),
    ) -> NeuralAutoencoder:
        """From staged windows, which are read once a round, and held-out ones, read once an epoch. Without held-out windows the training loss decides."""
        columns = [f"{v}_cells" for v in config.variables]
        rng = np.random.default_rng(training.seed)
        cells, code = linear.directions.shape
        draw = lambda rows, width: rng.normal(size=(rows, width)) / np.sqrt(width)
        p: Parameters = {
            "m": linear.mean.copy(), "D": linear.directions.copy(), "A": draw(training.hidden, cells), "a": np.zeros(training.hidden), "P": np.zeros((code, training.hidden)),
            "B": draw(training.hidden, code), "b": np.zeros(training.hidden), "Q": np.zeros((cells, training.hidden))}
        part = F.pmod(F.xxhash64(*columns), F.lit(training.rounds))

        def loss_of(rows: DataFrame) -> float:
            n, loss, _ = _sums(rows, columns, p, False)
            return loss / (n * cells) if n else float("nan")

        held_out = loss_of(held)
        decide = held if not np.isnan(held_out) else windows
        best_loss = held_out if decide is held else loss_of(windows)
        best, history, idle = {k: v.copy() for k, v in p.items()}, [(0, loss_of(windows), best_loss)], 0
        first, second, step = np.zeros(flat(p).size), np.zeros(flat(p).size), 0
        for epoch in range(1, training.epochs + 1):
            running, rounds = 0.0, 0
            for k in rng.permutation(training.rounds):
                n, loss, g = _sums(windows.where(part == int(k)), columns, p, True)
                if not n:
                    continue
                g, step = g / (n * cells), step + 1
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                move = training.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                p = shaped(flat(p) - move, p)
                running, rounds = running + loss / (n * cells), rounds + 1
            if not rounds:
                break
            now = loss_of(decide)
            history.append((epoch, running / rounds, now))
            if now < best_loss - training.least_gain:
                best_loss, best, idle = now, {k: v.copy() for k, v in p.items()}, 0
            else:
                idle += 1
                if idle >= training.patience:
                    break
        return cls(best, history)

    def rebuild_matrix(self, x: np.ndarray) -> np.ndarray:
        return forward(self.parameters, x)[-1]

    def rebuild(self, windows: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> DataFrame:
        columns, p = [f"{v}_cells" for v in config.variables], self.parameters

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, columns)
                parts = (forward(p, x)[-1] if len(x) else np.zeros((0, p["m"].size))).reshape(len(x), len(columns), -1)
                arrays = {c: batch.column(c) for c in batch.schema.names}
                yield pa.RecordBatch.from_pydict(arrays | {f"{v}_rebuilt": pa.array(list(parts[:, i]), pa.list_(pa.float64())) for i, v in enumerate(config.variables)})

        return windows.mapInArrow(run, windows.select("*", *(F.col(f"{v}_cells").alias(f"{v}_rebuilt") for v in config.variables)).schema)

    def losses(self, windows: DataFrame, config: ReconstructionConfig = ReconstructionConfig()) -> float:
        """Mean squared error over all cells of all windows."""
        n, loss, _ = _sums(windows, [f"{v}_cells" for v in config.variables], self.parameters, False)
        return loss / (n * self.parameters["m"].size) if n else float("nan")
