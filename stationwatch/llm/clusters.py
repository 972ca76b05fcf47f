"""Centroid clustering of whole-number vectors by bit planes and population counts.

A vector of DIMENSIONS whole numbers is packed by bits: plane b is one 64-bit
word that holds bit b of every component, in two's complement, so the last plane
weighs negatively. The dot product of two vectors is the sum over pairs of
planes of their weights times the population count of their AND, exactly; with
the squared lengths that is the squared distance, exactly. Vectors are packed
once. A round reads the planes, assigns each vector to its nearest centroid and
adds up components by centroid within its task; a few thousand numbers a task
meet in one aggregation, and the centroids, a fixed number, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

DIMENSIONS, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
#: Components of more bits than this (sign included) are multiplied as Python's whole numbers: their distances may pass 64 bits.
PLANE_BITS = 28
#: Vectors whose plane products are in memory at once.
BATCH = 4096

_LANES = np.arange(DIMENSIONS, dtype=np.uint64)


def planes_of(values: np.ndarray) -> np.ndarray:
    """(n, bits) words of the bits of int64 (n, DIMENSIONS) values; as few planes as the largest value needs."""
    top = int(np.where(values < 0, ~values, values).max(initial=0))
    bits = top.bit_length() + 1
    out = np.zeros((len(values), bits), np.uint64)
    for b in range(bits):
        out[:, b] = ((values >> b & 1).astype(np.uint64) << _LANES).sum(1, dtype=np.uint64)
    return out


def values_of(planes: np.ndarray) -> np.ndarray:
    """What planes_of packed."""
    out = np.zeros((len(planes), DIMENSIONS), np.int64)
    for b in range(planes.shape[1]):
        lane = (planes[:, b, None] >> _LANES & np.uint64(1)).astype(np.int64)
        out += lane * weights(planes.shape[1])[b]
    return out


def weights(bits: int) -> np.ndarray:
    """What each plane counts: powers of two, the last negative."""
    out = np.int64(1) << np.arange(bits, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of all rows of plane tables a (n, p) and b (k, q), as int64 (n, k)."""
    out = np.zeros((len(a), len(b)), np.int64)
    of_a, of_b = weights(a.shape[1]), weights(b.shape[1])
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            out += np.bitwise_count(a[:, i, None] & b[None, :, j]).astype(np.int64) * (of_a[i] * of_b[j])
    return out


class Centroids:
    """Numbered vectors, packed once if they fit the planes."""

    def __init__(self, vectors: list[list[int]]):
        self.vectors = vectors
        self.narrow = all(-(1 << PLANE_BITS - 1) <= x < 1 << PLANE_BITS - 1 for v in vectors for x in v)
        if self.narrow:
            table = np.array(vectors, np.int64).reshape(-1, DIMENSIONS)
            self.planes, self.squares = planes_of(table), (table * table).sum(1)

    def nearest(self, planes: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each packed vector, the smallest of equals, and the squared distance."""
        far = squares[:, None] - 2 * dot_products(planes, self.planes) + self.squares[None]
        at = far.argmin(1)
        return at, far[np.arange(len(far)), at]

    def nearest_wide(self, vector: list[int]) -> tuple[int, int]:
        far = [sum((x - y) ** 2 for x, y in zip(vector, c, strict=True)) for c in self.vectors]
        return min((d, i) for i, d in enumerate(far))[::-1]

    def hashes(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in self.vectors]


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, planes, wide) of the usable vectors: ``planes`` packed words, or null and ``wide`` decimal numbers where components need more bits.

    Usable are vectors of exactly DIMENSIONS components, none null or not finite, nor so after SCALE.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = np.floor(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS) * float(SCALE))
                finite = np.isfinite(x).all(1)
                ids, x = part.column("vec_id").filter(pa.array(finite)), x[finite]
                narrow = ((x >= -(1 << PLANE_BITS - 1)) & (x < 1 << PLANE_BITS - 1)).all(1)
                words = planes_of(np.where(narrow[:, None], x, 0).astype(np.int64))
                packed = [w.tobytes() if ok else None for w, ok in zip(words, narrow, strict=True)]
                wide = [None if ok else [str(int(v)) for v in row] for row, ok in zip(x, narrow, strict=True)]
                yield pa.RecordBatch.from_pydict({"vec_id": ids, "planes": pa.array(packed, pa.binary()), "wide": pa.array(wide, pa.list_(pa.string()))})

    usable = (F.size("embedding") == DIMENSIONS) & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.coalesce(usable, F.lit(False)))
    return rows.mapInArrow(run, "vec_id long, planes binary, wide array<string>")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(n, bits) planes of the rows of a batch that have them, and where these stand. A plane above a row's last repeats that: so signs extend."""
    packed = batch.column("planes")
    at = np.flatnonzero(packed.is_valid().to_numpy(zero_copy_only=False))
    rows = [np.frombuffer(v.as_buffer(), np.uint64) for v in packed.take(pa.array(at))]
    bits = max(map(len, rows), default=1)
    out = np.zeros((len(rows), bits), np.uint64)
    for width in {len(r) for r in rows}:
        mine = [i for i, r in enumerate(rows) if len(r) == width]
        out[mine, :width] = np.stack([rows[i] for i in mine])
        out[mine, width:] = out[mine, width - 1 : width]
    return out, at


def _vector(vec: DataFrame) -> list[list[int]]:
    """The components of a few packed rows, in their order."""
    out = []
    for row in vec.collect():
        out.append([int(v) for v in row["wide"]] if row["planes"] is None else values_of(np.frombuffer(row["planes"], np.uint64)[None])[0].tolist())
    return out


def first_centroids(packed: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> Centroids:
    """The ``count`` vectors whose ids hash lowest; of rows with one id the order is that of their contents. Rows without an id aren't drawn."""
    draw: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = packed.where("vec_id IS NOT NULL").withColumn("draw", draw).orderBy("draw", "planes", "wide").limit(count)  # the centroids are a fixed number
    return Centroids(_vector(rows.select("planes", "wide")))


def assign(packed: DataFrame, centroids: Centroids) -> DataFrame:
    """(vec_id, cluster, distance); a distance beyond 64 bits is null."""
    shared = packed.sparkSession.sparkContext.broadcast(centroids)  # a fixed number of vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                cluster, distance, _ = _nearest(part, shared.value)
                yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array([d if d < 1 << 63 else None for d in distance], pa.int64())})

    return packed.mapInArrow(run, "vec_id long, cluster int, distance long")


def _nearest(part: pa.RecordBatch, centroids: Centroids) -> tuple[np.ndarray, list[int], tuple[np.ndarray, np.ndarray, list[list[int]]]]:
    planes, at = _unpacked(part)
    cluster, distance = np.zeros(part.num_rows, np.int64), [0] * part.num_rows
    values = values_of(planes)
    if centroids.narrow and len(at):
        cluster[at], found = centroids.nearest(planes, (values * values).sum(1))
        for i, d in zip(at.tolist(), found.tolist(), strict=True):
            distance[i] = d
    wide = [] if centroids.narrow and len(at) == part.num_rows else part.column("wide").to_pylist()
    rest = []
    for i, row in enumerate(wide):
        if row is not None or not centroids.narrow:
            own = [int(v) for v in row] if row is not None else values[np.searchsorted(at, i)].tolist()
            cluster[i], distance[i] = centroids.nearest_wide(own)
            if row is not None:
                rest.append((i, own))
    return cluster, distance, (at, values, rest)


def totals(packed: DataFrame, centroids: Centroids) -> dict[tuple[int, int], tuple[int, int]]:
    """By cluster and component the exact sum and the number of vectors: CENTROIDS x DIMENSIONS rows, the same for any table."""
    shared = packed.sparkSession.sparkContext.broadcast(centroids)
    k = len(centroids.vectors)
    place = np.arange(k * DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [0] * (k * DIMENSIONS), np.zeros(k, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                cluster, _, (at, values, rest) = _nearest(batch.slice(start, BATCH), shared.value)
                part = np.zeros((k, DIMENSIONS), np.int64)
                np.add.at(part, cluster[at], values)
                sums = [a + b for a, b in zip(sums, part.reshape(-1).tolist(), strict=True)]
                for i, own in rest:
                    for j, x in enumerate(own):
                        sums[int(cluster[i]) * DIMENSIONS + j] += x
                counts += np.bincount(cluster, minlength=k)
        yield pa.RecordBatch.from_pydict({"place": place, "sum": pa.array(list(map(str, sums)), pa.string()), "n": np.repeat(counts, DIMENSIONS)})

    # sums of a task are whole numbers of any length; those of all tasks too, in parts of 15 digits
    parts = packed.mapInArrow(run, "place long, sum string, n long")
    digits = F.lpad(F.regexp_replace("sum", "-", ""), 450, "0")
    sign = F.when(F.startswith("sum", F.lit("-")), -1).otherwise(1)
    split = [F.sum(F.substring(digits, 1 + 15 * i, 15).cast("long") * sign) for i in range(30)]
    found = parts.groupBy("place").agg(F.sum("n").alias("n"), F.array(*split).alias("parts")).collect()
    return {divmod(r["place"], DIMENSIONS): (sum(x * 10 ** (15 * (29 - i)) for i, x in enumerate(r["parts"])), r["n"]) for r in found}


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row of ``vectors`` (vec_id, embedding).

    Other rows (null, of another length, with null or non-finite components) are
    left out. Repeated rows are vectors each. With fewer vectors than ``count``
    there are as many centroids; without any no row. Distances and inertias
    beyond 64 bits are null. Other columns play no part.
    """
    packed = stage(whole_vectors(vectors), "planes")
    centroids = first_centroids(packed, count, seed)
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids.vectors:
        return vectors.sparkSession.createDataFrame([], kind)
    for _ in range(rounds):
        found = totals(packed, centroids)
        moved = []
        for i, old in enumerate(centroids.vectors):
            n = found[i, 0][1] if (i, 0) in found else 0
            moved.append([found[i, j][0] // n for j in range(DIMENSIONS)] if n else old)
        centroids = Centroids(moved)
    assigned = stage(assign(packed, centroids), "assigned")
    sums = {r["cluster"]: (r["inertia"], r["lost"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}
    fits = lambda x, lost: int(x) if x is not None and not lost and x < 1 << 63 else None
    everything = fits(sum(x or 0 for x, _ in sums.values()), any(lost for _, lost in sums.values()))
    names = centroids.hashes()
    rows = [(i, fits(*sums[i]), everything, names[i]) for i in sorted(sums)]
    told = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most ``count`` rows
