"""Centroid clustering of integer vectors by bit planes and popcounts.

A component x becomes the integer floor(scale * x). Bit b of all components of
a vector is one plane, packed into 64-bit words; the planes are those of the
two's complement, so plane b weighs 2**b and the topmost -2**b. The product of
two vectors is the weighted sum of popcounts of their planes' ANDs, and
distances follow from products. All of it is exact in 64-bit integers.

A round assigns every vector to its nearest centroid and adds up, in each task,
the set bits of each plane per centroid; only `k` rows of sums leave a task. The
centroids, `k` rows whatever the size of the table, are on the driver.

Defined results: a vector counts if it has exactly `size` components, none of
them null, NaN, infinite or 2**27 / scale or more in size (its distances would
not fit a long); others are left out. Vectors without an id are clustered but
never begin a centroid. Repeated rows are vectors of their own; among rows of
one id the lesser planes come first. With fewer vectors than `k` there are as
many centroids as vectors. An empty table gives empty results. Sums of
distances that do not fit a long are null. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiregrid.session import materialize

#: Integers below this in size keep 64 squared differences within a long.
LARGEST = 1 << 27
_PACKED = "id long, planes binary"


@dataclass(frozen=True)
class Plan:
    """k: centroids. size: components. scale: of the integers. rounds: of moving centroids.
    salt: goes into the hashes that choose the first centroids."""

    k: int = 16
    size: int = 64
    scale: int = 64
    rounds: int = 3
    salt: str = "1"


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane counts."""
    found = np.int64(1) << np.arange(planes, dtype=np.int64)
    found[-1] = -found[-1]
    return found


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """(vector, plane, word) of integers (vector, component)."""
    n, size = values.shape
    words = -(-size // 64)
    out = np.zeros((n, planes, words * 8), np.uint8)
    for b in range(planes):
        bits = np.packbits(((values >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : bits.shape[1]] = bits
    return out.view(np.uint64)


def from_planes(planes: np.ndarray, size: int) -> np.ndarray:
    """The integers (vector, component) again."""
    return np.einsum("b,nbd->nd", weights(planes.shape[1]), _bits(planes, size))


def _bits(planes: np.ndarray, size: int) -> np.ndarray:
    n, count, words = planes.shape
    flat = np.ascontiguousarray(planes).view(np.uint8).reshape(n, count, 8 * words)
    return np.unpackbits(flat, axis=2, bitorder="little")[:, :, :size].astype(np.int64)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products by popcounts; the leading axes of planes (..., plane, word) are broadcast."""
    out = np.int64(0)
    for i, up in enumerate(weights(left.shape[-2])):
        for j, across in enumerate(weights(right.shape[-2])):
            ones = np.bitwise_count(left[..., i, :] & right[..., j, :])
            out = out + up * across * ones.sum(axis=-1, dtype=np.int64)
    return out


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance); of equal ones the smaller number."""
    own = products(planes, planes)
    theirs = products(centroids, centroids)
    found = own[:, None] + theirs - 2 * products(planes[:, None], centroids[None])
    number = found.argmin(axis=1)
    return number, found[np.arange(len(found)), number]


def _planes_of(column: pa.Array, shape: tuple[int, int]) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint64).reshape(-1, *shape)


def _pack(rows: Iterator[pa.RecordBatch], size: int, planes: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        packed = to_planes(values.astype(np.int64), planes)
        column = pa.array([row.tobytes() for row in packed], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["id", "planes"])


def _sums(
    rows: Iterator[pa.RecordBatch], centroids: np.ndarray, size: int
) -> Iterator[pa.RecordBatch]:
    """Per centroid the vectors of this task and the sums of their components."""
    count = np.zeros(len(centroids), np.int64)
    total = np.zeros((len(centroids), size), np.int64)
    for batch in rows:
        planes = _planes_of(batch.column(1), centroids.shape[1:])
        number, _ = nearest(planes, centroids)
        for c in np.unique(number):
            mine = _bits(planes[number == c], size)
            count[c] += len(mine)
            total[c] += weights(planes.shape[1]) @ mine.sum(axis=0)
    used = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
        names=["cluster", "n", "sums"],
    )


def _assign(rows: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        number, distance = nearest(_planes_of(batch.column(1), centroids.shape[1:]), centroids)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance)],
            names=["id", "cluster", "distance"],
        )


def integers(vectors: DataFrame, plan: Plan, vec_id: str, column: str) -> DataFrame:
    """(id, ints) of the vectors that count."""
    bound = LARGEST / plan.scale

    def whole(x):
        real = x.cast("double")
        return F.coalesce(~F.isnan(real) & (F.abs(real) < F.lit(bound)), F.lit(False))

    fits = (F.size(column) == plan.size) & F.forall(column, whole)
    steps = F.transform(column, lambda x: F.floor(x.cast("double") * F.lit(float(plan.scale))))
    return vectors.where(F.coalesce(fits, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), steps.cast("array<long>").alias("ints")
    )


def cluster(
    vectors: DataFrame, plan: Plan | None = None, vec_id: str = "vec_id", column: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(members, centroids).

    Members: `vec_id`, cluster int, distance long. Centroids: cluster int, components array<long>,
    members long, cluster_inertia long, inertia long; at most `k` rows.
    """
    plan = plan or Plan()
    spark = vectors.sparkSession
    ints = integers(vectors, plan, vec_id, column)
    low, high = ints.agg(
        F.min(F.array_min("ints")), F.max(F.array_max("ints"))
    ).first()
    planes = max(int(low or 0).bit_length(), int(high or 0).bit_length()) + 1
    shape = (planes, -(-plan.size // 64))
    packed, _ = materialize(
        ints.mapInArrow(partial(_pack, size=plan.size, planes=planes), _PACKED), "planes"
    )

    key = F.sha2(F.concat(F.lit(f"{plan.salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = (
        packed.where("id IS NOT NULL").select(key.alias("key"), "planes")
        .orderBy("key", "planes").limit(plan.k).collect()
    )
    centroids = np.frombuffer(b"".join(r.planes for r in first), np.uint64).reshape(-1, *shape)
    sums_of = "cluster long, n long, sums array<long>"
    added = F.array(*[F.sum(F.col("sums")[i]) for i in range(plan.size)]).alias("sums")
    for _ in range(plan.rounds if len(centroids) else 0):
        found = packed.mapInArrow(partial(_sums, centroids=centroids, size=plan.size), sums_of)
        moved = from_planes(centroids, plan.size)
        for row in found.groupBy("cluster").agg(F.sum("n").alias("n"), added).collect():
            moved[row.cluster] = np.array(row.sums, np.int64) // row.n
        centroids = to_planes(moved, planes)

    members_of = "id long, cluster int, distance long"
    if len(centroids):
        members = packed.mapInArrow(partial(_assign, centroids=centroids), members_of)
    else:
        members = spark.createDataFrame([], members_of)
    members, _ = materialize(members, "members")
    sums = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")
    )
    held = {row.cluster: (row.n, int(row.d)) for row in sums.collect()}
    all_of = sum(d for _, d in held.values())

    def fits(x: int) -> int | None:
        return x if x < 1 << 63 else None

    table = [
        (i, values, held.get(i, (0, 0))[0], fits(held.get(i, (0, 0))[1]), fits(all_of))
        for i, values in enumerate(from_planes(centroids, plan.size).tolist())
    ]
    centers = spark.createDataFrame(
        table,
        "cluster int, components array<long>, members long, cluster_inertia long, inertia long",
    )
    return members.withColumnRenamed("id", vec_id), centers
