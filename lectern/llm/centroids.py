"""Centroid clustering: Lloyd's rounds over shards of dimensions, in whole numbers.

Vectors are cut into blocks of rows, and each block into shards of columns. A
round takes a shard's exact partial distances to the same columns of all
centroids, adds the shards of a block up and takes the nearest centroid; then
each shard sums its own columns by cluster and divides. Only the centroids (k
rows of fixed width) pass through the driver.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import discard, save

SCALE, WIDTH = 256, 32
#: Partial distances that a block has in all its shards together, at most.
PARTIALS = 1 << 22


@dataclass(frozen=True)
class Shards:
    """The kept vectors: rows (block, shard, ids of the first shard's rows, n, kind, data)."""

    rows: DataFrame
    dims: int
    width: int

    @property
    def count(self) -> int:
        return -(-self.dims // self.width)

    def columns(self, shard: int) -> slice:
        return slice(shard * self.width, min(self.dims, (shard + 1) * self.width))


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """The narrowest whole-number type that holds x, and its bytes."""
    high = int(np.abs(x).max(initial=0))
    kind = "<i2" if high < 1 << 15 else "<i4" if high < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64).reshape(n, -1)


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly dims components, none null or non-finite."""
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); a ValueError where a squared distance might not fit 64 bits."""
    x = np.floor(scale * vectors.astype(np.float64))
    if np.abs(x).max(initial=0) >= (1 << 30) / max(1, vectors.shape[-1]) ** 0.5:
        raise ValueError("a component is too large: whole squared distances would not fit 64 bits")
    return x.astype(np.int64)


def sharded(kept: DataFrame, dims: int, k: int, width: int = WIDTH, scale: int = SCALE) -> Shards:
    """Cut (id, vector) rows into blocks and shards and write them. A block's rows are bounded so that its partial distances are."""
    size = max(16, min(4096, PARTIALS // (k * -(-dims // width))))
    kind = kept.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x = whole(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims), scale)
                cols = [_packed(x[:, a : a + width]) for a in range(0, dims, width)]
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows] + [part.num_rows] * (len(cols) - 1), pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(cols), pa.int64()), pa.array(range(len(cols)), pa.int32()), ids, pa.array([part.num_rows] * len(cols), pa.int32()), pa.array([c[0] for c in cols]), pa.array([c[1] for c in cols], pa.binary())],
                    ["block", "shard", "ids", "n", "kind", "data"],
                )
                block += 1

    return Shards(save(kept.mapInArrow(cut, f"block bigint, shard int, ids array<{kind}>, n int, kind string, data binary"), "shards"), dims, width)


def _partial(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of c, exactly."""
    most = x.shape[1] * max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(c).max(initial=0)))
    cross = (x.astype(float) @ c.T.astype(float)).astype(np.int64) if most < 1 << 53 else x @ c.T
    return (x * x).sum(1)[:, None] - 2 * cross + (c * c).sum(1)


def assigned(shards: Shards, centroids: np.ndarray) -> DataFrame:
    """(block, clusters array<int>, distances array<bigint>): each vector's nearest centroid, the smaller number at ties."""
    k, columns, sent = len(centroids), [shards.columns(s) for s in range(shards.count)], shards.rows.sparkSession.sparkContext.broadcast(centroids)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, shard, n, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                packed = _packed(_partial(_unpacked(kind, data, n), sent.value[:, columns[shard]]))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([n], pa.int32()), pa.array([packed[0]]), pa.array([packed[1]], pa.binary())], ["block", "n", "kind", "partial"])

    def nearest(parts: pa.Table) -> pa.Table:
        total = np.zeros((parts["n"][0].as_py(), k), np.int64)
        for kind, data in zip(parts["kind"].to_pylist(), parts["partial"].to_pylist(), strict=True):
            total += _unpacked(kind, data, len(total))
        best = total.argmin(1)
        return pa.table({"block": parts["block"][:1], "clusters": pa.array([best.astype(np.int32)], pa.list_(pa.int32())), "distances": pa.array([total[np.arange(len(total)), best]], pa.list_(pa.int64()))})

    parts = shards.rows.select("block", "shard", "n", "kind", "data").mapInArrow(distances, "block bigint, n int, kind string, partial binary")
    return parts.groupBy("block").applyInArrow(nearest, "block bigint, clusters array<int>, distances array<bigint>")


def moved(shards: Shards, clusters: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after each shard has set its columns to floor(sum / count) of their vectors; those without vectors stay."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for shard, n, kind, data, labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, labels = _unpacked(kind, data, n), np.array(labels)
                order = np.argsort(labels, kind="stable")
                first = np.flatnonzero(np.diff(labels[order], prepend=-1))
                total, count = totals.setdefault(shard, (np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)))
                total[labels[order][first]] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(labels, minlength=k)
        for shard, (total, count) in totals.items():
            cluster, column = (a.ravel() for a in np.nonzero(np.broadcast_to(count[:, None], total.shape)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cluster), shard, np.int32)), pa.array(cluster), pa.array(column), pa.array(total[cluster, column]), pa.array(count[cluster])], ["shard", "cluster", "at", "total", "n"])

    joined = shards.rows.select("block", "shard", "n", "kind", "data").join(clusters.select("block", "clusters"), "block").drop("block")
    totals = joined.mapInArrow(sums, "shard int, cluster bigint, at bigint, total bigint, n bigint").groupBy("shard", "cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in totals.selectExpr("shard", "cluster", "at", "(total - pmod(total, n)) div n AS mean").collect():  # at most one row a component
        out[r.cluster, r.shard * shards.width + r["at"]] = r["mean"]
    return out


def seeds(kept: DataFrame, dims: int, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors of the smallest sha256 of `seed:id`; equal ids are ordered by their vectors, a null id counts as empty."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return whole(np.array([r.vector for r in first], float).reshape(len(first), dims), scale)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each kept vector.

    Kept are vectors of exactly dims components, none null or non-finite; each
    becomes floor(scale * x). With fewer kept vectors than k, each is a centroid; with
    none the result is empty. Equal vectors that were all drawn as seeds leave the
    later centroids empty, and these stay. Null ids and repeated rows are vectors
    like others. Only the two named columns are read.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    kept = vectors.where(usable(v, dims)).select(F.col(f"`{id_col}`").alias("id"), v.cast("array<double>").alias("vector"))
    centroids = seeds(kept, dims, k, seed, scale)
    kind = kept.schema["id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    shards = sharded(kept, dims, len(centroids), width, scale)
    for _ in range(rounds):
        centroids = moved(shards, assigned(shards, centroids), centroids)
    labels = save(assigned(shards, centroids), "clusters")
    ids = save(shards.rows.where("shard = 0").select("block", "ids"), "vector-ids")
    discard(shards.rows)
    inertia = {r.cluster: r.total for r in labels.select(F.inline(F.arrays_zip(F.col("clusters").alias("cluster"), F.col("distances").alias("distance")))).toDF("cluster", "distance").groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    about = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    named = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    rows = ids.join(labels, "block").select(F.inline(F.arrays_zip("ids", "clusters", "distances"))).toDF("id", "cluster", "distance")
    return rows.join(F.broadcast(named), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
