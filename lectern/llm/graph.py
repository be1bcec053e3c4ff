"""Connected components by joins: alternating large and small stars."""

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import discard, save

EDGES_PER_FILE = 1 << 20


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n points, all in one task, the smallest index that it reaches over the pairs (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u: then the edges are stars."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))))
    return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 OR ups = 1 AND low = 0").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each end of an edge reaches. Nodes without edges are not in the result.

    Each step hangs a node's neighbours on their smallest one, until all edges are
    stars. The smallest neighbours are held before they are joined, so that both
    sides of a join are plain shuffles and Spark can split a hub. Null ends and
    loops are ignored.
    """
    x, y = F.col(a), F.col(b)
    known = save(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges", EDGES_PER_FILE)
    for _ in range(rounds):
        if _settled(known):
            break
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).persist(StorageLevel.DISK_ONLY)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().persist(StorageLevel.DISK_ONLY)
        lower = large.groupBy("u").agg(F.min("v").alias("m")).persist(StorageLevel.DISK_ONLY)
        small = large.join(lower, "u").select(F.inline(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        before, known = known, save(small, "stars", EDGES_PER_FILE)
        for held in (lower, large, low):
            held.unpersist()
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    stems = known.select("v").distinct()
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stems.select(F.col("v").alias("node"), F.col("v").alias("component")))
