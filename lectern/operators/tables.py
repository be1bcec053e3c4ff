"""Changes of tables as rewrites: replace by key, upsert, uniqueness, trees."""

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_by_key(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """All old rows of keys that occur in new go; the new ones come in."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """New rows take the place of old ones of the same key; of several new ones the greatest row counts."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*")
    return replace_by_key(old, one.select(*old.columns), *keys)


def add_to(stats: DataFrame, batch: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Running totals with a batch's added."""
    return stats.select(*keys, *sums).unionByName(batch.select(*keys, *sums)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of keys that are not unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cascade(rows: DataFrame, ref: str, gone: DataFrame, key: str) -> DataFrame:
    """rows without those that refer to a deleted row."""
    return rows.join(gone.select(F.col(key).alias("__gone")).distinct(), F.col(ref) == F.col("__gone"), "left_anti")


def removed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The keys that a cascade took, for the tables that refer to them."""
    return before.select(key).join(after.select(key).distinct(), key, "left_anti")


def set_null(rows: DataFrame, ref: str, gone: DataFrame, key: str) -> DataFrame:
    """rows whose reference is null where it was to a deleted row."""
    lost = gone.select(F.col(key).alias("__gone")).distinct()
    return rows.join(lost, F.col(ref) == F.col("__gone"), "left").withColumn(ref, F.when(F.col("__gone").isNull(), F.col(ref))).drop("__gone")


def tree(nodes: DataFrame, roots: str = "parent_id IS NULL") -> DataFrame:
    """(id, depth, path) of (id, parent_id), from the roots down: a join for each level, whatever the number of rows.

    A node of several parents, or below several roots, comes once for each path; one
    that is below itself and a root is an error. Each level is made at once and held
    on the executors' disks for the session, as the next one and the result read it.
    """
    start = nodes.where(roots).select("id", F.lit(0).alias("depth"), F.array("id").alias("up"))
    children = nodes.select(F.col("id").alias("child"), "parent_id")
    again = F.when(F.array_contains("up", F.col("child")), F.raise_error(F.lit("a node is below itself")))
    below = lambda level: level.join(children, F.col("parent_id") == F.col("id")).select(F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("up", F.coalesce(again.cast(start.schema["up"].dataType), F.array("child"))).alias("up"))
    levels = [start.persist(StorageLevel.DISK_ONLY)]
    while levels[-1].count():
        levels.append(below(levels[-1]).persist(StorageLevel.DISK_ONLY))
    levels.pop().unpersist()
    path = F.array_join(F.transform("up", lambda x: x.cast("string")), "/").alias("path")
    return reduce(DataFrame.unionAll, levels or [start]).select("id", "depth", path)
