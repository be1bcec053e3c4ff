"""Ranks within groups that may hold a large part of all rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], coarse: Column, order: list[Column], rank: str = "rank", size: str | None = None) -> DataFrame:
    """df with each row's number from 1 within its group by (coarse, order), and the group's size if wanted.

    coarse cuts a group into slices in its order: slices are counted and added up,
    rows are only sorted within their slice, so that no task ranks a whole group.
    Null group keys are groups too.
    """
    cut = df.withColumn("__slice", coarse)
    counts = cut.groupBy(*group, "__slice").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [*group, "__slice"]
    starts = counts.select(*(F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)), before.alias("__before"), F.sum("__n").over(whole).alias("__size"))
    inside = cut.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    out = inside.join(starts, same).withColumn(rank, (F.col("__at") + F.col("__before")).cast("long"))
    if size:
        out = out.withColumn(size, F.col("__size").cast("long"))
    return out.select(*df.columns, rank, *([size] if size else []))
