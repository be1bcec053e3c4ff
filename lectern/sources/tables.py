"""Readers of the star-schema and text tables, and what of the learning domain they stand for.

An order is a test attempt (its customer the learner), a line item an answer to
the question that its part stands for, and an event a learner's action.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; timestamps without a zone are taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """read(), dealt to all cores where the table is one file: Spark reads a file's row group in one task, and so would work on all of a small table's texts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    whole = read(spark, sf_dir, name)
    one_file = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    return whole.repartition(spark.sparkContext.defaultParallelism) if one_file else whole


ATTEMPTS_SQL = """attempts AS (SELECT o_orderkey AS attempt_id, o_orderkey % 40 AS test_id, o_custkey AS user_id,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) AS score, 30 + o_orderkey % 3600 AS elapsed_seconds,
  o_orderdate AS completed_at, o_orderstatus <> 'P' AS completed, o_custkey % 11 <> 0 AS visible FROM orders)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attempt_id, test_id, user_id, score 0 to 100, elapsed_seconds, completed_at, completed, visible)."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS attempt_id", "o_orderkey % 40 AS test_id", "o_custkey AS user_id", "CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) AS score",
        "30 + o_orderkey % 3600 AS elapsed_seconds", "o_orderdate AS completed_at", "o_orderstatus <> 'P' AS completed", "o_custkey % 11 <> 0 AS visible",
    )


ANSWERS_SQL = """answers AS (SELECT l_orderkey AS attempt_id, l_partkey AS question_id, p_type AS topic,
  CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS is_correct, l_shipdate AS answered_at
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attempt_id, question_id, topic, is_correct or null if unanswered, answered_at)."""
    items, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return items.join(parts, items.l_partkey == parts.p_partkey).selectExpr(
        "l_orderkey AS attempt_id", "l_partkey AS question_id", "p_type AS topic", "CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS is_correct", "l_shipdate AS answered_at"
    )


REVIEWS_SQL = """reviews AS (SELECT event_id AS review_id, user_id, event_id % 997 AS card_id, ts AS reviewed_at,
  CASE event_type WHEN 'view' THEN 'good' WHEN 'click' THEN 'easy' WHEN 'error' THEN 'again' ELSE 'hard' END AS rating FROM events)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(review_id, user_id, card_id, reviewed_at, rating) of flashcards."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS review_id", "user_id", "event_id % 997 AS card_id", "ts AS reviewed_at", "CASE event_type WHEN 'view' THEN 'good' WHEN 'click' THEN 'easy' WHEN 'error' THEN 'again' ELSE 'hard' END AS rating"
    )
