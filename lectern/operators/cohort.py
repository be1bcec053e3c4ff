"""Cohort ranking and statistics over test attempts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranks import ranked

#: Added before means are rounded, so that an exact half goes up whatever the order of the sum.
TINY = 1e-9
ORDER = (F.desc, "score"), (F.asc, "elapsed_seconds"), (F.asc, "completed_at"), (F.asc, "attempt_id")


def _order() -> list:
    return [f(c) for f, c in ORDER]


def first_attempts(attempts: DataFrame) -> DataFrame:
    """Each learner's first completed attempt at each test, by completion and id: an aggregate, not a sort of each group."""
    row = F.struct("completed_at", "attempt_id", "score", "elapsed_seconds", "visible")
    return attempts.where("completed").groupBy("test_id", "user_id").agg(F.min(row).alias("r")).select("test_id", "user_id", "r.*")


def by_rank(pool: DataFrame) -> DataFrame:
    """pool with rank: the place within the test by score, time taken, completion and id; a test's attempts are sorted score by score."""
    return ranked(pool, ["test_id"], -F.col("score"), _order())


def leaderboard(pool: DataFrame, top: int = 20, caller: int | None = None) -> DataFrame:
    """(test_id, rank, user_id, score, elapsed_seconds): ranks count hidden learners, who are then left out. The caller is added if beyond the top."""
    placed = by_rank(pool)
    shown = F.col("rank") <= top
    if caller is not None:
        return placed.where((F.col("visible") & shown) | (F.col("user_id") == caller)).select("test_id", "rank", "user_id", "score", "elapsed_seconds")
    return placed.where(shown).where("visible").select("test_id", "rank", "user_id", "score", "elapsed_seconds")


def midrank_percentiles(pool: DataFrame) -> DataFrame:
    """(test_id, user_id, attempt_id, score, percentile): 100 (below + ties / 2) / (n - 1) among the others; 100 alone.

    Counts by score come first; only they are windowed, so a test with a third of all attempts is a few rows.
    """
    by = pool.groupBy("test_id", "score").agg(F.count("*").alias("same"))
    w = Window.partitionBy("test_id")
    counts = by.withColumns({"below": F.sum("same").over(w.orderBy("score")) - F.col("same"), "n": F.sum("same").over(w)})
    share = 100 * (F.col("below") + (F.col("same") - 1) / 2) / (F.col("n") - 1)
    return pool.join(counts, ["test_id", "score"]).select("test_id", "user_id", "attempt_id", "score", F.when(F.col("n") == 1, 100.0).otherwise(F.round(share, 6)).alias("percentile"))


def cohort_stats(pool: DataFrame) -> DataFrame:
    """(test_id, n, mean, median, stddev): the population's deviation, rounded to 2."""
    return pool.groupBy("test_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 2).alias("mean"), F.round(F.median("score"), 2).alias("median"), F.round(F.stddev_pop("score"), 2).alias("stddev"))


def score_histogram(pool: DataFrame) -> DataFrame:
    """(bucket 0 to 10, n): tens, 100 on its own, empty buckets included."""
    bucket = F.least(F.floor(F.col("score") / 10), F.lit(10)).cast("long")
    counts = pool.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return pool.sparkSession.range(11).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def item_accuracy(answers: DataFrame, pool: DataFrame) -> DataFrame:
    """(question_id, n, accuracy) over the answers of pool attempts; a missing grade counts as wrong."""
    graded = answers.join(pool.select("attempt_id"), "attempt_id", "left_semi")
    return graded.groupBy("question_id").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("is_correct", F.lit(False)).cast("int")), 6).alias("accuracy"))


def accuracy_board(pool: DataFrame, handles: DataFrame, least_tests: int = 3, least_pool: int = 10, top: int = 50, caller: int | None = None, since: Column | None = None) -> DataFrame:
    """(user_id, handle, tests, mean_percentile, rank) of learners with enough tests of large enough pools, ties by handle; the caller is added if beyond the top.

    handles has (user_id, handle). With since only attempts completed from then on are looked at.
    """
    if since is not None:
        pool = pool.where(F.col("completed_at") >= since)
    sizes = pool.groupBy("test_id").agg(F.count("*").alias("size")).where(F.col("size") >= least_pool)
    rows = midrank_percentiles(pool).join(sizes, "test_id").groupBy("user_id").agg(F.count("*").alias("tests"), F.round(F.avg("percentile") + TINY, 4).alias("mean_percentile")).where(F.col("tests") >= least_tests)
    named = rows.join(handles, "user_id").select("user_id", "handle", "tests", "mean_percentile").withColumn("__all", F.lit(0))
    placed = ranked(named, ["__all"], F.floor(-F.col("mean_percentile") * 16), [F.desc("mean_percentile"), F.lower("handle"), F.col("user_id")]).drop("__all")
    return placed.where((F.col("rank") <= top) | (F.col("user_id") == caller) if caller is not None else F.col("rank") <= top)


def pool_summary(pool: DataFrame) -> DataFrame:
    """(user_id, tests, mean_rank, mean_percentile, mean_margin): the margin is the score less the test's mean."""
    means = pool.groupBy("test_id").agg(F.avg("score").alias("m"))
    rows = midrank_percentiles(pool).join(means, "test_id").join(by_rank(pool).select("attempt_id", "rank"), "attempt_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("tests"), F.round(F.avg("rank") + TINY, 4).alias("mean_rank"), F.round(F.avg("percentile") + TINY, 4).alias("mean_percentile"), F.round(F.avg(F.col("score") - F.col("m")) + TINY, 4).alias("mean_margin"))


def topic_against_pool(answers: DataFrame, pool: DataFrame) -> DataFrame:
    """(test_id, user_id, topic, user_accuracy, pool_accuracy): a learner's share of right answers by topic, and the mean of the questions' shares among all of the test's pool; a missing grade is wrong.

    answers has (attempt_id, question_id, topic, is_correct).
    """
    graded = answers.join(pool.select("attempt_id", "test_id", "user_id"), "attempt_id").select("test_id", "user_id", "question_id", "topic", F.coalesce("is_correct", F.lit(False)).cast("int").alias("ok"))
    by_question = graded.groupBy("test_id", "topic", "question_id").agg(F.avg("ok").alias("p"))
    of_pool = by_question.groupBy("test_id", "topic").agg(F.round(100 * F.avg("p") + TINY, 2).alias("pool_accuracy"))
    mine = graded.groupBy("test_id", "user_id", "topic").agg(F.round(100 * F.avg("ok") + TINY, 2).alias("user_accuracy"))
    return mine.join(of_pool, ["test_id", "topic"]).select("test_id", "user_id", "topic", "user_accuracy", "pool_accuracy")


def moderation_queue(reports: DataFrame, hide_at: int = 3) -> DataFrame:
    """(test_id, reporters, hidden): tests are hidden at so many different reporters."""
    return reports.groupBy("test_id").agg(F.countDistinct("reporter_id").alias("reporters")).withColumn("hidden", F.col("reporters") >= hide_at)
