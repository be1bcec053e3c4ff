"""Learner analytics: accuracy, streaks, study time, retention, inventories."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_date(ts: Column | str, zone: Column | str | None = "UTC") -> Column:
    """The date of a UTC time in a learner's zone; a null zone is UTC."""
    zone = F.lit(zone) if zone is None or isinstance(zone, str) else zone
    return F.to_date(F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, F.coalesce(zone, F.lit("UTC"))))


def day_start(day: str, zone: str) -> Column:
    """When a local day began, in UTC; a null zone is UTC."""
    return F.to_utc_timestamp(F.col(day).cast("timestamp"), F.coalesce(F.col(zone), F.lit("UTC")))


def accuracy(answers: DataFrame, *keys: str) -> DataFrame:
    """(keys, attempts, correct, accuracy %): unanswered rows, of null is_correct, do not count."""
    n, correct = F.count("is_correct"), F.count_if("is_correct")
    return answers.groupBy(*keys).agg(n.alias("attempts"), correct.alias("correct")).withColumn("accuracy", F.when(F.col("attempts") > 0, F.round(100 * F.col("correct") / F.col("attempts"), 2)).otherwise(0.0))


def weak_topics(answers: DataFrame, *keys: str, below: float = 60.0, least: int = 3) -> DataFrame:
    """Groups of at least so many answers whose accuracy is below the mark."""
    return accuracy(answers, *keys).where((F.col("attempts") >= least) & (F.col("accuracy") < below))


def score_history(attempts: DataFrame) -> DataFrame:
    """Per learner and day of completion: attempts, mean and best score."""
    return attempts.where("completed").groupBy("user_id", local_date("completed_at").alias("day")).agg(F.count("*").alias("attempts"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("best_score"))


def streaks(days: DataFrame, key: str, day: str, as_of: str) -> DataFrame:
    """(key, longest, current): runs of consecutive dates up to as_of; the current one ends on that day or the one before."""
    dates = days.select(key, F.col(day).alias("d")).where(F.col("d") <= F.lit(as_of).cast("date")).distinct()
    island = F.date_sub("d", F.row_number().over(Window.partitionBy(key).orderBy("d")))
    runs = dates.withColumn("island", island).groupBy(key, "island").agg(F.count("*").alias("n"), F.max("d").alias("last"))
    now = F.when(F.col("last") >= F.date_sub(F.lit(as_of).cast("date"), 1), F.col("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.coalesce(F.max(now), F.lit(0)).cast("long").alias("current"))


def study_minutes(quizzes: DataFrame, reviews: DataFrame, messages: DataFrame, first_day: str, last_day: str, review_seconds: int = 30, message_seconds: int = 300) -> DataFrame:
    """(day, minutes) for each day of the range, 0 where nothing was done.

    quizzes has (ts, seconds), negative ones count 0; reviews and messages have (ts).
    """
    of = lambda df, s: df.select(local_date("ts").alias("day"), s.cast("long").alias("seconds"))
    spent = of(quizzes, F.greatest(F.col("seconds"), F.lit(0))).unionByName(of(reviews, F.lit(review_seconds))).unionByName(of(messages, F.lit(message_seconds)))
    calendar = quizzes.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("day"))
    return calendar.join(spent.groupBy("day").agg(F.sum("seconds").alias("s")), "day", "left").select("day", F.round(F.coalesce("s", F.lit(0)) / 60, 2).alias("minutes"))


def weekly_retention(reviews: DataFrame, zone: str = "UTC") -> DataFrame:
    """(week, reviews, retained, retention %): good and easy ratings by Monday-start week."""
    week = F.to_date(F.date_trunc("week", F.from_utc_timestamp("reviewed_at", zone)))
    return reviews.groupBy(week.alias("week")).agg(F.count("*").alias("reviews"), F.count_if(F.col("rating").isin("good", "easy")).alias("retained")).withColumn("retention", F.round(100 * F.col("retained") / F.col("reviews"), 2))


def card_inventory(cards: DataFrame, *keys: str, as_of: str, mature: int = 21) -> DataFrame:
    """(keys, total, due, mature, new, suspended) of cards (due_day, interval, repetitions, suspended); only the total counts suspended ones."""
    live = ~F.col("suspended")
    return cards.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(live & (F.col("due_day") <= F.lit(as_of).cast("date"))).alias("due"), F.count_if(live & (F.col("interval") >= mature)).alias("mature"),
        F.count_if(live & (F.col("repetitions") == 0)).alias("new"), F.count_if("suspended").alias("suspended"),
    )


def upcoming_due(cards: DataFrame, as_of: str, days: int) -> DataFrame:
    """(day, due) for each of the next days, 0 included."""
    calendar = cards.sparkSession.range(days).select(F.expr(f"date_add(date '{as_of}', CAST(id AS INT))").alias("day"))
    due = cards.where(~F.col("suspended")).groupBy(F.col("due_day").alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(due, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("due"))


def best_and_weakest(by_topic: DataFrame, key: str) -> DataFrame:
    """(key, best_topic, weakest_topic) of accuracy rows with attempts; ties go to more attempts, then to the name."""
    some = by_topic.where("attempts > 0")
    # of the greatest (accuracy, attempts) the smallest name: the smallest of (-accuracy, -attempts, name)
    best = F.min(F.struct((-F.col("accuracy")).alias("a"), (-F.col("attempts")).alias("b"), "topic"))["topic"]
    weakest = F.min(F.struct("accuracy", (-F.col("attempts")).alias("b"), "topic"))["topic"]
    return some.groupBy(key).agg(best.alias("best_topic"), weakest.alias("weakest_topic"))


def quartiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, q1, q2, q3): the values at places n div 4, n div 2 and 3n div 4 from 0, by ranks rather than gathered lists."""
    rows = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(key).orderBy(value))
    total = F.sum("c").over(Window.partitionBy(key))
    held = rows.withColumns({"upto": upto, "n": total})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    return held.groupBy(key).agg(F.max("n").alias("n"), at(F.expr("n div 4")).alias("q1"), at(F.expr("n div 2")).alias("q2"), at(F.expr("3 * n div 4")).alias("q3"))


def threshold_sweep(rows: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, balanced_accuracy) of the best threshold for score >= threshold; ties go to the lower one. One aggregation for all thresholds."""
    positives, negatives = F.count_if(truth), F.count_if(~F.col(truth))
    hit = [F.count_if(F.col(truth) & (F.col(score) >= t)).alias(f"h{i}") for i, t in enumerate(thresholds)]
    clear = [F.count_if(~F.col(truth) & (F.col(score) < t)).alias(f"c{i}") for i, t in enumerate(thresholds)]
    one = rows.agg(positives.alias("p"), negatives.alias("n"), *hit, *clear)
    rates = F.array(*(F.struct(F.lit(t).alias("threshold"), F.round((F.coalesce(F.try_divide(f"h{i}", "p"), F.lit(0.0)) + F.coalesce(F.try_divide(f"c{i}", "n"), F.lit(0.0))) / 2, 6).alias("balanced_accuracy")) for i, t in enumerate(thresholds)))
    best = F.array_max(F.transform(rates, lambda x: F.struct(x["balanced_accuracy"].alias("b"), (-x["threshold"]).alias("t"))))
    return one.select(best.alias("x")).select((-F.col("x.t")).alias("threshold"), F.col("x.b").alias("balanced_accuracy"))
