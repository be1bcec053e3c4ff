"""Queries of learner analytics and cohorts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import analytics, cohort
from lectern.plans.registry import query
from lectern.sources.tables import ANSWERS_SQL, ATTEMPTS_SQL, REVIEWS_SQL, answers, attempts, read, reviews

AS_OF = "2024-01-30"
POOL_SQL = f"""{ATTEMPTS_SQL}, pool AS (SELECT test_id, user_id, completed_at, attempt_id, score, elapsed_seconds, visible FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id, user_id ORDER BY completed_at, attempt_id) AS rn FROM attempts WHERE completed) WHERE rn = 1)"""
MIDRANK_SQL = f"""{POOL_SQL}, ranked AS (SELECT *, count(*) OVER (PARTITION BY test_id) AS n,
  rank() OVER (PARTITION BY test_id ORDER BY score) - 1 AS below, count(*) OVER (PARTITION BY test_id, score) - 1 AS ties FROM pool),
  pct AS (SELECT *, CASE WHEN n = 1 THEN 100.0::DOUBLE ELSE round(100 * (below + ties / 2.0::DOUBLE) / (n - 1), 6) END AS percentile FROM ranked)"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.first_attempts(attempts(spark, sf_dir))


@query(f"""WITH {ATTEMPTS_SQL} SELECT user_id, completed_at::DATE AS day, count(*) AS attempts, round(avg(score), 6) AS mean_score, max(score) AS best_score
FROM attempts WHERE completed GROUP BY ALL""")
def score_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.score_history(attempts(spark, sf_dir))


@query(f"""WITH {ANSWERS_SQL} SELECT topic, count(is_correct) AS attempts, count(*) FILTER (is_correct) AS correct,
CASE WHEN count(is_correct) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (is_correct) / count(is_correct), 2) ELSE 0 END AS accuracy FROM answers GROUP BY topic""")
def topic_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.accuracy(answers(spark, sf_dir), "topic")


USER_TOPIC_SQL = f"""{ANSWERS_SQL}, by_topic AS (SELECT o_custkey AS user_id, topic, count(is_correct) AS attempts, count(*) FILTER (is_correct) AS correct,
CASE WHEN count(is_correct) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (is_correct) / count(is_correct), 2) ELSE 0 END AS accuracy
FROM answers JOIN orders ON attempt_id = o_orderkey GROUP BY ALL)"""


def user_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).join(attempts(spark, sf_dir).select("attempt_id", "user_id"), "attempt_id")


@query(f"WITH {USER_TOPIC_SQL} SELECT * FROM by_topic WHERE attempts >= 3 AND accuracy < 60")
def weak_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.weak_topics(user_answers(spark, sf_dir), "user_id", "topic")


@query(f"""WITH {USER_TOPIC_SQL} SELECT user_id, arg_min(topic, (-accuracy, -attempts, topic)) AS best_topic, arg_min(topic, (accuracy, -attempts, topic)) AS weakest_topic
FROM by_topic WHERE attempts > 0 GROUP BY user_id""")
def best_and_weakest_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.best_and_weakest(analytics.accuracy(user_answers(spark, sf_dir), "user_id", "topic"), "user_id")


@query(f"""WITH days AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE ts::DATE <= DATE '{AS_OF}'),
runs AS (SELECT user_id, count(*) AS n, max(d) AS last FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS island FROM days) GROUP BY user_id, island)
SELECT user_id, max(n) AS longest, coalesce(max(n) FILTER (last >= DATE '{AS_OF}' - 1), 0) AS current FROM runs GROUP BY user_id""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").select("user_id", analytics.local_date("ts").alias("day"))
    return analytics.streaks(days, "user_id", "day", AS_OF)


@query("""WITH spent AS (SELECT ts::DATE AS day, CASE event_type WHEN 'purchase' THEN greatest(CAST(floor(value) AS BIGINT), 0) WHEN 'click' THEN 300 ELSE 30 END AS s FROM events WHERE event_type IN ('purchase', 'click', 'view')),
calendar AS (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, round(coalesce(sum(s), 0) / 60.0::DOUBLE, 2) AS minutes FROM calendar LEFT JOIN spent USING (day) GROUP BY day""")
def study_time_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    of = lambda kind: e.where(F.col("event_type") == kind)
    quizzes = of("purchase").select("ts", F.floor("value").alias("seconds"))
    return analytics.study_minutes(quizzes, of("view").select("ts"), of("click").select("ts"), "2023-12-25", "2024-02-05")


@query(f"""WITH {REVIEWS_SQL} SELECT CAST(date_trunc('week', reviewed_at) AS DATE) AS week, count(*) AS reviews, count(*) FILTER (rating IN ('good', 'easy')) AS retained,
round(100.0::DOUBLE * count(*) FILTER (rating IN ('good', 'easy')) / count(*), 2) AS retention FROM reviews GROUP BY 1""")
def weekly_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.weekly_retention(reviews(spark, sf_dir))


CARDS_SQL = """cards AS (SELECT p_partkey AS card_id, p_type AS deck, DATE '2024-01-30' + CAST(p_partkey % 41 - 20 AS INTEGER) AS due_day,
  CAST(p_size AS BIGINT) AS "interval", p_partkey % 7 AS repetitions, p_partkey % 13 = 0 AS suspended FROM part)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS card_id", "p_type AS deck", "date_add(DATE '2024-01-30', CAST(p_partkey % 41 - 20 AS INT)) AS due_day",
        "CAST(p_size AS BIGINT) AS interval", "p_partkey % 7 AS repetitions", "p_partkey % 13 = 0 AS suspended",
    )


@query(f"""WITH {CARDS_SQL} SELECT deck, count(*) AS total, count(*) FILTER (NOT suspended AND due_day <= DATE '{AS_OF}') AS due, count(*) FILTER (NOT suspended AND "interval" >= 21) AS mature,
count(*) FILTER (NOT suspended AND repetitions = 0) AS new, count(*) FILTER (suspended) AS suspended FROM cards GROUP BY deck""")
def card_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.card_inventory(cards(spark, sf_dir), "deck", as_of=AS_OF)


@query(f"""WITH {CARDS_SQL}, calendar AS (SELECT CAST(unnest(generate_series(DATE '{AS_OF}', DATE '{AS_OF}' + 29, INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, count(card_id) AS due FROM calendar LEFT JOIN (SELECT * FROM cards WHERE NOT suspended) ON due_day = day GROUP BY day""")
def upcoming_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.upcoming_due(cards(spark, sf_dir), AS_OF, 30)


@query("""WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(value) FILTER (k = n // 4) AS q1, max(value) FILTER (k = n // 2) AS q2, max(value) FILTER (k = 3 * n // 4) AS q3 FROM x GROUP BY event_type""")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.quartiles(read(spark, sf_dir, "events"), "event_type", "value")


@query("""WITH x AS (SELECT value, event_type IN ('purchase', 'signup') AS truth FROM events WHERE value IS NOT NULL), t AS (SELECT unnest([1.0, 2.0, 5.0, 10.0, 20.0, 50.0])::DOUBLE AS threshold)
SELECT threshold, round((coalesce(count(*) FILTER (truth AND value >= threshold) / nullif(count(*) FILTER (truth), 0), 0.0) + coalesce(count(*) FILTER (NOT truth AND value < threshold) / nullif(count(*) FILTER (NOT truth), 0), 0.0)) / 2, 6) AS balanced_accuracy
FROM x, t GROUP BY threshold ORDER BY balanced_accuracy DESC, threshold LIMIT 1""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("value IS NOT NULL").select("value", F.col("event_type").isin("purchase", "signup").alias("truth"))
    return analytics.threshold_sweep(rows, "value", "truth", [1.0, 2.0, 5.0, 10.0, 20.0, 50.0])


@query(f"WITH {POOL_SQL} SELECT test_id, user_id, attempt_id, score FROM pool")
def first_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("test_id", "user_id", "attempt_id", "score")


@query(f"""WITH {POOL_SQL} SELECT test_id, rank, user_id, score, elapsed_seconds FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, elapsed_seconds, completed_at, attempt_id) AS rank FROM pool)
WHERE rank <= 20 AND visible""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.leaderboard(pool(spark, sf_dir))


@query(f"""WITH {POOL_SQL} SELECT test_id, rank, user_id, score, elapsed_seconds FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, elapsed_seconds, completed_at, attempt_id) AS rank FROM pool)
WHERE (rank <= 20 AND visible) OR user_id = 7""")
def leaderboard_with_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.leaderboard(pool(spark, sf_dir), caller=7)


@query(f"WITH {MIDRANK_SQL} SELECT test_id, user_id, attempt_id, score, percentile FROM pct")
def midrank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.midrank_percentiles(pool(spark, sf_dir))


@query(f"WITH {POOL_SQL} SELECT test_id, count(*) AS n, round(avg(score), 2) AS mean, round(median(score), 2) AS median, round(stddev_pop(score), 2) AS stddev FROM pool GROUP BY test_id")
def cohort_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_stats(pool(spark, sf_dir))


@query(f"""WITH {POOL_SQL}, b AS (SELECT range AS bucket FROM range(11)) SELECT bucket, count(score) AS n FROM b LEFT JOIN pool ON bucket = least(CAST(floor(score / 10) AS BIGINT), 10) GROUP BY bucket""")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.score_histogram(pool(spark, sf_dir))


@query(f"""WITH {POOL_SQL}, {ANSWERS_SQL} SELECT question_id, count(*) AS n, round(avg(CASE WHEN is_correct THEN 1 ELSE 0 END), 6) AS accuracy
FROM answers WHERE attempt_id IN (SELECT attempt_id FROM pool) GROUP BY question_id""")
def item_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.item_accuracy(answers(spark, sf_dir), pool(spark, sf_dir))


BOARD_SQL = """rows AS (SELECT user_id, count(*) AS tests, round(avg(percentile) + 1e-9, 4) AS mean_percentile FROM pct WHERE n >= 10 GROUP BY user_id HAVING count(*) >= {least}),
placed AS (SELECT user_id, c_name AS handle, tests, mean_percentile, row_number() OVER (ORDER BY mean_percentile DESC, lower(c_name), user_id) AS rank FROM rows JOIN customer ON c_custkey = user_id)"""


def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("handle"))


@query(f"WITH {MIDRANK_SQL}, {BOARD_SQL.format(least=3)} SELECT * FROM placed WHERE rank <= 50 OR user_id = 7")
def global_accuracy_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.accuracy_board(pool(spark, sf_dir), handles(spark, sf_dir), caller=7)


WEEK_SQL = MIDRANK_SQL.replace("ranked AS (SELECT *,", "recent AS (SELECT * FROM pool WHERE completed_at >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 400 DAY), ranked AS (SELECT *,").replace("FROM pool),", "FROM recent),")


@query(f"WITH {WEEK_SQL}, {BOARD_SQL.format(least=1)} SELECT * FROM placed WHERE rank <= 50 OR user_id = 7")
def recent_accuracy_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board over a window up to the last attempt: 400 days, as the given learners take a test a year; the window is a parameter."""
    last = read(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("last"))
    recent = pool(spark, sf_dir).crossJoin(F.broadcast(last))  # one row
    return cohort.accuracy_board(recent, handles(spark, sf_dir), least_tests=1, caller=7, since=F.col("last") - F.expr("INTERVAL 400 DAY"))


@query(f"""WITH {MIDRANK_SQL}, m AS (SELECT *, avg(score) OVER (PARTITION BY test_id) AS mean, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, elapsed_seconds, completed_at, attempt_id) AS rank FROM pct)
SELECT user_id, count(*) AS tests, round(avg(rank) + 1e-9, 4) AS mean_rank, round(avg(percentile) + 1e-9, 4) AS mean_percentile, round(avg(score - mean) + 1e-9, 4) AS mean_margin FROM m GROUP BY user_id""")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.pool_summary(pool(spark, sf_dir))


@query(f"""WITH {POOL_SQL}, {ANSWERS_SQL}, g AS (SELECT test_id, user_id, question_id, topic, CASE WHEN coalesce(is_correct, false) THEN 1 ELSE 0 END AS ok FROM answers JOIN pool USING (attempt_id)),
q AS (SELECT test_id, topic, question_id, avg(ok) AS p FROM g GROUP BY ALL), p AS (SELECT test_id, topic, round(100 * avg(p) + 1e-9, 2) AS pool_accuracy FROM q GROUP BY ALL)
SELECT test_id, user_id, topic, round(100 * avg(ok) + 1e-9, 2) AS user_accuracy, any_value(pool_accuracy) AS pool_accuracy FROM g JOIN p USING (test_id, topic) GROUP BY test_id, user_id, topic""")
def topic_against_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.topic_against_pool(answers(spark, sf_dir), pool(spark, sf_dir))


@query("""SELECT event_id % 200 AS test_id, count(DISTINCT user_id) AS reporters, count(DISTINCT user_id) >= 3 AS hidden FROM events WHERE event_type = 'error' GROUP BY 1""")
def moderation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = read(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("event_id % 200 AS test_id", "user_id AS reporter_id")
    return cohort.moderation_queue(reports)
