"""Windows, limits and caches over a stream of actions, with their batch forms.

Each function takes a batch or a streaming DataFrame of (ts, user_id, ...), but
where it says otherwise.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _watermarked(df: DataFrame, late: str) -> DataFrame:
    return df.withWatermark("ts", late) if df.isStreaming else df


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fixed_windows(df: DataFrame, key: str, length: str = "60 seconds", late: str = "1 hour") -> DataFrame:
    """(key, start, n) by tumbling window."""
    w = F.window("ts", length)
    return _watermarked(df, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def sessions(df: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, n) by session: a run of actions with no greater gap."""
    w = F.session_window("ts", gap)
    return _watermarked(df, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def latest_status(df: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """(key, status) of each key's last row by (ts, id): an aggregate, which a stream updates."""
    return _watermarked(df, late).groupBy(key).agg(F.max(F.struct("ts", "id", "status")).alias("r")).select(key, "r.status")


def in_time(df: DataFrame, started: str, limit_seconds: int) -> DataFrame:
    """Rows no later than the limit after their start."""
    return df.where(F.col("ts") <= F.col(started) + F.make_dt_interval(secs=F.lit(limit_seconds)))


def first_in(df: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    """A stream's first row of each key within the time to live: the misses of a cache."""
    return df.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def trailing_counts(df: DataFrame, key: str, seconds: int) -> DataFrame:
    """Batch: with n, the key's rows in so many seconds up to each row."""
    w = Window.partitionBy(key, "__slice").orderBy(F.unix_micros("ts")).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return _sliced(df, seconds).withColumn("n", F.count("*").over(w)).where("not __lead").drop("__slice", "__lead")


def _sliced(df: DataFrame, seconds: int) -> DataFrame:
    """Each row in its slice of so many seconds, and as a lead in the next one: a key's rows are never all in one task."""
    own = F.floor(F.unix_micros("ts") / (seconds * 1_000_000)).cast("long")
    places = F.array(F.struct(own.alias("__slice"), F.lit(False).alias("__lead")), F.struct((own + 1).alias("__slice"), F.lit(True).alias("__lead")))
    return df.select("*", F.inline(places))


def cache_hits(df: DataFrame, keys: list[str], seconds: int = 3600) -> DataFrame:
    """Batch: with hit, whether the same key came at most so many seconds before."""
    w = Window.partitionBy(*keys, "__slice").orderBy("ts", "event_id")
    hit = F.coalesce(F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w) <= seconds * 1_000_000, F.lit(False))
    return _sliced(df, seconds).withColumn("hit", hit).where("not __lead").drop("__slice", "__lead")


def limited(df: DataFrame, key: str, per_minute: int = 15, per_day: int = 1000) -> DataFrame:
    """Stream: (key, ts, allowed) by a sliding log in which refused requests are not recorded.

    The refusals feed back, so it is state for each key: its allowed times of the last day, at most per_day.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = list(state.get[0]) if state.exists else []
        times = sorted(t for f in frames for t in f.ts.astype("datetime64[us]").astype("int64"))
        out = []
        for t in times:
            log = [x for x in log if x > t - 86_400_000_000]
            ok = len(log) < per_day and sum(x > t - 60_000_000 for x in log) < per_minute
            if ok:
                log.append(t)
            out.append(ok)
        state.update((log,))
        state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame({key: [k[0]] * len(times), "ts": pd.to_datetime(times, unit="us"), "allowed": out})

    return df.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, allowed boolean", "log array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_hit_windows(df: DataFrame, key: str, seconds: int = 60, most: int = 10) -> DataFrame:
    """Stream: (key, ts, n, allowed): a counter that begins with a key's first hit and starts anew with the first one after so many seconds; beyond `most` a hit is refused.

    The state of a key is its window's start and count.
    """
    kind = df.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        times, counts = sorted(t for f in frames for t in f.ts.astype("datetime64[us]").astype("int64")), []
        for t in times:
            if start is None or t >= start + seconds * 1_000_000:
                start, n = int(t), 0
            n += 1
            counts.append(n)
        state.update((start, n))
        state.setTimeoutDuration(max(1000, seconds * 1000))
        yield pd.DataFrame({key: [k[0]] * len(times), "ts": pd.to_datetime(times, unit="us"), "n": counts, "allowed": [c <= most for c in counts]})

    return df.select(key, "ts").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, n bigint, allowed boolean", "start bigint, n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def provider_gate(df: DataFrame, key: str, tokens: str, requests_a_minute: int | None = None, tokens_a_minute: int | None = None, seconds: int = 60) -> DataFrame:
    """Stream: (key, ts, tokens, decision): each request is sent, refused for the limit, or skipped while the key cools down.

    A counter of requests and tokens begins with a key's first request and anew with
    the first one after so many seconds. A request that would go beyond either limit
    is a `limit` and is not counted; it makes the key cool down for what is left of
    the counter's time, in whole seconds and one at least, in which all requests are
    `cooldown`. The state of a key is its counter and the end of its cool-down, which
    outlives the batch and the counter. Null tokens count 0. Requests of a batch are
    taken in the order of their times, so a stream that brings them in order gives
    what one batch gives.
    """
    kind = df.schema[key].dataType.simpleString()
    unit = 1_000_000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, requests, used, until = state.get if state.exists else (None, 0, 0, 0)
        rows = pd.concat(list(frames))
        rows = rows.assign(at=rows.ts.astype("datetime64[us]").astype("int64"), n=rows[tokens].fillna(0).astype("int64")).sort_values(["at", "n"], kind="stable")
        said = []
        for t, n in zip(rows["at"].tolist(), rows["n"].tolist(), strict=True):
            if t < until:
                said.append("cooldown")
                continue
            if start is None or t - start >= seconds * unit:
                start, requests, used = t, 0, 0
            if (requests_a_minute and requests >= requests_a_minute) or (tokens_a_minute and used + n > tokens_a_minute):
                until = t + max(1, seconds - (t - start) // unit) * unit
                said.append("limit")
            else:
                requests, used = requests + 1, used + n
                said.append("sent")
        state.update((start, requests, used, until))
        state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame({key: [k[0]] * len(rows), "ts": pd.to_datetime(rows["at"], unit="us"), "tokens": rows["n"], "decision": said})

    asked = df.select(key, "ts", tokens)
    return asked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, tokens bigint, decision string", "start bigint, requests bigint, used bigint, until bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


# The states of an ingestion in their order, with the progress that each stands for.
STATES = {"queued": 0, "extracting": 10, "processing": 40, "indexing": 80, "ready": 100, "failed": 100}


def ingestion_states(df: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """(key, status, progress, ended) of each key's furthest state: a stream may bring them in any order. Of ready and failed the later one counts; unknown states are ignored. An aggregate, which a stream updates."""
    known = F.create_map(*(F.lit(x) for pair in STATES.items() for x in pair))
    rows = _watermarked(df, late).withColumn("progress", F.try_element_at(known, "status")).where("progress IS NOT NULL")
    best = F.max(F.struct("progress", "ts", "status"))
    return rows.groupBy(key).agg(best.alias("b")).select(key, "b.status", "b.progress", (F.col("b.progress") == 100).alias("ended"))


def token_budget(df: DataFrame, key: str, tokens: str, requests_a_minute: int, tokens_a_minute: int) -> DataFrame:
    """Batch: with wait, whether a request would go beyond the key's requests or tokens of the minute up to it."""
    w = Window.partitionBy(key, "__slice").orderBy(F.unix_micros("ts")).rangeBetween(-59_999_999, 0)
    over = (F.count("*").over(w) > requests_a_minute) | (F.sum(tokens).over(w) > tokens_a_minute)
    return _sliced(df, 60).withColumn("wait", over).where("not __lead").drop("__slice", "__lead")
