"""Quality classifier by importance resampling.

Two generative models of hashed word n-grams are counted: one of the target
(the labelled good texts), one of the raw corpus. A text's log weight is the sum
of log p_target / p_raw over its n-grams. Rows are drawn without replacement in
proportion to their weights: Gumbel noise is added to the log weights and the k
largest keys stay (Gumbel top-k).
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm import _text
from lectern.llm._shared import save

BUCKETS, ORDERS = 10_000, (1, 2)
#: Log weights are summed as whole millionths: sums are exact in any order, so that scoring again gives the same keys.
UNIT = 1e6


@dataclass(frozen=True)
class Model:
    """The log ratio of each n-gram bucket, in millionths; its size is fixed."""

    ratios: np.ndarray


def _grams(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, list[np.ndarray], list[np.ndarray]]]:
    """(first row, last row + 1, buckets of each order, bounds of each order)."""
    for first, last, data, offsets in _text.slices(column):
        words, bounds = _text.piece_hashes(data, offsets)
        found, ends = [], []
        for n in ORDERS:
            grams = (_text.gram_hashes(words, n) % np.uint64(buckets)).astype(np.int64)
            keep = np.ones(len(grams), bool)
            for b in range(1, n):  # n-grams that run over the end of a row
                over = bounds[1:-1] - b
                keep[over[(over >= 0) & (over < len(grams))]] = False
            total = np.concatenate([[0], np.cumsum(keep)])
            found.append(grams[keep])
            ends.append(total[np.minimum(bounds, len(grams))])
        yield first, last, found, ends


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_labels: int = 20_000) -> Model:
    """Count both models in one pass over all texts.

    labels has (id, target boolean). The target model is counted on at most
    max_labels labelled rows, those of the smallest id hashes; the raw model on
    every row. Only the counts of the fixed buckets reach the driver.
    """
    sample = labels.where("target").select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(max_labels)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample.withColumn("good", F.lit(True))), "id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, found, ends in _grams(batch.column(0), buckets):
                for grams, end in zip(found, ends, strict=True):
                    raw += np.bincount(grams, minlength=buckets)
                    chosen = np.repeat(good[first:last], np.diff(end))
                    target += np.bincount(grams[chosen], minlength=buckets)
        b = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(raw[b]), pa.array(target[b])], ["b", "raw", "target"])

    counts = rows.mapInArrow(count, "b bigint, raw bigint, target bigint").groupBy("b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(buckets), np.zeros(buckets)
    raw[counts.b] += counts.raw
    raw /= raw.sum()
    target[counts.b] += counts.target
    prior = min(buckets, target.sum() / 10)  # so many grams of the raw text as a prior: a bucket rarely seen says little
    target = (target + prior * raw) / (target.sum() + prior) if prior else raw
    return Model(np.rint(np.log(target / raw) * UNIT).astype(np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """(row struct of docs, n_grams, log_weight, gumbel_key): one narrow pass.

    Texts that are null, empty or blank have no n-grams: their weight and key are null.
    """
    buckets, sent = len(model.ratios), docs.sparkSession.sparkContext.broadcast(model.ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = sent.value
        for batch in batches:
            sums, counts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, last, found, ends in _grams(batch.column(1), buckets):
                for grams, end in zip(found, ends, strict=True):
                    total = np.concatenate([[0], np.cumsum(ratios[grams])])
                    sums[first:last] += np.diff(total[end])
                    counts[first:last] += np.diff(end)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(sums)], ["row", "n_grams", "units"])

    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    out = given.mapInArrow(run, StructType([given.schema["row"]]).add("n_grams", "long").add("units", "long"))
    weight = F.when(F.col("n_grams") > 0, F.col("units") / F.lit(UNIT))
    return out.select("row", "n_grams", weight.alias("log_weight"), (weight + _gumbel(F.col(f"row.`{id_col}`"), seed)).alias("gumbel_key"))


def _gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the key and the seed alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def kth_largest(values: DataFrame, col: str, k: int, bins: int = 4096, few: int = 10_000) -> float | None:
    """The k-th largest non-null value, exactly. Each pass counts equal bins of the range that holds it; at most `few` values or `bins` counts reach the driver."""
    v = values.select(F.col(col).alias("v")).where("v is not null")
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high and n > few:
        width = (high - low) / bins
        if low + width <= low:
            break
        inside = v.where((F.col("v") >= low) & (F.col("v") <= high))
        at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
        counts = {r.b: r for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b].n:
                low, high, n = counts[b].low, counts[b].high, counts[b].n
                break
            k -= counts[b].n
    if low == high:
        return low
    left = v.where((F.col("v") >= low) & (F.col("v") <= high))
    return left.orderBy(F.desc("v")).limit(k).agg(F.min("v")).first()[0] if n > few else sorted((r.v for r in left.collect()), reverse=True)[k - 1]


def threshold(scored: DataFrame, slack: float = 4.0, k: int | None = None) -> float | None:
    """The key of the last row that Gumbel top-k takes.

    A caller who wants a sample of a set size gives k. Without it k is the number
    of rows whose log weight is at least -slack: those that the target model
    explains nearly as well as the raw one. The raw model holds the good texts too,
    so that a short good text may weigh a little less than 0, and Gumbel noise is
    below -4 in one of 10**23 draws and above 4 in 2 % of them: a slack of 4 keeps
    the noise from drawing away texts above 0.
    """
    if k is None:
        k = scored.where(F.col("log_weight") >= -slack).count()
    return kth_largest(scored, "gumbel_key", k)


def _kept(tau: float | None) -> Column:
    return F.coalesce(F.col("gumbel_key") >= F.lit(tau), F.lit(False)) if tau is not None else F.lit(False)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", slack: float = 4.0, k: int | None = None) -> DataFrame:
    """(id, n_grams, log_weight, gumbel_key, kept) for every row of docs.

    Texts without n-grams (null, empty, blank) are not kept. Rows whose key equals
    the k-th are all kept, such as repeated rows. An empty table gives an empty one.
    """
    model = fit(docs, labels, id_col, text_col)
    scored = save(score(docs.select(id_col, text_col), model, id_col, text_col).select(F.col(f"row.`{id_col}`").alias(id_col), "n_grams", "log_weight", "gumbel_key"), "quality")
    return scored.withColumn("kept", _kept(threshold(scored, slack, k)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", slack: float = 4.0, k: int | None = None) -> DataFrame:
    """The rows of docs that classify() keeps, with all their columns. The texts are scored again rather than shuffled."""
    model = fit(docs, labels, id_col, text_col)
    keys = save(score(docs.select(id_col, text_col), model, id_col, text_col).select("log_weight", "gumbel_key"), "quality")
    return score(docs, model, id_col, text_col).where(_kept(threshold(keys, slack, k))).select("row.*")


def good_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, target) from the labels table: good quality and not toxic."""
    return labels.select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("target"))
