"""The corpus pipeline: documents to packed training sequences, in stages that each call one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's docs. All but the last return the columns of
documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language_id, minhash_dedup, packing, quality, secret_scan
from lectern.llm._shared import discard, save, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rows that importance resampling rejects go."""
    return quality.keep_good(docs, quality.good_labels(table(spark, sf_dir, "labels")))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rows in no learned language go. The languages are learned from docs."""
    return language_id.keep_identified(docs)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group the document of the smallest id stays."""
    return minhash_dedup.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: the spans found are masked, and n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of the texts' tokens."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("language", keep_identified), ("near-dedup", keep_one), ("secrets", mask_secrets), ("packing", pack)]

#: No stage but the secret scan can be written in SQL: the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is removed when the next one's is written; the result is read from what pack() wrote."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(docs)
    return out
