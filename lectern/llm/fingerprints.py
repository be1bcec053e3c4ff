"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is a non-blank line. Its vector has two parts: EQUAL 64-bit lanes,
the paragraph's BLAKE2b digest, and LIKE 32-bit lanes, signed counts of its
hashed three-word runs. A text's fingerprint is the sum of its paragraphs'
vectors, each lane modulo its power of two. So the order of paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its
vector. Equal fingerprints mean equal multisets of paragraphs; the second part
also tells how alike two different ones are.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import _text

EQUAL, LIKE, RUN = 8, 64, 3


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n x EQUAL of uint64, n x LIKE of uint32): the sums over each text's paragraphs; 0 for an empty text."""
    equal, like = np.zeros((len(texts), EQUAL), np.uint64), np.zeros((len(texts), LIKE), np.int64)
    paragraphs, owner = [], []
    for i, text in enumerate(texts):
        for line in text.split("\n"):
            if line and not line.isspace():
                paragraphs.append(line.encode())
                owner.append(i)
    if not paragraphs:
        return equal, like.astype(np.uint32)
    digests = np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=8 * EQUAL).digest() for p in paragraphs]), "<u8").reshape(-1, EQUAL)
    owners = np.array(owner)
    firsts = np.flatnonzero(np.diff(owners, prepend=-1))
    equal[owners[firsts]] = np.add.reduceat(digests, firsts, axis=0)
    for first, last, data, offsets in _text.slices(pa.array(paragraphs, pa.large_binary())):
        words, bounds = _text.word_hashes(data, offsets)
        hashes, of = _text.gram_hashes(words, RUN), np.searchsorted(bounds, np.arange(max(0, len(words) - RUN + 1)), "right") - 1
        inside = np.arange(len(hashes)) + RUN <= bounds[of + 1]
        few = np.flatnonzero((np.diff(bounds) < RUN) & (np.diff(bounds) > 0))
        small = [_text.gram_hashes(words[bounds[k] : bounds[k + 1]], bounds[k + 1] - bounds[k]) for k in few]
        hashes, of = np.concatenate([hashes[inside], *small]), np.concatenate([of[inside], few])
        lane = owners[first:last][of] * LIKE + (hashes & np.uint64(LIKE - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * ((hashes >> np.uint64(40)) & np.uint64(1)).astype(float)
        low = int(owners[first]) * LIKE
        sums = np.bincount(lane - low, sign, (int(owners[last - 1]) + 1) * LIKE - low)
        like[int(owners[first]) : int(owners[last - 1]) + 1] += sums.reshape(-1, LIKE).astype(np.int64)
    return equal, like.astype(np.uint32)


def add(a: tuple, b: tuple) -> tuple:
    """The fingerprint of both texts' paragraphs together."""
    return a[0] + b[0], a[1] + b[1]


def subtract(a: tuple, b: tuple) -> tuple:
    """The fingerprint of a without the paragraphs of b."""
    return a[0] - b[0], a[1] - b[1]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the LIKE lanes of two batches, row by row: 1 - |a - b|^2 / (|a|^2 + |b|^2), at least 0; 1 for two empty ones."""
    x, y = a.astype(np.int32).astype(float), b.astype(np.int32).astype(float)
    apart, both = ((x - y) ** 2).sum(1), (x**2).sum(1) + (y**2).sum(1)
    return np.where(both > 0, np.clip(1 - apart / np.maximum(both, 1), 0, 1), 1.0)


def as_text(v: tuple) -> list[str]:
    return [a.astype("<u8").tobytes().hex() + b.astype("<u4").tobytes().hex() for a, b in zip(*v, strict=True)]


def from_text(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = [bytes.fromhex(t) for t in texts]
    return np.array([np.frombuffer(r[: 8 * EQUAL], "<u8") for r in rows]), np.array([np.frombuffer(r[8 * EQUAL :], "<u4") for r in rows])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex) for every row; null and empty texts have the fingerprint of nothing, all zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(as_text(vectors(texts)), pa.string())], ["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 1024, max_buckets: int = 1 << 16) -> DataFrame:
    """(id, text, next_text) with the text of the next row by id; after the last comes the first.

    Ids are cut into ranges of about bucket_rows rows at ids that occur; a range's
    first rows also go to the range before, so that the texts are shuffled once and
    no range needs another. Null ids come first; equal ids are ordered by text. Ids
    are whole numbers; the rows of one id, or without one, are in one range.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, nulls, low = rows.agg(F.count("*"), F.count_if(F.col("id").isNull()), F.min("id")).first()
    buckets = min(max_buckets, -(-n // bucket_rows))
    cuts = np.zeros(0, np.int64)

    def bucket(cuts: np.ndarray) -> Column:
        @F.arrow_udf("int")
        def of(ids: pa.Array) -> pa.Array:  # the ids alone go to Python; a null is below all cuts
            return pa.array(np.searchsorted(cuts, ids.fill_null(-(1 << 63)).to_numpy(), "right").astype(np.int32))

        return of("id")

    @F.arrow_udf("boolean")
    def is_cut(ids: pa.Array) -> pa.Array:
        return pa.array(np.isin(ids.fill_null(-(1 << 63)).to_numpy(), cuts) & ids.is_valid().to_numpy(zero_copy_only=False))

    if buckets > 1:
        near = rows.agg(F.percentile_approx("id", [k / buckets for k in range(1, buckets)], max(10_000, 10 * buckets))).first()[0] or []
        # rounded as doubles: the ranges' first ids that occur are the cuts
        firsts = rows.where("id is not null").groupBy(bucket(np.unique(np.array(near, np.int64)))).agg(F.min("id").alias("id")).collect()
        cuts = np.unique(np.array([r.id for r in firsts if r.id > low], np.int64))
    last = len(cuts)
    b = F.col("bucket")
    first = F.col("id").isNull() if nulls else F.col("id") == low
    before = F.when(first, last).when(F.col("is_cut"), b - 1)
    own = F.struct(b.alias("bucket"), F.lit(False).alias("sentinel"))
    places = F.when(before.isNull(), F.array(own)).otherwise(F.array(own, F.struct(before.alias("bucket"), F.lit(True).alias("sentinel"))))
    dealt = rows.withColumns({"bucket": bucket(cuts), "is_cut": is_cut("id")}).select("id", "text", F.inline(places))
    order = Window.partitionBy("bucket").orderBy("sentinel", F.asc_nulls_first("id"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).where("not sentinel").select("id", "text", "next_text").withColumnRenamed("id", id_col)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next text by id, null ids first. Null texts are
    empty. A lone row is its own next. Repeated rows each give a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, texts, nexts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
                edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, nexts, strict=True)]
                mine, changed = vectors(texts), vectors(edited)
                known = [i + 1 if i + 1 < len(texts) and nexts[i] == texts[i + 1] else -1 for i in range(len(texts))]
                other = [i for i, k in enumerate(known) if k < 0]
                following = mine[1][known]
                following[other] = vectors([nexts[i] for i in other])[1]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(as_text(mine)), pa.array(as_text(changed)), pa.array(likeness(mine[1], changed[1])), pa.array(likeness(mine[1], following))],
                    ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return with_next_text(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)
