"""Language ID by language-bitmask n-gram filters.

Each language has a Bloom filter of its frequent n-grams. The filters are
bit-sliced: slot i holds one bit of every language, so that the AND of an
n-gram's slots is the set of all languages that contain it. A text's hits are
counted per language, corrected for the filters' false positives, and the
largest share decides.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm import _text

UNKNOWN = "und"
GRAM, HASHES = 4, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Slots of a filter for each n-gram in it, at least; a power of two of slots in all.
SLOTS = 32
#: Rows of a language that are learned from in any case.
FEW = 32
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[[*range(65, 91), *range(97, 123)]] = [*range(97, 123)] * 2
_LETTERS[128:] = range(128, 256)


@dataclass(frozen=True)
class Model:
    """languages, those with the most training text first; slots: uint64 masks, a column per 64 languages; rates: each filter's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 4-byte grams (A-Z lower-cased, all but letters blank, no run of blanks alone) and each row's bounds among them."""
    x = _LETTERS[data].astype(np.uint32)
    if len(x) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    grams = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    keep = grams != 0x20202020
    for k in range(1, GRAM):
        over = offsets[1:-1] - k
        keep[over[(over >= 0) & (over < len(keep))]] = False
    total = np.concatenate([[0], np.cumsum(keep)])
    return grams[keep], total[np.minimum(offsets, len(keep))]


def _slots(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(grams * np.uint32(h)) >> np.uint32(32 - bits) for h in HASHES]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 20_000, rarest: int = 30_000, most_grams: int = 1 << 24) -> Model:
    """Learn from rows with a language, at most about max_docs of them: an even share of each language, those of the smallest id hashes (about FEW at least), and all rows of a language that has fewer.

    A language's filter holds the n-grams that make up 1/rarest of its n-grams or
    more: at most `rarest` n-grams each. With hundreds of languages the rarest are
    fewer and the filters shorter, so that at most about most_grams n-grams and as
    many bits by SLOTS reach the driver, however many languages there are.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    sizes = rows.groupBy("lang").count().orderBy("count", "lang").collect()
    rarest = max(1, min(rarest, most_grams // max(1, len(sizes))))
    bits = (SLOTS * rarest - 1).bit_length()
    if sum(r["count"] for r in sizes) > max_docs:
        below, left = [], max_docs
        for k, r in enumerate(sizes):  # what the smaller ones leave is the larger ones'
            share = min(r["count"], max(FEW, left // (len(sizes) - k)))
            left -= share
            below.append((r.lang, int((1 << 53) * share / r["count"])))
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below bigint")), "lang").where(F.shiftrightunsigned("h", 11) < F.col("below"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in _text.slices(batch.column(1)):
                grams, bounds = _grams(data, offsets)
                langs, which = np.unique(np.array(batch.column(0).slice(first, last - first).to_pylist(), object), return_inverse=True)
                pairs, counts = np.unique(np.repeat(which.astype(np.uint64), np.diff(bounds)) << np.uint64(32) | grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs[(pairs >> np.uint64(32)).astype(int)], pa.string()), pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    found = rows.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    totals = found.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lang").collect()
    kept = found.join(F.broadcast(docs.sparkSession.createDataFrame([(r.lang, r.total) for r in totals], "lang string, total bigint")), "lang").where(F.col("n") * rarest >= F.col("total")).select("lang", "gram").toPandas()
    found.unpersist()
    languages = [r.lang for r in totals]
    slots = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
    rates = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        mine = kept.gram[kept.lang == lang].to_numpy().astype(np.uint32)
        bit = np.uint64(1 << (k % 64))
        for s in _slots(mine, bits):
            slots[s, k // 64] |= bit
        rates[k] = np.mean((slots[:, k // 64] & bit) > 0) ** len(HASHES)
    return Model(languages, slots, rates)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row struct of docs, lang_pred, score, n_grams): one narrow pass over whole texts.

    score is the winner's corrected share of the text's n-grams, 0 to 1. Null texts
    and texts without a letter are `und` with score 0, as is every text if no
    language was learned. Ties, and letters without a known n-gram, go to the
    language with more training text. Repeated rows are each predicted.
    """
    bits = len(model.slots).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        slots = m.slots[:, 0].astype(np.uint8 if len(m.languages) <= 8 else np.uint64)[:, None] if m.slots.shape[1] == 1 else m.slots
        for batch in batches:
            best, share, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, last, data, offsets in _text.slices(batch.column(1)):
                grams, bounds = _grams(data, offsets)
                a, b, c = _slots(grams, bits)
                masks = slots[a] & slots[b] & slots[c]
                total[first:last] = np.diff(bounds)
                n = np.maximum(total[first:last], 1)
                shares = np.zeros((last - first, len(m.languages)))
                for k, rate in enumerate(m.rates):
                    hit = (masks[:, k // 64] >> masks.dtype.type(k % 64)) & masks.dtype.type(1)
                    hits = np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[bounds])
                    shares[:, k] = np.clip((hits / n - rate) / (1 - rate), 0, 1)
                best[first:last], share[first:last] = shares.argmax(1), shares.max(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(m.languages, object)[best], pa.string()), pa.array(share), pa.array(total)], ["given", "lang_pred", "score", "n_grams"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    given = docs.select(F.struct(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), letters).alias("given"), F.col(text_col).alias("text"))
    if not model.languages:
        return given.select("given.row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_grams"))
    out = given.mapInArrow(run, StructType([given.schema["given"]]).add("lang_pred", "string").add("score", "double").add("n_grams", "long"))
    return out.select("given.row", F.when(F.col("given.letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("given.letters"), F.col("score")).otherwise(0.0).alias("score"), "n_grams")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of docs, learned from the rows with crc32(id) mod 4 other than 2.

    A null id is neither learned from nor held out.
    """
    held_out = F.crc32(F.col(id_col).cast("string")) % 4 == 2
    model = fit(docs.where(~held_out), text_col, lang_col, id_col)
    out = predict(docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")), model)
    return out.select(F.col("row.id").alias(id_col), "row.held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.05) -> DataFrame:
    """The rows of docs, with all their columns, whose text has letters and enough of a language's n-grams.

    The share of known n-grams must reach min_score with one more counted in: of a
    long text that is the share, while a few n-grams cannot speak against a text.
    """
    columns = docs.columns
    model = fit(docs.where(~(F.crc32(F.col(id_col).cast("string")) % 4 == 2)), text_col, lang_col, id_col)
    enough = F.col("score") * F.col("n_grams") + 1 >= min_score * F.col("n_grams")
    return predict(docs, model, text_col).where((F.col("lang_pred") != UNKNOWN) & enough).select(*(F.col(f"row.`{c}`").alias(c) for c in columns))
