"""Importance resampling towards a target by exact hashed features, with a head-tail vocabulary.

A feature is a run of consecutive words; its bucket is the CRC-32 of its bytes.
The most frequent words are the head: their CRC states are broadcast, and for
runs of two the buckets of the most frequent head pairs. A word or pair that is
not there gets its CRC directly. Both ways give the same buckets, so that the
head's choice changes nothing but the time.

A run's CRC follows from its words': appending n bytes to a text multiplies its
state by the matrix of n zero bytes and adds the CRC of what is appended.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import _text
from lectern.llm._shared import discard, save

BUCKETS, HEAD, PAIRS = 10_000, 1 << 14, 1 << 15
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The longest word of the head, in bytes: two 64-bit lanes hold it, so that looking it up compares it whole. No word has a zero byte.
LANES = 16
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def _zero_matrices(bits: int = 40) -> np.ndarray:
    """For each k, as tables of four bytes x 256: what 2**k zero bytes do to a CRC's state."""
    one = np.arange(256, dtype=np.uint32)
    step = np.stack([one << np.uint32(8 * b) for b in range(4)])
    out = [_CRC[step & 0xFF] ^ (step >> np.uint32(8))]
    for _ in range(bits - 1):
        out.append(_apply(out[-1], out[-1]))
    return np.stack(out)


def _apply(matrix: np.ndarray, state: np.ndarray) -> np.ndarray:
    return matrix[0][state & 0xFF] ^ matrix[1][(state >> np.uint32(8)) & 0xFF] ^ matrix[2][(state >> np.uint32(16)) & 0xFF] ^ matrix[3][state >> np.uint32(24)]


_ZEROS = _zero_matrices()
_BLANK = np.uint32(zlib.crc32(b" "))


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes. All spans go on by a byte at a time, the longest first; a span of over 64 bytes by itself."""
    length, out = end - start, np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(length, 65), kind="stable")
    ordered = np.minimum(length, 65)[order]
    long = int(np.searchsorted(-ordered, -64, "left")) if len(order) else 0
    for i in order[:long].tolist():
        out[i] = ~np.uint32(zlib.crc32(data[start[i] : end[i]].tobytes()))
    order = order[long:]
    at, state, ordered = start[order], out[order], ordered[long:]
    for k in range(int(ordered[0]) if len(ordered) else 0):
        n = int(np.searchsorted(-ordered, -k, "left"))  # spans of more than k bytes
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out[order] = state
    return ~out


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of one text put after another, from the CRCs of both and the second's length in bytes."""
    out, k = left.copy(), 0
    while (length >> k).any():
        on = (length >> k & 1).astype(bool)
        out[on] = _apply(_ZEROS[k], out[on])
        k += 1
    return out ^ right


@dataclass(frozen=True)
class Words:
    """The words of some rows: lower-cased bytes, places, and the bounds of each row's words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def lanes(self) -> tuple[np.ndarray, np.ndarray]:
        """The first 8 and the next 8 bytes of each word as numbers; a word of over LANES bytes gives (0, 0)."""
        padded = np.concatenate([self.data, np.zeros(LANES, np.uint8)])
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        n = self.end - self.start
        low = eight[self.start] & _LOW[np.minimum(n, 8)]
        high = eight[self.start + 8] & _LOW[np.clip(n - 8, 0, 8)]
        fits = n <= LANES
        return np.where(fits, low, np.uint64(0)), np.where(fits, high, np.uint64(0))


def words_of(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) for runs of rows of about a megabyte, or one longer row."""
    for first, last, data, offsets in _text.slices(column):
        data = _LOWER[data]
        start, end, bounds = _text.spans_of(_WORD[data], offsets)
        yield first, last, Words(data, start, end, bounds)


@dataclass(frozen=True)
class Head:
    """Frequent words, ordered by their lanes, with their CRCs, and buckets of frequent pairs of them; no more than HEAD and PAIRS."""

    low: np.ndarray
    high: np.ndarray
    crc: np.ndarray
    length: np.ndarray
    pairs: np.ndarray
    pair_buckets: np.ndarray

    def slots(self) -> np.ndarray:
        """A table of 4 * HEAD or more places by hash: the word in each place, or -1. Of words with one hash, the first in order stays and the others are found directly."""
        out = np.full(max(16, 1 << (4 * len(self.low)).bit_length()), -1, np.int64)
        place = self.place(self.low, self.high, len(out))
        out[place[::-1]] = np.arange(len(place))[::-1]
        return out

    @staticmethod
    def place(low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
        return (_text.mix(low + high * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(size - 1)).astype(np.int64)

    def find(self, slots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Each word's number in the head, or -1."""
        if not len(self.low):
            return np.full(len(low), -1)
        at = slots[self.place(low, high, len(slots))]
        return np.where((at >= 0) & (self.low[at] == low) & (self.high[at] == high), at, -1)


def buckets_of(words: Words, head: Head, slots: np.ndarray, orders: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... words: (bucket of each run, bounds of each row's runs)."""
    at = head.find(slots, *words.lanes())
    tail = np.flatnonzero(at < 0)
    crc, length = np.zeros(len(at), np.uint32), words.end - words.start
    known = at >= 0
    crc[known] = head.crc[at[known]]
    crc[tail] = crcs(words.data, words.start[tail], words.end[tail])
    yield (crc % np.uint32(buckets)).astype(np.int64), words.bounds
    row = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    run = crc
    for n in range(2, orders + 1):
        if len(run) < 2:
            run = run[:0]
            yield np.zeros(0, np.int64), np.zeros(len(words.bounds), np.int64)
            continue
        inside = row[n - 1 :] == row[: len(row) - n + 1]
        out = np.zeros(len(row) - n + 1, np.int64)
        direct = inside.copy()
        if n == 2 and len(head.pairs):
            key = at[:-1] << 32 | at[1:]
            place = np.minimum(np.searchsorted(head.pairs, key), len(head.pairs) - 1)
            hit = inside & (at[:-1] >= 0) & (at[1:] >= 0) & (head.pairs[place] == key)
            out[hit] = head.pair_buckets[place[hit]]
            direct = inside & ~hit if orders == 2 else inside
        longer = np.zeros(len(out), np.uint32)
        i = np.flatnonzero(direct)
        with_blank = joined(run[:-1][i], np.full(len(i), _BLANK, np.uint32), np.ones(len(i), np.int64))
        longer[i] = joined(with_blank, crc[n - 1 :][i], length[n - 1 :][i])
        out[direct] = longer[direct] % np.uint32(buckets)
        run = longer
        total = np.concatenate([[0], np.cumsum(inside)])
        yield out[inside], total[np.minimum(words.bounds, len(inside))]


def _top(counts: DataFrame, most: int) -> list:
    """Keys seen more than once, the most frequent ones, as many as whole bins of the logarithm of the count hold without passing `most`: so many rows and one a bin reach the driver. The choice changes no result."""
    keys = [c for c in counts.columns if c != "n"]
    total = save(counts.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 1").withColumn("bin", F.floor(F.log2("n") * 64)), "counts")
    rows, least = 0, None
    for r in sorted(total.groupBy("bin").agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["bin"]):
        if (rows := rows + r.rows) > most:
            break
        least = r["bin"]
    found = total.where(F.col("bin") >= least).collect() if least is not None else []
    discard(total)
    return found


def head_of(texts: DataFrame, orders: int = 1, buckets: int = BUCKETS, size: int = HEAD, pairs: int = PAIRS) -> Head:
    """The head of one text column: a pass for the words and, for runs of two, one for the pairs. A task adds its counts up and sends the `size` most frequent words on; only `size` words reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)

        def packed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))[: len(keys)])
            return keys[first], np.add.reduceat(n, first) if len(first) else n[:0]

        for batch in batches:
            for _, _, words in words_of(batch.column(0)):
                lanes = np.stack(words.lanes(), 1)
                more, counts = packed(lanes[lanes[:, 0] > 0], np.ones(int((lanes[:, 0] > 0).sum()), np.int64))
                keys, n = packed(np.concatenate([keys, more]), np.concatenate([n, counts]))
                if len(n) > 16 * size:  # what a task holds is bounded
                    most = np.argsort(-n, kind="stable")[: 4 * size]
                    keys, n = keys[most], n[most]
        most = np.argsort(-n, kind="stable")[:size]
        yield pa.RecordBatch.from_arrays([pa.array(keys[most, 0].view(np.int64)), pa.array(keys[most, 1].view(np.int64)), pa.array(n[most])], ["low", "high", "n"])

    found = _top(texts.mapInArrow(count, "low bigint, high bigint, n bigint"), size)
    low, high = (np.array([r[c] for r in found], np.int64).view(np.uint64) for c in ("low", "high"))
    data = np.stack([low.astype("<u8"), high.astype("<u8")], 1).view(np.uint8).reshape(len(low), LANES) if len(low) else np.zeros((0, LANES), np.uint8)
    length = (data > 0).sum(1).astype(np.int64)
    start = np.arange(len(low)) * LANES
    none = np.zeros(0, np.int64)
    head = Head(low, high, crcs(data.ravel(), start, start + length), length, none, none)
    if orders < 2 or not len(low):
        return head
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, keys, n = sent.value, none, none
        slots = head.slots()
        for batch in batches:
            for _, _, words in words_of(batch.column(0)):
                at, row = head.find(slots, *words.lanes()), np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
                both = (at[:-1] >= 0) & (at[1:] >= 0) & (row[:-1] == row[1:])
                keys, where = np.unique(np.concatenate([keys, (at[:-1] << 32 | at[1:])[both]]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n, np.ones(int(both.sum()), np.int64)]), len(keys)).astype(np.int64)
                if len(n) > 16 * pairs:
                    most = np.sort(np.argsort(-n, kind="stable")[: 4 * pairs])
                    keys, n = keys[most], n[most]
        most = np.argsort(-n, kind="stable")[:pairs]
        yield pa.RecordBatch.from_arrays([pa.array(keys[most]), pa.array(n[most])], ["pair", "n"])

    keys = np.array(sorted(r.pair for r in _top(texts.mapInArrow(count_pairs, "pair bigint, n bigint"), pairs)), np.int64)
    a, b = keys >> 32, keys & 0xFFFFFFFF
    one = np.ones(len(keys), np.int64)
    made = joined(joined(head.crc[a], np.full(len(keys), _BLANK, np.uint32), one), head.crc[b], length[b]) if len(keys) else np.zeros(0, np.uint32)
    return Head(low, high, head.crc, length, keys, (made % np.uint32(buckets)).astype(np.int64))


def bucket_totals(texts: DataFrame, head: Head, orders: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. One row a bucket reaches the driver."""
    sent = texts.sparkSession.sparkContext.broadcast(head)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slots = np.zeros(buckets, np.int64), sent.value.slots()
        for batch in batches:
            for _, _, words in words_of(batch.column(0)):
                for found, _ in buckets_of(words, sent.value, slots, orders, buckets):
                    total += np.bincount(found, minlength=buckets)
        b = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(total[b])], ["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, floor(1000 * ln of the target's share over the raw text's), both with one more feature a bucket."""
    n, s, t = len(raw), raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weights(docs: DataFrame, head: Head, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) for every row, in one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast((head, gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gain = sent.value
        slots = head.slots()
        for batch in batches:
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, last, words in words_of(batch.column(1)):
                n_words[first:last] = np.diff(words.bounds)
                for found, bounds in buckets_of(words, head, slots, orders, len(gain)):
                    n[first:last] += np.diff(bounds)
                    total[first:last] += np.diff(np.concatenate([[0], np.cumsum(gain[found])])[bounds])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n), pa.array(total)], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def _noise(key: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the first 8 hex digits of sha256(`seed:id`), a null id as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: int = 1, buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: int = 2024, head: int = HEAD, pairs: int = PAIRS) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of docs.

    target has a column of the same name with the target's texts. Of the rows with
    at least min_words words the best percent by score (weight and Gumbel noise) are
    drawn; rank is their place, ties going to the smaller id, and null for all
    others. Null and empty texts have no features and weight 0. A null id has the
    noise of an empty one and comes first among ties, as do repeated rows side by
    side, each with a rank of its own. Empty tables give empty results; without
    target texts all shares are those of one feature a bucket. Only the named
    columns are read.
    """
    texts, wanted = docs.select(F.col(f"`{text_col}`").alias("text")), target.select(F.col(f"`{text_col}`").alias("text"))
    known = head_of(texts, orders, buckets, head, pairs)
    gain = gains(bucket_totals(texts, known, orders, buckets), bucket_totals(wanted, known, orders, buckets))
    score = (F.col("weight") + _noise(F.col("id"), seed)).alias("score")
    scored = save(weights(docs, known, gain, id_col, text_col, orders).select("id", "n_words", "n_features", "weight", score), "weights")
    able = F.col("n_words") >= min_words
    n = scored.where(able).count() * percent // 100
    named = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    out = ["id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not n:
        return scored.select(*named, none)
    order = [F.desc("score"), F.asc_nulls_first("id")]
    # Sorted into ranges and written: a range's rows are numbered after those of the ranges before it.
    sorted_ = save(scored.where(able).repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id()).select(*out, "part"), "ranges")
    parts = sorted_.groupBy("part").agg(F.count("*").alias("rows"))
    starts = {}
    before = 0
    for r in sorted(parts.collect(), key=lambda r: r.part):  # one row a range
        starts[r.part] = before
        before += r.rows
    start = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("part"))
    place = (F.row_number().over(Window.partitionBy("part").orderBy(*order)) + start).cast("long")
    last = max(p for p, s in starts.items() if s < n)
    drawn = sorted_.where(F.col("part") <= last).select(*out, place.alias("rank")).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    rest = sorted_.where(F.col("part") > last).select(*out, none).unionByName(scored.where(~able).select(*out, none))
    return drawn.unionByName(rest).select(*named, "rank")
