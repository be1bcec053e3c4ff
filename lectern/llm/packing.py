"""Best-fit packing of token sequences with large-item matching.

Lengths are whole numbers up to the capacity, so the packing is planned on their
histogram, whose size is fixed. Pieces above a third of the capacity share a
sequence with at most one other such piece, by greedy matching from the longest;
shorter ones then go, longest first, to the smallest gap that holds them. The
plan is a list of runs (length, first rank, sequence, offset); each piece takes
its place by its rank among the pieces of its length.
"""

import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import tokens
from lectern.llm._shared import save

CAPACITY, END_ID = 1024, 2


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, n): n pieces of that length go to as many sequences in turn.

    Rows are ordered by length and rank. Work and size depend on the number of
    distinct lengths and gaps, not on the number of pieces.
    """
    left = {s: n for s, n in histogram.items() if n}
    if bad := [s for s in left if not 1 <= s <= capacity]:
        raise ValueError(f"lengths beyond 1 to {capacity}: {bad[:5]}")
    rank, runs, sequences = defaultdict(int), [], 0
    gaps: dict[int, deque] = defaultdict(deque)  # gap -> runs of sequences [first, n] with that much room
    open_gaps: list[int] = []

    def place(length: int, first: int, n: int, room: int) -> None:
        runs.append((length, rank[length], first, capacity - room, n))
        rank[length] += n
        left[length] -= n
        if gap := room - length:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for s in reversed(large):
        while left[s]:
            mate = next((m for m in reversed(large[: bisect_left(large, min(s, capacity - s) + 1)]) if left[m] > (m == s)), None)
            n = left[s] if mate is None else min(left[s] // 2, left[s]) if mate == s else min(left[s], left[mate])
            first, sequences = sequences, sequences + n
            runs.append((s, rank[s], first, 0, n))
            rank[s] += n
            left[s] -= n
            if mate is not None:
                place(mate, first, n, capacity - s)
            elif s < capacity:
                if not gaps[capacity - s]:
                    insort(open_gaps, capacity - s)
                gaps[capacity - s].append((first, n))
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(open_gaps, s)
            if k == len(open_gaps):  # no gap: open as many sequences as these pieces fill
                n = -(-left[s] // (capacity // s))
                gaps[capacity].append((sequences, n))
                insort(open_gaps, capacity)
                sequences += n
                k = len(open_gaps) - 1
            gap = open_gaps[k]
            first, n = gaps[gap].popleft()
            take = min(n, left[s])
            if take < n:
                gaps[gap].appendleft((first + take, n - take))
            if not gaps[gap]:
                open_gaps.remove(gap)
            place(s, first, take, gap)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and end_id, cut into pieces of the capacity if longer; the first may be shorter.

    A null or empty text is the end id alone.
    """
    path = path or public_tokenizers.path(tokens.COUNT_VOCABULARY)

    def cut(text: str) -> Iterator[tuple[int, int, int, int]]:
        held = array("I")  # four bytes an id, no more than the text
        for part in tokens.library_ids(text, path):
            held.extend(part)
        held.append(end_id)
        raw, n, start, k = memoryview(np.frombuffer(held, np.uint32).astype("<u4", copy=False)).cast("B"), len(held), 0, 0
        while start < n:
            end = n - (n - start - 1) // capacity * capacity
            yield k, start, end - start, zlib.crc32(raw[4 * start : 4 * end])
            start, k = end, k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for i, t in enumerate(batch.column(1)):
                rows += (found := list(cut(t.as_py() or "")))
                of += [i] * len(found)
            k, start, length, crc = np.array(rows, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def assign(items: DataFrame, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY, salts: int = 512) -> DataFrame:
    """items with sequence_id and offset. items is read twice and should be a written table.

    The ranks within a length are counted within salts of the rows' hash and then
    shifted by the counts of the salts before, so that a length that a third of all
    rows have is not ranked by one task.
    """
    n = items.count()
    salts = max(salts, n >> 17)
    salted = items.withColumn("__salt", F.pmod(F.xxhash64(*order_cols), F.lit(salts)).cast("int"))
    counts = salted.groupBy("__salt", length_col).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(length_col).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("__salt", length_col).orderBy(*order_cols)) - 1)
    histogram = {r[0]: r[1] for r in items.groupBy(length_col).count().collect()}  # at most one row for each length up to the capacity
    runs = items.sparkSession.sparkContext.broadcast(plan(histogram, capacity))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length, rank):
        import pandas as pd

        r = runs.value
        key = (r[:, 0] << 44) | r[:, 1]
        k = np.searchsorted(key, (length.to_numpy() << 44) | rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": r[k, 2] + rank.to_numpy() - r[k, 1], "offset": r[k, 3]})

    joined = ranked.join(before, ["__salt", length_col]).withColumn("__at", place(F.col(length_col), F.col("__rank") + F.coalesce("__before", F.lit(0))))
    return joined.select(*items.columns, "__at.sequence_id", "__at.offset")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): a row for each piece of each row of docs.

    Null and empty texts give a piece of length 1; repeated rows and null ids are
    packed like others; an empty table gives an empty one.
    """
    return assign(save(pieces(docs, id_col, text_col, path, capacity), "pieces"), "length", (id_col, "piece"), capacity)
