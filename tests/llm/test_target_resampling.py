import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from lectern.llm import target_resampling as tr
from lectern.llm.queries import op13_target_resampling

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, orders):
    words = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return len(words), [b" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, orders=1, buckets=10_000, least=20, percent=10, seed=2024):
    def count(texts):
        return Counter(zlib.crc32(f) % buckets for t in texts for f in features(t, orders)[1])

    s, t = count(x for _, x in docs), count(target)
    S, T = sum(s.values()), sum(t.values())
    out, able = [], []
    for k, (key, text) in enumerate(docs):
        n_words, found = features(text, orders)
        weight = 0
        for f in found:
            b = zlib.crc32(f) % buckets
            weight += math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n_words >= least:
            able.append(k)
    able.sort(key=lambda k: (-out[k][3], out[k][0] is not None, out[k][0] or 0))
    for r, k in enumerate(able[: len(able) * percent // 100]):
        out[k][4] = r + 1
    return sorted(map(tuple, out), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_crcs_of_spans_and_of_joined_texts():
    r = random.Random(3)
    data = bytes(r.randrange(256) for _ in range(3000))
    a = np.array([r.randrange(2900) for _ in range(400)])
    b = a + np.array([r.choice((0, 1, 2, 7, 8, 30, 64, 65, 66, 90)) for _ in a])
    got = tr.crcs(np.frombuffer(data, np.uint8), a, b)
    assert got.tolist() == [zlib.crc32(data[x:y]) for x, y in zip(a, b, strict=True)]
    both = tr.joined(got, got[::-1], (b - a)[::-1])
    assert both.tolist() == [zlib.crc32(data[x:y] + data[u:v]) for (x, y), (u, v) in zip(zip(a, b, strict=True), zip(a[::-1], b[::-1], strict=True), strict=True)]


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op13_target_resampling(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == plain(docs, target)


@pytest.mark.parametrize(("orders", "head", "pairs"), [(1, 3, 2), (2, 5, 4), (2, 1 << 14, 1 << 15), (3, 6, 5), (3, 0, 0)])
def test_head_and_tail_give_the_same(spark, orders, head, pairs):
    r = random.Random(orders)
    some = ["Ab", "c", "été", "a1", "x" * 16, "y" * 17, "z" * 80, "日本", "Σ"]
    docs = [(i, "".join(r.choice(some) + r.choice((" ", "-", "\n", "_")) for _ in range(r.randint(0, 40)))) for i in range(80)]
    docs += docs[:10] + [(200, None), (201, ""), (202, " - "), (None, "ab " * 30), (None, None), (203, "word " * 100_000)]
    target = ["ab c été", None, "x y", "été " * 5]
    given = spark.createDataFrame([(*x, 1, "n") for x in docs], "key long, body string, weight int, `a.b` string").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "body string")
    got = tr.resample(given, wanted, "key", "body", orders=orders, buckets=50, min_words=5, percent=30, head=head, pairs=pairs)
    assert rows_of(got) == plain(docs, target, orders, 50, 5, 30)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    assert tr.resample(none, some).count() == 0
    assert rows_of(tr.resample(some, none)) == plain([(1, "a b"), (2, "c")], [])


def test_buckets_of_rows_without_words():
    column = pa.array([None, "", "--", "a b", None, "c"])
    ((_, _, words),) = tr.words_of(column)
    none = np.zeros(0, np.int64)
    head = tr.Head(none.view(np.uint64), none.view(np.uint64), none.astype(np.uint32), none, none, none)
    one, two = tr.buckets_of(words, head, head.slots(), 2, 1000)
    assert np.diff(one[1]).tolist() == [0, 0, 0, 2, 0, 1] and np.diff(two[1]).tolist() == [0, 0, 0, 1, 0, 0]
    assert two[0].tolist() == [zlib.crc32(b"a b") % 1000]
