import zlib

import numpy as np
import public_tokenizers as P
import pytest
from lectern.llm import packing
from tokenizers import Tokenizer


def check(rows, capacity):
    """No gap or overlap in any sequence."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def expand(runs):
    return [type("R", (), {"sequence_id": seq + k, "offset": off, "length": length}) for length, _, seq, off, n in runs for k in range(n)]


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_close_to_the_least(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, [1025, 400, 60][seed % 3], 3000)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True), strict=True)}
    runs = packing.plan(histogram)
    placed = {}
    for length, rank, _, _, n in runs:
        assert rank == placed.get(length, 0)
        placed[length] = rank + n
    assert placed == histogram
    assert check(expand(runs.tolist()), 1024) <= 1.03 * np.ceil(sizes.sum() / 1024) + 1


def test_large_items_pair_at_most_twice():
    runs = packing.plan({342: 6, 600: 2, 424: 2})
    per = {}
    for length, _, seq, _, n in runs.tolist():
        for k in range(n):
            per.setdefault(seq + k, []).append(length)
    assert all(sum(3 * x > 1024 for x in v) <= 2 for v in per.values())
    assert sorted(map(sorted, per.values())) == sorted([[424, 600], [424, 600], [342, 342], [342, 342], [342, 342]])


def test_bad_lengths():
    with pytest.raises(ValueError):
        packing.plan({2000: 1})
    assert len(packing.plan({})) == 0


def test_pack(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, ""), (-2, None), (None, "a b"), (-3, "same text"), (-3, "same text")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    rows = packing.pack(docs).collect()
    used = check(rows, 1024)
    assert used <= 1.02 * sum(r.length for r in rows) / 1024 + 2
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for d in docs.collect():
        ids = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want.append((str(d.doc_id), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packing.pack(docs.limit(0)).count() == 0
