import hashlib
import math
import random

import pytest
from lectern.llm import centroids
from lectern.llm.queries import op12_centroid_clusters


def plain(rows, dims, k, rounds, seed=2):
    """The contract in plain Python, over (id, vector) rows."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centres)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == n]
            if own:
                centres[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted(((i, n, d, sum(e for _, e, m in found if m == n), total, hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert rows_of(op12_centroid_clusters(spark, sf)) == plain(rows, 64, 40, 5)


@pytest.mark.parametrize("seed", range(4))
def test_small_blocks_and_odd_shards(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(centroids, "PARTIALS", 16 * 7 * 3)
    rows = [(i if i % 9 else None, [r.choice((r.gauss(0, 1), 0.5, -3.0)) for _ in range(7)]) for i in range(150)]
    rows += rows[:20]  # repeated rows and ids
    rows += [(900, None), (901, []), (902, [0.0] * 6), (903, [None] * 7), (904, [math.nan] * 7), (905, [math.inf] + [0.0] * 6)]
    df = spark.createDataFrame([(*x, 1, "y", 0) for x in rows], "key long, v array<float>, block int, `a.b` string, id int").repartition(3)
    given = [(i, v if v is None else [None if x is None else float(x) for x in v]) for i, v, *_ in df.collect()]
    got = centroids.cluster(df, "key", "v", dims=7, k=5, rounds=3, width=3)
    assert got.columns[0] == "key"
    assert rows_of(got) == plain(given, 7, 5, 3)


def test_fewer_vectors_than_centroids_large_components_and_empty_tables(spark):
    some = spark.createDataFrame([(1, [1e6, -1e6]), (2, [1e6, -1e6]), (3, [-250000.25, 3.0])], "vec_id long, embedding array<double>")
    assert rows_of(centroids.cluster(some, dims=2, width=1)) == plain([tuple(r) for r in some.collect()], 2, 40, 5)
    for none in (some.limit(0), some.where("vec_id = 1").selectExpr("vec_id", "array(1D) AS embedding")):
        assert centroids.cluster(none, dims=2).count() == 0
    huge = spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(huge, dims=2)
