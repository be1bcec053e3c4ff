import re
from collections import Counter

import numpy as np
import pytest
from lectern.llm import quality


@pytest.fixture(scope="module")
def rows(spark):
    good = [(i, f"the cat sat on mat number {'one two three'.split()[i % 3]} and slept well today", "g") for i in range(60)]
    bad = [(100 + i, "### $$$ buy%%% now&&& | | | " * 3, "b") for i in range(20)]
    return spark.createDataFrame([*good, *bad, (200, None, "x"), (201, "", "x"), (202, "  \n", "x"), (None, "the cat sat on", "x"), (5, good[5][1], "x")], "doc_id long, text string, log_weight string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, True) for i in range(0, 60, 2)] + [(i, False) for i in range(100, 110)], "doc_id long, target boolean")


def test_classify(spark, rows, labels):
    got = quality.classify(rows, labels).collect()
    assert len(got) == rows.count()
    kept = Counter(r.doc_id for r in got if r.kept)
    assert set(range(60)) <= set(kept) and kept[5] == 2 and None in kept
    assert not any(100 <= (r.doc_id or 0) for r in got if r.kept)
    assert all(r.log_weight is None and not r.kept for r in got if r.doc_id in (200, 201, 202))
    stay = quality.keep_good(rows, labels)
    assert stay.columns == rows.columns
    assert Counter(r.doc_id for r in stay.collect()) == kept
    assert quality.classify(rows.limit(0), labels).count() == 0
    assert quality.classify(rows, labels.limit(0)).count() == rows.count()


def test_weights_are_log_ratios_of_the_two_models(spark, rows, labels):
    model = quality.fit(rows, labels)
    few = rows.where("doc_id < 10")
    got = {(r.row.doc_id, r.row.text): r.log_weight for r in quality.score(few, model).collect()}
    from lectern.llm import _text

    for (_, text), weight in got.items():
        raw = np.frombuffer(text.encode(), np.uint8)
        words, _ = _text.piece_hashes(raw, np.array([0, len(raw)]))
        assert len(words) == len(re.findall(r"\w+|[^\w\s]+", text))
        want = sum(model.ratios[(_text.gram_hashes(words, n) % np.uint64(quality.BUCKETS)).astype(int)].sum() for n in quality.ORDERS) / quality.UNIT
        assert abs(want - weight) < 1e-6


def test_models_against_plain_counts(spark):
    """Both models counted again, gram by gram, over whole texts."""
    from lectern.llm import _text

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "a b c")], "doc_id long, text string"))
    labels = quality.good_labels(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    good = {r.doc_id for r in labels.where("target").collect()}
    raw, target = np.ones(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for r in docs.collect():
        pieces = [m[0].encode().lower() for m in re.finditer(r"[0-9A-Za-z_\u0080-\U0010ffff]+|[^0-9A-Za-z_\u0080-\U0010ffff\x20\x09-\x0d]+", r.text or "")]
        hashes = np.array([_text.span_hashes(np.frombuffer(p, np.uint8), np.array([0]), np.array([len(p)]))[0] for p in pieces], np.uint64)
        for n in quality.ORDERS:
            for k in range(len(hashes) - n + 1):
                b = int(_text.gram_hashes(hashes[k : k + n], n)[0]) % quality.BUCKETS
                raw[b] += 1
                target[b] += r.doc_id in good
    raw /= raw.sum()
    prior = min(quality.BUCKETS, target.sum() / 10)
    want = np.log((target + prior * raw) / (target.sum() + prior) / raw)
    got = quality.fit(docs, labels).ratios / quality.UNIT
    assert np.abs(got - want).max() < 1e-6


def test_kth_largest(spark):
    r = np.random.default_rng(0)
    for values in (r.normal(size=500), np.repeat([1.0, 2.0, 3.0], 100), r.choice([1e-300, 1e300, 5.0], 200), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        for k in (1, 2, len(values) // 2 or 1, len(values), len(values) + 5):
            assert quality.kth_largest(df, "x", k, bins=8, few=10) == np.sort(values)[::-1][min(k, len(values)) - 1]
    assert quality.kth_largest(df, "x", 0) is None


def test_gumbel_top_k_draws_in_proportion(spark):
    scored = spark.range(20_000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN ln(3.0D) ELSE 0.0D END AS log_weight")
    keyed = scored.withColumn("gumbel_key", scored.log_weight + quality._gumbel(scored.id, 1))
    tau = quality.threshold(keyed, k=1000)
    drawn = keyed.where(keyed.gumbel_key >= tau)
    assert drawn.count() == 1000
    assert 0.70 < drawn.where("id % 2 = 0").count() / 1000 < 0.80


def test_held_out(spark):
    """On labels that it did not see."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, quality.good_labels(labels.where("doc_id % 2 = 0")))
    scored = quality.score(docs, model).selectExpr("row.doc_id", "log_weight").join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert (scored.log_weight >= -4)[scored.quality == 1].mean() > 0.98
    assert (scored.log_weight >= -4)[scored.quality == 0].mean() < 0.15
