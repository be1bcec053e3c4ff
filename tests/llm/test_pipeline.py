"""The pipeline against its stages written plainly."""

import __spark_entry__ as entry
import corpus_pipeline
from lectern.llm import language_id, packing, quality, secret_scan
from pyspark.sql import functions as F
from test_near_duplicates import joined, shingles
from test_secret_scan import brute


def masked(text, extra):
    out, at = "", 0
    for start, _, _, end in sorted(brute(text) + extra):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = quality.good_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "language", "near-dedup", "secrets", "packing"]
    rows = lambda df: sorted(map(tuple, df.collect()))

    good = stages["quality"](spark, docs, sf)
    kept = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept

    known = stages["language"](spark, good, sf)
    assert known.columns == docs.columns and set(rows(known)) <= set(rows(good))
    model = language_id.fit(good.where("crc32(cast(doc_id AS string)) % 4 <> 2"))
    scored = {r.row.doc_id: r for r in language_id.predict(good, model).collect()}
    stay = {i for i, r in scored.items() if any(c.isalpha() for c in r.row.text) and r.score * r.n_grams + 1 >= 0.05 * r.n_grams}
    assert {r.doc_id for r in known.collect()} == stay

    one = stages["near-dedup"](spark, known, sf)
    before = sorted(known.collect())
    sets = [shingles(r.text) for r in before]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    firsts = set(joined(len(before), links))
    assert rows(one) == [tuple(r) for k, r in enumerate(before) if k in firsts]

    safe = stages["secrets"](spark, one, sf)
    assert safe.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in safe.collect()} == {r.doc_id: (m := masked(r.text, []), len(m)) for r in one.collect()}
    assert secret_scan.digest(safe).where("spans <> ''").count() == 0

    want = packing.pack(safe).drop("sequence_id", "offset")
    ran = corpus_pipeline.run(spark, sf)
    assert rows(ran.drop("sequence_id", "offset")) == rows(want)
    assert language_id.UNKNOWN not in {r.lang for r in safe.collect()}


CLASHES = ("__gone", "__letters", "gone", "letters", "row", "id", "text2", "found", "given", "score", "n", "a.b", "lang_pred", "kept")


def test_nulls_repeats_empty_tables_and_clashing_columns(spark, sf):
    """Each stage on rows without id, text or language, repeated rows, and columns named as the operators name theirs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(None, docs.first().text, None, None, 5), (None, None, "en", "s", None), (5001, None, None, None, None), (5002, "", "fr", "s", 0), (5003, " ... ", "fr", "s", 5)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3)).unionByName(odd)
    more = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHES))).cache()
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(spark, docs, sf), stage(spark, more, sf)
        assert plain.columns == docs.columns and wide.columns == more.columns, name
        want = rows(plain)
        assert rows(wide.select(*docs.columns)) == want, name
        assert rows(wide.select(*(F.col(f"`{c}`") for c in CLASHES)).distinct()) == [tuple(range(len(CLASHES)))], name
        assert rows(stage(spark, docs.limit(0), sf)) == [], name
        if name != "secrets":
            assert set(want) <= set(rows(docs)), name
    ids = [r.doc_id for r in corpus_pipeline.keep_one(spark, docs, sf).collect()]
    assert ids.count(None) == 4 and ids.count(5001) == ids.count(5002) == 2
    assert not {5001, 5002, 5003} & {r.doc_id for r in corpus_pipeline.keep_identified(spark, docs, sf).collect()}
    assert corpus_pipeline.pack(spark, docs.limit(0), sf).count() == 0
    lengths = corpus_pipeline.pack(spark, docs, sf).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r.n == r.end <= 1024 for r in lengths)


def test_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
