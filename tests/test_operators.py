"""Hand-checked cases of single operators."""

import datetime as dt
import re
import unicodedata

import pytest
from lectern.functions import text as T
from lectern.operators import analytics, assessment, cohort, evidence, metrics, retrieval, tables, text
from pyspark.sql import functions as F


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


def python_normalize(t):
    t = unicodedata.normalize("NFKC", t).replace("’", "'")
    t = re.sub(T.EMAIL, " <EMAIL> ", t, flags=re.ASCII)
    t = re.sub(T.URL.removeprefix("(?i)"), " <URL> ", t, flags=re.IGNORECASE | re.ASCII)
    t = re.sub(r"\b[\w]+(?:'[\w]+)+\b", lambda m: T.CONTRACTIONS.get(m[0].lower(), m[0].lower()), t)
    t = re.sub(r"(?<!\w)[+-]?\d+(?:[.,]\d+)*(?!\w)", " <NUM> ", t)
    return " ".join(t.lower().split())


@pytest.mark.parametrize("t", ["I'm studying NLP.", "Don’t  pay 1,234.5 or -7 or x9 to a.b@c.de at HTTPS://x.yz/q?a=1.", "1 2 3 -5-6 v1.2.3", "", "naïve café 12%", "o'clock's rock'n'roll", "ﬁne ＡＢＣ e\u0301 １２ ½ x²"])
def test_normalize_text(spark, t):
    assert one(spark, T.normalize_text, t) == python_normalize(t)


def test_normalize_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", T.normalize_text(F.col("text")).alias("n")).collect()
    assert all(r.n == python_normalize(r.text) for r in rows)


def test_text_functions(spark):
    assert one(spark, T.sentences, "पहला वाक्य। दूसरा वाक्य।") == ["पहला वाक्य।", "दूसरा वाक्य।"]
    assert one(spark, T.script_language, "पहला") == "hi" and one(spark, T.script_language, "12") == "und" and one(spark, T.script_language, "पहला abcdef") == "en"
    assert one(spark, lambda c: T.ngrams(F.split(c, " "), 2), "a b a b") == ["a b", "b a", "a b"]
    assert one(spark, lambda c: T.ngrams(F.split(c, " "), 3), "a b") == []
    assert one(spark, T.tokens, "don't stop!") == ["don't", "stop", "!"]
    assert one(spark, T.syllables, "table") == 1 and one(spark, T.syllables, "beautiful") == 3 and one(spark, T.syllables, "rhythm") == 1
    assert one(spark, T.has_symbols, "C++ and C#") is False and one(spark, T.has_symbols, "a → b") is True
    assert one(spark, T.strip_citations, "a [Notes, p. 3] b") == "a b"
    assert one(spark, T.valid_handle, "ab") is False and one(spark, T.valid_handle, "a_b-1") is True


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", "x", 1, False), ("q", "a", 2, True), ("q", "b", 3, True)], "query_id string, doc_id string, rank long, hit boolean")
    relevant = spark.createDataFrame([("q", 2), ("none", 0)], "query_id string, n_relevant long")
    got = {r.query_id: (r.precision, r.recall, r.rr, r.ndcg) for r in metrics.ranking(ranked, relevant, 2).collect()}
    assert got == {"q": (0.5, 0.5, 0.5, 0.386853), "none": (0, 0, 0, 0)}
    with pytest.raises(ValueError):
        metrics.ranking(ranked, relevant, 0)


def test_rrf(spark):
    leg = lambda scores: spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "query_id long, doc_id long, score double")
    got = retrieval.rrf(retrieval.top_k(leg([0.9, 0.1, 0.8]), 3), retrieval.top_k(leg([0.1, 1.0, 0.0]), 3), 0.75, 10)
    assert {r.doc_id: round(r.score, 6) for r in got.collect()} == {0: 0.089015, 1: 0.080420, 2: 0.0625}


def test_rerank(spark):
    few = spark.range(35).selectExpr("1L AS query_id", "id AS doc_id", "id + 1 AS rank")
    assert [r.doc_id for r in retrieval.rerank(few, F.col("doc_id").cast("double"), 5).orderBy("final_rank").collect()] == [29, 28, 27, 26, 25]
    plain = retrieval.rerank(few, None, 3).orderBy("final_rank").collect()
    assert [r.doc_id for r in plain] == [0, 1, 2] and not plain[0].applied


def test_retrievers_agree_on_the_obvious(spark):
    docs = spark.createDataFrame([(1, "cells divide by mitosis"), (2, "stocks and bonds trade"), (3, "rivers carve valleys")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "mitosis cells")], "query_id long, text string")
    for f in retrieval.RETRIEVERS.values():
        assert [r.doc_id for r in retrieval.top_k(f(docs, q), 2).collect()] == [1]


def test_midrank(spark):
    rows = [(1, 80.0, 80), (2, 80.0, 60), (3, 90.0, 100), (4, 40.0, 50)]
    pool = spark.createDataFrame([(9, u, u, s, e, dt.datetime(2024, 1, 1), True) for u, s, e in rows], "test_id long, user_id long, attempt_id long, score double, elapsed_seconds long, completed_at timestamp, visible boolean")
    pct = {r.user_id: r.percentile for r in cohort.midrank_percentiles(pool).collect()}
    assert pct[1] == pct[2] == 50.0 and pct[3] == 100 and pct[4] == 0
    assert {r.user_id: r.rank for r in cohort.leaderboard(pool).collect()} == {3: 1, 2: 2, 1: 3, 4: 4}


def test_streaks(spark):
    days = spark.createDataFrame([("u", dt.date(2024, 11, d)) for d in (1, 2, 4, 5, 7)], "u string, d date")
    assert analytics.streaks(days, "u", "d", "2024-11-07").first()[1:] == (2, 1)
    assert analytics.streaks(days, "u", "d", "2024-11-08").first()[1:] == (2, 1)
    assert analytics.streaks(days, "u", "d", "2024-11-09").first()[1:] == (2, 0)


def test_weak_topics(spark):
    rows = [(t, k < c) for t, n, c in (("a", 2, 0), ("b", 4, 1), ("c", 7, 3), ("d", 3, 1), ("e", 6, 2), ("f", 4, 4)) for k in range(n)]
    weak = analytics.weak_topics(spark.createDataFrame(rows, "topic string, is_correct boolean"), "topic").orderBy("accuracy", F.desc("attempts"), "topic").collect()
    assert [(r.attempts, r.correct) for r in weak] == [(4, 1), (6, 2), (3, 1), (7, 3)] and weak[0].accuracy == 25


def test_study_minutes(spark):
    at = dt.datetime(2024, 1, 2, 9)
    t = lambda n: spark.createDataFrame([(at,)] * n, "ts timestamp")
    got = analytics.study_minutes(t(1).withColumn("seconds", F.lit(120)), t(2), t(1), "2024-01-01", "2024-01-03").orderBy("day").collect()
    assert [r.minutes for r in got] == [0, 8.0, 0]


def test_sm2(spark):
    log = [(1, k, dt.datetime(2024, 1, k + 1), "good") for k in range(3)]
    r = assessment.sm2_replay(spark.createDataFrame(log, "card long, review_id long, reviewed_at timestamp, rating string"), "card").first()
    assert (r.ease, r.interval, r.repetitions) == (2.5, 15, 3)
    steps = [assessment.sm2_replay(spark.createDataFrame(log[:k], "card long, review_id long, reviewed_at timestamp, rating string"), "card").first().interval for k in (1, 2, 3)]
    assert steps == [1, 6, 15]


def test_grading(spark):
    rows = spark.createDataFrame([("mcq", "  Paris ", "paris"), ("mcq", None, "paris"), ("open", "the red fox", "red the fox"), ("open", "blue", "red fox")], "kind string, answer string, expected string")
    assert [r.is_correct for r in assessment.grade(rows, "kind", "answer", "expected").collect()] == [True, False, True, False]


def test_grounding(spark):
    rows = [(1, 0, "user", "Cells divide by mitosis."), (1, 1, "assistant", "Cells divide by mitosis. Bonds trade on markets today."), (2, 0, "assistant", "")]
    got = {r.conv_id: (r.sentences, r.supported, r.score) for r in evidence.grounding(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 1.0)}


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "One two three. Four five six. Seven eight nine."), (2, " ".join(f"w{k}" for k in range(11))), (3, None)], "doc_id long, text string")
    got = text.chunks(docs.where("doc_id = 1"), "doc_id", "text", 8, 4).collect()
    assert [r.text for r in got] == ["One two three. Four five six.", "Four five six. Seven eight nine."]
    assert [r.n_tokens for r in text.chunks(docs.where("doc_id = 2"), "doc_id", "text", 4, 0).collect()] == [4, 4, 3]
    assert text.chunks(docs.where("doc_id = 3"), "doc_id", "text").count() == 0
    for size, overlap in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            text.chunks(docs, "doc_id", "text", size, overlap)


def test_summary_keeps_order_and_drops_the_alike(spark):
    body = "Alpha beta gamma delta epsilon zeta. " * 2 + "Rivers carve deep valleys over time. Markets trade bonds every single day."
    got = evidence.summary(spark.createDataFrame([(1, body)], "doc_id long, text string"), "doc_id", "text", 3).collect()
    assert [r.pos for r in got] == sorted(r.pos for r in got) and len({r.sentence for r in got}) == len(got) == 3


def test_summary_weighs_all_sentences(spark):
    """Sixty like lines that outrank the rest, and too few candidates to choose from."""
    like = " ".join(f"Alpha beta gamma delta epsilon zeta number{k}." for k in range(60))
    rest = "Rivers carve deep valleys over time. Markets trade bonds every single day. Gardens bloom after long spring rain. Engines burn fuel under high pressure."
    same = "Quiet lakes mirror tall mountains. " * 4
    docs = spark.createDataFrame([(1, f"{like} {rest}"), (2, same), (3, "It is on the of. " + "Too short.")], "doc_id long, text string")
    got = {}
    for r in evidence.summary(docs, "doc_id", "text").collect():
        got.setdefault(r.doc_id, []).append(r.pos)

    scores, terms = evidence.sentence_scores(docs, "doc_id", "text").toPandas(), {}
    for r in evidence.sentence_rows(docs, "doc_id", "text").withColumn("t", T.summary_terms(F.col("sentence"))).collect():
        terms.setdefault(r.doc_id, {})[r.pos] = set(r.t)
    want = {}
    for i, by_pos in terms.items():
        kept = sorted(by_pos) if len(by_pos) <= 5 else []
        if not kept:
            for p in scores[scores.doc_id == i].sort_values(["score", "pos"], ascending=[False, True]).pos:
                if len(kept) < 5 and all(len(by_pos[p] & by_pos[k]) <= 0.55 * len(by_pos[p] | by_pos[k]) for k in kept):
                    kept.append(p)
        want[i] = sorted(kept)
    assert {i: sorted(p) for i, p in got.items()} == want
    assert len(want[1]) == 5 and want[2] == [0, 1, 2, 3] and want[3] == [0]


def test_plan(spark):
    rows = [(1, "b", 0.0, 1.25, 60), (1, "a", 0.5, 1.7, 50), (1, "huge", 0.0, 1.2, 10_000), (1, "c", 0.0, 1.2, 20), (2, "late", 0.0, 1.0, 500)]
    got = {}
    plan = assessment.study_plan(spark.createDataFrame(rows, "u long, topic string, weak double, importance double, minutes int"), "u", 6, 60)
    for r in plan.orderBy("u", "day", "seq").collect():
        got.setdefault((r.u, r.day), []).append((r.topic, r.activity, r.minutes))
    assert got == {
        (1, 0): [("a", "read_summary", 35), ("a", "take_quiz", 10)],
        (1, 1): [("a", "read_summary", 5), ("b", "read_summary", 30), ("b", "take_quiz", 10), ("a", "revise_weak_topic", 15)],
        (1, 2): [("b", "read_summary", 20), ("c", "read_summary", 10), ("c", "take_quiz", 10), ("b", "review_flashcards", 15)],
        (1, 3): [("a", "revise_weak_topic", 15), ("c", "review_flashcards", 15)],
        (1, 4): [("b", "review_flashcards", 15)],
        (1, 5): [("c", "review_flashcards", 15)],
        (1, None): [("huge", "omitted", 10_000)],
        (2, 4): [(None, "review_flashcards", 15)], (2, 5): [(None, "review_flashcards", 15)], (2, None): [("late", "omitted", 500)],
    }
    one = assessment.study_plan(spark.createDataFrame(rows[:1], "u long, topic string, weak double, importance double, minutes int"), "u", 1, 60).collect()
    assert [(r.day, r.activity) for r in one] == [(0, "review_flashcards"), (None, "omitted")]


def test_sentence_scores_by_hand(spark):
    """tf is counted within the sentence: both `cell` of the first count twice."""
    import math

    body = "Each cell makes one more cell. Bonds trade on U.S. markets daily. Rivers carve deep old valleys."
    got = {r.pos: r.score for r in evidence.sentence_scores(spark.createDataFrame([(1, body)], "doc_id long, text string"), "doc_id", "text").collect()}
    idf = math.log(4 / 2) + 1
    assert got == {0: round((4 + 1 + 1) * idf / 4**0.8 * 1.4, 6), 1: round(4 * idf / 4**0.8 * (1 + 0.4 * 2 / 3), 6), 2: round(5 * idf / 5**0.8 * (1 + 0.4 / 3), 6)}
    assert one(spark, T.summary_sentences, 'He left the U.S. Army. "Why?" she said.\nNext line (done.) Then e.g. this!') == ["He left the U.S. Army.", '"Why?"', "she said.", "Next line (done.)", "Then e.g. this!"]


def test_two_level_summary(spark):
    names = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    rows = [(1, s, " ".join(f"{names[s * 5 + k]} {names[(s * 5 + k * 7 + 3) % 20]} word{s}{k} thing{s}{k} item{s}{k}." for k in range(5))) for s in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, section int, text string")
    got = evidence.two_level_summary(docs, "doc_id", "text").orderBy("pos").collect()
    firsts = []
    for _, s, t in rows:
        firsts += [r.sentence for r in evidence.summary(spark.createDataFrame([(s, t)], "doc_id int, text string"), "doc_id", "text", 3).orderBy("pos").collect()]
    want = evidence.summary(spark.createDataFrame([(1, "\n".join(firsts))], "doc_id long, text string"), "doc_id", "text", 4).orderBy("pos").collect()
    assert [r.sentence for r in got] == [r.sentence for r in want] and len(got) == 4


def test_replace_upsert_tree(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k long, v string")
    assert sorted(map(tuple, tables.replace_by_key(old, new, "k").collect())) == [(1, "a"), (2, "x"), (3, "y"), (3, "z")]
    assert sorted(map(tuple, tables.upsert(old, new, "k").collect())) == [(1, "a"), (2, "x"), (3, "z")]
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent_id long")
    assert {r.id: (r.depth, r.path) for r in tables.tree(nodes).collect()} == {1: (0, "1"), 2: (1, "1/2"), 3: (2, "1/2/3")}


def test_tree_of_more_rows_than_a_recursive_query_may_have(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", 50)
    try:
        nodes = spark.range(1, 101).selectExpr("id", "CASE WHEN id >= 10 THEN id div 10 END AS parent_id")
        assert tables.tree(nodes).groupBy("depth").count().orderBy("depth").collect() == [(0, 9), (1, 90), (2, 1)]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    below = spark.createDataFrame([(1, None), (2, 1), (3, 2), (2, 3)], "id int, parent_id int")
    with pytest.raises(Exception, match="below itself"):
        tables.tree(below)
    assert tables.tree(nodes.where("id < 0")).collect() == []


def test_summaries_stay_within_rows(spark):
    docs = spark.createDataFrame([(1, " ".join(f"Word{i} thing{i} item{i % 7} stone{i % 3} river runs deep." for i in range(40)))], "doc_id long, text string")
    for out in (evidence.sentence_scores(docs, "doc_id", "text"), evidence.summary(docs, "doc_id", "text")):
        plan = out._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "FlatMapGroups" not in plan
    assert evidence.summary(docs, "doc_id", "text").count() == 5


def test_confusion(spark):
    m = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 2), (2, 1, 1)], "truth int, predicted int, n long")
    got = {r.label: (r.precision, r.recall) for r in metrics.per_class(m).collect()}
    assert got == {0: (1, 0.75), 1: (0.5, 1), 2: (0, 0)}


def test_porter():
    from lectern.operators.models import porter

    for word, stem in {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "hoping": "hope", "falling": "fall", "happy": "happi", "relational": "relat", "conditional": "condit", "rationalize": "ration", "digitizer": "digit", "hopefulness": "hope", "electrical": "electr", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate", "controlling": "control", "is": "is", "naïve": "naïve"}.items():
        assert porter(word) == stem, word


def test_word_vectors(spark):
    from lectern.operators import models

    docs = spark.createDataFrame([(k, "red apple sweet fruit " * 5 if k % 2 else "fast car road engine " * 5) for k in range(20)], "doc_id long, text string")
    v = models.embed(models.word_vectors(docs, "text", size=8, passes=2), docs, "doc_id", "text")
    assert v.count() == 20 and len(v.first().embedding) == 8
    assert models.project(v, "vec_id", "embedding").select("cluster").distinct().count() >= 2


def test_files(spark, tmp_path):
    import json

    from lectern.sources import files

    good = [{"document": "d", "questions": [{"question": "q?", "question_type": "keyword", "relevant_chunk_ids": [1]}, {"question": "r?", "relevant_pages": [2]}]}]
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert files.read_questions(spark, str(tmp_path / "good.json")).count() == 2
    (tmp_path / "bad.json").write_text(json.dumps([{"document": "d", "questions": [{"question": " ", "relevant_pages": [2]}]}]))
    with pytest.raises(Exception, match="bad question"):
        files.read_questions(spark, str(tmp_path / "bad.json")).collect()
    files.write_flashcards(spark.createDataFrame([(2, "b", "B", None), (1, "a", "A", 3)], "id long, front string, back string, page int"), str(tmp_path / "cards"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "cards"), header=True).collect()] == [("a", "A", "3"), ("b", "B", None)]
    with pytest.raises(ValueError):
        files.read_store(spark, str(tmp_path) + "/../x")
    assert files.read_store(spark, str(tmp_path), "*.json").count() == 2
    out = str(tmp_path / "parts")
    files.overwrite_keys(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), out, "k")
    files.overwrite_keys(spark.createDataFrame([(2, "c")], "k long, v string"), out, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "c")}


def test_syllabus(spark):
    from lectern.operators.study import parse_syllabus, syllabi

    outline = "Unit I: Basics\n1. Cells, walls; membranes\n1.1 Mitosis.\n- Phases\n2. Tissue\n\nUnit II: Ecology\n1. Food\n   webs\nother"
    assert [(o, p, t) for o, p, _, t, _ in parse_syllabus(outline)] == [(0, None, "Basics"), (1, 0, "Cells"), (2, 1, "Mitosis"), (3, 2, "Phases"), (4, 0, "Tissue"), (5, None, "Ecology"), (6, 5, "Food"), (7, 6, "webs"), (8, 6, "other")]
    assert parse_syllabus(outline)[1][4] == ["walls", "membranes"]
    assert [(p, t) for _, p, _, t, _ in parse_syllabus("3\nUnit V\n,;\n2.1 b\n2.1.1 c\n1.2 a")] == [(None, "3"), (None, "Unit V"), (1, "b"), (2, "c"), (1, "a")]
    rows = syllabi(spark.createDataFrame([(1, outline), (2, None)], "doc_id long, text string"), "doc_id", "text").collect()
    assert len(rows) == 9 and rows[0].parent_order is None


def test_stem_reasons(spark):
    from lectern.operators.study import stem_reason

    rows = spark.createDataFrame([("Why", "x"), ("What divides a living cell?", "mitosis"), ("What does Mitosis  divide in cells?", "mitosis"), ("It is a kind of cell", "x y z"), ("a → b c d", "q")], "s string, a string")
    assert [r.r for r in rows.select(stem_reason(F.col("s"), F.col("a")).alias("r")).collect()] == ["too_short", None, "answer_leak", "pronoun_start", "symbols"]
