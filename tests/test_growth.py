"""Steps that once shuffled postings or held a large group in one task, by their plans and by hand."""

from collections import Counter

import numpy as np

from lectern.operators import course, evidence, text, word_vectors
from lectern.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_draft_questions_within_the_row(spark):
    docs = spark.createDataFrame([(0, "cell wall cell wall atom"), (1, "Atom. atom! cell"), (2, ""), (3, None)], "doc_id long, text string")
    got = course.draft_questions(docs, ["{}?", "why {}?", "{}!"])
    assert "Window" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {(0, 1, "cell?", 2), (0, 2, "why wall?", 1), (1, 1, "atom!", 2), (1, 2, "cell?", 2)}


def test_postings_within_the_row(spark):
    docs = spark.createDataFrame([(0, "cell wall of the cell"), (1, "a"), (2, None), (3, "äpfel x1 äpfel")], "doc_id long, text string")
    got = text.term_counts(docs, "doc_id", "text")
    assert "Exchange" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {(0, "cell", 2), (0, "wall", 1), (3, "äpfel", 2), (3, "x1", 1)}


def test_section_scores_over_blocks(spark):
    texts = {k: "\n".join(f"{w} {w} x{i % 2}y" for i, w in enumerate(["leaf", "root", "stem"] * (k % 3 + 1))) for k in (1, 3, 4, 9, 30, 31)}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    ids = sorted(texts)
    pairs = spark.createDataFrame([*zip(ids, ids[1:], strict=False)], "a long, b long")
    cut = lambda t: [Counter(w for x in t.split("\n")[k : k + 2] for w in x.split()) for k in range(0, len(t.split("\n")), 2)]
    norm = lambda c: sum(n * n for n in c.values()) ** 0.5
    want = {(f"{p}:{q}", i, j, s) for p, q in zip(ids, ids[1:], strict=False) for i, a in enumerate(cut(texts[p])) for j, b in enumerate(cut(texts[q])) if a and b and (s := round(sum(n * b[w] for w, n in a.items()) / norm(a) / norm(b), 6)) >= 0.3}
    for block in (2, 5, 100):
        assert {tuple(r) for r in course.section_scores(docs, pairs, 2, 0.3, block).collect()} == want
    assert want


def test_page_chunks_without_windows(spark):
    pages = spark.createDataFrame([(1, k, f"Word {k}.", None) for k in range(30)], "d long, page int, text string, headings array<string>").repartition(4)
    got = text.page_chunks(pages, "d", 6, 0)
    assert "Window" not in plan(got)
    assert [(r.first_page, r.last_page) for r in got.orderBy("chunk").collect()] == [(k, k + 1) for k in range(0, 30, 2)]


def test_graph_pages_deals_an_owners_texts(spark):
    pages = spark.createDataFrame([("s", k, f"a cell {k}") for k in range(300)], "owner string, page long, text string")
    nodes = spark.createDataFrame([("s", "n", "cell")], "owner string, node_id string, label string")
    got = evidence.graph_pages(nodes, spark.createDataFrame([], "owner string, term string, page long"), pages, "owner")
    assert "__part" in plan(got) and got.count() == 300


def test_extractive_answers_ranks_once(spark, sf):
    assert plan(QUERIES["extractive_answers"](spark, sf)).count("documents.parquet") <= 7


def test_word_vectors_are_trained_once(spark):
    docs = spark.createDataFrame([(k, f"apple pear plum{k % 2} plum{k % 2}", "m") for k in range(40)], "doc_id long, text string, owner string")
    made = word_vectors.cbow(docs, "text", "owner", size=4, rounds=1, passes=1)
    assert made.storageLevel.useDisk
    means = word_vectors.mean_vectors(docs, "doc_id", "text", made, "owner")
    of = {r.word: np.array(r.vector) for r in made.collect()}
    for r in means.collect():
        assert np.allclose(r.embedding, (of["apple"] + of["pear"] + 2 * of[f"plum{r.doc_id % 2}"]) / 4)
    assert means.count() == 40 and "CoGroup" in plan(means)
