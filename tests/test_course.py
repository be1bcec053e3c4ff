"""Operators without SQL against plain versions, and hand-checked cases."""

import re
from collections import Counter

from lectern.functions import text as T
from lectern.operators import course, metrics, ranks, spans, tables, text
from lectern.plans import QUERIES
from pyspark.sql import functions as F


def column(spark, f, *values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, x string")
    return [r.y for r in rows.select("k", f(F.col("x")).alias("y")).orderBy("k").collect()]


def f1(a, b):
    a, b = (Counter(re.findall("[a-z0-9]+", x.lower())) for x in (a, b))
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))


def test_different_questions(spark, sf):
    rows = [(1, 0, "What is a cell wall made of?"), (1, 1, "what is a CELL wall made of"), (1, 2, "What is a cell wall made of, exactly?"), (1, 3, "Why do rivers bend?"), (2, 0, "Why do rivers bend?")]
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").select(F.col("conv_id") + 10, "turn", "text").collect()
    rows += [tuple(r) for r in c] + [(r[0], r[1] + 100, r[2] + " once") for r in c if r[0] % 2]
    got = {(r.g, r.pos) for r in course.different_questions(spark.createDataFrame(rows, "g long, pos long, text string"), "g").collect()}
    want, kept = set(), {}
    for g, pos, t in sorted(rows):
        if all(f1(t, k) < 0.85 for k in kept.setdefault(g, [])):
            kept[g].append(t)
            want.add((g, pos))
    assert got == want and (1, 1) not in got and (2, 0) in got


def test_source_topics_and_submissions(spark):
    q = [(1, "t", " Walls ", 1, 4, 6, "cell wall"), (2, "t", "", 1, 4, 6, "The Cell WALL and root"), (3, "t", None, 1, 4, 6, "nothing"), (4, None, None, None, None, None, None), (5, "t", "  ", 2, 4, 6, "cell wall"), (6, "", " ", 1, 300, 400, "x leaf")]
    terms = [(1, "wall", 5), (1, "Cell Wall", 6), (1, "root", 4), (1, "the cell wall", 7), (1, "leaf", 350), (1, "LEAF", 351)]
    topics = course.source_topics(spark.createDataFrame(q, "question_id long, topic string, section string, document long, first long, last long, text string"), spark.createDataFrame(terms, "document long, term string, page long"))
    got = {r.question_id: r.topic for r in topics.collect()}
    assert got == {1: "Walls", 2: "Cell Wall", 3: "t", 4: "General", 5: "t", 6: "leaf"}
    answers = [(7, 1, False, 1), (7, 1, True, 2), (7, 2, None, 1), (7, 3, True, 1), (7, 5, False, 1), (8, 4, True, 1)]
    rows = course.submitted(spark.createDataFrame(answers, "attempt_id long, question_id long, is_correct boolean, at long"), topics).collect()
    assert {(r.attempt_id, r.topic, r.asked, r.right, r.total, r.correct, r.score) for r in rows} == {(7, "Walls", 1, 1, 4, 2, 0.5), (7, "Cell Wall", 1, 0, 4, 2, 0.5), (7, "t", 2, 1, 4, 2, 0.5), (8, "General", 1, 1, 1, 1, 1.0)}


def test_match_sections(spark):
    scores = [("p", 0, 0, 0.9), ("p", 0, 1, 0.95), ("p", 1, 1, 0.94), ("p", 1, 0, 0.61), ("p", 2, 2, 0.59), ("q", 0, 0, 0.6), ("q", 1, 0, 0.6)]
    got = {(r.k, r.a, r.b) for r in course.match_sections(spark.createDataFrame(scores, "k string, a long, b long, score double"), "k").collect()}
    assert got == {("p", 0, 1), ("p", 1, 0), ("q", 0, 0)}


def test_section_matches_of_documents(spark, sf):
    """The greedy choice over all pairs of sections, plainly."""
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    word = lambda t: [w for w in re.findall(r"\w{2,}", t.lower()) if w not in T.STOP_WORDS]
    sections = []
    for r in docs:
        lines = r.text.split("\n")
        sections.append([Counter(word("\n".join(lines[k : k + 10]))) for k in range(0, len(lines), 10)])
    want = set()
    for n in range(len(docs) - 1):
        norm = lambda c: sum(x * x for x in c.values()) ** 0.5
        pairs = [(round(sum(x * b[t] for t, x in a.items()) / (norm(a) * norm(b)), 6), i, j) for i, a in enumerate(sections[n]) for j, b in enumerate(sections[n + 1]) if a and b]
        left, right = set(), set()
        for s, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
            if s >= 0.6 and i not in left and j not in right:
                left.add(i)
                right.add(j)
                want.add((f"{docs[n].doc_id}:{docs[n + 1].doc_id}", i, j))
    assert {(r.pair, r.a, r.b) for r in QUERIES["section_matches"](spark, sf).collect()} == want


def test_rouge_l(spark, sf):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if not b else [0, *row[1:]]
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rows = [(1, "a b c d", "a c d e"), (2, "", ""), (3, "x", "y"), (4, "the cat sat on the mat", "on the mat the cat sat")]
    got = {r.k: r.rouge_l for r in metrics.rouge_l(spark.createDataFrame(rows, "k long, a string, b string"), ["k"], "a", "b").collect()}
    assert got == {k: round(2 * lcs(a.split(), b.split()) / (len(a.split()) + len(b.split())), 6) if a or b else 0 for k, a, b in rows}


def test_clean_ups(spark):
    stems = {
        "Why is c++ → faster than C#?": "Why is C++ faster than C#?",
        "f# and F#, but not f#x or xc++": "F# and F#, but not f#x or xc",
        "1 + 1 = 2 • ★  done": "1 1 2 done",
        "C+++ and C+ and C++y": "C++ and C and C y",
        "A CPPLANGUAGE stays what it is": "A CPPLANGUAGE stays what it is",
        "": "",
    }
    assert column(spark, T.clean_stem, *stems) == list(stems.values())
    slides = {
        "• Cells divide in two parts by mitosis\n- 12\nshort line\nDone!": "Cells divide in two parts by mitosis Done!",
        "1. Step 3: Cells divide in two parts by mitosis; slide 7 ends": "Cells divide in two parts by mitosis. ends",
        "A) no B) yes that is one of many\na | b | c d e f g\n[Table 2] x y z a b c.\nConcept  Example of all the things\n2) \"quoted\" option line here now": "",
        "STEP 2) Mix both parts.\n- c++ is a language of many uses today :": "Mix both parts. C++ is a language of many uses today",
        "one two three four five\none two three four five six": "one two three four five six",
        "Lecture #4 Why do rivers bend?\r\n3) Water takes the weaker bank away.": "Why do rivers bend? Water takes the weaker bank away.",
        "": "",
        "   \n\n": "",
    }
    assert column(spark, T.clean_slides, *slides) == list(slides.values())
    assert column(spark, T.clean_slides, "x " * 5000, None) == [("x " * 5000).strip(), None]


def test_prompt_and_phrases(spark):
    long = "c" * 400 + "\n\nUser Question: why?"
    got = column(spark, lambda c: T.trimmed_prompt(c, F.lit("s" * 40), 60), long, "short", "d" * 400)
    assert got[1] == "short" and got[2] == "d" * 200 and got[0].endswith("\n\nUser Question: why?") and (len(got[0]) + 3) // 4 <= 50
    phrase = lambda c: T.short_noun_phrase(c, ["the", "of"], ["is", "add"])
    assert column(spark, phrase, "cell wall", "the wall", "wall is thick", "1,234.5%", "a b c d e f", "", None) == [True, False, False, True, False, False, False]
    assert column(spark, lambda c: T.redact_literals(c, ["abcd", "xyz"]), "abcd xyz abcd") == ["[redacted] xyz [redacted]"]


def test_encode_and_decode(spark):
    docs = spark.createDataFrame([(1, "cell wall cell zebra"), (2, ""), (3, None), (4, "wall " * 9)], "d long, t string")
    vocab = text.vocabulary(docs, "t")
    e = text.encoded(docs, "d", "t", vocab, 5)
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert {r.d: r.ids for r in e.collect()} == {1: [ids["cell"], ids["wall"], ids["cell"], 1, 0], 2: [0] * 5, 3: [0] * 5, 4: [ids["wall"]] * 5}
    assert {r.d: r.text for r in text.decoded(e, "d", vocab).collect()} == {1: "cell wall cell <UNK>", 2: "", 3: "", 4: "wall wall wall wall wall"}


def test_ranked_slices(spark):
    rows = [(g, s, k) for k, (g, s) in enumerate([("a", 5.0), ("a", 1.0), (None, 2.0), ("a", 1.0), (None, 9.0), ("b", None)])]
    df = spark.createDataFrame(rows, "g string, s double, k long")
    got = {(r.k): (r.place, r.n) for r in ranks.ranked(df, ["g"], F.floor("s"), [F.col("s"), F.col("k")], "place", "n").collect()}
    assert got == {1: (1, 3), 3: (2, 3), 0: (3, 3), 2: (1, 2), 4: (2, 2), 5: (1, 1)}


def test_typed_edges(spark):
    s = spark.createDataFrame([(1, 0, "The wall uses cells."), (1, 1, "A cells and wall day."), (1, 2, "Wall is a kind of barrier here.")], "d long, pos long, sentence string")
    t = spark.createDataFrame([(1, x) for x in ("wall", "cells", "barrier")], "d long, term string")
    rel = {"is_a": r"is\s+(?:a\s+)?(?:type|kind)\s+of", "uses": "uses"}
    got = {(r.source, r.target, r.relation, r.weight, r.pos) for r in course.typed_edges(s, t, "d", rel).collect()}
    assert got == {("wall", "cells", "uses", 1, 0), ("cells", "wall", "related_to", 1, 1), ("wall", "barrier", "is_a", 1, 2)}


def test_cascade_and_windows(spark):
    child = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id long, ref long")
    gone = spark.createDataFrame([(7,)], "k long")
    assert sorted(r.id for r in tables.cascade(child, "ref", gone, "k").collect()) == [2, 3]
    assert {r.id: r.ref for r in tables.set_null(child, "ref", gone, "k").collect()} == {1: None, 2: 8, 3: None}
    n = spark.createDataFrame([(1, 10), (2, 11), (3, 0), (4, 4)], "d long, n long")
    got = sorted((r.d, r.window, r.first, r.last) for r in spans.stride_windows(n, "d", "n", 6, 2).collect())
    assert got == [(1, 0, 0, 5), (1, 1, 4, 9), (2, 0, 0, 5), (2, 1, 4, 9), (2, 2, 8, 10), (4, 0, 0, 3)]


def test_even_sample(spark):
    rows = [("a", k) for k in range(60)] + [("b", k) for k in range(30)] + [("c", k) for k in range(10)]
    df = spark.createDataFrame(rows, "g string, k long")
    for total in (7, 10, 100, 500):
        got = course.even_sample(df, "g", [F.col("k")], F.floor(F.col("k") / 8), total).collect()
        assert len(got) == min(total, 100)
    assert Counter(r.g for r in course.even_sample(df, "g", [F.col("k")], F.floor(F.col("k") / 8), 10).collect()) == {"a": 6, "b": 3, "c": 1}


def test_page_chunks(spark):
    pages = [(1, 1, "# Basics\nOne two three. Four five six.", ["basics"]), (1, 2, "Seven eight nine.\nNext  Part\nTen.", ["Next part"]), (2, 1, None, None)]
    df = spark.createDataFrame(pages, "d long, page int, text string, headings array<string>")
    got = [tuple(r)[1:] for r in text.page_chunks(df, "d", 10, 5).orderBy("d", "chunk").collect()]
    assert got == [(0, "One two three. Four five six.", 8, "Basics", 1, 1), (1, "Four five six. Seven eight nine.", 8, "Basics", 1, 2), (2, "Ten.", 2, "Next  Part", 2, 2)]


def test_preprocessed(spark):
    import pytest

    docs = spark.createDataFrame([(1, "Don't stop at 5 cells.")], "d long, t string")
    row = text.preprocessed(docs, "d", "t", ["content", "normalize"]).first()
    assert row.asDict() == {"d": 1, "normalize": "do not stop at <num> cells.", "content": ["do", "not", "stop", "<", "num", ">", "cells"]}
    with pytest.raises(ValueError):
        text.preprocessed(docs, "d", "t", ["nothing"])
    with pytest.raises(Exception, match="too long"):
        text.preprocessed(docs, "d", "t", ["tokens"], 5).collect()


def test_file_store(spark, tmp_path):
    import pytest
    from lectern.sources import files

    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        files.delete_from_store(spark, str(tmp_path), ["a.txt", "../b"])
    assert files.delete_from_store(spark, str(tmp_path), ["a.txt", "none"]) == ["a.txt"] and not (tmp_path / "a.txt").exists()
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")
    assert files.checked_vectors(v.limit(1), "v", 2).count() == 1
    with pytest.raises(Exception, match="must have 2"):
        files.checked_vectors(v, "v", 2).collect()


def test_pages_of_graph_nodes(spark):
    from lectern.operators import evidence

    terms = spark.createDataFrame([("o", "C++", 1), ("o", "new  york", 9), ("o", "art", 2), ("p", "art", 2)], "owner string, term string, page long")
    nodes = evidence.graph_nodes(terms, terms.limit(0).select("owner", "term", F.lit(1.0).alias("importance")), "owner")
    pages = [("o", 1, "nothing"), ("o", 2, "New\n York, and c++."), ("o", 3, "start of partly c+++"), ("o", 4, "(ART)"), ("o", 4, "art"), ("o", 5, None), ("o", 6, "c++x"), ("p", 2, ""), ("q", 1, "art")]
    got = evidence.graph_pages(nodes, terms, spark.createDataFrame(pages, "owner string, page long, text string"), "owner").collect()
    assert sorted((r.owner, r.label, r.page) for r in got) == [("o", "art", 2), ("o", "art", 4), ("o", "c++", 1), ("o", "c++", 2), ("o", "c++", 3), ("o", "new york", 2), ("p", "art", 2)]
    assert evidence.graph_pages(nodes.limit(0), terms, spark.createDataFrame(pages, "owner string, page long, text string"), "owner").count() == 0


def test_rows_of_a_web_search(spark):
    from lectern.operators import evidence

    rows = [("q", 1, "t", "http://a.org/x", "plain"), ("q", 2, None, "https://B.org:8/x?y", " two \n words "), ("q", 3, "t" * 300, "https://u@c.org", "c" * 400), ("q", 4, "t", "https://d.org", " \n"), ("q", 5, "t", "https:///x", "no host"), ("q", 6, "t", "https://f.org", "beyond"), ("r", 1, "t", None, "x"), ("r", 2, "t", "https://g.org", None)]
    got = evidence.web_rows(spark.createDataFrame(rows, "query string, position long, title string, url string, content string"), "query").orderBy("position").collect()
    assert [tuple(r)[1:] for r in got] == [(2, "", "https://B.org:8/x?y", "b.org", "two words"), (3, "t" * 200, "https://u@c.org", "c.org", "c" * 300)]
    assert column(spark, evidence.topic_query, " one\n two three  four five six seven eight nine", "x" * 200, "", None) == ["one two three four five six seven eight", "x" * 120, "", None]


def test_typed_edges_shuffle_a_sentence_once(spark):
    sentences = spark.createDataFrame([(1, 0, "Rust uses iron and the iron uses Rust.")], "doc_id long, pos long, sentence string")
    terms = spark.createDataFrame([(1, "rust"), (1, "iron")], "doc_id long, term string")
    out = course.typed_edges(sentences, terms, "doc_id", {"uses": "uses"})
    assert [tuple(r) for r in out.collect()] == [(1, "iron", "rust", "uses", 1, 0)]
    assert "explode(array_distinct(regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pages_by_label_are_numbered(spark):
    rows = spark.createDataFrame([("t", None, d, p, p - 1, p + 1, "An Oak") for d, p in ((2, 1), (1, 9), (1, 3))], "topic string, section string, document long, page long, first long, last long, text string")
    terms = spark.createDataFrame([(1, "oak", 4), (1, "elm", 4)], "document long, term string, page long")
    got = course.pages_by_label(rows, terms).orderBy("label", "number").collect()
    assert [tuple(r) for r in got] == [("oak", 1, 3, 1), ("t", 1, 3, 1), ("t", 1, 9, 2), ("t", 2, 1, 3)]


def test_longest_terms_by_chunk(spark):
    chunks = spark.createDataFrame([(7, 1, 0, 5, "the Oak tree and Elm"), (8, 1, 50, 60, "oak"), (9, 1, 0, 5, None)], "doc_id long, document long, first long, last long, text string")
    terms = spark.createDataFrame([(1, "elm", 1), (1, "oak", 2), (1, "tree", 9)], "document long, term string, page long")
    assert [tuple(r) for r in course.longest_terms(chunks, "doc_id", terms).collect()] == [(7, "oak")]


def test_typed_edges_try_pairs_beside_a_relation(spark):
    said = ["Oak of the elm and oak", "the elm  of oak of elm", "of oak, of elm of the oak", "elm of of the oak of", "elm-of oak; oak of elms", "oak\tof\nelm", "élm of oak of élm", "oak of elm" * 2, "elm", None]
    rows = [(d, k, x) for d in (1, 2) for k, x in enumerate(said)] * 2
    terms = [(1, "oak"), (1, "elm"), (1, "élm"), (1, "elm-of"), (2, "oak")]
    rel = {"of": "of|of\\s+the|of\\s+of\\s+the", "and": "and"}
    want = {}
    for k, x in enumerate(said):
        s = (x or "").lower()
        held = sorted({"oak", "elm", "élm"} & set(re.findall(r"\w+", s)))
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                hits = [(p, q, r) for r, w in rel.items() for p, q in ((a, b), (b, a)) if re.search(rf"(?:^|\W){p}\s+(?:{w})\s+{q}(?:$|\W)", s)]
                want.setdefault((hits or [(a, b, "related_to")])[0], []).append(k)
    want = {e: (len(ks), min(ks)) for e, ks in want.items() if e[2] != "related_to" or not any((*e[:2], r) in want for r in rel)}
    out = course.typed_edges(spark.createDataFrame(rows, "d long, pos long, sentence string"), spark.createDataFrame(terms, "d long, term string"), "d", rel)
    assert {(r.source, r.target, r.relation): (r.weight, r.pos) for r in out.collect()} == want and len(want) == 3
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(before" in text and "first(" not in text and text.count("LogicalRDD") == 2
    none = course.typed_edges(spark.createDataFrame(rows, "d long, pos long, sentence string"), spark.createDataFrame(terms, "d long, term string"), "d", {})
    assert {r.relation for r in none.collect()} == {"related_to"}


def test_sentences_are_found_once(spark):
    from lectern.operators import evidence

    rows = evidence.sentence_rows(spark.createDataFrame([(1, "One two three four five. No."), (2, ""), (3, None)], "d long, t string"), "d", "t")
    assert [tuple(r) for r in rows.collect()] == [(1, 1, 0, "One two three four five.")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == rows._jdf.queryExecution().analyzed().toString().count("split(")
