"""Likeness of strings against difflib, close spellings and nearest labels against all pairs."""

import random
import re
from difflib import SequenceMatcher

import pytest
from lectern.functions import similar
from lectern.operators import course, text
from lectern.plans import QUERIES
from pyspark.sql import functions as F


@pytest.mark.parametrize("seed", range(6))
def test_matching_blocks(seed):
    r = random.Random(seed)
    for k in range(300):
        n, letters = r.choice((0, 3, 10, 40, 250)), r.choice(("ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyzé日"))
        a = "".join(r.choices(letters, k=r.randint(0, n)))
        b = "".join(r.choices(letters, k=r.randint(0, n))) if k % 2 else a[: n // 2] + "x" + a[n // 3 :]
        assert similar.matching(a, b) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def test_ratio_of_nulls_and_empties(spark):
    rows = spark.createDataFrame([("", ""), (None, "a"), ("abcd", "bcde"), ("a", "")], "a string, b string")
    assert [r.r for r in rows.select(similar.ratio(F.col("a"), F.col("b")).alias("r")).collect()] == [1.0, None, 0.75, 0.0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_close_spellings_against_all_pairs(spark, edits):
    r = random.Random(edits)
    known = {"".join(r.choices("abcde", k=r.randint(1, 8))) for _ in range(150)} | {"Plant"}
    asked = {"".join(r.choices("abcde", k=r.randint(1, 8))) for _ in range(60)} | {"plantt", "PLNT", "", None}
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws] * 2, "word string").repartition(3)
    got = {(x.word, x["rank"]): (x.suggestion, x.score) for x in similar.close_spellings(frame(asked), frame(known), edits=edits).collect()}
    low = {w.lower() for w in known}
    want = {}
    for w in {a.lower() for a in asked if a} - low:
        near = [(-round(SequenceMatcher(None, w, v).ratio(), 6), v) for v in low if v[0] == w[0] and distance(w, v) <= edits]
        for k, (s, v) in enumerate(sorted(x for x in near if -x[0] >= 0.65)[:3]):
            want[w, k + 1] = (v, -s)
    assert got == want and got["plantt", 1][0] == "plant"


def nearest(queries, labels, most=3):
    words = lambda t: sorted(set(re.findall("[a-z0-9]+", t.lower())))
    one = {}
    for label, place in labels:
        if label and len(label.strip()) >= 3:
            key = label.strip().lower()
            old = one.get(key, (label.strip(), place))
            one[key] = (min(old[0], label.strip()), min(old[1], place))
    out = set()
    for q, t in queries:
        scored = []
        for key, (label, place) in one.items():
            a, b = words(key), words(t or "")
            if set(a) & set(b):
                s = len(set(a) & set(b)) / len(a) + 0.25 * SequenceMatcher(None, " ".join(a), " ".join(b)).ratio()
                scored.append((-round(s, 6), key, label, place))
        out |= {(q, label, -s, k + 1, place) for k, (s, _, label, place) in enumerate(sorted(scored)[:most])}
    return out


def test_closest_labels(spark, sf):
    r = random.Random(2)
    labels = [(" ".join(r.choices(["cell", "wall", "Root", "of", "the", "sugar", "light"], k=r.randint(1, 4))), k) for k in range(60)] + [("ab", 1), (None, 2), ("CELL", 3), ("--- -", 4)]
    queries = [(k, " ".join(r.choices(["cell", "walls", "root", "of", "light", "zebra"], k=r.randint(0, 6)))) for k in range(25)] + [(99, None)]
    got = course.closest_labels(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(labels, "label string, place long"))
    assert {tuple(x) for x in got.collect()} == nearest(queries, labels)
    pages = text.headings(spark.read.parquet(f"{sf}/pages.parquet"))
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {tuple(x) for x in QUERIES["closest_topics"](spark, sf).collect()} == nearest(items, [(x.title, x.page_id) for x in pages.collect()])
