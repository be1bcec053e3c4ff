"""Answer extraction against its definition in plain Python."""

import math
import random

from lectern.operators import answers
from pyspark.sql import functions as F

SCHEMA = f"query_id long, context string, tokens {answers.TOKENS}, place struct<rank:long,doc:string>"


def plain(tokens, starts=20, longest=30):
    a = sorted(range(len(tokens)), key=lambda i: (-tokens[i][2], i))[:starts]
    b = sorted(range(len(tokens)), key=lambda i: (-tokens[i][3], i))[:starts]
    pairs = [(tokens[i][2] + tokens[j][3], i, j) for i in a for j in b if j >= i and j - i < longest and tokens[i][1] and tokens[j][1]]
    if not pairs:
        return None
    _, i, j = max(pairs)
    soft = lambda k, at: math.exp(tokens[at][k]) / sum(math.exp(t[k]) for t in tokens)
    return i, j, soft(2, i) * soft(3, j)


def test_best_of_many_passages(spark):
    r = random.Random(4)
    rows, want = [], {}
    for q in range(30):
        found = []
        for p in range(r.randrange(5)):
            words = ["w" * r.randint(1, 6) for _ in range(r.choice((0, 1, 40, 90)))]
            context, at, tokens = " ".join(words), 0, [(0, 0, 9.0, 9.0)] if p % 2 else []
            for w in words:
                tokens.append((at, at + len(w), r.randrange(40) / 4, r.randrange(40) / 4))
                at += len(w) + 1
            rows.append((q, context, tokens, (p // 2, f"d{p}")))
            if (best := plain(tokens)) and round(best[2], 6) >= 0.05:
                begin, end = tokens[best[0]][0], tokens[best[1]][1]
                if context[begin:end].strip():
                    found.append((-round(best[2], 6), (p // 2, f"d{p}"), begin, end, context[begin:end]))
        want[q] = min(found, default=None)
    asked = spark.createDataFrame([(q,) for q in range(30)], "query_id long")
    got = {x.query_id: x for x in answers.extract(asked, spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == 30 and sum(w is not None for w in want.values()) > 5
    for q, w in want.items():
        x = got[q]
        if w is None:
            assert (x.found, x.answer, x.confidence, x.place) == (False, answers.NOT_FOUND, None, None)
        else:
            assert (x.found, round(-x.confidence, 6), tuple(x.place), x.begin, x.end, x.answer) == (True, *w)


def test_lexical_reader(spark):
    text = "Mitosis is slow. The cell wall of an old plant holds Cellulose, mostly!"
    rows = spark.createDataFrame([(1, text, ["cell", "wall", "holds"]), (2, "", ["x"]), (3, " - ", [])], "query_id long, context string, terms array<string>")
    read = rows.select("query_id", "context", answers.lexical_reader(F.col("context"), F.col("terms")).alias("tokens"), F.struct(F.lit(0).cast("long").alias("rank"), F.lit("d").alias("doc")).alias("place"))
    tokens = {r.query_id: r.tokens for r in read.collect()}
    assert [text[t.begin : t.end] for t in tokens[1]] == text.replace(".", "").replace(",", "").replace("!", "").split() and not tokens[2] and not tokens[3]
    one = {text[t.begin : t.end]: t for t in tokens[1]}
    assert one["Cellulose"].start == 4 * (0.5 * 3 + 1 + 0.5) and one["Cellulose"].finish == one["Cellulose"].start + 1 and one["wall"].start == 4 * (0.5 * 3 - 2)
    got = {r.query_id: r.answer for r in answers.extract(rows, read, threshold=0.0).collect()}
    assert got[1] == "Cellulose" and got[2] == got[3] == answers.NOT_FOUND


def test_passages(spark):
    docs = spark.createDataFrame([(1, "A b. C d! E f?"), (2, ""), (3, None)], "d long, t string")
    assert sorted((r.d, r.passage, r.context) for r in answers.passages(docs, "d", "t", 2).collect()) == [(1, 0, "A b. C d!"), (1, 1, "E f?")]
