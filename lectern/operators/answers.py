"""Answers from passages: a reader's start and end scores, the best span of each passage, the best passage of each question."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.quiz import let

NOT_FOUND = "not found in the document"
PIECE = rf"{T.WORD}+|[^a-zA-Z0-9_\p{{L}}\p{{N}}]+"
TOKENS = "array<struct<begin:int,end:int,start:double,finish:double>>"


def passages(docs: DataFrame, id_col: str, text_col: str, sentences: int = 8) -> DataFrame:
    """(id, passage, context): so many sentences each, in order."""
    s = docs.select(F.col(id_col), T.sentences(F.col(text_col)).alias("s")).where(F.size("s") > 0)
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"(size(s) - 1) div {sentences}")), lambda c: F.array_join(F.slice("s", c * sentences + 1, F.lit(sentences)), " "))
    return s.select(id_col, F.posexplode(parts).alias("passage", "context")).withColumn("passage", F.col("passage").cast("long"))


def lexical_reader(context: Column, terms: Column, window: int = 8, sharp: float = 4.0) -> Column:
    """Scores without a model, as tokens (begin, end, start, finish) of a passage of bounded length.

    A word scores half a point for each of the question's terms within so many words,
    one for being neither asked nor a stop word (else -2) and half for beginning with a
    capital or a digit; an end has a quarter more where no single blank follows. sharp
    multiplies all. terms are the question's, in lower case.
    """

    def scored(c: Column) -> Column:
        words, asked = c["words"], c["asked"]

        def one(w: Column, i: Column) -> Column:
            begin = F.greatest(F.lit(0), i - window)
            near = F.size(F.filter(F.slice(asked, begin + 1, i + window - begin + 1), lambda x: x))
            plain = ~F.lower(w["text"]).isin(T.STOP_WORDS) & ~F.get(asked, i)
            base = 0.5 * near + F.when(plain, 1.0).otherwise(-2.0) + F.when(w["text"].rlike(r"^[\p{Lu}\p{N}]"), 0.5).otherwise(0.0)
            return F.struct(w["begin"].alias("begin"), (w["begin"] + F.length(w["text"])).alias("end"), (sharp * base).alias("start"), (sharp * (base + F.when(w["tail"] == " ", 0.0).otherwise(0.25))).alias("finish"))

        return F.transform(words, one)

    def placed(pieces: Column) -> Column:
        each = F.transform(pieces, lambda p, i: F.struct(p.alias("text"), F.length(F.array_join(F.slice(pieces, F.lit(1), i), "")).alias("begin"), F.coalesce(F.get(pieces, i + 1), F.lit("")).alias("tail")))
        return F.filter(each, lambda x: x["text"].rlike(rf"^{T.WORD}"))

    pieces = F.regexp_extract_all(context, F.lit(PIECE), F.lit(0))
    with_words = lambda ws: let(F.struct(ws.alias("words"), F.transform(ws, lambda x: F.array_contains(terms, F.lower(x["text"]))).alias("asked")), scored)
    return let(let(pieces, placed), with_words)


def best_span(tokens: Column, starts: int = 20, longest: int = 30) -> Column:
    """struct (score, i, j, confidence) of a passage's best span, null without one: of the so many best starts and as many best ends, smaller places first at ties, the pair of the greatest sum that begins before it ends and is shorter than `longest`; of equal sums the last. Tokens that end at 0 stand for none. The confidence is the product of both ends' shares in a softmax over all tokens."""

    def top(field: str) -> Column:
        ordered = F.array_sort(F.transform(tokens, lambda t, i: F.struct((-t[field]).alias("s"), i.alias("i"), t["end"].alias("end"))))
        return F.filter(F.slice(ordered, 1, starts), lambda x: x["end"] > 0)

    def share(field: str, at: Column) -> Column:
        most = F.array_max(F.transform(tokens, lambda t: t[field]))
        total = F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.exp(t[field] - most))
        return F.exp(F.get(tokens, at)[field] - most) / total

    def choose(x: Column) -> Column:
        pairs = F.flatten(F.transform(x["a"], lambda a: F.transform(F.filter(x["b"], lambda b: (b["i"] >= a["i"]) & (b["i"] - a["i"] < longest)), lambda b: F.struct((-a["s"] - b["s"]).alias("score"), a["i"].alias("i"), b["i"].alias("j")))))
        return F.array_max(pairs)

    found = let(F.struct(top("start").alias("a"), top("finish").alias("b")), choose)
    whole = lambda b: F.when(b.isNotNull(), F.struct(b["score"].alias("score"), b["i"].alias("i"), b["j"].alias("j"), (share("start", b["i"]) * share("finish", b["j"])).alias("confidence")))
    return let(found, whole)


def extract(questions: DataFrame, candidates: DataFrame, query: str = "query_id", threshold: float = 0.05, starts: int = 20, longest: int = 30) -> DataFrame:
    """(query, found, answer, confidence, begin, end, place): each question's answer of the greatest confidence among the passages that reach the threshold.

    candidates has (query, context, tokens, place): place is a struct whose order breaks
    ties, the smallest first, and is handed through. A question without an answer has
    found = false, NOT_FOUND and nulls. Only a passage's best span is shuffled.
    """
    # Conditions are within the aggregate: a filter would be pushed below and work tokens and spans out again for each use.
    span = candidates.select(query, "context", "place", "tokens", best_span(F.col("tokens"), starts, longest).alias("b"))
    begin, end = F.get("tokens", F.col("b.i"))["begin"], F.get("tokens", F.col("b.j"))["end"]
    said = span.select(query, "context", "place", F.round("b.confidence", 6).alias("confidence"), begin.alias("begin"), end.alias("end"))
    answer = F.substring("context", F.col("begin") + 1, F.col("end") - F.col("begin"))
    good = (F.col("confidence") >= threshold) & (F.trim(answer) != "")
    best = said.groupBy(query).agg(F.min(F.when(good, F.struct((-F.col("confidence")).alias("c"), "place", "begin", "end", answer.alias("answer")))).alias("b"))
    out = questions.select(query).distinct().join(best, query, "left")
    return out.select(query, F.col("b").isNotNull().alias("found"), F.coalesce("b.answer", F.lit(NOT_FOUND)).alias("answer"), (-F.col("b.c")).alias("confidence"), "b.begin", "b.end", "b.place")
