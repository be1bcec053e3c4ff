"""Study material from texts: source sentences, stem checks, flashcards, questions, syllabi."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T


def source_sentences(docs: DataFrame, id_col: str, text_col: str, verbs: str, least: int = 8, most: int = 35) -> DataFrame:
    """(id, pos, sentence): complete sentences of so many words that begin with a capital, end in . ! or ?, hold a verb and no second mark."""
    s = docs.select(id_col, F.posexplode(T.sentences(F.col(text_col))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))
    n = F.size(F.split("sentence", r"\s+"))
    return s.where(n.between(least, most) & F.col("sentence").rlike(r"^\p{Lu}") & F.col("sentence").rlike(r"[.!?]$") & ~F.col("sentence").rlike(r"[.!?].*[.!?]$") & F.lower("sentence").rlike(T.whole(verbs)))


def stem_reason(stem: Column, answer: Column) -> Column:
    """The first reason against a question's stem, in a fixed order, or null."""
    words = F.size(F.split(T.strip(stem), r"\s+"))
    return (
        F.when(T.strip(stem) == "", "empty").when(words < 4, "too_short").when(words > 40, "too_long").when(T.has_symbols(stem), "symbols")
        .when(F.contains(T.normalize_term(stem), T.normalize_term(answer)), "answer_leak").when(F.lower(stem).rlike(r"^(it|this|that|they|these|those)\b"), "pronoun_start")
    )


def flashcards(sources: list[DataFrame], existing: DataFrame, owner: str, most: int) -> DataFrame:
    """(owner, fact_key, front, back, number): the sources' cards (owner, pos, front, back, evidence) in turn, each fact once and none that exists, at most so many an owner."""
    rows = None
    for k, s in enumerate(sources):
        one = s.select(owner, "pos", "front", "back", "evidence", F.lit(k).alias("source"))
        rows = one if rows is None else rows.unionByName(one)
    key = F.sha2(F.concat_ws("\u001f", *(T.normalize_term(F.col(c)) for c in ("front", "back", "evidence"))), 256)
    first = rows.withColumn("fact_key", key).groupBy(owner, "fact_key").agg(F.min(F.struct("source", "pos", "front", "back")).alias("c"))
    new = first.join(existing.select(owner, "fact_key"), [owner, "fact_key"], "left_anti")
    number = F.row_number().over(Window.partitionBy(owner).orderBy("c.source", "c.pos", "fact_key")).cast("long")
    return new.withColumn("number", number).where(F.col("number") <= most).select(owner, "fact_key", "c.front", "c.back", "number")


def map_topics(chunks: DataFrame, topics: DataFrame, manual: DataFrame, least: float = 0.35, most: int = 2) -> DataFrame:
    """(chunk, topic, score): a chunk's best topics by cosine, unless it is mapped by hand.

    Both sides are weights by term, (chunk, term, weight) and (topic, term, weight), and meet on terms alone.
    """
    open_ = chunks.join(manual, "chunk", "left_anti")
    scores = open_.join(topics.select("topic", "term", F.col("weight").alias("w")), "term").groupBy("chunk", "topic").agg(F.round(F.sum(F.col("weight") * F.col("w")), 6).alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("score"), "topic"))
    return scores.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def important_sentences(docs: DataFrame, id_col: str, text_col: str, title_terms: list[str], least: int = 35, most: int = 6) -> DataFrame:
    """(id, rank, pos, score): sentences of so many characters by 3 times the title terms they hold plus their terms' mean count in the text."""
    s = docs.select(id_col, T.terms(F.col(text_col)).alias("all"), F.posexplode(T.sentences(F.col(text_col))).alias("pos", "sentence")).where(F.length("sentence") >= least)
    t = s.select(id_col, F.col("pos").cast("long"), F.explode(T.terms(F.col("sentence"))).alias("term"))
    counts = docs.select(id_col, F.explode(T.terms(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("c"))
    title = F.col("term").isin(title_terms)
    per = t.join(counts, [id_col, "term"]).groupBy(id_col, "pos").agg((3 * F.countDistinct(F.when(title, F.col("term"))) + F.avg("c")).alias("s")).withColumn("score", F.round("s", 4)).drop("s")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "pos")).cast("long")
    return per.withColumn("rank", rank).where(F.col("rank") <= most)


# What marks a unit, a number and a bullet, and what is cut off titles.
_UNIT = re.compile(r"unit\s+([ivxlcdm]+)\s*[:.)-]?\s*(.*)", re.IGNORECASE)
_NUMBER = re.compile(r"(\d+(?:\.\d+)*)[.)]?\s*(.*)")
_BULLET = re.compile(r"[-*•▪◦]\s+(.+)")
_ENDS = " .;:"


@dataclass
class _Open:
    """A node that lines below may still belong to."""

    order: int
    depth: int
    unit: bool
    number: tuple[int, ...] | None

    def takes(self, depth: int, unit: bool, number: tuple[int, ...] | None, indent: int) -> bool:
        if number is None and not unit:  # a bullet or plain line goes under a numbered one, or under a less indented one
            return self.unit or self.number is not None or indent > self.depth
        if self.unit:
            return not unit
        return self.depth < depth and (self.number is None or number is None or self.number < number)


def parse_syllabus(text: str) -> list[tuple[int, int | None, int, str, list[str]]]:
    """(order, parent order, depth, title, sub-topics): units, dotted numbers, bullets and indents make the tree; `,` and `;` part sub-topics.

    A numbered line goes under the open unit or the open number that it is deeper
    than and beyond; a new unit closes everything.
    """
    out, open_ = [], []
    for raw in text.splitlines():
        line = raw.strip()
        if not line:
            continue
        unit, number = _UNIT.fullmatch(line), None
        if not unit and (m := _NUMBER.fullmatch(line)):
            number, title = tuple(map(int, m[1].split("."))), m[2].strip() or line
        elif unit:
            title = unit[2].strip() or line
        else:
            title = m[1].strip() if (m := _BULLET.fullmatch(line)) else line
        names = [x for x in (p.strip(_ENDS) for p in re.split("[,;]", title)) if x]
        if not names:
            continue
        depth = 1 if unit else len(number) if number else open_[-1].depth + 1 if open_ else 1
        indent = len(raw) - len(raw.lstrip(" \t"))
        while open_ and not open_[-1].takes(depth, bool(unit), number, indent):
            open_.pop()
        out.append((len(out), open_[-1].order if open_ else None, len(open_), names[0], names[1:]))
        open_.append(_Open(len(out) - 1, depth, bool(unit), number))
    return out


def syllabi(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, topic_order, parent_order, depth, title, sub_topics): each text's tree as rows; a null text has none. The stack needs the lines in turn, so a text is parsed by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *r) for i, t in zip(f.id, f.text, strict=True) if t for r in parse_syllabus(t)]
            out = pd.DataFrame(rows, columns=["id", "topic_order", "parent_order", "depth", "title", "sub_topics"])
            yield out.astype({"parent_order": "Int64"})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, topic_order bigint, parent_order bigint, depth bigint, title string, sub_topics array<string>").withColumnRenamed("id", id_col)
