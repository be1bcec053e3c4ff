"""Likeness of short strings: the share of matching blocks, and a table of words for close spellings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _codes(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("utf-32-le"), np.uint32)


def _popular(b: np.ndarray) -> np.ndarray:
    """The characters that a second string of 200 or more holds too often to begin a block: more than one in a hundred, and one more."""
    values, counts = np.unique(b, return_counts=True)
    return values[counts > len(b) // 100 + 1] if len(b) >= 200 else values[:0]


def _longest_run(a: np.ndarray, b: np.ndarray, rare: np.ndarray) -> tuple[int, int, int]:
    """(i, j, n) of the longest common run of characters marked rare in b, the first in a and then in b; then it grows over equal characters on both sides."""
    best = (0, 0, 0)
    before = np.zeros(len(b), np.int64)
    for i, c in enumerate(a):
        now = np.zeros(len(b), np.int64)
        same = (b == c) & rare
        now[same] = 1
        now[1:][same[1:]] += before[:-1][same[1:]]
        if len(now) and (n := int(now.max())) > best[2]:
            best = (i - n + 1, int(now.argmax()) - n + 1, n)
        before = now
    i, j, n = best
    while i and j and a[i - 1] == b[j - 1]:
        i, j, n = i - 1, j - 1, n + 1
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    return i, j, n


def _short_run(a: str, b: str) -> tuple[int, int, int]:
    """_longest_run() of short strings, of which all characters may begin a block."""
    best, before = (0, 0, 0), [0] * (len(b) + 1)
    for i, c in enumerate(a):
        now = [0] * (len(b) + 1)
        for j, d in enumerate(b):
            if c == d:
                n = now[j + 1] = before[j] + 1
                if n > best[2]:
                    best = (i - n + 1, j - n + 1, n)
        before = now
    return best


def matching(a: str, b: str) -> int:
    """How many characters lie in matching blocks: the longest common run, and those on its left and on its right in turn."""
    short = len(b) < 200 and len(a) < 200
    x, y = (a, b) if short else (_codes(a), _codes(b))
    rare = None if short else ~np.isin(y, _popular(y))
    total, todo = 0, [(0, len(x), 0, len(y))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 == i1 or j0 == j1:
            continue
        i, j, n = _short_run(x[i0:i1], y[j0:j1]) if short else _longest_run(x[i0:i1], y[j0:j1], rare[j0:j1])
        if n:
            total += n
            todo += [(i0, i0 + i, j0, j0 + j), (i0 + i + n, i1, j0 + j + n, j1)]
    return total


def ratio(a: Column, b: Column) -> Column:
    """2 * matching characters / all characters, 1 for two empty strings; null where one is null. The order of the strings matters."""

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            out.append(None if x is None or y is None else 1.0 if not x and not y else 2 * matching(x, y) / (len(x) + len(y)))
        return pa.array(out, pa.float64())

    return of(a, b)


def deletions(word: Column, most: int = 1) -> Column:
    """The word and all that is left of it when up to `most` characters are taken out, each once."""
    out = F.array(word)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))))
    return out


def close_spellings(asked: DataFrame, vocabulary: DataFrame, least: float = 0.65, edits: int = 2, most: int = 3) -> DataFrame:
    """(word, suggestion, score, rank): the words of the vocabulary nearest to each asked word that it does not hold.

    Candidates have the same first letter, a length that differs by at most `edits`
    and an edit distance of at most `edits`; they meet through what is left of both
    when up to so many characters are taken out, so that no two words are compared
    that share no such key (a bound on edits stands where a share of the length would
    ask for all pairs). The score is the ratio of matching blocks and at least
    `least`; the greatest come first, ties by word. Both tables have (word); words
    are taken in lower case, null and empty ones are left out.
    """
    clean = lambda df: df.select(F.lower("word").alias("word")).where("word <> ''").distinct()
    known = clean(vocabulary)
    unknown = clean(asked).join(known, "word", "left_anti")
    keys = lambda df: df.select("word", F.substring("word", 1, 1).alias("initial"), F.explode(deletions(F.col("word"), edits)).alias("key"))
    wanted = keys(unknown)
    near = keys(known).join(wanted.select("initial", "key").distinct(), ["initial", "key"], "left_semi").withColumnRenamed("word", "suggestion")
    pairs = wanted.join(near, ["initial", "key"]).select("word", "suggestion").distinct()
    pairs = pairs.where((F.abs(F.length("word") - F.length("suggestion")) <= edits) & (F.levenshtein("word", "suggestion") <= edits))
    scored = pairs.withColumn("score", F.round(ratio(F.col("word"), F.col("suggestion")), 6)).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "suggestion")).cast("long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)
