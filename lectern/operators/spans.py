"""Range and overlap joins, runs of labels, span choice."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(ranges: DataFrame, points: DataFrame, key: str, place: str, first: str, last: str, width: int = 64) -> DataFrame:
    """points joined with the ranges of their key that hold their place, both ends included.

    Both are dealt to cells of the width, so a key's points meet only the ranges near them.
    """
    cells = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    return points.withColumn("__cell", F.floor(F.col(place) / width)).join(cells, [key, "__cell"]).where(F.col(place).between(F.col(first), F.col(last))).drop("__cell")


def overlapping(a: DataFrame, b: DataFrame, key: str, a_ends: tuple[str, str], b_ends: tuple[str, str], width: int = 1024) -> DataFrame:
    """Rows of a and b of one key whose ranges overlap.

    Both are dealt to cells of the width; a pair is made in the first cell that it
    shares, so a long key's ranges meet only near each other.
    """
    (p, q), (r, s) = a_ends, b_ends
    cells = lambda df, x, y: df.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(x) / width), F.floor(F.col(y) / width))))
    both = cells(a, p, q).join(cells(b, r, s), [key, "__cell"])
    return both.where((F.col(q) >= F.col(r)) & (F.col(p) <= F.col(s)) & (F.col("__cell") == F.greatest(F.floor(F.col(p) / width), F.floor(F.col(r) / width)))).drop("__cell")


def runs(rows: DataFrame, key: str, pos: str, label: str, text: str) -> DataFrame:
    """(key, label, first, last, text): unbroken runs of one non-null label."""
    held = rows.where(F.col(label).isNotNull())
    island = F.col(pos) - F.row_number().over(Window.partitionBy(key, label).orderBy(pos))
    words = F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text])
    return held.withColumn("island", island).groupBy(key, label, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.array_join(words, " ").alias("text")).drop("island")


def aligned_labels(pieces: DataFrame, words: DataFrame, key: str, ignored: int = -100, width: int = 1024) -> DataFrame:
    """(key, pos, label): a word's label on the first of the pieces that begin within it, `ignored` on its others and on pieces outside words.

    pieces has (key, pos, begin, end), words (key, begin, end, label), in places of the
    key's text, ends exclusive; a piece that begins with blanks gives the place after
    them. Pieces meet only words near them. A null label, or a piece of no length, is ignored.
    """
    held = words.where("end > begin AND label IS NOT NULL").select(key, F.col("begin").alias("__first"), (F.col("end") - 1).alias("__last"), "label")
    met = within(held, pieces.where("end > begin").select(key, "pos", "begin"), key, "begin", "__first", "__last", width)
    first = met.groupBy(key, "__first").agg(F.min(F.struct("begin", "pos", "label")).alias("b")).select(key, F.col("b.pos").alias("pos"), "b.label")
    return pieces.select(key, "pos").join(first, [key, "pos"], "left").select(key, "pos", F.coalesce("label", F.lit(ignored)).alias("label"))


def stride_windows(rows: DataFrame, key: str, n: str, length: int = 384, stride: int = 128) -> DataFrame:
    """(key, window, first, last): windows of so many of n places, each beginning `stride` before the end of the one before; none of 0 places."""
    step = length - stride
    count = F.greatest(F.lit(0), F.ceil((F.col(n) - length) / step)).cast("long")
    w = rows.where(F.col(n) > 0).select(key, n, F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("window"))
    return w.select(key, "window", (F.col("window") * step).alias("first"), (F.least(F.col("window") * step + length, F.col(n)) - 1).alias("last"))


def best_span(start: Column, end: Column, longest: int) -> Column:
    """struct(i, j, score) of the greatest start[i] + end[j], to six places, with i <= j < i + longest; the first of equals. Within the row."""
    from_ = F.sequence(F.lit(0), F.size(start) - 1)
    pairs = F.flatten(F.transform(from_, lambda i: F.transform(F.sequence(i, F.least(i + longest, F.size(end)) - 1), lambda j: F.struct((-F.round(F.get(start, i).cast("double") + F.get(end, j).cast("double"), 6)).alias("s"), i.alias("i"), j.alias("j")))))
    best = F.array_min(pairs)
    return F.struct(best["i"].alias("i"), best["j"].alias("j"), (-best["s"]).alias("score"))
