"""Evaluation: ranking, classification and text-overlap metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall, rr, ndcg) at k. ranked has (query_id, doc_id, rank), relevant (query_id, n_relevant, doc_id) pairs joined before as ranked.hit.

    Precision divides by k even if fewer came back; without relevant items all are 0.
    """
    if k < 1:
        raise ValueError("k must be positive")
    top = ranked.where(F.col("rank") <= k)
    gain = F.col("hit").cast("double") / F.log2(F.col("rank") + 1)
    per = top.groupBy("query_id").agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    none = F.col("n_relevant") == 0
    zero = lambda c: F.when(none, 0.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return relevant.join(per, "query_id", "left").select(
        "query_id", F.round(zero(F.col("hits") / k), 6).alias("precision"), F.round(zero(F.col("hits") / F.col("n_relevant")), 6).alias("recall"),
        F.round(zero(1 / F.col("first")), 6).alias("rr"), F.round(zero(F.when(~none, F.col("dcg") / F.when(~none, ideal))), 6).alias("ndcg"),
    )


def macro_ranking(per: DataFrame, *keys: str) -> DataFrame:
    """(keys, questions, precision, recall, mrr, ndcg): the means of ranking()'s metrics over questions."""
    mean = lambda c, name: F.round(F.avg(c) + 1e-9, 5).alias(name)
    return per.groupBy(*keys).agg(F.count("*").alias("questions"), *(mean(c, n) for c, n in (("precision", "precision"), ("recall", "recall"), ("rr", "mrr"), ("ndcg", "ndcg"))))


def entity_scores(truth: DataFrame, predicted: DataFrame, place: list[str]) -> DataFrame:
    """(label, precision, recall, f1) of entities, which count if label and place are the same; 0 where a denominator is 0."""
    side = lambda df, n: df.select("label", *place, F.lit(n).alias("side"))
    per = side(truth, 1).unionByName(side(predicted, 2)).groupBy("label", *place).agg(F.count_if(F.col("side") == 1).alias("t"), F.count_if(F.col("side") == 2).alias("p"))
    s = per.groupBy("label").agg(F.sum(F.least("t", "p")).alias("both"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return s.select("label", ratio("both", "p").alias("precision"), ratio("both", "t").alias("recall"), ratio(2 * F.col("both"), F.col("t") + F.col("p")).alias("f1"))


def bleu(counts: DataFrame, lengths: DataFrame, orders: int = 4) -> DataFrame:
    """(bleu,) in one row, 0 to 100: the geometric mean of clipped shares, less for a text shorter than the reference. counts are bleu_counts()', lengths (mine, theirs) in one row."""
    one = counts.agg(F.avg(F.log(F.col("clipped") / F.col("total"))).alias("m"), F.min("clipped").alias("least"), F.count("*").alias("n")).crossJoin(lengths)
    brief = F.when(F.col("mine") >= F.col("theirs"), 1.0).otherwise(F.exp(1 - F.col("theirs") / F.col("mine")))
    return one.select(F.round(100 * F.when((F.col("least") == 0) | (F.col("n") < orders), 0.0).otherwise(F.exp("m") * brief), 4).alias("bleu"))


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) of a confusion matrix; 0 where a denominator is 0."""
    t = matrix.select(F.col("truth").alias("label"), F.col("n").alias("truth"), F.lit(0).alias("predicted"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("both"))
    p = matrix.select(F.col("predicted").alias("label"), F.lit(0).alias("truth"), F.col("n").alias("predicted"), F.lit(0).alias("both"))
    s = t.unionByName(p).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("truth", "predicted", "both")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select("label", F.round(ratio("both", "predicted"), 6).alias("precision"), F.round(ratio("both", "truth"), 6).alias("recall"), F.round(ratio(2 * F.col("both"), F.col("truth") + F.col("predicted")), 6).alias("f1"))


def macro(matrix: DataFrame) -> DataFrame:
    """(accuracy, macro_precision, macro_recall, macro_f1) in one row."""
    m = per_class(matrix).agg(*(F.round(F.avg(c), 5).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    a = matrix.agg(F.round(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))
    return a.crossJoin(m)  # one row each


def overlap_counts(rows: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """(key, both, left, right): multiset overlap of two token arrays, by counting rather than comparing."""
    side = lambda c, n: rows.select(key, F.explode(c).alias("t"), F.lit(n).alias("side"))
    per = side(a, 1).unionByName(side(b, 2)).groupBy(key, "t").agg(F.count_if(F.col("side") == 1).alias("x"), F.count_if(F.col("side") == 2).alias("y"))
    return per.groupBy(key).agg(F.sum(F.least("x", "y")).alias("both"), F.sum("x").alias("left"), F.sum("y").alias("right"))


def f1_of(counts: DataFrame, name: str) -> DataFrame:
    return counts.withColumn(name, F.round(2 * F.col("both") / (F.col("left") + F.col("right")), 6))


def repeated_ngram_rate(rows: DataFrame, key: str, tokens: Column, n: int = 3) -> DataFrame:
    """(key, rate): the share of runs of n tokens that came before; 0 without any."""
    from lectern.functions.text import ngrams

    g = rows.select(key, tokens.alias("t")).select(key, ngrams(F.col("t"), n).alias("g"))
    return g.select(key, F.when(F.size("g") == 0, 0.0).otherwise(F.round(1 - F.size(F.array_distinct("g")) / F.size("g"), 6)).alias("rate"))


def bleu_counts(rows: DataFrame, key: str, a: Column, b: Column, orders: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(size, clipped, total) over all rows: the n-grams of a, and how many of them are matched in b, each as often as it is there."""
    from lectern.functions.text import ngrams

    side = lambda t, s: rows.select(key, t.alias("t")).select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("size"), ngrams(F.col("t"), n).alias("g")) for n in orders))).alias("x"), F.lit(s).alias("side")).select(key, "x.size", F.explode("x.g").alias("g"), "side")
    per = side(a, 1).unionByName(side(b, 2)).groupBy(key, "size", "g").agg(F.count_if(F.col("side") == 1).alias("x"), F.count_if(F.col("side") == 2).alias("y"))
    return per.groupBy("size").agg(F.sum(F.least("x", "y")).alias("clipped"), F.sum("x").alias("total"))


def unigram_perplexity(counts: DataFrame, key: str) -> DataFrame:
    """(key, perplexity) of (key, term, tf) under the corpus' unigram model, each count plus one."""
    c = counts.groupBy("term").agg(F.sum("tf").alias("c"))
    total = c.agg((F.sum("c") + F.count("*")).alias("total"))
    p = counts.join(c, "term").crossJoin(F.broadcast(total))  # one row
    mean = F.sum(F.col("tf") * F.log((F.col("c") + 1) / F.col("total"))) / F.sum("tf")
    return p.groupBy(key).agg(F.round(F.exp(-mean), 4).alias("perplexity"))


def rouge_l(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, rouge_l): F1 of the longest common subsequence of words."""
    import pandas as pd

    words = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z0-9]+"), F.lit(0))

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p: list[str], q: list[str]) -> float:
            row = [0] * (len(q) + 1)
            for w in p:
                left = 0
                for j, v in enumerate(q, 1):
                    old = row[j]
                    row[j] = left + 1 if w == v else max(row[j], row[j - 1])
                    left = old
            return 2 * row[-1] / (len(p) + len(q)) if len(p) + len(q) else 0.0

        return pd.Series([one(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype=float)

    return rows.select(*keys, F.round(score(words(a), words(b)), 6).alias("rouge_l"))
