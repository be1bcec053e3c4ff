"""Retrieval: BM25, TF-IDF cosine, dense vectors, rank fusion, reranking, and a registry of modes."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.ranks import ranked
from lectern.operators.text import tfidf_parts

Scorer = Callable[[DataFrame, DataFrame], DataFrame]
RETRIEVERS: dict[str, Scorer] = {}


def retriever(name: str) -> Callable[[Scorer], Scorer]:
    """Register a function (docs (doc_id, text), queries (query_id, text)) -> (query_id, doc_id, score)."""

    def put(f: Scorer) -> Scorer:
        RETRIEVERS[name] = f
        return f

    return put


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, q): how often a query has the term."""
    return queries.select("query_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("q"))


@retriever("bm25")
def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25. A negative idf is epsilon times the mean idf of all terms, made positive. Only documents that share a term appear.

    Postings are counted within a document's row and keep the queries' terms alone; the document frequencies cover all and are counted with partial sums.
    """
    t = docs.select("doc_id", T.terms(F.col("text")).alias("t"))
    df = t.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    corpus = t.agg(F.count("*").alias("N"), F.sum(F.size("t")).alias("all"))  # a row
    idf = df.crossJoin(F.broadcast(corpus)).select("term", "N", "all", (F.log(F.col("N") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = idf.agg(F.avg("raw").alias("mean"))
    q = query_terms(queries)
    wanted = idf.join(q.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean)).select("term", (F.col("all") / F.col("N")).alias("avgdl"), F.when(F.col("raw") < 0, F.abs(epsilon * F.col("mean"))).otherwise(F.col("raw")).alias("idf"))
    tf = t.select("doc_id", F.size("t").alias("dl"), F.inline(T.counts(F.col("t")))).join(q.select("term").distinct(), "term", "left_semi")
    found = tf.join(q.join(wanted, "term"), "term")
    part = F.col("q") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return found.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


@retriever("tfidf")
def tfidf_cosine(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine of TF-IDF vectors; the query's uses the corpus' idf and terms. Norms take in all terms, weights only the queries'."""
    w, df, n = tfidf_parts(docs, "doc_id", "text")
    norms = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    q = query_terms(queries).join(df, "term").crossJoin(F.broadcast(n)).select("query_id", "term", (F.col("q") * (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1)).alias("wq"))
    q_norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("q_norm"))
    dots = w.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("wq")).alias("dot"))
    return dots.join(norms, "doc_id").join(q_norm, "query_id").select("query_id", "doc_id", (F.col("dot") / F.col("norm") / F.col("q_norm")).alias("score"))


def top_k(scores: DataFrame, k: int, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(query, item, score, rank): positive scores to six places, the greatest first, ties by item."""
    if k < 1:
        raise ValueError("k must be positive")
    rounded = scores.withColumn("score", F.round("score", 6)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item)).cast("long")
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)


def all_ranks(scores: DataFrame, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(query, item, score, rank) of all positive scores, to six places, ties by item; a query's items are sorted score range by score range."""
    rounded = scores.withColumn("score", F.round("score", 6)).where("score > 0")
    return ranked(rounded, [query], F.floor(-F.col("score") * 64), [F.desc("score"), F.col(item)])


def dense_top_k(items: DataFrame, queries: DataFrame, k: int, first: int | None = None, query_rows: int = 4096, item_rows: int = 65_536) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine of (vec_id, embedding) with each query (query_id, embedding), other than itself.

    Queries and items are cut into blocks by hash. A task compares one block of each
    and gives its own k best for each query, which alone are shuffled on. first
    compares the first so many dimensions only.
    """

    def unit(vectors: pd.Series) -> np.ndarray:
        x = np.array([np.asarray(v, float)[:first] for v in vectors])
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(f):
            return none
        ids, vectors, out = q.query_id.to_numpy(), unit(q.embedding), []
        for at in range(0, len(f), 2048):
            mine, s = f.vec_id.to_numpy()[at : at + 2048], np.round(vectors @ unit(f.embedding[at : at + 2048]).T, 6)
            s[ids[:, None] == mine[None]] = -np.inf
            order = np.lexsort((np.broadcast_to(mine, s.shape), -s), axis=1)[:, :k]
            rows = np.repeat(np.arange(len(ids)), order.shape[1])
            out.append(pd.DataFrame({"query_id": ids[rows], "doc_id": mine[order.ravel()], "score": s[rows, order.ravel()]}))
        return pd.concat(out).sort_values(["query_id", "score", "doc_id"], ascending=[True, False, True]).groupby("query_id").head(k) if len(out) > 1 else out[0]

    held = items.where("embedding IS NOT NULL").select("vec_id", "embedding")
    n = held.count()
    q_blocks = max(1, -(-queries.count() // query_rows))
    i_blocks = max(1, -(-n // item_rows), min(items.sparkSession.sparkContext.defaultParallelism, -(-n // 4096)))
    cut = lambda df, key, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    q = cut(queries.select("query_id", "embedding"), "query_id", "qb", q_blocks, "ib", i_blocks)
    i = cut(held, "vec_id", "ib", i_blocks, "qb", q_blocks)
    near = q.groupBy("qb", "ib").cogroup(i.groupBy("qb", "ib")).applyInPandas(best, "query_id bigint, doc_id bigint, score double")
    return top_k(near, k)


def dense_top_k_within(items: DataFrame, queries: DataFrame, k: int, owner: str = "owner", document: str = "document", query_rows: int = 4096, item_rows: int = 65_536) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine among the query's owner's items alone, and among its documents where it names some.

    items has (vec_id, owner, document, embedding), queries (query_id, owner, documents
    array or null, embedding). An owner's items and queries are cut into blocks by
    hash, as many as the owner has need of, and a task compares one block of each; a
    query is never compared with other owners' items. Ties go by item; null vectors
    and owners find nothing.
    """

    def best(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(f):
            x = np.array([np.asarray(v, float) for v in f.embedding])
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            ids, of = f.vec_id.to_numpy(), f.document.to_numpy()
            for query, documents, v in zip(q.query_id, q.documents, q.embedding, strict=True):
                v = np.asarray(v, float)
                may = ids != query if documents is None else (ids != query) & np.isin(of, documents)
                s = np.round(x[may] @ (v / max(np.linalg.norm(v), 1e-300)), 6)
                order = np.lexsort((ids[may], -s))[:k]
                out.append(pd.DataFrame({"query_id": query, "doc_id": ids[may][order], "score": s[order]}))
        return pd.concat(out)

    held = items.where(f"embedding IS NOT NULL AND {owner} IS NOT NULL").select(F.col("vec_id").alias("vec_id"), F.col(owner).alias("of"), F.col(document).alias("document"), F.col("embedding").alias("embedding"))
    asked = queries.where(f"embedding IS NOT NULL AND {owner} IS NOT NULL").select(F.col("query_id").alias("query_id"), F.col(owner).alias("of"), F.col("documents").alias("documents"), F.col("embedding").alias("embedding"))
    blocks = lambda df, rows, n: df.groupBy("of").agg(F.ceil(F.count("*") / rows).cast("int").alias(n))
    sizes = blocks(held, item_rows, "ni").join(blocks(asked, query_rows, "nq"), "of")
    cut = lambda df, key, own, n, other, m: df.join(sizes, "of").withColumn(own, F.pmod(F.xxhash64(key), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("ni", "nq")
    q, i = cut(asked, "query_id", "qb", "nq", "ib", "ni"), cut(held, "vec_id", "ib", "ni", "qb", "nq")
    near = q.groupBy("of", "qb", "ib").cogroup(i.groupBy("of", "qb", "ib")).applyInPandas(best, "query_id bigint, doc_id bigint, score double")
    return top_k(near, k)


def latest(rows: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """(key, at, ...): each key's row of the latest time, such as the last saved model of a document; of several at once the one of the greatest columns. Rows without a time count as the oldest."""
    best = F.max(F.struct(F.col(at), *columns))
    return rows.groupBy(key).agg(best.alias("__b")).select(key, *(F.col(f"__b.{c}") for c in (at, *columns)))


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, size: int = 64) -> DataFrame:
    """(id, embedding) by a built-in encoder: TF-IDF weights of a text's terms, summed by the terms' digest modulo the size and scaled to length 1.

    Each different text is encoded once; half its digest stands for it in the postings. A blank text is an error, as is a text without terms, whose vector would be zero.
    """
    blank = F.coalesce(F.trim(text_col), F.lit("")) == ""
    keyed = docs.select(F.col(id_col), F.when(blank, F.raise_error(F.lit("blank text"))).otherwise(F.col(text_col)).alias("__text")).withColumn("__key", F.substring(F.unhex(F.sha2("__text", 256)), 1, 16))
    texts = keyed.groupBy("__key").agg(F.min("__text").alias("__text"))
    w, _, _ = tfidf_parts(texts, "__key", "__text")
    place = F.pmod(F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")
    cells = w.groupBy("__key", place.alias("place")).agg(F.sum("w").alias("v"))
    held = cells.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))  # at most `size` cells a text
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("norm"))
    made = held.select("__key", vector.alias("embedding"))
    out = keyed.join(made, "__key", "left")
    return out.select(id_col, F.when(F.col("embedding").isNull(), F.raise_error(F.lit("a text without terms"))).otherwise(F.col("embedding")).alias("embedding"))


def rrf(dense: DataFrame, lexical: DataFrame, weight: float = 0.5, k: int = 60) -> DataFrame:
    """(query_id, doc_id, score): weight / (k + rank) of the one ranking plus (1 - weight) / (k + rank) of the other; a missing leg adds 0."""
    a = dense.select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    b = lexical.select("query_id", "doc_id", F.col("rank").alias("lexical_rank"))
    part = lambda w, r: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    return a.join(b, ["query_id", "doc_id"], "full_outer").withColumn("score", part(weight, "dense_rank") + part(1 - weight, "lexical_rank"))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets, within the row. Give columns: an expression would be worked out anew for each token."""
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def rerank(candidates: DataFrame, scorer: Column | None, k: int, most: int = 30) -> DataFrame:
    """The `most` first candidates (query_id, doc_id, rank, ...) in the order of the scorer, ties in the order before; without a scorer the order before."""
    few = candidates.where(F.col("rank") <= most).withColumn("rerank_score", scorer if scorer is not None else F.lit(None).cast("double"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank", "doc_id")
    return few.withColumn("final_rank", F.row_number().over(order).cast("long")).where(F.col("final_rank") <= k).withColumn("applied", F.lit(scorer is not None))


def gate(ranked: DataFrame, threshold: float) -> DataFrame:
    """(query_id, best, answered): a query whose best score is below the threshold is refused."""
    return ranked.groupBy("query_id").agg(F.max("score").alias("best")).withColumn("answered", F.col("best") >= threshold)


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, place, value): each label's mean vector in long form, by partial aggregation."""
    return vectors.select("label", F.posexplode("embedding").alias("place", "v")).groupBy("label", "place").agg(F.avg("v").alias("value"))


def nearest_centroid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, predicted) by the greatest dot product with a label's centroid, ties to the smaller label."""
    cells = vectors.select("vec_id", "label", F.posexplode("embedding").alias("place", "v"))
    c = centroids(vectors).withColumnRenamed("label", "candidate")
    scores = cells.join(c, "place").groupBy("vec_id", "label", "candidate").agg(F.round(F.sum(F.col("v") * F.col("value")), 6).alias("s"))
    return scores.groupBy("vec_id", "label").agg(F.min(F.struct((-F.col("s")).alias("s"), "candidate")).alias("b")).select("vec_id", "label", F.col("b.candidate").alias("predicted"))
