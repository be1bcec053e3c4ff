"""Queries of retrieval and its metrics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answers, fusion, metrics, retrieval, word_vectors
from lectern.plans.registry import query
from lectern.plans.texts import SENTENCES_SQL, STOP_SQL, TFIDF_SQL, docs
from lectern.sources.tables import read

QTERMS_SQL = f"""qt AS (SELECT item_id AS query_id, term, count(*) AS q FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '{T.WORD}{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x))) AS term FROM benchmark) GROUP BY ALL)"""
BM25_SQL = f"""{TFIDF_SQL}, {QTERMS_SQL}, dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id), c AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) AS total),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, c), idf AS (SELECT term, CASE WHEN raw < 0 THEN abs(0.25 * (SELECT avg(raw) FROM raw)) ELSE raw END AS idf FROM raw),
bm AS (SELECT query_id, doc_id, sum(q * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (total / n)))) AS s FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), c GROUP BY query_id, doc_id),
bm25 AS (SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM bm WHERE round(s, 6) > 0)"""
COSINE_SQL = """qw AS (SELECT query_id, term, q * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM qt JOIN df USING (term)), qn AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS wq FROM qw),
cs AS (SELECT query_id, doc_id, sum(weight * wq) AS s FROM tfidf JOIN qn USING (term) GROUP BY query_id, doc_id),
cosine AS (SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM cs WHERE round(s, 6) > 0)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")


@query(f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(retrieval.bm25(docs(spark, sf_dir), questions(spark, sf_dir)), 5)


@query(f"WITH {TFIDF_SQL}, {QTERMS_SQL}, {COSINE_SQL} SELECT query_id, doc_id, score, rank FROM cosine WHERE rank <= 5")
def tfidf_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(retrieval.tfidf_cosine(docs(spark, sf_dir), questions(spark, sf_dir)), 5)


RRF_SQL = f"""{BM25_SQL}, {COSINE_SQL}, fused AS (SELECT query_id, doc_id, coalesce(0.5::DOUBLE / (60 + c.rank), 0.0) + coalesce(0.5::DOUBLE / (60 + b.rank), 0.0) AS s
FROM cosine c FULL JOIN bm25 b USING (query_id, doc_id)),
rrf AS (SELECT query_id, doc_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM fused)"""


@query(f"WITH {RRF_SQL} SELECT * FROM rrf WHERE rank <= 10")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fused_top_k(docs(spark, sf_dir), questions(spark, sf_dir), 10)


@query(f"WITH {BM25_SQL} SELECT query_id, max(score) AS best, max(score) >= 40 AS answered FROM bm25 GROUP BY query_id")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.gate(retrieval.top_k(retrieval.bm25(docs(spark, sf_dir), questions(spark, sf_dir)), 1), 40)


@query(f"""WITH {BM25_SQL}, few AS (SELECT * FROM bm25 WHERE rank <= 10), side AS (SELECT f.query_id, f.doc_id, unnest(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS t, 1 AS side FROM few f JOIN benchmark b ON item_id = query_id
UNION ALL SELECT f.query_id, f.doc_id, unnest(regexp_extract_all(lower(d.text), '[a-z0-9]+')), 2 FROM few f JOIN documents d USING (doc_id)),
per AS (SELECT query_id, doc_id, t, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 2) AS y FROM side GROUP BY ALL), s AS (SELECT query_id, doc_id, round(2.0::DOUBLE * sum(least(x, y)) / (sum(x) + sum(y)), 6) AS rerank_score FROM per GROUP BY ALL)
SELECT query_id, doc_id, rank, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, rank, doc_id) AS final_rank, true AS applied FROM few JOIN s USING (query_id, doc_id) QUALIFY final_rank <= 5""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = docs(spark, sf_dir), questions(spark, sf_dir)
    few = retrieval.top_k(retrieval.bm25(d, q), 10).drop("score")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    joined = few.join(q.select("query_id", words(F.col("text")).alias("question")), "query_id").join(d.select("doc_id", words(F.col("text")).alias("words")), "doc_id")
    f1 = F.round(retrieval.token_f1(F.col("question"), F.col("words")), 6)
    return retrieval.rerank(joined, f1, 5, most=10).drop("question", "words")


_NEAR = "len(list_filter(asked[greatest(1, i - 8):i + 8], lambda x: x))"
_BASE = f"0.5 * {_NEAR} + CASE WHEN NOT asked[i] AND NOT list_contains({STOP_SQL}, lower(words[i].txt)) THEN 1.0 ELSE -2.0 END + CASE WHEN regexp_matches(words[i].txt, '^[\\p{{Lu}}\\p{{N}}]') THEN 0.5 ELSE 0.0 END"
_TOP = lambda field: f"list_sort(list_transform(tokens, lambda t, i: {{'s': -t.{field}, 'i': i - 1}}))[1:20]"
_SHARE = lambda field, at: f"exp(tokens[{at} + 1].{field} - list_max(list_transform(tokens, lambda t: t.{field}))) / list_sum(list_transform(tokens, lambda t: exp(t.{field} - list_max(list_transform(tokens, lambda u: u.{field})))))"
ANSWERS_SQL = rf"""{BM25_SQL}, few AS (SELECT query_id, doc_id, rank FROM bm25 WHERE rank <= 3), qv AS (SELECT query_id, list(term) AS terms FROM qt GROUP BY query_id),
se AS (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents JOIN (SELECT DISTINCT doc_id FROM few) USING (doc_id)), pa AS (SELECT doc_id, unnest(range((len(s) + 7) // 8)) AS passage, s FROM se),
pc AS (SELECT query_id, doc_id, rank, passage, terms, array_to_string(s[passage * 8 + 1:passage * 8 + 8], ' ') AS context FROM few JOIN pa USING (doc_id) JOIN qv USING (query_id)),
pi AS (SELECT *, regexp_extract_all(context, '{answers.PIECE}') AS pieces FROM pc),
pw AS (SELECT *, list_filter(list_transform(pieces, lambda p, i: {{'txt': p, 'start': length(array_to_string(pieces[1:i - 1], '')), 'tail': coalesce(pieces[i + 1], '')}}), lambda x: regexp_matches(x.txt, '^{T.WORD}')) AS words FROM pi),
pq AS (SELECT *, list_transform(words, lambda w: list_contains(terms, lower(w.txt))) AS asked FROM pw),
tk AS (SELECT query_id, doc_id, rank, passage, context, list_transform(range(1, len(words) + 1), lambda i: {{'start': words[i].start, 'stop': words[i].start + length(words[i].txt), 's': 4.0 * ({_BASE}), 'f': 4.0 * ({_BASE} + CASE WHEN words[i].tail = ' ' THEN 0.0 ELSE 0.25 END)}}) AS tokens FROM pq WHERE len(words) > 0),
tp AS (SELECT *, {_TOP("s")} AS a, {_TOP("f")} AS b FROM tk),
sp AS (SELECT *, list_max(flatten(list_transform(a, lambda x: list_transform(list_filter(b, lambda y: y.i >= x.i AND y.i - x.i < 30), lambda y: {{'score': -x.s - y.s, 'i': x.i, 'j': y.i}})))) AS best FROM tp),
an AS (SELECT query_id, doc_id, rank, passage, round({_SHARE("s", "best.i")} * {_SHARE("f", "best.j")}, 6) AS confidence, tokens[best.i + 1].start AS starts, tokens[best.j + 1].stop AS stops, substring(context, tokens[best.i + 1].start + 1, tokens[best.j + 1].stop - tokens[best.i + 1].start) AS answer FROM sp WHERE best IS NOT NULL),
be AS (SELECT * FROM an WHERE confidence >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, rank, doc_id, passage) = 1)"""


@query(f"""WITH {ANSWERS_SQL} SELECT item_id AS query_id, be.query_id IS NOT NULL AS found, coalesce(answer, '{answers.NOT_FOUND}') AS answer, confidence, starts AS begins, stops AS ends, doc_id, passage,
CASE WHEN be.query_id IS NULL THEN '{answers.NOT_FOUND}' ELSE answer || ' [doc_' || doc_id || ', p.' || (passage + 1) || ']' END AS reply FROM benchmark LEFT JOIN be ON be.query_id = item_id""")
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the benchmark items from the passages of the three best documents by BM25, with a lexical reader."""
    d, q = docs(spark, sf_dir), questions(spark, sf_dir)
    few = retrieval.top_k(retrieval.bm25(d, q), 3).select("query_id", "doc_id", "rank")
    terms = q.select("query_id", F.array_distinct(T.terms(F.col("text"))).alias("terms"))
    asked = few.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", "rank")).alias("asked"))  # joined once: the ranking is not worked out again
    parts = answers.passages(d.select("doc_id", "text").join(asked, "doc_id").select(F.struct("doc_id", "asked").alias("of"), "text"), "of", "text")
    met = parts.select("of.doc_id", F.inline("of.asked"), "passage", "context").join(terms, "query_id")
    rows = met.repartition(spark.sparkContext.defaultParallelism * 4)  # a passage's bytes are few, but it takes long to read
    read_ = rows.select("query_id", "context", F.struct("rank", "doc_id", "passage").alias("place"), answers.lexical_reader(F.col("context"), F.col("terms")).alias("tokens"))
    out = answers.extract(q, read_)
    reply = F.when(F.col("found"), F.concat("answer", F.lit(" [doc_"), "doc_id", F.lit(", p."), F.col("passage") + 1, F.lit("]"))).otherwise(F.col("answer"))
    return out.select("query_id", "found", "answer", "confidence", F.col("begin").alias("begins"), F.col("end").alias("ends"), "place.doc_id", "place.passage").withColumn("reply", reply)


DENSE_SQL = """q AS (SELECT vec_id AS query_id, embedding AS e, label AS q_label FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT query_id, q_label, vec_id AS doc_id, label, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> query_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds WHERE score > 0)"""


def vector_queries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = read(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


@query(f"WITH {DENSE_SQL} SELECT query_id, doc_id, score, rank FROM dense WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = vector_queries(spark, sf_dir)
    return retrieval.dense_top_k(e, q, 10)


@query("""WITH q AS (SELECT vec_id AS query_id, label AS owner, CASE WHEN vec_id % 100 = 0 THEN [vec_id % 7, (vec_id + 1) % 7] END AS documents, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings ON label = owner AND vec_id <> query_id AND (documents IS NULL OR list_contains(documents, vec_id % 7)))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 10""")
def owned_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search among the vectors of the query's label, and for every other query in two of seven documents."""
    e = read(spark, sf_dir, "embeddings").withColumnsRenamed({"label": "owner"}).withColumn("document", F.col("vec_id") % 7)
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "owner", F.when(F.col("vec_id") % 100 == 0, F.array(F.col("vec_id") % 7, (F.col("vec_id") + 1) % 7)).alias("documents"), "embedding")
    return retrieval.dense_top_k_within(e, q, 10)


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_type, event_id)) AS event_type, arg_max(event_id, (ts, event_type, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each learner's latest event, as the latest model of a document."""
    return retrieval.latest(read(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


def hits(e: DataFrame, q: DataFrame, ranked: DataFrame) -> DataFrame:
    labels = e.select(F.col("vec_id").alias("doc_id"), "label")
    return ranked.join(labels, "doc_id").join(q.select("query_id", F.col("label").alias("q_label")), "query_id").withColumn("hit", F.col("label") == F.col("q_label"))


@query(f"""WITH {DENSE_SQL}, rel AS (SELECT query_id, (SELECT count(*) FROM embeddings WHERE label = q_label) - 1 AS n_relevant FROM q),
per AS (SELECT query_id, count(*) FILTER (label = q_label) AS hits, min(rank) FILTER (label = q_label) AS first, sum(CASE WHEN label = q_label THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM dense WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, round(hits / 10, 6) AS precision, round(hits / n_relevant, 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr,
round(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM rel JOIN per USING (query_id)""")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, q = vector_queries(spark, sf_dir)
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    return metrics.ranking(hits(e, q, retrieval.dense_top_k(e, q, 10)), q.join(sizes, "label").select("query_id", "n_relevant"), 10)


@query(f"""WITH {DENSE_SQL}, hs AS (SELECT query_id, q_label, vec_id AS doc_id, label, round(list_cosine_similarity(e[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[]), 6) AS score FROM q, embeddings WHERE vec_id <> query_id),
head AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hs WHERE score > 0)
SELECT query_id, bool_or(full_) AS full_hit, bool_or(head_) AS head_hit FROM (SELECT query_id, label = q_label AS full_, false AS head_ FROM dense WHERE rank <= 5 UNION ALL SELECT query_id, false, label = q_label FROM head WHERE rank <= 5) GROUP BY query_id HAVING bool_or(full_) <> bool_or(head_)""")
def mode_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries where only the full vectors or only their first 16 dimensions find a relevant item in the first five."""
    e, q = vector_queries(spark, sf_dir)
    legs = [hits(e, q, retrieval.dense_top_k(e, q, 5, n)).select("query_id", (F.col("hit") & F.lit(n is None)).alias("full_"), (F.col("hit") & F.lit(n is not None)).alias("head_")) for n in (None, 16)]
    wins = legs[0].unionByName(legs[1]).groupBy("query_id").agg(F.bool_or("full_").alias("full_hit"), F.bool_or("head_").alias("head_hit"))
    return wins.where(F.col("full_hit") != F.col("head_hit"))


CENTROID_SQL = """cell AS (SELECT vec_id, label, unnest(range(len(embedding))) AS place, unnest(embedding)::DOUBLE AS v FROM embeddings), cen AS (SELECT label AS candidate, place, avg(v) AS value FROM cell GROUP BY ALL),
sc AS (SELECT vec_id, label, candidate, round(sum(v * value), 6) AS s FROM cell JOIN cen USING (place) GROUP BY vec_id, label, candidate), pred AS (SELECT vec_id, label, arg_min(candidate, (-s, candidate)) AS predicted FROM sc GROUP BY vec_id, label),
matrix AS (SELECT label AS truth, predicted, count(*) AS n FROM pred GROUP BY ALL)"""


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return metrics.confusion(retrieval.nearest_centroid(e), "label", "predicted")


@query(f"WITH {CENTROID_SQL} SELECT * FROM matrix")
def centroid_classify_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir)


@query(f"""WITH {CENTROID_SQL}, l AS (SELECT truth AS label FROM matrix UNION SELECT predicted FROM matrix), c AS (SELECT label, coalesce((SELECT sum(n) FROM matrix WHERE truth = label), 0)::BIGINT AS t, coalesce((SELECT sum(n) FROM matrix WHERE predicted = label), 0)::BIGINT AS p,
coalesce((SELECT sum(n) FROM matrix WHERE truth = label AND predicted = label), 0)::BIGINT AS b FROM l), k AS (SELECT round(coalesce(b / nullif(p, 0), 0), 6) AS precision, round(coalesce(b / nullif(t, 0), 0), 6) AS recall, round(coalesce(2 * b / nullif(t + p, 0), 0), 6) AS f1 FROM c)
SELECT (SELECT round(sum(CASE WHEN truth = predicted THEN n ELSE 0 END) / sum(n), 6) FROM matrix) AS accuracy, round(avg(precision), 5) AS macro_precision, round(avg(recall), 5) AS macro_recall, round(avg(f1), 5) AS macro_f1 FROM k""")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro(matrix(spark, sf_dir))


@query("""WITH p AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text AS question FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user'),
side AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS t, 1 AS side FROM p UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')), 2 FROM p),
per AS (SELECT conv_id, turn, t, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 2) AS y FROM side GROUP BY ALL)
SELECT conv_id || ':' || turn AS pair, sum(least(x, y))::BIGINT AS both, sum(x)::BIGINT AS "left", sum(y)::BIGINT AS "right", round(2 * sum(least(x, y)) / (sum(x) + sum(y)), 6) AS rouge_1 FROM per GROUP BY conv_id, turn""")
def rouge_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1 F1 of each answer against the question before it."""
    c = read(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    p = a.join(u, ["conv_id", "turn"]).withColumn("pair", F.concat_ws(":", "conv_id", "turn"))
    words = lambda c: F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z0-9]+"), F.lit(0))
    return metrics.f1_of(metrics.overlap_counts(p, "pair", words("answer"), words("question")), "rouge_1")


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w)
SELECT doc_id, CASE WHEN len(g) = 0 THEN 0 ELSE round(1 - len(list_distinct(g)) / len(g), 6) END AS rate FROM g""")
def repeated_trigram_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.repeated_ngram_rate(docs(spark, sf_dir), "doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))


@query("""WITH x AS (SELECT a.vec_id AS query_id, b.vec_id AS b, c.vec_id AS c, list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE + c.embedding[i]::DOUBLE) AS e
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS score FROM x, embeddings WHERE vec_id NOT IN (query_id, b, c))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5""")
def analogy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors to a - b + c, none of the three included."""
    e = read(spark, sf_dir, "embeddings")
    a = e.where("vec_id % 50 = 0").select("vec_id", F.col("embedding").alias("a"))
    shifted = lambda n, name: e.select((F.col("vec_id") - n).alias("vec_id"), F.col("embedding").alias(name))
    x = a.join(shifted(1, "b"), "vec_id").join(shifted(2, "c"), "vec_id")
    d = lambda v: v.cast("double")
    q = x.select(F.col("vec_id").alias("query_id"), F.transform(F.arrays_zip("a", "b", "c"), lambda v: d(v["a"]) - d(v["b"]) + d(v["c"])).alias("embedding"))
    near = retrieval.dense_top_k(e, q, 8).where("doc_id - query_id NOT BETWEEN 0 AND 2")
    return retrieval.top_k(near.drop("rank"), 5)


@query()
def word2vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents nearest to each question by mean CBOW vectors, a model for each language; four passes in all."""
    d = docs(spark, sf_dir).select("doc_id", "text", "lang")
    return word_vectors.top_k(d, questions(spark, sf_dir), word_vectors.cbow(d, "text", "lang", rounds=2, passes=2), 5, "lang")
