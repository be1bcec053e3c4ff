"""Queries of filters, range joins, spans and further metrics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answers, metrics, models, ranks, spans, text
from lectern.plans.registry import query
from lectern.plans.texts import STOP_SQL, docs
from lectern.sources.tables import read

LINES_SQL = r"ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), line AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM ls)"


@query("SELECT doc_id, source, n_chars FROM documents WHERE text ILIKE '%tion%' AND lang IN ('en', 'fr') AND n_chars BETWEEN 200 AND 5000 AND source IS NOT NULL")
def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.col("text").ilike("%tion%") & F.col("lang").isin("en", "fr") & F.col("n_chars").between(200, 5000) & F.col("source").isNotNull()).select("doc_id", "source", "n_chars")


@query("SELECT doc_id FROM documents WHERE instr(lower(concat_ws(' ', source, lang, text)), 'src1 en') > 0")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.instr(F.lower(F.concat_ws(" ", "source", "lang", "text")), "src1 en") > 0).select("doc_id")


@query("SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the')")
def topic_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).where(F.array_contains(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), "the")).select("doc_id")


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def report_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a status or named by another table: two semi-joined branches, united."""
    o = read(spark, sf_dir, "orders")
    named = o.join(read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return o.where("o_orderstatus = 'P'").select("o_orderkey").unionByName(named.select("o_orderkey")).distinct()


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_of_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query(r"""SELECT doc_id, regexp_matches(regexp_replace(text, '\b(?:C\+\+|C#|F#)', '', 'g'), '[\p{S}\x{200d}\x{fe0f}]') AS clutter FROM documents""")
def symbol_clutter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.has_symbols(F.col("text")).alias("clutter"))


@query(rf"""WITH {LINES_SQL} SELECT doc_id, pos, line FROM line WHERE length(line) <= 120 AND regexp_matches(line, '^[\p{{L}}\p{{N}}]') AND NOT regexp_matches(line, '[.!?]') AND NOT regexp_matches(lower(line), '\b(quiz|answer|question)') AND NOT (len(regexp_split_to_array(line, '\s+')) >= 8 AND regexp_matches(lower(line), '{T.whole("is|are|was|est|ist|des")}'))""")
def title_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that may be section titles; a long one with a verb is none."""
    line = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))
    return line.where((F.length("line") <= 120) & F.col("line").rlike(r"^[\p{L}\p{N}]") & ~F.col("line").rlike("[.!?]") & ~F.lower("line").rlike(r"\b(quiz|answer|question)") & ~((F.size(F.split("line", r"\s+")) >= 8) & F.lower("line").rlike(T.whole("is|are|was|est|ist|des"))))


@query(f"""WITH {LINES_SQL}, term AS (SELECT doc_id, pos, unnest(list_filter(regexp_extract_all(lower(line), '{T.WORD}{{2,}}'), lambda x: x LIKE 'th%' AND NOT list_contains({STOP_SQL}, x))) AS term FROM line),
chunk AS (SELECT doc_id, pos // 5 AS chunk, min(pos) AS first, max(pos) AS last FROM line GROUP BY ALL)
SELECT doc_id, chunk, count(*) AS terms FROM chunk JOIN term USING (doc_id) WHERE pos BETWEEN first AND last GROUP BY doc_id, chunk""")
def terms_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join: terms whose line lies within a chunk's lines."""
    line = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    term = line.select("doc_id", "pos", F.explode(T.terms(F.col("line"))).alias("term")).where("term LIKE 'th%'")
    chunk = line.groupBy("doc_id", F.expr("CAST(pos div 5 AS BIGINT)").alias("chunk")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return spans.within(chunk, term, "doc_id", "pos", "first", "last").groupBy("doc_id", "chunk").agg(F.count("*").alias("terms"))


@query("""WITH a AS (SELECT doc_id, unnest(range(n_chars // 400 + 1)) AS k FROM documents), b AS (SELECT doc_id, unnest(range(n_chars // 700 + 1)) AS j FROM documents)
SELECT doc_id, k AS section, count(*) AS chunks FROM a JOIN b USING (doc_id) WHERE k * 400 + 399 >= j * 700 AND k * 400 <= j * 700 + 699 GROUP BY doc_id, k""")
def section_chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An overlap join: sections of 400 characters with chunks of 700."""
    cut = lambda name, n: docs(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n_chars div {n}"))).alias(name)).withColumns({f"{name}_start": F.col(name) * n, f"{name}_end": F.col(name) * n + n - 1})
    return spans.overlapping(cut("section", 400), cut("chunk", 700), "doc_id", ("section_start", "section_end"), ("chunk_start", "chunk_end")).groupBy("doc_id", "section").agg(F.count("*").alias("chunks"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{T.TOKEN.replace("'", "''")}') AS w FROM documents), t AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM w),
c AS (SELECT doc_id, pos, token, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM t WHERE regexp_matches(token, '^\p{{Lu}}'))
SELECT doc_id, min(pos) AS first, max(pos) AS last, string_agg(token, ' ' ORDER BY pos) AS entity FROM c GROUP BY doc_id, island""")
def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised tokens as entity spans."""
    t = docs(spark, sf_dir).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token")).withColumn("label", F.when(F.col("token").rlike(r"^\p{Lu}"), "ENT"))
    return spans.runs(t, "doc_id", "pos", "label", "token").select("doc_id", F.col("first").cast("long"), F.col("last").cast("long"), F.col("text").alias("entity"))


@query("""WITH x AS (SELECT vec_id, unnest(range(32)) AS i, embedding FROM embeddings), p AS (SELECT vec_id, i, unnest(range(i, least(i + 30, 32))) AS j, embedding FROM x),
s AS (SELECT vec_id, i, j, round(embedding[i + 1]::DOUBLE + embedding[33 + j]::DOUBLE, 6) AS s FROM p) SELECT vec_id, arg_min(i, (-s, i, j)) AS "start", arg_min(j, (-s, i, j)) AS "end", max(s) AS score FROM s GROUP BY vec_id""")
def qa_span_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best start and end by their logits' sum, the end not before the start and fewer than 30 places on; the two halves of each vector stand for the logits."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return e.select("vec_id", spans.best_span(F.col("a"), F.col("b"), 30).alias("x")).select("vec_id", F.col("x.i").cast("long").alias("start"), F.col("x.j").cast("long").alias("end"), F.col("x.score").alias("score"))


BLEU_PART = """SELECT {n} AS size, sum(least(x, y))::BIGINT AS clipped, sum(x)::BIGINT AS total FROM (SELECT pair, g, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 2) AS y FROM (
  SELECT pair, 1 AS side, unnest(list_transform(range(1, len(a) - {m}), lambda i: array_to_string(a[i:i + {k}], ' '))) AS g FROM p UNION ALL SELECT pair, 2, unnest(list_transform(range(1, len(b) - {m}), lambda i: array_to_string(b[i:i + {k}], ' '))) FROM p) GROUP BY ALL)"""


@query("""WITH p AS (SELECT a.conv_id || ':' || a.turn AS pair, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS a, regexp_extract_all(lower(u.text), '[a-z0-9]+') AS b FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1) """ + " UNION ALL ".join(BLEU_PART.format(n=n, m=n - 2, k=n - 1) for n in (1, 2, 3, 4)))
def corpus_bleu_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped and all n-grams of each turn against the turn before, summed over the corpus."""
    c = read(spark, sf_dir, "conversations")
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    p = c.select("conv_id", "turn", "text").join(u, ["conv_id", "turn"]).withColumn("pair", F.concat_ws(":", "conv_id", "turn"))
    return metrics.bleu_counts(p, "pair", *(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)) for x in ("text", "reference")))


@query(f"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{T.WORD}{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x))) AS term FROM documents), c AS (SELECT term, count(*) AS c FROM t GROUP BY term)
SELECT doc_id, round(exp(-avg(ln((c + 1) / (SELECT sum(c) + count(*) FROM c)))), 4) AS perplexity FROM t JOIN c USING (term) GROUP BY doc_id""")
def unigram_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.unigram_perplexity(text.term_counts(docs(spark, sf_dir), "doc_id", "text"), "doc_id")


@query("""SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= greatest(1, count(*) OVER (PARTITION BY lang) * 15 // 100) THEN 'test'
WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) <= 2 * greatest(1, count(*) OVER (PARTITION BY lang) * 15 // 100) THEN 'val' ELSE 'train' END AS split FROM documents""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.greatest(F.lit(1), F.expr("n * 15 div 100"))
    d = docs(spark, sf_dir).select("doc_id", "lang", F.md5(F.col("doc_id").cast("string")).alias("h"))
    d = ranks.ranked(d, ["lang"], F.substring("h", 1, 3), [F.col("h"), F.col("doc_id")], "k", "n")
    return d.select("doc_id", "k", F.when(F.col("k") <= share, "test").when(F.col("k") <= 2 * share, "val").otherwise("train").alias("split"))


@query()
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    p = c.select("conv_id", "turn", "text").join(u, ["conv_id", "turn"])
    return metrics.rouge_l(p, ["conv_id", "turn"], "text", "reference")


@query()
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of each term of the English documents, by its frequency."""
    t = docs(spark, sf_dir).where("lang = 'en'").select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return models.stemmed(t, "term")


@query()
def embedding_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCA to two dimensions and KMeans."""
    return models.project(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query()
def snowball_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Snowball stem of each term of all documents, by its frequency."""
    t = docs(spark, sf_dir).select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return models.stemmed(t, "term", "snowball")


ALIGNED_SQL = rf"""WITH t AS (SELECT conv_id * 1000 + turn AS key, regexp_extract_all(text, '{T.WORD}+|[^a-zA-Z0-9_\p{{L}}\p{{N}}]+') AS p FROM conversations),
x AS (SELECT key, unnest(list_transform(p, lambda w, i: {{'word': w, 'begin': coalesce(length(array_to_string(p[1:i - 1], '')), 0)}}), recursive := true) FROM t),
w AS (SELECT key, word, "begin", CASE WHEN regexp_matches(word, '^[\p{{Lu}}]') THEN 1 WHEN regexp_matches(word, '^[\p{{N}}]') THEN 2 ELSE 0 END AS label FROM x WHERE regexp_matches(word, '^{T.WORD}')),
c AS (SELECT key, unnest(range((length(word) + 3) // 4)) AS k, word, "begin", label FROM w)
SELECT key, "begin" + 4 * k AS pos, CASE WHEN k = 0 THEN label ELSE -100 END AS label FROM c"""


@query(ALIGNED_SQL)
def aligned_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' words, labelled by their first letter, and pieces of up to four letters of them."""
    t = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.regexp_extract_all("text", F.lit(answers.PIECE), F.lit(0)).alias("p"))
    each = t.select("key", F.inline(F.transform("p", lambda w, i: F.struct(w.alias("word"), F.length(F.array_join(F.slice("p", F.lit(1), i), "")).alias("begin")))))
    label = F.when(F.col("word").rlike(r"^\p{Lu}"), 1).when(F.col("word").rlike(r"^\p{N}"), 2).otherwise(0)
    words = each.where(F.col("word").rlike(rf"^{T.WORD}")).select("key", F.col("begin").cast("long"), (F.col("begin") + F.length("word")).cast("long").alias("end"), label.alias("label"))
    pieces = words.select("key", "end", F.explode(F.sequence("begin", F.col("end") - 1, F.lit(4).cast("long"))).alias("begin")).select("key", F.col("begin").alias("pos"), "begin", F.least(F.col("begin") + 4, "end").alias("end"))
    return spans.aligned_labels(pieces, words, "key")
