"""Queries of courses, samples, notes, graphs and further metrics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.similar import close_spellings
from lectern.operators import analytics, assessment, course, evidence, metrics, retrieval, spans, tables, text
from lectern.plans.registry import query
from lectern.plans.search import DENSE_SQL, hits, vector_queries
from lectern.plans.study import EDGES_SQL, SROWS_SQL, TOP_SQL, edges, neighbours
from lectern.plans.texts import HEADINGS_SQL, STOP_SQL, TFIDF_SQL, VOCAB_SQL, docs
from lectern.sources import files
from lectern.sources.tables import ANSWERS_SQL, ATTEMPTS_SQL, answers, attempts, read
from lectern.streaming import windows

TERMS_SQL = "list_filter(regexp_extract_all(lower({}), '" + T.WORD.replace("{", "{{").replace("}", "}}") + "{{2,}}'), lambda x: NOT list_contains(" + STOP_SQL + ", x))"
LINES_SQL = "ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), line AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM ls)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def top_terms(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return text.top_terms(text.tfidf(docs(spark, sf_dir), "doc_id", "text"), "doc_id", k)


@query("""WITH asked AS (SELECT DISTINCT o_custkey AS owner, o_orderkey + o_custkey % 2 AS id FROM orders) SELECT a.owner, a.id, o_orderkey IS NOT NULL AS found FROM asked a LEFT JOIN orders ON o_custkey = owner AND o_orderkey = id""")
def ownership_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether orders that learners ask for are their own; every other one asks for the order after."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"))
    return course.owned(o, o.select("owner", (F.col("id") + F.col("owner") % 2).alias("id")), "owner", "id")


@query(f"""WITH {TOP_SQL}, r AS (SELECT doc_id, lang AS topic, CASE WHEN doc_id % 3 > 0 THEN source END AS section, doc_id % 50 AS document, doc_id AS page, doc_id - 20 AS first, doc_id + 20 AS last, text FROM documents),
k AS (SELECT doc_id % 50 AS document, term, doc_id AS page FROM top WHERE rank <= 2),
e AS (SELECT topic AS label, document, page FROM r UNION SELECT section, document, page FROM r UNION SELECT term, r.document, r.page FROM r JOIN k ON r.document = k.document AND k.page BETWEEN first AND last AND contains(lower(text), lower(term)))
SELECT *, row_number() OVER (PARTITION BY label ORDER BY document, page) AS number FROM e WHERE label IS NOT NULL""")
def topic_source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as topics, sources as sections, and each document's two best terms."""
    d = docs(spark, sf_dir)
    at = F.col("doc_id")
    rows = d.select(F.col("lang").alias("topic"), F.when(at % 3 > 0, F.col("source")).alias("section"), (at % 50).alias("document"), at.alias("page"), (at - 20).alias("first"), (at + 20).alias("last"), "text")
    return course.pages_by_label(rows, top_terms(spark, sf_dir, 2).select((at % 50).alias("document"), "term", at.alias("page")))


@query(f"""WITH {ANSWERS_SQL}, t AS (SELECT DISTINCT p_brand AS syllabus, p_type AS topic FROM part), a AS (SELECT p_brand AS syllabus, p_type AS topic, is_correct FROM answers JOIN part ON question_id = p_partkey WHERE question_id % 3 = 0 AND is_correct IS NOT NULL),
p AS (SELECT syllabus, topic, count(*) AS answers, count(*) FILTER (is_correct) AS correct FROM a GROUP BY ALL), s AS (SELECT syllabus, topic, coalesce(answers, 0) AS answers, coalesce(correct, 0) AS correct, round(100 * correct / answers, 2) AS accuracy FROM t LEFT JOIN p USING (syllabus, topic))
SELECT *, answers >= 3 AND correct < 0.7 * answers AS weak, round(100 * count(*) FILTER (answers >= 3 AND accuracy >= 70) OVER (PARTITION BY syllabus) / count(*) OVER (PARTITION BY syllabus), 2) AS progress FROM s""")
def syllabus_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as syllabi, types as topics; a third of the questions belongs to a syllabus."""
    part = read(spark, sf_dir, "part").select(F.col("p_brand").alias("syllabus"), F.col("p_type").alias("topic"), "p_partkey")
    a = answers(spark, sf_dir).where("question_id % 3 = 0").drop("topic").join(part, F.col("question_id") == F.col("p_partkey"))
    return course.syllabus_analytics(part.select("syllabus", "topic").distinct(), a)


@query(f"""WITH {ANSWERS_SQL}, p AS (SELECT attempt_id, topic, count(*) AS asked, count(*) FILTER (coalesce(is_correct, false)) AS correct FROM answers GROUP BY ALL)
SELECT *, round(100 * sum(correct) OVER (PARTITION BY attempt_id) / sum(asked) OVER (PARTITION BY attempt_id), 2) AS score FROM p""")
def attempt_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.attempt_results(answers(spark, sf_dir))


@query(f"""WITH {TOP_SQL}, {ANSWERS_SQL}, d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ' ' ELSE ' ' END AS section, doc_id % 50 AS document, doc_id - 60 AS first, doc_id + 60 AS last, text FROM documents), k AS (SELECT doc_id % 50 AS document, term, doc_id AS page FROM top WHERE rank <= 2),
m AS (SELECT d.doc_id, arg_max(term, (length(term), lower(term), term)) AS found FROM d JOIN k ON d.document = k.document AND k.page BETWEEN first AND last AND contains(lower(text), lower(term)) WHERE trim(section) = '' GROUP BY d.doc_id),
q AS (SELECT p_partkey AS question_id, coalesce(nullif(trim(section), ''), found, p_type, 'General') AS topic FROM part LEFT JOIN d ON d.doc_id = p_partkey % (SELECT count(*) FROM documents) LEFT JOIN m USING (doc_id)),
l AS (SELECT attempt_id, question_id, arg_max(coalesce(is_correct, false), (answered_at, coalesce(is_correct, false))) AS ok FROM answers GROUP BY ALL), p AS (SELECT attempt_id, topic, count(*) AS asked, count(*) FILTER (ok) AS "right" FROM l JOIN q USING (question_id) GROUP BY ALL),
tot AS (SELECT attempt_id, sum(asked)::BIGINT AS total, sum("right")::BIGINT AS correct FROM p GROUP BY attempt_id) SELECT *, round(correct / total, 6) AS score FROM p JOIN tot USING (attempt_id)""")
def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' questions are asked of documents; a third of these have a section, the others go by their key terms."""
    d, at = docs(spark, sf_dir), F.col("doc_id")
    n = d.agg(F.count("*").alias("n"))  # a row
    chunk = d.select("doc_id", F.when(at % 3 == 0, F.concat("source", F.lit(" "))).otherwise(" ").alias("section"), (at % 50).alias("document"), (at - 60).alias("first"), (at + 60).alias("last"), "text")
    asked = read(spark, sf_dir, "part").crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("question_id"), F.col("p_type").alias("topic"), (F.col("p_partkey") % F.col("n")).alias("doc_id"))
    # a document's term is found once, whatever the number of questions that are asked of it
    found = course.longest_terms(chunk.where("trim(section) = ''"), "doc_id", top_terms(spark, sf_dir, 2).select((at % 50).alias("document"), "term", at.alias("page")))
    topics = course.topics_of(asked.join(chunk.select("doc_id", "section").join(found, "doc_id", "left"), "doc_id", "left"))
    return course.submitted(answers(spark, sf_dir).withColumnRenamed("answered_at", "at"), topics)


@query(f"WITH {ANSWERS_SQL} SELECT DISTINCT attempt_id, question_id FROM answers WHERE NOT is_correct")
def retake_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.retake(answers(spark, sf_dir))


@query(r"""WITH q AS (SELECT conv_id, turn AS id, text FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id, unnest(string_split(text, ' ')) AS sentence FROM conversations WHERE role = 'user'),
l AS (SELECT DISTINCT conv_id, id FROM q JOIN s USING (conv_id) WHERE length(sentence) >= 12 AND contains(text, sentence)) SELECT * FROM q ANTI JOIN l USING (conv_id, id)""")
def snapshot_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that hold none of the long words of their conversation's questions; words stand for the sentences of a source."""
    c = read(spark, sf_dir, "conversations")
    source = c.where("role = 'user'").select("conv_id", F.explode(F.split("text", " ")).alias("sentence"))
    return course.safe_snapshot(c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("id"), "text"), source, "conv_id", 12)


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.daily_cap(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2).select("event_id", "allowed")


@query("""WITH r AS (SELECT user_id, CASE event_type WHEN 'click' THEN ' Good' WHEN 'view' THEN 'ok' WHEN 'error' THEN 'bad' ELSE 'later' END AS rating FROM events), p AS (SELECT user_id, count(*) FILTER (lower(trim(rating)) = 'good') AS good, count(*) FILTER (lower(trim(rating)) IN ('good', 'ok', 'bad')) AS rated FROM r GROUP BY user_id)
SELECT *, round(100 * good / nullif(rated, 0), 4) AS percent_good FROM p""")
def rating_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rating = F.when(F.col("event_type") == "click", " Good").when(F.col("event_type") == "view", "ok").when(F.col("event_type") == "error", "bad").otherwise("later")
    return course.rating_sheet(read(spark, sf_dir, "events").select("user_id", rating.alias("rating")), "user_id", "rating")


@query("""WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT source, n, n * 64 // (SELECT count(*) FROM documents) AS base, n * 64 % (SELECT count(*) FROM documents) AS rest FROM g),
q AS (SELECT source, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= 64 - (SELECT sum(base) FROM p) THEN 1 ELSE 0 END AS quota FROM p),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS k FROM documents) SELECT doc_id, source FROM r JOIN q USING (source) WHERE quota > 0 AND (k * quota + n - 1) // n > ((k - 1) * quota + n - 1) // n""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 documents of all sources in proportion, evenly by length."""
    d = docs(spark, sf_dir).select("doc_id", "source", "n_chars")
    return course.even_sample(d, "source", [F.col("n_chars"), F.col("doc_id")], F.floor(F.col("n_chars") / 64), 64).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE substring(sha256(doc_id::VARCHAR), 1, 2) < '40'")
def hash_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quarter of the documents in every run: a sample by the ids' digests."""
    return docs(spark, sf_dir).where(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 2) < "40").select("doc_id")


@query(f"""WITH {TFIDF_SQL}, t AS (SELECT doc_id, term, tf, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, term) AS number FROM tf QUALIFY number <= 2), p AS (SELECT term, count(*) AS relevant FROM tf GROUP BY term)
SELECT doc_id, number, replace(['What is {{}}?', 'How does {{}} work?', 'Why does {{}} matter?'][(doc_id * 2 + number - 1) % 3 + 1], '{{}}', term) AS question, relevant FROM t JOIN p USING (term)""")
def draft_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.draft_questions(docs(spark, sf_dir), ["What is {}?", "How does {} work?", "Why does {} matter?"])


@query(f"WITH {TOP_SQL}, n AS (SELECT doc_id, max(rank) AS n FROM top WHERE rank <= 4 GROUP BY doc_id), s AS (SELECT doc_id, n, unnest(range(6)) AS slot FROM n) SELECT doc_id, slot, term FROM s JOIN top USING (doc_id) WHERE rank = slot % n + 1")
def cycling_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six slots a document, filled with its four best terms in turn."""
    return course.cycled(top_terms(spark, sf_dir, 4), "doc_id", "rank").select("doc_id", "slot", "term")


@query("SELECT conv_id, sha256(string_agg(sha256(text), chr(10) ORDER BY sha256(text))) AS fingerprint FROM conversations GROUP BY conv_id")
def chunk_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.chunk_fingerprint(read(spark, sf_dir, "conversations"), "conv_id", "text")


@query(f"""WITH {HEADINGS_SQL}, l AS (SELECT DISTINCT title AS label, unnest({TERMS_SQL.format("title")}) AS term FROM headings), q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS_SQL.format("text")}) AS term FROM benchmark),
n AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id), s AS (SELECT query_id, label, round(count(*) / any_value(n), 6) AS score FROM q JOIN l USING (term) JOIN n USING (query_id) GROUP BY query_id, label)
SELECT query_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rank FROM s QUALIFY rank <= 3""")
def nearest_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' headings nearest to each benchmark item."""
    words = lambda df, key, c: df.select(F.col(key), F.explode(F.array_distinct(T.terms(F.col(c)))).alias("term")).distinct()
    labels = text.headings(read(spark, sf_dir, "pages")).withColumnRenamed("title", "label").withColumn("title", F.col("label"))
    return course.nearest_labels(words(read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id", "text"), words(labels, "label", "title"))


@query()
def closest_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' headings nearest to each benchmark item by words and spelling, and the first page of each."""
    labels = text.headings(read(spark, sf_dir, "pages")).select(F.col("title").alias("label"), F.col("page_id").alias("place"))
    return course.closest_labels(read(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), labels)


@query()
def spelling_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close spellings, from the documents' words that occur five times or more, of words of the conversations that are none of these."""
    words = lambda df, least: df.select(F.explode(T.terms(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return close_spellings(words(read(spark, sf_dir, "conversations"), 1), words(docs(spark, sf_dir), 5))


@query(f"""WITH {TOP_SQL}, {SROWS_SQL}, o AS (SELECT doc_id, sentence, min(pos) AS pos FROM sr GROUP BY doc_id, sentence), p AS (SELECT doc_id, 'point' AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number, sentence AS text FROM o QUALIFY number <= 3),
e AS (SELECT doc_id, 'example' AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number, sentence AS text FROM o WHERE regexp_matches(lower(sentence), '{T.whole("est|ist|was|son")}') QUALIFY number <= 3)
SELECT doc_id, 'term' AS kind, rank AS number, term AS text FROM top WHERE rank <= 5 UNION ALL SELECT * FROM p UNION ALL SELECT * FROM e""")
def chapter_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.chapter_notes(top_terms(spark, sf_dir, 5), evidence.sentence_rows(docs(spark, sf_dir), "doc_id", "text"), "doc_id", "est|ist|was|son")


RELATIONS = {"is_a": r"is\s+(?:a\s+)?(?:type|kind)\s+of", "uses": r"uses|relies\s+on", "part_of": r"consists\s+of|contains|includes", "used_for": r"is\s+used\s+for|helps\s+with", "beside": r"the|of|and|la|le|die|der|und|les"}
_PAIRS = [(n, r, x, y) for n, r in RELATIONS.items() for x, y in (("a", "b"), ("b", "a"))]
_CASE = " ".join(rf"WHEN regexp_matches(s, '(?:^|[^\p{{L}}\p{{N}}_])' || {x} || '\s+(?:{r})\s+' || {y} || '(?:$|[^\p{{L}}\p{{N}}_])') THEN {{{{'source': {x}, 'target': {y}, 'relation': '{n}'}}}}" for n, r, x, y in _PAIRS).replace("{{", "{").replace("}}", "}")
TYPED_SQL = f"""{TOP_SQL}, {SROWS_SQL}, ws AS (SELECT DISTINCT doc_id, pos, lower(sentence) AS s, unnest(regexp_extract_all(lower(sentence), '{T.WORD}+')) AS term FROM sr), h AS (SELECT ws.* FROM ws SEMI JOIN top USING (doc_id, term)),
p AS (SELECT x.doc_id, x.pos, x.s, x.term AS a, y.term AS b FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.pos = y.pos AND x.term < y.term), e AS (SELECT doc_id, pos, CASE {_CASE} ELSE {{'source': a, 'target': b, 'relation': 'related_to'}} END AS e FROM p),
g AS (SELECT doc_id, e.source AS source, e.target AS target, e.relation AS relation, count(*) AS weight, min(pos) AS pos FROM e GROUP BY ALL)"""


@query(f"WITH {TYPED_SQL} SELECT * FROM g WHERE relation <> 'related_to' OR (doc_id, source, target) NOT IN (SELECT (doc_id, source, target) FROM g WHERE relation <> 'related_to')")
def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each document's eight best terms; `beside` is a relation that the made-up texts have."""
    d = docs(spark, sf_dir)
    return course.typed_edges(evidence.sentence_rows(d, "doc_id", "text"), top_terms(spark, sf_dir, 8), "doc_id", RELATIONS)


@query(f"WITH {EDGES_SQL} SELECT doc_id, a AS term, b AS other, weight FROM edges UNION ALL SELECT doc_id, b, a, weight FROM edges")
def node_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course.neighbours(edges(spark, sf_dir), "doc_id")


@query(f"""WITH {TOP_SQL}, {LINES_SQL}, h AS (SELECT doc_id, term, pos AS page, pos <> 2 AS other FROM line JOIN top USING (doc_id) WHERE rank <= 3 AND contains(lower(line), lower(term)))
SELECT doc_id, term, arg_min(page, (other, page)) AS page FROM h GROUP BY doc_id, term""")
def term_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages, the third one preferred."""
    wanted = top_terms(spark, sf_dir, 3).select("doc_id", "term", F.lit(2).cast("long").alias("preferred"))
    return course.term_page(lines(spark, sf_dir).select("doc_id", F.col("pos").alias("page"), F.col("line").alias("text")), wanted)


@query(f"""WITH {DENSE_SQL}, rel AS (SELECT query_id, q_label, (SELECT count(*) FROM embeddings WHERE label = q_label) - 1 AS n_relevant FROM q),
per AS (SELECT query_id, count(*) FILTER (label = q_label) AS hits, min(rank) FILTER (label = q_label) AS first, sum(CASE WHEN label = q_label THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM dense WHERE rank <= 10 GROUP BY query_id),
m AS (SELECT query_id, q_label, round(hits / 10, 6) AS precision, round(hits / n_relevant, 6) AS recall, round(coalesce(1 / first, 0), 6) AS rr, round(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM rel JOIN per USING (query_id))
SELECT q_label % 4 AS question_type, count(*) AS questions, round(avg(precision) + 1e-9, 5) AS precision, round(avg(recall) + 1e-9, 5) AS recall, round(avg(rr) + 1e-9, 5) AS mrr, round(avg(ndcg) + 1e-9, 5) AS ndcg FROM m GROUP BY 1""")
def macro_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking metrics' means over the questions of each type."""
    e, q = vector_queries(spark, sf_dir)
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    per = metrics.ranking(hits(e, q, retrieval.dense_top_k(e, q, 10)), q.join(sizes, "label").select("query_id", "n_relevant"), 10)
    return metrics.macro_ranking(per.join(q.select("query_id", (F.col("label") % 4).alias("question_type")), "query_id"), "question_type")


@query(f"WITH {LINES_SQL}, c AS (SELECT doc_id, pos // 5 AS chunk, min(pos) AS first, max(pos) AS last FROM line GROUP BY ALL), p AS (SELECT doc_id, pos FROM line WHERE regexp_matches(lower(line), '{T.whole('for|que|mit')}')) SELECT DISTINCT doc_id, chunk FROM p JOIN c USING (doc_id) WHERE pos BETWEEN first AND last")
def page_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant chunks from labelled pages: chunks of five lines that hold a labelled line."""
    line = lines(spark, sf_dir)
    chunk = line.groupBy("doc_id", F.expr("pos div 5").alias("chunk")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    labelled = line.where(F.lower("line").rlike(T.whole("for|que|mit"))).select("doc_id", "pos")
    return spans.within(chunk, labelled, "doc_id", "pos", "first", "last").select("doc_id", "chunk").distinct()


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{T.TOKEN.replace("'", "''")}') AS w FROM documents), t AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM w),
a AS (SELECT doc_id, pos, 1 AS side FROM t WHERE regexp_matches(token, '^\p{{Lu}}') UNION ALL SELECT doc_id, pos, 2 FROM t WHERE regexp_matches(token, '^\p{{Lu}}') AND length(token) >= 4),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, side ORDER BY pos) AS island FROM a), s AS (SELECT doc_id, side, min(pos) AS first, max(pos) AS last FROM i GROUP BY doc_id, side, island),
m AS (SELECT count(*) AS hit FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.first = y.first AND x.last = y.last AND x.side = 1 AND y.side = 2), n AS (SELECT count(*) FILTER (side = 1) AS truth, count(*) FILTER (side = 2) AS predicted FROM s)
SELECT 'ENT' AS label, round(hit / predicted, 6) AS precision, round(hit / truth, 6) AS recall, round(2 * hit / (truth + predicted), 6) AS f1 FROM m, n""")
def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalised tokens as true entities, of those of four letters or more as predicted ones."""
    t = docs(spark, sf_dir).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "token"))
    runs = lambda ok: spans.runs(t.withColumn("label", F.when(ok, "ENT")), "doc_id", "pos", "label", "token").select("doc_id", "label", "first", "last")
    capital = F.col("token").rlike(r"^\p{Lu}")
    return metrics.entity_scores(runs(capital), runs(capital & (F.length("token") >= 4)), ["doc_id", "first", "last"])


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey, o_custkey FROM orders ANTI JOIN gone ON o_custkey = c_custkey)
SELECT l_orderkey, l_linenumber, CASE WHEN s_nationkey = 3 THEN NULL ELSE l_suppkey END AS l_suppkey FROM lineitem SEMI JOIN o ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting one nation's customers takes their orders and lines along; its suppliers leave a null in the lines that stay."""
    of = lambda name, key: read(spark, sf_dir, name).where(F.col(key) == 3)
    o = tables.cascade(read(spark, sf_dir, "orders"), "o_custkey", of("customer", "c_nationkey"), "c_custkey")
    lost = tables.removed(read(spark, sf_dir, "orders"), o, "o_orderkey")
    kept = tables.cascade(read(spark, sf_dir, "lineitem"), "l_orderkey", lost, "o_orderkey")
    return tables.set_null(kept, "l_suppkey", of("supplier", "s_nationkey"), "s_suppkey").select("l_orderkey", "l_linenumber", "l_suppkey")


@query(f"""WITH {VOCAB_SQL}, v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM vocab), t AS (SELECT doc_id, {TERMS_SQL.format("text")}[1:16] AS t FROM documents), x AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS token FROM t),
e AS (SELECT doc_id, string_agg(coalesce(id, 1)::VARCHAR, ' ' ORDER BY pos) AS ids, count(*) AS n FROM x LEFT JOIN v USING (token) GROUP BY doc_id) SELECT doc_id, trim(coalesce(ids, '') || repeat(' 0', (16 - coalesce(n, 0))::INTEGER)) AS ids FROM t LEFT JOIN e USING (doc_id)""")
def encode_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen terms as ids of the vocabulary, 1 for unknown ones, filled up with 0."""
    d = docs(spark, sf_dir)
    return text.encoded(d, "doc_id", "text", text.vocabulary(d, "text"), 16).select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(rf"""WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '{T.TOKEN.replace("'", "''")}')) AS n FROM documents), k AS (SELECT doc_id, n, unnest(range(greatest(0, CAST(ceil((n - 384) / 256.0) AS BIGINT)) + 1)) AS win FROM w WHERE n > 0) SELECT doc_id, win AS "window", win * 256 AS first, least(win * 256 + 384, n) - 1 AS last FROM k""")
def stride_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 384 tokens, each 128 into the one before."""
    n = docs(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))
    return spans.stride_windows(n, "doc_id", "n", 384, 128)


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{T.TOKEN.replace("'", "''")}') AS w FROM documents) SELECT doc_id, count(*) AS tokens, count(DISTINCT token) AS forms, max(pos - 1) AS last_head FROM (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS token FROM w) GROUP BY doc_id""")
def token_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fallback analysis: each token's head is the token before, the first one is the root (head -1)."""
    a = text.linear_analysis(docs(spark, sf_dir), "doc_id", "text")
    return a.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.countDistinct("token").alias("forms"), F.max("head").cast("long").alias("last_head"))


PAIRS_SQL = "p AS (SELECT a.conv_id || ':' || a.turn AS pair, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS a, regexp_extract_all(lower(u.text), '[a-z0-9]+') AS b FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    return c.select("conv_id", "turn", "text").join(u, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("pair"), words("text").alias("a"), words("before").alias("b"), "text", "before")


@query(f"""WITH {PAIRS_SQL}, s AS (SELECT pair, 1 AS side, unnest(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS g FROM p UNION ALL SELECT pair, 2, unnest(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1])) FROM p),
c AS (SELECT pair, g, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 2) AS y FROM s GROUP BY ALL) SELECT pair, sum(least(x, y))::BIGINT AS both, sum(x)::BIGINT AS "left", sum(y)::BIGINT AS "right", round(2 * sum(least(x, y)) / (sum(x) + sum(y)), 6) AS rouge_2 FROM c GROUP BY pair""")
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = turn_pairs(spark, sf_dir)
    return metrics.f1_of(metrics.overlap_counts(p, "pair", T.ngrams(F.col("a"), 2), T.ngrams(F.col("b"), 2)), "rouge_2")


_GRAMS = " UNION ALL ".join(f"SELECT pair, {n} AS size, {side} AS side, unnest(list_transform(range(1, len({c}) - {n - 2}), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))) AS g FROM p" for n in (1, 2, 3, 4) for side, c in ((1, "a"), (2, "b")))


@query(f"""WITH {PAIRS_SQL}, s AS ({_GRAMS}), c AS (SELECT pair, size, g, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 2) AS y FROM s GROUP BY ALL), k AS (SELECT size, sum(least(x, y)) AS clipped, sum(x) AS total FROM c GROUP BY size),
n AS (SELECT sum(len(a)) AS mine, sum(len(b)) AS theirs FROM p) SELECT round(100 * CASE WHEN min(clipped) = 0 OR count(*) < 4 THEN 0 ELSE exp(avg(ln(clipped / total))) * (SELECT CASE WHEN mine >= theirs THEN 1 ELSE exp(1 - theirs / mine) END FROM n) END, 4) AS bleu FROM k""")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = turn_pairs(spark, sf_dir)
    return metrics.bleu(metrics.bleu_counts(p, "pair", F.col("a"), F.col("b")), p.agg(F.sum(F.size("a")).alias("mine"), F.sum(F.size("b")).alias("theirs")))


@query(f"""WITH {PAIRS_SQL.replace("u.text), '[a-z0-9]+') AS b", "u.text), '[a-z0-9]+') AS b, a.text AS text, u.text AS before")} SELECT pair, array_to_string(a, ' ') = array_to_string(b, ' ') AS exact FROM p""")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("pair", (F.array_join("a", " ") == F.array_join("b", " ")).alias("exact"))


@query("SELECT doc_id, md5(replace(replace(text, 'tion', '[redacted]'), 'http', '[redacted]')) AS digest FROM documents")
def redact_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known secrets of four characters or more; shorter ones are left."""
    return docs(spark, sf_dir).select("doc_id", F.md5(T.redact_literals(F.col("text"), ["tion", "http", "the"])).alias("digest"))


@query("SELECT conv_id, string_agg('[' || conv_id || ', p.' || turn || ']' || chr(10) || regexp_replace(replace(replace(text, '[', '［'), ']', '］'), '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY turn) AS block FROM conversations WHERE turn < 4 GROUP BY conv_id")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first four turns as one block of context; brackets within the turns cannot end it."""
    c = read(spark, sf_dir, "conversations").where("turn < 4")
    return evidence.context_blocks(c, "conv_id", "turn", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "text")


@query(f"""WITH s AS (SELECT event_id, ts, ['UTC', 'Asia/Kolkata', 'America/New_York'][user_id % 3 + 1] AS zone FROM events) SELECT event_id, timezone(zone, timezone('UTC', ts))::DATE AS day, epoch(timezone('UTC', timezone(zone, date_trunc('day', timezone(zone, timezone('UTC', ts))))))::BIGINT AS day_start FROM s""")
def local_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each action in its learner's zone, and when that day began in UTC."""
    zone = F.element_at(F.array(*map(F.lit, ("UTC", "Asia/Kolkata", "America/New_York"))), (F.col("user_id") % 3 + 1).cast("int"))
    e = read(spark, sf_dir, "events").select("event_id", analytics.local_date("ts", zone).alias("day"), zone.alias("zone"))
    return e.select("event_id", "day", F.unix_seconds(analytics.day_start("day", "zone")).alias("day_start"))


@query("""WITH x AS (SELECT conv_id, turn, text, list(text) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS chunks, role FROM conversations),
a AS (SELECT conv_id, turn, """ + r"""list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|$)'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s, chunks FROM x WHERE role = 'assistant'),
q AS (SELECT conv_id, turn, unnest(range(len(s))) AS pos, unnest(s) AS sentence, chunks FROM a), t AS (SELECT conv_id, turn, pos, unnest(range(1, len(chunks) + 1)) AS chunk, unnest(chunks) AS c, sentence FROM q WHERE len(chunks) > 0),""" + f"""
g AS (SELECT conv_id, turn, pos, chunk, list_distinct(list_filter(list_transform(regexp_extract_all(sentence, '{T.GROUNDING_TOKEN.replace("'", "''")}'), lambda w: lower(w)), lambda w: length(w) > 1 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.GROUNDING_STOP_WORDS)}], w))) AS st,
list_distinct(list_filter(list_transform(regexp_extract_all(c, '{T.GROUNDING_TOKEN.replace("'", "''")}'), lambda w: lower(w)), lambda w: length(w) > 1 AND NOT list_contains([{", ".join(f"'{w}'" for w in T.GROUNDING_STOP_WORDS)}], w))) AS ct FROM t),
o AS (SELECT conv_id, turn, pos, chunk, CASE WHEN len(st) = 0 THEN 0 ELSE round(len(list_intersect(st, ct)) / len(st), 6) END AS overlap FROM g)
SELECT conv_id, turn, pos, arg_min(chunk, (-overlap, chunk)) FILTER (overlap > 0) AS chunk, max(overlap) AS overlap, max(overlap) >= 0.65 AS supported FROM o GROUP BY conv_id, turn, pos""")
def grounding_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of an answer with the best of the questions among the six turns before."""
    return evidence.best_chunks(read(spark, sf_dir, "conversations"), 6)


@query()
def section_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of the ten-line sections of each document and the next by cosine of their term counts."""
    d = docs(spark, sf_dir)
    scores = course.section_scores(d, neighbours(d), 10, 0.6)
    return course.match_sections(scores, "pair", 0.6)


@query()
def different_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    return course.different_questions(c.select("conv_id", F.col("turn").alias("pos"), "text"), "conv_id").select("conv_id", "pos")


@query()
def clean_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.clean_slides(F.col("text"))).alias("digest"))


@query(f"""WITH {TOP_SQL}, n AS (SELECT source AS owner, lower(term) AS label, count(*)::DOUBLE AS importance FROM top JOIN documents USING (doc_id) WHERE rank <= 4 GROUP BY ALL)
SELECT owner, 'node_' || substring(sha256(label), 1, 16) AS node_id, label, round(greatest(importance, CASE WHEN label LIKE 'a%' THEN 2.5 ELSE 0 END), 4) AS importance, row_number() OVER (PARTITION BY owner ORDER BY greatest(importance, CASE WHEN label LIKE 'a%' THEN 2.5 ELSE 0 END) DESC, label) AS rank FROM n QUALIFY rank <= 40""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each source's graph; entries of words with a first letter a stand for a glossary."""
    t = top_terms(spark, sf_dir, 4).join(docs(spark, sf_dir).select("doc_id", F.col("source").alias("owner")), "doc_id")
    return evidence.graph_nodes(t, t.where("term LIKE 'a%'").select("owner", "term", F.lit(2.5).alias("importance")), "owner")


NODES_SQL = f"""{TOP_SQL}, n AS (SELECT source AS owner, lower(term) AS label, count(*)::DOUBLE AS importance FROM top JOIN documents USING (doc_id) WHERE rank <= 4 GROUP BY ALL),
nodes AS (SELECT owner, label FROM n QUALIFY row_number() OVER (PARTITION BY owner ORDER BY greatest(importance, CASE WHEN label LIKE 'a%' THEN 2.5 ELSE 0 END) DESC, label) <= 40)"""


@query(rf"""WITH {NODES_SQL}, m AS (SELECT owner, label, doc_id AS page FROM nodes JOIN documents ON source = owner WHERE regexp_matches(regexp_replace(lower(text), '\s+', ' ', 'g'), '(?:^|[^\p{{L}}\p{{N}}_])' || label || '(?:$|[^\p{{L}}\p{{N}}_])')
UNION SELECT owner, label, doc_id FROM nodes JOIN documents ON source = owner JOIN top USING (doc_id) WHERE rank <= 4 AND lower(term) = label)
SELECT owner, 'node_' || substring(sha256(label), 1, 16) AS node_id, label, page FROM m""")
def graph_node_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a source that mention or hold each node of its graph."""
    d = docs(spark, sf_dir).select("doc_id", F.col("source").alias("owner"), "text")
    t = top_terms(spark, sf_dir, 4).join(d.select("doc_id", "owner"), "doc_id")
    nodes = evidence.graph_nodes(t, t.where("term LIKE 'a%'").select("owner", "term", F.lit(2.5).alias("importance")), "owner")
    return evidence.graph_pages(nodes, t.select("owner", "term", F.col("doc_id").alias("page")), d.select("owner", F.col("doc_id").alias("page"), "text"), "owner")


@query(r"""WITH c AS (SELECT page_id AS id, url, substring(regexp_replace(html, '\s+', ' ', 'g'), 10 + page_id % 5, 30) || CASE WHEN page_id % 4 = 0 THEN '?' ELSE '' END AS quote FROM pages)
SELECT id, bool_or(contains(regexp_replace(regexp_replace(html, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), regexp_replace(quote, '^\s+|\s+$', '', 'g'))) AS valid FROM c JOIN pages USING (url) GROUP BY id""")
def web_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from pages, every fourth one altered, against all pages of the address."""
    p = read(spark, sf_dir, "pages")
    quote = F.concat(F.substring(F.regexp_replace("html", r"\s+", " "), (F.col("page_id") % 5 + 10).cast("int"), F.lit(30)), F.when(F.col("page_id") % 4 == 0, "?").otherwise(""))
    return evidence.web_evidence(p.select(F.col("page_id").alias("id"), "url", quote.alias("quote")), p.select("url", F.col("html").alias("snippet")))


@query(r"""WITH r AS (SELECT page_id // 8 AS query_id, page_id AS position, regexp_replace(regexp_replace(html, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS content, substring(html, 1, 200) AS title, CASE WHEN page_id % 3 = 0 THEN replace(url, 'https://', 'http://') ELSE replace(url, 'http://', 'https://') END AS url FROM pages),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position, url) <= 5)
SELECT query_id, position, title, url, lower(regexp_extract(url, '^https://([^/:?#]+)', 1)) AS domain, substring(content, 1, 300) AS snippet FROM f WHERE url LIKE 'https://%' AND content <> ''""")
def web_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight pages as the results of a search, every third one without https."""
    url = F.when(F.col("page_id") % 3 == 0, F.replace("url", F.lit("https://"), F.lit("http://"))).otherwise(F.replace("url", F.lit("http://"), F.lit("https://")))
    r = read(spark, sf_dir, "pages").select(F.expr("page_id div 8").alias("query_id"), F.col("page_id").alias("position"), F.col("html").alias("title"), url.alias("url"), F.col("html").alias("content"))
    return evidence.web_rows(r, "query_id")


@query("SELECT vec_id, sha256('7:' || label || ':' || vec_id) AS id FROM embeddings")
def vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").withColumn("owner", F.lit(7)).select("vec_id", files.vector_id("owner", "label", "vec_id").alias("id"))


@query("""WITH s AS (SELECT conv_id, turn AS number, role AS title, substring(text, 1, 40) AS body, string_split(substring(text, 1, 30), ' ') AS items FROM conversations), b AS (SELECT conv_id, number, unnest(range(2 + len(items))) AS k, unnest(list_concat([title, body], items)) AS text FROM s)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY number, k) - 1 AS pos, CASE k WHEN 0 THEN 'heading' WHEN 1 THEN 'paragraph' ELSE 'bullet' END AS kind, CASE k WHEN 0 THEN 2 ELSE 0 END AS level, text FROM b WHERE text <> ''""")
def export_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as sections of a document to export."""
    c = read(spark, sf_dir, "conversations")
    return files.export_blocks(c.select("conv_id", F.col("turn").alias("number"), F.col("role").alias("title"), F.substring("text", 1, 40).alias("body"), F.split(F.substring("text", 1, 30), " ").alias("items")), "conv_id")


@query("SELECT event_id, count(*) OVER w > 2 OR sum(event_id % 100) OVER w > 120 AS wait FROM events WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("tokens", F.col("event_id") % 100)
    return windows.token_budget(e, "event_type", "tokens", 2, 120).select("event_id", "wait")


@query("""WITH s AS (SELECT user_id, ts, ['queued', 'extracting', 'processing', 'indexing', 'ready', 'failed'][event_id % 6 + 1] AS status, [0, 10, 40, 80, 100, 100][event_id % 6 + 1] AS progress FROM events WHERE event_id % 4 < 2)
SELECT user_id, arg_max(status, (progress, ts, status)) AS status, max(progress) AS progress, max(progress) = 100 AS ended FROM s GROUP BY user_id""")
def ingestion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, windows.STATES))
    e = read(spark, sf_dir, "events").where("event_id % 4 < 2").select("user_id", "ts", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("status"))
    return windows.ingestion_states(e, "user_id")


@query()
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lines as a page, lines of at most three words as headings."""
    l = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("l"))
    p = l.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("CAST((size(l) - 1) div 10 AS INT)"))).alias("page"), "l").select("doc_id", "page", F.slice("l", F.col("page") * 10 + 1, F.lit(10)).alias("l"))
    return text.page_chunks(p.select("doc_id", "page", F.array_join("l", "\n").alias("text"), F.filter("l", lambda x: F.size(F.split(x, " ")) <= 3).alias("headings")), "doc_id")


@query(f"""WITH {TOP_SQL}, t AS (SELECT doc_id, left(term, 4) AS term, rank % 3 AS page FROM top), g AS (SELECT doc_id, term, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS p FROM t GROUP BY ALL),
n AS (SELECT doc_id AS a, lead(doc_id) OVER (ORDER BY doc_id) AS b FROM documents QUALIFY b IS NOT NULL), s AS (SELECT a, b, term, p AS pages_a, NULL AS pages_b FROM n JOIN g ON doc_id = a UNION ALL SELECT a, b, term, NULL, p FROM n JOIN g ON doc_id = b),
m AS (SELECT a, b, term, max(pages_a) AS x, max(pages_b) AS y FROM s GROUP BY ALL) SELECT a, b, term, CASE WHEN y IS NULL THEN 'only_a' WHEN x IS NULL THEN 'only_b' ELSE 'shared' END AS side, coalesce(x, '') AS pages_a, coalesce(y, '') AS pages_b FROM m""")
def term_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of each document's best terms against the next document's; ranks stand for pages."""
    t = top_terms(spark, sf_dir, 8).select("doc_id", F.substring("term", 1, 4).alias("term"), (F.col("rank") % 3).alias("page"))
    return evidence.term_sides(t, neighbours(docs(spark, sf_dir)))


CITED_SQL = "cited AS (SELECT conv_id, turn, 'T' || turn % 5 AS title, turn % 3 AS page FROM conversations WHERE turn % 2 = 1), found AS (SELECT conv_id, 't' || turn % 5 AS title, turn % 4 AS page FROM conversations WHERE turn % 2 = 0)"


@query(f"""WITH {CITED_SQL}, c AS (SELECT DISTINCT conv_id, lower(title) AS title, page FROM cited), f AS (SELECT DISTINCT * FROM found), g AS (SELECT c.* FROM c SEMI JOIN f USING (conv_id, title, page)) SELECT * FROM g UNION ALL SELECT * FROM f WHERE conv_id NOT IN (SELECT conv_id FROM g)""")
def kept_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd turns as citations, even ones as what was retrieved for the conversation."""
    c = read(spark, sf_dir, "conversations")
    of = lambda odd, mark, n: c.where(F.col("turn") % 2 == odd).select("conv_id", F.concat(F.lit(mark), (F.col("turn") % 5).cast("string")).alias("title"), (F.col("turn") % n).alias("page"))
    return evidence.kept_citations(of(1, "T", 3), of(0, "t", 4), "conv_id")


@query("""WITH c AS (SELECT event_id AS id, 'Doc' || user_id AS title, event_id % 40 AS page FROM events), k AS (SELECT 'doc' || d AS title, k AS chunk, 7 * k AS first, 7 * k + 9 AS last FROM range(1, 20000) t(d), range(5) u(k) WHERE d % 3 > 0)
SELECT id, title, page, (SELECT min(chunk) FROM k WHERE k.title = lower(c.title) AND page BETWEEN first AND last) AS chunk FROM c""".replace("range(1, 20000)", "(SELECT DISTINCT user_id FROM events)"))
def citation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learners' documents in five overlapping chunks of pages; every third learner has none."""
    e = read(spark, sf_dir, "events")
    cited = e.select(F.col("event_id").alias("id"), F.concat(F.lit("Doc"), "user_id").alias("title"), (F.col("event_id") % 40).alias("page"))
    chunks = e.select("user_id").distinct().where("user_id % 3 > 0").select(F.concat(F.lit("doc"), "user_id").alias("title"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("chunk"))
    return evidence.citation_chunks(cited, chunks.select("title", F.col("chunk").cast("long"), (7 * F.col("chunk")).alias("first"), (7 * F.col("chunk") + 9).alias("last")))


@query("SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number, p_partkey, p_type AS answer, p_size::BIGINT AS marks, sum(p_size) OVER ()::BIGINT AS total_marks FROM part")
def marking_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.marking_scheme(read(spark, sf_dir, "part"), "p_brand", "p_partkey", F.col("p_type"), F.col("p_size").cast("long"))


@query(f"WITH {ATTEMPTS_SQL}, n AS (SELECT l_orderkey, count(*) AS q FROM lineitem GROUP BY 1) SELECT attempt_id, elapsed_seconds > 3000 AS late, elapsed_seconds < 30 * q AS suspicious FROM attempts JOIN n ON l_orderkey = attempt_id")
def attempt_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("attempt_id")).agg(F.count("*").alias("q"))
    return assessment.attempt_flags(attempts(spark, sf_dir).join(n, "attempt_id"), F.col("q"), 3000, 30).select("attempt_id", "late", "suspicious")


@query(f"""WITH d AS (SELECT doc_id, text FROM documents WHERE len({TERMS_SQL.format("text")}) > 0), u AS (SELECT text, min(doc_id) AS k FROM d GROUP BY text), t AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest({TERMS_SQL.format("text")}) AS term FROM u) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term), w AS (SELECT k, ('0x' || substring(md5(term), 1, 8))::BIGINT % 64 AS place, sum(tf * (ln((1 + (SELECT count(*) FROM u)) / (1 + df)) + 1)) AS v FROM t JOIN f USING (term) GROUP BY ALL),
n AS (SELECT k, sqrt(sum(v * v)) AS norm FROM w GROUP BY k) SELECT doc_id, place, round(v / norm, 6) AS value FROM d JOIN u USING (text) JOIN w USING (k) JOIN n USING (k) WHERE round(v / norm, 6) > 0""")
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that have terms by the built-in encoder, cell by cell."""
    d = docs(spark, sf_dir).where(F.size(T.terms(F.col("text"))) > 0)
    v = retrieval.hashed_vectors(d, "doc_id", "text").select("doc_id", F.posexplode("embedding").alias("place", "value"))
    return v.select("doc_id", F.col("place").cast("long"), F.round("value", 6).alias("value")).where("value > 0")


@query(f"""WITH {TOP_SQL}, {SROWS_SQL}, de AS (SELECT doc_id, rank AS number, term, arg_min(sentence, pos) AS sentence FROM (SELECT * FROM top WHERE rank <= 8) JOIN sr USING (doc_id) WHERE contains(' ' || list_aggregate(regexp_extract_all(lower(sentence), '{T.WORD}+'), 'string_agg', ' ') || ' ', ' ' || term || ' ') GROUP BY doc_id, rank, term),
ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), ln AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM ls), fo AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM ln WHERE regexp_matches(line, '[=+*/^]') AND length(line) <= 160 QUALIFY number <= 6),
fa AS (SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number FROM sr WHERE regexp_matches(sentence, '[0-9]') QUALIFY number <= 5)
SELECT doc_id, 'term' AS kind, number, term || ': ' || substring(sentence, 1, 160) AS text FROM de UNION ALL SELECT doc_id, 'formula', number, line FROM fo UNION ALL SELECT doc_id, 'fact', number, sentence FROM fa""")
def cheat_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evidence.sentence_rows(docs(spark, sf_dir), "doc_id", "text")
    return course.cheat_sheet(top_terms(spark, sf_dir, 8), s, lines(spark, sf_dir), "doc_id")
