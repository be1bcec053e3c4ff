"""Queries of study material: cards, questions, topics, wrong answers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import assessment, study, text
from lectern.plans.registry import query
from lectern.plans.study import TOP_SQL
from lectern.plans.texts import SENTENCES_SQL, STOP_SQL, docs
from lectern.sources.tables import read

VERBS = "is|are|was|be|die|est|ist"
SENT_SQL = f"so AS (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents), sr AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM so)"


@query(rf"""WITH {SENT_SQL} SELECT doc_id, pos, sentence FROM sr WHERE len(regexp_split_to_array(sentence, '\s+')) BETWEEN 8 AND 35 AND regexp_matches(sentence, '^\p{{Lu}}') AND regexp_matches(sentence, '[.!?]$') AND NOT regexp_matches(sentence, '[.!?].*[.!?]$') AND regexp_matches(lower(sentence), '{T.whole(VERBS)}')""")
def source_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.source_sentences(docs(spark, sf_dir), "doc_id", "text", VERBS)


@query(rf"""WITH {SENT_SQL}, {TOP_SQL}, x AS (SELECT doc_id, pos, sentence AS stem, term FROM sr JOIN top USING (doc_id) WHERE rank = 1)
SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM (SELECT CASE WHEN len(regexp_split_to_array(stem, '\s+')) < 4 THEN 'too_short' WHEN len(regexp_split_to_array(stem, '\s+')) > 40 THEN 'too_long'
WHEN regexp_matches(stem, '[\p{{S}}]') THEN 'symbols' WHEN contains(lower(stem), term) THEN 'answer_leak' WHEN regexp_matches(lower(stem), '^(it|this|that|they|these|those)\b') THEN 'pronoun_start' END AS reason FROM x) GROUP BY 1""")
def stem_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences fail as stems, by the first reason."""
    d = docs(spark, sf_dir)
    top = text.top_terms(text.tfidf(d, "doc_id", "text"), "doc_id", 1).select("doc_id", "term")
    s = d.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("stem")).join(top, "doc_id")
    return s.groupBy(F.coalesce(study.stem_reason(F.col("stem"), F.col("term")), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(rf"""WITH {SENT_SQL}, {TOP_SQL}, x AS (SELECT doc_id, pos, sentence, term, instr(' ' || regexp_replace(lower(sentence), '[^\p{{L}}\p{{N}}_]', ' ', 'g') || ' ', ' ' || term || ' ') AS k FROM sr JOIN top USING (doc_id) WHERE rank <= 2),
c AS (SELECT doc_id, pos, substring(sentence, 1, k - 1) || '____' || substring(sentence, k + length(term), length(sentence)) AS front, term AS back, sentence AS evidence FROM x WHERE k > 0),
h AS (SELECT *, sha256(concat_ws(chr(31), lower(trim(regexp_replace(front, '\s+', ' ', 'g'))), lower(back), lower(trim(regexp_replace(evidence, '\s+', ' ', 'g'))))) AS fact_key FROM c),
f AS (SELECT doc_id, fact_key, arg_min(pos, (pos, front, back)) AS pos FROM h GROUP BY doc_id, fact_key), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, fact_key) AS number FROM f WHERE fact_key NOT IN (SELECT fact_key FROM h WHERE pos % 5 = 0))
SELECT doc_id, fact_key, number FROM n WHERE number <= 10""")
def flashcard_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloze cards of each document's two best terms, without those that exist already."""
    d = docs(spark, sf_dir)
    top = text.top_terms(text.tfidf(d, "doc_id", "text"), "doc_id", 2).select("doc_id", "term")
    s = d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))
    cards = assessment.cloze(s.join(top, "doc_id"), "sentence", "term").select("doc_id", "pos", "front", "back", F.col("sentence").alias("evidence"))
    key = F.sha2(F.concat_ws("\u001f", *(T.normalize_term(F.col(c)) for c in ("front", "back", "evidence"))), 256)
    old = cards.where("pos % 5 = 0").select(key.alias("fact_key")).distinct()
    fresh = cards.withColumn("fact_key", key).join(old, "fact_key", "left_anti").drop("fact_key")
    none = cards.limit(0).select("doc_id", F.lit("").alias("fact_key"))
    return study.flashcards([fresh], none, "doc_id", 10).select("doc_id", "fact_key", "number")


QW_SQL = f"""qt AS (SELECT item_id AS topic, term, count(*) AS q FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '{T.WORD}{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x))) AS term FROM benchmark) GROUP BY ALL),
qd AS (SELECT term, count(*) AS df FROM qt GROUP BY term), qw AS (SELECT topic, term, q * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM qt JOIN qd USING (term)), topics AS (SELECT topic, term, w / sqrt(sum(w * w) OVER (PARTITION BY topic)) AS wt FROM qw)"""


@query(f"""WITH {TOP_SQL}, {QW_SQL}, s AS (SELECT doc_id AS chunk, topic, round(sum(weight * wt), 6) AS score FROM tfidf JOIN topics USING (term) WHERE doc_id % 10 <> 0 GROUP BY doc_id, topic HAVING round(sum(weight * wt), 6) >= 0.1)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY score DESC, topic) <= 2""")
def syllabus_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as topics; every tenth document counts as mapped by hand."""
    d = docs(spark, sf_dir)
    chunks = text.tfidf(d, "doc_id", "text").withColumnRenamed("doc_id", "chunk")
    topics = text.tfidf(read(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "topic")
    return study.map_topics(chunks, topics, d.where("doc_id % 10 = 0").select(F.col("doc_id").alias("chunk")), 0.1)


@query(rf"""WITH {SENT_SQL}, tt AS (SELECT doc_id, pos, unnest(list_filter(regexp_extract_all(lower(sentence), '{T.WORD}{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x))) AS term FROM sr WHERE length(sentence) >= 35),
c AS (SELECT doc_id, term, count(*) AS c FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{T.WORD}{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x))) AS term FROM documents) GROUP BY ALL),
s AS (SELECT doc_id, pos, round(3 * count(DISTINCT CASE WHEN term IN ('there', 'tion', 'und', 'les') THEN term END) + avg(c), 4) AS score FROM tt JOIN c USING (doc_id, term) GROUP BY doc_id, pos)
SELECT doc_id, pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM s QUALIFY rank <= 6""")
def important_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study.important_sentences(docs(spark, sf_dir), "doc_id", "text", ["there", "tion", "und", "les"])


@query("""SELECT c_mktsegment, p_brand, count(*) AS wrong, count(DISTINCT o_custkey) AS learners FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
WHERE l_returnflag = 'R' AND coalesce(s_nationkey, c_nationkey) = c_nationkey GROUP BY ALL""")
def wrong_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four inner joins and an outer one with a residual over both sides."""
    t = {n: read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part", "supplier")}
    rows = t["lineitem"].where("l_returnflag = 'R'").join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"), "left").where("coalesce(s_nationkey, c_nationkey) = c_nationkey")
    return rows.groupBy("c_mktsegment", "p_brand").agg(F.count("*").alias("wrong"), F.countDistinct("o_custkey").alias("learners"))


@query()
def syllabus_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's lines as an outline."""
    return study.syllabi(docs(spark, sf_dir), "doc_id", "text")
