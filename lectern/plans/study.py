"""Queries of evidence, assessment, scheduling, tables and windows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import analytics, assessment, evidence, ranks, tables, text
from lectern.plans.registry import query
from lectern.plans.texts import SENTENCES_SQL, STOP_SQL, TFIDF_SQL, docs
from lectern.sources.tables import ANSWERS_SQL, REVIEWS_SQL, answers, read, reviews
from lectern.streaming import windows

GTERMS_SQL = "list_filter(list_transform(regexp_extract_all({}, '" + T.GROUNDING_TOKEN.replace("'", "''") + "'), lambda w: lower(w)), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.GROUNDING_STOP_WORDS) + "], w))"
GSENT_SQL = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+(?:[.!?]+|$)'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(f"""WITH c AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS chunk FROM conversations),
a AS (SELECT conv_id, turn, {GSENT_SQL} AS s, {GTERMS_SQL.format("coalesce(chunk, '')")} AS c FROM c WHERE role = 'assistant'),
x AS (SELECT conv_id, turn, len(s) AS sentences, len(list_filter(s, lambda y: len(list_distinct({GTERMS_SQL.format("y")})) > 0 AND len(list_intersect(list_distinct({GTERMS_SQL.format("y")}), c)) >= 0.65 * len(list_distinct({GTERMS_SQL.format("y")})))) AS supported FROM a)
SELECT *, CASE WHEN sentences = 0 THEN 1 ELSE round(supported / sentences, 6) END AS score FROM x""")
def grounding_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.grounding(read(spark, sf_dir, "conversations"))


_Q = lambda x: x.replace("'", "''")
SUMMARY_SENTENCES_SQL = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '{_Q(T.LINE_END)}', chr(1), 'g'), '{_Q(T.INITIALISM)}', '\1' || chr(2) || '\2', 'g'), '{_Q(T.SENTENCE_END)}', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(replace(x, chr(2), ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""
SROWS_SQL = rf"""sp AS (SELECT doc_id, list_transform({SUMMARY_SENTENCES_SQL}, lambda x: regexp_replace(regexp_replace(x, '^[-*•] ', ''), '^\s+|\s+$', '', 'g')) AS s FROM documents),
so AS (SELECT doc_id, list_filter(s, lambda s: regexp_matches(s, '[.!?]$') AND len(regexp_split_to_array(s, '\s+')) >= 5 AND NOT regexp_matches(s, '{T.PLACEHOLDER}')) AS s FROM sp),
sr AS (SELECT doc_id, len(s) AS n, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM so),
st AS (SELECT doc_id, n, pos, unnest(list_filter(regexp_extract_all(lower(sentence), '{T.WORD}{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x))) AS term FROM sr)"""
SUMMARY_STOP_SQL = "[" + ", ".join(f"'{_Q(w)}'" for w in T.SUMMARY_STOP_WORDS) + "]"
SCORES_SQL = f"""{SROWS_SQL}, ut AS (SELECT doc_id, n, pos, unnest(list_filter(regexp_extract_all(lower(sentence), '{T.WORD}+'), lambda x: regexp_matches(x, '^[a-z0-9_]{{2,}}$') AND NOT list_contains({SUMMARY_STOP_SQL}, x))) AS term FROM sr),
pr AS (SELECT doc_id, term, count(DISTINCT pos) AS df FROM ut GROUP BY ALL), tc AS (SELECT doc_id, n, pos, term, count(*) AS tf FROM ut GROUP BY ALL),
sm AS (SELECT doc_id, pos, n, sum(tf * tf * (ln((n + 1) / (df + 1)) + 1)) AS w, sum(tf) AS len FROM tc JOIN pr USING (doc_id, term) GROUP BY doc_id, pos, n),
scores AS (SELECT doc_id, pos, round(w / pow(len::DOUBLE, 0.8::DOUBLE) * (1 + 0.4::DOUBLE * (1 - pos / n)), 6) AS score FROM sm)"""


@query(f"WITH {SCORES_SQL} SELECT * FROM scores")
def extractive_sentence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.sentence_scores(docs(spark, sf_dir), "doc_id", "text")


@query()
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.summary(docs(spark, sf_dir), "doc_id", "text")


@query()
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of ten lines, three sentences each, and four of those."""
    lines = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("l"))
    section = lines.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("CAST((size(l) - 1) div 10 AS INT)"))).alias("section"), "l")
    return evidence.two_level_summary(section.select("doc_id", "section", F.array_join(F.slice("l", F.col("section") * 10 + 1, F.lit(10)), "\n").alias("text")), "doc_id", "text")


@query(rf"""WITH so AS (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents), k AS (SELECT doc_id, list_filter(s, lambda x: regexp_matches(x, '[.!?]$') AND len(regexp_split_to_array(x, '\s+')) >= 7) AS s FROM so)
SELECT doc_id, unnest(range(least(len(s), 3))) AS pos, unnest(s[1:3]) AS sentence FROM k""")
def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sentences of seven words or more."""
    ok = F.filter(T.sentences(F.col("text")), lambda s: s.rlike(r"[.!?]$") & (F.size(F.split(s, r"\s+")) >= 7))
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.slice(ok, 1, 3)).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


TOP_SQL = f"{TFIDF_SQL}, top AS (SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank FROM tfidf QUALIFY rank <= 8)"
EDGES_SQL = f"""{TOP_SQL}, {SROWS_SQL}, h AS (SELECT DISTINCT doc_id, pos, term FROM st SEMI JOIN top USING (doc_id, term)),
edges AS (SELECT x.doc_id, x.term AS a, y.term AS b, count(*) AS weight FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.pos = y.pos AND x.term < y.term GROUP BY ALL)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return evidence.cooccurrence(evidence.sentence_rows(d, "doc_id", "text"), "doc_id", text.top_terms(text.tfidf(d, "doc_id", "text"), "doc_id", 8))


@query(f"WITH {EDGES_SQL} SELECT * FROM edges")
def cooccurrence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


@query(f"WITH {EDGES_SQL} SELECT doc_id, term, count(*) AS degree, sum(weight)::BIGINT AS weight FROM (SELECT doc_id, a AS term, weight FROM edges UNION ALL SELECT doc_id, b, weight FROM edges) GROUP BY ALL")
def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.node_degrees(edges(spark, sf_dir), "doc_id")


@query(f"""WITH {TOP_SQL}, p AS (SELECT doc_id AS a, lead(doc_id) OVER (ORDER BY doc_id) AS b FROM documents QUALIFY b IS NOT NULL), s AS (SELECT a, b, term, 1 AS side FROM p JOIN top ON doc_id = a UNION ALL SELECT a, b, term, 2 FROM p JOIN top ON doc_id = b),
t AS (SELECT a, b, term, sum(side) AS s FROM s GROUP BY ALL) SELECT a, b, count(*) FILTER (s = 3) AS shared, count(*) FILTER (s = 1) AS only_a, count(*) FILTER (s = 2) AS only_b FROM t GROUP BY a, b""")
def doc_term_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    terms = text.top_terms(text.tfidf(d, "doc_id", "text"), "doc_id", 8).select("doc_id", "term")
    return evidence.compare(terms, neighbours(d))


def neighbours(d: DataFrame) -> DataFrame:
    """(a, b): each document's id and the next one that there is, by joining ranks."""
    placed = ranks.ranked(d.select("doc_id").withColumn("__all", F.lit(0)), ["__all"], F.floor(F.col("doc_id") / 4096), [F.col("doc_id")], "k")
    return placed.select(F.col("doc_id").alias("a"), "k").join(placed.select(F.col("doc_id").alias("b"), (F.col("k") - 1).alias("k")), "k").select("a", "b")


@query(f"""WITH topics AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '{T.WORD}{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x))) AS topic FROM benchmark), ls AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM ls), mp AS (SELECT DISTINCT doc_id, pos // 5 AS chunk, unnest(list_filter(regexp_extract_all(lower(line), '{T.WORD}{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x))) AS topic FROM line),
ch AS (SELECT doc_id, pos // 5 AS chunk, count(*) AS lines FROM line GROUP BY ALL), per AS (SELECT topic, count(*) AS chunks, count(DISTINCT doc_id) AS documents, sum(lines)::BIGINT AS pages FROM mp JOIN ch USING (doc_id, chunk) GROUP BY topic),
c AS (SELECT topic, coalesce(chunks, 0) AS chunks, coalesce(documents, 0) AS documents, coalesce(pages, 0) AS pages, CASE WHEN coalesce(chunks, 0) = 0 THEN 'none' WHEN chunks < 3 THEN 'partial' ELSE 'covered' END AS status FROM topics LEFT JOIN per USING (topic))
SELECT *, (SELECT round(100 * count(*) FILTER (status = 'covered') / count(*), 2) FROM c) AS covered_percent FROM c""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark as topics, five lines as a chunk, a line as a page."""
    topics = read(spark, sf_dir, "benchmark").select(F.explode(T.terms(F.col("text"))).alias("topic")).distinct()
    lines = docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("l"))
    chunks = lines.select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("CAST((size(l) - 1) div 5 AS INT)"))).alias("chunk"), "l")
    last = F.least(F.col("chunk") * 5 + 5, F.size("l"))
    words = chunks.select("doc_id", "chunk", (F.col("chunk") * 5).alias("first_page"), (last - 1).alias("last_page"), T.terms(F.array_join(F.slice("l", F.col("chunk") * 5 + 1, F.lit(5)), "\n")).alias("t"))
    mapped = words.select("doc_id", "chunk", "first_page", "last_page", F.explode(F.array_distinct("t")).alias("topic")).join(topics, "topic", "left_semi")
    return evidence.coverage(mapped, topics)


@query(f"""WITH {TOP_SQL}, kt AS (SELECT source AS owner, term, CASE rank WHEN 1 THEN 'stored' WHEN 2 THEN 'ner' WHEN 3 THEN 'keyphrase' ELSE 'other' END AS src, doc_id AS page FROM top JOIN documents USING (doc_id)),
wt AS (SELECT *, lower(term) AS term_key, CASE src WHEN 'stored' THEN 1.0 WHEN 'ner' THEN 0.95 WHEN 'keyphrase' THEN 0.9 ELSE 0.8 END::DOUBLE AS w FROM kt),
g AS (SELECT owner, term_key, arg_min(term, (-w, term, src)) AS term, arg_min(src, (-w, term, src)) AS source, max(w) AS w, count(DISTINCT page) AS pages FROM wt GROUP BY owner, term_key)
SELECT owner, term_key, term, source, pages, round(w + 0.05::DOUBLE * least(pages - 1, 5), 4) AS importance FROM g WHERE term_key NOT LIKE 'q%'""")
def glossary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    top = text.top_terms(text.tfidf(d, "doc_id", "text"), "doc_id", 8).join(d.select("doc_id", F.col("source").alias("owner")), "doc_id")
    kind = F.when(F.col("rank") == 1, "stored").when(F.col("rank") == 2, "ner").when(F.col("rank") == 3, "keyphrase").otherwise("other")
    terms = top.select("owner", "term", kind.alias("source"), F.col("doc_id").alias("page"))
    custom = terms.where(F.col("term").startswith("q")).select("owner", F.col("term").alias("term_key")).distinct()
    return evidence.glossary(terms, custom)


@query(f"""WITH {TOP_SQL}, so AS (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents), sr AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM so),
p AS (SELECT *, ' ' || list_aggregate(regexp_extract_all(lower(sentence), '{T.WORD}+'), 'string_agg', ' ') || ' ' AS padded FROM sr),
h AS (SELECT doc_id, term, pos, sentence, CASE WHEN contains(padded, ' ' || term || ' is ') OR contains(padded, ' ' || term || ' are ') OR contains(padded, ' ' || term || ' refers to ') OR contains(padded, ' ' || term || ' means ') THEN -1 ELSE 0 END AS d
FROM p JOIN top USING (doc_id) WHERE rank = 1 AND contains(padded, ' ' || term || ' '))
SELECT doc_id, term, arg_min(sentence, (d, -least(length(sentence), 400), abs(length(sentence) - 180), pos)) AS sentence FROM h GROUP BY doc_id, term""")
def evidence_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    first = text.top_terms(text.tfidf(d, "doc_id", "text"), "doc_id", 1).select("doc_id", "term")
    return evidence.evidence_sentences(d.select("doc_id", "text"), "doc_id", "text", first)


@query("""WITH p AS (SELECT a.conv_id || ':' || a.turn AS pair, CASE WHEN a.turn % 4 = 1 THEN 'open' ELSE 'mcq' END AS kind, a.text AS answer, u.text AS expected FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
side AS (SELECT pair, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS t, 1 AS side FROM p UNION ALL SELECT pair, unnest(regexp_extract_all(lower(expected), '[a-z0-9]+')), 2 FROM p),
per AS (SELECT pair, t, count(*) FILTER (side = 1) AS x, count(*) FILTER (side = 2) AS y FROM side GROUP BY ALL), f AS (SELECT pair, round(2.0::DOUBLE * sum(least(x, y)) / (sum(x) + sum(y)), 6) AS f1 FROM per GROUP BY pair)
SELECT pair, f1, CASE WHEN kind = 'open' THEN f1 >= 0.78 ELSE lower(trim(regexp_replace(answer, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(expected, '\\s+', ' ', 'g'))) END AS is_correct FROM p JOIN f USING (pair)""")
def token_f1_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    u = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected"))
    p = c.select("conv_id", "turn", F.col("text").alias("answer")).join(u, ["conv_id", "turn"])
    p = p.select(F.concat_ws(":", "conv_id", "turn").alias("pair"), F.when(F.col("turn") % 4 == 1, "open").otherwise("mcq").alias("kind"), "answer", "expected")
    return assessment.grade(p, "kind", "answer", "expected").select("pair", "f1", "is_correct")


@query(f"""WITH {TOP_SQL}, so AS (SELECT doc_id, {SENTENCES_SQL} AS s FROM documents), sr AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM so),
x AS (SELECT doc_id, pos, sentence, term, instr(' ' || regexp_replace(lower(sentence), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') || ' ', ' ' || term || ' ') AS k FROM sr JOIN top USING (doc_id) WHERE rank <= 2)
SELECT doc_id, pos, substring(sentence, 1, k - 1) || '____' || substring(sentence, k + length(term), length(sentence)) AS front, term AS back FROM x WHERE k > 0""")
def cloze_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    top = text.top_terms(text.tfidf(d, "doc_id", "text"), "doc_id", 2).select("doc_id", "term")
    s = d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))
    return assessment.cloze(s.join(top, "doc_id"), "sentence", "term").select("doc_id", "pos", "front", "back")


@query(f"""WITH {TOP_SQL}, r AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM top),
x AS (SELECT doc_id, term, n, k, unnest(range(1, least(9, n - 1) + 1)) AS s FROM r WHERE n > 1), o AS (SELECT x.doc_id, x.term, s, r.term AS distractor FROM x JOIN r ON x.doc_id = r.doc_id AND (x.k + s) % x.n = r.k WHERE NOT contains(r.term, x.term) AND NOT contains(x.term, r.term))
SELECT doc_id, term, distractor, row_number() OVER (PARTITION BY doc_id, term ORDER BY s) AS rank FROM o QUALIFY rank <= 3""")
def distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.distractors(text.top_terms(text.tfidf(docs(spark, sf_dir), "doc_id", "text"), "doc_id", 8), "doc_id", "term", "weight")


@query("""SELECT p_partkey, least(2, greatest(0, p_partkey % 3 + CASE WHEN p_size >= 40 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 <= 1 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 >= 5 THEN 1 ELSE 0 END)) AS difficulty FROM part""")
def difficulty_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select("p_partkey", assessment.blended_difficulty(k % 3, F.when(F.col("p_size") >= 40, 4).otherwise(0), k % 5, F.when(k % 7 >= 5, 2).otherwise(0)).alias("difficulty"))


@query(f"""WITH RECURSIVE {REVIEWS_SQL}, log AS (SELECT user_id, card_id, CASE rating WHEN 'again' THEN 1 WHEN 'hard' THEN 3 WHEN 'good' THEN 4 ELSE 5 END AS q, row_number() OVER (PARTITION BY user_id, card_id ORDER BY reviewed_at, review_id) AS k FROM reviews),
s AS (SELECT user_id, card_id, 0::BIGINT AS k, 2.5::DOUBLE AS ease, 0::DOUBLE AS "interval", 0 AS repetitions FROM log WHERE k = 1
UNION ALL SELECT s.user_id, s.card_id, l.k, greatest(1.3::DOUBLE, ease + 0.1::DOUBLE - (5 - q) * (0.08::DOUBLE + (5 - q) * 0.02::DOUBLE)), CASE WHEN q < 3 OR repetitions = 0 THEN 1 WHEN repetitions = 1 THEN 6 ELSE round_even("interval" * greatest(1.3::DOUBLE, ease + 0.1::DOUBLE - (5 - q) * (0.08::DOUBLE + (5 - q) * 0.02::DOUBLE)), 0) END, CASE WHEN q < 3 THEN 0 ELSE repetitions + 1 END
FROM s JOIN log l ON l.user_id = s.user_id AND l.card_id = s.card_id AND l.k = s.k + 1)
SELECT user_id, card_id, k AS reviews, round(ease, 6) AS ease, "interval"::BIGINT AS "interval", repetitions::BIGINT AS repetitions FROM s WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY user_id, card_id ORDER BY k DESC) = 1""")
def sm2_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.sm2_replay(reviews(spark, sf_dir), "user_id", "card_id")


@query(f"""WITH {ANSWERS_SQL}, acc AS (SELECT topic, CASE WHEN count(is_correct) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (is_correct) / count(is_correct), 2) ELSE 0 END AS accuracy FROM answers WHERE question_id % 5 <> 0 GROUP BY topic),
sec AS (SELECT p_brand AS document, p_type AS topic, count(*) AS pages, CAST(max(p_size % 3) AS INTEGER) AS difficulty FROM part GROUP BY ALL), x AS (SELECT document, topic, pages, [0.9, 1.0, 1.25][difficulty + 1]::DOUBLE AS m, 1 - coalesce(accuracy, 100) / 100 AS weak FROM sec LEFT JOIN acc USING (topic))
SELECT document, topic, round(weak, 6) AS weak, greatest(15, CAST(round_even(10 * pages * m * (1 + 0.75::DOUBLE * weak), 0) AS BIGINT)) AS minutes, round(1 + weak + 0.25::DOUBLE * m, 6) AS importance FROM x""")
def study_topic_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as documents and types as their sections, whose title is met whatever its case; the questions' accuracy of a part of the answers."""
    return study_sections(spark, sf_dir)


def study_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("document"), F.col("p_type").alias("topic")).agg(F.count("*").alias("pages"), F.max(F.col("p_size") % 3).alias("difficulty"))
    of = analytics.accuracy(answers(spark, sf_dir).where("question_id % 5 <> 0").withColumn("topic", F.lower("topic")), "topic")
    return assessment.study_topics(parts, of).select("document", "topic", "weak", "minutes", "importance")


@query("WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i, count(*) OVER () AS n, (SELECT count(*) FROM events) AS total FROM (SELECT DISTINCT event_type FROM events)) SELECT event_type AS kind, total // n + CASE WHEN i < total % n THEN 1 ELSE 0 END AS quota FROM k")
def type_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.type_quotas(read(spark, sf_dir, "events"), "event_type")


@query("""WITH r AS (SELECT l_partkey % 50 AS g, l_orderkey * 10 + l_linenumber AS id, l_returnflag = 'A' AS flag FROM lineitem), c AS (SELECT g, count(*) FILTER (flag) AS t, count(*) FILTER (NOT flag) AS f FROM r GROUP BY g),
k AS (SELECT r.*, t, f, row_number() OVER (PARTITION BY r.g, flag ORDER BY id) AS rn FROM r JOIN c USING (g)) SELECT g, flag, count(*) AS n FROM k WHERE rn <= CASE WHEN flag THEN 7 * f // 3 ELSE 7 * t // 3 END GROUP BY g, flag""")
def tf_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_partkey % 50 AS g", "l_orderkey * 10 + l_linenumber AS id", "l_returnflag = 'A' AS flag")
    return assessment.balance(rows, "g", "flag", "id").groupBy("g", "flag").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT p_brand, p_partkey, [p_name, p_type, p_brand] AS o, p_size::BIGINT AS marks, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS number, sum(p_size) OVER (PARTITION BY p_brand)::BIGINT AS section_marks FROM part)
SELECT p_brand, number, p_partkey, chr(65 + unnest(range(3))::INTEGER) AS option_letter, unnest(o) AS option, marks, section_marks FROM q""")
def exam_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessment.exam_paper(read(spark, sf_dir, "part"), "p_brand", "p_partkey", F.array("p_name", "p_type", "p_brand"), F.col("p_size").cast("long"))


@query()
def study_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks' plans of all brands over their sections."""
    return assessment.study_plan(study_sections(spark, sf_dir), "document", 14, 60)


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent_id FROM part), t AS (SELECT id, 0 AS depth, id::VARCHAR AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.id FROM n JOIN t ON n.parent_id = t.id) SELECT * FROM t""")
def recursive_topic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tree(read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CASE WHEN p_partkey >= 10 THEN p_partkey div 10 END AS parent_id"))


@query("""WITH new AS (SELECT c_custkey, c_name || '*' AS c_name, c_nationkey FROM customer WHERE c_custkey % 10 = 0) SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM new) UNION ALL SELECT * FROM new""")
def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    new = old.where("c_custkey % 10 = 0").withColumn("c_name", F.concat("c_name", F.lit("*")))
    return tables.replace_by_key(old, new, "c_nationkey")


@query("""WITH new AS (SELECT c_custkey, max(c_acctbal + k) AS c_acctbal FROM customer, (SELECT 1 AS k UNION ALL SELECT 2) WHERE c_custkey % 3 = 0 GROUP BY c_custkey) SELECT c_custkey, coalesce(new.c_acctbal, customer.c_acctbal) AS c_acctbal FROM customer LEFT JOIN new USING (c_custkey)""")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    some = old.where("c_custkey % 3 = 0")
    return tables.upsert(old, some.withColumn("c_acctbal", F.col("c_acctbal") + 1).unionByName(some.withColumn("c_acctbal", F.col("c_acctbal") + 2)), "c_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.duplicates(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT user_id, floor(epoch(time_bucket(INTERVAL 1 HOUR, ts)))::BIGINT AS start, count(*) AS n FROM events GROUP BY 1, 2")
def fixed_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.fixed_windows(read(spark, sf_dir, "events"), "user_id", "1 hour").withColumn("start", F.unix_seconds("start"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trailing_counts(read(spark, sf_dir, "events"), "user_id", 21_600).select("event_id", "n")


@query("SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 36000000000, false) AS hit FROM events")
def cache_hits_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cache_hits(read(spark, sf_dir, "events"), ["user_id", "event_type"], 36_000).select("event_id", "hit")


@query("""WITH s AS (SELECT user_id, min(ts) AS started FROM events GROUP BY user_id) SELECT user_id, count(*) AS saved FROM events JOIN s USING (user_id) WHERE ts <= started + INTERVAL 5 DAY GROUP BY user_id""")
def late_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions within five days of a learner's first one."""
    e = read(spark, sf_dir, "events")
    starts = e.groupBy("user_id").agg(F.min("ts").alias("started"))
    return windows.in_time(e.join(starts, "user_id"), "started", 5 * 86_400).groupBy("user_id").agg(F.count("*").alias("saved"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(read(spark, sf_dir, "events"), "user_id", "4 hours").withColumn("start", F.unix_seconds("start"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest_status(read(spark, sf_dir, "events").selectExpr("user_id", "ts", "event_id AS id", "event_type AS status"), "user_id")


@query("""SELECT user_id, event_type, (count(*) FILTER (event_id % 2 = 0) + count(*) FILTER (event_id % 2 = 1))::BIGINT AS attempts FROM events GROUP BY ALL""")
def topic_stats_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of half the rows with the other half added as a batch."""
    e = read(spark, sf_dir, "events")
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id", "event_type").agg(F.count("*").alias("attempts"))
    return tables.add_to(half(0), half(1), ["user_id", "event_type"], ["attempts"])
