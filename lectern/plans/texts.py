"""Queries of the text pipeline."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import text
from lectern.plans.registry import query
from lectern.sources.tables import dealt, read


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


STOP_SQL = "[" + ", ".join(map(quoted, T.STOP_WORDS)) + "]"
SPACE_SQL = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
STRIP_SQL = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
WORDS_SQL = rf"regexp_extract_all(lower(text), '{T.WORD}{{2,}}')"
TERMS_SQL = f"list_filter({WORDS_SQL}, lambda x: NOT list_contains({STOP_SQL}, x))"
SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?।॥])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "documents")


@query()
def norm_tokens_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no NFKC; the tests compare with a plain Python version."""
    n = docs(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("norm"))
    t = n.select("doc_id", "norm", T.tokens(F.col("norm")).alias("tok"))
    words = T.drop_punctuation(F.col("tok"))
    return t.select("doc_id", F.md5("norm").alias("digest"), F.size("tok").cast("long").alias("tokens"), F.size(words).cast("long").alias("words"), F.size(T.drop_stop_words(words)).cast("long").alias("content"))


@query("""SELECT doc_id, CASE WHEN hi > pa AND hi > en THEN 'hi' WHEN pa > hi AND pa > en THEN 'pa' WHEN en > 0 THEN 'en' ELSE 'und' END AS script FROM (SELECT doc_id,
length(text) - length(regexp_replace(text, '[ऀ-ॿ]', '', 'g')) AS hi, length(text) - length(regexp_replace(text, '[਀-੿]', '', 'g')) AS pa, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS en FROM documents)""")
def lang_script_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.script_language(F.col("text")).alias("script"))


@query(f"""SELECT doc_id, len({SENTENCES_SQL}) AS sentences, len(list_filter(list_transform(regexp_extract_all(text, {quoted(T.GROUNDING_SENTENCE)}), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) AS grounding_sentences FROM documents""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"), F.size(T.grounding_sentences(F.col("text"))).cast("long").alias("grounding_sentences"))


@query(f"""WITH t AS (SELECT {TERMS_SQL} AS t FROM documents), g AS (SELECT 1 AS size, unnest(t) AS ngram FROM t
UNION ALL SELECT 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t UNION ALL SELECT 3, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM t)
SELECT size, ngram, n FROM (SELECT size, ngram, count(*) AS n FROM g GROUP BY size, ngram) QUALIFY row_number() OVER (PARTITION BY size ORDER BY n DESC, ngram) <= 20""")
def ngram_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent runs of one, two and three terms."""
    one = lambda n: text.ngram_counts(docs(spark, sf_dir), F.col("text"), n).orderBy(F.desc("n"), "ngram").limit(20).select(F.lit(n).alias("size"), "ngram", "n")
    return one(1).unionByName(one(2)).unionByName(one(3))


TFIDF_SQL = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS_SQL}) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""


@query(f"WITH {TFIDF_SQL} SELECT doc_id, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 6) DESC, term) AS rank FROM tfidf QUALIFY rank <= 5")
def tfidf_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.top_terms(text.tfidf(docs(spark, sf_dir), "doc_id", "text"), "doc_id", 5)


@query(f"""WITH m AS (SELECT doc_id, list_aggregate(list_transform(regexp_extract_all(lower(text), {quoted(T.TOKEN)}), lambda x: CASE WHEN regexp_matches(x, '^{T.WORD}') AND NOT list_contains({STOP_SQL}, x) THEN x ELSE '|' END), 'string_agg', ' ') AS m FROM documents),
p AS (SELECT doc_id, trim(unnest(string_split(m, '|'))) AS phrase FROM m), ok AS (SELECT *, string_split(phrase, ' ') AS words FROM p WHERE phrase <> '' AND len(string_split(phrase, ' ')) <= 3),
s AS (SELECT doc_id, word, sum(n) / count(*) AS s FROM (SELECT doc_id, unnest(words) AS word, len(words) AS n FROM ok) GROUP BY ALL),
o AS (SELECT doc_id, phrase, unnest(words) AS word FROM (SELECT DISTINCT doc_id, phrase, words FROM ok))
SELECT doc_id, phrase, round(sum(s), 6) AS score FROM o JOIN s USING (doc_id, word) GROUP BY ALL""")
def rake_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.rake(docs(spark, sf_dir), "doc_id", "text")


YAKE_SQL = rf"""WITH sn AS (SELECT doc_id, unnest({SENTENCES_SQL}) AS sentence, unnest(range(len({SENTENCES_SQL}))) AS s FROM documents),
tk AS (SELECT doc_id, s, regexp_extract_all(sentence, {quoted(T.TOKEN)}) AS t FROM sn),
pl AS (SELECT doc_id, s, t, unnest(t) AS w, unnest(range(len(t))) AS p FROM tk),
pw AS (SELECT doc_id, s, p, w, lower(w) AS word, CASE WHEN p > 0 AND regexp_matches(t[p], '^{T.WORD}') THEN lower(t[p]) END AS l, CASE WHEN regexp_matches(t[p + 2], '^{T.WORD}') THEN lower(t[p + 2]) END AS r FROM pl WHERE regexp_matches(w, '^{T.WORD}')),
wd AS (SELECT doc_id, word, NOT list_contains({STOP_SQL}, word) AS content, count(*) AS tf, count(*) FILTER (regexp_matches(w, '^\p{{Lu}}{{{{2,}}}}$')) AS upper, count(*) FILTER (NOT regexp_matches(w, '^\p{{Lu}}{{{{2,}}}}$') AND regexp_matches(w, '^\p{{Lu}}') AND p > 0) AS capital, median(s) AS middle, count(DISTINCT s) AS sf,
coalesce(count(DISTINCT l) / nullif(count(l), 0), 0) + coalesce(count(DISTINCT r) / nullif(count(r), 0), 0) AS free FROM pw GROUP BY doc_id, word),
ab AS (SELECT doc_id, max(tf) AS most, count(*) FILTER (content) AS n, sum(tf) FILTER (content) AS one, sum(tf * tf) FILTER (content) AS two FROM wd GROUP BY doc_id),
sc AS (SELECT doc_id, word, tf, content, 1 + free * tf / most AS relate, greatest(upper, capital) / (1 + ln(tf)) AS casing, ln(ln(3 + middle)) AS pos, one / n + sqrt(greatest(0, two / n - (one / n) * (one / n))) AS usual, sf / (SELECT count(*) FROM sn WHERE sn.doc_id = wd.doc_id) AS dif FROM wd JOIN ab USING (doc_id) WHERE n > 0),
h AS (SELECT doc_id, word, tf, content, relate * pos / (casing + tf / usual / relate + dif / relate) AS h FROM sc),
mk AS (SELECT doc_id, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^[\p{{L}}''’]+$') THEN lower(x) ELSE '|' END) AS t FROM tk),
ng AS (SELECT doc_id, unnest(t) AS phrase FROM mk UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM mk UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM mk),
ph AS (SELECT doc_id, phrase, string_split(phrase, ' ') AS t, count(*) AS kf FROM ng WHERE NOT contains(phrase, '|') AND NOT list_contains({STOP_SQL}, string_split(phrase, ' ')[1]) AND NOT list_contains({STOP_SQL}, string_split(phrase, ' ')[-1]) GROUP BY doc_id, phrase),
ea AS (SELECT doc_id, phrase, kf, t, unnest(t) AS word, unnest(range(len(t))) AS i FROM ph),
bi AS (SELECT doc_id, word, r, count(*) AS n FROM pw WHERE r IS NOT NULL GROUP BY ALL),
al AS (SELECT doc_id, phrase, kf, h AS times, h AS plus FROM ea JOIN h USING (doc_id, word) WHERE content
UNION ALL SELECT e.doc_id, phrase, kf, 1 + (1 - a.n / x.tf * b.n / y.tf), -(1 - a.n / x.tf * b.n / y.tf) FROM ea e JOIN bi a ON a.doc_id = e.doc_id AND a.word = e.t[e.i] AND a.r = e.word JOIN bi b ON b.doc_id = e.doc_id AND b.word = e.word AND b.r = e.t[e.i + 2]
JOIN h x ON x.doc_id = e.doc_id AND x.word = e.t[e.i] JOIN h y ON y.doc_id = e.doc_id AND y.word = e.t[e.i + 2] WHERE e.i > 0 AND list_contains({STOP_SQL}, e.word)),
rk AS (SELECT doc_id, phrase, round(product(times) / (max(kf) * (1 + sum(plus))), 9) AS score FROM al GROUP BY doc_id, phrase),
li AS (SELECT doc_id, list([{{{{'score': score, 'phrase': phrase}}}}] ORDER BY score, phrase) AS l FROM rk GROUP BY doc_id),
be AS (SELECT doc_id, list_reduce(l, lambda b, x: CASE WHEN len(b) >= 10 OR len(list_filter(b, lambda y: 1 - levenshtein(y.phrase, x[1].phrase) / greatest(length(y.phrase), length(x[1].phrase)) > 0.9)) > 0 THEN b ELSE list_concat(b, x) END) AS b FROM li)
SELECT doc_id, unnest(b).phrase AS phrase, unnest(b).score AS score, unnest(range(1, len(b) + 1)) AS rank FROM be""".replace("{{", "{").replace("}}", "}")


@query(YAKE_SQL)
def yake_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.yake(docs(spark, sf_dir), "doc_id", "text")


VOCAB_SQL = f"""vocab AS (SELECT token, count(*) AS n FROM (SELECT unnest({TERMS_SQL}) AS token FROM documents) GROUP BY token HAVING count(*) >= 2 ORDER BY n DESC, token LIMIT 19998)"""


@query(f"WITH {VOCAB_SQL} SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM vocab")
def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.vocabulary(docs(spark, sf_dir), "text")


@query(f"WITH {VOCAB_SQL} SELECT doc_id, count(*) AS tokens, count(vocab.token) AS known FROM (SELECT doc_id, unnest({TERMS_SQL}) AS token FROM documents) t LEFT JOIN vocab USING (token) GROUP BY doc_id")
def oov_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return text.unknown_tokens(d, "doc_id", "text", text.vocabulary(d, "text"))


DIFFICULTY_SQL = f"""base AS (SELECT doc_id, source, len({SENTENCES_SQL}) AS ns, {WORDS_SQL} AS words FROM documents), wd AS (SELECT doc_id, source, ns, unnest(words) AS word FROM base WHERE ns > 0),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM wd GROUP BY word), sy AS (SELECT *, len(regexp_extract_all(word, '[aeiouy]+')) AS g FROM wd JOIN df USING (word)),
y AS (SELECT *, greatest(1, g - CASE WHEN regexp_matches(word, 'e$') AND g > 1 THEN 1 ELSE 0 END) AS y FROM sy),
per AS (SELECT doc_id, source, ns, count(*) AS n, sum(y)::BIGINT AS y, avg(1 / df) AS rarity, avg(CASE WHEN y >= 3 THEN 1 ELSE 0 END) AS technical FROM y GROUP BY ALL),
f AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * n / ns - 84.6::DOUBLE * y / n AS flesch, n / ns AS len FROM per),
difficulty AS (SELECT doc_id, source, round(flesch, 4) AS flesch, round(rarity, 6) AS rarity, round(len, 4) AS sentence_length, round(technical + 1e-9, 6) AS technical, round(greatest(0.0::DOUBLE, (100 - flesch) / 100) + rarity + len / 40 + 3 * technical, 4) AS score FROM f)"""


@query(f"""WITH {DIFFICULTY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM difficulty)
SELECT doc_id, source, flesch, rarity, sentence_length, technical, score, CASE WHEN k < (n + 2) // 3 THEN 0 WHEN k < (2 * n + 2) // 3 THEN 1 ELSE 2 END AS label FROM r""")
def weak_difficulty_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return text.terciles(text.difficulty(d, "doc_id", "text").join(d.select("doc_id", "source"), "doc_id"), "source", "doc_id")


@query("SELECT doc_id, greatest(1, (length(text) + 3) // 4) AS estimate, greatest(1, (length(text) + 3) // 4) > 1000 AS over_budget FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.token_estimate(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", e.alias("estimate"), (e > 1000).alias("over_budget"))


@query(f"""WITH c AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM conversations)
SELECT conv_id, turn, CASE WHEN prev IS NOT NULL AND (regexp_matches(lower(text), '{T.whole("it|this|that|they|these|those")}') OR len(regexp_split_to_array(trim(text), '\\s+')) <= 4) THEN prev || ': ' || text ELSE text END AS rewritten FROM c WHERE role = 'user'""")
def followup_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.evidence import followups

    return followups(read(spark, sf_dir, "conversations"))


@query(rf"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.page_text(F.col("html"))).alias("digest"))


HEADINGS_SQL = r"""hs AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS h FROM pages), hp AS (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS h FROM hs),
headings AS (SELECT page_id, pos, regexp_extract(h, '(?i)<h([1-6])', 1) AS level, trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM hp)"""


@query(f"WITH {HEADINGS_SQL} SELECT * FROM headings")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.headings(read(spark, sf_dir, "pages"))


@query(f"WITH {HEADINGS_SQL} SELECT *, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS next_pos FROM headings")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sections(text.headings(read(spark, sf_dir, "pages")))


ROWS_SQL = r"""raw AS (SELECT doc_id AS page_id, '<p>x</p><table class="t"><tr><td>' || replace(replace(text, ' | ', '</td><td>'), chr(10), '</td></tr><tr><td> ') || '</td></tr><tr><td> </td></tr></table>' AS html FROM documents WHERE contains(text, ' | '))"""


@query("WITH " + ROWS_SQL + r""", ts AS (SELECT page_id, regexp_extract_all(html, '(?is)<table.*?</table>') AS t FROM raw), tp AS (SELECT page_id, unnest(range(1, len(t) + 1)) AS table_no, unnest(t) AS t FROM ts),
l AS (SELECT page_id, table_no, list_filter(list_transform(regexp_extract_all(t, '(?is)<tr.*?</tr>'), lambda r: coalesce(list_aggregate(list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>.*?</t[dh]>'), lambda c: trim(regexp_replace(regexp_replace(c, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), 'string_agg', ' | '), '')), lambda x: regexp_matches(x, '[^\s|]')) AS l FROM tp)
SELECT page_id, table_no, '[Table ' || table_no || ']' || chr(10) || coalesce(list_aggregate(l, 'string_agg', chr(10)), '') AS text FROM l""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of pages made from the documents' lines with bars; the given pages hold none."""
    cells = F.replace(F.replace("text", F.lit(" | "), F.lit("</td><td>")), F.lit("\n"), F.lit("</td></tr><tr><td> "))
    html = F.concat(F.lit('<p>x</p><table class="t"><tr><td>'), cells, F.lit("</td></tr><tr><td> </td></tr></table>"))
    made = docs(spark, sf_dir).where(F.contains("text", F.lit(" | "))).select(F.col("doc_id").alias("page_id"), html.alias("html"))
    return text.tables(made)


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
c AS (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(x, '\.{3,}\s*[0-9]+$'))) AS toc, list_filter(l, lambda x: len(regexp_split_to_array(x, '\s+')) >= 4 AND regexp_matches(x, '[.!?]$') AND NOT regexp_matches(x, '\.{3,}\s*[0-9]+$')) AS f FROM l)
SELECT doc_id, CASE WHEN n = 0 THEN false ELSE NOT ((toc > 0 OR (n > 2 AND (n - len(f)) / n >= 0.5)) AND coalesce(list_sum(list_transform(f, lambda x: len(regexp_split_to_array(x, '\s+')))), 0) < 40) END AS content FROM c""")
def content_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.is_content(docs(spark, sf_dir), "doc_id", "text")


@query(r"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT doc_id, unnest(range(len(l))) AS pos, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS line FROM p)
SELECT doc_id, pos, CASE WHEN regexp_extract(line, '^(#+)\s', 1) <> '' THEN 'heading' WHEN regexp_matches(line, '^[-*•]\s') THEN 'bullet' ELSE 'paragraph' END AS kind, least(length(regexp_extract(line, '^(#+)\s', 1)), 3) AS level,
regexp_replace(regexp_replace(line, '^(?:#+|[-*•])\s', ''), '^\s+|\s+$', '', 'g') AS text FROM x WHERE NOT regexp_matches(line, '^-*$')""")
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.markdown_blocks(docs(spark, sf_dir), "doc_id", "text")


@query()
def sentence_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunks(docs(spark, sf_dir), "doc_id", "text")


@query("SELECT page_id, url_host AS host FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS url_host FROM pages)")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))


@query("""WITH d AS (SELECT doc_id, text, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fact_key FROM documents) SELECT fact_key, min(doc_id) AS doc_id, count(*) AS copies FROM d GROUP BY fact_key""")
def exact_dedupe_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normalised text: an aggregate by digest, so copies do not meet."""
    key = F.sha2(T.normalize_term(F.col("text")), 256)
    return docs(spark, sf_dir).groupBy(key.alias("fact_key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH c AS (SELECT doc_id, source, text || ' [' || source || ', p. ' || (doc_id % 9) || '] and [' || upper(source) || ', p.' || (doc_id % 9) || ']' AS cited FROM documents), m AS (SELECT doc_id, unnest(regexp_extract_all(cited, '\\[([^\\[\\],]+), p\\.\\s*(\\d+)\\]', 1)) AS title, unnest(regexp_extract_all(cited, '\\[([^\\[\\],]+), p\\.\\s*(\\d+)\\]', 2)) AS page FROM c)
SELECT DISTINCT doc_id, lower(title) AS title, page::BIGINT AS page FROM m""")
def citation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.evidence import citations

    cited = F.concat("text", F.lit(" ["), "source", F.lit(", p. "), (F.col("doc_id") % 9).cast("string"), F.lit("] and ["), F.upper("source"), F.lit(", p."), (F.col("doc_id") % 9).cast("string"), F.lit("]"))
    return citations(docs(spark, sf_dir).select("doc_id", cited.alias("cited")), "doc_id", "cited")
