"""Evidence: citations, follow-ups, grounding, summaries, co-occurrence, comparison, coverage, glossaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

CITATION = r"\[([^\[\],]+), p\.\s*(\d+)\]"


def citations(answers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, title, page) of [title, p. N] marks, each once whatever its case."""
    pairs = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(CITATION), F.lit(1)).alias("t"), F.regexp_extract_all(text_col, F.lit(CITATION), F.lit(2)).alias("p"))
    return answers.select(id_col, F.explode(pairs).alias("x")).select(id_col, F.lower("x.t").alias("title"), F.col("x.p").cast("long").alias("page")).distinct()


def followups(turns: DataFrame, words: str = "it|this|that|they|these|those", few: int = 4) -> DataFrame:
    """(conv_id, turn, rewritten): a user's turn that points back, or of few words, gets the user's turn before as a prefix."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    c = turns.withColumn("prev", prev).where("role = 'user'")
    short = F.size(F.split(T.strip(F.col("text")), r"\s+")) <= few
    back = F.col("prev").isNotNull() & (F.lower("text").rlike(T.whole(words)) | short)
    return c.select("conv_id", "turn", F.when(back, F.concat_ws(": ", "prev", "text")).otherwise(F.col("text")).alias("rewritten"))


def grounding(turns: DataFrame, least: float = 0.65) -> DataFrame:
    """(conv_id, turn, sentences, supported, score) of an assistant's turns: a sentence is supported if so great a share of its terms is in the user's turn before; 1 without sentences.

    All within a row: nothing is exploded across answers and chunks.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    rows = turns.withColumn("chunk", chunk).where("role = 'assistant'").select("conv_id", "turn", T.grounding_sentences(F.col("text")).alias("s"), T.grounding_terms(F.coalesce("chunk", F.lit(""))).alias("c"))

    def held(sentence: Column) -> Column:
        t = F.array_distinct(T.grounding_terms(sentence))
        return (F.size(t) > 0) & (F.size(F.array_intersect(t, F.col("c"))) >= least * F.size(t))

    n, ok = F.size("s").cast("long"), F.size(F.filter("s", held)).cast("long")
    return rows.select("conv_id", "turn", n.alias("sentences"), ok.alias("supported"), F.when(n == 0, 1.0).otherwise(F.round(ok / n, 6)).alias("score"))


def best_chunks(turns: DataFrame, back: int, least: float = 0.65) -> DataFrame:
    """(conv_id, turn, pos, chunk, overlap, supported) of the sentences of an assistant's turns: the number of the user's turn, among so many before, that holds the greatest share of a sentence's terms, the first of equals; null if none holds any.

    The turns before are few, so all is within the row.
    """
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, -1)
    chunks = F.collect_list(F.when(F.col("role") == "user", F.col("text"))).over(w)
    rows = turns.withColumn("__c", chunks).where("role = 'assistant'").select("conv_id", "turn", F.transform("__c", lambda c: F.array_distinct(T.grounding_terms(c))).alias("c"), F.posexplode(T.grounding_sentences(F.col("text"))).alias("pos", "s")).where(F.size("c") > 0)
    rows = rows.select("conv_id", "turn", F.col("pos").cast("long"), "c", F.array_distinct(T.grounding_terms(F.col("s"))).alias("t"))
    share = lambda c: F.when(F.size("t") == 0, 0.0).otherwise(F.round(F.size(F.array_intersect("t", c)) / F.size("t"), 6))
    best = F.array_min(F.transform("c", lambda c, i: F.struct((-share(c)).alias("o"), (i + 1).cast("long").alias("chunk"))))
    out = rows.select("conv_id", "turn", "pos", best.alias("b"))
    return out.select("conv_id", "turn", "pos", F.when(F.col("b.o") < 0, F.col("b.chunk")).alias("chunk"), F.abs("b.o").alias("overlap"), (F.col("b.o") <= -least).alias("supported"))


def context_blocks(chunks: DataFrame, key: str, order: str, title: Column, page: Column, text: str) -> DataFrame:
    """(key, block): a key's few chunks in order, each under its [title, p.page], with square brackets in the texts replaced by wide ones."""
    plain = T.strip(F.translate(F.col(text), "[]", "［］"))
    line = F.concat(F.lit("["), title, F.lit(", p."), page, F.lit("]\n"), plain)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return chunks.groupBy(key).agg(F.array_join(parts, "\n").alias("block"))


def sentence_array(text: Column) -> Column:
    """The sentences of sentence_rows() as an array."""
    plain = F.transform(T.summary_sentences(text), lambda s: T.strip(F.regexp_replace(s, "^[-*•] ", "")))
    return F.filter(plain, lambda s: s.rlike(r"[.!?]$") & (F.size(F.split(s, r"\s+")) >= 5) & ~s.rlike(T.PLACEHOLDER))


def sentence_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, n, sentence): the sentences of five words or more that end in . ! or ? and hold no placeholder, without a bullet, with their number."""
    once = docs.select(id_col, F.explode(F.array(sentence_array(F.col(text_col)))).alias("s"))  # a filter of the next step stays above this one
    return once.select(id_col, F.size("s").alias("n"), F.posexplode("s").alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


def _term_sums(terms: Column) -> Column:
    """Of each of a text's n sentences, arrays of terms, struct (w, len, n): the sum of tf tf (ln((n + 1) / (df + 1)) + 1) over its different terms, and their number."""
    import pyarrow as pa

    @F.arrow_udf("array<struct<w:double,len:bigint,n:bigint>>")
    def sums(x: pa.Array) -> pa.Array:
        from collections import Counter
        from math import log

        def one(text: list[list[str]]) -> list[dict]:
            counts = [Counter(t) for t in text]
            df = Counter(w for c in counts for w in c)
            idf = {w: log((len(text) + 1) / (k + 1)) + 1 for w, k in df.items()}
            return [{"w": sum(k * k * idf[w] for w, k in c.items()), "len": c.total(), "n": len(text)} for c in counts]

        # one text's terms at a time are Python objects
        return pa.array((None if not v.is_valid else one(v.as_py()) for v in x), pa.list_(pa.struct([("w", pa.float64()), ("len", pa.int64()), ("n", pa.int64())])))

    return sums(terms)


def scored_sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs' (id) with arrays s of sentence_rows() and, in the same order, terms and score (null without terms): all within the row, so that no word is shuffled."""
    rows = docs.select(id_col, sentence_array(F.col(text_col)).alias("s")).select(id_col, "s", F.transform("s", T.summary_terms).alias("terms"))
    summed = rows.select(id_col, "s", "terms", _term_sums(F.col("terms")).alias("sums"))
    score = lambda x, pos: F.when(x["len"] > 0, F.round(x["w"] / F.pow(x["len"].cast("double"), F.lit(0.8)) * (1 + 0.4 * (1 - pos / x["n"])), 6))
    return summed.select(id_col, "s", "terms", F.transform("sums", score).alias("score"))


def sentence_scores(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, score): over a sentence's words the sum of tf (ln((n + 1) / (df + 1)) + 1), over length ** 0.8, times 1 + 0.4 (1 - pos / n).

    tf is a word's count in the sentence, df the number of the text's sentences that
    hold it. A text is scored within its row; ids are taken to be unique.
    """
    # an outer one, as Spark would work all out once more to leave out rows without elements
    rows = scored_sentences(docs, id_col, text_col).select(id_col, F.posexplode_outer("score").alias("pos", "score"))
    return rows.where("score IS NOT NULL").withColumn("pos", F.col("pos").cast("long"))


def summary(docs: DataFrame, id_col: str, text_col: str, target: int = 5, most_alike: float = 0.55) -> DataFrame:
    """(id, pos, sentence): greedily the best sentences that are not too alike (by Jaccard of words), in the text's order.

    All scored sentences of a document are weighed until there are `target`; a document
    of no more candidates keeps them all. A text is weighed within its row.
    """
    rows = scored_sentences(docs, id_col, text_col)
    one = F.transform("score", lambda x, i: F.struct((-x).alias("o"), i.alias("pos"), F.array_distinct(F.get("terms", i)).alias("t")))
    ordered = F.array_sort(F.filter(one, lambda x: x["o"].isNotNull()))

    def weigh(kept: Column, x: Column) -> Column:
        alike = F.exists(kept, lambda k: F.size(F.array_intersect(x["t"], k["t"])) > most_alike * F.size(F.array_union(x["t"], k["t"])))
        return F.when((F.size(kept) >= target) | alike, kept).otherwise(F.concat(kept, F.array(F.struct(x["pos"].alias("pos"), x["t"].alias("t")))))

    best = F.aggregate(ordered, F.array().cast("array<struct<pos:int,t:array<string>>>"), weigh, lambda kept: F.array_sort(F.transform(kept, lambda k: k["pos"])))
    every = F.transform("s", lambda x, i: i)
    chosen = rows.select(id_col, "s", F.when(F.size("s") <= target, every).otherwise(best).alias("at"))
    # an outer one, as in sentence_scores()
    return chosen.select(id_col, F.inline_outer(F.transform("at", lambda i: F.struct(i.cast("long").alias("pos"), F.get("s", i).alias("sentence"))))).where("pos IS NOT NULL")


def two_level_summary(sections: DataFrame, id_col: str, text_col: str, each: int = 3, whole: int = 4) -> DataFrame:
    """(id, pos, sentence): `each` sentences of each section, and of all those put together the `whole` best. sections has (id, section, text); sections are in order."""
    keyed = sections.select(F.struct(id_col, "section").alias("part"), F.col(text_col).alias("text"))
    first = summary(keyed, "part", "text", each)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part.section", "pos", "sentence"))), lambda x: x["sentence"])
    joined = first.groupBy(F.col(f"part.{id_col}").alias(id_col)).agg(F.array_join(lines, "\n").alias("text"))
    return summary(joined, id_col, "text", whole)


def cooccurrence(sentences: DataFrame, id_col: str, terms: DataFrame) -> DataFrame:
    """(id, a, b, weight): terms a < b of a document that share sentences, with how many. terms has (id, term), a few for each document.

    A document's terms go to its sentences as one array, so that no sentence's words are shuffled.
    """
    few = terms.groupBy(id_col).agg(F.collect_set("term").alias("few"))
    held = sentences.join(few, id_col).select(id_col, "pos", F.array_intersect("few", T.terms(F.col("sentence"))).alias("ts")).where(F.size("ts") > 0)
    per = held.groupBy(id_col, "pos").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("ts")).where(F.size("ts") > 1)
    pairs = F.flatten(F.transform("ts", lambda x: F.transform(F.filter("ts", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return per.select(id_col, F.inline(pairs)).groupBy(id_col, "a", "b").agg(F.count("*").alias("weight"))


def node_degrees(edges: DataFrame, id_col: str) -> DataFrame:
    """(id, term, degree, weight) over both ends of the edges."""
    ends = edges.select(id_col, F.explode(F.array("a", "b")).alias("term"), "weight")
    return ends.groupBy(id_col, "term").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


def compare(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared, only_a, only_b) numbers of terms for each pair of documents; terms has (doc_id, term) once each."""
    left = pairs.join(terms, F.col("a") == F.col("doc_id")).select("a", "b", "term", F.lit(1).alias("side"))
    right = pairs.join(terms, F.col("b") == F.col("doc_id")).select("a", "b", "term", F.lit(2).alias("side"))
    per = left.unionByName(right).groupBy("a", "b", "term").agg(F.sum("side").alias("s"))
    return per.groupBy("a", "b").agg(F.count_if(F.col("s") == 3).alias("shared"), F.count_if(F.col("s") == 1).alias("only_a"), F.count_if(F.col("s") == 2).alias("only_b"))


def coverage(mapped: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, chunks, documents, pages, status, covered_percent): none, partial below three chunks, or covered; the share of covered topics stands in each row.

    mapped has (topic, doc_id, chunk, first_page, last_page); pages counts the different pages of documents.
    """
    per = mapped.groupBy("topic").agg(F.countDistinct("doc_id", "chunk").alias("chunks"), F.countDistinct("doc_id").alias("documents"))
    page = mapped.select("topic", "doc_id", F.explode(F.sequence("first_page", "last_page")).alias("page")).distinct().groupBy("topic").agg(F.count("*").alias("pages"))
    n = F.coalesce("chunks", F.lit(0))
    out = topics.join(per, "topic", "left").join(page, "topic", "left")
    out = out.select("topic", n.alias("chunks"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("pages", F.lit(0)).alias("pages"), F.when(n == 0, "none").when(n < 3, "partial").otherwise("covered").alias("status"))
    share = out.agg(F.round(100 * F.count_if(F.col("status") == "covered") / F.count("*"), 2).alias("covered_percent"))
    return out.crossJoin(F.broadcast(share))  # one row


WEIGHTS = {"stored": 1.0, "ner": 0.95, "keyphrase": 0.9}


def glossary(key_terms: DataFrame, custom: DataFrame) -> DataFrame:
    """(owner, term_key, term, source, pages, importance): one entry for each normalised term that is not a custom one.

    The entry of the weightiest source stands for the term; five more pages add up to 0.25. key_terms has (owner, term, source, page).
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in WEIGHTS.items() for x in p)), "source"), F.lit(0.8))
    rows = key_terms.withColumns({"term_key": T.normalize_term(F.col("term")), "w": weight})
    best = F.min(F.struct((-F.col("w")).alias("w"), "term", "source"))
    out = rows.groupBy("owner", "term_key").agg(best.alias("b"), F.countDistinct("page").alias("pages"))
    kept = out.join(custom, ["owner", "term_key"], "left_anti")
    return kept.select("owner", "term_key", "b.term", "b.source", "pages", F.round(-F.col("b.w") + 0.05 * F.least(F.col("pages") - 1, F.lit(5)), 4).alias("importance"))


def evidence_sentences(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(id, term, sentence): of the sentences that hold the term the one where a defining verb follows it, else the longest up to 400 characters, nearest to 180; the first of equals."""
    s = docs.join(terms, id_col).select(id_col, "term", F.posexplode(T.sentences(F.col(text_col))).alias("pos", "sentence"))
    padded = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower("sentence"), F.lit(rf"{T.WORD}+"), F.lit(0)), " "), F.lit(" "))
    held = s.withColumn("padded", padded).where(F.contains("padded", F.concat(F.lit(" "), "term", F.lit(" "))))
    defines = F.greatest(*(F.contains("padded", F.concat(F.lit(" "), "term", F.lit(f" {v} "))) for v in ("is", "are", "refers to", "means"))).cast("int")
    n = F.length("sentence")
    best = F.min(F.struct((-defines).alias("d"), (-F.least(n, F.lit(400))).alias("l"), F.abs(n - 180).alias("g"), "pos", "sentence"))
    return held.groupBy(id_col, "term").agg(best.alias("b")).select(id_col, "term", "b.sentence")


def graph_nodes(key_terms: DataFrame, entries: DataFrame, owner: str, most: int = 40) -> DataFrame:
    """(owner, node_id, label, importance, rank): key terms (owner, term), each mention adding 1, and glossary entries (owner, term, importance), the greatest of which counts if it is more; the most important ones, ties by label."""
    a = key_terms.select(owner, T.normalize_term(F.col("term")).alias("label"), F.lit(1.0).alias("more"), F.lit(0.0).alias("at_least"))
    b = entries.select(owner, T.normalize_term(F.col("term")).alias("label"), F.lit(0.0).alias("more"), F.col("importance").alias("at_least"))
    one = a.unionByName(b).groupBy(owner, "label").agg(F.round(F.greatest(F.sum("more"), F.max("at_least")), 4).alias("importance"))
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("importance"), "label")).cast("long")
    top = one.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.select(owner, F.concat(F.lit("node_"), F.substring(F.sha2("label", 256), 1, 16)).alias("node_id"), "label", "importance", "rank")


def graph_pages(nodes: DataFrame, mentions: DataFrame, pages: DataFrame, owner: str, parts: int = 128) -> DataFrame:
    """(owner, node_id, label, page): the pages of each node, those of its mentions (owner, term, page) and those whose text holds the label as a whole, whatever the case and white space.

    Only pages of (owner, page, text) count; a page is there once for a node. An
    owner's nodes, as few as a graph shows, go as one row to each of the `parts` that
    its pages are dealt to, so that a text is shuffled once and no task has all of a
    large owner's. Null texts hold nothing.
    """
    named = mentions.select(owner, T.normalize_term(F.col("term")).alias("label"), "page")
    own = named.join(nodes.select(owner, "node_id", "label"), [owner, "label"]).join(pages.select(owner, "page").distinct(), [owner, "page"], "left_semi")
    literal = F.regexp_replace("label", r"([^\p{L}\p{N}_ ])", r"\\$1")
    before, after = T.whole("label").split("label")
    pattern = F.concat(F.lit(before), literal, F.lit(after))
    few = nodes.groupBy(owner).agg(F.collect_list(F.struct("node_id", "label", pattern.alias("pattern"))).alias("nodes"))
    dealt = pages.withColumn("__part", F.pmod(F.xxhash64("page"), F.lit(parts)))
    met = dealt.select(owner, "__part").distinct().join(few, owner)
    texts = dealt.join(met, [owner, "__part"]).select(owner, "page", T.normalize_term(F.col("text")).alias("low"), "nodes")
    held = F.filter("nodes", lambda n: F.contains(F.col("low"), n["label"]) & F.regexp_like(F.col("low"), n["pattern"]))
    found = texts.select(owner, "page", F.explode(held).alias("n")).select(owner, "n.node_id", "n.label", "page")
    return own.select(owner, "node_id", "label", "page").unionByName(found).distinct()


def topic_query(c: Column) -> Column:
    """What of a question goes to a web search: its first eight words, at most 120 characters."""
    return F.substring(F.array_join(F.slice(F.split(T.normalize_whitespace(c), " "), 1, 8), " "), 1, 120)


def web_rows(results: DataFrame, query: str, position: str = "position", most: int = 5) -> DataFrame:
    """(query, position, title, url, domain, snippet): of each query's first `most` results (title, url, content) those of an https address with a host and some content.

    Titles are cut at 200 characters, snippets, with their white space made single,
    at 300. Results at one place are taken by address. The first results are chosen
    before any is left out, as a search gives no more than so many.
    """
    first = F.row_number().over(Window.partitionBy(query).orderBy(position, "url"))
    few = results.withColumn("__first", first).where(F.col("__first") <= most)
    host = F.lower(F.regexp_extract("url", "^https://(?:[^/?#@]*@)?([^/:?#@]+)", 1))
    out = few.select(query, position, F.substring(F.coalesce("title", F.lit("")), 1, 200).alias("title"), "url", host.alias("domain"), F.substring(T.normalize_whitespace(F.col("content")), 1, 300).alias("snippet"))
    return out.where((F.col("domain") != "") & (F.col("snippet") != ""))


def web_evidence(claims: DataFrame, results: DataFrame) -> DataFrame:
    """claims (id, url, quote) with valid: whether a result (url, snippet) of that address holds the quote, but for white space."""
    held = results.select(F.col("url").alias("__url"), T.normalize_whitespace(F.col("snippet")).alias("__snippet"))
    quote = T.normalize_whitespace(F.col("quote"))
    both = claims.join(held, F.col("url") == F.col("__url"), "left")
    return both.groupBy("id").agg(F.bool_or(F.coalesce((quote != "") & F.contains("__snippet", quote), F.lit(False))).alias("valid"))


def term_sides(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, term, side, pages_a, pages_b): each term of a pair of documents as shared, only_a or only_b, with the sorted pages of both. terms has (doc_id, term, page)."""
    pages = terms.groupBy("doc_id", "term").agg(F.array_sort(F.collect_set("page")).alias("p"))
    of = lambda c: pairs.join(pages, F.col(c) == F.col("doc_id")).select("a", "b", "term", *(F.when(F.lit(c == x), F.col("p")).alias(f"pages_{x}") for x in ("a", "b")))
    both = of("a").unionByName(of("b")).groupBy("a", "b", "term").agg(F.max("pages_a").alias("pages_a"), F.max("pages_b").alias("pages_b"))
    side = F.when(F.col("pages_b").isNull(), "only_a").when(F.col("pages_a").isNull(), "only_b").otherwise("shared")
    text = lambda c: F.coalesce(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))
    return both.select("a", "b", "term", side.alias("side"), text("pages_a").alias("pages_a"), text("pages_b").alias("pages_b"))


def kept_citations(cited: DataFrame, retrieved: DataFrame, key: str) -> DataFrame:
    """(key, title, page): an answer's citations (key, title, page) that were retrieved for it, (key, title, page); an answer without any cites all that was retrieved."""
    low = retrieved.select(key, F.lower("title").alias("title"), "page").distinct()
    good = cited.select(key, F.lower("title").alias("title"), "page").distinct().join(low, [key, "title", "page"], "left_semi")
    return good.unionByName(low.join(good.select(key).distinct(), key, "left_anti"))


def citation_chunks(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, title, page, chunk): the first chunk (title, chunk, first, last) whose pages hold each citation's page; null if there is none."""
    low = chunks.select(F.lower("title").alias("__title"), "chunk", "first", "last")
    at = F.col("page").between(F.col("first"), F.col("last")) & (F.lower("title") == F.col("__title"))
    return cited.join(low, at, "left").groupBy("id", "title", "page").agg(F.min("chunk").alias("chunk"))
