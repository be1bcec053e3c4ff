"""Secret scans through a trigram inverted index, in DataFrame functions alone.

Each rule's regex is read for the substrings that every match must hold; they
give a Boolean query of trigrams (over lower-cased text). The index has the
postings of those trigrams, in blocks of documents, so that a trigram that a
third of all texts hold is still many short lists. A rule's postings are united
and intersected block by block; the documents that are left are candidates, and
only on them does the regex run. A rule without a mandatory trigram, such as a
run of hex digits, is run on every text.

Of a mandatory string only the rarest trigrams are looked up. A text that has no
posting of any string's rarest trigram cannot be a candidate: it is scanned where
it is read, and only the other texts are shuffled to their rules.
Places are summed up in blocks, so that a text's work grows with its length and
its matches, not with their product.
"""

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A match of the pattern counts if its group has at least so many characters. base: whether it counts as a base span."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),  # a maximal run of [0-9a-f]+ that is long enough
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
#: How many strings one place of a regex may stand for before it is taken as anything.
MOST = 24
#: So many of a string's trigrams are looked up: those of the rarest characters, which stand last here; others count as rarer.
TRIGRAMS, COMMON_FIRST = 2, " etaoinshrdlucmwfgypbvk"
#: Places are summed up, and texts cut, in blocks of so many.
STEP, PIECE = 256, 4096
SPANS = "array<struct<start:int,kind_order:int,kind:string,end:int>>"


def _strings(items: list) -> set[str] | None:
    """All lower-cased strings that a parsed regex matches, or None if they are too many to list."""
    found = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            more = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            more = {chr(c).lower() for _, c in arg}
        elif name == "SUBPATTERN":
            more = _strings(list(arg[-1]))
        elif name == "BRANCH":
            parts = [_strings(list(b)) for b in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and arg[1] in (0, 1) and str(list(arg[2])[0][0]) != "IN":  # an optional class ends the run
            more = _strings(list(arg[2]))
            more = more if more is None or arg[0] else more | {""}
        elif name == "AT":
            more = {""}
        else:
            more = None
        if more is None or len(found) * len(more) > MOST:
            return None
        found = {a + b for a, b in product(found, more)}
    return found


def _rarity(trigram: str) -> tuple[int, str]:
    """Sorts the trigrams of rare characters last."""
    return sum(k if (k := COMMON_FIRST.find(c)) >= 0 else len(COMMON_FIRST) for c in trigram), trigram


def trigram_query(pattern: str) -> list[list[list[str]]]:
    """The Boolean query: all of [any of [all of [trigrams]]], at most TRIGRAMS of a string. Empty: the regex has no mandatory trigram."""
    query, run = [], {""}

    def close() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            query.append(sorted(sorted(sorted({s[i : i + 3] for i in range(len(s) - 2)}, key=_rarity)[-TRIGRAMS:]) for s in run))
        run = {""}

    for item in re._parser.parse(pattern):
        name, arg = str(item[0]), item[1]
        more = _strings([item])
        if more is None and name == "MAX_REPEAT" and arg[0] > 0 and (once := _strings(list(arg[2]))):
            more = once  # at least one; what follows is open
            if len(run) * len(more) <= MOST:
                run = {a + b for a, b in product(run, more)}
            close()
        elif more is None or len(run) * len(more) > MOST:
            close()
            run = more if more and len(more) <= MOST else {""}
        else:
            run = {a + b for a, b in product(run, more)}
    close()
    return query


def trigram_index(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text", block_rows: int = 1024) -> DataFrame:
    """(block, trigram, ids): the postings of the given trigrams in blocks of about block_rows documents."""
    blocks = max(1, -(-docs.count() // block_rows))
    low = F.lower(F.col(text_col))
    held = docs.select(F.col(id_col).alias("id"), low.alias("low")).select("id", F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams))).alias("held"))
    # explode() would have Spark evaluate the whole list once more in a filter before it
    return held.select("id", F.explode_outer("held").alias("trigram")).where("trigram is not null").groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "trigram").agg(_ids(docs, id_col))


def _ids(docs: DataFrame, id_col: str) -> Column:
    """Ids as an array; a null id is kept as a struct that holds it."""
    return F.collect_set(F.struct("id")).alias("ids")


def candidates(index: DataFrame, queries: dict[int, list]) -> DataFrame:
    """(id, rules): the rules, as bits, whose trigram queries a document meets."""
    kind = index.schema["ids"].dataType.simpleString()
    postings = F.map_from_entries(F.collect_list(F.struct("trigram", "ids"))).alias("postings")

    def of(trigram: str) -> Column:
        return F.coalesce(F.try_element_at("postings", F.lit(trigram)), F.expr(f"cast(array() as {kind})"))

    def met(query: list) -> Column:
        every = [reduce(F.array_union, [reduce(F.array_intersect, map(of, all_)) for all_ in any_]) for any_ in query]
        return reduce(F.array_intersect, every)

    def marked(n: int) -> Column:
        return F.transform(met(queries[n]), lambda x: F.struct(x["id"].alias("id"), F.lit(1 << n).alias("bit")))

    hits = F.flatten(F.array(*map(marked, queries)))
    return index.groupBy("block").agg(postings).select(F.inline(hits)).groupBy("id").agg(F.bit_or("bit").alias("rules"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of the bigint values the result over those before it, from 0. Lists are only appended to within blocks."""

    def along(values: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(values, begin, lambda d, x: F.struct(add(d["at"], x).alias("at"), F.array_append(d["out"], d["at"]).alias("out")))["out"]

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda k: F.slice(v, k * STEP + 1, F.lit(STEP)))
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, along(F.transform(b, lambda one: F.aggregate(one, F.lit(0).cast("bigint"), add)), F.lit(0).cast("bigint")), along)))

    return F.when(F.size(values) > 0, _let(values, blocked)).otherwise(F.expr("cast(array() as array<bigint>)"))


def _found(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in the text, in code points.

    The parts between the matches and the matches themselves are summed up in turn.
    """
    size = lambda strings: F.transform(strings, lambda x: F.char_length(x).cast("bigint"))
    add = lambda a, b: a + b
    pattern = F.lit(rule.pattern)
    hit, held = size(F.regexp_extract_all(text, pattern, F.lit(0))), size(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    gap = size(F.split(text, rule.pattern, -1))

    def spans(gap: Column, hit: Column) -> Column:
        steps = F.zip_with(F.slice(gap, F.lit(1), F.size(hit)), hit, add)
        starts = F.zip_with(F.zip_with(_running(steps, add), F.slice(gap, F.lit(1), F.size(hit)), add), hit, lambda s, n: F.struct(s.alias("s"), n.alias("n")))
        every = F.zip_with(starts, held if rule.group else hit, lambda x, n: F.struct(x["s"].cast("int").alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), (x["s"] + x["n"]).cast("int").alias("end"), n.alias("held")))
        kept = F.filter(every, lambda x: x["held"] >= rule.least) if rule.least else every
        return kept.cast(f"{SPANS[:-2]},held:bigint>>")

    whole = _let(gap, lambda g: _let(hit, lambda h: spans(g, h)))
    return F.when(text.rlike(rule.pattern), F.transform(whole, lambda x: F.struct(*(x[c].alias(c) for c in ("start", "kind_order", "kind", "end"))))).otherwise(F.expr(f"cast(array() as {SPANS})"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row struct of docs, found array of spans): every row of docs with the spans of all rules, by start and then by rule.

    Null and empty texts have no spans. Rows that share an id, or have none, are
    each scanned by their own text: the index only tells which ids to look at.
    """
    queries = {n: q for n, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    wanted = sorted({t for q in queries.values() for any_ in q for all_ in any_ for t in all_})
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def scanned(rows: DataFrame, bits: Column | None) -> DataFrame:
        none = F.expr(f"cast(array() as {SPANS})")
        one = lambda n, r: _found(text, r, n) if n not in queries else none if bits is None else F.when(bits.bitwiseAND(1 << n) != 0, _found(text, r, n)).otherwise(none)
        held = rows.select("row", *(one(n, r).alias(f"s{n}") for n, r in enumerate(rules)))
        return held.select("row", F.array_sort(F.concat(*(f"s{n}" for n in range(len(rules))))).alias("found"))

    if not queries:
        return scanned(rows, None)
    # of each rule's shortest clause the rarest trigram of each string: without any of them a text meets no query
    posted = _posted(F.lower(text), sorted({max(all_, key=_rarity) for q in queries.values() for all_ in min(q, key=len)}))
    chosen = candidates(trigram_index(docs, wanted, id_col, text_col), queries).withColumnRenamed("id", "candidate")
    looked_up = rows.where(posted).join(chosen, F.col(f"row.`{id_col}`").eqNullSafe(F.col("candidate")), "left")
    return scanned(rows.where(~posted), None).unionByName(scanned(looked_up, F.coalesce("rules", F.lit(0))))


def _posted(low: Column, trigrams: list[str]) -> Column:
    """Whether a text has a posting of one of these."""
    return _let(low, lambda x: reduce(Column.__or__, (F.contains(x, F.lit(t)) for t in trigrams)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, n_<base kind>..., base_sha256, spans) for every row of docs."""
    found = scan(docs.select(id_col, text_col), id_col, text_col, rules)
    base = [r.kind for r in rules if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col(f"row.`{id_col}`").alias(id_col), *map(count, base), F.sha2(joined(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _masked(text: Column, found: Column, mask: str) -> Column:
    """The text with the spans, in the order of their starts, masked; those that overlap as one.

    The text is cut into pieces once; what stays between two spans is put together
    from the pieces that it touches.
    """
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        """Code points a to b, b exclusive."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        head = F.substring(F.get(pieces, first), (a - first * PIECE + 1).cast("int"), (F.least(b, (first.cast("bigint") + 1) * PIECE) - a).cast("int"))
        rest = F.when(last > first, F.concat(F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substring(F.get(pieces, last), F.lit(1), (b - last * PIECE).cast("int")))).otherwise("")
        return F.when(a < b, F.concat(head, rest)).otherwise("")

    ends = F.transform(found, lambda x: x["end"].cast("bigint"))
    upto = _running(ends, lambda a, b: F.greatest(a, b))
    # a span that begins before another's end belongs to the same mask
    heads = F.filter(F.zip_with(found, upto, lambda x, u: F.struct(u.alias("a"), x["start"].cast("bigint").alias("b"))), lambda x: (x["b"] >= x["a"]))

    def put(pieces: Column) -> Column:
        rest = between(pieces, F.array_max(ends), F.char_length(text).cast("bigint"))
        return F.concat(F.array_join(F.transform(heads, lambda x: F.concat(between(pieces, x["a"], x["b"]), F.lit(mask))), ""), rest)

    return _let(pieces, put)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with each span of its text masked; spans that overlap are masked as one. A null text stays null."""
    found = scan(docs, id_col, text_col, rules)
    text = F.col(f"row.`{text_col}`")
    columns = [F.when(F.size("found") > 0, _masked(text, F.col("found"), mask)).otherwise(text).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns)


def _sql_spans(rule: Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    keep = f"length(regexp_extract(h[i], '{pattern}', {rule.group})) >= {rule.least}"
    return f"""SELECT rid, {order} AS kind_order, '{rule.kind}' AS kind, s AS start, s + length(hit) AS "end" FROM (
      SELECT rid, i, h[i] AS hit, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s FROM (
        SELECT rid, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS p, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS i FROM docs WHERE regexp_matches(text, '{pattern}'))
      WHERE {keep})"""


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """digest() over documents in DuckDB's SQL."""
    base = [r.kind for r in rules if r.base]
    inside = ", ".join(f"'{k}'" for k in base)
    order = "ORDER BY start, kind_order"
    counts = ", ".join(f"count(kind) FILTER (kind = '{k}') AS n_{k}" for k in base)
    one = "kind || ':' || start || ':' || \"end\""
    return f"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    spans AS ({" UNION ALL ".join(_sql_spans(r, n) for n, r in enumerate(rules))})
    SELECT doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' {order}) FILTER (kind IN ({inside})), '')) AS base_sha256, coalesce(string_agg({one}, ',' {order}), '') AS spans
    FROM docs LEFT JOIN spans USING (rid) GROUP BY rid, doc_id"""
