"""The registered queries of the engine and, where SQL can express them, what DuckDB should find.

Documents without a time get one: 2024-01-01 and as many hours as their id says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import analysis, scalar
from siftwell.functions.analysis import SIMPLE, STOP
from siftwell.functions.arrays import let
from siftwell.operators import changes, match, postings, rank, snippets, spans, triples
from siftwell.operators.match import Matcher
from siftwell.plans import boolean, human
from siftwell.plans.parts import PROHIBITED, DateRange, Fuzzy, MatchAll, Or, Part, Prefix, Property, Query, Text, TermRange, Uri, Wildcard
from siftwell.sources import html, tables
from siftwell.streaming import live

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


# --- documents as both engines see them ---------------------------------------------------------------------------

_TERMS = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"
_DOCS = f"d AS (SELECT 'doc:' || doc_id AS uri, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS ts, lang, source, n_chars, text, {_TERMS} AS terms FROM documents)"


def _docs(spark: SparkSession, sf_dir: str, analyzer: analysis.Analyzer = SIMPLE) -> DataFrame:
    return match.analyzed(tables.documents(spark, sf_dir), analyzer)


def _find(query: Query | Part) -> Run:
    return lambda spark, sf_dir: Matcher(SIMPLE).search(_docs(spark, sf_dir), query).select("uri")


def _typed(text: str) -> Run:
    return _find(human.parse(text))


def _uris(where: str) -> str:
    return f"WITH {_DOCS} SELECT uri FROM d WHERE {where}"


def _t(w: str) -> str:
    """A text part of one word: in the text, or the whole of a keyword."""
    return f"(list_contains(terms, '{w}') OR lower(lang) = '{w}' OR lower(source) = '{w}')"


def _p(*ws: str) -> str:
    here = " AND ".join(f"terms[i + {k}] = '{w}'" for k, w in enumerate(ws))
    return f"(len(list_filter(range(1, len(terms) + 1), lambda i: {here})) > 0)"


def _any(test: str) -> str:
    return f"(len(list_filter(terms, lambda t: {test})) > 0)"


def _key(test: str) -> str:
    return "(" + " OR ".join(f"({test.replace('$', f'lower({c})')})" for c in ("lang", "source")) + ")"


# --- text ----------------------------------------------------------------------------------------------------------

_add("text_term", _typed("thing"), _uris(_t("thing")))
_add("text_and", _typed("thing attion"), _uris(f"{_t('thing')} AND {_t('attion')}"))
_add("text_not", _typed("thing -attion"), _uris(f"{_t('thing')} AND NOT {_t('attion')}"))
_add("text_or", _typed("thing OR nicht OR ersch"), _uris(f"{_t('thing')} OR {_t('nicht')} OR {_t('ersch')}"))
_add("text_or_and", _typed("ering OR oning thble"), _uris(f"({_t('ering')} OR {_t('oning')}) AND {_t('thble')}"))
_add("text_or_trailing", _typed("thing OR"), _uris("false"))
_add("text_phrase", _typed('"to thanedble the"'), _uris(_p("to", "thanedble", "the")))
_add("text_phrase_not", _typed('thble -"and attion"'), _uris(f"{_t('thble')} AND NOT {_p('and', 'attion')}"))
_add("text_keyword_value", _typed("SRC7"), _uris(_t("src7").replace("list_contains(terms, 'src7')", "list_contains(terms, 'src')")))
_add("text_only_body", _find(Text("de", properties=False)), _uris("list_contains(terms, 'de')"))
_add("text_only_properties", _find(Text("de", full_text=False)), _uris("lower(lang) = 'de' OR lower(source) = 'de'"))
_add(
    "stopword_drop",
    lambda s, d: Matcher(STOP).search(_docs(s, d, STOP), human.parse("the thing is")).select("uri"),
    _uris(_t("thing")),
)
_add("stopword_only", lambda s, d: Matcher(STOP).search(_docs(s, d, STOP), human.parse("the")).select("uri"), _uris("false"))
_add(
    "stopword_phrase",
    lambda s, d: Matcher(STOP).search(_docs(s, d, STOP), human.parse('"thanedble the anea"')).select("uri"),
    rf"""WITH d AS (SELECT 'doc:' || doc_id AS uri, list_filter(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+'), lambda t: t NOT IN ({", ".join(f"'{w}'" for w in analysis.STOP_WORDS)})) AS terms FROM documents)
SELECT uri FROM d WHERE {_p("thanedble", "anea")}""",
)
_add("wildcard_star", _typed("thanea*ion"), _uris(_any("regexp_full_match(t, 'thanea.*ion')") + " OR " + _key("regexp_full_match($, 'thanea.*ion')")))
_add("wildcard_question", _find(Wildcard("th?ng")), _uris(_any("regexp_full_match(t, 'th.ng')") + " OR " + _key("regexp_full_match($, 'th.ng')")))
_add("prefix_query", _find(Prefix("thinti")), _uris(_any("starts_with(t, 'thinti')") + " OR " + _key("starts_with($, 'thinti')")))
_add("range_query", _find(TermRange("thinb", "thind")), _uris(_any("t >= 'thinb' AND t <= 'thind'")))
_add("range_exclusive", _find(boolean.parse("{nicht TO nicko}")), _uris(_any("t > 'nicht' AND t < 'nicko'")))
_add("range_open", _find(boolean.parse("[zz TO *]")), _uris(_any("t >= 'zz'")))
_add("fuzzy_query", _find(Fuzzy("thinking", 0.7)), _uris(_any("1 - levenshtein(t, 'thinking') / least(length(t), 8)::DOUBLE > 0.7")))
_add("match_all", _find(MatchAll()), _uris("true"))
_add("min_should_match", _find(Or([Text("thing"), Text("attion"), Text("ering"), Text("oning")], least=3)), _uris(f"{_t('thing')}::INT + {_t('attion')}::INT + {_t('ering')}::INT + {_t('oning')}::INT >= 3"))
_add("boolean_nested", _find(boolean.parse("(thing OR nicht) AND NOT (attion AND thble)")), _uris(f"({_t('thing')} OR {_t('nicht')}) AND NOT ({_t('attion')} AND {_t('thble')})"))
_add("boolean_default_and", _find(boolean.parse("thing attion !oning", default_and=True)), _uris(f"{_t('thing')} AND {_t('attion')} AND NOT {_t('oning')}"))
_add(
    "sloppy_phrase",
    _find(boolean.parse('"thing attion"~8')),
    _uris("(len(list_filter(range(1, len(terms) + 1), lambda i: terms[i] = 'thing' AND len(list_filter(range(1, len(terms) + 1), lambda j: terms[j] = 'attion' AND abs(j - 1 - i) <= 8)) > 0)) > 0)"),
)

# --- spans ----------------------------------------------------------------------------------------------------------


def _spans(build: Callable[[DataFrame], object]) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _docs(spark, sf_dir)
        # An outer explode works its array out once; an inner one has filters of it too.
        df = df.select("uri", F.explode_outer(let(F.col("terms"), build)).alias("x")).where(F.col("x").isNotNull())
        return df.select("uri", F.col("x.first").cast("long").alias("first"), F.col("x.end").cast("long").alias("span_end"))

    return run


_POS = f"WITH {_DOCS}, p AS (SELECT uri, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM d)"
_add("span_term", _spans(lambda t: spans.term(t, "thing")), f"{_POS} SELECT uri, pos AS first, pos + 1 AS span_end FROM p WHERE term = 'thing'")
_add("span_first", _spans(lambda t: spans.first(spans.term(t, "thing"), 50)), f"{_POS} SELECT uri, pos AS first, pos + 1 AS span_end FROM p WHERE term = 'thing' AND pos + 1 <= 50")
_add("span_or", _spans(lambda t: spans.either(spans.term(t, "thing"), spans.term(t, "nicht"))), f"{_POS} SELECT uri, pos AS first, pos + 1 AS span_end FROM p WHERE term IN ('thing', 'nicht')")
_NEAR = "SELECT DISTINCT a.uri, a.pos AS first, b.pos + 1 AS span_end FROM p a JOIN p b ON a.uri = b.uri AND b.pos > a.pos AND b.pos - a.pos - 1 <= 10 WHERE {0}"
_add("span_near", _spans(lambda t: spans.near(spans.term(t, "thing"), spans.term(t, "attion"), 10)), f"{_POS} " + _NEAR.format("a.term = 'thing' AND b.term = 'attion'"))
_add(
    "span_near_unordered",
    _spans(lambda t: spans.near(spans.term(t, "thing"), spans.term(t, "attion"), 10, ordered=False)),
    f"{_POS} " + _NEAR.format("(a.term = 'thing' AND b.term = 'attion') OR (a.term = 'attion' AND b.term = 'thing')"),
)
_add(
    "span_not",
    _spans(lambda t: spans.without(spans.near(spans.term(t, "and"), spans.term(t, "the"), 3), spans.term(t, "attion"))),
    f"{_POS}, n AS ("
    + _NEAR.format("a.term = 'and' AND b.term = 'the'").replace("<= 10", "<= 3")
    + ") SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.uri = n.uri AND p.term = 'attion' AND p.pos < n.span_end AND p.pos + 1 > n.first)",
)

# --- properties, addresses and dates --------------------------------------------------------------------------------

_ORDERS = "o AS (SELECT 'order:' || o_orderkey AS uri, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS ts FROM orders)"


def _orders(query: Query | Part) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = tables.orders(spark, sf_dir).withColumns({"terms": F.array().cast("array<string>"), "property_terms": F.array().cast("array<string>")})
        return Matcher(SIMPLE).search(docs, query).select("uri")

    return run


def _order_uris(where: str) -> str:
    return f"WITH {_ORDERS} SELECT uri FROM o WHERE {where}"


_add("prop_keyword", _find(Property("k", "dc:language", "FR")), _uris("lower(lang) = 'fr'"))
_add("prop_keyword_unsearched", _find(Property("k", "fixme:filesize", "631")), _uris("n_chars = 631"))
_add("prop_all_keyword", _find(Property("k", "_all", "de")), _uris("lower(lang) = 'de' OR lower(source) = 'de'"))
_add("prop_text", _orders(Property("t", "order:priority", "not specified")), _order_uris("priority = '4-NOT SPECIFIED'"))
_add("prop_not", _orders(Query([Property("k", "order:status", "f"), Property("t", "order:priority", "low", logic=PROHIBITED)])), _order_uris("status = 'F' AND priority <> '5-LOW'"))
_add("mapped_key", _typed("language:es"), _uris("lower(lang) = 'es'"))
_add("mapped_key_source", _typed("source:src3 -language:en"), _uris("lower(source) = 'src3' AND lower(lang) <> 'en'"))
_add("mapped_key_or", _typed("language:es OR language:fr thing"), _uris(f"lower(lang) IN ('es', 'fr') AND {_t('thing')}"))
_add("raw_key", _typed("keyword:dc:source=src5"), _uris("lower(source) = 'src5'"))
_add("uri_query", _find(Uri("doc:17")), _uris("uri = 'doc:17'"))
_add("date_range", _typed("date:20240105-20240107 thing"), _uris(f"ts >= '2024-01-05' AND ts < '2024-01-08' AND {_t('thing')}"))
_add("date_month", _typed("date:202402"), _uris("ts >= '2024-02-01' AND ts < '2024-03-01'"))
_add("date_open_ended", _typed("date:20240120-"), _uris("ts >= '2024-01-20'"))
_add("prohibited_date", _typed("thing -date:-20240110"), _uris(f"{_t('thing')} AND NOT (ts < '2024-01-11')"))
_add("date_range_property", _orders(DateRange(human._day("1997")[0], human._day("199706")[1], "order:date")), _order_uris("ts >= '1997-01-01' AND ts < '1997-07-01'"))
_add("date_range_all", _orders(DateRange(human._day("199912")[0], None, "_all")), _order_uris("ts >= '1999-12-01'"))
_add("only_prohibited_empty", _typed("-thing"), _uris("false"))
_add("domain_filter", lambda s, d: Matcher(SIMPLE).search(tables.parts(s, d).unionByName(tables.orders(s, d)).withColumn("domain", F.when(F.col("hit_type") == "Part", 1).otherwise(8)).withColumns({"terms": F.array().cast("array<string>"), "property_terms": F.array().cast("array<string>")}), Query([MatchAll()])).select("uri"), "SELECT 'part:' || p_partkey AS uri FROM part")

# --- counts, scores and orders ---------------------------------------------------------------------------------------


def _hits(spark: SparkSession, sf_dir: str, text: str = "thing OR nicht") -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir)
    return Matcher(SIMPLE).search(docs, human.parse(text)), docs


_HIT = f"({_t('thing')} OR {_t('nicht')})"


def _score_words(*ws: str) -> str:
    return " + ".join(f"sqrt(len(list_filter(terms, lambda t: t = '{w}'))) * (ln(n.n_docs / (n.df_{k} + 1)) + 1)" for k, w in enumerate(ws))


def _stats(*ws: str) -> str:
    return "n AS (SELECT count(*) AS n_docs, " + ", ".join(f"count(*) FILTER (list_contains(terms, '{w}')) AS df_{k}" for k, w in enumerate(ws)) + " FROM d)"


_add("count_match", lambda s, d: _hits(s, d)[0].agg(F.count(F.lit(1)).alias("n")), f"WITH {_DOCS} SELECT count(*) AS n FROM d WHERE {_HIT}")
_add("count_per_source", lambda s, d: _hits(s, d)[0].groupBy("source").agg(F.count(F.lit(1)).alias("n")), f"WITH {_DOCS} SELECT source, count(*) AS n FROM d WHERE {_HIT} GROUP BY source")
_add("topk_recent", lambda s, d: rank.recent(_hits(s, d)[0], 100).select("uri", scalar.date_string(F.col("ts")).alias("stamp")), f"WITH {_DOCS} SELECT uri, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM d WHERE {_HIT} ORDER BY ts DESC, uri LIMIT 100")
_add(
    "topk_per_source",
    lambda s, d: rank.recent_per_source(_hits(s, d)[0], 3).select("source", "uri"),
    f"WITH {_DOCS} SELECT source, uri FROM d WHERE {_HIT} QUALIFY row_number() OVER (PARTITION BY source ORDER BY ts DESC, uri) <= 3",
)
_add(
    "score_tfidf",
    lambda s, d: rank.scored(*_hits(s, d), ["thing", "nicht"]).select("uri", F.round("score", 6).alias("score")),
    f"WITH {_DOCS}, {_stats('thing', 'nicht')} SELECT uri, round({_score_words('thing', 'nicht')}, 6) AS score FROM d, n WHERE {_HIT}",
)
_add(
    "score_repeated_term",
    lambda s, d: rank.scored(*_hits(s, d), ["thing", "thing"]).select("uri", F.round("score", 6).alias("score")),
    f"WITH {_DOCS}, {_stats('thing')} SELECT uri, round(2 * ({_score_words('thing')}), 6) AS score FROM d, n WHERE {_HIT}",
)
_add(
    "score_classic",
    lambda s, d: rank.classic(*_hits(s, d), ["thing", "nicht"]).select("uri", F.round("score", 6).alias("score")),
    f"""WITH {_DOCS}, {_stats("thing", "nicht")}, w AS (SELECT ln(n_docs / (df_0 + 1)) + 1 AS w0, ln(n_docs / (df_1 + 1)) + 1 AS w1 FROM n),
f AS (SELECT uri, len(list_filter(terms, lambda t: t = 'thing')) AS f0, len(list_filter(terms, lambda t: t = 'nicht')) AS f1, len(terms) AS size FROM d WHERE {_HIT})
SELECT uri, round((sqrt(f0) * w0 * w0 + sqrt(f1) * w1 * w1) * (((f0 > 0)::INT + (f1 > 0)::INT) / 2) / sqrt(w0 * w0 + w1 * w1) / sqrt(greatest(size, 1)), 6) AS score FROM f, w""",
)
_add(
    "dismax",
    lambda s, d: _hits(s, d)[0].select("uri", F.round(rank.best_of([F.sqrt(rank.frequency(F.col("terms"), w)) for w in ("thing", "nicht")], 0.1), 6).alias("score")),
    f"""WITH {_DOCS}, f AS (SELECT uri, sqrt(len(list_filter(terms, lambda t: t = 'thing'))) AS a, sqrt(len(list_filter(terms, lambda t: t = 'nicht'))) AS b FROM d WHERE {_HIT})
SELECT uri, round(greatest(a, b) + (a + b - greatest(a, b)) * 0.1, 6) AS score FROM f""",
)
_add("constant_score_range", lambda s, d: Matcher(SIMPLE).search(_docs(s, d), TermRange("thinb", "thind")).select("uri", F.lit(1.0).alias("score")), f"WITH {_DOCS} SELECT uri, 1.0::DOUBLE AS score FROM d WHERE " + _any("t >= 'thinb' AND t <= 'thind'"))
_add(
    "sort_relevance",
    lambda s, d: rank.numbered(rank.scored(*_hits(s, d), ["thing", "nicht"]).select("uri", "ts", F.round("score", 6).alias("score")), *rank.order_of("relevance")).select("uri", "score", "place"),
    f"WITH {_DOCS}, {_stats('thing', 'nicht')}, r AS (SELECT uri, ts, round({_score_words('thing', 'nicht')}, 6) AS score FROM d, n WHERE {_HIT}) SELECT uri, score, row_number() OVER (ORDER BY score DESC, ts DESC, uri) - 1 AS place FROM r",
)
_add(
    "sort_name",
    lambda s, d: rank.numbered(tables.read(s, d, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("uri"), F.col("p_name").alias("name"), F.lit(None).cast("timestamp").alias("ts")), *rank.order_of("name")).select("uri", "name", "place"),
    "SELECT 'part:' || p_partkey AS uri, p_name AS name, row_number() OVER (ORDER BY lower(p_name), 'part:' || p_partkey) - 1 AS place FROM part",
)
_add(
    "dedup_union",
    lambda s, d: rank.unique(_hits(s, d, "thing")[0].select("uri", F.lit(0).alias("backend"), F.lit("first").alias("found_by")).unionByName(_hits(s, d, "attion")[0].select("uri", F.lit(1).alias("backend"), F.lit("second").alias("found_by"))), "backend").select("uri", "found_by"),
    f"WITH {_DOCS} SELECT uri, CASE WHEN {_t('thing')} THEN 'first' ELSE 'second' END AS found_by FROM d WHERE {_t('thing')} OR {_t('attion')}",
)
_add(
    "term_frequencies",
    lambda s, d: rank.term_frequencies(_docs(s, d)).select("term", "df", "cf"),
    f"WITH {_DOCS} SELECT term, count(DISTINCT uri) AS df, count(*) AS cf FROM (SELECT uri, unnest(terms) AS term FROM d) GROUP BY term",
)
_add(
    "term_vector",
    lambda s, d: rank.term_vector(_docs(s, d)).select("uri", "term", "tf", F.col("first_pos").cast("long").alias("first_pos"), F.col("last_pos").cast("long").alias("last_pos")),
    f"{_POS} SELECT uri, term, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM p GROUP BY uri, term",
)
_add(
    "field_list",
    lambda s, d: tables.documents(s, d).unionByName(tables.orders(s, d)).unionByName(tables.parts(s, d)).select(F.explode("properties").alias("p")).select(F.concat(F.lit("prop:"), "p.type", F.lit(":"), "p.key").alias("field")).distinct(),
    "SELECT unnest(['prop:k:dc:language', 'prop:k:dc:source', 'prop:k:fixme:filesize', 'prop:k:order:status', 'prop:t:order:priority', 'prop:k:order:customer', 'prop:d:order:date', 'prop:t:dc:title', 'prop:k:part:brand', 'prop:k:part:type', 'prop:k:part:size']) AS field",
)
_add(
    "index_info",
    lambda s, d: tables.documents(s, d).select("hit_type").unionByName(tables.conversations(s, d).select("hit_type")).unionByName(tables.parts(s, d).select("hit_type")).groupBy("hit_type").agg(F.count(F.lit(1)).alias("n")),
    "SELECT 'File' AS hit_type, count(*) AS n FROM documents UNION ALL SELECT 'IMLog', count(*) FROM conversations UNION ALL SELECT 'Part', count(*) FROM part",
)
_add(
    "timeline_bucket",
    lambda s, d: tables.read(s, d, "events").select(rank.timeline(F.col("ts"), F.lit("2024-01-31 12:00:00").cast("timestamp")).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")),
    """SELECT CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 7 THEN 'this week' WHEN days < 14 THEN 'last week' WHEN days < 31 THEN 'this month' ELSE 'this year' END AS bucket, count(*) AS n
FROM (SELECT date_diff('day', ts, TIMESTAMP '2024-01-31 12:00:00') AS days FROM events) GROUP BY 1""",
)
_add("half_life", lambda s, d: tables.read(s, d, "events").select("event_id", F.round(scalar.half_life(F.datediff(F.lit("2024-02-01").cast("date"), "ts")), 6).alias("weight")), "SELECT event_id, round(pow(0.5, date_diff('day', ts::DATE, DATE '2024-02-01') / 182.0), 6) AS weight FROM events")

# --- the stored index -------------------------------------------------------------------------------------------------


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.build(tables.documents(spark, sf_dir).unionByName(tables.parts(spark, sf_dir)), SIMPLE)


_add("postings_phrase", lambda s, d: postings.with_phrase(_postings(s, d), ["and", "attion"]), _uris(_p("and", "attion")))
_add(
    "postings_boolean",
    lambda s, d: postings.with_all([postings.with_term(_postings(s, d), w) for w in ("thing", "thble")], [postings.with_term(_postings(s, d), "attion")]),
    _uris("list_contains(terms, 'thing') AND list_contains(terms, 'thble') AND NOT list_contains(terms, 'attion')"),
)
_add("postings_property", lambda s, d: postings.with_term(_postings(s, d), "widget", "prop:t:dc:title"), r"SELECT 'part:' || p_partkey AS uri FROM part WHERE list_contains(regexp_extract_all(lower(p_name), '\p{L}+'), 'widget')")
_add(
    "set_operations",
    lambda s, d: (lambda a, b: a.union(b).distinct().join(a.intersect(b), "uri", "left_anti"))(postings.with_term(_postings(s, d), "thing"), postings.with_term(_postings(s, d), "attion")),
    _uris("list_contains(terms, 'thing') <> list_contains(terms, 'attion')"),
)

# --- analysis and scalar functions --------------------------------------------------------------------------------------


def _analysis(analyzer: analysis.Analyzer) -> Run:
    return lambda s, d: tables.documents(s, d).select("uri", F.explode_outer(analyzer.column(F.col("text"))).alias("term")).where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _analysis_sql(terms: str) -> str:
    return f"SELECT term, count(*) AS n FROM (SELECT unnest({terms}) AS term FROM documents) GROUP BY term"


_add("analyzer_whitespace", _analysis(analysis.WHITESPACE), _analysis_sql(r"regexp_extract_all(coalesce(text, ''), '\S+')"))
_add("analyzer_letter", _analysis(analysis.LETTER), _analysis_sql(r"regexp_extract_all(coalesce(text, ''), '\p{L}+')"))
_add("analyzer_simple", _analysis(SIMPLE), _analysis_sql(r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"))
_add("analyzer_stop", _analysis(STOP), _analysis_sql(rf"list_filter(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+'), lambda t: t NOT IN ({', '.join(repr(w) for w in analysis.STOP_WORDS)}))"))
_add("analyzer_standard", _analysis(analysis.STANDARD_ANALYZER))
_add("stem_english", lambda s, d: analysis.stemmed_vocabulary(tables.documents(s, d).where(F.exists("properties", lambda p: (p["key"] == "dc:language") & (p["value"] == "en"))).select(F.explode(SIMPLE.column(F.col("text"))).alias("term")), "term"))

_PART = "part"
_SCALARS: dict[str, tuple[str, Callable, str]] = {
    "file_length_string": ("documents", lambda: (F.col("doc_id"), scalar.file_length(F.col("n_chars"))), "SELECT doc_id AS id, CASE WHEN n_chars < 0 THEN '*BadLength*' WHEN n_chars = 1 THEN '1 byte' WHEN n_chars < 1024 THEN n_chars || ' bytes' WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars / 1024.0, 1)) ELSE printf('%.1f MB', round(n_chars / 1048576.0, 1)) END AS value FROM documents"),
    "strip_tags": ("pages", lambda: (F.col("page_id"), F.md5(scalar.strip_tags(F.col("html")))), "SELECT page_id AS id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS value FROM pages"),
    "decode_entities": ("pages", lambda: (F.col("page_id"), F.md5(scalar.decode_entities(F.col("html")))), "SELECT page_id AS id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '&nbsp;', ' '), '&apos;', '''')) AS value FROM pages"),
    "escape_html": ("documents", lambda: (F.col("doc_id"), F.md5(scalar.escape_html(F.col("text")))), "SELECT doc_id AS id, md5(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(13), '&#13;'), chr(10), '&#10;')) AS value FROM documents"),
    "sanitize_email": ("supplier", lambda: (F.col("s_suppkey"), scalar.sanitize_email(F.concat("s_name", F.lit("_X@mail-1.Example.com")))), "SELECT s_suppkey AS id, regexp_replace(translate(lower(s_name || '_X@mail-1.Example.com'), '@.-_+', '     '), ' (com|net|org|edu|gov|mil)$', '') AS value FROM supplier"),
    "count_words": ("documents", lambda: (F.col("doc_id"), scalar.count_words(F.col("text")).cast("string")), r"SELECT doc_id AS id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))::VARCHAR AS value FROM documents"),
    "glob_match": ("part", lambda: (F.col("p_partkey"), scalar.glob_match("*ed wi*", F.col("p_name")).cast("string")), "SELECT p_partkey AS id, regexp_full_match(p_name, '.*ed wi.*')::VARCHAR AS value FROM part"),
    "date_strings": ("events", lambda: (F.col("event_id"), F.concat_ws("|", scalar.date_string(F.col("ts")), scalar.year_month(F.col("ts")), scalar.day(F.col("ts")))), "SELECT event_id AS id, concat_ws('|', strftime(ts, '%Y%m%d%H%M%S'), strftime(ts, '%Y%m'), strftime(ts, '%d')) AS value FROM events"),
    "duration_string": ("orders", lambda: (F.col("o_orderkey"), scalar.duration(F.col("o_orderkey") * 997)), "SELECT o_orderkey AS id, CASE WHEN o_orderkey = 0 THEN '0s' ELSE concat(CASE WHEN x // 86400 > 0 THEN x // 86400 || 'd' ELSE '' END, CASE WHEN x // 3600 % 24 > 0 THEN x // 3600 % 24 || 'h' ELSE '' END, CASE WHEN x // 60 % 60 > 0 THEN x // 60 % 60 || 'm' ELSE '' END, CASE WHEN x % 60 > 0 THEN x % 60 || 's' ELSE '' END) END AS value FROM (SELECT o_orderkey, o_orderkey * 997 AS x FROM orders)"),
    "fold_accents": ("documents", lambda: (F.col("doc_id"), F.md5(scalar.fold_accents(F.col("text")))), "SELECT doc_id AS id, md5(replace(replace(replace(replace(replace(replace(replace(translate(text, 'ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝàáâãäåçèéêëìíîïðñòóôõöøùúûüýÿ', 'AAAAAACEEEEIIIIDNOOOOOOUUUUYaaaaaaceeeeiiiidnoooooouuuuyy'), 'Æ', 'AE'), 'Œ', 'OE'), 'Þ', 'TH'), 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), 'þ', 'th')) AS value FROM documents"),
    "levenshtein_similarity": ("part", lambda: (F.col("p_partkey"), F.round(scalar.levenshtein_similarity(F.col("p_name"), "red widget"), 6).cast("string")), "SELECT p_partkey AS id, round(1 - levenshtein(p_name, 'red widget') / least(length(p_name), 10), 6)::VARCHAR AS value FROM part"),
    "fuzzy_divide": ("customer", lambda: (F.col("c_custkey"), scalar.fuzzy_divide(F.concat("c_name", F.lit("someFileName2Go.txt")))), "SELECT c_custkey AS id, replace(c_name, '#', ' ') || ' some File Name 2 Go txt' AS value FROM customer"),
    "split_quoted": ("part", lambda: (F.col("p_partkey"), F.concat_ws("|", scalar.split_quoted(F.concat("p_type", F.lit(' "'), "p_name", F.lit('" end'))))), "SELECT p_partkey AS id, concat_ws('|', p_type, p_name, 'end') AS value FROM part"),
}


def _scalar(table: str, columns: Callable) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key, value = columns()
        return tables.read(spark, sf_dir, table).select(key.alias("id"), value.alias("value"))

    return run


for _name, (_table, _columns, _sql) in _SCALARS.items():
    _add(_name, _scalar(_table, _columns), _sql)

# --- pages ----------------------------------------------------------------------------------------------------------------

_ENTITIES = "replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '&nbsp;', ' '), '&apos;', '''')"
_add("html_title", lambda s, d: tables.read(s, d, "pages").select("page_id", html.title(F.col("html")).alias("title")), "SELECT page_id, " + _ENTITIES.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + " AS title FROM pages")
_add("html_links", lambda s, d: tables.read(s, d, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("link")), """SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS link FROM pages""")
_add("html_recorded_links", lambda s, d: tables.read(s, d, "pages").select("page_id", F.explode(html.recorded_links(F.col("html"))).alias("link")), """SELECT DISTINCT page_id, link FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS link FROM pages) WHERE regexp_matches(link, '^(http|mailto|ftp):')""")
_add(
    "html_text",
    lambda s, d: html.extract(tables.read(s, d, "pages")).select("page_id", "text"),
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '"""
    + html.BREAKS
    + r"""', ' ', 'g'), '<[^>]*>', '', 'g') AS h FROM a) SELECT page_id, trim(regexp_replace("""
    + _ENTITIES.format("h")
    + r""", '\s+', ' ', 'g')) AS text FROM b""",
)

# --- children, metadata and changes -------------------------------------------------------------------------------------------

_add(
    "child_parent_props",
    lambda s, d: changes.child_properties(
        tables.conversations(s, d), tables.conversations(s, d).where(F.col("uri").endswith("#0")).select(F.col("parent_uri").alias("uri"), F.lit("dc:title").alias("key"), F.col("text").alias("value"))
    ),
    "SELECT 'im:' || c.conv_id || '#' || c.turn AS uri, 'parent:dc:title' AS key, p.text AS value FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = 0",
)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutable properties of documents from outside."""
    df = tables.read(spark, sf_dir, "labels").select(F.concat(F.lit("doc:"), "doc_id").alias("uri"), F.explode(F.create_map(F.lit("fixme:quality"), "quality", F.lit("fixme:toxic"), "toxic")).alias("key", "value"))
    return df.select("uri", "key", F.col("value").cast("string").alias("value"), (F.col("key") == "fixme:toxic").alias("persistent"))


_LABELS = "m AS (SELECT 'doc:' || doc_id AS uri, unnest(['fixme:quality', 'fixme:toxic']) AS key, unnest([quality, toxic])::VARCHAR AS value, unnest([false, true]) AS persistent FROM labels)"
_add(
    "secondary_merge",
    lambda s, d: tables.documents(s, d).select("uri", F.col("source")).join(_labels(s, d).where(F.col("key") == "fixme:toxic").select("uri", F.col("value").alias("toxic")), "uri", "left").select("uri", "source", "toxic"),
    "SELECT 'doc:' || d.doc_id AS uri, d.source, l.toxic::VARCHAR AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)
_add(
    "property_change",
    lambda s, d: changes.changed(_labels(s, d), _labels(s, d).where((F.col("key") == "fixme:quality")).select("uri", "key", F.when(F.col("value") == "0", F.lit("")).otherwise(F.lit("good")).alias("value"))).select("uri", "key", "value"),
    f"WITH {_LABELS} SELECT uri, key, CASE WHEN key = 'fixme:quality' THEN 'good' ELSE value END AS value FROM m WHERE NOT (key = 'fixme:quality' AND value = '0')",
)
_add(
    "persistent_carry",
    lambda s, d: changes.carried(_labels(s, d), tables.documents(s, d).where(F.col("source") == "src0").select("uri", F.lit("note").alias("key"), F.lit("new").alias("value"), F.lit(False).alias("persistent"))).select("uri", "key", "value"),
    f"WITH {_LABELS}, a AS (SELECT 'doc:' || doc_id AS uri FROM documents WHERE source = 'src0') SELECT uri, key, value FROM m WHERE uri NOT IN (SELECT uri FROM a) OR persistent UNION ALL SELECT uri, 'note', 'new' FROM a",
)
_add(
    "remove_with_children",
    lambda s, d: changes.removed(tables.conversations(s, d).select("uri", "parent_uri"), tables.conversations(s, d).where(F.col("text").contains("thing")).select(F.col("parent_uri").alias("uri")).distinct()),
    "SELECT 'im:' || conv_id || '#' || turn AS uri, 'im:' || conv_id AS parent_uri FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE contains(text, 'thing'))",
)
_add(
    "coalesce_requests",
    lambda s, d: changes.coalesced(
        tables.read(s, d, "events").select(
            F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "click", "add").otherwise("property").alias("op"),
            F.concat(F.lit("user:"), "user_id").alias("uri"),
            F.lit(None).cast("string").alias("parent_uri"),
            F.array(F.struct(F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"))).alias("properties"),
        )
    ).select("uri", "op", F.transform("properties", lambda p: p["key"]).cast("string").alias("keys")),
    """WITH e AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'remove' WHEN 'click' THEN 'add' ELSE 'property' END AS op, 'user:' || user_id AS uri, event_type AS key FROM events),
l AS (SELECT uri, max(seq) AS seq, arg_max(op, seq) AS op FROM e WHERE op <> 'property' GROUP BY uri),
k AS (SELECT e.uri, list_sort(list(DISTINCT e.key)) AS keys FROM e LEFT JOIN l ON e.uri = l.uri WHERE e.op = 'property' AND (l.uri IS NULL OR (e.seq > l.seq AND l.op <> 'remove')) GROUP BY e.uri)
SELECT coalesce(l.uri, k.uri) AS uri, coalesce(l.op, 'property') AS op, '[' || array_to_string(coalesce(k.keys, []), ', ') || ']' AS keys FROM l FULL JOIN k ON l.uri = k.uri""",
)
_add(
    "log_sessions",
    lambda s, d: changes.sessions(tables.read(s, d, "events").select("event_type", "ts", F.col("event_id").alias("line")), "event_type").groupBy("group").agg(F.count_distinct("session").alias("n_sessions")),
    """WITH RECURSIVE a AS (SELECT event_type AS g, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
r(g, k, ts, begun, n, s) AS (SELECT g, k, ts, date_trunc('hour', ts), 1, 1 FROM a WHERE k = 1
UNION ALL SELECT g, k, ts, CASE WHEN cut THEN ts ELSE begun END, CASE WHEN cut THEN 1 ELSE n + 1 END, s + cut::INT
FROM (SELECT a.g, a.k, a.ts, r.begun, r.n, r.s, a.ts::DATE <> r.ts::DATE OR (r.n > 50 AND a.ts - r.begun > INTERVAL 360 MINUTE) AS cut FROM r JOIN a ON a.g = r.g AND a.k = r.k + 1))
SELECT g AS group, max(s)::BIGINT AS n_sessions FROM r GROUP BY g""".replace("g AS group", 'g AS "group"'),
)


def _live_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, query = _docs(spark, sf_dir), human.parse("thing")
    results = Matcher(SIMPLE).search(docs.where(F.col("ts") < "2024-01-15"), query).select("uri")
    batch = docs.where(F.col("ts") >= "2024-01-10")
    return live.deltas(results, batch, lambda b: Matcher(SIMPLE).search(b, query)).select("op", "uri")


_add("live_delta", _live_delta, f"WITH {_DOCS} SELECT '-' AS op, uri FROM d WHERE {_t('thing')} AND ts >= '2024-01-10' AND ts < '2024-01-15' UNION ALL SELECT '+', uri FROM d WHERE {_t('thing')} AND ts >= '2024-01-10'")

# --- triples ---------------------------------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, regions and suppliers as triples."""
    n, r, u = (tables.read(spark, sf_dir, t) for t in ("nation", "region", "supplier"))

    def of(df: DataFrame, s: str, key: str, p: str, o) -> DataFrame:
        return df.select(F.concat(F.lit(s), key).alias("s"), F.lit(p).alias("p"), (o if not isinstance(o, str) else F.col(o)).cast("string").alias("o"))

    return (
        of(n, "nation:", "n_nationkey", "name", "n_name")
        .union(of(n, "nation:", "n_nationkey", "in_region", F.concat(F.lit("region:"), "n_regionkey")))
        .union(of(r, "region:", "r_regionkey", "name", "r_name"))
        .union(of(u, "supplier:", "s_suppkey", "in_nation", F.concat(F.lit("nation:"), "s_nationkey")))
        .union(of(u, "supplier:", "s_suppkey", "balance", "s_acctbal"))
    )


_GRAPH = """g AS (SELECT 'nation:' || n_nationkey AS s, 'name' AS p, n_name AS o FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'in_region', 'region:' || n_regionkey FROM nation
UNION ALL SELECT 'region:' || r_regionkey, 'name', r_name FROM region UNION ALL SELECT 'supplier:' || s_suppkey, 'in_nation', 'nation:' || s_nationkey FROM supplier UNION ALL SELECT 'supplier:' || s_suppkey, 'balance', s_acctbal::VARCHAR FROM supplier)"""
for _case in range(8):
    _bound = {k: v for bit, (k, v) in enumerate({"s": "nation:3", "p": "in_region", "o": "region:3"}.items()) if _case >> bit & 1}
    _where = " AND ".join(f"{k} = '{v}'" for k, v in _bound.items()) or "true"
    _add("rdf_select_" + ("".join(_bound) or "all"), lambda s, d, b=_bound: triples.select(_graph(s, d), **b), f"WITH {_GRAPH} SELECT s, p, o FROM g WHERE {_where}")
_add(
    "rdf_bgp",
    lambda s, d: triples.match(_graph(s, d), [("?supplier", "in_nation", "?nation"), ("?nation", "in_region", "?region"), ("?region", "name", "?name")], ["supplier", "name"]),
    "SELECT 'supplier:' || s_suppkey AS supplier, r_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
_add(
    "rdf_literal_filter",
    lambda s, d: triples.match(_graph(s, d), [("?supplier", "balance", "?balance"), ("?supplier", "in_nation", "?nation")], ["supplier", "nation"], [triples.literal_filter("balance", "gt", 5000.0)]),
    "SELECT 'supplier:' || s_suppkey AS supplier, 'nation:' || s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000",
)
_add("rdf_subtract", lambda s, d: triples.subtract(_graph(s, d), triples.select(_graph(s, d), p="in_nation")), f"WITH {_GRAPH} SELECT s, p, o FROM g WHERE p <> 'in_nation'")
_add("rdf_documents", lambda s, d: triples.select(triples.of_documents(tables.documents(s, d)), p="prop:k:dc:language", o="de"), "SELECT 'doc:' || doc_id AS s, 'prop:k:dc:language' AS p, lang AS o FROM documents WHERE lang = 'de'")


def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in a chain of tens over the nations' numbers, and suppliers as instances."""
    n, u = tables.read(spark, sf_dir, "nation"), tables.read(spark, sf_dir, "supplier")
    up = n.where("n_nationkey > 0").select(F.concat(F.lit("class:"), "n_nationkey").alias("s"), F.lit(triples.SUBCLASS).alias("p"), F.concat(F.lit("class:"), F.floor(F.col("n_nationkey") / 2)).alias("o"))
    return up.union(u.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("s"), F.lit(triples.RDF_TYPE).alias("p"), F.concat(F.lit("class:"), "s_nationkey").alias("o")))


_add("rdfs_closure", lambda s, d: triples.instances(_hierarchy(s, d), "class:2"), "WITH RECURSIVE c(k) AS (SELECT 2 UNION SELECT n_nationkey FROM nation JOIN c ON n_nationkey > 0 AND n_nationkey // 2 = c.k) SELECT 'supplier:' || s_suppkey AS s FROM supplier WHERE s_nationkey IN (SELECT k FROM c)")
_add(
    "rule_fixpoint",
    lambda s, d: triples.fixpoint(_graph(s, d).where(F.col("p").isin("in_nation", "in_region")), [([("?a", "in_nation", "?b")], ("?a", "within", "?b")), ([("?a", "in_region", "?b")], ("?a", "within", "?b")), ([("?a", "within", "?b"), ("?b", "within", "?c")], ("?a", "within", "?c"))]).where(F.col("p") == "within"),
    "SELECT 'supplier:' || s_suppkey AS s, 'within' AS p, 'nation:' || s_nationkey AS o FROM supplier UNION ALL SELECT 'nation:' || n_nationkey, 'within', 'region:' || n_regionkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'within', 'region:' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)

# --- snippets -----------------------------------------------------------------------------------------------------------------------

_add("snippet", lambda s, d: _hits(s, d, "thing")[0].select("uri", snippets.snippets(F.col("text"), ["thing"]).cast("string").alias("snippet")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest hits of a typed query with their scores."""
    hits, docs = _hits(spark, sf_dir, "thing -attion")
    return rank.recent(rank.scored(hits, docs, ["thing"]), 100).select("uri", "source", scalar.date_string(F.col("ts")).alias("stamp"), F.round("score", 6).alias("score"))


_add("search", flagship, f"WITH {_DOCS}, {_stats('thing')} SELECT uri, source, strftime(ts, '%Y%m%d%H%M%S') AS stamp, round({_score_words('thing')}, 6) AS score FROM d, n WHERE {_t('thing')} AND NOT {_t('attion')} ORDER BY ts DESC, uri LIMIT 100")

from siftwell import catalog_more  # noqa: E402, F401  (adds its queries)
