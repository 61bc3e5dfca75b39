"""More registered queries: searches through the stored index, relations, scalar functions, changes and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.catalog import _DOCS, _GRAPH, _HIT, _POS, _add, _docs, _find, _graph, _hierarchy, _hits, _labels, _stats, _t, _uris, ORACLE_SQL
from siftwell.functions import analysis, relations, scalar
from siftwell.functions.analysis import SIMPLE
from siftwell.functions.arrays import let
from siftwell.functions.stemming import STEMMERS
from siftwell.operators import changes, match, rank, spans, triples
from siftwell.operators.index import TEXT, Index
from siftwell.plans import boolean, human
from siftwell.plans.parts import Fuzzy, MatchAll, MultiPhrase, Or, Part, Prefix, Property, Query, Text, TermRange, Uri, Wildcard
from siftwell.sources import html, registry, tables
from siftwell.storage import shared_dir

# --- searches through the stored index -----------------------------------------------------------------------------------

_built: dict[tuple[str, str], Index] = {}


def _index(spark: SparkSession, sf_dir: str) -> Index:
    """An index of all documents and parts, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built:
        folder = f"{shared_dir(spark)}/siftwell-{key[0]}/index-{abs(hash(sf_dir))}"
        _built[key] = Index(spark, folder, SIMPLE, most=None)
        _built[key].add(tables.documents(spark, sf_dir).unionByName(tables.parts(spark, sf_dir)), 16)
    return _built[key]


#: The searches that are also run through the index, as they are registered.
_SEARCHES: dict[str, Query | Part] = {
    "text_term": human.parse("thing"), "text_and": human.parse("thing attion"), "text_not": human.parse("thing -attion"), "text_or": human.parse("thing OR nicht OR ersch"), "text_or_and": human.parse("ering OR oning thble"),
    "text_phrase": human.parse('"to thanedble the"'), "text_phrase_not": human.parse('thble -"and attion"'), "text_keyword_value": human.parse("SRC7"), "text_only_body": Text("de", properties=False), "text_only_properties": Text("de", full_text=False),
    "wildcard_star": human.parse("thanea*ion"), "wildcard_question": Wildcard("th?ng"), "prefix_query": Prefix("thinti"), "range_query": TermRange("thinb", "thind"), "range_exclusive": boolean.parse("{nicht TO nicko}"), "fuzzy_query": Fuzzy("thinking", 0.7),
    "min_should_match": Or([Text("thing"), Text("attion"), Text("ering"), Text("oning")], least=3), "boolean_nested": boolean.parse("(thing OR nicht) AND NOT (attion AND thble)"), "boolean_default_and": boolean.parse("thing attion !oning", default_and=True),
    "sloppy_phrase": boolean.parse('"thing attion"~8'), "prop_keyword": Property("k", "dc:language", "FR"), "prop_keyword_unsearched": Property("k", "fixme:filesize", "631"), "mapped_key": human.parse("language:es"), "mapped_key_or": human.parse("language:es OR language:fr thing"),
    "uri_query": Uri("doc:17"), "date_range": human.parse("date:20240105-20240107 thing"), "prohibited_date": human.parse("thing -date:-20240110"), "only_prohibited_empty": human.parse("-thing"),
}
for _name, _query in _SEARCHES.items():
    _add(f"indexed_{_name}", lambda s, d, q=_query: _index(s, d).search(q), ORACLE_SQL[_name])
_add("indexed_match_all", lambda s, d: _index(s, d).search(MatchAll()), "SELECT 'doc:' || doc_id AS uri FROM documents UNION ALL SELECT 'part:' || p_partkey FROM part")
_add("indexed_prop_text", lambda s, d: _index(s, d).search(Property("t", "dc:title", "red widget")), "SELECT 'part:' || p_partkey AS uri FROM part WHERE contains(p_name, 'red widget')")
_MULTI = MultiPhrase([["and", "the"], ["attion", "thing", "thanedble"]])
_MULTI_SQL = _uris("(len(list_filter(range(1, len(terms) + 1), lambda i: terms[i] IN ('and', 'the') AND terms[i + 1] IN ('attion', 'thing', 'thanedble'))) > 0)")
_add("multi_phrase", _find(_MULTI), _MULTI_SQL)
_add("indexed_multi_phrase", lambda s, d: _index(s, d).search(_MULTI), _MULTI_SQL)
_VOCAB = r"""t AS (SELECT 'doc:' || doc_id AS uri, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS term FROM documents)"""
_add("index_vocabulary", lambda s, d: _index(s, d).vocab().where(F.col("field") == TEXT).select("term", "df", "cf"), f"WITH {_VOCAB} SELECT term, count(DISTINCT uri) AS df, count(*) AS cf FROM t GROUP BY term")
_add(
    "indexed_score",
    lambda s, d: _index(s, d).scored(_index(s, d).search(human.parse("thing OR nicht")), ["thing", "nicht"]).where(F.col("uri").startswith("doc:")).select("uri", F.round("score", 6).alias("score")),
    f"WITH {_DOCS}, n AS (SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM part) AS n_docs, count(*) FILTER (list_contains(terms, 'thing')) AS df_0, count(*) FILTER (list_contains(terms, 'nicht')) AS df_1 FROM d), f AS (SELECT uri, len(list_filter(terms, lambda t: t = 'thing')) AS f0, len(list_filter(terms, lambda t: t = 'nicht')) AS f1 FROM d WHERE {_HIT}) "
    "SELECT uri, round(sqrt(f0) * (ln(n_docs / (df_0 + 1)) + 1) + sqrt(f1) * (ln(n_docs / (df_1 + 1)) + 1), 6) AS score FROM f, n",
)
_add("index_positions", lambda s, d: _index(s, d).positions(["thing", "nicht"]).select("uri", F.col("pos").cast("long").alias("pos")), f"{_POS} SELECT uri, pos FROM p WHERE term IN ('thing', 'nicht')")
_add("index_vectors", lambda s, d: _index(s, d).vectors().where(F.col("uri").startswith("doc:")).select("uri", "term", "tf", F.array_join("positions", ",").alias("positions")), f"{_POS} SELECT uri, term, count(*)::INT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY uri, term")
_add(
    "index_offsets",
    lambda s, d: tables.documents(s, d).select("uri", let(analysis.tokens(F.col("text")), lambda ts: F.struct(F.size(ts).alias("n"), F.size(F.filter(F.zip_with(ts, analysis.at_places(F.col("text"), ts), lambda t, x: F.lower(x) == t["term"]), lambda right: right)).alias("n_right"))).alias("x")).groupBy("uri").agg(F.sum("x.n").alias("n"), F.sum("x.n_right").alias("n_right")).where("n > 0"),
    f"{_POS} SELECT uri, count(*) AS n, count(*) AS n_right FROM p GROUP BY uri",
)
_add("index_first_field", lambda s, d: _index(s, d).first("dc:title"), "SELECT 'part:' || p_partkey AS uri, p_name AS value FROM part")
_add("index_selected_fields", lambda s, d: _index(s, d).documents(["properties"], ["part:brand"]).where(F.col("uri").startswith("part:")).select("uri", F.col("properties")[0]["value"].alias("brand"), F.size("properties").cast("long").alias("n")), "SELECT 'part:' || p_partkey AS uri, p_brand AS brand, 1::BIGINT AS n FROM part")
_add("index_field_sizes", lambda s, d: _index(s, d).sizes().groupBy("key").agg(F.sum("bytes").alias("bytes")).where(F.col("key").isin("dc:title", "dc:source")), "SELECT 'dc:title' AS key, sum(octet_length(encode(p_name)))::BIGINT AS bytes FROM part UNION ALL SELECT 'dc:source', sum(octet_length(encode(source)))::BIGINT FROM documents")
_add(
    "index_zipped",
    lambda s, d: _index(s, d).zipped(_labels(s, d).where(F.col("key") == "fixme:toxic").select("uri", F.col("value").alias("toxic"))).where(F.col("uri").startswith("doc:")).select("uri", "toxic"),
    "SELECT 'doc:' || d.doc_id AS uri, l.toxic::VARCHAR AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)",
)


def _index_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add, delete, update, optimise and sweep a small index of its own; what it has then."""
    parts = tables.parts(spark, sf_dir)
    index = Index(spark, f"{shared_dir(spark)}/siftwell-{spark.sparkContext.applicationId}/life-{abs(hash(sf_dir))}", SIMPLE)
    while index.segments():  # of an earlier call
        index._commit([])
    index.add(parts, 2)
    index.delete(parts.where(F.col("uri").endswith("7")).select("uri"))
    index.update(parts.where(F.col("uri").endswith("5")).withColumn("text", F.lit("updated")), 2)
    index.optimize(2)
    index.sweep()
    return index.documents().select("uri", "text")


_add("index_life", _index_life, "SELECT 'part:' || p_partkey AS uri, CASE WHEN p_partkey % 10 = 5 THEN 'updated' END AS text FROM part WHERE p_partkey % 10 <> 7")

# --- queries and filters ---------------------------------------------------------------------------------------------------


def _parts(query) -> object:
    return lambda s, d: match.Matcher(SIMPLE).search(match.analyzed(tables.parts(s, d), SIMPLE), query).select("uri")


_WORDS = r"regexp_extract_all(lower(p_name), '\p{L}+')"
_add("fielded_range", _parts(boolean.parse_fields("[red TO ring]", ["dc:title"])), f"SELECT 'part:' || p_partkey AS uri FROM part WHERE len(list_filter({_WORDS}, lambda t: t >= 'red' AND t <= 'ring')) > 0")
_add("fielded_fuzzy", _parts(boolean.parse_fields("widgit~0.5", ["dc:title"])), f"SELECT 'part:' || p_partkey AS uri FROM part WHERE len(list_filter({_WORDS}, lambda t: 1 - levenshtein(t, 'widgit') / least(length(t), 6)::DOUBLE > 0.5)) > 0")
_add("fielded_slop", _parts(boolean.parse_fields('"widget red"~2', ["dc:title"])), f"SELECT 'part:' || p_partkey AS uri FROM part WHERE len(list_filter(range(1, len({_WORDS}) + 1), lambda i: {_WORDS}[i] = 'widget' AND len(list_filter(range(1, len({_WORDS}) + 1), lambda j: {_WORDS}[j] = 'red' AND abs(j - 1 - i) <= 2)) > 0)) > 0")
_add("typed_keyword", lambda s, d: _typed_files(s, d, "type:order"), "SELECT 'order:' || o_orderkey AS uri FROM orders")
_add("typed_mime", lambda s, d: _typed_files(s, d, "mimetype:text/x-order filetype:document"), "SELECT 'order:' || o_orderkey AS uri FROM orders")
_add("typed_filename", lambda s, d: _typed_files(s, d, "filename:urgent"), "SELECT 'order:' || o_orderkey AS uri FROM orders WHERE o_orderpriority = '1-URGENT'")
_add("typed_folder", lambda s, d: _typed_files(s, d, "inuri:/orders/F"), "SELECT 'order:' || o_orderkey AS uri FROM orders WHERE o_orderstatus = 'F'")
_add("typed_folder_name", lambda s, d: _typed_files(s, d, "inuri:P"), "SELECT 'order:' || o_orderkey AS uri FROM orders WHERE o_orderstatus = 'P'")
_add("typed_extension", lambda s, d: _typed_files(s, d, "*.ord"), "SELECT 'order:' || o_orderkey AS uri FROM orders")


def _typed_files(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Orders as files of folders by their status."""
    docs = tables.orders(spark, sf_dir)
    status = F.filter("properties", lambda p: p["key"] == "order:status")[0]["value"]
    priority = F.filter("properties", lambda p: p["key"] == "order:priority")[0]["value"]
    own = match.properties(
        match.prop("k", "file:hit_type", F.lit("Order"), searched=False),
        match.prop("k", "file:mime_type", F.lit("text/x-order"), searched=False),
        match.prop("k", "file:type", F.lit("document"), searched=False),
        match.prop("k", "file:extension", F.lit(".ord"), searched=False),
        match.prop("t", "file:name", priority),
        match.prop("k", "file:parent", F.concat(F.lit("/orders/"), status), searched=False),
        match.prop("k", "file:parent_name", status, searched=False),
    )
    found = match.Matcher(SIMPLE)
    return found.search(match.analyzed(docs.withColumn("properties", own), SIMPLE), human.parse(text)).select("uri")


_add(
    "hit_filter",
    lambda s, d: match.filtered(_hits(s, d)[0], match.all_of(match.any_of(F.col("source") == "src1", F.col("source") == "src2"), match.none_of(F.col("text").contains("attion")))).select("uri"),
    _uris(f"{_HIT} AND source IN ('src1', 'src2') AND NOT contains(text, 'attion')"),
)
_add(
    "existing_files",
    lambda s, d: match.existing(_hits(s, d)[0].select("uri"), tables.read(s, d, "labels").select(F.concat(F.lit("doc:"), "doc_id").alias("uri"), F.when(F.col("toxic") == 1, F.concat(F.lit("moved:"), "doc_id")).alias("now_uri"))),
    f"WITH {_DOCS} SELECT CASE WHEN toxic = 1 THEN 'moved:' || doc_id ELSE uri END AS uri FROM d JOIN labels ON uri = 'doc:' || doc_id WHERE {_HIT}",
)
_add("query_hook", _find(boolean.rewritten(boolean.parse("thing OR nicht"), lambda p: Text("attion") if isinstance(p, Text) and p.text == "thing" else None)), _uris(f"{_t('attion')} OR {_t('nicht')}"))
_NEAR3 = f"{_POS} SELECT DISTINCT a.uri, a.pos AS first, c.pos + 1 AS span_end FROM p a JOIN p b ON a.uri = b.uri AND b.pos > a.pos JOIN p c ON b.uri = c.uri AND c.pos > b.pos WHERE a.term = 'the' AND b.term = 'and' AND c.term = 'the' AND (b.pos - a.pos - 1) + (c.pos - b.pos - 1) <= 12"


def _spans3(s: SparkSession, d: str) -> DataFrame:
    df = _docs(s, d)
    found = spans.near_all([spans.term(F.col("terms"), w) for w in ("the", "and", "the")], 12)
    rows = df.select("uri", found.alias("s")).where(F.size("s") > 0).select("uri", F.explode("s").alias("x"))
    return rows.select("uri", F.col("x.first").cast("long").alias("first"), F.col("x.end").cast("long").alias("span_end"))


_add("span_near_three", _spans3, _NEAR3)
_add(
    "span_frequency",
    lambda s, d: _docs(s, d).select("uri", F.round(spans.frequency(spans.near(spans.term(F.col("terms"), "thing"), spans.term(F.col("terms"), "attion"), 10)), 6).alias("freq")).where("freq > 0"),
    f"{_POS}, n AS (SELECT DISTINCT a.uri, a.pos AS first, b.pos + 1 AS span_end FROM p a JOIN p b ON a.uri = b.uri AND b.pos > a.pos AND b.pos - a.pos - 1 <= 10 WHERE a.term = 'thing' AND b.term = 'attion') SELECT uri, round(sum(1.0::DOUBLE / (span_end - first + 1)), 6) AS freq FROM n GROUP BY uri",
)
_TF = "SELECT uri, len(list_filter(terms, lambda t: t = 'thing')) AS f0, len(list_filter(terms, lambda t: t = 'nicht')) AS f1 FROM d"
_add(
    "boosted_coordinated",
    lambda s, d: _hits(s, d)[0].select("uri", F.round(rank.boosted([(F.sqrt(rank.frequency(F.col("terms"), "thing")), 2.0), (F.sqrt(rank.frequency(F.col("terms"), "nicht")), 0.5)]), 6).alias("score")),
    f"WITH {_DOCS}, f AS ({_TF} WHERE {_HIT}) SELECT uri, round((2 * sqrt(f0) + 0.5 * sqrt(f1)) * ((f0 > 0)::INT + (f1 > 0)::INT) / 2, 6) AS score FROM f",
)
_add(
    "explained",
    lambda s, d: rank.explained(*_hits(s, d), ["thing", "nicht"]).select("uri", F.round("explanation.value", 6).alias("value"), F.round(F.col("explanation.details")[0]["value"], 6).alias("first"), F.col("explanation.details")[1]["match"].alias("second_matches")),
    f"WITH {_DOCS}, {_stats('thing', 'nicht')}, f AS ({_TF} WHERE {_HIT}), e AS (SELECT uri, sqrt(f0) * (ln(n.n_docs / (n.df_0 + 1)) + 1) AS a, sqrt(f1) * (ln(n.n_docs / (n.df_1 + 1)) + 1) AS b, f1 > 0 AS m FROM f, n) SELECT uri, round(a + b, 6) AS value, round(a, 6) AS first, m AS second_matches FROM e",
)
_add("hit_batches", lambda s, d: rank.batches(_hits(s, d)[0].select("uri", "ts")).select("uri", "batch"), f"WITH {_DOCS} SELECT uri, (row_number() OVER (ORDER BY ts DESC, uri) - 1) // 25 AS batch FROM d WHERE {_HIT}")
_add("sliced_triples", lambda s, d: rank.sliced(_graph(s, d).where("p = 'name'"), 5, 10, "s", "o").select("s", "o"), f"WITH {_GRAPH} SELECT s, o FROM g WHERE p = 'name' ORDER BY s, o LIMIT 10 OFFSET 5")
_add("event_rate", lambda s, d: rank.event_rate(tables.read(s, d, "events"), "ts").select(scalar.date_string(F.col("start")).alias("start"), "n", F.round("per_second", 9).alias("per_second")), "SELECT strftime(date_trunc('hour', ts), '%Y%m%d%H%M%S') AS start, count(*) AS n, round(count(*) / 3600.0, 9) AS per_second FROM events GROUP BY 1")
_add("source_status", lambda s, d: rank.source_status(tables.documents(s, d)).select("source", "items", scalar.date_string(F.col("latest")).alias("latest"), "has_text"), f"WITH {_DOCS} SELECT source, count(*) AS items, strftime(max(ts), '%Y%m%d%H%M%S') AS latest, max((text IS NOT NULL)::INT) = 1 AS has_text FROM d GROUP BY source")
_add("matches_and_returned", lambda s, d: rank.matches_and_returned(_hits(s, d)[0], 10), f"WITH {_DOCS} SELECT source, count(*) AS matches, least(count(*), 10) AS returned FROM d WHERE {_HIT} GROUP BY source")
_add("terms_of_query", lambda s, d: s.createDataFrame([(t,) for t in human.search_terms(human.parse("the thing -other OR word"), analysis.STOP.terms)], "term string"), "SELECT unnest(['thing', 'word']) AS term")

# --- relations ----------------------------------------------------------------------------------------------------------------


def _relations(names, table: str, key: str, subject, obj=None):
    def run(s: SparkSession, d: str) -> DataFrame:
        df = tables.read(s, d, table)
        made = [(relations.holds(n, subject(), obj()) if obj else F.round(relations.value(n, subject()), 6)).alias(n) for n in names]
        return df.select(F.col(key).alias("id"), *made)

    return run


_X = "(s_acctbal / 1000)"
_add(
    "math_unary",
    _relations(tuple(relations.UNARY), "supplier", "s_suppkey", lambda: (F.col("s_acctbal") / 1000).cast("string")),
    f'SELECT s_suppkey AS id, round(abs({_X}), 6) AS "absoluteValue", round(cos({_X}), 6) AS cos, round({_X} * pi() / 180, 6) AS degrees, round({_X}, 6) AS "equalTo", round(-{_X}, 6) AS negation, floor({_X})::DOUBLE AS rounded, round(sin({_X}), 6) AS sin, round(sinh({_X}), 6) AS sinh, round(tan({_X}), 6) AS tan, round(tanh({_X}), 6) AS tanh FROM supplier',
)
_add(
    "math_pair",
    _relations(tuple(relations.PAIR), "part", "p_partkey", lambda: F.array((F.col("p_retailprice") / 100).cast("string"), (F.col("p_size") % 4).cast("string"))),
    'SELECT p_partkey AS id, round(atan2(a, b), 6) AS atan2, round(a - b, 6) AS difference, round(pow(a, b), 6) AS exponentiation, CASE WHEN b <> 0 THEN floor(a / b) END::DOUBLE AS "integerQuotient", CASE WHEN b <> 0 THEN round(a / b, 6) END AS quotient, CASE WHEN b <> 0 THEN round(a % b, 6) END AS remainder FROM (SELECT p_partkey, p_retailprice / 100 AS a, (p_size % 4)::DOUBLE AS b FROM part)',
)
_add("math_list", _relations(tuple(relations.LIST), "part", "p_partkey", lambda: F.array(F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"), F.lit("2"))), "SELECT p_partkey AS id, round(p_retailprice + p_size + 2, 6) AS sum, round(p_retailprice * p_size * 2, 6) AS product FROM part")
_add(
    "math_comparison",
    _relations(tuple(relations.COMPARISON), "customer", "c_custkey", lambda: F.col("c_acctbal").cast("string"), lambda: F.lit("4500.5")),
    'SELECT c_custkey AS id, c_acctbal > 4500.5 AS "greaterThan", c_acctbal < 4500.5 AS "lessThan", c_acctbal <= 4500.5 AS "notGreaterThan", c_acctbal >= 4500.5 AS "notLessThan", c_acctbal <> 4500.5 AS "notEqualTo" FROM customer',
)
_add(
    "math_in_pattern",
    lambda s, d: triples.match(_graph(s, d), [("?u", "balance", "?b"), ("?b", "math:greaterThan", "5000"), (("?b", "1000"), "math:quotient", "?k"), ("?k", "math:rounded", "?r")], ["u", "r"]),
    "SELECT 'supplier:' || s_suppkey AS u, floor(s_acctbal / 1000)::DOUBLE AS r FROM supplier WHERE s_acctbal > 5000",
)
_add("math_turned_round", lambda s, d: triples.match(_graph(s, d), [("?u", "balance", "?b"), ("?x", "math:negation", "?b")], ["u", "x"]), "SELECT 'supplier:' || s_suppkey AS u, -s_acctbal AS x FROM supplier")

# --- scalar functions ---------------------------------------------------------------------------------------------------------

_NOW = "2024-01-20 12:00:00"


def _scalar(name: str, table: str, key: str, value, sql: str) -> None:
    _add(name, lambda s, d: tables.read(s, d, table).select(F.col(key).alias("id"), value().alias("value")), f"SELECT {key} AS id, {sql} AS value FROM {table}")


_now = lambda: F.lit(_NOW).cast("timestamp")
_DAYS = f"date_diff('day', ts, TIMESTAMP '{_NOW}')"
_scalar("pretty_date", "events", "event_id", lambda: scalar.pretty_date(F.col("ts"), _now()), f"CASE WHEN {_DAYS} = 0 THEN 'Today' WHEN {_DAYS} = 1 THEN 'Yesterday' WHEN {_DAYS} BETWEEN 2 AND 6 THEN {_DAYS} || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END")
_scalar("fuzzy_date", "events", "event_id", lambda: scalar.fuzzy_date(F.col("ts"), _now()), f"CASE WHEN {_DAYS} = 0 THEN 'Today' WHEN {_DAYS} = 1 THEN 'Yesterday' WHEN {_DAYS} BETWEEN 2 AND 6 THEN strftime(ts, '%A') ELSE strftime(ts, '%B %-d') END || strftime(ts, ' %H:%M')")
_scalar("pretty_duration", "orders", "o_orderkey", lambda: scalar.pretty_duration(F.col("o_orderkey") * 37), "CASE WHEN o_orderkey * 37 < 60 THEN 'less than a minute' ELSE concat_ws(' ', CASE WHEN o_orderkey * 37 // 3600 > 0 THEN o_orderkey * 37 // 3600 || ' hour' || CASE WHEN o_orderkey * 37 // 3600 > 1 THEN 's' ELSE '' END END, CASE WHEN o_orderkey * 37 // 60 % 60 > 0 THEN o_orderkey * 37 // 60 % 60 || ' minute' || CASE WHEN o_orderkey * 37 // 60 % 60 > 1 THEN 's' ELSE '' END END) END")
_scalar("unix_time", "orders", "o_orderkey", lambda: scalar.date_string(scalar.from_unix_time(F.col("o_orderkey") * 86_399)), "strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y%m%d%H%M%S')")
_scalar("date_resolutions", "events", "event_id", lambda: F.concat_ws("|", *[scalar.date_at(F.col("ts"), r) for r in scalar.RESOLUTIONS]), "concat_ws('|', strftime(ts, '%Y'), strftime(ts, '%Y%m'), strftime(ts, '%Y%m%d'), strftime(ts, '%Y%m%d%H'), strftime(ts, '%Y%m%d%H%M'), strftime(ts, '%Y%m%d%H%M%S'), strftime(ts, '%Y%m%d%H%M%S%g'))")
_scalar("number_string", "orders", "o_orderkey", lambda: F.concat_ws("|", scalar.number_string(F.col("o_orderkey") * 1_000_003), scalar.string_number(scalar.number_string(F.col("o_orderkey") * -17)).cast("string")), "concat_ws('|', '0' || lpad(lower(to_base(o_orderkey * 1000003, 36)), 13, '0'), (o_orderkey * -17)::VARCHAR)")
_scalar("hex_escape", "part", "p_partkey", lambda: scalar.hex_escape(F.concat(F.lit("/é <a>/"), "p_name")), "'/%C3%A9%20%3Ca%3E/' || replace(p_name, ' ', '%20')")
_scalar("hex_unescape", "part", "p_partkey", lambda: scalar.hex_unescape(F.concat(F.lit("100%/%C3%A9+"), F.replace("p_name", F.lit(" "), F.lit("%20")))), "'100%/é+' || p_name")
_scalar("file_uris", "part", "p_partkey", lambda: F.concat_ws("|", scalar.with_fragment(scalar.path_uri(F.concat(F.lit("/a b/"), "p_name")), F.lit("m1")), scalar.uri_path(scalar.path_uri(F.concat(F.lit("/a b/"), "p_name"))), scalar.same_uri(scalar.path_uri(F.col("p_name")), F.concat(F.lit("file://"), "p_name")).cast("string")), "concat_ws('|', 'file:///a%20b/' || replace(p_name, ' ', '%20') || '#m1', '/a b/' || p_name, 'true')")
_GUID = "md5(p_name || p_partkey)"
_LONG = f"concat_ws('-', substr({_GUID}, 1, 8), substr({_GUID}, 9, 4), substr({_GUID}, 13, 4), substr({_GUID}, 17, 4), substr({_GUID}, 21, 12))"
_scalar("short_guid", "part", "p_partkey", lambda: scalar.guid_uri(scalar.long_guid(scalar.short_guid(F.md5(F.concat("p_name", "p_partkey"))))), f"'uid:' || replace(replace(rtrim(base64(unhex({_GUID})), '='), '+', '-'), '/', '_')")
_scalar("long_guid", "part", "p_partkey", lambda: scalar.long_guid(scalar.short_guid(F.md5(F.concat("p_name", "p_partkey")))), _LONG)
_WHEN = lambda k: F.when(F.col("event_id") % k != 0, F.col("ts"))
_scalar(
    "versions",
    "events",
    "event_id",
    lambda: F.concat_ws("|", scalar.is_newer(_WHEN(3), F.when(F.col("event_id") % 5 != 0, _now())).cast("string"), scalar.is_obsoleted(_WHEN(3), F.when(F.col("event_id") % 5 != 0, _now())).cast("string")),
    f"concat_ws('|', CASE WHEN event_id % 3 = 0 THEN 'false' WHEN event_id % 5 = 0 THEN 'true' ELSE (ts > TIMESTAMP '{_NOW}')::VARCHAR END, CASE WHEN event_id % 5 = 0 THEN 'false' WHEN event_id % 3 = 0 THEN 'true' ELSE (ts <= TIMESTAMP '{_NOW}')::VARCHAR END)",
)
_scalar("pattern_list", "part", "p_partkey", lambda: F.col("p_name").rlike(scalar.pattern_regex(["*ring", "/red w.*/", "/(/", "small gear"])).cast("string"), "(ends_with(p_name, 'ring') OR regexp_full_match(p_name, 'red w.*') OR p_name = 'small gear')::VARCHAR")
_EDGE = r"(^|[^\p{L}\p{N}])"
_scalar("found_terms", "documents", "doc_id", lambda: F.array_join(scalar.found_terms(F.coalesce("text", F.lit("")), ["thing", "attion", "nicht"]), ","), "array_to_string(list_filter(['thing', 'attion', 'nicht'], lambda w: regexp_matches(coalesce(text, ''), '(?i)" + _EDGE + "' || w || '" + _EDGE.replace("^|", "$|") + "')), ',')")
_scalar("without_html", "pages", "page_id", lambda: F.md5(scalar.without_html(F.col("html"))), "md5(array_to_string(list_transform(regexp_split_to_array(html, '\\r?\\n'), lambda x: replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '&nbsp;', ' '), '&apos;', '''')), chr(10)))")
_scalar("url_words", "pages", "page_id", lambda: F.lower(scalar.url_fuzzy_divide(F.regexp_extract("url", "^[a-z]+://[a-z.]+", 0))), "lower(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[a-z.]+', 0), '^.*?://', ''), '[^a-z]+', ' ', 'g'))")
_scalar("xml_characters", "part", "p_partkey", lambda: scalar.valid_xml(F.concat("p_name", F.lit("\x01\x0b￾<"))), "p_name || '   <'")
_scalar("sanitize_path", "part", "p_partkey", lambda: scalar.sanitize_path(F.concat(F.lit("//"), "p_name", F.lit("//"))), "'/' || p_name")
_scalar("parse_date", "events", "event_id", lambda: scalar.date_string(scalar.parse_date(F.when(F.col("event_id") % 2 == 0, scalar.date_string(F.col("ts"))).otherwise(F.lit("2024")))), "CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y%m%d%H%M%S') END")
_scalar("has_space", "part", "p_partkey", lambda: scalar.has_space(F.col("p_name")).cast("string"), "regexp_matches(p_name, '\\s')::VARCHAR")
_scalar("length_filter", "documents", "doc_id", lambda: F.size(analysis.Analyzer("simple", least=3, longest=6).column(F.col("text"))).cast("long"), r"len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+'), lambda t: length(t) BETWEEN 3 AND 6))")
_scalar("field_length_limit", "documents", "doc_id", lambda: F.size(analysis.Analyzer("simple", most=100).column(F.col("text"))).cast("long"), r"least(100, len(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')))")
_scalar("per_field", "documents", "doc_id", lambda: F.size(analysis.PerField(SIMPLE, {"src1": analysis.KEYWORD}).column(F.col("source"), F.col("text"))).cast("long"), r"CASE WHEN source = 'src1' THEN (coalesce(text, '') <> '')::BIGINT ELSE len(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) END")
_scalar("analyzer_keyword", "part", "p_partkey", lambda: F.array_join(analysis.KEYWORD.column(F.col("p_name")), "|"), "p_name")

for _language in sorted(set(STEMMERS) - {"english"}):
    _add(f"stem_{_language}", lambda s, d, x=_language: analysis.stemmed_vocabulary(tables.documents(s, d).select(F.explode_outer(SIMPLE.column(F.col("text"))).alias("term")).where(F.col("term").isNotNull()), "term", x))

# --- pages, changes and folders ------------------------------------------------------------------------------------------------

_add("html_meta", lambda s, d: tables.read(s, d, "pages").select("page_id", html.meta(F.col("html"), "description").alias("description")), """SELECT page_id, regexp_extract(html, '(?is)<meta\\b[^>]*?\\bname\\s*=\\s*["'']description["''][^>]*?\\bcontent\\s*=\\s*["'']([^"'']*)["'']', 1) AS description FROM pages""")


def _late_changes(s: SparkSession, d: str) -> DataFrame:
    """Events as changes of a user's properties: an error takes its key away."""
    e = tables.read(s, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user:"), "user_id").alias("uri"), F.when(F.col("event_type") == "error", "click").otherwise(F.col("event_type")).alias("key"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_id").cast("string")).alias("value"))
    old = tables.read(s, d, "customer").select(F.concat(F.lit("user:"), "c_custkey").alias("uri"), F.lit("click").alias("key"), F.lit("old").alias("value"), (F.col("c_custkey") % 2 == 0).alias("persistent"))
    return changes.changed(old, e)


_add(
    "property_change_last",
    _late_changes,
    """WITH e AS (SELECT event_id AS seq, 'user:' || user_id AS uri, CASE event_type WHEN 'error' THEN 'click' ELSE event_type END AS key, CASE event_type WHEN 'error' THEN '' ELSE event_id::VARCHAR END AS value FROM events),
l AS (SELECT uri, key, arg_max(value, seq) AS value FROM e GROUP BY uri, key), o AS (SELECT 'user:' || c_custkey AS uri, 'click' AS key, 'old' AS value, c_custkey % 2 = 0 AS persistent FROM customer)
SELECT uri, key, value, persistent FROM o WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.uri = o.uri AND l.key = o.key) UNION ALL SELECT l.uri, l.key, l.value, coalesce(o.persistent, false) FROM l LEFT JOIN o ON o.uri = l.uri AND o.key = l.key WHERE l.value <> ''""",
)
_add("remove_by_property", lambda s, d: changes.removed_by_property(tables.documents(s, d), "k", "dc:language", "en").select("uri"), "SELECT 'doc:' || doc_id AS uri FROM documents WHERE lang <> 'en'")
_add(
    "changed_children",
    lambda s, d: changes.changed_children(
        tables.conversations(s, d),
        tables.conversations(s, d).where(F.col("uri").endswith("#0")).select(F.col("parent_uri").alias("uri"), F.lit("dc:title").alias("key"), F.col("text").alias("value")),
        tables.conversations(s, d).where(F.col("uri").endswith("0#0")).select(F.col("parent_uri").alias("uri"), F.lit("dc:title").alias("key"), F.lit("new").alias("value")),
    ),
    "SELECT 'im:' || conv_id || '#' || turn AS uri, 'parent:dc:title' AS key, 'new' AS value FROM conversations WHERE conv_id % 10 = 0 AND conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)",
)
_add(
    "mutable_overwrite",
    lambda s, d: changes.overwritten(tables.read(s, d, "events").select(F.col("user_id").cast("string").alias("uri"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("value"), (F.col("event_type") == "view").alias("mutable"))),
    "SELECT user_id::VARCHAR AS uri, event_id AS seq, event_type AS key, event_id::VARCHAR AS value, false AS mutable FROM events WHERE event_type <> 'view' UNION ALL SELECT user_id::VARCHAR, max(event_id), 'view', max(event_id)::VARCHAR, true FROM events WHERE event_type = 'view' GROUP BY user_id",
)
_LISTING = "l AS (SELECT n_nationkey AS uid, CASE WHEN n_nationkey > 0 THEN n_nationkey // 2 END AS parent_uid, n_name AS name FROM nation)"
_add(
    "folder_paths",
    lambda s, d: registry.folders(tables.read(s, d, "nation").select(F.col("n_nationkey").alias("uid"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2)).alias("parent_uid"), F.col("n_name").alias("name"))).select("uid", "path"),
    f"WITH RECURSIVE {_LISTING}, p(uid, path) AS (SELECT uid, '/' || name FROM l WHERE parent_uid IS NULL UNION ALL SELECT l.uid, p.path || '/' || l.name FROM l JOIN p ON l.parent_uid = p.uid) SELECT uid, path FROM p",
)
_add("located_files", lambda s, d: registry.listed(s, tables.read(s, d, "part").select(F.concat(F.lit("/p/"), "p_name", F.lit(".part")).alias("path"))).select("uri", "source", F.get(F.filter("properties", lambda p: p["key"] == "file:parent"), 0)["value"].alias("parent")), "SELECT 'file:///p/' || p_name || '.part' AS uri, 'Locate' AS source, '/p' AS parent FROM part")

# --- graphs -----------------------------------------------------------------------------------------------------------------------

_add("rdf_subjects", lambda s, d: triples.subjects(_graph(s, d), "in_region", "region:2"), "SELECT 'nation:' || n_nationkey AS s FROM nation WHERE n_regionkey = 2")
_add("rdf_objects", lambda s, d: triples.objects(_graph(s, d), "nation:4", "name"), "SELECT n_name AS o FROM nation WHERE n_nationkey = 4")
_add("rdf_predicates", lambda s, d: triples.predicates(_graph(s, d)), f"WITH {_GRAPH} SELECT DISTINCT p FROM g")
_add("rdf_entities", lambda s, d: triples.entities(_graph(s, d)), f"WITH {_GRAPH} SELECT s FROM g UNION SELECT o FROM g WHERE p IN ('in_region', 'in_nation')")
_add("rdf_metas", lambda s, d: triples.metas(_graph(s, d)), "SELECT '' AS g")
_add("rdf_of_type", lambda s, d: triples.of_type(_hierarchy(s, d), "class:3"), "SELECT 'supplier:' || s_suppkey AS s FROM supplier WHERE s_nationkey = 3")
_add("rdf_select_where", lambda s, d: triples.select_where(_graph(s, d), s=tables.read(s, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("nation:"), "n_nationkey")), p=s.createDataFrame([("name",)], "p string"), filters=[triples.literal_filter("o", "contains", "A")]), "SELECT 'nation:' || n_nationkey AS s, 'name' AS p, n_name AS o FROM nation WHERE n_regionkey = 1 AND contains(n_name, 'A')")
_add("rdf_links", lambda s, d: triples.links(tables.read(s, d, "pages").select(F.col("url").alias("uri"), html.links(F.col("html")).alias("links"))).distinct(), """SELECT DISTINCT url AS s, 'text:link' AS p, link AS o FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS link FROM pages)""")
_add("rdf_to_documents", lambda s, d: triples.to_documents(triples.of_documents(tables.documents(s, d))).select("uri", F.to_json("properties").alias("properties")), """SELECT 'doc:' || doc_id AS uri, '[{"type":"k","key":"dc:language","value":"' || lang || '"},{"type":"k","key":"dc:source","value":"' || source || '"},{"type":"k","key":"fixme:filesize","value":"' || n_chars || '"}]' AS properties FROM documents""")
_add("rdf_renamed", lambda s, d: triples.renamed(_graph(s, d).where("p = 'in_region'"), {"nation:": "http://x.example/n/", "region:": "http://x.example/r/", "in_": "http://x.example/p/in_"}), "SELECT 'http://x.example/n/' || n_nationkey AS s, 'http://x.example/p/in_region' AS p, 'http://x.example/r/' || n_regionkey AS o FROM nation")
_add("rdf_converted", lambda s, d: triples.converted(_graph(s, d).where("p = 'name'"), F.upper, F.lower), f"WITH {_GRAPH} SELECT upper(s) AS s, p, lower(o) AS o FROM g WHERE p = 'name'")
_add("rdf_subproperties", lambda s, d: triples.with_subproperties(_graph(s, d).where("p <> 'balance'").union(s.createDataFrame([("in_nation", triples.SUBPROPERTY, "in"), ("in_region", triples.SUBPROPERTY, "in"), ("in", triples.SUBPROPERTY, "near")], "s string, p string, o string")), "near"), f"WITH {_GRAPH} SELECT s, 'near' AS p, o FROM g WHERE p IN ('in_nation', 'in_region')")
_add("rdf_connected", lambda s, d: triples.connected(_graph(s, d).where("p IN ('in_nation', 'in_region')")), "WITH r AS (SELECT r_regionkey AS k, min(x) AS part FROM (SELECT r_regionkey, 'region:' || r_regionkey AS x FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT n_regionkey, 'nation:' || n_nationkey FROM nation) GROUP BY 1) SELECT node, part FROM (SELECT DISTINCT 'region:' || n_regionkey AS node, n_regionkey AS k FROM nation UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) JOIN r USING (k)")


def _blanks(s: SparkSession, d: str) -> DataFrame:
    """A blank thing for each customer, of which those of one nation and segment say the same."""
    c = tables.read(s, d, "customer")
    of = lambda p, o: c.select(F.concat(F.lit("_:c"), "c_custkey").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))
    return of("nation", F.col("c_nationkey")).union(of("segment", F.col("c_mktsegment")))


_add("rdf_lean", lambda s, d: triples.lean(_blanks(s, d)), "WITH k AS (SELECT min('_:c' || c_custkey) AS s, c_nationkey, c_mktsegment FROM customer GROUP BY 2, 3) SELECT s, 'nation' AS p, c_nationkey::VARCHAR AS o FROM k UNION ALL SELECT s, 'segment', c_mktsegment FROM k")
_add("rdf_self_contained", lambda s, d: triples.self_contained(_blanks(s, d)).select("s", "p", "part"), "SELECT '_:c' || c_custkey AS s, unnest(['nation', 'segment']) AS p, '_:c' || c_custkey AS part FROM customer")
_add(
    "rdf_threads",
    lambda s, d: triples.fixpoint(tables.read(s, d, "conversations").where("turn > 0 AND turn < 12").select(F.concat_ws("#", "conv_id", "turn").alias("s"), F.lit("prop:k:fixme:reference").alias("p"), F.concat_ws("#", F.col("conv_id"), F.col("turn") - 1).alias("o")), triples.THREAD_RULES).where("p = 'in_thread'"),
    "WITH RECURSIVE e AS (SELECT DISTINCT conv_id || '#' || turn AS a, conv_id || '#' || (turn - 1) AS b FROM conversations WHERE turn > 0 AND turn < 12), t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a AS s, 'in_thread' AS p, b AS o FROM t",
)
_add("transitive_closure", lambda s, d: triples.closure(_hierarchy(s, d).where(F.col("p") == triples.SUBCLASS).select(F.col("s").alias("a"), F.col("o").alias("b"))), "WITH RECURSIVE e AS (SELECT 'class:' || n_nationkey AS a, 'class:' || n_nationkey // 2 AS b FROM nation WHERE n_nationkey > 0), t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a) SELECT a, b FROM t")
