"""Chat formatting by quotation linking.

Lines that begin with ``>`` quote; the number of marks is the level. A passage is a run of lines of one
level without a blank one; its lines are joined, so that it may be wrapped otherwise than where it was said,
normalised (lower case, letters and digits only, single spaces) and hashed. A quoted passage is joined to
the first message of the same conversation that has it among its own, as a whole; where none has, the
shorter passages in it, its sentences and then its lines, are. Passages under MIN_WORDS words are too common
to tell whose they are, and are linked only with the message just before. A message replies to the message
that most of the words it quotes at level 1 come from (of equals, the latest); passages of deeper levels are
linked to their originals too. The root of a thread is found along replies, and messages are ordered by
root and turn, so that a reply follows what it answers. Quotes are taken out of the texts.

Passages that many messages quote, messages that many reply to and messages that come many times are dealt
out; messages that quote nothing aren't joined at all.

Hostile cases: a null or empty text quotes nothing and is quoted by nobody; a null conversation or turn is
linked with nothing and is its own root; repeated rows each get the same result, and rows that share
conversation and turn are one message; a passage that is new, or only in later messages, stays unlinked; an
empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import counted, even_join, forget, written

MARKS = r"^[ \t]*((?:>[ \t]*)+)"
KEY = ("conv_id", "turn")
#: Shorter passages are looked for in the message before only.
MIN_WORDS = 4


def _normal(s: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))


def _lines(text: Column) -> Column:
    """level, raw (without its marks) and words (normalised) of each line."""

    def line(s: Column) -> Column:
        raw = F.regexp_replace(s, MARKS, "")
        level = F.length(F.regexp_replace(F.regexp_extract(s, MARKS, 1), "[^>]", ""))
        return F.struct(level.alias("level"), raw.alias("raw"), _normal(raw).alias("words"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), line)


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, passage, rank and words: the passages of each message (rank 0) and the shorter ones in each (1 and 2)."""
    rows = messages.select(*KEY, _lines(F.col("text")).alias("lines"))
    # Where a run begins: at words behind a blank line, another level or nothing.

    def begins(x: Column, i: Column) -> Column:
        before = F.get("lines", i - 1)
        return F.when((x["words"] != "") & (before.isNull() | (before["words"] == "") | (before["level"] != x["level"])), i)

    rows = rows.withColumn("starts", F.array_compact(F.transform("lines", begins)))

    def run(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("lines"))
        own = F.filter(F.slice(F.col("lines"), i + 1, end - i), lambda x: x["words"] != "")
        return F.struct(F.get("lines", i)["level"].alias("level"), F.array_join(F.transform(own, lambda x: x["raw"]), " ").alias("raw"), F.transform(own, lambda x: x["words"]).alias("lines"))

    # explode_outer(), as the optimiser would find all runs twice to see below explode() if there are any.
    rows = rows.select(*KEY, F.explode_outer(F.transform("starts", run)).alias("run")).where(F.col("run").isNotNull()).select(*KEY, "run.*")
    rows = rows.withColumns({"passage": _normal(F.col("raw")), "sentences": F.transform(F.split("raw", "[.!?]+"), _normal)})
    units = F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), F.col("passage").alias("words"))),
        F.transform("sentences", lambda w: F.struct(F.lit(1).alias("rank"), w.alias("words"))),
        F.transform("lines", lambda w: F.struct(F.lit(2).alias("rank"), w.alias("words"))),
    )
    rows = rows.withColumn("units", F.array_distinct(F.filter(units, lambda u: u["words"] != "")))
    return rows.select(*KEY, "level", _digest("passage").alias("passage"), F.explode_outer("units").alias("u")).select(*KEY, "level", "passage", "u.rank", "u.words")


def unquoted(text: Column) -> Column:
    """A text without its quoted lines and the space around."""
    own = F.filter(F.split(text, "\r?\n"), lambda s: ~s.rlike(MARKS))
    return F.when(text.isNotNull(), F.btrim(F.array_join(own, "\n"), F.lit(" \t\r\n")))


def _digest(*parts: str | Column) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", *parts)))


def _n_words() -> Column:
    return F.size(F.split("words", " "))


def _spot(turn: Column) -> Column:
    """What a passage is looked up by: conversation and words, and for a short one the turn it must be said in."""
    return F.when(_n_words() >= MIN_WORDS, _digest("conv_id", "words")).otherwise(_digest("conv_id", turn.cast("string"), "words"))


def _placed(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, n_quotes, n_linked, depth and reply_to of the messages that quote; the counts are of distinct passages."""
    quoted = passages(_placed(messages).where(F.col("text").contains(">")).select(*KEY, "text").distinct()).where("level > 0")
    quoted = written(quoted.select(*KEY, "level", "passage", "rank", _n_words().alias("n"), _spot(F.col("turn") - 1).alias("spot")).distinct(), "quotes")
    said = passages(_placed(messages)).where("level = 0").select(_spot(F.col("turn")).alias("spot"), "turn")
    said = said.join(quoted.select("spot").distinct(), "spot", "left_semi") if quoted.limit(1).count() else said.limit(0)
    originals = written(said.groupBy("spot").agg(F.min("turn").alias("said")), "originals")
    many = counted(quoted, "spot")
    found = even_join(quoted, originals, "spot", many, quoted.count(), "left")
    found = found.withColumn("said", F.when(F.col("said") < F.col("turn"), F.col("said")))
    # Of each passage the longest that was found of it, and whose most of its words are.
    pieces = found.groupBy(*KEY, "level", "passage", "rank", "said").agg(F.sum("n").alias("n"))
    best = F.max(F.when(F.col("said").isNotNull(), F.struct((-F.col("rank")).alias("rank"), "n", "said")))
    linked = pieces.groupBy(*KEY, "level", "passage").agg(best.alias("best")).select(*KEY, "level", "best.n", "best.said")
    near = F.sum(F.when(F.col("level") == 1, F.col("n")))
    votes = linked.groupBy(*KEY, "said").agg(F.count(F.lit(1)).alias("quotes"), F.max("level").alias("depth"), near.alias("near"))
    top = F.max(F.when(F.col("near").isNotNull(), F.struct("near", "said")))
    quotes = F.when(F.col("said").isNotNull(), F.col("quotes")).otherwise(0)
    out = written(votes.groupBy(*KEY).agg(F.sum("quotes").alias("n_quotes"), F.sum(quotes).alias("n_linked"), F.max("depth").alias("depth"), top["said"].alias("reply_to")), "linked")
    forget(quoted, originals, many)
    return out


def _at(turn: str) -> Column:
    return F.concat_ws(":", "conv_id", turn)


def roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root of the messages with a reply_to: pointers are doubled until all stand at a root."""
    now = written(replies.where(F.col("reply_to").isNotNull()).select(*KEY, F.col("reply_to").alias("root"), _at("reply_to").alias("at")), "threads")
    n = now.count()
    while True:
        up = now.select(_at("turn").alias("at"), F.col("root").alias("above"))
        many = counted(now, "at")
        nxt = even_join(now, up, "at", many, n, "left").select(*KEY, F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        nxt = written(nxt.withColumn("at", _at("root")), "threads")
        moved = nxt.where("moved").limit(1).count()
        forget(now, many)
        now = nxt
        if not moved:
            out = now.select(*KEY, "root")
            out.written_path = now.written_path
            return out


def conversations(messages: DataFrame) -> DataFrame:
    """A row for each message, ordered by conversation, thread root and turn.

    conv_id, turn, role, reply_to, thread_root, depth (of its quotes), n_quotes, n_linked and text without quotes.
    """
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    linked = link(messages)
    tops = roots(linked)
    facts = written(linked.join(tops, list(KEY), "left").withColumn("at", _at("turn")).drop(*KEY), "facts")
    forget(linked, tops)
    quotes = F.coalesce(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").contains(">"), F.lit(False))
    quoting = messages.where(quotes).withColumn("at", _at("turn"))
    many = counted(quoting, "at")
    joined = even_join(quoting, facts, "at", many, many.agg(F.sum("n_rows")).first()[0] or 0, "left").drop("at")
    none = {c: F.lit(None).cast(facts.schema[c].dataType) for c in ("n_quotes", "n_linked", "depth", "reply_to", "root")}
    both = joined.unionByName(messages.where(~quotes).withColumns(none))
    zero = F.lit(0).cast("long")
    out = both.select(
        *KEY,
        "role",
        "reply_to",
        F.coalesce("root", "turn").alias("thread_root"),
        F.coalesce(F.col("depth").cast("long"), zero).alias("depth"),
        F.coalesce("n_quotes", zero).alias("n_quotes"),
        F.coalesce("n_linked", zero).alias("n_linked"),
        unquoted(F.col("text")).alias("text"),
    )
    return out.orderBy("conv_id", "thread_root", "turn")


_NORMAL = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

ORACLE = rf"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT conv_id, turn, text, unnest(regexp_split_to_array(text, '\r?\n')) AS s, unnest(range(len(regexp_split_to_array(text, '\r?\n')))) AS i FROM m),
l AS (SELECT conv_id, turn, text, i, length(regexp_replace(regexp_extract(s, '^[ \t]*((?:>[ \t]*)+)', 1), '[^>]', '', 'g')) AS level, regexp_replace(s, '^[ \t]*((?:>[ \t]*)+)', '') AS raw FROM s),
w AS (SELECT *, {_NORMAL.format("raw")} AS words FROM l),
b AS (SELECT *, (words <> '' AND (coalesce(lag(words) OVER o, '') = '' OR lag(level) OVER o <> level))::INT AS b FROM w WINDOW o AS (PARTITION BY conv_id, turn, text ORDER BY i)),
r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id, turn, text ORDER BY i) AS run FROM b),
p AS (SELECT conv_id, turn, min(level) AS level, string_agg(raw, ' ' ORDER BY i) AS raw, list(words) AS lines FROM r WHERE words <> '' GROUP BY conv_id, turn, text, run),
q AS (SELECT conv_id, turn, level, {_NORMAL.format("raw")} AS passage, raw, lines FROM p),
u AS (SELECT conv_id, turn, level, passage, 0 AS rank, passage AS words FROM q UNION
  SELECT conv_id, turn, level, passage, 1, {_NORMAL.format("x")} FROM (SELECT *, unnest(regexp_split_to_array(raw, '[.!?]+')) AS x FROM q) UNION
  SELECT conv_id, turn, level, passage, 2, unnest(lines) FROM q),
v AS (SELECT *, len(string_split(words, ' ')) AS n FROM u WHERE words <> ''),
o AS (SELECT conv_id, words, CASE WHEN n < {MIN_WORDS} THEN turn END AS spot, min(turn) AS said FROM v WHERE level = 0 GROUP BY ALL),
f AS (SELECT v.conv_id, v.turn, v.level, v.passage, v.rank, o.said, sum(v.n) AS n FROM v LEFT JOIN o
  ON o.conv_id = v.conv_id AND o.words = v.words AND o.spot IS NOT DISTINCT FROM CASE WHEN v.n < {MIN_WORDS} THEN v.turn - 1 END AND o.said < v.turn WHERE v.level > 0 GROUP BY ALL),
g AS (SELECT conv_id, turn, level, passage, max(struct_pack(rank := -rank, n := n, said := said)) FILTER (said IS NOT NULL) AS best FROM f GROUP BY ALL),
h AS (SELECT conv_id, turn, best.said AS said, count(*) AS quotes, max(level) AS depth, sum(best.n) FILTER (level = 1) AS near FROM g GROUP BY ALL),
k AS (SELECT conv_id, turn, sum(quotes) AS n_quotes, sum(quotes) FILTER (said IS NOT NULL) AS n_linked, max(depth) AS depth,
  max(struct_pack(near := near, said := said)) FILTER (near IS NOT NULL) AS best FROM h GROUP BY ALL),
a AS (SELECT conv_id, turn, best.said AS reply_to FROM k WHERE best IS NOT NULL),
t(conv_id, turn, root) AS (SELECT conv_id, turn, reply_to FROM a UNION SELECT t.conv_id, t.turn, a.reply_to FROM t JOIN a ON t.conv_id = a.conv_id AND t.root = a.turn),
z AS (SELECT conv_id, turn, min(root) AS root FROM t GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, a.reply_to, coalesce(z.root, c.turn) AS thread_root, coalesce(k.depth, 0)::BIGINT AS depth,
  coalesce(k.n_quotes, 0)::BIGINT AS n_quotes, coalesce(k.n_linked, 0)::BIGINT AS n_linked,
  trim(array_to_string(list_filter(regexp_split_to_array(c.text, '\r?\n'), lambda s: NOT regexp_matches(s, '^[ \t]*((?:>[ \t]*)+)')), chr(10)), E' \t\r\n') AS text
FROM conversations c LEFT JOIN k USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn) LEFT JOIN z USING (conv_id, turn)
"""
