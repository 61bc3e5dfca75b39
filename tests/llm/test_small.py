"""Each operator against a plain reading of its contract on small hostile tables."""

import hashlib
import json
import random
import re
import unicodedata
import zlib
from itertools import pairwise
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import best_fit, bloom, flac, license_index, mcd_rules, minmax_dedup, prefix_bpe, queries, quote_linking, toxicity_chain, url_filter, weak_pii
from siftwell.llm.shared import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Extra columns have names that a careless operator would use itself.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words string, score string, class string, t string, words array<string>"


def table(spark, texts, schema=SCHEMA):
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "src0", None, None, "x", "y", "z", "u", ["w"]) for i, t in texts]
    return spark.createDataFrame(rows, schema)


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def hostile(spark):
    rng = random.Random(5)
    base = prose(rng, 120).split()
    texts = [None, "", "  \n\t ", "one", "a b c d", "a b c d e", "Ünïcode ß İ Σ ΑΣ 漢字 \U0001f600 test", "x" * 5000, "la " * 9000, "Mail joe.x@mail.example.com\n1.2.3.4 256.1.1.1 +1 (555) 555-1234 4111 1111 1111 1111 4111111111111112"]
    texts += [" ".join(base), " ".join(base), " ".join(base[:60] + ["changed"] + base[61:]), " ".join(base[:40]), "\n".join(["same line here"] * 30)]
    texts += ['token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" end', "Released under the MIT License.\n" * 3, "Licensed under the Apache License, Version 2.0. The GNU general\npublic-license", "\x00nul\x00 a#b*c$d%e&f|g<h>i"]
    texts += [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    rows = list(enumerate(texts))
    rows += [(None, "null id"), (None, None), (10, " ".join(base)), (10, " ".join(base))]
    return rows


@pytest.fixture(scope="module")
def docs(spark, hostile):
    return table(spark, hostile).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [])


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- 1 ---------------------------------------------------------------------------------------------------------------


def test_quotes_are_linked_and_ordered(spark):
    talk = [
        (1, 0, "user", "How do I sort a list?\nThanks!"),
        (1, 1, "other", "Unrelated start"),
        (1, 2, "assistant", "> how do I  SORT a list\nUse sorted()."),
        (1, 3, "user", ">> How do I sort a list?\n> Use sorted().\nGreat, and a dict?"),
        (1, 4, "user", "> never said\nhm"),
        (1, 5, "user", "> Great, and a dict?\n> Unrelated start\n> hm"),
        (2, 0, "user", "> How do I sort a list?\nother conversation"),
        (None, 1, "user", "> hm"),
        (3, None, "user", None),
        (1, 1, "other", "Unrelated start"),
        # Wrapped anew; a short passage that many say; two passages of one message, the longer of which decides.
        (4, 0, "user", "ok\n\nThe quick brown fox jumps over\nthe lazy dog and runs away"),
        (4, 1, "user", "ok"),
        (4, 2, "user", "> The quick brown\n> fox jumps over the lazy\n> dog and runs away\n\nIndeed it does so"),
        (4, 3, "user", "> ok\nnot from the one before"),
        (4, 4, "user", "ok"),
        (4, 5, "user", "> ok\nfrom the one before"),
        (4, 6, "user", "> Indeed it does so\n\n> The quick brown fox jumps over the lazy dog and runs away\n>\n> Indeed it does so\nyes"),
        (4, 7, "user", "> The quick brown fox jumps over\n> and something that nobody said"),
        (4, 7, "user", "> The quick brown fox jumps over\n> and something that nobody said"),
    ]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    rows = quote_linking.conversations(df).collect()
    got = {(r["conv_id"], r["turn"]): r for r in rows}
    assert {k: (r["reply_to"], r["thread_root"]) for k, r in got.items()} == {
        (1, 0): (None, 0), (1, 1): (None, 1), (1, 2): (0, 0), (1, 3): (2, 0), (1, 4): (None, 4), (1, 5): (3, 0), (2, 0): (None, 0), (None, 1): (None, 1), (3, None): (None, None),
        (4, 0): (None, 0), (4, 1): (None, 1), (4, 2): (0, 0), (4, 3): (None, 3), (4, 4): (None, 4), (4, 5): (4, 4), (4, 6): (0, 0), (4, 7): (0, 0),
    }
    assert (got[1, 3]["depth"], got[1, 3]["n_quotes"], got[1, 3]["n_linked"], got[1, 3]["text"]) == (2, 2, 2, "Great, and a dict?")
    assert (got[1, 4]["n_quotes"], got[1, 4]["n_linked"]) == (1, 0) and (got[4, 6]["n_quotes"], got[4, 6]["n_linked"]) == (2, 2)
    ordered = [(r["conv_id"], r["thread_root"], r["turn"]) for r in rows if r["conv_id"] == 4]
    assert ordered == sorted(ordered) and len(rows) == len(talk)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", talk)
    found = con.execute(quote_linking.ORACLE)
    names = [d[0] for d in found.description]
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in rows)
    assert quote_linking.conversations(df.limit(0)).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    blooms = bloom.build(keys, "key", 64)
    probed = bloom.probe(spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), "id"), F.col("key"), blooms, "maybe", 64)
    assert probed.where("id < 3000 AND NOT maybe").count() == 0
    n = bloom.blocks_for(3000)
    joined = bloom.probe(spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), "id"), F.col("key"), bloom.build(keys, "key", n), "maybe", n, most=1)
    assert joined.where("id < 3000 AND NOT maybe").count() == 0
    wide = bloom.probe(spark.range(6000).select(F.concat(F.lit("k"), "id").alias("key"), "id"), F.col("key"), bloom.build(keys, "key", n), "maybe", n)
    assert joined.exceptAll(wide).count() == 0
    assert wide.where("id >= 3000 AND maybe").count() < 60


def test_urls(spark):
    urls = [None, "", "no scheme/en/7", "HTTP://Example.COM/en/7?x#y", "https://a.example.com/en/71", "https://example.com/en/6", "http://example.net/de/8/z", "http://x.net/de/9", "http://notexample.com/fr/", "http://www.org.io/es/", "https://www.a.io/p/?b=2&utm_source=f&a=1#t", "http://a.io/p?a=1&b=2", "://", "a://b://c/en/", "http://com/en/"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)] + [(3, urls[3], "c", "c")], "page_id long, url string, host string, listed string")
    listed = url_filter.with_parts(pages.where("page_id = 11")).select("canonical")
    got = {r["page_id"]: r for r in url_filter.judge(pages, listed).collect()}
    assert len(got) == len(urls) and url_filter.judge(pages, listed).count() == len(urls) + 1
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate(LOWER)
        fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        verdict = best[2] if best else "block" if i in (10, 11) else "allow"
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best and best[0] + best[1], verdict), u
    assert url_filter.judge(pages.limit(0), listed.limit(0)).count() == 0


def test_urls_with_line_ends_as_in_sql(spark, tmp_path):
    tails = ["", "\n", "\r", "\u2028", "\u0085", "\r\n"]
    urls = [f"http://www.a.io{x}{t}" for t in tails for x in ("", ":80", "/p/", "/p/index.html", "/p.htm", "/p?ref=1", "/p?ref", "/p?utm_x=1\n2&b=1")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict", "canonical", "listed"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({url_filter.ORACLE})").fetchall()
    assert rows_of(queries.op2_url_filter(spark, str(tmp_path)), *columns) == sorted(want, key=str)


# --- 3 ---------------------------------------------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    where = {}
    for k in range(len(words) - 2):
        where.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + d for v in where.values() if len(v) > 1 for k in v for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, hostile, empty, monkeypatch):
    got = rows_of(mcd_rules.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = [(i, *(c := base_counts(t)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for i, t in hostile]
    assert got == sorted(want, key=str)
    monkeypatch.setattr(mcd_rules, "PLACES", 4)  # long texts by the wide way
    again = rows_of(mcd_rules.statistics(docs), "doc_id", "n_words", "n_repeat_words")
    assert again == sorted([(i, base_counts(t)[0], base_counts(t)[4]) for i, t in hostile], key=str)
    assert mcd_rules.judge(empty).count() == 0 and mcd_rules.passing(empty).count() == 0


def test_quality_outliers(spark):
    rng = random.Random(1)
    clean = [(i, prose(rng, rng.randrange(80, 400))) for i in range(300)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in prose(rng, 150).split())) for i in range(60)]
    df = table(spark, clean + junk)
    got = {r["doc_id"]: r["kept"] for r in mcd_rules.judge(df).collect()}
    assert all(got[i] for i, _ in clean) and not any(got[i] for i, _ in junk)
    kept = mcd_rules.passing(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [i for i, _ in clean]


def brute_estimates(x, langs, keys):
    """The estimator over rows x by plain numpy: starts, concentration steps, the least determinant, reweighting."""
    m, floors = mcd_rules, np.array(list(mcd_rules.FLOORS.values()), float)
    own = {k: x[keys == k].astype(float) for k in dict.fromkeys(keys)}
    lang_of = dict(zip(keys, langs))

    def raised(cov):
        root, cov = np.zeros((5, 5)), cov.copy()
        for i in range(5):
            cov[i, i] = max(cov[i, i], floors[i] ** 2)
            for j in range(i + 1):
                rest = cov[i, j] - root[i, :j] @ root[j, :j]
                root[i, j] = np.sqrt(max(rest, 1.0)) if i == j else rest / root[j, j]
        return root

    def d2(k, mean, root):
        return (np.linalg.solve(root, (own[k] - mean).T) ** 2).sum(axis=0)

    def estimated(inner, factor):
        def moments(rows):
            return np.concatenate([[len(rows)], rows.sum(axis=0), (rows.T @ rows)[np.tril_indices(5)]])

        sums = {k: moments(rows) for k, rows in inner.items()}
        total = sum(sums.values())
        out = {}
        for k in sums:
            of_lang = sum(v for j, v in sums.items() if lang_of[j] == lang_of[k])
            of_lang = (of_lang + m.PRIOR_ROWS * total / total[0]) / (of_lang[0] + m.PRIOR_ROWS)
            v = (sums[k] + m.PRIOR_ROWS * of_lang) / (sums[k][0] + m.PRIOR_ROWS)
            cov = np.zeros((5, 5))
            cov[np.tril_indices(5)] = v[6:]
            cov = cov + np.tril(cov, -1).T
            root = raised((cov - np.outer(v[1:6], v[1:6])) * factor)
            out[k] = (v[1:6], root, np.log(np.diag(root)).sum())
        return out

    def concentrate(params):
        inner = {}
        for k, (mean, root, _) in params.items():
            ring = np.minimum(np.floor(np.sqrt(d2(k, mean, root)) * m.FINE), m.RINGS - 1)
            least = np.sort(ring)[int(np.ceil(len(ring) * m.SUBSET)) - 1]
            inner[k] = own[k][ring <= least]
        return estimated(inner, m.CONSISTENCY)

    starts = {name: {} for name in m._STARTS}
    for k, rows in own.items():
        n, cells = len(rows), np.sort(np.floor(rows / 50), axis=0)
        q = {s: cells[int(np.ceil(n * s)) - 1] * 50 + 25 for s in (0.25, 0.5, 0.75)}
        size = np.maximum((q[0.75] - q[0.25]) / 1.349, floors)
        z = (rows - q[0.5]) / size
        length = np.maximum(np.sqrt((z**2).sum(axis=1)), 1e-9)[:, None]
        for name, v in (("quartiles", None), ("squashed", np.tanh(z)), ("directions", z / length)):
            r = np.eye(5)
            if v is not None:
                v = np.sign(v) * np.floor(np.abs(v) * m.SCALE + 0.5)
                c = v.T @ v
                both = np.sqrt(np.outer(np.diag(c), np.diag(c)))
                r = np.where(both > 0, 0.9 * c / np.where(both > 0, both, 1), 0.0)
                np.fill_diagonal(r, 1)
            root = raised(r * np.outer(size, size))
            starts[name][k] = (q[0.5], root, np.log(np.diag(root)).sum())
    for _ in range(m.FIRST_STEPS):
        starts = {name: concentrate(p) for name, p in starts.items()}
    best = {k: min((starts[name][k] for name in sorted(m._STARTS)), key=lambda p: p[2]) for k in own}
    while True:
        nxt = concentrate(best)
        moved = {k for k in own if nxt[k][2] < best[k][2] - m.FALL}
        best = {k: nxt[k] if k in moved else best[k] for k in own}
        if not moved:
            return estimated({k: own[k][d2(k, *best[k][:2]) <= m.TRIM] for k in own}, m.TRIM_CONSISTENCY)


def test_estimates_by_brute_force(spark):
    """Groups of 3 to 500 rows, one of them with a third of its rows far off."""
    rng = np.random.default_rng(3)
    rows, mix = [], rng.normal(size=(5, 5)) * 300
    for lang, source, n, far in (("a", "x", 500, 0.0), ("a", "y", 80, 0.2), ("a", "z", 3, 0.0), ("b", "x", 150, 0.2), ("c", "", 1, 0.0)):
        v = rng.normal(size=(n, 5)) @ mix + 5000 + 8000 * (rng.random((n, 1)) < far)
        rows += [(lang, source, *map(int, r)) for r in v]
    df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{d} long" for d in mcd_rules.DIMS))
    want = brute_estimates(np.array([r[2:] for r in rows]), np.array([r[0] for r in rows]), np.array([r[0] + "/" + r[1] for r in rows]))
    got = {r["lang"] + "/" + r["source"]: r for r in mcd_rules.estimates(df).collect()}
    assert set(got) == set(want)
    for k, (mean, root, det) in want.items():
        assert np.allclose([got[k][f"m{i}"] for i in range(5)], mean) and abs(got[k]["det"] - det) < 1e-6, k
        assert np.allclose([[got[k][f"l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)], root, atol=1e-6), k
    assert np.linalg.norm(want["b/x"][0] - 5000) < 500  # a fifth of far rows doesn't move the centre


# --- 4 ---------------------------------------------------------------------------------------------------------------


def test_chain_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words, bad, low = prose(rng, 60).split(), rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words[rng.randrange(60)] = rng.choice(["idiot", "clown", "Trash."])
        if low:
            words = [w + " buy" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(low), int(bad)))
    known = spark.createDataFrame(labels[:400] + [(5, None, 1), (None, 1, 1), (9999, 1, 1)], "doc_id long, low_quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity_chain.judge(table(spark, [*rows, (None, None), (-1, "")]), known, ["low_quality", "toxic"], "toxic").collect()}
    held = labels[400:]
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in held) >= 0.98 * len(held)
    assert sum((got[i]["p_low_quality"] > 0.5) == bool(q) for i, q, _ in held) >= 0.98 * len(held)
    assert not got[None]["toxic"] and not got[-1]["toxic"]
    none = toxicity_chain.judge(table(spark, rows[:3]), known.limit(0), ["low_quality", "toxic"], "toxic")
    assert [r["kept"] for r in none.collect()] == [True] * 3
    assert toxicity_chain.passing(table(spark, []), known, ["low_quality", "toxic"], "toxic").count() == 0


def test_a_useless_model_rejects_nothing(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40)) for i in range(300)]
    labels = spark.createDataFrame([(i, 0, int(rng.random() < 0.2)) for i in range(300)], "doc_id long, low_quality int, toxic int")
    df = table(spark, rows)
    assert toxicity_chain.passing(df, labels, ["low_quality", "toxic"], "toxic").count() == 300


def test_threshold_survives_missed_labels():
    for missed in (0.0, 0.05, 0.1, 0.12, 0.15, 0.3):
        for seed in range(20):
            rng = np.random.default_rng(seed)
            truth = rng.random(4000) < 0.11
            p = 1 / (1 + np.exp(-np.where(truth, rng.normal(3, 1, 4000), rng.normal(-3, 1, 4000))))
            rejected = p > toxicity_chain._threshold(p, (truth & (rng.random(4000) >= missed)).astype(float))
            assert rejected[truth].mean() >= 0.95 and rejected[~truth].mean() <= 0.02, (missed, seed)


def test_threshold_of_scores_without_signal_rejects_nothing():
    for share in (0.02, 0.1, 0.3, 0.5):
        for seed in range(50):
            rng = np.random.default_rng(seed)
            p, y = rng.random(4000), (rng.random(4000) < share).astype(float)
            assert toxicity_chain._threshold(p, y) == 2.0, (share, seed)


def test_chain_by_brute_force(spark):
    """Term picking, folds, fits and scores by plain Python over the same rows, some of whose ids repeat."""
    rng, m = random.Random(15), toxicity_chain
    rows, labels = [], []
    for i in range(300):
        bad, low = rng.random() < 0.3, rng.random() < 0.3
        words = [w[:3] for w in prose(rng, 12).split()] + (["Idiotically"] if bad and rng.random() < 0.9 else []) + (["buy"] if low else [])
        rows.append((i, " ".join(words)))
        labels.append((i, int(low), int(bad)))
    known = spark.createDataFrame(labels, "doc_id long, low int, toxic int")
    chain = m.train(table(spark, rows + rows[:40] * 3), known, ["low", "toxic"])
    folds = {r["id"]: r["f"] for r in spark.range(300).select("id", m._fold(F.col("id")).alias("f")).collect()}
    has = [m.terms(t) for _, t in rows]
    fold = np.array([folds[i] for i, _ in rows])

    def picked(y, use):
        n, yes, scored = int(use.sum()), int(y[use].sum()), []
        for t in sorted(set().union(*has)):
            w = np.array([t in h for h in has]) & use
            a, c = int(y[w].sum()), int(w.sum())
            cells = ((a, c, yes), (c - a, c, n - yes), (yes - a, n - c, yes), (n - yes - c + a, n - c, n - yes))
            ratio = 2 * sum(s * np.log(s * n / (r * k)) for s, r, k in cells if s > 0)
            if c >= m.MIN_ROWS and ratio >= m.MIN_RATIO:
                scored.append((-round(ratio, 9), t))
        return [t for _, t in sorted(scored)[: m.TERMS]]

    before = np.zeros((300, 0))
    for k, link in enumerate(chain.links):
        y = np.array([x[1 + k] for x in labels], float)

        def matrix(terms, before=before):
            return np.column_stack([np.array([[t in h for t in terms] for h in has], float).reshape(300, len(terms)), m._logit(before)])

        out = np.zeros(300)
        for f in range(m.FOLDS):
            x = matrix(picked(y, fold != f))
            out[fold == f] = m._predict(x[fold == f], m._fit(x[fold != f], y[fold != f]))
        terms = picked(y, np.ones(300, bool))
        w = m._fit(matrix(terms), y)
        assert list(link.terms) == terms and np.allclose(list(link.terms.values()), w[: len(terms)])
        assert np.allclose([*link.earlier, link.intercept], w[len(terms) :]) and abs(link.threshold - m._threshold(out, y)) < 1e-9 and link.state == m.FITTED
        before = np.column_stack([before, out])
    got = chain.scores([t for _, t in rows] + [None])
    for h, p in zip([*has, set()], got):
        done = []
        for link in chain.links:
            z = link.intercept + sum(w for t, w in link.terms.items() if t in h) + sum(w * m._logit(q) for w, q in zip(link.earlier, done))
            done.append(1 / (1 + np.exp(-z)))
        assert np.allclose(p, done)


def test_repeated_ids_make_one_training_row_each(spark, monkeypatch):
    sizes = []
    fit = toxicity_chain._fit
    monkeypatch.setattr(toxicity_chain, "_fit", lambda x, y: sizes.append(len(y)) or fit(x, y))
    monkeypatch.setattr(toxicity_chain, "TRAIN_ROWS", 20)
    rows = [(i, ("bad word" if i % 3 == 0 else "fine word") + f" {k}") for i in range(60) for k in range(30)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, a int")
    found = toxicity_chain.judge(table(spark, rows), labels, ["a"], "a")
    assert max(sizes) == 20 and found.count() == len(rows)


def test_a_model_that_rejects_nothing_says_so(spark):
    rows = [(i, "word") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, a int")
    assert {r["model_state"] for r in toxicity_chain.judge(table(spark, rows), labels, ["a"], "a").collect()} == {toxicity_chain.NO_SIGNAL}
    with pytest.warns(UserWarning, match="all documents pass"):
        assert toxicity_chain.passing(table(spark, rows), labels, ["a"], "a").count() == 40


def test_later_links_train_on_out_of_fold_predictions(spark, monkeypatch):
    seen = []
    fit = toxicity_chain._fit
    monkeypatch.setattr(toxicity_chain, "_fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    rows = [(i, "bad word" if i % 3 == 0 else "fine word") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(90)], "doc_id long, a int, b int")
    chain = toxicity_chain.train(table(spark, rows), labels, ["a", "b"])
    assert len(seen) == 2 * (toxicity_chain.FOLDS + 1) and len(chain.links[1].earlier) == 1


# --- 5 ---------------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(docs, hostile, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    got = rows_of(prefix_bpe.digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in hostile:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert prefix_bpe.digests(empty, path).count() == 0
    rng = random.Random(4)
    vocab = prefix_bpe.load(path)
    odd = ["<|endoftext|>a<|startoftext|>", "don't I'LL we've", "aaaaaaaaaaaaaaaa", "ﬁ ǅ Σ'S", "a\x1cb\x85c", "<|endoftext|"]
    for text in odd + ["".join(rng.choice("abcdefghij thein'.12éß中") for _ in range(30)) for _ in range(300)]:
        assert vocab.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_bpe_equals_the_library_on_all_code_points():
    """Every code point between letters, and every mark among marks that it could change places with."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    library, vocab = Tokenizer.from_file(path), prefix_bpe.load(path)
    library.no_truncation()
    library.no_padding()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    marks = [c for c in points if unicodedata.combining(c)] + [chr(c) for a, b in prefix_bpe.UNKNOWN_MARKS for c in range(a, b + 1)]
    texts = [" ".join(f"a{c}b" for c in points[k : k + 4096]) for k in range(0, len(points), 4096)]
    texts += ["|".join(f"q\u0301{c}\u0334z {c}" for c in marks[k : k + 256]) for k in range(0, len(marks), 256)]
    for text in texts:
        assert vocab.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_other_settings_are_refused(tmp_path):
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="normalizer"):
        prefix_bpe.Vocabulary(str(tmp_path / "other.json"))


# --- 6 ---------------------------------------------------------------------------------------------------------------

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base(spark, hostile, empty):
    rng = random.Random(6)
    odd = ["a@b.c.d@e.f x@y", "a@b.com_c@d.com", "1.2.3.4.5.6.7.8", "0001.02.3.255 1.2.3.256", "4111-1111-1111-1111 4111 11111111 1111", "+1 555 555 1234+44 20 7946 0958", "1" * 3000, "a" * 5000 + "@", "1-" * 2000 + "1"]
    odd += ["".join(rng.choice("a@.1234 -+()") for _ in range(60)) for _ in range(150)]
    rows = hostile + [(1000 + i, t) for i, t in enumerate(odd)]
    got = weak_pii.detect(table(spark, rows)).collect()
    want = []
    for i, t in rows:
        s = base_spans(t)
        want.append((i, *(sum(k == kind for k, _, _ in s) for kind in PII), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 10:
            text = dict(rows)[r["doc_id"]]
            assert r["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)))
    assert weak_pii.detect(empty).count() == 0


def test_secrets_are_found_and_redacted(spark):
    rng = random.Random(7)
    rows = [(i, f"{prose(rng, 30)} page {i} token = \"{rng.getrandbits(160):040x}\" tail v{i}.2 joe{i}@x.example.com") for i in range(60)]
    found = {r["doc_id"]: r["spans"] for r in weak_pii.detect(table(spark, rows)).collect()}
    for i, t in rows:
        at = t.index('"') + 1
        assert f"secret:{at}:{at + 40}" in found[i].split(","), (found[i], at)
        assert found[i].count("secret:") == 1
    df = table(spark, rows)
    clean = weak_pii.redact(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        i, t = r["doc_id"], dict(rows)[r["doc_id"]]
        at = t.index('"') + 1
        assert r["text"] == t[:at] + "[SECRET]" + t[at + 40 :].replace(f"joe{i}@x.example.com", "[EMAIL]")
    assert [r["text"] for r in weak_pii.redact(table(spark, [(1, None), (2, "")])).collect()] == [None, ""]


def test_secrets_beside_other_fields_are_found(spark):
    rng = random.Random(9)
    forms = ['{{"email":"joe{i}@x.example.com","api_key":"{k}","n":{i}}}', "ip=10.0.0.{i},token={k},page=3", "{i},joe{i}@x.example.com,{k},x", "https://x.example.com/?user=joe{i}@x.example.com&token={k}&n=2", "😀 joe{i}@x.example.com;key={k}"]
    keys = [f"ghp_{rng.getrandbits(160):040x}" for _ in range(100)]
    rows = [(i, forms[i % len(forms)].format(i=i, k=k)) for i, k in enumerate(keys)]
    found = {r["doc_id"]: r["spans"].split(",") for r in weak_pii.detect(table(spark, rows)).collect()}
    for i, t in rows:
        at = t.index(keys[i])
        assert [x for x in found[i] if x.startswith("secret:")] == [f"secret:{at}:{at + 44}"], (t, found[i])
    for r in weak_pii.redact(table(spark, rows)).collect():
        assert r["text"] == re.sub(r"joe\d+@x.example.com", "[EMAIL]", re.sub(r"10\.0\.0\.\d+", "[IP]", rows[r["doc_id"]][1].replace(keys[r["doc_id"]], "[SECRET]")))


def test_a_text_of_many_matches(spark):
    text = "é ".join(f"joe{i}@x.example.com token = ghp_{i:040x}" for i in range(20_000))
    found = weak_pii.detect(table(spark, [(1, text)])).first()
    want = [(k, a, b) for k, a, b in base_spans(text)] + [("secret", m.start(), m.end()) for m in re.finditer(r"ghp_\w+", text)]
    assert found["n_email"] == 20_000 and found["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want)
    clean = weak_pii.redact(table(spark, [(1, text)])).first()["text"]
    assert clean == " ".join(["[EMAIL] token = [SECRET]"] * 20_000)


def test_added_spans_by_brute_force(spark):
    """Candidates by a plain reading, decided by the same classifier: the spans of the method and no others."""
    rng = random.Random(14)
    forms = ["token = {k}", "page {n} of {n}", "password: {w}", "ghp_{k}", "v{n}.{n}", "DE{n}{n}370400440532013000", "id={k};x={w}", '{{"api_key":"{k}"}}']
    texts = [" ".join(rng.choice(forms).format(k=f"{rng.getrandbits(160):040x}", n=rng.randrange(10, 99), w=rng.choice(["swordfish", "hunter", "tree"])) for _ in range(12)) for _ in range(80)]
    df = table(spark, enumerate(texts))
    found = weak_pii._packed(weak_pii._found(df.select("doc_id", F.col("text").alias("t"))))
    good = set(weak_pii.accepted(weak_pii.train(found)))
    got = {r["doc_id"]: r["spans"] for r in weak_pii.detect(df).collect()}
    cut = weak_pii.CUTS.replace(r"\x20\x09-\x0D", r"\x20\x09-\x0d")
    for i, t in enumerate(texts):
        base = base_spans(t)
        free = list(t)
        for _, a, b in base:
            free[a:b] = "," * (b - a)
        runs = [(m.start(), m.end()) for m in re.finditer(f"[^{cut}]+", "".join(free))]
        want = []
        for a, b in runs:
            m, before = t[a:b].strip("([{<)]}>.!?"), t[max(0, a - 48) : a]
            asked = re.search(r"(?i)(?:^|[^a-z])(?:" + "|".join(weak_pii.ASKING) + r")[\x20\x09]*[:=\"'\x20\x09]*$", before)
            if not re.search("[0-9@]", m) and not (asked and before[-1:] in "=:\"' \t" and m.lower() not in weak_pii.ASKING):
                continue
            n, digits = len(m), len(re.sub("[^0-9]", "", m))
            bits = [n >= 12, n >= 24, 8 <= digits < 16, re.search("[A-Za-z]", m), re.fullmatch("[0-9a-fA-F]+", m), re.search("[^0-9A-Za-z_-]", m), re.search("[0-9][A-Za-z]", m) and re.search("[A-Za-z][0-9]", m), re.search(r"[:=][\x20\x09\"']*$", before)]
            if int("".join("1" if x else "0" for x in bits), 2) in good:
                want.append(("secret", a, b))
        assert got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in base + want), (t, got[i], want)


def test_runs_after_asking_words_are_candidates(spark):
    texts = ["password: correcthorsebattery", 'a "secret":"swordfish", token = secret: hidden', "joe@x.example.com,password=staple", "the monkey bars", "password: joe@x.example.com and so on", "key=QUJDREVGR0hJSktMTU5P1Q== end"]
    df = weak_pii._found(table(spark, enumerate(texts)).select("doc_id", F.col("text").alias("t")))
    got = {r["doc_id"]: [(x["m"], texts[r["doc_id"]][x["s"] : x["e"]]) for x in r["secret"]] for r in df.collect()}
    want = [["correcthorsebattery"], ["swordfish", "hidden"], ["staple"], [], [], ["QUJDREVGR0hJSktMTU5P1Q=="]]
    assert got == {i: [(w, w) for w in ws] for i, ws in enumerate(want)}


def test_expectation_maximisation_finds_reliable_labelers():
    rng = random.Random(8)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = [int(truth == (rng.random() < a)) if rng.random() < 0.9 else 2 for a in (0.95, 0.9, 0.85, 0.6, 0.9, 0.7, 0.8)]
        code = 0
        for v in votes:
            code = code * 3 + v
        counts[code] = counts.get(code, 0) + 1
    prior, tables, _ = weak_pii.reliabilities(counts)
    assert abs(prior - 0.3) < 0.05
    right = [t[1][1] / (t[1][0] + t[1][1]) for t in tables]
    assert right[0] > 0.9 and right[3] < 0.7


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_packing(spark, docs, hostile, empty):
    small = (64, 128, 256)
    got = best_fit.pack_documents(docs, capacities=small).collect()
    want = {}
    for i, t in hostile:
        n = len((t or "").encode())
        want.setdefault(i, []).append(n)
    assert sum(r["length"] for r in got) == sum(map(sum, want.values()))
    for i, sizes in want.items():
        assert sum(r["length"] for r in got if r["doc_id"] == i) == sum(sizes)
    bins = {}
    for r in got:
        bins.setdefault((r["bin"], r["capacity"]), []).append((r["offset"], r["length"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), placed in bins.items():
        placed.sort()
        assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(placed))
        total = sum(n for _, n in placed)
        assert capacity == min(c for c in small if c >= total)  # downsized
    assert best_fit.pack_documents(empty).count() == 0


def test_pack_takes_the_tightest_bin():
    placed = best_fit.pack([200, 120, 56, 100, 28, 8], (128, 256))
    assert placed[0][:2] == placed[2][:2] and placed[2][2] == 200  # 56 fills up the bin of 200
    assert placed[1][0] != placed[0][0] and placed[5][:2] == placed[1][:2]  # 8 goes where 8 are left
    rng = random.Random(9)
    sizes = [rng.randrange(1, 2000) for _ in range(1500)]
    used = {b: c for b, c, _ in best_fit.pack(sizes)}
    assert sum(sizes) / sum(used.values()) > 0.97


def test_pack_weighs_capacities():
    def cost(sizes):
        return sum(best_fit.bin_cost(c) for c in {b: c for b, c, _ in best_fit.pack(sizes)}.values())

    # Just above a capacity: three, or a few of the next, share a larger bin at less than a bin each.
    assert {c for _, c, _ in best_fit.pack([5000] * 300)} == {16384} and cost([5000] * 300) == 100 * best_fit.bin_cost(16384)
    for capacity in best_fit.CAPACITIES[:-2]:
        for extra in (1, 50, capacity // 4):
            alone = best_fit.bin_cost(2 * capacity)
            assert cost([capacity + extra] * 240) < 240 * alone, (capacity, extra)
    # The last bin gets what is left and is downsized.
    assert [c for _, c, _ in best_fit.pack([5000] * 4)] == [16384] * 3 + [8192]
    assert [c for _, c, _ in best_fit.pack([2000] * 3)] == [2048] * 3


def plain_pack(sizes, capacities):
    """The packing rule by lists: longest first, the tightest open bin, else the capacity that costs least a token on trial."""
    order, left, bins, where = sorted(range(len(sizes)), key=lambda i: -sizes[i]), None, [], {}
    for at, i in enumerate(order):
        left = [sizes[j] for j in order[at:]]
        fits = [(room, b) for b, (room, _) in enumerate(bins) if room >= sizes[i] and room]
        if not fits:
            options = []
            for c in capacities:
                if c >= sizes[i]:
                    holds = 0
                    for n in left:
                        holds += n if holds + n <= c else 0
                    options.append((best_fit.bin_cost(min(x for x in capacities if x >= holds)) / holds, c))
            bins.append([min(options)[1], 0])
            fits = [(bins[-1][0], len(bins) - 1)]
        b = min(fits)[1]
        where[i] = (b, bins[b][1])
        bins[b][0] -= sizes[i]
        bins[b][1] += sizes[i]
    return [(where[i][0], min(c for c in capacities if c >= bins[where[i][0]][1]), where[i][1]) for i in range(len(sizes))]


def test_pack_by_brute_force():
    rng = random.Random(16)
    for most, capacities in ((200, (64, 128, 256)), (5000, best_fit.CAPACITIES), (60, (60,)), (9, (4, 10, 11))):
        for _ in range(20):
            sizes = [rng.randrange(1, min(most, max(capacities)) + 1) for _ in range(rng.randrange(1, 120))]
            assert best_fit.pack(sizes, capacities) == plain_pack(sizes, capacities)


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(best_fit, "TOGETHER", 7)
    got = best_fit.pack_documents(table(spark, [(1, "abc")] * 50 + [(2, "de")]), capacities=(8, 16)).collect()
    assert len(got) == 51 and sum(r["length"] for r in got) == 152
    assert len({(r["bin"], r["offset"]) for r in got}) == 51


# --- 8 ---------------------------------------------------------------------------------------------------------------


def test_licenses(docs, hostile, empty):
    got = {}
    for r in license_index.judge(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))
    for i, t in hostile:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        found, labels = [], set()
        for phrase, label in license_index.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            found += at
            labels |= {label} if at else set()
        assert (len(words), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))) in got[i], t
    assert license_index.judge(empty).count() == 0


def test_license_templates(spark):
    notices = {k: " ".join(["filler"] * k) + " " + t.upper() + "! more" for k, (_, t, _) in enumerate(license_index.TEMPLATES)}
    got = {r["doc_id"]: r for r in license_index.judge(table(spark, [*notices.items(), (99, "license of the use"), (98, "The attribution of a work is licensed")])).collect()}
    for k, (label, _, _) in enumerate(license_index.TEMPLATES):
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1.0, (k, got[k])
    assert got[99]["labels"] == "" and got[98]["labels"] == ""


def test_every_notice_of_a_file_is_found(spark):
    rng = random.Random(8)
    notices = [t for _, t, _ in license_index.TEMPLATES]
    texts = [notices[1] + " All rights reserved.", "Licensed under CC BY-NC 4.0. " + notices[1], " ... ".join(notices), "license " * 3000 + "all rights reserved"]
    texts += [" and then ".join(w for n in rng.sample(notices, 4) for w in [" ".join(x for x in n.split() if rng.random() < 0.95)]) for _ in range(30)]
    got = {r["doc_id"]: r for r in license_index.judge(table(spark, [*enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        words, labels, score = re.findall(r"[0-9a-z]+", text.lower()), set(), 0.0
        labels |= {label for phrase, label in license_index.PHRASES.items() if f" {phrase} " in f" {' '.join(words)} "}
        for label, notice, keys in license_index.TEMPLATES:
            t = notice.split()
            for at in range(-len(t), len(words)):
                same = [0 <= at + p < len(words) and words[at + p] == w for p, w in enumerate(t)]
                near = [w in words[max(0, at + p - license_index.DRIFT) : max(0, at + p + license_index.DRIFT + 1)] for p, w in enumerate(t)]
                spans = [(a, len(k.split())) for k in keys for a in range(len(t)) if t[a : a + len(k.split())] == k.split()]
                if any(all(same[a : a + n]) for a, n in spans):
                    score = max(score, sum(near) / len(t))
                    labels |= {label} if sum(near) / len(t) >= license_index.MIN_SCORE else set()
        assert (got[i]["labels"], got[i]["score"]) == (",".join(sorted(labels)), score), text
    put_in = {r["doc_id"]: r["labels"] for r in license_index.judge(table(spark, [(0, notices[6].replace("without modification", "without any modification")), (1, notices[1].replace("free of charge ", ""))])).collect()}
    assert put_in == {0: "bsd", 1: "mit"}
    assert got[0]["labels"] == "mit,reserved" and got[1]["labels"] == "cc-by-nc,mit"


# --- 9 ---------------------------------------------------------------------------------------------------------------


def test_flac_round_trip(docs, hostile, empty):
    media = flac.store(docs).cache()
    got = rows_of(flac.read_back(media), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t in hostile:
        data = (t or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        want.append((i, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert got == sorted(want, key=str)
    first = media.where("doc_id = 8").first()
    found = flac.pcm_blocks(media.where("doc_id = 8")).orderBy("block").collect()
    assert [r["sample_offset"] for r in found] == [flac.BLOCK * k for k in range(len(found))]
    data = bytes(first["media"])
    for r in found:  # a block can be read from its byte offset alone
        stream = flac.Stream(data)
        samples, _, _ = flac._decoded(np.frombuffer(data[r["byte_offset"] :], np.uint8), [0], [stream.block], [stream.bits])
        assert samples[0].astype(np.int8).tobytes() == bytes(r["pcm"])
    assert flac.read_back(flac.store(empty)).count() == 0


def test_flac_stored_table_is_small(spark, monkeypatch):
    """What the query stores takes at most 1.5 times what the documents take, and holds every text."""
    sf_dir, tables = "/root/testdata/sf0.01", []

    def kept(df, name, **options):
        tables.append(written(df, name, **options))
        return tables[-1]

    monkeypatch.setattr(queries, "written", kept)
    got = rows_of(queries.op9_flac(spark, sf_dir), "doc_id", "n_bytes", "payload_sha256", "media_bytes", "media_sha256")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = []
    for r in documents:
        n, data = flac.payload(r["text"])
        (media,) = flac.encode([data])
        want.append((r["doc_id"], n, hashlib.sha256(data).hexdigest(), len(media), hashlib.sha256(media).hexdigest()))
    assert got == sorted(want, key=str)
    (media,) = tables
    stored = sum(f.stat().st_size for f in Path(media.written_path).glob("*.parquet"))
    assert stored <= 1.5 * Path(sf_dir, "documents.parquet").stat().st_size


def test_flac_damage_is_seen():
    rng = random.Random(10)
    payload = bytes(rng.choices(b"etaoin shrdlu", k=4096))
    (media,) = flac.encode([payload])
    assert flac.decode([media]) == [payload] and len(media) < len(payload)
    first = flac.Stream(media).first
    for _ in range(60):
        bad = bytearray(media)
        bad[rng.randrange(first, len(bad))] ^= 1 << rng.randrange(8)
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


class Bits:
    def __init__(self):
        self.s = ""

    def put(self, value, width):
        self.s += format(value & ((1 << width) - 1), f"0{width}b")

    def rice(self, value, k):
        u = value * 2 if value >= 0 else -value * 2 - 1
        self.s += "0" * (u >> k) + "1"
        if k:
            self.put(u, k)

    def data(self):
        s = self.s + "0" * (-len(self.s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8))


def test_flac_linear_predictors_and_partitions():
    """A stream by hand: order 2 with quantised coefficients, four partitions, no seek table."""
    n, order, shift, coefs = 192, 2, 3, [15, -8]
    samples = [int(90 * np.sin(t / 9)) for t in range(n)]
    b = Bits()
    b.put((32 + order - 1) << 1, 8)
    for s in samples[:order]:
        b.put(s, 8)
    b.put(5, 4)
    b.put(shift, 5)
    for c in coefs:
        b.put(c, 6)
    b.put(0, 2)
    b.put(2, 4)
    for t in range(order, n):
        if t == order or t % (n >> 2) == 0:
            k = 1 + t // (n >> 2)
            b.put(k, 4)
        guess = sum(c * samples[t - 1 - j] for j, c in enumerate(coefs)) >> shift
        b.rice(samples[t] - guess, k)
    frame = flac._header(0, n) + b.data()
    buf = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16(buf, np.array([0]), np.array([len(buf)]))[0]).to_bytes(2, "big")
    signed = np.array(samples, np.int8).tobytes()
    info = (1024).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(signed).digest()
    stream = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + frame
    assert flac.decode([stream]) == [(np.array(samples, np.int8).view(np.uint8) ^ 0x80).tobytes()]


def test_flac_plain_partitions_and_wasted_bits():
    """A stream by hand: one wasted bit, a Rice partition and two plain ones, of 5 bits and of none."""
    n = 192
    samples = [2 * (t % 13 - 6) if t < 128 else 0 for t in range(n)]
    b = Bits()
    b.put(8 << 1 | 1, 8)  # fixed predictor of order 0, wasted bits
    b.put(1, 1)  # one of them
    b.put(0, 2)
    b.put(2, 4)  # four partitions
    for part in range(4):
        own = [s >> 1 for s in samples[part * 48 : part * 48 + 48]]
        if part in (0, 3):
            b.put(2, 4)
            for s in own:
                b.rice(s, 2)
        else:
            b.put(15, 4)
            b.put(5 if any(own) else 0, 5)
            for s in own:
                if any(own):
                    b.put(s, 5)
    frame = flac._header(0, n) + b.data()
    buf = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16(buf, np.array([0]), np.array([len(buf)]))[0]).to_bytes(2, "big")
    signed = np.array(samples, np.int8).tobytes()
    info = (1024).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(signed).digest()
    stream = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + frame
    assert flac.decode([stream]) == [(np.array(samples, np.int8).view(np.uint8) ^ 0x80).tobytes()]


def test_flac_sparse_seek_points_and_bad_streams(spark, monkeypatch):
    monkeypatch.setattr(flac, "MOST_SEEK", 18 * 3)
    payload = bytes(range(256)) * 64
    (media,) = flac.encode([payload])
    assert 0 < len(flac.Stream(media).points) <= 3 and flac.decode([media]) == [payload]
    rows = spark.createDataFrame([(1, 5, bytearray(media)), (2, 5, bytearray(media[:-9])), (3, 5, bytearray(b"RIFF")), (4, None, None)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in flac.read_back(rows).collect()}
    assert got[1]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and got[1]["error"] is None and len(got[1]["block_offsets"]) == 16
    assert all(got[i]["error"] and got[i]["payload_sha256"] is None for i in (2, 3, 4))


# --- 10 --------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        low = min(ids, default=None) if sets[k] else i
        out.append((i, len(sets[k]), low, i == low))
    return sorted(out, key=str)


def near_copies(rng, n, words, most):
    base = prose(rng, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(words)] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_by_brute_force(spark, hostile, empty):
    rng = random.Random(11)
    texts = near_copies(rng, 120, 150, 9) + near_copies(rng, 30, 60, 4) + near_copies(rng, 40, 300, 20)
    rows = hostile + [(2000 + i, t) for i, t in enumerate(texts)]
    got = rows_of(minmax_dedup.near_duplicates(table(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components(rows)
    assert minmax_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_long_texts(spark):
    """Batches of more text than is worked on at a time."""
    rng = random.Random(21)
    texts = [" ".join(rng.choice(["alpha", "Bété", "漢字", "zéta"]) + str(rng.randrange(10**6)) for _ in range(9000)) for _ in range(90)]
    texts += [texts[3], texts[50].upper().replace("É", "é"), texts[40].replace("Bété1", "changed")]
    rows = list(enumerate(texts))
    assert sum(len((t or "").encode()) for t in texts) > 2 * (4 << 20)
    got = rows_of(minmax_dedup.near_duplicates(table(spark, rows).coalesce(1)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components(rows)


def test_near_duplicates_at_the_least_similarity(spark):
    """Pairs of 3 and 4 shingles; of these, 40 bands of 5 values left two pairs apart."""
    starts = [18615, 381635, *range(200)]
    rows = [(2 * k + d, " ".join(f"w{i}x{n}" for n in range(7 + d))) for k, i in enumerate(starts) for d in (0, 1)]
    got = rows_of(minmax_dedup.near_duplicates(table(spark, rows)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(i, 3 + i % 2, i - i % 2, i % 2 == 0) for i, _ in rows], key=str)


def test_bands_agree_as_often_as_their_values():
    rng = np.random.default_rng(22)
    whole = rng.integers(0, 2**64, (20000, 8), dtype=np.uint64)
    pairs = [minmax_dedup.band_hashes(list(x)) for x in (whole[:, :7], whole[:, 1:])]
    agree = (pairs[0] == pairs[1]).mean(axis=0)
    assert len(agree) == minmax_dedup.BANDS and np.abs(agree - 0.75**minmax_dedup.BAND_ROWS).max() < 0.02
    assert (pairs[0] == pairs[1]).any(axis=1).all()


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(12)
    rows = list(enumerate([*near_copies(rng, 10, 200, 2), *[prose(rng, 100) for _ in range(5)], None, ""]))
    df = table(spark, rows)
    kept = minmax_dedup.passing(df)
    low = {c for _, _, c, _ in brute_components(rows)}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == low


def test_min_and_max_agree_as_often_as_sets():
    rng = np.random.default_rng(13)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[100:])
    real, values = 200 / 400, []
    for f in minmax_dedup._multipliers():
        values += [(a * f).min() == (b * f).min(), (a * f).max() == (b * f).max()]
    assert abs(np.mean(values) - real) < 0.12
