"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model gets, besides the words of a text, the
probabilities of the categories before it. For training these are out-of-fold predictions, so that
a later model doesn't lean on what an earlier one has learnt by heart.

The models are fitted on at most TRAIN_ROWS labelled documents, one row of each, taken in the order of a hash of
their ids; all rows are scored over their whole texts. A model's terms are the words and word beginnings that
differ most between the two classes, TERMS of each category at most (a size of the model, like its form); the
models of the folds pick theirs without the rows that they predict. The threshold of each category is the
one that does best out of fold while rejections are clearly likelier in the category than outside it.
That is a comparison with the base rate, so labels that miss part of a category don't rule it out.

Each model says in its state whether it is fitted, has one class only, or can't tell the classes apart; where
that leaves the verdict without a threshold, judge() shows it in each row and passing() warns.

Hostile cases: a null or blank text has no terms and gets the base rate; null labels and labels
without a document aren't used; of a document's repeated labels the highest counts, and of its rows the one
whose text's hash is greatest; without both classes a category's probability is its base rate and nothing
is rejected; repeated rows give repeated rows; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import re
import warnings
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.shared import forget, small_batches, written

TRAIN_ROWS = 20_000
TERMS = 192
#: Rows of either class that a term must be in.
MIN_ROWS = 5
#: Least log-likelihood ratio of a term and a category: about four standard errors.
MIN_RATIO = 16.0
#: Letters of a word's beginning.
BEGINNING = 5
FOLDS = 5
#: How many times likelier a rejection out of fold must be in the category than outside it; a model that can't reach it,
#: or reaches it on too few rows for MIN_RATIO, rejects nothing.
MIN_LIFT = 4.0
PENALTY = 1.0
NEWTON_ROUNDS = 12

#: States of a link.
FITTED, ONE_CLASS, NO_SIGNAL = "fitted", "one class only", "rejects nothing: no threshold tells the classes apart"

_words = re.compile(r"\w+")


def terms(text: str | None) -> set[str]:
    """The distinct words of a text and the beginnings of its longer words."""
    words = set(_words.findall((text or "").lower()))
    return words | {w[:BEGINNING] + "*" for w in words if len(w) > BEGINNING}


@dataclass
class Link:
    """One model of the chain: category, its terms and weights, and the weights of earlier categories."""

    category: str
    terms: dict[str, float]
    earlier: list[float]
    intercept: float
    threshold: float
    state: str = FITTED


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """A row of probabilities for each text: a product of which terms it has and their weights, link by link."""
        index = {t: k for k, t in enumerate(dict.fromkeys(t for link in self.links for t in link.terms))}
        has = [[index[t] for t in terms(text) & index.keys()] for text in texts]
        rows = np.repeat(np.arange(len(texts)), np.array([len(h) for h in has], np.int64))
        columns = np.array([k for h in has for k in h], np.int64)
        out = np.zeros((len(texts), len(self.links)))
        for n, link in enumerate(self.links):
            weights = np.zeros(len(index) + 1)
            weights[np.array([index[t] for t in link.terms], np.int64)] = list(link.terms.values())
            z = link.intercept + np.bincount(rows, weights[columns], len(texts))
            out[:, n] = 1 / (1 + np.exp(-np.clip(z + _logit(out[:, :n]) @ np.array(link.earlier[:n], float), -35, 35)))
        return out


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression, the intercept last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 1e-6
    w[-1] = _logit(y.mean())
    for _ in range(NEWTON_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (p - y) + ridge * w
        if np.abs(grad).max() < 1e-4:
            break
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.linalg.solve(hess, grad)
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))


def _dependence(hit: np.ndarray, taken: np.ndarray, yes: float, total: int) -> np.ndarray:
    """The log-likelihood ratio of rejections and category being independent."""
    share = np.zeros(len(hit))
    for seen, row, column in ((hit, taken, yes), (taken - hit, taken, total - yes), (yes - hit, total - taken, yes), (total - yes - taken + hit, total - taken, total - yes)):
        some = seen > 0
        share[some] += seen[some] * np.log(seen[some] * total / (row[some] * column))
    return 2 * share


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of the best F1 with MIN_LIFT and MIN_RATIO, midway to the next prediction; beyond all if there is none."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    taken = np.arange(1, len(p) + 1)
    yes, no = y.sum(), len(p) - y.sum()
    f1 = 2 * hit / (taken + yes)
    ends = np.append(p[order][1:] != p[order][:-1], True) & (hit * no >= MIN_LIFT * (taken - hit) * yes)
    ends &= _dependence(hit, taken, yes, len(p)) >= MIN_RATIO
    if not ends.any():
        return 2.0
    k = int(np.argmax(np.where(ends, f1, -1)))
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + low) / 2)


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(FOLDS)), F.lit(FOLDS)).cast("int")


def _counts(categories: list[str]):
    """term, fold, and how many rows of the fold have it: of all, and of each category."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0] * (1 + len(categories)))
            labels = list(zip(*[batch.column(c).to_pylist() for c in categories]))
            for text, fold, ys in zip(batch.column("text"), batch.column("fold").to_pylist(), labels):
                for t in terms(text.as_py()):
                    s = sums[t, fold]
                    s[0] += 1
                    for k, y in enumerate(ys):
                        s[1 + k] += y
            columns = [pa.array([t for t, _ in sums], pa.string()), pa.array([f for _, f in sums], pa.int32()), *[pa.array([s[k] for s in sums.values()], pa.int64()) for k in range(1 + len(categories))]]
            yield pa.RecordBatch.from_arrays(columns, ["term", "fold", "n", *categories])

    return run


def _rows(categories: list[str], index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [sorted(index[t] for t in terms(x.as_py()) & index.keys()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), *[batch.column(c) for c in categories], pa.array(has, pa.list_(pa.int32()))], ["doc_id", "fold", *categories, "has"])

    return run


def _ratio(both: Column, with_term: Column, in_class: Column, total: Column) -> Column:
    """The log-likelihood ratio of term and class being independent, from how many rows have both, the term or the class."""
    share = F.lit(0.0)
    for seen, row, column in (
        (both, with_term, in_class),
        (with_term - both, with_term, total - in_class),
        (in_class - both, total - with_term, in_class),
        (total - in_class - with_term + both, total - with_term, total - in_class),
    ):
        share = share + F.when(seen > 0, seen * F.log(F.try_divide(seen * total, row * column))).otherwise(0.0)
    return 2 * share


#: Stands for no fold: terms picked from all rows.
ALL = -1


def _picked(sample: DataFrame, categories: list[str]) -> dict[tuple[str, int], list[str]]:
    """The terms for each category and fold, picked from the rows outside of the fold (ALL: from all); TERMS of each come to the driver."""
    fields = "term string, fold int, n long, " + ", ".join(f"`{c}` long" for c in categories)
    measures = ("n", *categories)
    totals = sample.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in categories]).collect()  # a row for each fold
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(m)).otherwise(0)).alias(f"{m}_{f}") for m in measures for f in range(FOLDS)]
    counts = sample.mapInArrow(_counts(categories), fields).groupBy("term").agg(*[F.sum(m).alias(f"{m}_{ALL}") for m in measures], *by_fold)
    # Counts of the rows outside of each fold first, and then one ratio for each.
    options = []
    for fold in (ALL, *range(FOLDS)):
        own = {m: sum(r[m] for r in totals if r["fold"] != fold) for m in measures}
        left = {m: F.col(f"{m}_{ALL}") - (F.col(f"{m}_{fold}") if fold != ALL else F.lit(0)) for m in measures}
        for c in categories:
            options.append(F.struct(F.lit(c).alias("category"), F.lit(fold).alias("without"), left[c].alias("both"), left["n"].alias("has"), F.lit(own[c]).alias("yes"), F.lit(own["n"]).alias("rows")))
    rows = counts.where(F.col(f"n_{ALL}") >= MIN_ROWS).select("term", F.explode(F.array(*options)).alias("o")).select("term", "o.*").where(F.col("has") >= MIN_ROWS)
    rows = rows.withColumn("ratio", _ratio(F.col("both"), F.col("has"), F.col("yes"), F.col("rows"))).where(F.col("ratio") >= MIN_RATIO)
    order = Window.partitionBy("category", "without").orderBy(F.desc("ratio"), "term")
    best = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= TERMS).collect()
    found: dict[tuple[str, int], list[str]] = {(c, f): [] for c in categories for f in (ALL, *range(FOLDS))}
    for r in sorted(best, key=lambda r: r["place"]):
        found[r["category"], r["without"]].append(r["term"])
    return found


def train(docs: DataFrame, labels: DataFrame, categories: list[str]) -> Chain:
    """A chain over 0/1 label columns, in their order, from docs (doc_id, text) and labels (doc_id, categories)."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    chosen = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most TRAIN_ROWS short rows are broadcast. Ids are counted first, so that only texts whose ids repeat are shuffled to
    # keep one of each, however many there are.
    times = texts.select("doc_id").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *categories).agg(F.count(F.lit(1)).alias("times"))
    there = texts.join(F.broadcast(written(times, "chosen")), "doc_id")
    row = F.max(F.struct(F.xxhash64("text").alias("hash"), "text"))
    again = there.where("times > 1").groupBy("doc_id", *categories).agg(row.alias("row")).select("doc_id", *categories, "row.text")
    sample = there.where("times = 1").select("doc_id", *categories, "text").unionByName(again)
    sample = written(sample.select("doc_id", _fold(F.col("doc_id")).alias("fold"), *categories, "text"), "labelled")
    if not sample.limit(1).count():
        return Chain([Link(c, {}, [0.0] * k, -35.0, 2.0, ONE_CLASS) for k, c in enumerate(categories)])
    picked = _picked(sample, categories)
    index = {t: k for k, t in enumerate(dict.fromkeys(t for ts in picked.values() for t in ts))}
    fields = "doc_id long, fold int, " + ", ".join(f"`{c}` int" for c in categories) + ", has array<int>"
    # At most TRAIN_ROWS rows of the places of picked terms.
    rows = sorted(sample.mapInArrow(_rows(categories, index), fields).collect(), key=lambda r: r["doc_id"])
    forget(sample)
    x = np.zeros((len(rows), len(index)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["has"]] = 1
    fold = np.array([r["fold"] for r in rows])
    chain, before = Chain(), np.zeros((len(rows), 0))
    for c in categories:
        y = np.array([r[c] for r in rows], float)
        if y.min() == y.max():
            chain.links.append(Link(c, {}, [0.0] * before.shape[1], float(_logit(y.mean())), 2.0, ONE_CLASS))
            before = np.column_stack([before, np.full(len(rows), y.mean())])
            continue

        def matrix(without: int, c: str = c) -> np.ndarray:
            return np.column_stack([x[:, [index[t] for t in picked[c, without]]], _logit(before)])

        out = np.full(len(rows), y.mean())
        for k in range(FOLDS):
            here = fold == k
            if here.any() and 0 < y[~here].sum() < (~here).sum():
                m = matrix(k)
                out[here] = _predict(m[here], _fit(m[~here], y[~here]))
        own = picked[c, ALL]
        w = _fit(matrix(ALL), y)
        threshold = _threshold(out, y)
        chain.links.append(Link(c, {t: float(v) for t, v in zip(own, w)}, [float(v) for v in w[len(own) : -1]], float(w[-1]), threshold, FITTED if threshold <= 1 else NO_SIGNAL))
        before = np.column_stack([before, out])
    return chain


def _scorer(chain: Chain, verdict: str):
    last = next(k for k, link in enumerate(chain.links) if link.category == verdict)

    def run(texts: pa.Array) -> pa.Array:
        scored = chain.scores(texts.to_pylist())
        fields = {link.category: pa.array(scored[:, k], pa.float64()) for k, link in enumerate(chain.links)}
        fields["__rejected"] = pa.array(scored[:, last] > chain.links[last].threshold, pa.bool_())
        return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))

    return run


def scores(spark: SparkSession, chain: Chain, text: Column, verdict: str) -> Column:
    """A struct of each category's probability and __rejected, by the verdict category's threshold."""
    small_batches(spark)
    kind = "struct<" + ",".join(f"`{x.category}`:double" for x in chain.links) + ",`__rejected`:boolean>"
    return F.arrow_udf(_scorer(chain, verdict), kind)(text.cast("string"))


def _state(chain: Chain, verdict: str) -> str:
    return next(link.state for link in chain.links if link.category == verdict)


def judge(docs: DataFrame, labels: DataFrame, categories: list[str], verdict: str) -> DataFrame:
    """doc_id, p_ of each category, the verdict category as a boolean, kept, and the verdict's model_state, of each row of docs."""
    chain = train(docs, labels, categories)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scores(docs.sparkSession, chain, F.col("text"), verdict).alias("s"))
    rejected = F.col("s.__rejected")
    return scored.select("doc_id", *[F.col("s")[c].alias(f"p_{c}") for c in categories], rejected.alias(verdict), (~rejected).alias("kept"), F.lit(_state(chain, verdict)).alias("model_state"))


def passing(docs: DataFrame, labels: DataFrame, categories: list[str], verdict: str) -> DataFrame:
    """The rows of docs that are kept, as they are."""
    chain = train(docs, labels, categories)
    if _state(chain, verdict) != FITTED:
        warnings.warn(f"all documents pass the model of {verdict}: {_state(chain, verdict)}", stacklevel=2)
    return docs.where(~scores(docs.sparkSession, chain, F.col("text"), verdict)["__rejected"])
