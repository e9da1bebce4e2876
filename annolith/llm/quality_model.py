"""Quality classifier: a sparse rule ensemble.

1. Statistics of every whole text, as Spark expressions.
2. On a bounded sample of labelled training rows: shallow trees over random
   features and bootstrap rows; each path from a root to a node is a
   conjunctive rule.
3. Lasso logistic regression over the rules leaves a sparse weighting.
4. The rules that remain are compiled into one Spark column expression that
   scores every document.

Rows whose crc32(doc_id as text) mod 3 is 1 are held out: never learned from.
Labels, lang, source and doc_id are no inputs of a score.

Edge cases: null and empty texts have zero statistics and a score like any
other; without labels of both kinds the score is the smoothed share of label 1; labels of null doc_ids, and
labels null or repeated with both values, are not learned from; repeated rows score alike; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, staged
from .quality_rules import statistics

#: Labelled rows that are learned from, at most.
TRAINING_ROWS = 20_000
TREES, TREE_DEPTH, BINS = 40, 3, 24
PENALTY = 0.002
SEED = 7


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics that rules may test, each a double."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = statistics(docs.select("doc_id", "text"))
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    lines = F.greatest(count("\n") + 1, F.lit(1))
    named = {
        "words": F.col("n_words"),
        "word_length": F.col("word_chars") / n,
        "symbols": F.col("n_symbols") / n,
        "pipes": count(r"\|") / n,
        "exclaimed": count("!!") / n,
        "capitals": count("[A-Z]") / chars,
        "digits": count("[0-9]") / chars,
        "stops": count("[.,]") / n,
        "line_words": F.col("n_words") / lines,
        "repeated_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / n,
        "distinct_words": F.size(F.array_distinct("__w")) / n,
    }
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.cast("double").alias(k) for k, c in named.items()))


FEATURES = ("words", "word_length", "symbols", "pipes", "exclaimed", "capitals", "digits", "stops", "line_words", "repeated_lines", "repeated_words", "distinct_words")


@dataclass(frozen=True)
class Model:
    """rules: conjunctions of (feature, is_above, cut); one weight each, and a bias."""

    rules: tuple[tuple[tuple[str, bool, float], ...], ...]
    weights: tuple[float, ...]
    bias: float


def _paths(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, depth: int, path: tuple = ()) -> list[tuple]:
    """Paths of a tree grown by Gini gain over a random half of the features."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return []
    best = (1e-9, None, None)
    p = y.mean()
    for f in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]:
        for c in cuts[f]:
            above = x[:, f] > c
            k = int(above.sum())
            if 5 <= k <= len(y) - 5:
                pa, pb = y[above].mean(), y[~above].mean()
                gain = p * (1 - p) - (k * pa * (1 - pa) + (len(y) - k) * pb * (1 - pb)) / len(y)
                best = max(best, (gain, int(f), float(c)), key=lambda b: b[0])
    _, f, c = best
    if f is None:
        return []
    out = []
    for side in (True, False):
        here = (x[:, f] > c) == side
        longer = (*path, (f, side, c))
        out += [longer, *_paths(x[here], y[here], cuts, rng, depth - 1, longer)]
    return out


def _covers(rule: tuple, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, above, c in rule:
        hit &= (x[:, f] > c) == above
    return hit


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an l1 penalty by accelerated proximal gradients; the bias is free."""
    n, k = r.shape
    w = z = np.zeros(k + 1)
    full = np.column_stack([r, np.ones(n)])
    rate = 4 * n / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    t = 1.0
    for _ in range(steps):
        grad = full.T @ (1 / (1 + np.exp(-np.clip(full @ z, -30, 30))) - y) / n
        new = z - rate * grad
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:k], float(w[k])


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, seed: int = SEED) -> Model:
    """Trees, rules and weights from a sample; the same sample gives the same model."""
    if len(y) < 20 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model((), (), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, BINS))) for f in range(x.shape[1])]
    rules: dict[tuple, None] = {}
    for _ in range(TREES):
        rows = rng.integers(0, len(y), min(len(y), 4000))
        rules |= dict.fromkeys(_paths(x[rows], y[rows], cuts, rng, TREE_DEPTH))
    columns, kept, seen = [], [], set()
    for rule in rules:
        hit = _covers(rule, x)
        mark = hit.tobytes()
        if 5 <= hit.sum() <= len(y) - 5 and mark not in seen:
            seen.add(mark)
            columns.append(hit)
            kept.append(rule)
    weights, bias = _lasso(np.column_stack(columns).astype(float), y.astype(float), PENALTY)
    live = np.flatnonzero(np.abs(weights) > 1e-6)
    return Model(
        tuple(tuple((names[f], above, c) for f, above, c in kept[k]) for k in live), tuple(float(weights[k]) for k in live), bias
    )


def compiled(model: Model) -> Column:
    """The score between 0 and 1 as a column over the features."""
    total = F.lit(model.bias)
    for rule, weight in zip(model.rules, model.weights, strict=True):
        holds = F.lit(True)
        for name, above, cut in rule:
            holds = holds & (F.col(name) > cut if above else F.col(name) <= cut)
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def train(table: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """table: doc_id and features. The sample is the labelled training rows of the smallest hashes."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("__q"), F.max("quality").alias("__q2"))
    known = bounded_sample(known.filter("__q = __q2").filter(~held_out()).select("doc_id", F.col("__q").cast("double").alias("__y")), "doc_id", rows)
    sample = table.join(F.broadcast(known), "doc_id").orderBy("doc_id", *FEATURES).limit(rows).select("__y", *FEATURES).toPandas()
    return fit(sample[list(FEATURES)].to_numpy(float), sample["__y"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    table = staged(features(docs), "text-statistics")
    model = train(table, labels)
    scored = table.select("doc_id", held_out().alias("held_out"), compiled(model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
