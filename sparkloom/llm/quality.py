"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are fitted one after another to the residuals of a boosted logistic model over a bounded sample of labelled
rows; every path from a root becomes a rule, a conjunction of thresholds; a logistic model with lasso penalty over the
rules keeps a few dozen of them; and these are compiled into one Spark column expression. The statistics of a text (shares
of character kinds, word lengths, repetition) are computed in array steps over whole texts; language, source, id and labels
are no inputs.

``SAMPLE`` bounds the labelled rows that are fitted on, taken in the order of a hash of the id; a row whose crc32 of the id
leaves ``HELD_OUT`` modulo ``FOLDS`` is never fitted on. Everything else covers all rows.

Cases: a null or empty text has all statistics 0 and a score like any other; a null id is scored, and its crc32 is that of
the empty text; repeated labels of an id are averaged; a null label is left out; with labels of one kind or none, every
score is the share of label 1, or 1 without any; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import words as W
from sparkloom.llm.common import arrow_map, flat, fresh, table

FOLDS, HELD_OUT = 4, 2
SAMPLE = 10_000
KEEP_FROM = 0.7
TREES, DEPTH, LEAST_LEAF, SHRINK = 24, 3, 20, 0.3
PENALTY, STEPS = 1e-3, 400

STATISTICS = ("chars", "words", "word_length", "distinct_words", "top_word", "repeated_words", "letters", "upper", "digits", "symbols", "bangs", "bars", "periods", "lines", "longest_word")


def _kind(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


UPPER = _kind(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = UPPER | _kind(b"abcdefghijklmnopqrstuvwxyz") | (W.ALL >= 0xC2)
DIGIT = _kind(b"0123456789")
SYMBOL = _kind(b"#$%&*@^~<>{}[]\\_=+")


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, STATISTICS) of the UTF-8 texts that ``at`` cuts out of ``raw``."""
    n = len(at) - 1

    def count(member: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(member, dtype=np.int64)))
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    chars = count((raw & 0xC0) != 0x80)
    starts, stops, first = W.find(raw, at, W.NOT_SPACE)
    n_words = np.diff(first).astype(float)
    hashed = W.hashes(raw, starts, stops)
    owner = np.repeat(np.arange(n), np.diff(first))
    size = stops - starts
    longest, top, distinct, repeated = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    if len(hashed):
        some = n_words > 0
        longest[some] = np.maximum.reduceat(size, first[:-1][some])
        same = np.concatenate(([False], (hashed[1:] == hashed[:-1]) & (owner[1:] == owner[:-1])))
        repeated = np.bincount(owner, same, n)
        order = np.lexsort((hashed, owner))
        h, o = hashed[order], owner[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
        distinct = np.bincount(o[new], minlength=n).astype(float)
        begin = np.flatnonzero(new)
        runs = np.diff(np.append(begin, len(h)))
        np.maximum.at(top, o[begin], runs)
    per_char, per_word = np.maximum(chars, 1), np.maximum(n_words, 1)
    return np.column_stack([
        chars, n_words, np.bincount(owner, size, n) / per_word if len(hashed) else np.zeros(n), distinct / per_word, top / per_word, repeated / per_word,
        count(LETTER[raw]) / per_char, count(UPPER[raw]) / per_char, count(DIGIT[raw]) / per_char, count(SYMBOL[raw]) / per_char,
        count(raw == 0x21) / per_word, count(raw == 0x7C) / per_word, count(raw == 0x2E) / per_word, count(raw == 0x0A) / per_word, longest,
    ])


def with_statistics(docs: DataFrame, text: str, name: str, keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct column ``name`` of the statistics; the text may be left out of what comes back."""
    rest = [c for c in docs.columns if c != text]
    chosen = docs.select(text, *rest)
    kept = [f for f in chosen.schema.fields if keep_text or f.name != text]
    struct = ", ".join(f"{s} double" for s in STATISTICS)
    schema = chosen.select(*[f.name for f in kept], F.lit(None).cast(f"struct<{struct.replace(' double', ': double')}>").alias(name)).schema

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = statistics(*flat(batch.column(0)))
            struct = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(STATISTICS))], list(STATISTICS))
            columns = list(batch.columns) if keep_text else list(batch.columns[1:])
            return pa.RecordBatch.from_arrays([*columns, struct], schema.names)

        return step

    return arrow_map(chosen, make, schema)


@dataclass
class Rule:
    """All conditions hold: (statistic, at most, threshold)."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        for k, low, t in self.conditions:
            found &= x[:, k] <= t if low else x[:, k] > t
        return found

    def column(self, name: str) -> Column:
        found = F.lit(True)
        for k, low, t in self.conditions:
            value = F.col(f"{name}.{STATISTICS[k]}")
            found = found & (value <= t if low else value > t)
        return found


@dataclass
class Ensemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, name: str) -> Column:
        terms = [F.lit(self.intercept)]
        terms += [F.when(rule.column(name), F.lit(w)).otherwise(0.0) for rule, w in zip(self.rules, self.weights, strict=True)]
        while len(terms) > 1:  # a balanced sum: a chain of additions would be too deep for the optimiser
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return 1 / (1 + F.exp(-terms[0]))


def grow(x: np.ndarray, r: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, paths: list, out: np.ndarray) -> None:
    """A regression tree on residuals ``r`` with curvatures ``h``; adds its paths and writes its leaves to ``out``."""
    best = (1e-9, -1, 0.0)
    if depth and len(rows) >= 2 * LEAST_LEAF:
        whole = r[rows].sum() ** 2 / (h[rows].sum() + 1)
        for k in range(x.shape[1]):
            order = rows[np.argsort(x[rows, k], kind="stable")]
            v = x[order, k]
            left, left_h = np.cumsum(r[order])[:-1], np.cumsum(h[order])[:-1]
            gain = left**2 / (left_h + 1) + (r[rows].sum() - left) ** 2 / (h[rows].sum() - left_h + 1) - whole
            place = np.arange(1, len(rows))
            gain[(v[1:] <= v[:-1]) | (place < LEAST_LEAF) | (len(rows) - place < LEAST_LEAF)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), k, float((v[i] + v[i + 1]) / 2))
    _, k, t = best
    if k < 0:
        out[rows] = r[rows].sum() / (h[rows].sum() + 1)
        return
    low = x[rows, k] <= t
    for part, side in ((rows[low], True), (rows[~low], False)):
        longer = (*path, (k, side, t))
        paths.append(longer)
        grow(x, r, h, part, depth - 1, longer, paths, out)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Ensemble:
    """Rules and lasso weights for labels ``y`` of 0 and 1."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return Ensemble(30.0 if share >= 1 else -30.0)
    rng = np.random.default_rng(seed)
    base = math.log(y.mean() / (1 - y.mean()))
    z, paths = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        kept = np.sort(rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)])
        own, out = [], np.zeros(len(y))
        view = np.full_like(x, 0.0)
        view[:, kept] = x[:, kept]
        grow(view, y - p, p * (1 - p), rows, DEPTH, (), own, out)
        for path in own:
            paths.append(tuple(sorted(path)))
        z[rows] += SHRINK * out[rows]
        rest = np.setdiff1d(np.arange(len(y)), rows)
        z[rest] += SHRINK * route(own, x, rest, y - p, p * (1 - p), rows)
    rules = [Rule(p) for p in dict.fromkeys(paths)]
    held = np.column_stack([r.holds(x) for r in rules]).astype(float)
    share = held.mean(axis=0)
    unlike = (share > 0) & (share < 1)
    rules, held = [r for r, u in zip(rules, unlike, strict=True) if u], held[:, unlike]
    weights, intercept = lasso(held, y.astype(float))
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return Ensemble(intercept, [rules[i] for i in used], [float(weights[i]) for i in used])


def route(paths: list, x: np.ndarray, rows: np.ndarray, r: np.ndarray, h: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """What a tree says of ``rows`` that it was not grown on."""
    found = np.zeros(len(rows))
    longest: dict[tuple, bool] = {p: True for p in paths}
    for p in paths:
        if len(p) > 1:
            longest[p[:-1]] = False
    for p, leaf in longest.items():
        if leaf:
            rule = Rule(p)
            own, there = rule.holds(x[rows]), fitted[rule.holds(x[fitted])]
            found[own] = r[there].sum() / (h[there].sum() + 1)
    return found


def lasso(held: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of an L1-penalised logistic model, by accelerated proximal steps; the intercept is not penalised."""
    n, k = held.shape
    mean = held.mean(axis=0)
    spread = np.maximum(held.std(axis=0), 1e-6)
    x = (held - mean) / spread
    step = 4 * n / max(np.linalg.norm(x, 2) ** 2 + n, 1)
    w = v = np.zeros(k)
    b = u = math.log(y.mean() / (1 - y.mean()))
    t = 1.0
    for _ in range(STEPS):
        gap = 1 / (1 + np.exp(-(x @ v + u))) - y
        moved = v - step * (x.T @ gap) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_b = u - step * gap.mean()
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, u = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    weights = w / spread
    return weights, float(b - weights @ mean)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> Ensemble:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    known = labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.avg("y").alias("y")).where(~held_out(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    # repeated ids would go past the bound
    found = with_statistics(rows, "text", "s", keep_text=False).orderBy(F.xxhash64("id"), "id").limit(2 * sample).select("y", "s.*").toPandas()
    return fit(found[list(STATISTICS)].to_numpy(float).reshape(-1, len(STATISTICS)), (found["y"].to_numpy(float) >= 0.5).astype(float))


def with_score(docs: DataFrame, model: Ensemble, name: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the column ``name``: 0 to 1, higher where label 1 is likelier."""
    stats = fresh(docs, "statistics")
    found = with_statistics(docs, text, stats, keep_text)
    order = [c for c in docs.columns if keep_text or c != text]
    return found.select(*order, model.column(stats).alias(name))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, by a model learnt from those of them that have labels."""
    name = fresh(docs, "score")
    scored = with_score(docs, learn(docs, labels), name)
    return scored.where(F.col(name) >= threshold).select(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = with_score(docs, model, "score", keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
