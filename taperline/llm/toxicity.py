"""Toxic passages by maximum-scoring segments.

Word counts of toxic and clean training texts give log-odds under an informative Dirichlet prior (the pooled word frequencies); a
word scores what its log-odds surely exceed (a multiple of their standard error off), less a drift per word. A linear scan finds every maximal
scoring segment. Segment scores follow an extreme-value law (lambda from the score distribution, K fitted on clean
texts), so every passage has an expected number E of chance occurrences, and a text's least E and its significant passages make its score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import slices, stored

_WORDS = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    return _WORDS(text.lower())


def segments(scores: list[tuple[int, float]], drift: float, n: int) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, end, score) of a text of n words, in linear time.

    ``scores``: (position, score) of the words that don't score 0; every word also costs ``drift``. A stack holds disjoint
    candidates with the running totals before and after each, and a link from each to the nearest that starts lower; one is joined to that if
    it ends lower too. A link that has been passed is never passed again, so the work is in proportion to the words.
    """
    held: list[tuple[int, int, float, float, int]] = []
    total, at = 0.0, 0
    for i, s in scores:
        total -= drift * (i - at)
        at = i + 1
        s -= drift
        if s <= 0:
            total += s
            continue
        a, b, lo, hi = i, i + 1, total, total + s
        total = hi
        j = len(held) - 1
        while j >= 0 and held[j][2] >= lo:
            j = held[j][4]
        while j >= 0 and held[j][3] < hi:
            a, lo, lower = held[j][0], held[j][2], held[j][4]
            del held[j:]
            j = lower
        held.append((a, b, lo, hi, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in held]


@dataclass
class ToxicityModel:
    """weights: word to score, for the words that don't score 0; lam and K: the extreme-value law; logit: its weights."""

    weights: dict[str, float] = field(default_factory=dict)
    drift: float = 0.1
    lam: float = 1.0
    k: float = 1.0
    logit: tuple[float, ...] = (-20.0, 0.0, 0.0)
    level: float = 0.01

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        weights = self.weights
        return segments([(i, weights[w]) for i, w in enumerate(words) if w in weights], self.drift, len(words))

    def features(self, words: list[str]) -> tuple[float, float, list[tuple[int, int, float, float]]]:
        """(-log of the least E, log of 1 + the significant passages' -log E in sum, passages with E)."""
        found = [(a, b, s, self.k * max(len(words), 1) * exp(-self.lam * s)) for a, b, s in self.passages(words)]
        x = max((-log(max(e, 1e-300)) for *_, e in found), default=-10.0)
        sure = [p for p in found if p[3] < self.level]
        return max(-10.0, min(x, 60.0)), log1p(sum(min(-log(max(p[3], 1e-300)), 60.0) for p in sure)), sure

    def score(self, x: float, y: float) -> float:
        z = self.logit[0] + self.logit[1] * x + self.logit[2] * y
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def log_odds(counts: DataFrame, toxic: int, clean: int, prior: float, z: float, least: float) -> DataFrame:
    """(word, weight, clean) of ``counts`` (word, clean, toxic; ``toxic`` and ``clean`` in all): what each word's log-odds surely exceed, which is
    the log-odds shrunk by z standard errors; words whose weight would be under ``least`` have no row."""
    alpha = prior * (F.col("toxic") + F.col("clean")) / float(toxic + clean)
    t, c = F.col("toxic") + alpha, F.col("clean") + alpha
    d = F.log(t / (toxic + prior - t)) - F.log(c / (clean + prior - c))
    sure = F.abs(d) - z * F.sqrt(1 / t + 1 / c)
    return counts.select("word", (F.signum(d) * sure).alias("weight"), sure.alias("sure"), "clean").where(F.col("sure") > least).drop("sure")


def _lambda(weights: np.ndarray, share: np.ndarray, drift: float) -> float:
    """The positive root of E[exp(lambda * score)] = 1 over clean words; 1 if no score is positive."""
    s, p = np.append(weights - drift, -drift), np.append(share, max(1 - share.sum(), 0))
    if not (s[p > 0] > 0).any():
        return 1.0
    lo, hi = 1e-6, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        with np.errstate(over="ignore"):
            lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (lo, mid)
    return min(lo, 5.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per word and task, so that the shuffle gets sums."""
    sums = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            sums[toxic.as_py()].update(words_of(text.as_py() or ""))
    words = list(sums[0].keys() | sums[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([s[w] for w in words], pa.int64()) for s in sums)], names=["word", "clean", "toxic"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, prior: float = 50_000.0, z: float = 2.0, least: float = 0.7, drift: float = 0.1) -> ToxicityModel:
    """A model from at most ``max_rows`` labelled rows (the bound on the sample: those with the least hash of doc_id).

    ``labels`` has doc_id and toxic (0, 1); rows with a null are left out, and of several for a doc_id the greater counts. Three quarters of
    the sample give the weights and the rest, which they have not seen, the calibration. Only text is an input. Without labels of
    both kinds the model scores every text under 0.5.
    """
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(max_rows).withColumn("fit", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) > 0)
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", "fit"), "toxicity-sample")
    counts = rows.where("fit").select("text", "toxic").mapInArrow(_count, "word string, clean long, toxic long")
    counts = stored(counts.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-counts")
    clean, toxic = (x or 0 for x in counts.agg(F.sum("clean"), F.sum("toxic")).first())
    if not toxic or not clean:
        return ToxicityModel()
    # the words of max_rows rows at most, and of these only those with much evidence
    got = log_odds(counts, toxic, clean, float(min(prior, toxic + clean)), z, least).orderBy("word").toPandas()
    weights = got["weight"].to_numpy(float)
    model = ToxicityModel(dict(zip(got["word"], weights.tolist())), drift, _lambda(weights, got["clean"].to_numpy(float) / clean, drift))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(lambda w: (len(w), max((s for *_, s in model.passages(w)), default=0.0)))(words_of(t.as_py() or "")) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.int64()), pa.array([s for _, s in made], pa.float64()), batch.column(1)], names=["n", "s", "toxic"])

    held = rows.where("not fit").select("text", "toxic").mapInArrow(best, "n long, s double, toxic int").toPandas()  # max_rows at most
    if held.empty:
        return model
    null = held[held["toxic"] == 0]
    model.k = float(max(len(null), 1) / max((np.maximum(null["n"], 1) * np.exp(-model.lam * null["s"])).sum(), 1e-9))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.features(words_of(t.as_py() or ""))[:2] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.float64()), pa.array([y for _, y in made], pa.float64()), batch.column(1)], names=["x", "y", "toxic"])

    seen: pd.DataFrame = rows.where("not fit").select("text", "toxic").mapInArrow(both, "x double, y double, toxic int").toPandas()
    if seen["toxic"].nunique() == 2:
        model.logit = _logistic(seen[["x", "y"]].to_numpy(), seen["toxic"].to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with score double, predicted int and passages (first word, end, score, E of each significant one) added, in one pass without a
    shuffle. Null or empty text: no words, and so the least score. Very long texts are scored whole, in time that grows with their length. Columns of these names are replaced, all others stay; repeated
    rows score alike; an empty table gives no rows."""
    kept = docs.drop("score", "predicted", "passages")
    at = kept.columns.index(text)
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in slices(batches):
            got = [made.features(words_of(x.as_py() or "")) for x in batch.column(at)]
            scores = [made.score(x, y) for x, y, _ in got]
            spans = [[{"start": a, "end": b, "score": s, "e_value": e} for a, b, s, e in p] for _, _, p in got]
            cols = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, shape)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "score", "predicted", "passages"])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return kept.mapInArrow(run, ", ".join([*types, "score double, predicted int, passages array<struct<start:int,end:int,score:double,e_value:double>>"]))
