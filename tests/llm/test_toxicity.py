"""The toxicity query against a plain version: dictionaries for counts, recursion on best segments for the scan."""

import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taperline.llm import queries, toxicity


def best_segments(x, lo, hi):
    """All maximal segments of the scores x[lo:hi]: the best, and those left and right of it."""
    out, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        best, run, start = (1e-12, 0, 0), 0.0, lo
        for i in range(lo, hi):
            if run <= 0:
                run, start = 0.0, i
            run += x[i]
            if run > best[0] + 1e-12:
                best = (run, start, i + 1)
        if best[2]:
            out.append((best[1], best[2], best[0]))
            todo += [(lo, best[1]), (best[2], hi)]
    return sorted(out)


def test_segments_are_those_of_recursion():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = rng.choice([0, 0, 1.5, 2.25, -1.75, 0.5], 40) + rng.normal(0, 1e-3, 40)
        got = toxicity.segments([(i, s) for i, s in enumerate(x.tolist()) if s], 0.3125, len(x))
        want = best_segments([s - 0.3125 for s in x], 0, len(x))
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_scan_is_linear():
    def took(n):
        began = time.perf_counter()
        assert len(toxicity.segments([(60 * i, 1.0) for i in range(n)], 0.1, 60 * n)) == n
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 40 * max(took(10_000), 0.01)


def test_query_against_brute_force(spark, data):
    got = {r["doc_id"]: r for r in queries.op5_toxicity(spark, data).collect()}
    docs = {r["doc_id"]: re.findall(r"\w+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").where(~queries.held_out(5)).select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) > 0).alias("fit")).collect()
    assert len(labels) < 20_000
    sums = Counter(), Counter()
    for r in labels:
        if r["fit"]:
            sums[r["toxic"]].update(docs[r["doc_id"]])
    clean, toxic = (sum(s.values()) for s in sums)
    prior = float(min(50_000, clean + toxic))
    weights = {}
    for w in sums[0].keys() | sums[1].keys():
        alpha = prior * (sums[0][w] + sums[1][w]) / (clean + toxic)
        t, c = sums[1][w] + alpha, sums[0][w] + alpha
        d = math.log(t / (toxic + prior - t)) - math.log(c / (clean + prior - c))
        if abs(d) - 2 * math.sqrt(1 / t + 1 / c) > 0.7:
            weights[w] = math.copysign(abs(d) - 2 * math.sqrt(1 / t + 1 / c), d)
    share = {w: sums[0][w] / clean for w in weights}
    mean = lambda lam: sum(share[w] * math.exp(lam * (s - 0.1)) for w, s in weights.items()) + (1 - sum(share.values())) * math.exp(-0.1 * lam) - 1
    lo, hi = 1e-6, 5.0
    if mean(5.0) < 0:
        lo = 5.0
    elif not any(share[w] > 0 and s > 0.1 for w, s in weights.items()):
        lo = 1.0
    else:
        for _ in range(80):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if mean(mid) < 0 else (lo, mid)
    found = {i: best_segments([weights.get(w, 0.0) - 0.1 for w in words], 0, len(words)) for i, words in docs.items()}
    null = [r["doc_id"] for r in labels if not r["fit"] and not r["toxic"]]
    k = len(null) / sum(max(len(docs[i]), 1) * math.exp(-lo * max((s for *_, s in found[i]), default=0)) for i in null)

    def features(i):
        e = [k * max(len(docs[i]), 1) * math.exp(-lo * s) for *_, s in found[i]]
        return max(-10, min(60, max((-math.log(max(x, 1e-300)) for x in e), default=-10))), math.log1p(sum(min(-math.log(max(x, 1e-300)), 60) for x in e if x < 0.01)), sum(x < 0.01 for x in e)

    seen = [(features(r["doc_id"])[:2], r["toxic"]) for r in labels if not r["fit"]]
    logit = toxicity._logistic(np.array([x for x, _ in seen]), np.array([y for _, y in seen], float))
    assert len(got) == len(docs)
    for i in docs:
        x, y, n = features(i)
        z = logit[0] + logit[1] * x + logit[2] * y
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), rel=1e-6, abs=1e-9) and got[i]["n_passages"] == n
