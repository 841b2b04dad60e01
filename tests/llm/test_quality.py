"""The quality verdict of the query against a plain version of its rules, proposal and proof."""

import math
from collections import Counter

import brute
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from taperline.llm import quality_rules, queries


def test_verdict_against_brute_force(spark, data):
    sf = data.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert {r["doc_id"]: r["kept"] for r in queries.op1_quality_rules(spark, sf).collect()} == {i: r["kept"] for i, r in got.items()}
    half = {r["doc_id"]: r["h"] for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).alias("h")).collect()}
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    share = lambda a, b: min(quality_rules.BINS, math.ceil(quality_rules.BINS * a / max(b, 1)))
    bins = {}
    for i, r in got.items():
        n, chars = r["n_words"], r["word_chars"]
        bins[i] = [share(r["n_symbols"], chars), share(r["n_upper"], chars), share(r["n_marks"], chars), share(r["n_dup_lines"], r["n_lines"]), share(r["n_repeat_words"], n), share(chars, 25 * n), share(50, 50 + n)]
    strata = sorted({r["stratum"] for r in got.values()})
    cuts = {}
    for s in strata:
        mine = [i for i in quality if quality[i] in (0, 1) and got[i]["stratum"] == s]
        a, b = [i for i in mine if half[i] == 0], [i for i in mine if half[i] == 1 and quality[i] == 1]
        good, bad = ([Counter(bins[i][r] for i in a if quality[i] == q) for r in range(7)] for q in (1, 0))
        n_good, n_bad = (max(sum(c[0].values()), 1) for c in (good, bad))
        now, path = [quality_rules.BINS] * 7, []
        while True:
            options = []
            for r in range(7):
                worse = [x for x in bad[r] if 0 < x <= now[r]]
                if worse:
                    to = max(worse) - 1
                    cost = (sum(v for x, v in good[r].items() if to < x <= now[r]) + 0.5) / n_good
                    options.append((sum(v for x, v in bad[r].items() if to < x <= now[r]) / n_bad / cost, -r, to))
            if not options or max(options)[0] <= 1:
                break
            _, r, to = max(options)
            now[-r] = to
            path.append(list(now))
        cuts[s] = [quality_rules.BINS] * 7
        for cut in path:
            k = sum(any(x > c for x, c in zip(bins[i], cut)) for i in b)
            if not b or brute.binomial_cdf(k, len(b), 0.05) > 0.05 / len(strata):
                break
            cuts[s] = cut
    assert any(min(c) < quality_rules.BINS for c in cuts.values())
    for i, r in got.items():
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == base and r["kept"] == (not base and all(x <= c for x, c in zip(bins[i], cuts[r["stratum"]]))), i
