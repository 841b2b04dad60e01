"""Quality rules with risk-controlled cutoffs.

Every rule is a metric in whole bins, higher is worse. One half of the labelled rows proposes a path of ever stricter cutoffs of all rules together. The
other half certifies them: along the path, a step stands as long as the exact binomial test rejects "the rules together turn away more than the limit's share of
good documents", at a level corrected for the number of strata, and the first step that fails ends the path (a fixed sequence needs no further correction).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import BROADCAST_ROWS, slices, stored

SYMBOLS = b"#*$%&|<>"
BINS = 200
FEATURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long"
_UPPER = bytes(range(65, 91))
_MARKS = b"!?"


def text_features(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of FEATURES. Words are runs without ASCII white space."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if n >= 3:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        pairs = ids[:-1] * len(known) + ids[1:]
        if len(known) > 1 << 20:  # keep the product below 2^63
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, back, count = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        twice = count[back] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= twice
        repeat = int(cover.sum())
    return (
        n,
        word_chars,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat,
        len(raw) - len(raw.translate(None, _UPPER)),
        len(raw) - len(raw.translate(None, _MARKS)),
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in slices(batches):
        rows = [text_features(x.as_py() or "") for x in batch.column(0)]
        table = np.array(rows, np.int64).reshape(-1, len(names))
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *(pa.array(table[:, k]) for k in range(len(names)))], names=["doc_id", "stratum", *names])


def _share(part: Column, whole: Column) -> Column:
    """The bin of part / whole: 0 (none) to BINS (all or more)."""
    return F.least(F.lit(BINS), F.ceil(F.lit(BINS) * part / F.greatest(whole, F.lit(1)))).cast("int")


def rules() -> dict[str, Column]:
    """The metrics; each is a bin from 0 to BINS, and higher is worse."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": _share(F.col("n_symbols"), chars),
        "upper": _share(F.col("n_upper"), chars),
        "marks": _share(F.col("n_marks"), chars),
        "dup_lines": _share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeats": _share(F.col("n_repeat_words"), n),
        "long_words": _share(chars, 25 * n),
        "few_words": _share(F.lit(50), 50 + n),
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exact, as a regularised incomplete beta function by its continued fraction."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    f = d
    for m in range(1, 100_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + t * d, 1 + t / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * f


#: The step of a bin that no step turns away.
NEVER = 1 << 30


def proposed_steps(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """For each rule (row) and bin the step that turns it away, from counts by rule and bin; NEVER if none does.

    A step lowers one rule's cutoff to the next bin with bad documents: the step with the most bad documents for the good ones
    it costs, as long as their share is the greater. Ties go to the first rule.
    """
    n_good, n_bad = max(good[0].sum(), 1), max(bad[0].sum(), 1)
    step = np.full(good.shape, NEVER)
    cutoff = [good.shape[1] - 1] * len(good)
    for now in range(good.size):
        best = (1.0, None, None)
        for r, c in enumerate(cutoff):
            with_bad = np.flatnonzero(bad[r, 1 : c + 1])
            if len(with_bad):
                to = int(with_bad[-1])  # bins over ``to`` go
                ratio = bad[r, to + 1 : c + 1].sum() / n_bad / ((good[r, to + 1 : c + 1].sum() + 0.5) / n_good)
                if ratio > best[0]:
                    best = (ratio, r, to)
        if best[1] is None:
            break
        _, r, to = best
        step[r, to + 1 : cutoff[r] + 1] = now
        cutoff[r] = to
    return step


def certified_step(rejected: np.ndarray, n: int, limit: float, level: float) -> tuple[int, float]:
    """(the last step that stands, its p-value); -1 and 1 if none does. ``rejected``: good documents that each step turns away first, of ``n``.

    Fixed-sequence test: the steps only ever turn more away; each is tested in turn at ``level`` by the exact binomial bound, and the first that fails
    ends the row, so all before it hold together.
    """
    last, p_last, k = -1, 1.0, 0
    for i, more in enumerate(rejected.tolist()):
        k += int(more)
        p = binomial_cdf(k, n, limit)
        if p > level:
            break
        last, p_last = i, p
    return last, p_last


def cutoffs(features: DataFrame, labels: DataFrame, max_false_rejection: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """(stratum, rule, cutoff, n_good, p_value): in each stratum, with the confidence given over all strata together, at most
    ``max_false_rejection`` of the good documents (quality 1) are turned away by all rules together. A bin above a cutoff is turned away.

    Half of the labelled documents (by a hash of doc_id) propose a sequence of ever stricter sets of cutoffs; the other half, which had no part in
    that, certify it. All rules are tested as one, so the correction is for the strata only.
    """
    made = rules()
    names = list(made)
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    held = features.join(marked, "doc_id").select("stratum", "quality", half.alias("half"), F.monotonically_increasing_id().alias("row"), *(v.cast("int").alias(k) for k, v in made.items()))
    held = stored(held, "labelled-bins")
    each = held.select("stratum", "quality", "half", "row", F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), F.col(k).alias("bin")) for i, k in enumerate(names)))).alias("x")).select("*", "x.rule", "x.bin").drop("x")
    counts = each.where("half = 0").groupBy("stratum", "rule", "bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))

    def propose(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros((len(names), BINS + 1)), np.zeros((len(names), BINS + 1))
        np.add.at(good, (pdf["rule"], pdf["bin"]), pdf["good"])
        np.add.at(bad, (pdf["rule"], pdf["bin"]), pdf["bad"])
        step = proposed_steps(good, bad)
        return pd.DataFrame({"stratum": pdf["stratum"].iloc[0], "rule": np.repeat(np.arange(len(names)), BINS + 1), "bin": np.tile(np.arange(BINS + 1), len(names)), "step": step.ravel()})

    # a row for each rule and bin of a stratum, whatever the corpus
    steps = stored(counts.groupBy("stratum").applyInPandas(propose, "stratum string, rule int, bin int, step int"), "proposed-steps")
    small = F.broadcast(steps) if steps.count() <= BROADCAST_ROWS else steps
    first = each.where("half = 1").join(small, ["stratum", "rule", "bin"]).groupBy("stratum", "row", "quality").agg(F.min("step").alias("step"))
    tested = first.where("quality = 1").groupBy("stratum", "step").agg(F.count("*").alias("good"))
    strata = features.select("stratum").distinct().count()
    level = (1 - confidence) / max(strata, 1)

    def certify(pdf: pd.DataFrame) -> pd.DataFrame:
        here = pdf[pdf["step"] < NEVER]
        good = np.zeros(int(here["step"].max()) + 1 if len(here) else 0)
        np.add.at(good, here["step"], here["good"])
        n = int(pdf["good"].sum())
        # steps after the last that turns a good document away cost nothing more
        last, p = certified_step(np.append(good, np.zeros(len(names) * (BINS + 1) - len(good))), n, max_false_rejection, level)
        return pd.DataFrame({"stratum": pdf["stratum"][:1], "last": last, "n_good": n, "p_value": p})

    # at most a row for each step of a stratum
    stands = tested.groupBy("stratum").applyInPandas(certify, "stratum string, last int, n_good long, p_value double")
    cut = F.least(F.lit(BINS), F.min(F.when(F.col("step") <= F.col("last"), F.col("bin") - 1)))
    done = steps.join(stands, "stratum").groupBy("stratum", "rule", "n_good", "p_value").agg(F.coalesce(cut, F.lit(BINS)).cast("int").alias("cutoff"))
    return done.select("stratum", F.get(F.array(*map(F.lit, names)), F.col("rule")).alias("rule"), "cutoff", "n_good", "p_value")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", max_false_rejection: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """One row per row of ``docs``: doc_id, stratum, the counts, base_failed, failed_rules, kept.

    Null text: no words, so base_failed. Null doc_id: scored, never used as a label. Null stratum: the stratum "".
    Rows that repeat are each returned; a doc_id with several labels counts once, with the better one. Very long texts are counted whole; an empty table gives no
    rows. Without labels, or with too few for a proof, no rule stands and only the base decides. Columns besides doc_id, text and the stratum are not read.
    """
    picked = docs.select(F.col("text"), F.col("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
    features = stored(picked.mapInArrow(_features, f"doc_id {dict(docs.dtypes)['doc_id']}, stratum string, {FEATURES}"), "quality")
    made = rules()
    cuts = cutoffs(features, labels.select("doc_id", "quality"), max_false_rejection, confidence)
    wide = stored(cuts.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"cut_{k}") for k in made)), "cutoffs")
    wide = F.broadcast(wide) if wide.count() <= BROADCAST_ROWS else wide
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*(F.when(v > F.col(f"cut_{k}"), F.lit(k)) for k, v in made.items())))
    return (
        features.join(wide, "stratum", "left")
        .withColumns({"base_failed": base, "failed_rules": failed})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop(*(f"cut_{k}" for k in made))
    )
