"""Longest-previous-factor arrays decide what suffix-array dedup removes."""

import numpy as np
from pyspark.sql import functions as F

from taperline.llm import stages, suffix_dedup


def factors(raw, starts, length, later):
    def common(i, j):
        n = 0
        while n < length and raw[i + n] == raw[j + n]:
            n += 1
        return n

    return [max((common(i, j) for j in (starts[k + 1 :] if later else starts[:k])), default=0) for k, i in enumerate(starts)]


def test_longest_factors_against_brute_force():
    rng = np.random.default_rng(5)
    for trial in range(60):
        length = int(rng.integers(40, 60))
        raw = rng.integers(97, 97 + rng.integers(1, 4), rng.integers(70, 300)).astype(np.uint8)
        if trial % 3 == 0:
            raw = np.tile(raw[: rng.integers(3, 50)], 50)[:300]
        if trial % 5 == 0:
            raw = np.r_[raw, raw[10:]]
        starts = np.flatnonzero(rng.random(len(raw) - length + 1) < 0.8)
        for later in (False, True):
            got = suffix_dedup.longest_factors(suffix_dedup.words_at(raw), starts, length, later)
            assert got.tolist() == factors(raw.tobytes(), starts.tolist(), length, later)


def test_factors_decide(monkeypatch):
    text = bytes(np.random.default_rng(1).integers(97, 123, 300).astype(np.uint8))
    found = [(1, 0, b"x" * 20 + text), (2, 5, text + b"y" * 20)]
    assert [len(c) for c in suffix_dedup.repeats(found, 200, "first")] == [1, 1, 1]
    assert [c.tolist() for c in suffix_dedup.repeats(found, 200, "none")] == [[1, 2], [20, 5], [320, 305]]
    monkeypatch.setattr(suffix_dedup, "longest_factors", lambda word, starts, length, later=False: np.full(len(starts), length - 1))
    assert [len(c) for c in suffix_dedup.repeats(found, 200, "none")] == [0, 0, 0]


def test_neighbours_of_long_runs():
    place = np.r_[np.arange(5000), np.arange(2500, 7000), np.arange(100)[::-1]]
    before, after = suffix_dedup.smaller_neighbours(place)
    held = []
    for i, x in enumerate(place):
        while held and place[held[-1]] >= x:
            held.pop()
        assert before[i] == (held[-1] if held else -1)
        held.append(i)
    assert after[-1] == len(place) and (place[after[:5000][after[:5000] < len(place)]] < place[:5000][after[:5000] < len(place)]).all()


def test_stages_keep_clashing_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    names = ("score", "predicted", "passages", "spans", "kept", "_rid", "_raw_spans", "rest", "key", "words", "_leak_key", "set", "cut_spans", "whole")
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    wide = wide.unionByName(wide.limit(3)).unionByName(wide.limit(1).withColumns({"text": F.lit(None).cast("string"), "source": F.lit(None).cast("string")}))
    for stage in (stages.toxicity, stages.simhash, stages.suffix_dedup, stages.decontaminate):
        out = stage(spark, wide, data)
        assert out.dtypes == wide.dtypes and out.count() > 0
        assert out.where(" or ".join(f"`{n}` is distinct from concat('{n}', cast(doc_id as string))" for n in names)).isEmpty(), stage
