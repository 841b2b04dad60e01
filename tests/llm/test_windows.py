"""op12 against brute force: every window kept as its words."""

import hashlib
import random

import pytest

from taperline.llm import queries, substring_dedup

LAST = 1 << 70


def brute(rows, length):
    """For each row the places of the words that go."""
    texts, first = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows], {}
    for i, w in texts:
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            first[k] = min(i, first.get(k, LAST))
    return [(w, {p for s in range(len(w) - length + 1) if first[tuple(w[s : s + length])] < i for p in range(s, s + length)}) for i, w in texts]


def shown(w, gone):
    return len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()


def test_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in queries.op12_substring_dedup(spark, data).collect()}
    assert len(rows) == len(got) and got == {i: shown(*x) for (i, _), x in zip(rows, brute(rows, 50))}
    assert sum(x[1] for x in got.values()) > 1000


@pytest.mark.parametrize("length,anchor", [(8, 3), (6, 6), (12, 1)])
def test_short_windows(spark, length, anchor):
    random.seed(length)
    rows = [(i // 2 if i % 9 else None, " ".join(random.choice("ab") for _ in range(random.choice([0, 1, 5, 6, 30, 80])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "a " * 400), (503, " a\n" * 350), (504, "é 日本\x0b" * 9), (505, "é\t日本 " * 9), (506, "x" * 50_000 + " y"), (506, "a " * 10)]
    d = spark.createDataFrame([(*r, "e", 1.0, 2) for r in rows], "doc_id long, text string, kept string, _rid double, start int")
    done = substring_dedup.substring_dedup(d, length, anchor)
    assert done.columns == ["doc_id", "text", "_rid", "start", *substring_dedup.ADDED]
    got = sorted((r["doc_id"] or -1, r["text"] or "", r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest(), sum(x["end"] - x["start"] for x in r["spans"])) for r in done.collect())
    want = sorted((i or -1, t or "", *shown(*x), len(x[1])) for (i, t), x in zip(rows, brute(rows, length)))
    assert got == want


def test_spans_are_maximal(spark):
    rows = [(1, "a b c d e f"), (2, "x a b c d e y c d e f")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3, 2).where("doc_id = 2").first()
    assert [(x["start"], x["end"]) for x in got["spans"]] == [(1, 6), (7, 11)] and got["kept"] == "x y"


def test_text_ids_and_empty_tables(spark):
    rows = [("b", "1 2 3 4"), ("a", "0 1 2 3"), (None, "1 2 3"), (None, "1 2 3")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r["doc_id"] or "", r["kept"]) for r in substring_dedup.substring_dedup(d, 3, 2).collect())
    assert got == [("", ""), ("", ""), ("a", "0 1 2 3"), ("b", "4")]
    assert substring_dedup.substring_dedup(d.limit(0), 3, 2).collect() == []
