"""op11 against brute force: all pairs of words compared letter by letter."""

import random
import re
import zlib
from collections import Counter

import pytest

from taperline.llm import queries, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            n[r] += len(r) >= 7
    return {w: c for w, c in n.items() if c >= 2}


def brute(n):
    words, near = sorted(n), {w: [] for w in n}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for w in words:
        near[w] = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if x != w and one_edit(w, x)]
    form = {w: b for w in words if near[w] for b in [min(near[w], key=lambda x: (-n[x], x))] if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in words}


def rows_of(df):
    got = df.collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def test_query(spark, data):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = rows_of(queries.op11_spelling(spark, data))
    assert got == brute(brute_words(rows)) and any(v[0] for v in got.values())


@pytest.mark.parametrize("block", [50_000, 60, 7])
def test_halves_that_no_block_holds(spark, block):
    random.seed(block)
    words = {"".join(random.choice("abé") for _ in range(random.choice([7, 7, 8, 9, 10]))) for _ in range(700)}
    n = {w: random.choice([2, 3, 30, 400, 5000]) for w in words}
    want = {w: (v[3], *v[4:]) for w, v in brute(n).items() if v[3]}
    got = {r["word"]: r for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), block).collect()}
    assert {w: r["n_near"] for w, r in got.items()} == {w: v[0] for w, v in want.items()}
    assert all(r["form_n"] == n[r["form"]] and one_edit(w, r["form"]) for w, r in got.items())


def test_suffix_ranks():
    words = ["banana", "bananas", "ananas", "cabana", "a" * 300, "a" * 301]
    index = spelling.FMIndex(words)
    text = "\n" + "\n".join(words) + "\n\0"
    assert [text[i:] for i in index.places] == sorted(text[i:] for i in range(len(text)))
    q, w = index.search(["banana", "a" * 300, "bananna"], [3, 150, 4])
    assert sorted(zip(q.tolist(), w.tolist())) == [(1, 5)]  # a letter more in front of the exact half; that of bananas is behind it
    q, w = spelling.FMIndex([x[::-1] for x in words]).search([x[::-1] for x in ["banana", "bananas"]], [3, 3])
    assert sorted(zip(q.tolist(), w.tolist())) == [(0, 1), (1, 0)]


def test_forms_are_followed(spark):
    rows = [(i, "Kaleidoscope " * 2) for i in range(1)] + [(2, "kaleidoscops " * 30), (3, "kaleidoscopsx " * 400), (4, "KALEIDOSCOPSX")]
    got = rows_of(spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string"), every=1 << 40))
    assert got["kaleidoscope"] == ("kaleidoscops", "kaleidoscopsx", 2, 1, 30) and got["kaleidoscops"] == ("kaleidoscopsx", "kaleidoscopsx", 30, 2, 401)
    assert got["kaleidoscopsx"] == (None, "kaleidoscopsx", 401, 1, None)


def test_odd_rows(spark):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (None, "nothing nothing nothinc nothinc", "x", 1), (3, "ÀÉÎÕÜßÿ àéîõüßÿ ÀÉÎÕÜßÿ", "x", 1), (4, "w" * 100_000 + " " + "w" * 100_000, "x", 1), (5, "Ÿseven77 sevens", "x", 1)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    plain = [r[:2] for r in rows]
    assert rows_of(spelling.spelling_groups(d)) == brute(brute_words(plain))
    assert rows_of(spelling.spelling_groups(d.limit(0))) == {}
    with pytest.raises(ValueError):
        spelling.spelling_groups(d, least=5)
