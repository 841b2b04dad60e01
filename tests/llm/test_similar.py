import random

import brute

from taperline.llm import similar, stages


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_pipeline_catches_similarity_of_four_fifths(spark, data):
    random.seed(5)
    rows, copies = [], set()
    for k in range(150):
        words = [random.choice("abcdefgh") + str(random.randint(0, 5000)) for _ in range(random.choice([50, 100, 150]))]
        changed = list(words)
        for j in range(len(words) // 50):
            changed[25 + 50 * j] = "other"
        apart = list(words)
        for j in range(10, len(words) - 10, 12):
            apart[j] = "other"
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " \n".join(changed)), (3 * k + 2, " ".join(apart))]
        assert jaccard(rows[-3][1], rows[-2][1]) >= 0.8 > 0.6 > max(jaccard(rows[-1][1], r[1]) for r in rows[-3:-1])
        copies.add(3 * k + 1)
    rows += [(1000, ""), (1001, None), (None, "a b"), (1002, "a b"), (1003, "a b"), (1003, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in stages.simhash(spark, docs, data).collect())
    assert kept == sorted({3 * k + j for k in range(150) for j in range(3)} - copies | {1000, 1002})


def test_similar_links_follow_paths():
    sets = [similar.shingles(" ".join(f"w{i}" for i in range(a, a + 100))) for a in (0, 8, 16, 60, 0)]
    links = similar.similar_links([10, 11, 12, 13, 14], sets, 0.8)
    assert {frozenset(x) for x in links} >= {frozenset((11, 12))} and {i for x in links for i in x} == {10, 11, 12, 14} and len(links) == 3


def test_stage_against_all_pairs(spark, data):
    rows = sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()), key=lambda r: r[0])
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = brute.groups([i for i, _ in rows], lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    kept = {r["doc_id"] for r in stages.simhash(spark, spark.read.parquet(f"{data}/documents.parquet"), data).collect()}
    assert kept == {rows[k][0] for k in range(len(rows)) if root[k] == k}


def test_links_join_what_all_pairs_join():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(40):
        base = [rng.choice(60, rng.integers(0, 20), replace=False) for _ in range(6)]
        sets = [np.unique(np.concatenate([base[rng.integers(6)][rng.integers(0, 4) :], rng.choice(60, rng.integers(0, 3))])).astype(np.uint64) for _ in range(40)]
        near = lambda i, j: (lambda x: x >= 0.8 * (len(sets[i]) + len(sets[j]) - x) and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])))(len(np.intersect1d(sets[i], sets[j])))  # noqa: B023, E731
        links = {frozenset(x) for x in similar.similar_links(list(range(40)), sets, 0.8)}
        assert all(near(*x) for x in links)
        assert brute.groups(range(40), lambda i, j: frozenset((i, j)) in links) == brute.groups(range(40), near)  # noqa: B023


def test_unrelated_sets_of_a_bucket_are_not_compared(monkeypatch):
    import numpy as np

    rng, compared = np.random.default_rng(1), []
    whole = np.intersect1d
    monkeypatch.setattr(similar.np, "intersect1d", lambda *a, **k: compared.append(1) or whole(*a, **k))
    sets = [np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64)) for _ in range(1000)]
    assert similar.similar_links(list(range(1000)), sets, 0.8) == [] and len(compared) < 10
    copies = [np.unique(np.append(sets[0], np.uint64(i))) for i in range(1000)]
    assert len(similar.similar_links(list(range(1000)), copies, 0.8)) == 999 and len(compared) < 1100
