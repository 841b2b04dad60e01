import random
from itertools import combinations

from taperline.llm import decontaminate


def agrees(a, b):
    """Whether a stretch of 13 words or more of two aligned lists, equal at both ends, agrees in four fifths."""
    same = [x == y for x, y in zip(a, b)]
    return any(same[i] and same[j] and 5 * sum(same[i : j + 1]) >= 4 * (j + 1 - i) for i in range(len(same)) for j in range(i + 12, len(same)))


def test_every_planted_leak_is_found(spark):
    random.seed(3)
    word = lambda: f"w{random.randint(0, 100000)}"
    sizes = [1, 2, 3, 4, 5, 7, 8, 12, 13, 14, 15, 15, 20, 40, 59]
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate(sizes)]
    docs, leaked = [], {}
    for i, text in items:
        b = text.split()
        plans = [()]
        if len(b) >= 13:
            plans += [tuple(range(4, len(b), 5)), *([(3,), (3, 7, 11), (2, 5, 8)] if len(b) == 15 else [])]
            plans += [tuple(random.sample(range(1, len(b) - 1), len(b) // 5)) for _ in range(40)]
        if len(b) == 15 and i == sizes.index(15):
            plans += list(combinations(range(1, 14), 3))
        for swaps in plans:
            copy = [x if k not in swaps else "swapped" for k, x in enumerate(b)]
            docs.append((len(docs), " ".join([word() for _ in range(20)] + copy + [word() for _ in range(20)])))
            if len(b) < 13 or agrees(copy, b):
                leaked[docs[-1][0]] = (i, copy)
    clean = len(docs)
    for i, text in items:
        if len(text.split()) > 1:
            docs.append((len(docs), " ".join([*text.split()[: min(11, len(text.split()) - 1)], *(word() for _ in range(30))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_overlaps(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(leaked) > 500 and {d for d, _ in got} == set(leaked) and all(d < clean for d, _ in got)
    for d, (i, copy) in leaked.items():
        r, text, b = got[d, i], docs[d][1].split(), items[i][1].split()
        assert r["matches"] == sum(x in b for x in text[r["doc_start"] : r["doc_end"]]) and 5 * r["matches"] >= 4 * (r["doc_end"] - r["doc_start"])
