"""Spelling variants: words one edit apart, found by search schemes over FM-indexes of the vocabulary.

One edit leaves the first or the second half of a word as it is. Words are dealt out by these halves, so that a word and all that share a half with it
meet in one block. A block's words, set off by delimiters, have an FM-index: of the reversed words for first halves, which matches
rightwards, and of the words for second halves, which matches leftwards. A search matches the half exactly and goes on across the other with one
edit at most; all it keeps is an interval of suffix ranks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import slices, stored

#: Most words of one half that a block holds; those of a more frequent half are dealt to several.
BLOCK = 50_000
#: Most words counted in a task before they are handed on.
COUNTED = 200_000
#: Longest interval whose symbols are listed one by one; for longer ones all symbols are tried.
LISTED = 32


def _count_words(least: int, every: int):
    """Batches of (doc_id as text, text) to words and how often they occur, added up by task as far as memory allows."""
    # bytes.lower: A-Z only
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def flush(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                low = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                before = zlib.crc32(f"{doc or ''}:".encode())
                for word, times in Counter(runs.findall(low)).items():
                    h = zlib.crc32(word.encode(), before)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    n[word] += times
            if len(n) > COUNTED:
                yield flush(n)
                n = Counter()
        yield flush(n)

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes of whole numbers in ascending order, by prefix doubling; the last number must be the least and unique."""
    rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        later = np.append(rank[width:], np.full(min(width, len(rank)), -1))
        key = rank * (len(text) + 1) + later[: len(rank)] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(len(text), np.int64)
        new[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        rank = new
        if rank[order[-1]] == len(text) - 1:
            return order
        width *= 2


class FMIndex:
    """Of distinct words between delimiters: backward steps on intervals of suffix ranks for many searches at once."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        text = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)  # words hold letters only, so the delimiter is the least
        self.letters = np.unique(text)
        codes = np.append(np.searchsorted(self.letters, text) + 1, 0)  # 1 is the delimiter, 0 the end
        self.starts = np.flatnonzero(codes[:-2] == 1)  # the delimiter before each word
        self.places = suffix_array(codes)
        self.last = codes[self.places - 1]  # what stands before each suffix
        order = np.argsort(self.last, kind="stable")
        self.size = len(codes) + 1
        self.ranks = self.last[order] * self.size + order

    def code(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.searchsorted(self.letters, raw) + 1

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes with a symbol put before those of the given intervals."""
        return np.searchsorted(self.ranks, symbol * self.size + lo), np.searchsorted(self.ranks, symbol * self.size + hi)

    def before(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, symbol): the letters that stand before some suffix of each interval, each once."""
        top = len(self.letters)
        short = np.flatnonzero(hi - lo <= LISTED)
        n = (hi - lo)[short]
        which = np.repeat(short, n)
        at = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(which * (top + 1) + self.last[at])
        long = np.flatnonzero(hi - lo > LISTED)
        pairs = np.concatenate([pairs, (long[:, None] * (top + 1) + np.arange(2, top + 1)).ravel()])
        which, symbol = pairs // (top + 1), pairs % (top + 1)
        return which[symbol > 1], symbol[symbol > 1]

    def search(self, patterns: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, word): numbers of the words exactly one edit away, the edit before the last ``exact`` letters. All letters of patterns must be in words."""
        sizes = np.array([len(p) + 2 for p in patterns])
        flat = self.code("".join(["\n" + p[::-1] + "\n" for p in patterns]))  # in the order in which they are matched
        begin = np.cumsum(sizes) - sizes
        exact = np.array(exact) + 1
        none = np.zeros(0, np.int64)
        q = np.arange(len(patterns))
        now = (q, *self.step(flat[begin], np.zeros(len(q), np.int64), np.full(len(q), self.size - 1)))  # without an edit so far
        edited = (none, none, none)
        found_q, found_word = [], []
        join = lambda *parts: tuple(np.concatenate(x) for x in zip(*parts))
        alive = lambda q, lo, hi: (q[hi > lo], lo[hi > lo], hi[hi > lo])
        p = 1  # letters matched, the first delimiter among them
        while len(now[0]) or len(edited[0]):
            q, lo, hi = now
            may = p >= exact[q]
            eq, elo, ehi = q[may], lo[may], hi[may]
            inside = p < sizes[eq] - 1  # else all but the last delimiter is matched
            which, symbol = self.before(elo, ehi)
            slo, shi = self.step(symbol, elo[which], ehi[which])
            edited = join(edited, alive(eq[which], slo, shi))  # a letter more
            swap = inside[which] & (symbol != flat[begin[eq[which]] + np.minimum(p, sizes[eq[which]] - 1)])
            after = join(alive(eq[which][swap], slo[swap], shi[swap]), (eq[inside], elo[inside], ehi[inside]))  # another letter, or one less
            q, lo, hi = edited
            edited = join(alive(q, *self.step(flat[begin[q] + p], lo, hi)), after)
            q, lo, hi = now
            now = alive(q, *self.step(flat[begin[q] + p], lo, hi))
            p += 1
            done = sizes[edited[0]] == p
            for q, lo, hi in zip(*(x[done] for x in edited)):
                found_q.append(np.full(hi - lo, q))
                found_word.append(np.searchsorted(self.starts, self.places[lo:hi]))
            edited, now = tuple(x[~done] for x in edited), tuple(x[sizes[now[0]] > p] for x in now)
        if not found_q:
            return none, none
        pairs = np.unique(np.concatenate(found_q) * len(self.words) + np.concatenate(found_word))
        return pairs // len(self.words), pairs % len(self.words)


def _search_block(side: int, rows: list[tuple]) -> Iterator[tuple[str, int, str, int]]:
    """(word, near words, best near word, its n) for the rows that ask. rows: part, parts, word, n, whether it is asked for, whether it asks."""
    n = {r[2]: r[3] for r in rows if r[4]}
    asked = [(r[2], r[0], r[1]) for r in rows if r[5]]
    turn = (lambda w: w[::-1]) if side == 0 else (lambda w: w)
    words = sorted(n)
    have = set("".join(words))
    asked = [a for a in asked if have.issuperset(a[0]) or (side == 0 and have.issuperset(a[0][: len(a[0]) // 2])) or (side == 1 and have.issuperset(a[0][len(a[0]) // 2 :]))]
    if not words or not asked:
        return
    foreign = sorted(set("".join(a[0] for a in asked)) - have)
    index = FMIndex([turn(w) for w in words] + foreign)  # letters that only patterns have stand alone, too short to be found
    exact = [len(w) // 2 if side == 0 else len(w) - len(w) // 2 for w, _, _ in asked]
    pattern, word = index.search([turn(w) for w, _, _ in asked], exact)
    best: dict[int, list] = {}
    for a, b in zip(pattern.tolist(), word.tolist()):
        if b >= len(words):
            continue
        (text, part, parts), near = asked[a], words[b]
        if side == 1 and near.startswith(text[: len(text) // 2]):
            continue  # the other scheme finds it
        if parts > 1 and zlib.crc32(near.encode()) % parts != part:
            continue  # another block of this half finds it
        got = best.setdefault(a, [0, 0, ""])
        got[0] += 1
        if (-n[near], near) < (-got[1], got[2]):
            got[1:] = n[near], near
    for a, (count, times, near) in best.items():
        yield asked[a][0], count, near, times


def _search_blocks(block: int):
    """Over rows sorted by side, half and part: blocks of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, group, side = [], None, None

        def results() -> pa.RecordBatch:
            found = list(_search_block(side, rows))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.int64()))] if found else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64())], names=["word", "n_near", "form", "form_n"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[:3] != group:
                    if rows and (len(rows) >= block or r[0] != side):
                        yield results()
                        rows = []
                    group, side = r[:3], r[0]
                rows.append(r[2:])
        if rows:
            yield results()

    return run


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of the words with near ones. words: distinct ones of at least 7 letters, with n.

    Every word is filed by the first and by the second halves that words of its length, one less and one more have: four rows. Groups of over
    ``block`` rows are filed in several parts, and asked in all of them.
    """
    size = F.length("word")
    row = lambda s, k, asks: F.struct(F.lit(s).alias("side"), k.alias("half"), F.lit(asks).alias("asks"))
    part = lambda a, n: F.col("word").substr(a, n)
    one = F.lit(1)
    half = F.floor(size / 2).cast("int")
    other = F.when(size % 2 == 0, half - 1).otherwise(half + 1)  # of even sizes one less, of odd sizes one more
    back = size - half
    rear = F.when(size % 2 == 0, back + 1).otherwise(back - 1)
    halves = F.array(row(0, part(one, half), True), row(0, part(one, other), False), row(1, part(half + 1, back), True), row(1, part(size - rear + 1, rear), False))
    rows = words.select("word", "n", F.explode(halves).alias("h")).select("h.side", "h.half", "word", "n", "h.asks")
    hot = rows.groupBy("side", "half").agg(F.count("*").alias("rows")).where(F.col("rows") > block)
    many = stored(hot.select("side", "half", F.ceil(F.col("rows") / block).cast("int").alias("parts")), "frequent-halves")
    rows = rows.join(many, ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = (F.crc32(F.col("word").cast("binary")) % F.col("parts")).cast("int")
    dealt = rows.select("side", "half", "word", "n", "asks", "parts", own.alias("own"), F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))).alias("part"))
    dealt = dealt.select("side", "half", "part", "parts", "word", "n", (F.col("part") == F.col("own")).alias("filed"), "asks")
    spark = words.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + words.count() // block)
    sorted_ = dealt.repartition(tasks, "side", "half", "part").sortWithinPartitions("side", "half", "part")
    found = sorted_.mapInArrow(_search_blocks(block), "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n"))


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2, every: int = 31) -> DataFrame:
    """(word, n): the words of all texts that occur ``times`` or more."""
    counted = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(_count_words(least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _last_forms(step: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last, twice as far in each round. Every step leads to a word of ten times the count, so a
    chain has under 20 steps and five rounds do."""
    far = stored(step.select("word", F.col("form").alias("root")), "roots")
    for _ in range(5):
        beyond = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = stored(far.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return far


def spelling_groups(docs: DataFrame, least: int = 7, times: int = 2, ratio: int = 10, every: int = 31, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each word of the vocabulary of all texts.

    Words are maximal runs of a-z, A-Z and U+00C0 to U+00FF with A-Z lower-cased; let h be the unsigned crc32 of ``<doc_id>:<run>``: if ``every`` divides h, the code
    point h modulo the run's length is deleted. Kept are words of ``least`` code points and ``times`` occurrences or more. Two are near at exactly one inserted, deleted or
    replaced code point. form is the near word of the largest count (ties: the least in code-point order) if that is ``ratio`` times the word's own or more, and root
    where following forms ends. Null and empty texts have no words, a null doc_id counts as empty; texts and words of any length are taken whole; repeated rows
    count again; an empty table gives no rows; other columns are not read.
    """
    if least < 7 or ratio < 10:
        raise ValueError("least must be 7 or more (halves of three code points), and ratio 10 or more")
    words = stored(vocabulary(docs, least, times, every), "vocabulary")
    near = near_words(words, block)
    all_ = stored(words.join(near, "word", "left"), "near-words")
    has = F.col("form_n") >= ratio * F.col("n")
    formed = all_.select("word", F.when(has, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form_n")).alias("form_n"))
    roots = _last_forms(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
