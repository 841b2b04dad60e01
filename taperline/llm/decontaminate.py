"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Fixed masks over windows of words keep some positions and ignore the others. Equal hashes of the kept words join documents and
benchmark items; each hit names a diagonal, on which the two are compared word for word. A match scores 1 there and a
substitution -4, so four fifths of a stretch agree if it doesn't sum up to less than 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import BROADCAST_BYTES, BROADCAST_ROWS, stored

#: Fixed masks; 1 marks a word that counts. The last two alone hit every stretch of 13 words or more that agrees in four fifths: either
#: four equal words follow each other, or it is of 15 words and three runs of three are apart by one word each.
MASKS = ("11010011", "10110101", "11101001", "1111", "1110111")
#: Items of fewer words than the shortest mask are found by a hash of the whole item.
SHORTEST = min(map(len, MASKS))


def words(text: Column) -> Column:
    """Lower-case words between ASCII white space."""
    return F.filter(F.split(F.translate(F.lower(text), "\t\n\x0b\f\r", "     "), " "), lambda x: x != "")


def seeds(rows: DataFrame, keep: list[str], short: list[int], whole: bool = False) -> DataFrame:
    """``keep`` with pos (from 0) and seed long: a row for each window of the array ``words`` and each mask, and for each window of a size
    in ``short``; if ``whole``, the latter only where the window is all of the array."""
    width = max(map(len, MASKS))
    spread = rows.where(F.size("words") > 0).withColumn("_n", F.size("words")).select(*keep, "_n", F.posexplode(F.arrays_zip(*(F.slice("words", k + 1, 1 << 30).alias(f"w{k}") for k in range(width)))).alias("pos", "w"))
    word = lambda k: F.col(f"w.w{k}")
    hashed = [F.when(word(len(x) - 1).isNotNull(), F.xxhash64(F.lit(m), *(word(k) for k, c in enumerate(x) if c == "1"))) for m, x in enumerate(MASKS)]
    for n in short:
        there = F.col("_n") == n if whole else word(n - 1).isNotNull()
        hashed.append(F.when(there & word(n - 1).isNotNull(), F.xxhash64(F.lit(-n), *(word(k) for k in range(n)))))
    return spread.select(*keep, "pos", F.explode(F.array(*hashed)).alias("seed")).where("seed is not null")


def best_stretch(flags: Column) -> Column:
    """struct<score, start, end, matches> of the best stretch of an array of booleans; of equals the first to end, from its earliest start; score 0 if none matches."""
    zero = F.struct(*(F.lit(0).alias(c) for c in ("i", "run", "from", "hits", "score", "start", "end", "matches")))

    def step(a: Column, same: Column) -> Column:
        fresh = a["run"] < 0
        run = F.when(fresh, 0).otherwise(a["run"]) + F.when(same, 1).otherwise(-4)
        hits = F.when(fresh, 0).otherwise(a["hits"]) + F.when(same, 1).otherwise(0)
        first = F.when(fresh, a["i"]).otherwise(a["from"])
        up = run > a["score"]
        pick = lambda new, old: F.when(up, new).otherwise(a[old])
        return F.struct(
            (a["i"] + 1).alias("i"), run.alias("run"), first.alias("from"), hits.alias("hits"), pick(run, "score").alias("score"), pick(first, "start").alias("start"), pick(a["i"] + 1, "end").alias("end"), pick(hits, "matches").alias("matches")
        )

    return F.aggregate(flags, zero, step)


def longest_stretch(flags: Column) -> Column:
    """struct<i, sum, firsts, len, start>: len and start of the longest stretch of an array of booleans that begins and ends with true and has four fifths
    true; of equals the first; len 0 if none is true. firsts[k] is the first true place before which the sum was -k or less."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("firsts"), F.lit(0).alias("len"), F.lit(0).alias("start"))

    def met(a: Column) -> Column:
        firsts = F.when(F.size(a["firsts"]) <= -a["sum"], F.concat(a["firsts"], F.array_repeat(a["i"], -a["sum"] + 1 - F.size(a["firsts"])))).otherwise(a["firsts"])
        start = F.get(firsts, F.greatest(-a["sum"] - 1, F.lit(0)))
        longer = a["i"] + 1 - start > a["len"]
        return F.struct(
            (a["i"] + 1).alias("i"), (a["sum"] + 1).alias("sum"), firsts.alias("firsts"), F.when(longer, a["i"] + 1 - start).otherwise(a["len"]).alias("len"), F.when(longer, start).otherwise(a["start"]).alias("start")
        )

    def step(a: Column, same: Column) -> Column:
        missed = F.struct((a["i"] + 1).alias("i"), (a["sum"] - 4).alias("sum"), a["firsts"].alias("firsts"), a["len"].alias("len"), a["start"].alias("start"))
        return F.when(same, met(a)).otherwise(missed)

    return F.aggregate(flags, zero, step)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, min_matches: int = 13) -> DataFrame:
    """(key, doc_id, item_id, matches, doc_start, doc_end): overlaps of documents with benchmark items, the best of each pair.

    key is a hash of doc_id and text. An overlap counts if a stretch of ``min_matches`` words or more, from an equal word to an equal word,
    agrees in four fifths; a shorter item must stand there as a whole. For 13 words or more no such stretch is missed. matches, doc_start and doc_end
    are of the best stretch where that has ``min_matches`` equal words, else of the longest. Null texts and items have no words. Repeated
    rows share a key and appear once. Ties go to the first place in the document. Texts are compared whole, whatever their length. An empty
    table on either side gives no rows. Extra columns are not read.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", words(F.col("text")).alias("words"))
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).distinct()
    short = sorted(r["n"] for r in items.select(F.size("words").alias("n")).where(f"n between 1 and {SHORTEST - 1}").distinct().collect())
    marks = stored(seeds(items, ["item_id"], short, whole=True).select("seed", "item_id", F.col("pos").alias("item_pos")).distinct(), "benchmark-seeds")
    small = marks.count() <= BROADCAST_ROWS
    hits = seeds(rows, ["key"], short).join(F.broadcast(marks) if small else marks, "seed").select("key", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    hits = stored(hits, "benchmark-hits")
    few = hits.count() <= BROADCAST_ROWS
    # of the items only those that are hit anywhere; sent to all tasks only if few and short
    item = items.join(hits.select("item_id").distinct(), "item_id", "left_semi").select("item_id", F.col("words").alias("item_words"))
    n_items, n_bytes = item.agg(F.count("*"), F.sum(F.octet_length(F.array_join("item_words", " ")))).first()
    small = n_items <= BROADCAST_ROWS and (n_bytes or 0) <= BROADCAST_BYTES
    pairs = rows.join(F.broadcast(hits) if few else hits, "key").join(F.broadcast(item) if small else item, "item_id")
    at, skip = F.greatest("diagonal", F.lit(0)), F.greatest(-F.col("diagonal"), F.lit(0))
    n = F.least(F.size("words") - at, F.size("item_words") - skip)
    same = F.zip_with(F.slice("words", at + 1, n), F.slice("item_words", skip + 1, n), lambda a, b: a == b)
    flags = pairs.select("key", "doc_id", "item_id", at.alias("at"), F.size("item_words").alias("n_item"), same.alias("same"))
    best = flags.select("*", best_stretch(F.col("same")).alias("b"), longest_stretch(F.col("same")).alias("l"))
    kept = best.where(F.when(F.col("n_item") < min_matches, F.col("b.matches") == F.col("n_item")).otherwise(F.col("l.len") >= min_matches))
    equal = F.size(F.filter(F.slice("same", F.col("l.start") + 1, F.col("l.len")), lambda x: x))
    longest = F.struct((F.col("l.start")).alias("start"), (F.col("l.start") + F.col("l.len")).alias("end"), equal.alias("matches"))
    kept = kept.withColumn("b", F.when(F.col("b.matches") >= F.least(F.lit(min_matches), F.col("n_item")), F.struct("b.start", "b.end", "b.matches")).otherwise(longest))
    return kept.groupBy("key", "item_id").agg(
        F.max_by(F.struct("doc_id", F.col("b.matches").alias("matches"), (F.col("at") + F.col("b.start")).alias("doc_start"), (F.col("at") + F.col("b.end")).alias("doc_end")), F.struct("b.matches", -F.col("at"))).alias("x")
    ).select("key", "x.doc_id", "item_id", "x.matches", "x.doc_start", "x.doc_end")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_matches: int = 13) -> DataFrame:
    """``docs`` without the rows that overlap an item; every column stays, and clean rows stay as they are (null ids and texts too).

    Very long texts are searched whole. Rows of one doc_id and text are kept or go together; rows that share a doc_id only are judged one by one. How many items a row overlaps, and which
    of several equal overlaps is the best, doesn't matter here. An empty benchmark keeps all rows, and an empty table gives none.
    """
    found = find_overlaps(docs, benchmark, min_matches).select(F.col("key").alias("_leak_key")).distinct()
    return docs.join(found, F.xxhash64(docs["doc_id"], docs["text"]) == found["_leak_key"], "left_anti")
