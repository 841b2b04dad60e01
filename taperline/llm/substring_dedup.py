"""Repeated word windows by Rabin-Karp hashes.

Every window of ``length`` words has a rolling hash. Windows are counted in runs: consecutive windows of a document whose least rolling hash of
``anchor`` words (the anchor) is the same make one run, and equal windows have equal anchors, so only runs of one anchor can share a window.
A run that stands elsewhere word for word repeats as a whole; where runs of one anchor differ, the windows of one of each kind are counted
one by one. Repeated windows merge into maximal removal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import numbered, packed, slices, stored

#: Columns that the operator adds; those of the input by these names are replaced.
ADDED = ("n_words", "n_removed", "spans", "kept")

#: Odd multipliers of the two rolling hashes modulo 2 ** 64, and their inverses.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_BACK = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Most words whose hashes a task keeps.
_KEPT_WORDS = 500_000


class Roller:
    """Rolling hashes of texts' words; keeps the hashes of frequent words and the powers of the multipliers."""

    def __init__(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _BASES]

    def _hash(self, word: bytes) -> bytes:
        if len(self.known) >= _KEPT_WORDS:
            self.known.clear()
        h = self.known[word] = xxhash.xxh3_128_digest(word)
        return h

    def sums(self, words: list[bytes]) -> list[np.ndarray]:
        """Running sums of word hash times power, for both multipliers."""
        n, known = len(words), self.known
        both = np.frombuffer(b"".join([known.get(w) or self._hash(w) for w in words]), np.uint64).reshape(n, 2)
        out = []
        for k, (base, back) in enumerate(zip(_BASES, _BACK)):
            if len(self.powers[k][0]) <= n:
                m = 1 << (n + 1).bit_length()
                self.powers[k] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, x, np.uint64))]) for x in (base, back))
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(both[:, k] * self.powers[k][0][:n], out=total[1:])
            out.append(total)
        return out

    def ranges(self, sums: list[np.ndarray], start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
        """The hash of words start to end (exclusive) by multiplier k."""
        return (sums[k][end] - sums[k][start]) * self.powers[k][1][start]


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _find_runs(length: int, anchor: int):
    """Batches of (_rid, _ord, text) to (_rid, _ord, anchor, c1, c2, start, n): runs of n windows from word start on, c1 and c2 their words' hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in slices(batches):
            parts = []
            for i, text in enumerate(batch.column(2)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if len(words) < length:
                    continue
                sums = roller.sums(words)
                at = np.arange(len(words) - anchor + 1)
                h = roller.ranges(sums, at, at + anchor, 0)
                h = (h ^ (h >> np.uint64(32))) * _MIX
                least = least_of(h ^ (h >> np.uint64(29)), length - anchor + 1)
                start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
                n = np.diff(np.append(start, len(least)))
                end = start + n + length - 1
                parts.append((np.full(len(start), i), least[start], roller.ranges(sums, start, end, 0), roller.ranges(sums, start, end, 1), start, n))
            if parts:
                row, least, c1, c2, start, n = (np.concatenate(x) for x in zip(*parts))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), _signed(least), _signed(c1), _signed(c2), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["_rid", "_ord", "anchor", "c1", "c2", "start", "n"],
                )

    return run


def _find_windows(length: int):
    """Batches of (_ord, text, runs) to a row for each window of the runs: _ord, c1, c2, n, off and the window's hashes w1 and w2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in slices(batches):
            for i in range(batch.num_rows):
                words = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass").split()
                sums, runs = roller.sums(words), batch.column(2)[i].values
                first, n = (runs.field(k).to_numpy().astype(np.int64) for k in ("start", "n"))
                which = np.repeat(np.arange(len(n)), n)
                off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                start = first[which] + off
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.full(len(which), i))), runs.field("c1").take(take), runs.field("c2").take(take), runs.field("n").take(take), pa.array(off.astype(np.int32)),
                        _signed(roller.ranges(sums, start, start + length, 0)), _signed(roller.ranges(sums, start, start + length, 1)),
                    ],
                    names=["_ord", "c1", "c2", "n", "off", "w1", "w2"],
                )

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The maximal intervals that half-open intervals cover; those that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[new].tolist(), reach[np.append(new[1:] - 1, len(reach) - 1)].tolist()))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (..., text, cuts) to the same without cuts and with n_words, n_removed, spans and kept."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in slices(batches):
        rest, text, cuts = batch.columns[:-2], batch.columns[-2], batch.columns[-1]
        n_words, n_removed, spans, kept = [], [], [], []
        for x, c in zip(text, cuts):
            words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
            found = merged(c.values.field("start").to_numpy(), c.values.field("end").to_numpy()) if c.is_valid else []
            left, at = [], 0
            for s, e in found:
                left += words[at:s]
                at = e
            left += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            spans.append([{"start": s, "end": e} for s, e in found])
            kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*rest, text, *made], names=[*batch.schema.names[:-1], "n_words", "n_removed", "spans", "kept"])


def removal_windows(docs: DataFrame, length: int = 50, anchor: int = 16) -> DataFrame:
    """(_rid, start, end): word intervals, unmerged, of the windows that start in a document with a smaller _ord as well. docs: _rid, _ord, text.

    A run's distinct wordings are counted by hash before any shuffle of a hot one, and the joins on wordings and windows have one row a key on one side.
    """
    kinds = dict(docs.dtypes)
    runs = stored(
        docs.select("_rid", "_ord", "text").mapInArrow(_find_runs(length, anchor), f"_rid {kinds['_rid']}, _ord {kinds['_ord']}, anchor long, c1 long, c2 long, start int, n int"), "runs"
    )
    wording = ["c1", "c2", "n"]
    first = runs.groupBy("anchor", *wording).agg(F.min(F.struct("_ord", "_rid", "start")).alias("x"), F.count("*").alias("times"))
    first = stored(first.select("anchor", *wording, "x.*", "times"), "wordings")
    # anchors with wordings that begin in different documents
    mixed = first.groupBy("anchor").agg(F.min("_ord").alias("a"), F.max("_ord").alias("b")).where("a < b").select("anchor")
    asked = first.join(mixed, "anchor", "left_semi").groupBy("_rid").agg(F.collect_list(F.struct(*wording, "start")).alias("runs"))
    texts = docs.select("_rid", "_ord", "text").join(asked, "_rid").select("_ord", "text", "runs")
    windows = stored(texts.mapInArrow(_find_windows(length), f"_ord {kinds['_ord']}, c1 long, c2 long, n int, off int, w1 long, w2 long"), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min("_ord").alias("a"), F.max("_ord").alias("b")).where("a < b").select("w1", "w2", "a")
    least = stored(least, "repeated-windows")  # so that the join can split a frequent window
    later = windows.join(least, ["w1", "w2"]).where("a < _ord")
    parts = later.groupBy(*wording).agg(F.collect_list("off").alias("offs"))  # bounded by the wording
    known = first.select(*wording, F.col("_ord").alias("a"), "times").join(parts, wording, "left").where("times > 1 or offs is not null")
    hit = runs.join(stored(known, "repeats"), wording)
    whole = hit.where("a < _ord").select("_rid", "start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    some = hit.where("a = _ord and offs is not null").select("_rid", "start", F.explode("offs").alias("off")).select("_rid", (F.col("start") + F.col("off")).alias("start"))
    return whole.unionByName(some.withColumn("end", F.col("start") + length))


def substring_dedup(docs: DataFrame, length: int = 50, anchor: int = 16) -> DataFrame:
    """``docs`` with n_words, n_removed, spans array<struct<start, end>> of removed words (maximal, numbered from 0) and kept, the words left, joined by one space.

    A word goes if a window of ``length`` words that covers it also starts in a document with a smaller doc_id; windows are judged on the
    input. Words are runs of bytes other than ASCII white space, unchanged. Rows with one doc_id leave each other alone; rows without a doc_id
    come after all others and leave each other alone. Null and empty texts have no words; texts of fewer than ``length`` words lose none; very long texts are
    read whole; an empty table gives no rows; other columns stay, but those that are named as the added ones. ``anchor`` is from 1 to ``length`` and changes no result.
    """
    docs = docs.drop(*ADDED)
    inner = packed(docs)
    whole = dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) if whole else F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    rows = numbered(inner).withColumn("_ord", order)
    cuts = removal_windows(rows, length, anchor).select("_rid", F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).alias("cut")).groupBy("_rid").agg(F.collect_list("cut").alias("cuts"))
    columns = [c for c in inner.columns if c != "text"]  # doc_id and rest
    joined = rows.join(cuts, "_rid", "left").select(*columns, "text", "cuts")
    shape = ", ".join(f"`{c}` {inner.schema[c].dataType.simpleString()}" for c in [*columns, "text"])
    done = joined.mapInArrow(_cut, f"{shape}, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
    return done.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns), *ADDED)
