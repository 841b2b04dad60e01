"""Near-duplicates by exact similarity of word shingles.

Candidates come from SimHash components and from bands of MinHash values; both only name buckets of texts that may be near. In
every bucket a search from text to text compares the sets of shingles themselves, with those not yet reached that share a leading shingle only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import fingerprint, near_links
from .tables import slices, stored

#: A pair of Jaccard similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_TIMES, _PLUS = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1]


def shingles(text: str, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 hashes of the word shingles of a text, ascending; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z only
    k = min(shingle, len(words))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), seed) for i in range(len(words) - k + 1 if words else 0)], np.uint64))


def bands(held: np.ndarray) -> list[int]:
    """A signed 64-bit hash of each band of a set's MinHash values; none for an empty set."""
    if not len(held):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(held), 2048):
        least = np.minimum(least, (held[i : i + 2048, None] * _TIMES + _PLUS).min(axis=0))
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) - (1 << 63) for b in range(BANDS)]


def _sketches(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x.as_py() or "" for x in batch.column(2)]
            sets = [shingles(x, shingle, seed) for x in texts]
            made = [
                batch.column(0),
                batch.column(1),
                pa.array([fingerprint(x, shingle, seed) for x in texts], pa.int64()),
                pa.array([xxhash.xxh64_intdigest(s.tobytes(), seed) - (1 << 63) for s in sets], pa.int64()),
                pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "text_hash", "fp", "set", "bands"])

    return run


def _sets(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [shingles(x.as_py() or "", shingle, seed).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["set", "held"])

    return run


def similar_links(ids: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of a Jaccard similarity of ``least`` or more that join exactly those that paths of such links join.

    Sets are ascending. Two sets that are so alike share one of the first len - ceil(least * len) + 1 elements of each, so a search from set to set only compares with those not yet
    reached that are listed under one of these elements: unrelated sets of a bucket are never compared, and a dense group costs its size.
    """
    first = [s[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1].tolist() or [-1] for s in sets]  # empty sets are alike
    listed: dict[int, list[int]] = {}
    for i, tokens in enumerate(first):
        for t in tokens:
            listed.setdefault(t, []).append(i)
    found, reached = [], [False] * len(ids)
    for start in range(len(ids)):
        if reached[start]:
            continue
        reached[start], edge = True, [start]
        while edge:
            at = edge.pop()
            a, tried = sets[at], set()
            for t in first[at]:
                if t not in listed:
                    continue
                left = listed[t] = [i for i in listed[t] if not reached[i]]
                if not left:
                    del listed[t]
                for i in left:
                    if i in tried:
                        continue
                    tried.add(i)
                    b = sets[i]
                    if min(len(a), len(b)) >= least * max(len(a), len(b)):
                        both = len(np.intersect1d(a, b, assume_unique=True))
                        if both >= least * (len(a) + len(b) - both):
                            found.append((ids[at], ids[i]))
                            reached[i] = True
                            edge.append(i)
    return found


def _searched(least: float):
    """Over rows sorted by bucket: the links of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def links() -> pa.RecordBatch:
            ends = np.array(similar_links(ids, sets, least), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

        for batch in batches:
            for bucket, i, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if bucket != now:
                    if len(ids) > 1:
                        yield links()
                    now, ids, sets = bucket, [], []
                ids.append(i)
                sets.append(np.frombuffer(held.as_py(), np.uint64))
        if len(ids) > 1:
            yield links()

    return run


def keep_one_similar(docs: DataFrame, least: float = 0.8, shingle: int = 5, seed: int = 42, distance: int = 4, segments: int | None = None) -> DataFrame:
    """``docs`` with one row of each group that links of a shingle similarity of ``least`` or more join: that of the least doc_id and,
    where ids are null or repeat, of the least text_hash.

    ``distance`` and ``segments`` are of the SimHash candidates only; each link is checked on the shingles. Texts without words are one group, and very
    long ones are read whole. Extra columns stay. An empty table gives no rows.
    """
    made = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        _sketches(shingle, seed), f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long, set long, bands array<long>"
    )
    made = stored(made, "sketches")
    sets = stored(made.groupBy("set").agg(F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "sets")
    tied = stored(components(near_links(sets.select("fp").distinct(), distance, segments)), "fp-components")
    of_simhash = sets.join(tied, sets["fp"] == tied["node"], "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp")).alias("bucket"), "set")
    rows = stored(of_simhash.unionByName(sets.select(F.explode("bands").alias("bucket"), "set")), "buckets")
    # buckets that hold the same texts are searched once
    same = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("set").alias("a"), F.max("set").alias("b"), F.bit_xor(F.xxhash64("set")).alias("c"), F.bit_xor(F.xxhash64("set", F.lit(1))).alias("d"))
    once = same.where("n > 1").groupBy("n", "a", "b", "c", "d").agg(F.min("bucket").alias("bucket")).select("bucket")
    asked = stored(rows.join(once, "bucket", "left_semi"), "asked")
    wanted = sets.join(asked.select("set").distinct(), "set", "left_semi").select("set", "text_hash")
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(wanted, "text_hash").groupBy("set").agg(F.first("text").alias("text"))
    held = stored(texts.mapInArrow(_sets(shingle, seed), "set long, held binary"), "held")
    searched = asked.join(held, "set").select("bucket", "set", "held").repartition("bucket").sortWithinPartitions("bucket")
    groups = stored(components(searched.mapInArrow(_searched(least), "u long, v long")), "set-components")
    grouped = made.join(groups, made["set"] == groups["node"], "left").select("doc_id", "text_hash", F.coalesce("component", "set").alias("component"))
    # of each group the least doc_id that is not null, then its least text_hash
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("x")
    kept = stored(grouped.groupBy("component").agg(first).select(F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_hash")), "kept")
    here = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_hash"]), "left_semi")
    # equal rows can be left only where an id and text occur twice
    twice = made.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    return here if twice.isEmpty() else here.dropDuplicates(["doc_id", "text"])
