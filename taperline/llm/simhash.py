"""SimHash near-duplicates by multi-index hashing.

The 64 bits of a fingerprint are cut into segments. Fingerprints within ``distance`` bits agree in some segment up to
``distance // segments`` bits, so every fingerprint is filed in a table under each segment's value and sent to all values
in a small Hamming ball around it. What meets in a table entry is verified on the complete distance. Within an entry, a search
from fingerprint to fingerprint compares with those not yet reached only, so a dense group costs its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import slices, stored

BITS = 64


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of a text: a bit is 1 if set in over half of the XXH64 hashes of its word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    n, k = len(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: n - k + 1].tolist()
    hashed = np.array([xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashed), 8192):
        votes += np.unpackbits(hashed[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(hashed)).astype(np.uint8)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp long) for each row; a null text has no words, and without words the fingerprint is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [fingerprint(x.as_py() or "", shingle, seed) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())], names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long")


def segment_layout(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; widths differ by one at most."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def radii(segments: int, distance: int) -> list[int]:
    """Search radius of each segment. If all of the first distance % segments + 1 segments differ by more than
    distance // segments and the others by as much at least, the whole differs by more than distance."""
    whole, rest = divmod(distance, segments)
    return [whole if i <= rest else whole - 1 for i in range(segments)]


def _balls(segments: int, distance: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(segment, shift, mask, what to flip to get from a value to those in its ball, 0 first)."""
    out = []
    for i, ((at, width), r) in enumerate(zip(segment_layout(segments), radii(segments, distance))):
        if r >= 0:
            flips = [sum(1 << b for b in bits) for k in range(r + 1) for bits in combinations(range(width), k)]
            out.append((i, at, (1 << width) - 1, np.array(flips, np.uint64)))
    return out


def _entries(segments: int, distance: int):
    balls = _balls(segments, distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(every), 2048):
                fp = every[lo : lo + 2048]
                keys, probe = [], []
                for i, at, mask, flips in balls:
                    own = (fp.view(np.uint64) >> np.uint64(at)) & np.uint64(mask)
                    keys.append(((own[:, None] ^ flips[None, :]) | np.uint64(i << 58)).ravel())
                    probe.append(np.tile(np.arange(len(flips)) > 0, len(fp)))
                fps = np.concatenate([np.repeat(fp, len(f)) for _, _, _, f in balls])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(probe)), pa.array(fps)], names=["entry", "probe", "fp"])

    return run


def links_within(filed: np.ndarray, probes: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what is connected in one table entry: among ``filed``, and between them and ``probes``.

    Every filed fingerprint starts or continues a search; a probe is tied to each connected part it touches.
    """
    found, open_ = [], filed
    while len(open_):
        part, open_ = open_[:1], open_[1:]
        edge = part
        reached = [part]
        while len(edge) and len(open_):
            x, edge = edge[0], edge[1:]
            near = np.bitwise_count(open_ ^ x) <= distance
            if near.any():
                got, open_ = open_[near], open_[~near]
                found += [(int(x), int(y)) for y in got]
                edge = np.concatenate([edge, got])
                reached.append(got)
        if len(probes):
            left = probes
            for x in np.concatenate(reached):
                near = np.bitwise_count(left ^ x) <= distance
                if near.any():
                    found += [(int(x), int(y)) for y in left[near]]
                    left = left[~near]
                if not len(left):
                    break
    return found


def _matches(distance: int):
    """Over rows sorted by (entry, probe): the links of each entry, entry after entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def groups(cols: list[np.ndarray]) -> pa.RecordBatch:
            entry, probe, fp = cols
            first = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
            size = np.diff(np.r_[first, len(entry)])
            found: list[tuple[int, int]] = []
            use = (size > 1) & ~probe[first]  # an entry in which nothing is filed has probes only
            pair = first[use & (size == 2)]
            near = pair[np.bitwise_count((fp[pair] ^ fp[pair + 1]).view(np.uint64)) <= distance]
            found += list(zip(fp[near].view(np.uint64).tolist(), fp[near + 1].view(np.uint64).tolist()))
            use &= size > 2
            for a, n in zip(first[use].tolist(), size[use].tolist()):
                filed, x = int(n - probe[a : a + n].sum()), fp[a : a + n].view(np.uint64)
                found += links_within(x[:filed], x[filed:], distance)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last entry may go on in the next batch
            if last:
                yield groups([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None:
            yield groups(held)

    return run


#: Distinct fingerprints from which 2 segments are cheaper than 3: at 3 an entry then holds about 180 unrelated ones, at 2 about 2.
MANY = 1 << 24


def near_links(fps: DataFrame, distance: int = 4, segments: int | None = None) -> DataFrame:
    """(u, v): links between distinct fingerprints that join exactly those that paths of links of ``distance`` bits or fewer join.

    Every number of segments gives the same groups. By default 3 (a ball of 22 or 23 entries a segment), and from MANY fingerprints on 2 (balls of 529
    entries, but two thousand times as many of them to meet in), so that entries stay small: within one, unrelated fingerprints are all compared.
    """
    if segments is None:
        segments = 3 if fps.count() < MANY else 2
    sent = fps.select("fp").mapInArrow(_entries(segments, distance), "entry long, probe boolean, fp long")
    return sent.repartition("entry").sortWithinPartitions("entry", "probe").mapInArrow(_matches(distance), "u long, v long").distinct()


def simhash_groups(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, segments: int | None = None) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id): one row per row of ``docs``.

    text_hash is Spark's xxhash64 of the text; component is the least fingerprint of the group, component_id its least doc_id. Equal fingerprints always link; texts without words
    share fingerprint 0. A null doc_id gets its row but never is a component_id, unless all of the group are null. Repeated
    rows are each returned. Very long texts are hashed whole. An empty table gives no rows. Columns besides doc_id and text are not read.
    """
    fps = stored(fingerprints(docs, shingle, seed), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tied = stored(components(near_links(least, distance, segments)), "fp-components")
    grouped = tied.join(least, tied["node"] == least["fp"]).select("fp", "component", "least")
    groups = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = grouped.select("fp", "component").join(groups, "component")
    alone = least.join(tied, least["fp"] == tied["node"], "left_anti").select("fp", F.col("fp").alias("component"), F.col("least").alias("component_id"))
    return fps.join(linked.unionByName(alone), "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def hexed(fp):
    """16 lower-case hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one_each(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, segments: int | None = None) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id and, where ids are null or repeat, of the least text_hash."""
    groups = stored(simhash_groups(docs, distance, shingle, seed, segments), "simhash-groups").where("doc_id <=> component_id")
    kept = stored(groups.groupBy("component").agg(F.min("text_hash").alias("_hash"), F.first("component_id").alias("_id")).select("_id", "_hash"), "kept")
    rows = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_hash"]), "left_semi")
    # equal rows can be left only where an id and text occur twice
    twice = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    return rows if twice.isEmpty() else rows.dropDuplicates(["doc_id", "text"])
