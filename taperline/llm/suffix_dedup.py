"""Repeated passages by suffix arrays and longest-previous-factor arrays.

Two equal strings of ``length`` bytes have the same least hash among their anchor windows. Start positions are therefore dealt out
by that hash: a run of starts whose least hash lies at the same place, and the bytes that their strings cover, is a piece. Pieces whose hash
occurs once can hold no repeat. Of the others, equal pieces repeat as a whole, and the first of each is sorted into a suffix array with the
other pieces of its hash. There the previous and next smaller (or greater) positions in suffix order give the longest earlier (or later)
factor of each start, and its length decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import numbered, slices, stored, unstored

#: Bytes of an anchor window, for strings of 200 bytes or more; two fifths of shorter strings.
ANCHOR = 80
#: Shortest strings that can be asked for.
SHORTEST = 40
#: Bytes of texts hashed at a time; bytes in a suffix array, unless one hash has more.
CHUNK, ARRAY = 1 << 19, 1 << 20
#: Low bits of a hash that make room for the place, so that the leftmost of equal hashes is the least; longer texts are hashed in parts.
PLACE_BITS = 21
_B = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240117).integers(0, 2**64, 256, dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def anchor_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width``-byte string."""
    parts: list[tuple[int, np.ndarray]] = []
    now, size, rest = _TABLE[raw], 1, width
    while True:
        if rest & size:
            parts.append((size, now))
        if 2 * size > width:
            break
        now, size = now[:-size] * _power(size) + now[size:], 2 * size
    n = len(raw) - width + 1
    out, at = np.zeros(n, np.uint64), 0
    for size, part in parts:
        out = out * _power(size) + part[at : at + n]
        at += size
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    now, size = x, 1
    while 2 * size <= width:
        now, size = np.minimum(now[:-size], now[size:]), 2 * size
    return np.minimum(now[: len(x) - width + 1], now[width - size :]) if size < width else now


def pieces(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(key, text, first start, number of starts) of the pieces of some texts, of 2 ** PLACE_BITS bytes in all at most."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none, none
    width = min(ANCHOR, 2 * length // 5)
    hashed = anchor_hashes(raw, width)
    low = np.uint64((1 << PLACE_BITS) - 1)
    place = (sliding_min(hashed & ~low | np.arange(len(hashed), dtype=np.uint64), length - width + 1) & low).astype(np.int64)
    sizes = np.array([len(x) for x in texts])
    ends = np.cumsum(sizes)
    first = np.zeros(len(place) + 1, bool)
    first[0] = True
    first[1:-1] = place[1:] != place[:-1]
    first[(ends - sizes)[(ends - sizes) <= len(place)]] = True
    stops = ends - length + 1  # after a text's last start
    first[stops[(sizes >= length) & (stops <= len(place))]] = True
    a = np.flatnonzero(first[:-1])
    n = np.diff(np.r_[a, len(place)])
    text = np.searchsorted(ends, a, side="right")
    keep = a + length <= ends[text]
    a, n, text = a[keep], n[keep], text[keep]
    return hashed[place[a]], text, a - (ends - sizes)[text], n


def _dealt(length: int):
    def one(batch: pa.RecordBatch, texts: list[bytes], owner: list[int], offset: list[int]) -> pa.RecordBatch:
        key, text, start, n = pieces(texts, length)
        body = [xxhash.xxh3_64_intdigest(texts[t][a : a + m]) for t, a, m in zip(text.tolist(), start.tolist(), (n + length - 1).tolist())]
        ids = batch.column(0).take(pa.array(np.array(owner)[text]))
        # equal pieces of one text, if near enough, need not meet others: all but the first repeat it
        seen = np.zeros(len(body), [("text", np.int64), ("body", np.uint64)])
        seen["text"], seen["body"] = np.array(owner)[text], body
        _, first, copies = np.unique(seen, return_index=True, return_counts=True)
        again, twice = np.ones(len(body), bool), np.zeros(len(body), bool)
        again[first] = False
        twice[first] = copies > 1
        start = start + np.array(offset)[text]
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(np.array(body, np.uint64).view(np.int64)), ids, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again), pa.array(twice)],
            names=["key", "body", "rid", "start", "n", "again", "twice"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[bytes] = []
            owner: list[int] = []
            offset: list[int] = []
            size = 0
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_buffer().to_pybytes()
                for at in range(0, len(raw) - length + 1, CHUNK):
                    texts.append(raw[at : at + CHUNK + length - 1])
                    owner.append(i)
                    offset.append(at)
                    size += len(texts[-1])
                    if size >= CHUNK:
                        yield one(batch, texts, owner, offset)
                        texts, owner, offset, size = [], [], [], 0
            if texts:
                yield one(batch, texts, owner, offset)

    return run


def suffix_order(word: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The places in ``starts`` (ascending) in the order of their strings of ``length`` bytes; equal strings by place.

    ``word`` has the next 8 bytes of every position, as numbers. What is tied after some bytes is sorted by as many more as fit beside the
    number of its group. Now and then groups are compared with their first string directly, so that equal strings need no more rounds.
    """
    first = word[starts]
    order = np.argsort(first, kind="stable")
    first = first[order]
    head = np.r_[True, first[1:] != first[:-1]] if len(order) else np.zeros(0, bool)
    depth, rounds = 8, 0
    slots = np.flatnonzero(~(head & np.r_[head[1:], True])) if len(order) else np.zeros(0, np.int64)
    while len(slots) and depth < length:
        begins = head[slots]
        group = np.cumsum(begins) - 1
        at = starts[order[slots]]
        if rounds % 8 == 3:
            lead = at[np.flatnonzero(begins)][group]
            same = np.ones(len(slots), bool)
            for d in range(depth, length, 8):
                same &= word[at + min(d, length - 8)] == word[lead + min(d, length - 8)]
            settled = np.bincount(group[~same], minlength=int(group[-1]) + 1) == 0
            for_more = ~settled[group]
            slots, group, at, begins = slots[for_more], group[for_more], at[for_more], begins[for_more]
            if not len(slots):
                break
            group = np.cumsum(begins) - 1
        size = min(8, (64 - int(group[-1]).bit_length()) // 8, length - depth)
        key = word[at + depth] >> np.uint64(64 - 8 * size)
        if size < 8:
            key |= group.astype(np.uint64) << np.uint64(8 * size)
        by = np.argsort(key, kind="stable")
        order[slots] = order[slots][by]
        key = key[by]
        head[slots[1:]] |= key[1:] != key[:-1]
        slots = slots[~(head[slots] & np.r_[head, True][slots + 1])]
        depth, rounds = depth + size, rounds + 1
    return order


def common_prefix(word: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many of their next bytes, ``length`` at most, the positions a and b have in common; 0 where one of them is negative."""
    out = np.zeros(len(a), np.int32)
    open_ = np.flatnonzero((a >= 0) & (b >= 0))
    for d in range(0, length, 8):
        if not len(open_):
            break
        other = word[a[open_] + d] ^ word[b[open_] + d]
        same = other == 0
        ends = open_[~same]
        # leading zero bytes of the difference
        rest = other[~same]
        more = np.zeros(len(rest), np.int32)
        for k in range(1, 8):
            more += rest < np.uint64(1 << (64 - 8 * k))
        out[ends] = np.minimum(d + more, length)
        open_ = open_[same]
    out[open_] = length
    return out


def smaller_neighbours(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For positions in suffix order, the indices of the previous and the next smaller one; -1 and len(place) where none is."""

    def previous(x: np.ndarray) -> np.ndarray:
        """By a tree of minima: up until a left neighbour's minimum is smaller, then down to the last smaller place below it."""
        least = [x]
        while len(least[-1]) > 1:
            low = least[-1] if len(least[-1]) % 2 == 0 else np.append(least[-1], np.iinfo(x.dtype).max)
            least.append(np.minimum(low[::2], low[1::2]))
        at = np.full(len(x), -1)
        node, open_ = np.arange(len(x)), np.arange(len(x))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for low in least[:-1]:
            beside = (node & 1 == 1) & (low[node - 1] < x[open_])
            found.append((open_[beside], node[beside] - 1))
            open_, node = open_[~beside], node[~beside] >> 1
        open_, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for level in range(len(found) - 1, -1, -1):
            open_, node = np.r_[open_, found[level][0]], np.r_[node, found[level][1]]
            if level:
                low = least[level - 1]
                right = np.minimum(2 * node + 1, len(low) - 1)
                node = np.where(low[right] < x[open_], right, 2 * node)
        at[open_] = node
        return at

    return previous(place), len(place) - 1 - previous(place[::-1])[::-1]


def longest_factors(word: np.ndarray, starts: np.ndarray, length: int, later: bool = False) -> np.ndarray:
    """The longest-previous-factor array of ``starts``: how many bytes, ``length`` at most, each has in common with the string at an earlier
    start that has most; with ``later``, at a later start."""
    order = suffix_order(word, starts, length)
    place = starts[order]
    before, after = smaller_neighbours(place if not later else -place + (place.max() if len(place) else 0))
    padded = np.r_[place, -1]
    previous = common_prefix(word, place, padded[before], length)
    following = common_prefix(word, place, padded[np.where(after < len(place), after, -1)], length)
    out = np.zeros(len(starts), np.int32)
    out[order] = np.maximum(previous, following)
    return out


def words_at(raw: np.ndarray) -> np.ndarray:
    """The next 8 bytes of every position as numbers, the first byte the highest; zeros beyond the end, and 8 more numbers of them."""
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    n = len(raw) + 8
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    return word


def repeats(found: list[tuple[int, int, bytes]], length: int, keep: str) -> tuple[np.ndarray, ...]:
    """(rid, begin, end) of what the strings that repeat among some pieces (rid, start, bytes) cover.

    keep "none": with any other match; "first": with an earlier one, by (rid, start).
    """
    found = sorted(found, key=lambda x: x[:2])
    sizes = np.array([len(x[2]) for x in found])
    ends = np.cumsum(sizes)
    word = words_at(np.frombuffer(b"".join(x[2] for x in found), np.uint8))
    starts = np.concatenate([np.arange(b - s, b - length + 1) for b, s in zip(ends, sizes)])
    longest = longest_factors(word, starts, length)
    if keep == "none":
        longest = np.maximum(longest, longest_factors(word, starts, length, later=True))
    at = starts[longest >= length]
    which = np.searchsorted(ends, at, side="right")
    begin = at - (ends - sizes)[which] + np.array([x[1] for x in found], np.int64)[which]
    first = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (begin[1:] != begin[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(at)] - 1 if len(at) else first
    rid = np.array([x[0] for x in found], np.int64)
    return rid[which[first]], begin[first], begin[last] + length


def _arrays(length: int, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None

        def done() -> pa.RecordBatch:
            cols = repeats(held, length, keep)
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names=["rid", "begin", "end"])

        for batch in batches:
            for key, rid, start, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if size >= ARRAY and key != last:
                    yield done()
                    held, size = [], 0
                held.append((rid, start, raw))
                size, last = size + len(raw), key
        if held:
            yield done()

    return run


def _strings(length: int):
    """For keys with very many pieces: a row for each start, with two hashes of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                raws = part.column(3).to_pylist()
                sizes = [len(r) - length + 1 for r in raws]
                got = [xxhash.xxh3_128_digest(r[k : k + length]) for r, n in zip(raws, sizes) for k in range(n)]
                begin = np.concatenate([np.arange(s, s + n, dtype=np.int64) for s, n in zip(part.column(2).to_pylist(), sizes)])
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), part.column(1).take(pa.array(np.repeat(np.arange(len(raws)), sizes))), pa.array(begin)], names=["h", "rid", "begin"])

    return run


def _slices(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_buffer().to_pybytes()
                cut = batch.column(2)[i].values
                starts, n = cut.field("start").to_numpy(), cut.field("n").to_numpy()
                got = [raw[a : a + m + length - 1] for a, m in zip(starts.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [cut.field("key"), pa.array(np.full(len(got), batch.column(0)[i].as_py(), np.int64)), cut.field("start"), pa.array(got, pa.binary()), cut.field("hot")], names=["key", "rid", "start", "raw", "hot"]
                )

    return run


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of a union of spans; those that touch become one."""
    order = np.argsort(begin, kind="stable")
    begin, far = begin[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, begin[1:] > far[:-1]])
    return begin[first], far[np.r_[first[1:], len(begin)] - 1]


def repeated_spans(rows: DataFrame, length: int, keep: str, hot_pieces: int) -> DataFrame:
    """(rid, begin, end): spans, which may overlap, of the bytes of ``rows`` (rid long, text) that a repeated string covers."""
    shape = "key long, body long, rid long, start int, n int, again boolean, twice boolean"
    dealt = stored(rows.where(F.octet_length("text") >= length).select("rid", F.col("text").cast("binary").alias("text")).mapInArrow(_dealt(length), shape), "pieces")
    # counts are added up before they are shuffled, and written, so that the joins on them can split a skewed key
    once = dealt.where("not again")
    shared = stored(once.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "shared-keys")
    live = stored(once.join(shared, "key", "left_semi").drop("again", "twice"), "shared-pieces")
    bodies = stored(live.groupBy("key", "body").agg(F.count("*").alias("copies"), F.min("rid").alias("first")).where("copies > 1"), "shared-bodies")
    whole = F.col("copies").isNotNull() if keep == "none" else F.col("first") < F.col("rid")
    lead = F.coalesce("first", "rid") == F.col("rid")
    flagged = live.join(bodies, ["key", "body"], "left").select("key", "rid", "start", "n", F.coalesce(whole, F.lit(False)).alias("whole"), lead.alias("lead")).where("whole or lead")
    within = dealt.where("again or twice" if keep == "none" else "again").select("key", "rid", "start", "n", F.lit(True).alias("whole"), F.lit(False).alias("lead"))
    marked = stored(flagged.unionByName(within), "marked-pieces")
    for t in (dealt, live, shared, bodies):
        unstored(t)
    lead = marked.where("lead")
    met = lead.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", (F.col("m") > hot_pieces).alias("hot"))
    asked = lead.join(met, "key").groupBy("rid").agg(F.collect_list(F.struct("key", "start", "n", "hot")).alias("cut"))  # bounded by the text
    raw = stored(rows.join(asked, "rid").select("rid", F.col("text").cast("binary").alias("text"), "cut").mapInArrow(_slices(length), "key long, rid long, start int, raw binary, hot boolean"), "piece-bytes")
    found = raw.where("not hot").select("key", "rid", "start", "raw").repartition("key").sortWithinPartitions("key").mapInArrow(_arrays(length, keep), "rid long, begin long, end long")
    pieces_ = marked.where("whole").select("rid", F.col("start").cast("long").alias("begin"), (F.col("start").cast("long") + F.col("n") + length - 1).alias("end"))
    out = pieces_.unionByName(found)
    if raw.where("hot").isEmpty():
        return out
    each = stored(raw.where("hot").select("key", "rid", "start", "raw").mapInArrow(_strings(length), "h binary, rid long, begin long"), "hot-strings")
    within = each.groupBy("h", "rid").agg(F.count("*").alias("n"), F.min("begin").alias("at"))
    over = within.groupBy("h").agg(F.sum("n").alias("copies"), F.min("rid").alias("first")).where("copies > 1")
    strings = each.join(over, "h")
    if keep == "first":
        strings = strings.join(within.select("h", "rid", "at"), ["h", "rid"]).where("rid > first or begin > at")
    return out.unionByName(strings.select("rid", "begin", (F.col("begin") + length).alias("end")))


def suffix_dedup(docs: DataFrame, length: int = 200, keep: str = "first", hot_pieces: int = 4096, characters: bool = False) -> DataFrame:
    """``docs`` with spans array<struct<begin, end>> (maximal runs of bytes to remove) and kept binary (what is left) added; with ``characters`` kept is a string: what is
    left if each span is shrunk to whole characters.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else ("none") or earlier ("first": by doc_id, then
    position; where ids are null or repeat, in the order in which rows are read). Strings never cross rows, and are judged on the input.
    Null text: empty. Texts under ``length`` bytes stay whole; very long ones are hashed in parts. An empty table gives no rows. Columns spans,
    kept, _rid and _raw_spans of the input are replaced; all others stay. Repeated rows are copies of each other. A hash with more than
    ``hot_pieces`` different pieces has its strings counted by their 128-bit hashes instead of sorted in one task: the result is the same.
    """
    if length < SHORTEST or keep not in ("first", "none"):
        raise ValueError(f"length must be {SHORTEST} or more, and keep first or none")
    docs = docs.drop("spans", "kept", "_rid", "_raw_spans")
    rows = numbered(docs)
    text = F.coalesce("text", F.lit(""))
    spans = repeated_spans(rows.select(F.col("_rid").alias("rid"), text.alias("text")), length, keep, hot_pieces)
    per = spans.groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("_raw_spans")).withColumnRenamed("rid", "_rid")  # bounded by the text
    joined = rows.join(per, "_rid", "left").drop("_rid")
    kept = joined.drop("_raw_spans")
    at = [*kept.columns].index("text")
    shape = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given = batch.column(batch.num_columns - 1)
            out_spans, out_kept = [], []
            for i in range(batch.num_rows):
                raw = batch.column(at)[i].as_buffer()
                raw = raw.to_pybytes() if raw is not None else b""
                if not given[i].is_valid:
                    out_spans.append([])
                    out_kept.append(raw)
                    continue
                b, e = (x.tolist() for x in merged(given[i].values.field("begin").to_numpy(), given[i].values.field("end").to_numpy()))
                out_spans.append([{"begin": x, "end": y} for x, y in zip(b, e)])
                if characters:
                    b, e = zip(*(whole_characters(raw, x, y) for x, y in zip(b, e)))
                out_kept.append(b"".join(raw[x:y] for x, y in zip([0, *e], [*b, len(raw)])))
            kind = pa.string() if characters else pa.binary()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out_spans, shape), pa.array(out_kept, pa.binary()).cast(kind)], names=[*batch.schema.names[:-1], "spans", "kept"])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema]
    return joined.select(*kept.columns, "_raw_spans").mapInArrow(cut, ", ".join([*types, "spans array<struct<begin:bigint,end:bigint>>", f"kept {'string' if characters else 'binary'}"]))


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])


def whole_characters(raw: bytes, begin: int, end: int) -> tuple[int, int]:
    """A span of UTF-8 bytes without the parts of characters at its ends."""
    while begin < end and raw[begin] & 0xC0 == 0x80:
        begin += 1
    while end > begin and end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return begin, end
