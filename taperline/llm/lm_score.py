"""Language-model scores by deleted interpolation of word bigrams and unigrams.

P(w | previous) = L * P2 + (1 - L) * P1: the maximum-likelihood bigram and the maximum-likelihood unigram beside a share for unknown words. L
is the weight of the frequency bucket of the context (the previous word), learned by expectation-maximisation on the counts of a
deleted fold. Every word and every pair of words has its own count; nothing is pruned or folded into classes.

Texts are tokenised once, into chunks of numbers. A chunk asks for the counts of its distinct words and pairs: they are dealt out by hash,
added up where they meet, and sent back to the chunk, so a frequent word costs one entry a chunk, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import numbered, stored

#: Tokens in a chunk: what a task holds. Only a longer text makes a larger one.
CHUNK = 2_000_000
#: Bytes of texts tokenised at a time; only a longer word takes more.
BLOCK = 1 << 20
#: Words and pairs, at a guess, that are added up at a time.
PART = 1_500_000
SMOOTH = 0.1
#: Ratios of bigram to unigram are learned from in bins of about 5 percent.
BINS = 20.0

_TABLE = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=np.uint64)
#: A-Z as a-z, and all white space as a space.
_PLAIN = bytes(0x20 if 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_B = 0x9E3779B97F4A7C15
#: Numbers of what is no word: the end of a text (a token), and its start (a context only).
END, START = np.uint64(0x51A3C0DE00000001), np.uint64(0x51A3C0DE00000002)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_keys(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, first bytes) of the words between the spaces of ``plain``, which ends with one."""
    found, at = [], 0
    while at < len(plain):
        end = plain.rfind(b" ", at, at + BLOCK) + 1 or plain.find(b" ", at) + 1
        keys, starts = _hashed(plain[at:end])
        found.append((keys, starts + at))
        at = end
    return tuple(map(np.concatenate, zip(*found)))


def _hashed(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(plain, np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, buf == 0x20]))
    starts, ends = edge[::2], edge[1::2]
    if not _cache or len(_cache[0]) < len(buf):
        _cache[:] = [_powers(_B, len(buf)), _powers(pow(_B, -1, 1 << 64), len(buf))]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * _cache[0][: len(buf)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _cache[1][starts] + (ends - starts).astype(np.uint64)), starts


_cache: list[np.ndarray] = []


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens, each text's end among them; numbers of tokens of the texts)."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    keys, starts = word_keys(b" ".join([*texts, b""]).translate(_PLAIN))
    of = np.searchsorted(offsets, starts, side="right") - 1
    sizes = np.bincount(of, minlength=len(texts)) + 1
    out = np.full(len(keys) + len(texts), END)
    out[np.arange(len(keys)) + of] = keys
    return out, sizes


_ROW = "chunk long, part int, deleted boolean, tokens long, trained long, b0 binary, b1 binary, b2 binary, b3 binary, b4 binary"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_FIRST = _NAMES.index("b0")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of rows (chunk, part, deleted, tokens, trained, blobs...)."""
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    cols = zip(*((*r, *[b""] * (len(types) - len(r))) for r in rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_NAMES)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, fold, text) to a row for each chunk: rids, whether trained on, sizes, distinct words' hashes, each token's place among them.

    Texts of the deleted fold (1) are in chunks of their own.
    """
    task = TaskContext.get()
    first, made = (task.partitionId() if task else 0) << 32, 0
    held: dict[bool, list] = {False: [[], [], [], [], 0], True: [[], [], [], [], 0]}

    def done(deleted: bool) -> pa.RecordBatch:
        nonlocal made
        rids, train, sizes, keys, n = held[deleted]
        held[deleted] = [[], [], [], [], 0]
        known, word = np.unique(np.concatenate(keys), return_inverse=True)
        made += 1
        blobs = [np.array(rids, np.int64), np.array(train, np.uint8), np.concatenate(sizes).astype(np.int32), known, word.astype(np.int32)]
        return _rows([(first + made, -1, deleted, n, int(blobs[2][blobs[1] != 0].sum()), *(b.tobytes() for b in blobs))])

    def put(deleted: bool, rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        at = held[deleted]
        keys, sizes = token_keys([t for *_, t in rows])
        at[0] += [r for r, *_ in rows]
        at[1] += [f != 0 for _, f, _ in rows]
        at[2].append(sizes)
        at[3].append(keys)
        at[4] += len(keys)
        if at[4] >= CHUNK:
            yield done(deleted)

    for batch in batches:
        waiting: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}
        for i in range(batch.num_rows):
            raw = batch.column(2)[i].as_buffer()
            raw = raw.to_pybytes() if raw is not None else b""
            fold = batch.column(1)[i].as_py()
            k = fold == 1
            waiting[k].append((batch.column(0)[i].as_py(), fold, raw))
            size[k] += len(raw)
            if size[k] >= BLOCK:
                yield from put(k, waiting[k])
                waiting[k], size[k] = [], 0
        for k in (False, True):
            if waiting[k]:
                yield from put(k, waiting[k])
    for k in (False, True):
        if held[k][4]:
            yield done(k)


@dataclass
class Grams:
    """A chunk's distinct words (hashes ascending) and pairs (in the order of their own hashes), and where each token's are among them."""

    rids: np.ndarray
    train: np.ndarray  # of each token
    sizes: np.ndarray
    words: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    before: np.ndarray  # of each pair its context's place among the words; their number for the start
    after: np.ndarray

    @classmethod
    def of(cls, blobs: list[bytes]) -> Grams:
        rids, train, sizes, words, word = (np.frombuffer(b, t) for b, t in zip(blobs, (np.int64, np.uint8, np.int32, np.uint64, np.int32)))
        previous = np.empty(len(word), np.int64)
        previous[1:] = word[:-1]
        previous[np.cumsum(sizes) - sizes] = len(words)
        local, pair = np.unique(previous * len(words) + word, return_inverse=True)
        before, after = np.divmod(local, len(words))
        pairs = _mixed(np.append(words, START)[before] * np.uint64(0xFF51AFD7ED558CCD) + words[after])
        order = np.argsort(pairs)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(rids, np.repeat(train, sizes) != 0, sizes, words, word, pairs[order], place[pair], before[order], after[order])


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins among ascending hashes, and the end."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def packed_counts(n: np.ndarray) -> bytes:
    """Counts, most of them small: one byte each, and the rest in full before them."""
    large = n >= 255
    rest = n[large].astype("<u8")
    return np.uint64(len(rest)).tobytes() + rest.tobytes() + np.where(large, 255, n).astype(np.uint8).tobytes()


def counts_of(raw: bytes) -> np.ndarray:
    many = int(np.frombuffer(raw, "<u8", 1)[0])
    out = np.frombuffer(raw, np.uint8, offset=8 + 8 * many).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", many, 8)
    return out


def _asked(parts: int):
    """From each chunk to each part: words' hashes and training counts, pairs' hashes and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, deleted = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                g = Grams.of([batch.column(_FIRST + k)[i].as_py() for k in range(5)])
                uses = [np.bincount(x[g.train], minlength=len(k)) for x, k in ((g.word, g.words), (g.pair, g.pairs))]
                cuts = [_cuts(k, parts) for k in (g.words, g.pairs)]
                rows = []
                for p in range(parts):
                    (a, b), (c, d) = ((x[p], x[p + 1]) for x in cuts)
                    if b > a or d > c:
                        rows.append((chunk, p, deleted, 0, 0, g.words[a:b].tobytes(), packed_counts(uses[0][a:b]), g.pairs[c:d].tobytes(), packed_counts(uses[1][c:d])))
                yield _rows(rows)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _asked sorted by part to the same rows with sums: all training counts of words and pairs, and those but of the deleted
    fold (for its chunks). A row of chunk -1 has the numbers of distinct words and of the deleted fold's tokens whose word is not seen elsewhere."""
    now, held = None, []

    def done() -> pa.RecordBatch:
        chunks, deleted, *blobs = zip(*held)
        away = np.array(deleted)
        sums, kinds, new = [], 0, 0
        for k in (0, 2):
            keys = [np.frombuffer(b, np.uint64) for b in blobs[k]]
            counts = [counts_of(b) for b in blobs[k + 1]]
            of = np.repeat(away, [len(x) for x in keys])
            _, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.concatenate(counts)
            total = np.bincount(back, weights=n).astype(np.int64)
            kept = np.bincount(back, weights=np.where(of, 0, n), minlength=len(total)).astype(np.int64)
            ends = np.cumsum([len(x) for x in keys])[:-1]
            sums += [np.split(total[back], ends), np.split(kept[back], ends)]
            if k == 0:
                kinds, new = int((total > 0).sum()), int(total[kept == 0].sum())
        rows = [(c, now, deleted[i], 0, 0, *(packed_counts(sums[k][i]) for k in ((0, 2, 1, 3) if deleted[i] else (0, 2)))) for i, c in enumerate(chunks)]
        return _rows([*rows, (-1, now, False, 0, 0, np.array([kinds, new], np.int64).tobytes())])

    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.column(1)[i].as_py()
            if held and part != now:
                yield done()
                held = []
            now = part
            held.append((batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), *(batch.column(_FIRST + k)[i].as_py() for k in range(4))))
    if held:
        yield done()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Grams, list[np.ndarray]]]:
    """Of rows sorted by chunk and part (-1: the chunk itself) each chunk with its words' and pairs' counts: all, then those but of the deleted fold."""
    now, grams, parts = None, None, []

    def done() -> tuple[Grams, list[np.ndarray]]:
        return grams, [np.concatenate([counts_of(p[k]) for p in parts if p[k]] or [np.zeros(0, np.int64)]) for k in range(4)]

    for batch in batches:
        for i in range(batch.num_rows):
            chunk, part = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if chunk != now and grams is not None:
                yield done()
                grams, parts = None, []
            now = chunk
            if part < 0:
                grams = Grams.of([batch.column(_FIRST + k)[i].as_py() for k in range(5)])
            else:
                parts.append([batch.column(_FIRST + k)[i].as_py() for k in range(4)])
    if grams is not None:
        yield done()


@dataclass(frozen=True)
class Unigrams:
    n: int
    kinds: int
    unknown: float

    def shares(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (1 - self.unknown) * c / max(self.n, 1), self.unknown)


def _contexts(g: Grams, words: np.ndarray) -> np.ndarray:
    """Counts of the pairs' contexts: a word is followed by one token wherever it stands, and a text starts as often as it ends."""
    end = np.searchsorted(g.words, END)
    return np.append(words, words[end])[g.before]


def buckets(context: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(context, 1))).astype(np.int64)


def _events(kept: Unigrams):
    """Over chunks of the deleted fold: (bucket, bin, n, ratios), where a context is known elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, (_, _, words, pairs) in _met(batches):
            n = np.bincount(g.pair, minlength=len(g.pairs))
            context = _contexts(g, words)
            use = context > 0
            r = pairs[use] / context[use] / kept.shares(words[g.after[use]])
            bins = np.where(r > 0, np.floor(BINS * np.log(np.maximum(r, 1e-30))), -1e6).astype(np.int64)
            key, back = np.unique(buckets(context[use]) * 10_000_000 + bins + 5_000_000, return_inverse=True)
            sums = [np.bincount(back, weights=w, minlength=len(key)) for w in (n[use], n[use] * r)]
            yield pa.RecordBatch.from_arrays([pa.array(key // 10_000_000), pa.array(key % 10_000_000), pa.array(sums[0]), pa.array(sums[1])], names=["bucket", "bin", "n", "ratios"])

    return run


def em_weights(groups: dict[int, list[tuple[float, float]]], rounds: int = 200) -> dict[int, float]:
    """For each bucket the weight L that maximises the sum of n * log(L * r + 1 - L) over its (n, r); 0 without events."""
    out = {}
    for b, events in groups.items():
        n, r = np.array(events, float).reshape(-1, 2).T
        w = 0.5
        for _ in range(rounds if n.sum() else 0):
            new = float((n * w * r / (w * r + 1 - w)).sum() / n.sum())
            done = abs(new - w) < 1e-9
            w = min(new, 0.999)
            if done:
                break
        out[b] = w if n.sum() else 0.0
    return out


def _scored(unigrams: Unigrams, weights: np.ndarray):
    least = log10(unigrams.n + SMOOTH * (unigrams.kinds + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, (words, pairs, _, _) in _met(batches):
            row = np.repeat(np.arange(len(g.sizes)), g.sizes)
            sums = lambda v: np.bincount(row, weights=v, minlength=len(g.sizes))
            share = unigrams.shares(words)[g.after]
            context = _contexts(g, words)
            weight = np.where(context > 0, weights[np.minimum(buckets(context), len(weights) - 1)], 0)
            value = np.log10(weight * pairs / np.maximum(context, 1) + (1 - weight) * share)
            cols = [g.rids, g.sizes.astype(np.int64), np.rint(sums(words[g.word] > 0)).astype(np.int64), sums(np.log10(words + SMOOTH)[g.word] - least), sums(value[g.pair])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["rid", "tokens", "known", "base", "score"])

    return run


def lm_score(docs: DataFrame, fold: Column) -> DataFrame:
    """(doc_id, fold, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``; scores are log10.

    ``fold``: 0 is never learned from, 1 gives the interpolation weights, any other the counts; a null counts as 2. The counts that scores use are
    those of all folds but 0. base_score: unigrams with SMOOTH added to each count and one kind more. Null or empty text:
    the end token alone. A very long text makes a chunk of its own. Repeated rows are each returned, and null ids too. An empty table gives no
    rows. Nothing to learn from: every token is unknown. Columns besides doc_id, text and those of ``fold`` are not read.
    """
    rows = numbered(docs.withColumn("_fold", F.coalesce(fold.cast("int"), F.lit(2))).select("doc_id", "text", "_fold"))
    read = rows.select(F.col("_rid").alias("rid"), F.col("_fold").alias("fold"), F.col("text").cast("binary").alias("text"))
    chunks = stored(read.mapInArrow(_chunked, _ROW), "chunks")
    n_chunks, tokens, trained, deleted = (x or 0 for x in chunks.agg(F.count("*"), F.sum("tokens"), F.sum("trained"), F.sum(F.when(F.col("deleted"), F.col("trained")))).first())
    parts = max(1, 2 * tokens // PART)
    asked = chunks.mapInArrow(_asked(parts), _ROW).repartition(parts, "part").sortWithinPartitions("part")
    replies = stored(asked.mapInArrow(_added, _ROW), "counts")
    kinds = new = 0
    for x in replies.where("chunk = -1").select("b0").toLocalIterator():  # a row of two numbers a part
        a, b = np.frombuffer(x["b0"], np.int64)
        kinds, new = kinds + int(a), new + int(b)
    unknown = min(0.5, (new + 1) / (deleted + 2)) if trained else 1.0
    replies = replies.where("chunk >= 0")
    met = lambda where: chunks.where(where).unionByName(replies.where(where)).repartition(max(1, n_chunks), "chunk").sortWithinPartitions("chunk", "part")
    events = met("deleted").mapInArrow(_events(Unigrams(trained - deleted, kinds, unknown)), "bucket long, bin long, n double, ratios double")
    bins = events.groupBy("bucket", "bin").agg(F.sum("n").alias("n"), F.sum("ratios").alias("ratios")).collect()  # 64 buckets of a few hundred bins at most
    groups: dict[int, list] = {}
    for x in sorted(bins, key=lambda x: (x["bucket"], x["bin"])):
        groups.setdefault(x["bucket"], []).append((x["n"], x["ratios"] / x["n"]))
    learned = em_weights(groups)
    weights = np.array([learned.get(b, 0.0) for b in range(64)])
    sums = met("true").mapInArrow(_scored(Unigrams(trained, kinds, unknown), weights), "rid long, tokens long, known long, base double, score double")
    ids = rows.select("doc_id", F.col("_fold").alias("fold"), "_rid")
    return ids.join(sums, ids["_rid"] == sums["rid"]).select(
        "doc_id", "fold", F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(trained).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )
