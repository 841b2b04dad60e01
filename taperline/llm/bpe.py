"""Byte-pair encoding by a tokenization automaton.

The automaton is deterministic and reads tokens: all arcs labelled v lead to the state of v, and which labels leave a state is a row of a
table of bits. It starts as one state with an arc for each byte and grows by one gadget a merge: the gadget for (a, b) gives a a state of
its own, without the arc b, and adds the label ab, whose arcs leave from where a's do and lead to where b's do. States and labels that no gadget has told apart
share a row and a column. A pre-split word has exactly one path; it is found by looking up bytes in the labels' transitions and bits in the table, with no
merge looked at, and emitting the labels' bytes decodes.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The byte-level pre-tokenizer's pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: The same for texts in Latin letters alone, where the standard library's faster engine can do it; the letters come first as no other branch starts like them.
_LETTER, _NUMBER, _SPACE = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\t-\\r \u0085\u00a0"
LATIN_PATTERN = f" ?[{_LETTER}]+| ?[{_NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_NOT_LATIN = re.compile("[^\u0000-\u024f]")
#: Words whose encoding a task keeps, and their bytes; the table is emptied when it is full.
KEPT_WORDS, KEPT_BYTES = 700_000, 64 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if it prints, else the next character from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Words(dict):
    """Encodings of words, made when asked for."""

    def __init__(self, made: MergeAutomaton):
        self.made, self.size = made, 0

    def clear(self) -> None:
        super().clear()
        self.size = 0

    def __missing__(self, word: str) -> bytes:
        got = self[word] = np.array(self.made.path(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        self.size += len(word) + len(got)
        return got


class Gadgets:
    """The automaton under construction: each label's state (a row) and kind (a column), and a bit where a state lacks the arcs of a kind."""

    def __init__(self, alphabet: list[int]):
        self.row, self.col = dict.fromkeys(alphabet, 0), dict.fromkeys(alphabet, 0)
        self.in_row, self.in_col = [len(alphabet)], [len(alphabet)]
        self.lacks = np.zeros((1024, 128), np.uint8)

    def _own_row(self, k: int) -> int:
        """The row of label k alone: a copy if others share it."""
        old = self.row[k]
        if self.in_row[old] > 1:
            new = len(self.in_row)
            if new == len(self.lacks):
                self.lacks = np.concatenate([self.lacks, np.zeros_like(self.lacks)])
            self.lacks[new] = self.lacks[old]
            self.in_row[old] -= 1
            self.in_row.append(1)
            self.row[k] = new
        return self.row[k]

    def _own_col(self, k: int) -> int:
        old = self.col[k]
        if self.in_col[old] > 1:
            new = len(self.in_col)
            if new == 8 * self.lacks.shape[1]:
                self.lacks = np.concatenate([self.lacks, np.zeros_like(self.lacks)], axis=1)
            rows = self.lacks[: len(self.in_row)]
            rows[:, new >> 3] |= ((rows[:, old >> 3] >> (old & 7)) & 1) << (new & 7)
            self.in_col[old] -= 1
            self.in_col.append(1)
            self.col[k] = new
        return self.col[k]

    def merge(self, a: int, b: int, ab: int) -> None:
        """The gadget for (a, b): nothing if no text leads to it, that is if a or b has no arc or b can't follow a (as where ab is there already)."""
        if a not in self.row or b not in self.row or self.lacks[self.row[a], self.col[b] >> 3] >> (self.col[b] & 7) & 1:
            return
        state = self.row[b]  # where b leads before a loses the arc b, should they be the same token
        self.in_row[state] += 1
        r, c = self._own_row(a), self._own_col(b)
        self.lacks[r, c >> 3] |= 1 << (c & 7)
        self.row[ab], self.col[ab] = state, self.col[a]
        self.in_col[self.col[a]] += 1

    def table(self) -> np.ndarray:
        return self.lacks[: len(self.in_row), : (len(self.in_col) + 7) >> 3]


class MergeAutomaton:
    """The compiled merges. ``labels``: bytes of each id; ``added``: special strings to ids, matched before words are split."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        alphabet = byte_alphabet()
        self.labels = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for s, k in vocab.items():
            self.labels[k] = bytes(alphabet[c] for c in s)
        self.added = added
        for s, k in added.items():
            self.labels[k] = s.encode()
        made = Gadgets([k for s, k in vocab.items() if len(s) == 1])
        for a, b in merges:
            made.merge(vocab[a], vocab[b], vocab[a + b])
        table = made.table()
        self.width, self.lacks = table.shape[1], table.tobytes()
        self.row, self.col = array("i", [-1]) * len(self.labels), array("i", [-1]) * len(self.labels)
        for k in made.row:
            self.row[k], self.col[k] = made.row[k], made.col[k]
        self._start()

    @classmethod
    def load(cls, path: str) -> MergeAutomaton:
        """From a tokenizers file of a byte-level BPE model."""
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in made["added_tokens"]})

    def _start(self) -> None:
        """The labels' bytes as transitions: ``step`` from a node (times 256) and a byte to a node, ``ends`` the label that a node ends, if any."""
        self.words, self.split = _Words(self), None
        self.base = [r * self.width for r in self.row]
        self.byte, self.bit = [c >> 3 for c in self.col], [1 << (c & 7) for c in self.col]
        self.step, self.ends = {}, [-1]
        self.shorter = [-1] * len(self.labels)
        step, ends = self.step, self.ends
        for k in sorted((k for k, r in enumerate(self.row) if r >= 0), key=lambda k: len(self.labels[k])):
            node, last = 0, -1
            for b in self.labels[k]:
                if ends[node] >= 0:
                    last = ends[node]
                to = step.get(node << 8 | b)
                if to is None:
                    to = step[node << 8 | b] = len(ends)
                    ends.append(-1)
                node = to
            ends[node], self.shorter[k] = k, last

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("labels", "added", "width", "lacks", "row", "col")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def path(self, word: bytes) -> list[int]:
        """The labels on the only path that spells ``word``: always the longest arc, and where that leads to a dead end a shorter one."""
        labels, lacks, base, byte, bit, shorter = self.labels, self.lacks, self.base, self.byte, self.bit, self.shorter
        n, at, out, dead = len(word), 0, [], set()
        v = self._arc(word, 0)
        while True:
            end = at + len(labels[v])
            if end not in dead and not (out and lacks[base[out[-1]] + byte[v]] & bit[v]):
                out.append(v)
                at = end
                if at == n:
                    return out
                v = self._arc(word, at)
                continue
            v = shorter[v]
            while v < 0:
                dead.add(at)
                v = out.pop()
                at -= len(labels[v])
                v = shorter[v]

    def _arc(self, word: bytes, at: int) -> int:
        """The longest label whose bytes stand at ``at``."""
        node, found, step, ends = 0, -1, self.step, self.ends
        for i in range(at, len(word)):
            node = step.get(node << 8 | word[i])
            if node is None:
                break
            if ends[node] >= 0:
                found = ends[node]
        if found < 0:
            raise ValueError("the vocabulary lacks a byte")
        return found

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.split is None:
            self.split, self.latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
            self.special = regex.compile("|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        if self.special and self.special.search(text):
            out, at = [], 0
            for m in self.special.finditer(text):
                out += [self._words(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
                at = m.end()
            return b"".join([*out, self._words(text[at:])])
        return self._words(text)

    def _words(self, text: str) -> bytes:
        if len(self.words) > KEPT_WORDS or self.words.size > KEPT_BYTES:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, (self.split if _NOT_LATIN.search(text) else self.latin)(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, array("I", ids))).decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, path: str, decode: bool = False, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens long and ids binary (little-endian unsigned 32-bit; see unpacked) added, and, with ``decode``,
    decoded string: the ids' labels put together again. Columns of these names are replaced, all others stay.

    Null text: empty, no ids. One pass without a shuffle; a text is taken whole, whatever its length. The file is read on
    the driver and the automaton, of fixed size, is broadcast. Repeated rows are each encoded; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(MergeAutomaton.load(path))
    new = ["n_tokens", "ids", *(["decoded"] if decode else [])]
    kept = docs.drop(*new)
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = [made.encode(x.as_py() or "") for x in part.column(at)]
                cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array([made.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *new])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_tokens long", "ids binary", "decoded string"][: len(new)]
    return kept.mapInArrow(run, ", ".join(types))


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with ids as bpe_encode makes them) with decoded string added; null ids: empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(MergeAutomaton.load(path))
    kept = encoded.drop("decoded")
    at = kept.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([shared.value.decode(x.as_py() or b"") for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return kept.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["decoded string"]))


def unpacked(ids: bytes) -> list[int]:
    return list(array("I", ids))
