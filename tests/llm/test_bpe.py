"""The tokenization automaton against merging by hand, over small alphabets where every word can be tried."""

import itertools
import pickle
import random

import pytest

from taperline.llm import bpe, queries


def by_hand(word: str, merges: list[tuple[str, str]]) -> list[str]:
    """The definition: the first of the merges that applies joins its leftmost place, again and again."""
    rank = {m: i for i, m in enumerate(merges)}
    out = list(word)
    while True:
        found = [(rank[p], i) for i, p in enumerate(itertools.pairwise(out)) if p in rank]
        if not found:
            return out
        _, i = min(found)
        out[i : i + 2] = [out[i] + out[i + 1]]


def some_merges(rng: random.Random, letters: str, n: int) -> list[tuple[str, str]]:
    tokens, merges = list(letters), []
    for _ in range(n):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if a + b not in tokens and len(a + b) <= 6:
            merges.append((a, b))
            tokens.append(a + b)
    return merges


def automaton(letters: str, merges: list[tuple[str, str]]) -> tuple[bpe.MergeAutomaton, list[str]]:
    tokens = [*letters, *(a + b for a, b in merges)]
    return bpe.MergeAutomaton({t: k for k, t in enumerate(tokens)}, merges, {}), tokens


@pytest.mark.parametrize("seed", range(40))
def test_every_short_word(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    merges = some_merges(rng, letters, 12)
    made, tokens = automaton(letters, merges)
    for n in range(1, 11 if len(letters) == 2 else 8):
        for word in map("".join, itertools.product(letters, repeat=n)):
            assert [tokens[k] for k in made.path(word.encode())] == by_hand(word, merges), (merges, word)


@pytest.mark.parametrize("seed", range(20))
def test_bits_are_the_pairs_that_stay_apart(seed):
    """v may follow u just if merging their joined bytes gives u and v again."""
    merges = some_merges(random.Random(seed), "abc", 14)
    made, tokens = automaton("abc", merges)
    live = {k for k, t in enumerate(tokens) if by_hand(t, merges) == [t]}
    assert {k for k, r in enumerate(made.row) if r >= 0} == live
    for u, v in itertools.product(sorted(live), repeat=2):
        barred = bool(made.lacks[made.base[u] + made.byte[v]] & made.bit[v])
        assert barred == (by_hand(tokens[u] + tokens[v], merges) != [tokens[u], tokens[v]]), (merges, tokens[u], tokens[v])


def test_equal_letters_join_from_the_left():
    made, tokens = automaton("a", [("a", "a"), ("aa", "a"), ("aa", "aa")])
    for n in range(1, 30):
        assert [tokens[k] for k in made.path(b"a" * n)] == by_hand("a" * n, [("a", "a"), ("aa", "a"), ("aa", "aa")])


def test_tables_alone_encode():
    """No merge is at hand while encoding: what tasks get holds bits, rows, columns and labels; states are far fewer than labels."""
    made = bpe.MergeAutomaton.load(queries.vocabulary())
    sent = made.__getstate__()
    assert set(sent) == {"labels", "added", "width", "lacks", "row", "col"}
    assert len(made.lacks) == made.width * (max(made.row) + 1) and max(made.row) < len(made.labels) // 2
    again = pickle.loads(pickle.dumps(made))
    text = "Ünïcode and 日本 <|endoftext|> \t many   spaces, letterlettersletters 12345's"
    assert again.encode(text) == made.encode(text) and again.decode(again.encode(text)) == text


def test_a_second_way_to_a_token_changes_nothing():
    merges = [("a", "b"), ("b", "c"), ("ab", "c")]
    tokens = {t: k for k, t in enumerate(["a", "b", "c", "ab", "bc", "abc"])}
    once, twice = (bpe.MergeAutomaton(tokens, [*merges, *more], {}) for more in ([], [("a", "bc"), ("a", "b")]))
    assert once.__getstate__() == twice.__getstate__()


def test_a_missing_byte_is_named():
    made, _ = automaton("ab", [("a", "b")])
    with pytest.raises(ValueError, match="lacks a byte"):
        made.path(b"abz")
