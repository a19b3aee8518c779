import random

import pytest

from peltrane.llm import token_counts as t


def test_lengths_are_those_of_greedy_longest_match():
    rng = random.Random(9)
    for _ in range(30):
        letters = b"abc"
        pieces = {bytes([c]) for c in range(256)} | {bytes(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(1, 40))}
        pieces |= {b" " + bytes(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 10))}
        a = t.Automaton(list(pieces))
        for _ in range(100):
            word = b" " + bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 25)))
            assert a.length(word) == len(t.greedy_pieces(word, frozenset(pieces)))


def test_vocabulary_must_hold_single_bytes():
    with pytest.raises(ValueError):
        t.Automaton([b"a", b"b"])
    with pytest.raises(ValueError):  # nor may the blank be missing: words are looked up after one
        t.Automaton([bytes([c]) for c in range(256) if c != 32])


def test_documents_and_awkward_rows(small, awkward):
    pieces = frozenset(t.vocabulary())
    for docs in (small, awkward):
        want, known = [], {}
        for key, text in (tuple(r) for r in docs.select("doc_id", "text").collect()):
            counts = [known.setdefault(w, None) or known.__setitem__(w, len(t.greedy_pieces(b" " + w, pieces))) or known[w] for w in (text or "").encode().split()]
            want.append((key, len(counts), sum(counts), max(counts, default=0)))
        for cache in (t.CACHE_WORDS, 3):
            assert sorted(map(tuple, t.count_tokens(docs, cache=cache).collect()), key=repr) == sorted(want, key=repr)


def test_empty(empty):
    assert t.count_tokens(empty).count() == 0
