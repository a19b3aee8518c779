import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from peltrane.llm import packing as p


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def padded(n, limit=2048):
    return limit if n & (n - 1) else n


def held_against(rows, docs, tokenizer):
    """Every id in one piece, offsets without gaps; returns tokens and padding."""
    want = defaultdict(list)
    for key, text in docs:
        want[key].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        per_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(per_doc) == set(want)
    for key, texts in want.items():
        spare = [(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in per_doc[key]]
        for ids in texts:
            at = 0
            while at < len(ids):
                piece = next(x for x in spare if x[0] == at and x[3] == len(ids) and zlib.crc32(np.array(ids[at : at + x[1]], "<u4").tobytes()) == x[2])
                spare.remove(piece)
                at += piece[1]
        assert not spare
    total = padding = 0
    for pieces in per_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        total += at
        padding += padded(at) - at
    return total, padding


def test_ids_are_those_of_the_library(tokenizer):
    encode = p.Encoder(p.tokenizer_files())
    rng = random.Random(2)
    texts = ["", " ", "a  b\n\n c", "<|endoftext|>", "x<|endoftext|>y", "漢字 \u2003 \U0001f600 ١٢", "e\u0301", "'s 'll 'S"]
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)} b{chr(c)}" for c in range(0x250)]
    texts += ["".join(chr(rng.randrange(0x250)) for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert encode(t).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_cuts_are_of_least_cost():
    rng = random.Random(4)
    for _ in range(60):
        gaps = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 25))]
        places = np.concatenate(([0], np.cumsum(gaps)))
        cost = np.array([rng.choice([0, 1, 4]) for _ in places])
        limit = 16
        best = [0.0] + [float("inf")] * len(gaps)
        price = lambda n: 0 if n & (n - 1) == 0 and n >= 16 else limit - n
        for j in range(1, len(places)):
            for i in range(j):
                if (n := places[j] - places[i]) <= limit:
                    best[j] = min(best[j], best[i] + price(n) + cost[j] + 1)
        at = total = 0
        for j in p.best_cuts(places, cost, limit):
            total += price(places[j] - places[at]) + cost[j] + 1
            assert places[j] - places[at] <= limit
            at = j
        assert at == len(places) - 1 and total == best[-1]


def test_query_on_documents(small, tokenizer):
    rows = p.pack(small).collect()
    total, padding = held_against(rows, [tuple(r) for r in small.select("doc_id", "text").collect()], tokenizer)
    assert padding < 0.02 * total


def test_awkward_rows_and_small_chunks(awkward, tokenizer):
    rows = p.pack(awkward, chunk=3000).collect()
    total, padding = held_against(rows, [tuple(r) for r in awkward.select("doc_id", "text").collect()], tokenizer)
    assert padding < 0.05 * total


def test_long_runs(spark, tokenizer):
    """Runs of a million and more blanks, line feeds, letters and digits crash neither library."""
    texts = [f"a{c * n}b." for c, n in ((" ", 5_000_000), ("\n", 5_000_000), ("x", 300_000), ("7", 1_000_000), ("-", 300_000), ("\u2003", 1_000_000), (" ", p.LONG_RUN - 1), ("ab ", 500_000))]
    docs = list(enumerate(texts))
    rows = p.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    held_against(rows, docs, tokenizer)


def test_empty(empty):
    assert p.pack(empty).count() == 0
