import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from peltrane.llm import suffix_dedup as s


def brute(texts, length):
    """For each text its spans of repeated windows."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [s.spans_of((i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1) for t in texts]


def brute_across(texts, length):
    """For each list of words its spans of windows that another list has too."""
    rows = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            rows.setdefault(tuple(t[i : i + length]), set()).add(k)
    return [s.spans_of((i, i + length) for i in range(len(t) - length + 1) if len(rows[tuple(t[i : i + length])]) > 1) for t in texts]


def made(texts, shape, ranges, run, size):
    """The operator's steps without Spark, and without the filter on hashes. Texts are bytes, or words' codes."""
    runs, held, away, unit = [], {}, [], shape.brief

    def flush():
        out = {}
        for *e, places in sorted((*k, v) for k, v in held.items()):
            if len(places) > 3:  # kept elsewhere
                away.append(places)
                places = [(-1, len(away) - 1), (-2, min(p[0] for p in places)), (-2, max(p[0] for p in places))]
            e = (*e, places)
            out.setdefault(int.from_bytes(e[0][:8], "big") * ranges >> 64, []).append(e)
        runs.append({r: s.coded(x) for r, x in out.items()})
        held.clear()

    count = 0
    for chunk in s._chunks(texts, shape, size):
        doc, place, lo, hi, h, _ = s.anchors([x[2] for x in chunk], shape)
        for d, p, a, z, x in zip(doc.tolist(), place.tolist(), lo.tolist(), hi.tolist(), h.tolist(), strict=True):
            row, offset, _ = chunk[d]
            p += offset
            text = shape.shortened(texts[row])
            at = p * unit
            held.setdefault((x.to_bytes(8, "big") + text[at : at + shape.length * unit], text[at - z * unit : at], a * unit, z * unit), []).append((row, p))
            count += 1
            if count % run == 0:
                flush()
    flush()
    found = [[] for _ in texts]
    for r in range(ranges):
        for row, place, a, b, kind in s.merge_range([x[r] for x in runs if r in x], [shape]):
            assert kind == (shape.unit > 1)
            for i, p in away[place] if row < 0 else [(row, place)]:
                found[i].append((p + a, p + b))
    return [s.spans_of(x) for x in found]


@pytest.mark.parametrize("seed", range(40))
def test_against_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(s, "PAIRS_UP_TO", rng.choice([0, 1, 3, 12]))
    alphabet = rng.choice([b"a", b"ab", b"abc", bytes(range(97, 123)), "aé漢".encode()])
    make = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    texts = [make(rng.randrange(0, 200)) for _ in range(12)]
    passages = [make(rng.randrange(20, 90)) for _ in range(4)]
    for _ in range(25):
        t = make(rng.randrange(0, 60)) + rng.choice(passages) + make(rng.randrange(0, 60))
        if rng.random() < 0.4:
            k = rng.randrange(len(t))
            t = t[:k] + b"#" + t[k + 1 :]
        texts.append(t + rng.choice([b"", rng.choice(passages)]))
    texts += [texts[-1], b"", b"aaaa" * 40]
    length = rng.choice([16, 24, 40])
    shape = s.Shape(length, rng.randrange(1, length - s.GRAM + 2))
    assert made(texts, shape, rng.choice([1, 3, 8]), rng.choice([5, 50, 10_000]), rng.choice([37, 300, 1 << 20])) == brute(texts, length)


@pytest.mark.parametrize("seed", range(40))
def test_passages_against_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(s, "PAIRS_UP_TO", rng.choice([0, 1, 3, 12]))
    vocabulary = [f"w{k}" for k in range(rng.choice([1, 2, 4, 200]))]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [make(rng.randrange(0, 80)) for _ in range(8)]
    passages = [make(rng.randrange(5, 30)) for _ in range(4)]
    for _ in range(25):
        t = make(rng.randrange(0, 20)) + rng.choice(passages) + make(rng.randrange(0, 20))
        texts.append(t + rng.choice([[], rng.choice(passages)]))
    texts += [texts[-1], [], make(1) * 50, passages[0] * 3]
    length = rng.choice([6, 9, 17])
    shape = s.Shape(length, rng.randrange(1, length - s.WORD_GRAM + 2), unit=s.WORD, across=True)
    coded = list(s.word_codes(("\t ".join(t).encode() for t in texts), rng.choice([1, 20, 1 << 20])))
    assert made(coded, shape, rng.choice([1, 3, 8]), rng.choice([5, 50, 10_000]), rng.choice([37, 300, 1 << 20])) == brute_across(texts, length)


def test_merge_keeps_order_and_known_prefixes():
    rng = random.Random(1)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 30))) for _ in range(300)]
    runs = [sorted(keys[k::5]) for k in range(5)]
    blocks = [s.coded([(k, b"", 0, 0, [(i, 0)]) for i, k in enumerate(r)]) for r in runs]
    out = list(s.merged([s.decoded(b) for b in blocks]))
    assert [x[0] for x in out] == sorted(keys)
    for (a, _, _), (b, lcp, _) in zip(out, out[1:], strict=False):
        assert lcp == s.common_prefix(a, b)


def expected(docs):
    texts = [(r.text or "").encode() for r in docs]
    rows = []
    for r, t, spans in zip(docs, texts, brute(texts, 400), strict=True):
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + t[at:a], b
        kept += t[at:]
        rows.append((r.doc_id, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    passages = brute_across([t.split() for t in texts], 51)
    return sorted(((*r, len(p), sum(b - a for a, b in p)) for r, p in zip(rows, passages, strict=True)), key=repr)


def test_query_on_awkward_rows(awkward):
    cut = awkward.where("text is null or length(text) < 100000")  # brute force keeps each window
    want = expected(cut.select("doc_id", "text").collect())
    for hot in (0, 1, 20_000):  # from 0 on: all single windows, some, none
        out = s.suffix_dedup(cut, size=2000, run_entries=7, range_entries=200, hot_contexts=hot, inline=hot % 2)
        assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words"]
        assert sorted(map(tuple, out.collect()), key=repr) == want


def test_a_passage_with_ever_different_neighbours(spark):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = make(500)
    docs = spark.createDataFrame([(k, make(rng.randrange(350)) + passage + make(rng.randrange(350))) for k in range(40)], "doc_id long, text string")
    want = expected(docs.collect())
    for hot in (5, 20_000):
        assert sorted((tuple(r) for r in s.suffix_dedup(docs, hot_contexts=hot).collect()), key=repr) == want


def test_very_long_texts_and_many_copies(spark):
    rng = random.Random(5)
    make = lambda n: " ".join(f"{rng.randrange(1 << 30):x}" for _ in range(n))
    shared, short = make(60), " ".join(f"{rng.randrange(1 << 16):x}" for _ in range(55))  # 55 words of under 400 bytes
    copy = make(200)
    texts = {1: make(300_000) + " " + shared + " " + make(300_000), 2: make(1000) + "  " + shared + " " + make(10), 3: make(30) + " " + short + " " + make(30), 4: make(9) + " " + short.replace(" ", "  ") + " " + make(9), 5: "x" * 100_000, 6: make(100)}
    rows = [*texts.items(), *((10 + k, copy) for k in range(3000))]
    got = {r.doc_id: r for r in s.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), inline=10).collect()}
    assert len(got) == len(rows)
    assert min(got[1].n_removed, got[2].n_removed) >= len(shared) and got[1].n_passage_words == got[2].n_passage_words == 60
    assert (got[3].n_removed, got[3].n_passages, got[3].n_passage_words) == (0, 1, 55)
    assert got[4].n_passage_words == 55
    assert (got[5].n_bytes, got[5].n_removed, got[5].n_passages) == (100_000, 100_000, 0)
    assert (got[6].n_removed, got[6].n_passages) == (0, 0)
    assert all(got[10 + k].n_removed == len(copy) and got[10 + k].n_passage_words == 200 for k in range(3000))


def test_string_hashes():
    data = np.frombuffer(b"abcabcXabc", dtype=np.uint8)
    h = s.string_hashes(data, np.array([0, 3, 7, 6, 0]), np.array([3, 6, 10, 9, 2])).tolist()
    assert h[0] == h[1] == h[2] and len(set(h)) == 3


def test_query_on_documents(small):
    out = s.suffix_dedup(small, with_text=True).collect()
    assert sorted((tuple(r)[:7] for r in out), key=repr) == expected(small.select("doc_id", "text").collect())
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out)


def test_empty(empty):
    assert s.suffix_dedup(empty).count() == 0


def test_memory_of_a_chunk():
    import tracemalloc

    rng = random.Random(5)
    texts = [" ".join(str(rng.random()) for _ in range(1000)).encode() for _ in range(150)]
    s.POWERS.clear()
    tracemalloc.start()
    try:
        for shape, of in ((s.Shape(), texts), (s.Shape(s.PASSAGE_WORDS, s.PASSAGE_SPAN, unit=s.WORD), s.word_codes(texts))):
            for chunk in s._chunks(of, shape, s.CHUNK_BYTES):
                s.anchors([x[2] for x in chunk], shape)
        assert tracemalloc.get_traced_memory()[1] < 64e6 and len(s.POWERS) == 1
    finally:
        tracemalloc.stop()
