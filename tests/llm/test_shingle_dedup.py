import random
from collections import Counter

import corpus_pipeline

from . import test_simhash
from peltrane.llm import shingle_dedup as s


def plain(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0


def expected(rows):
    """The ids left, by brute force over all pairs."""
    roots = test_simhash.grouped([plain(t) for _, t in rows], linked)
    left = {}
    for (k, _), r in zip(rows, roots, strict=True):
        left[r] = min(k, left.get(r, k), key=lambda x: (x is None, x or 0))
    return Counter(left.values())


def ids(docs):
    return Counter(r.doc_id for r in docs.collect())


def test_documents_and_awkward_rows(small, awkward):
    for docs in (small, awkward):
        out = s.one_of_each(docs)
        assert out.columns == docs.columns
        assert ids(out) == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def corpus():
    """Copies with changed words around the threshold, groups of them, short texts, passages that many texts share."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [word() for _ in range(60)]
    texts = []
    for size in (3, 5, 6, 9, 14, 30, 80, 200, 400):
        for _ in range(5):
            base = [word() for _ in range(size)]
            for changes in (0, 1, 1, 2, 3, 4, 6, 8):
                copy = list(base)
                for i in rng.sample(range(size), min(size, changes * max(1, size // 200))):
                    copy[i] = word()
                texts += [" ".join(copy), " ".join(copy + [word() for _ in range(size // 12)])]
    for n in (10, 20, 40, 200):
        texts += [" ".join(shared + [word() for _ in range(n)]) for _ in range(15)]
    for i in range(60):  # a chain and a group whose members aren't all similar
        texts.append(" ".join(["x%d" % (j + 3 * (i % 30)) for j in range(100)] + ["y"] * (i // 30)))
    return list(enumerate(texts))


def test_all_pairs_of_that_similarity(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    assert 100 < len(want) < len(rows) - 200
    assert ids(s.one_of_each(docs)) == want


def test_order_does_not_change_the_result(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(s, "OFTEN", 1 << 30)
    assert ids(s.one_of_each(docs)) == expected(rows)


def test_pipeline_stage_finds_copies_with_a_few_changed_words(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(600)]
    changed = [w if i % 60 else "other" for i, w in enumerate(words)]
    rows = [(1, " ".join(words), "s"), (2, " ".join(changed), "s"), (3, " ".join(reversed(words)), "s")]
    assert (test_simhash.plain(rows[0][1]) ^ test_simhash.plain(rows[1][1])).bit_count() > 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert ids(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, None)) == Counter([1, 3])


def test_empty(empty):
    assert s.one_of_each(empty).count() == 0
