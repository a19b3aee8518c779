import random
import re

import xxhash

from peltrane.llm import simhash as s


def plain(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda x: x[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(keys, linked):
    """For each index the indices reachable."""
    group = list(range(len(keys)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if linked(keys[i], keys[j]):
                group[root(i)] = root(j)
    return [root(i) for i in range(len(keys))]


def expected(rows):
    fps = [plain(t) for _, t in rows]
    roots = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (k, _), r in zip(rows, roots, strict=True):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return sorted(((k, f"{f:016x}", least.get(r)) for (k, _), f, r in zip(rows, fps, roots, strict=True)), key=repr)


def test_documents_and_awkward_rows(small, awkward):
    for docs in (small, awkward):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, s.near_duplicates(docs).collect()), key=repr) == expected(rows)


def test_links_are_complete_and_single(spark):
    rng = random.Random(6)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for n in (1, 1, 2, 3, 4, 4, 5, 6):
            x = base
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            fps.add(x)
    fps |= {1 << 63, 1, (1 << 63) | (1 << 21), (1 << 42) | (1 << 21)}
    signed = [s._signed(x) for x in fps]
    for distance in (1, 2, 4, 5):
        got = [tuple(sorted((r.u, r.v))) for r in s.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance).collect()]
        assert len(got) == len(set(got))
        mask = (1 << 64) - 1
        assert set(got) == {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= distance}


def test_index_is_not_broadcast(spark):
    plan = s.links(spark.range(100).selectExpr("id AS fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # the index has 64 rows for each fingerprint, whatever Spark reckons


def test_one_of_each(awkward, small):
    for docs in (awkward, small):
        out = s.one_of_each(docs)
        assert out.columns == docs.columns
        want = {}
        for k, f, c in expected([tuple(r) for r in docs.select("doc_id", "text").collect()]):
            want.setdefault(c if c is not None else f, c)
        assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted(want.values(), key=repr)


def test_empty(empty):
    assert s.near_duplicates(empty).count() == 0
    assert s.one_of_each(empty).count() == 0
