import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from peltrane.llm import mixing as m


def targets(sizes, weights=m.WEIGHTS, most=3):
    """Water-filling as worded: what is above the cap is shared again by weight until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, fixed = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return {s: float(x) for s, x in fixed.items()}
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            return {s: float(fixed.get(s, level * w[s])) for s in order}
        fixed |= {s: Fraction(most * sizes[s]) for s in over}


def check(docs, **options):
    rows = m.mix(docs, **options).collect()
    given = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in docs.select("doc_id", "text", "source").collect()]
    sizes = Counter()
    for _, n, s in given:
        sizes[s] += n
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter(x[:2] for x in given)
    want = targets(sizes)
    by_target, taken = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[round(r.target, 4), r.source_size] += r.taken
    for s, t in want.items():
        by_target[round(t, 4), sizes[s]].append(t)
    assert set(taken) == set(by_target)
    for k, ts in by_target.items():
        assert abs(taken[k] - sum(ts)) <= 12 * len(ts) + 0.01 * sum(ts)
    return rows


def test_documents(small):
    first = check(small)
    again = m.mix(small.repartition(5)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))  # reruns and other partitions agree
    check(small, shard_words=2000)
    other = m.mix(small, seed=18).collect()
    assert sorted(map(tuple, first)) != sorted(map(tuple, other))


def test_awkward_rows(awkward):
    check(awkward)
    check(awkward, shard_words=500)


def test_few_large_sources_are_capped(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a"), (4000, "b"), (3, None), (500, "c"), (0, "d")])]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(8)
    for _ in range(4):
        claims = [rng.randrange(0, 1000) for _ in range(rng.randrange(1, 12))]
        claims[0] += 1
        seats = rng.randrange(0, 60)
        rows = spark.createDataFrame(list(enumerate(claims)), "_key long, claim long")
        got = {r["_key"]: r["won"] for r in m.apportion(rows, [], F.col("claim"), F.lit(seats), "won").collect()}
        quotients = sorted(((-Fraction(c, 2 * k + 1), i) for i, c in enumerate(claims) if c for k in range(seats)))[:seats]
        assert got == {i: sum(x[1] == i for x in quotients) for i in range(len(claims))}


def test_apportion_ranks_few_quotients_of_many_small_claims(spark):
    """Rounding gives nothing to a thousand small claims; one large claim gets their seats. Work is linear in the rows."""
    claims = [40] * 1000 + [100_000]
    seats = sum(claims) // 100
    rows = spark.createDataFrame(list(enumerate(claims)), "_key long, claim long")
    got = {r["_key"]: r["won"] for r in m.apportion(rows, [], F.col("claim"), F.lit(seats), "won").collect()}
    quotients = sorted(((-Fraction(c, 2 * k + 1), i) for i, c in enumerate(claims) for k in range(seats if c > 40 else 3)))[:seats]
    assert got == {i: sum(x[1] == i for x in quotients) for i in range(len(claims))}


def test_mixed_documents_repeats_whole_rows(small):
    want = {r.doc_id: int(r.taken / r["size"] + 0.5) for r in m.mix(small).where("taken > 0").collect()}
    out = m.mixed_documents(small)
    assert out.columns == small.columns
    assert Counter(r.doc_id for r in out.collect()) == {k: n for k, n in want.items() if n}


def test_empty(empty):
    assert m.mix(empty).count() == 0
    assert m.mixed_documents(empty).columns == empty.columns
