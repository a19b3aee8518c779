import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from peltrane.functions import scalars, tokens
from peltrane.operators import groups, information, padding, selection, vocabulary


def test_bounds():
    assert vocabulary.absolute_bounds(1000) == (10, 990)
    assert vocabulary.absolute_bounds(250) == (2, 248)  # half to even
    assert vocabulary.relative_bounds(1999) == (1, 1997)
    assert vocabulary.relative_bounds(500) == (0, 499)


@pytest.mark.parametrize("n, four, six", [(0, 0, 0), (4, 0, 0), (5, 1, 0), (6, 2, 1), (10, 6, 5)])
def test_ngram_counts(n, four, six):
    assert (tokens.gram_starts(n, 4), tokens.gram_starts(n, 6)) == (four, six)


def test_byte_ngrams(spark):
    rng = random.Random(1)
    files = {k: bytes(rng.choice(b"ab\xff\0") for _ in range(n)) for k, n in enumerate([0, 3, 4, 5, 6, 7, 300])}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [(99, None)], "id int, content binary")
    for last in (False, True):
        got = defaultdict(list)
        for r in tokens.byte_ngrams(df, sample="id", content="content", sizes=(4, 6, 9), include_last=last).collect():
            got[r.id, r["size"]].append(bytes(r.token))
        for k, data in files.items():
            for size in (4, 6, 9):
                n = len(data) - size + (1 if last or size > 4 else 0)
                want = {data[i : i + size] for i in range(max(0, n))}
                assert len(got[k, size]) == len(want) and set(got[k, size]) == want


def test_entropy(spark):
    rows = [(0, bytearray()), (1, None), (2, bytearray(b"aaaa")), (3, bytearray(range(256))), (4, bytearray(b"aab"))]
    got = {r.id: r.e for r in spark.createDataFrame(rows, "id int, c binary").select("id", tokens.byte_entropy(F.col("c")).alias("e")).collect()}
    assert got[0] == got[1] == got[2] == 0.0 and got[3] == 8.0
    assert math.isclose(got[4], -(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))


def test_strings(spark):
    data = b"abc\0abcd\0\tabc \0 ab  \x80hello world\x01tab\there\0abcd\0"
    df = spark.createDataFrame([(1, bytearray(data))], "id int, content binary")
    got = [r.token for r in tokens.string_tokens(df, sample="id", content="content").collect()]
    assert sorted(got) == ["abcd", "hello world", "tab\there"]


def test_sequence_ngrams(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a"]), (3, []), (4, None)], "id int, items array<string>")
    got = {(r.id, r.token): r.tf for r in tokens.sequence_ngrams(df, sample="id", items="items").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (1, "a b"): 1, (1, "b a"): 1, (1, "a b a"): 1}
    full = {(r.id, r.token): r.tf for r in tokens.sequence_ngrams(df, sample="id", items="items", include_last=True).collect()}
    assert full[1, "a b"] == 2 and full[1, "b a b"] == 1 and full[2, "a"] == 1


def test_row_ngrams_are_sequence_ngrams(spark):
    rng = random.Random(7)
    lists = {k: [rng.choice("abc") for _ in range(n)] for k, n in enumerate([0, 1, 2, 3, 4, 40])}
    rows = spark.createDataFrame([(k, i, x) for k, xs in lists.items() for i, x in enumerate(xs)], "id int, at int, item string").repartition(3)
    arrays = spark.createDataFrame(list(lists.items()), "id int, items array<string>")
    for last in (False, True):
        one = tokens.row_ngrams(rows, sample="id", order=["at"], item="item", include_last=last)
        two = tokens.sequence_ngrams(arrays, sample="id", items="items", include_last=last)
        assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}


def test_names(spark):
    names = ["KERNEL32.DLL", "a.drv", "b.dll.x", "", "x"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", scalars.dll_name(F.col("n")).alias("d"))
    assert {r.n: r.d for r in df.collect()} == {"KERNEL32.DLL": "kernel32.dll", "a.drv": "a.drv.dll", "b.dll.x": "b.dll", "": ".dll", "x": "x.dll"}


def dense_gain(rows, labels):
    """The definition on a dense row of values."""
    h = lambda xs: -sum(c / len(xs) * math.log2(c / len(xs)) for c in Counter(xs).values())
    parts = defaultdict(list)
    for s, y in labels.items():
        parts[rows.get(s, 0)].append(y)
    return h(list(labels.values())) - sum(len(p) / len(labels) * h(p) for p in parts.values())


def test_sparse_gain_is_dense_gain(spark):
    rng = random.Random(2)
    labels = {s: rng.choice("xyz") for s in range(60)}
    counts = {(s, t): rng.randrange(1, 4) for s in range(70) for t in "abcdef" if rng.random() < 0.15 * (ord(t) - 96)}
    pairs = spark.createDataFrame([(s, t, n) for (s, t), n in counts.items()], "id int, token string, tf int")
    y = spark.createDataFrame(list(labels.items()), "id int, y string")
    for value in (None, "tf"):
        got = {r.token: r.ig for r in information.information_gain(pairs, y, sample="id", label="y", value=value).collect()}
        for t in "abcdef":
            own = {s: (n if value else 1) for (s, u), n in counts.items() if u == t}
            assert math.isclose(got[t], dense_gain(own, labels), abs_tol=1e-9)
            assert 0 <= got[t] <= math.log2(3)
    e = {r.token: r.ig for r in information.information_gain(pairs, y, sample="id", label="y", base=math.e).collect()}
    two = {r.token: r.ig for r in information.information_gain(pairs, y, sample="id", label="y").collect()}
    assert all(math.isclose(e[t], two[t] * math.log(2), abs_tol=1e-9) for t in two)


def test_one_pass_gain_is_the_same(spark):
    rng = random.Random(5)
    labels = {s: rng.choice("xyz") for s in range(50)}
    pairs = [(s, t, labels[s]) for s in labels for t in "abcdefgh" if rng.random() < 0.1 * (ord(t) - 95)]
    found = spark.createDataFrame(pairs, "id int, token string, y string")
    y = spark.createDataFrame(list(labels.items()), "id int, y string")
    want = {r.token: r.ig for r in information.information_gain(found.drop("y"), y, sample="id", label="y").collect()}
    df = Counter(t for _, t, _ in pairs)
    got = {r.token: (r.df, r.ig) for r in information.labelled_gain(found, y, label="y").collect()}
    assert {t: n for t, (n, _) in got.items()} == df and all(math.isclose(got[t][1], want[t], abs_tol=1e-9) for t in want)
    some = {r.token for r in information.labelled_gain(found, y, label="y", bounds=(10, 30)).collect()}
    assert some == {t for t, n in df.items() if 10 < n < 30}


def test_tfidf_gain_is_zero_where_idf_is(spark):
    pairs = spark.createDataFrame([(s, "t", s + 1) for s in range(3)], "id int, token string, tf int")
    y = spark.createDataFrame([(s, s % 2) for s in range(4)], "id int, y int")
    df = vocabulary.document_frequency(pairs)
    assert information.tfidf_gain(pairs, y, df, 4, sample="id", label="y").first().ig == 0.0


def test_selection(spark):
    gains = [("byte", "a", 0.1), ("byte", "b", 0.5), ("opcode", "a", 0.36), ("byte", "c", 0.5), ("opcode", "z", 0.0)]
    g = selection.union_gains(spark.createDataFrame(gains, "kind string, token string, ig double"), spark.createDataFrame([("byte", "a", 0.9)], "kind string, token string, ig double"))
    ranked = {(r.kind, r.token): r.ccdf for r in selection.ccdf(g).collect()}
    order = sorted(gains, key=lambda x: (x[2], x[0], x[1]))
    assert {k: round(v, 9) for k, v in ranked.items()} == {(k, t): round(1 - (i + 1) / 5, 9) for i, (k, t, _) in enumerate(order)}
    first = selection.elbow(selection.ccdf(g)).collect()
    assert [(r.kind, r.token) for r in first] == [("opcode", "a")]
    assert {(r.kind, r.token) for r in selection.select_features(g).collect()} == {("byte", "b"), ("byte", "c")}
    assert selection.elbow(selection.ccdf(g), 5.0).count() == 0


def test_padding_and_wide_names(spark):
    samples = spark.createDataFrame([(1,), (2,)], "id int")
    found = spark.createDataFrame([(1, "Foo"), (1, "other"), (1, "foo")], "id int, token string")
    out = padding.pad_presence(samples, found, ["foo", "Foo", "bar"], sample="id")
    assert {r.id: r.features for r in out.collect()} == {1: [True, False, True], 2: [False] * 3}
    wide = padding.wide(out, {"features": ("str_", ["foo", "Foo", "bar"])})
    assert len({c.lower() for c in wide.columns}) == 4
    weights = spark.createDataFrame([(2, "foo", 1.5)], "id int, token string, weight double")
    out = padding.pad_weights(samples, weights, ["a", "foo"], sample="id")
    assert {r.id: r.weights for r in out.collect()} == {1: [0.0, 0.0], 2: [0.0, 1.5]}
    assert padding.pad_presence(samples, found, [], sample="id").first().features == []


def test_part_stats(spark):
    df = spark.createDataFrame([([1.0, 2.0], [2.0]), ([], [])], "a array<double>, b array<double>")
    got = [tuple(r.s) for r in df.select(groups.part_stats(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [(5 / 3, 1.0, 2.0), (0.0, 0.0, 0.0)]


def test_top_k_and_subsample(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "token string, df long")
    assert [r.token for r in vocabulary.top_k(df, 2).collect()] == ["a", "b"]
    assert vocabulary.top_share(df, 0.0001).count() == 0
    ids = spark.range(100)
    one, two = ({r.id for r in vocabulary.subsample(f, 10, key="id").collect()} for f in (ids, ids.repartition(7)))
    assert one == two and len(one) == 10 and vocabulary.subsample(ids, 1000, key="id").count() == 100


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    df = spark.createDataFrame([("b", 2)], "token string, df long")
    found = spark.createDataFrame([(1, "b")], "id int, token string")
    assert "BroadcastHashJoin" in plan(vocabulary.members(found, df, size=1))
    assert "TakeOrderedAndProject" in plan(vocabulary.top_k(df, 2))
    native = information.information_gain(found, spark.createDataFrame([(1, "y")], "id int, y string"), sample="id", label="y")
    assert "Python" not in plan(native) and "Arrow" not in plan(native) and "Cartesian" not in plan(native)
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan(table.select("doc_id", "lang"))
