import numpy as np
import pytest

from peltrane.llm import embeddings as e

SCHEMA = "vec_id long, embedding array<float>, label int, node string, unit string"


def expected(rows, cosine=0.98):
    units = []
    for _, x, label, *_ in rows:
        ok = label is not None and x and None not in x and np.isfinite(np.array(x, float)).all() and np.any(np.array(x, float))
        v = np.array(x, dtype=np.float64) if ok else None
        units.append(v / np.linalg.norm(v) if ok else None)
    n = len(rows)
    near = [[j for j in range(n) if i != j and units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((rows[i][0], len(near[i]), c, None if rows[i][0] is None or c is None else rows[i][0] == c))
    return sorted(out, key=repr)


def vectors(seed, dims):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        center = rng.standard_normal(dims)
        for k in range(9):
            v = center + rng.standard_normal(dims) * rng.choice([0.0, 0.05, 0.1, 0.15]) * np.linalg.norm(center) / np.sqrt(dims)
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([1.0, 3.0])], [0, 1, None][c % 3] if k else 0, "n", "u"))
    return rows


@pytest.mark.parametrize("dims", [2, 7, 64])
def test_against_brute_force(spark, dims):
    rows = vectors(dims, dims)
    odd = [(500, None, 0, None, None), (501, [], 0, None, None), (502, [0.0] * dims, 0, None, None), (503, [float("nan")] * dims, 0, None, None), (504, [None] * dims, 0, None, None), (505, [float("inf")] * dims, 0, None, None), (None, rows[0][1], 0, None, None), (None, None, None, None, None), (506, [1.0] * (dims + 1), 0, None, None), (507, [1.0] * (dims + 1), 0, None, None)]
    rows = [*rows, rows[3], rows[3], rows[10], *odd]
    got = e.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, e.near_duplicates(table).collect()), key=repr) == expected(rows)


def test_empty(spark):
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
