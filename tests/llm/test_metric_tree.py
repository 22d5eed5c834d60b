import numpy as np
import pytest
from pyspark.sql import functions as F

from tunewright.llm import metric_tree


def brute(rows, top=5):
    whole = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.append((i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    out = []
    for q, qv in {(i, tuple(v)) for i, v in whole if i % 50 == 0}:
        hits = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in whole if i != q)[:top]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return sorted(tuple(r) for r in metric_tree.top_k(df, F.col("vec_id") % 50 == 0).collect())


@pytest.fixture(autouse=True)
def packaged(documents):
    return documents


def vectors(rng, n, dims, spread):
    centres = rng.normal(size=(6, dims))
    return (centres[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_many_blocks_and_shares_equal_brute_force(spark, monkeypatch, spread):
    for name, value in {"BLOCK_ROWS": 150, "SHARE_ROWS": 7, "PAGE": 16, "REGIONS": 4}.items():
        monkeypatch.setattr(metric_tree, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(rng, 1_200, 8, spread))]
    # A crowd of equal vectors and ties.
    rows += [(5_000 + i, rows[50][1]) for i in range(400)]
    assert run(spark, rows, block="b", region=1, vec=0, share=2) == brute(rows)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]),
            (5, [-1.0, 0.001]), (6, []), (None, [1.0, 1.0]), (7, [1.0, 0.5]), (7, [1.0, 0.5]), (100, [1.0]), (0, [1.0, 0.5]),
            (150, [3e5, -2e5]), (8, [3e5, 2e5])]
    assert run(spark, rows) == brute(rows)


def test_fewer_rows_than_asked_and_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]


def test_pages_bound_their_entries():
    rng = np.random.default_rng(2)
    rows = rng.integers(-256, 256, (700, 6))
    rows[100:300] = rows[100]
    longest = float((rows ** 2).sum(1).max())
    pages = metric_tree.build_pages(np.arange(700), rows, longest, page=8)
    points = metric_tree.lifted(rows, longest)

    def members(number):
        page = pages[number]
        assert len(page["ids"]) <= 8
        if page["leaf"]:
            return list(page["ids"])
        out = []
        for entry, child in enumerate(page["ids"]):
            head = metric_tree.lifted(page["rows"][entry:entry + 1], longest)[0]
            below = members(child)
            assert metric_tree.distances(points[below], head).max() <= page["radii"][entry] + 1e-9
            np.testing.assert_allclose(metric_tree.distances(metric_tree.lifted(pages[child]["rows"], longest), head),
                                       pages[child]["to_parent"], atol=1e-9)
            out += below
        return out

    assert sorted(members(0)) == list(range(700))


def test_the_bounds_save_distance_computations():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * vectors(rng, 4_000, 4, 0.02)).astype(np.int64)
    longest = float((rows ** 2).sum(1).max())
    pages = dict(enumerate(metric_tree.build_pages(np.arange(4_000), rows, longest, page=32)))
    touched = 0

    class Counting(np.ndarray):
        def __getitem__(self, at):
            nonlocal touched
            touched += len(at) if isinstance(at, np.ndarray) else 0
            return np.ndarray.__getitem__(self, at).view(np.ndarray)

    for page in pages.values():
        page["points"] = None if page["leaf"] else metric_tree.lifted(page["rows"], longest)
        page["rows"] = page["rows"].view(Counting)
    best = metric_tree.search(pages, rows[0], 0, 5, [], longest)
    scores = rows @ rows[0]
    assert sorted(-s for s, _ in best) == sorted(-scores[1:])[:5]
    assert touched < 2_000
