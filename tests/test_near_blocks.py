"""Top-k with bounds against numpy: the same rows, with blocks left out."""

import numpy as np
import pytest

from tunewright.functions import vectors
from tunewright.operators import near_blocks, similarity


def frame(spark, matrix, key):
    rows = [(i, i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, song_ord bigint, embedding array<double>")


def unit(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, where=n > 0, out=np.zeros_like(m))


def brute(users, songs, k):
    scores = np.round(unit(users) @ unit(songs).T, vectors.SCORE_DIGITS)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return {u: [int(i) for i in order[u]] for u in range(len(users))}, scores


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["user_id"], {})[r["rank"]] = (r["song_id"], r["similarity"])
    return out


@pytest.mark.parametrize("shape", ["clusters", "third equal", "flat"])
def test_bounds_leave_the_rows_as_they_are(spark, monkeypatch, shape):
    monkeypatch.setattr(near_blocks, "LEAST_ROWS", 20)
    monkeypatch.setattr(near_blocks, "CELLS", 700)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 5))
    songs = centres[rng.integers(0, 12, 900)] + 0.1 * rng.normal(size=(900, 5))
    users = centres[rng.integers(0, 12, 60)] + 0.1 * rng.normal(size=(60, 5))
    if shape == "third equal":
        songs[300:600] = songs[0]
    if shape == "flat":
        songs, users = rng.normal(size=(900, 5)), rng.normal(size=(60, 5))
    users[4], songs[[7, 800]] = 0, 0
    got = similarity.similar_songs_topk(frame(spark, users, "user_id").drop("song_ord"), frame(spark, songs, "song_id"), 7,
                                        item_rows=40, query_rows=16, worth_pairs=0)
    rows = found(got)
    want, scores = brute(users, songs, 7)
    assert {u: [v[i][0] for i in range(1, 8)] for u, v in rows.items()} == want
    assert all(abs(s - scores[u, i]) < 1e-8 for u, v in rows.items() for i, s in v.values())


def test_blocks_below_the_floor_are_not_asked(spark, monkeypatch):
    monkeypatch.setattr(near_blocks, "LEAST_ROWS", 20)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 5))
    songs = unit(centres[np.arange(900) % 12] + 0.02 * rng.normal(size=(900, 5)))
    users = unit(centres[np.arange(60) % 12] + 0.02 * rng.normal(size=(60, 5)))
    items = frame(spark, songs, "item_id").withColumnsRenamed({"song_ord": "item_ord", "embedding": "vector"})
    asked = frame(spark, users, "query_id").withColumnRenamed("embedding", "vector").drop("song_ord")
    _, met = similarity.bounded_topk(asked, items, 60, 900, 5, item_rows=40)
    pairs = [(r["query_id"], r["_ib"]) for r in met.collect()]
    assert len(pairs) == len(set(pairs))
    blocks = len({b for _, b in pairs})
    assert blocks > 20 and len(pairs) < 0.5 * 60 * blocks


def test_few_and_no_items(spark):
    users = frame(spark, np.eye(2, 3), "user_id").drop("song_ord")
    few = similarity.similar_songs_topk(users, frame(spark, np.eye(3), "song_id"), 10, worth_pairs=0)
    assert few.count() == 6
    none = similarity.similar_songs_topk(users, frame(spark, np.eye(3), "song_id").where("song_id < 0"), 10, worth_pairs=0)
    assert none.count() == 0
    zero = similarity.similar_songs_topk(users, frame(spark, np.zeros((3, 3)), "song_id"), 2, worth_pairs=0)
    assert zero.count() == 4


def test_small_item_blocks_do_not_multiply_the_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    items, queries = np.round(rng.normal(size=(300, 3)), 1), np.round(rng.normal(size=(40, 3)), 1)
    # Equal items make ties across runs.
    items[150:] = items[:150]
    i = spark.createDataFrame([(n, n, v.tolist()) for n, v in enumerate(items)], "song_id int, song_ord int, embedding array<double>")
    q = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(queries)], "user_id int, embedding array<double>")
    sent, scored = [], similarity._scored

    def seen(left, *rest):
        sent.append(left.count())
        return scored(left, *rest)

    monkeypatch.setattr(similarity, "_scored", seen)
    expected = similarity.cosine_topk(q, i, 7).orderBy("user_id", "rank").collect()
    del sent[:]
    assert similarity.cosine_topk(q, i, 7, item_rows=4).orderBy("user_id", "rank").collect() == expected
    assert sent == [40]
    # Bounds that leave nothing out give way to scoring every pair.
    del sent[:]
    monkeypatch.setattr(similarity.near_blocks, "SLACK", 2.0)
    assert similarity.cosine_topk(q, i, 7, item_rows=4, worth_pairs=1).orderBy("user_id", "rank").collect() == expected
    assert sent[-1] == 40


@pytest.mark.parametrize("held", [10, 2_000_000])
def test_a_query_travels_once_per_group_of_small_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(similarity, "HELD_CELLS", held)
    rng = np.random.default_rng(6)
    songs, users = np.round(rng.normal(size=(600, 4)), 1), np.round(rng.normal(size=(50, 4)), 1)
    # Equal songs make ties across blocks; the order is not that of the ids.
    songs[300:] = songs[:300]
    items = frame(spark, unit(songs), "item_id").withColumnsRenamed({"song_ord": "item_ord", "embedding": "vector"})
    asked = frame(spark, unit(users), "query_id").withColumnRenamed("embedding", "vector").drop("song_ord")
    sent, scored = [], similarity._scored_groups

    def seen(left, *rest):
        sent.append(left.count())
        return scored(left, *rest)

    monkeypatch.setattr(similarity, "_scored_groups", seen)
    monkeypatch.setattr(similarity.near_blocks, "SLACK", 2.0)
    best, met = similarity.bounded_topk(asked, items, 50, 600, 7, item_rows=8)
    rows = {}
    for r in best.collect():
        rows.setdefault(r["query_id"], {})[r["rank"]] = r["item_id"]
    want, _ = brute(users, songs, 7)
    assert {u: [v[i] for i in range(1, 8)] for u, v in rows.items()} == want
    # Nothing is left out, and still a query is sent to one group each time, not to some 75 blocks.
    assert met.count() > 50 * 60 and all(n <= 50 * 4 for n in sent)
