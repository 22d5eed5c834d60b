"""Vector sums, cosines and block top-k against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunewright.functions import vectors
from tunewright.operators import embeddings, similarity


def frame(spark, matrix, key):
    rows = [(i, i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, song_ord bigint, embedding array<double>")


def cosines(a, b):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, where=n > 0, out=np.zeros_like(m))
    return np.round(unit(a) @ unit(b).T, vectors.SCORE_DIGITS)


@pytest.mark.parametrize("blocks", [{}, {"item_rows": 7}, {"item_rows": 16, "query_rows": 5}])
def test_block_topk_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(1)
    users, songs = rng.normal(size=(23, 6)), rng.normal(size=(60, 6))
    users[3] = 0
    songs[10] = 0
    songs[20:30] = songs[40]  # equal vectors: ties go to the lower song_ord
    got = similarity.similar_songs_topk(frame(spark, users, "user_id").drop("song_ord"), frame(spark, songs, "song_id"), 5, **blocks)
    want = cosines(users, songs)
    best = {u: sorted(range(60), key=lambda s: (-want[u, s], s))[:5] for u in range(23)}
    found = {}
    for r in got.collect():
        found.setdefault(r["user_id"], {})[r["rank"]] = (r["song_id"], r["similarity"])
    assert {u: [v[i][0] for i in range(1, 6)] for u, v in found.items()} == best
    assert all(abs(s - want[u, i]) < 1e-8 for u, v in found.items() for i, s in v.values())


def test_fewer_items_than_k(spark):
    users, songs = np.eye(2, 3), np.eye(3)
    got = similarity.similar_songs_topk(frame(spark, users, "user_id"), frame(spark, songs, "song_id"), 10)
    assert got.count() == 6


def test_no_items(spark):
    users = frame(spark, np.eye(2, 3), "user_id")
    none = frame(spark, np.eye(3), "song_id").where("song_id < 0")
    assert similarity.similar_songs_topk(users, none, 10).count() == 0


def small_log(spark):
    rows = [("a", 0, 1), ("a", 0, 1), ("a", 1, 1), ("a", 2, 0), ("a", 99, 1), ("b", 3, 1), ("c", 1, 0)]
    return spark.createDataFrame(rows, "user_id string, song_id bigint, label int")


def test_user_embedding_counts_repeats_and_ignores_unknown_songs(spark):
    m = np.array([[1.0, 0], [0, 1.0], [3, 3], [0, 0]])
    got = {r["user_id"]: r for r in embeddings.user_embedding(small_log(spark), frame(spark, m, "song_id")).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"]["n_liked"] == 3 and got["a"]["embedding"] == pytest.approx([2 / 3, 1 / 3])
    taste = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [1.0, 1.0, 1.0])], "user_id string, artist_vector array<double>")
    blended = {r["user_id"]: r["embedding"] for r in
               embeddings.user_embedding(small_log(spark), frame(spark, m, "song_id"), taste).collect()}
    assert blended["a"] == pytest.approx([0.7 * 2 / 3 + 0.3, 0.7 / 3 + 0.3])
    assert blended["b"] == [0.0, 0.0]  # another length: no blend


def test_collaborative_scores_equal_pairwise_means(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(12, 5))
    m[4] = 0
    log_rows = [(int(u), int(s), int(x)) for u, s, x in zip(rng.integers(0, 3, 60), rng.integers(0, 12, 60), rng.integers(0, 2, 60))]
    log = spark.createDataFrame(log_rows, "user_id bigint, song_id bigint, label int")
    pairs = spark.createDataFrame([(u, s) for u in range(4) for s in range(13)], "user_id bigint, song_id bigint")
    songs = frame(spark, m, "song_id")
    c = cosines(m, m)
    liked = {u: [s for v, s, x in log_rows if v == u and x] for u in range(4)}
    full = {(r["user_id"], r["song_id"]): r["collaborative_score"] for r in
            embeddings.collaborative_score(pairs, log, songs).collect()}
    loo = {(r["user_id"], r["song_id"]): r["collaborative_score"] for r in
           embeddings.collaborative_loo(pairs, log, songs).collect()}
    for u in range(4):
        for s in range(13):
            mean = lambda js: float(np.mean([c[s, j] for j in js])) if js and s < 12 else 0.0
            assert full[u, s] == pytest.approx(mean(liked[u]), abs=2e-9)
            assert loo[u, s] == pytest.approx(mean([j for j in liked[u] if j != s]), abs=2e-9)


def test_pca_keeps_cosines_of_scaled_features(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) * [1, 10, 100]
    rows = spark.createDataFrame([(i, i, 0, *map(float, r)) for i, r in enumerate(x)],
                                 "song_id int, song_ord int, artist_id int, p double, q double, r double")
    got = {r["song_id"]: r["embedding"] for r in embeddings.pca_embedding(rows, ["p", "q", "r"]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(cosines(np.array([got[i] for i in range(40)]), np.array([got[i] for i in range(40)])), cosines(z, z), atol=1e-8)
    model = embeddings.fit_pca(rows, ["p", "q", "r"])
    assert sum(embeddings.explained_variance(model)) == pytest.approx(1.0)


def test_blank_artist_has_no_vector(spark):
    rows = spark.createDataFrame([("a", [1.0]), ("a", [3.0]), (" ", [5.0])], "artist_id string, embedding array<double>")
    assert [(r["artist_id"], r["embedding"], r["n_songs"]) for r in embeddings.artist_embedding(rows).collect()] == [("a", [2.0], 2)]


def test_vector_sum_without_rows(spark):
    rows = spark.createDataFrame([], "k int, v array<double>")
    assert vectors.sum_vectors(rows, ["k"], "v", vectors.dimension(rows, "v"), n="count(1)").count() == 0
    assert rows.select(F.lit(1)).count() == 0


def test_no_item_is_copied_more_often_than_the_bounds_need():
    assert similarity.block_plan(1_000_000, 100_000_000, 2_000) == (16, 6_104)
    # Small sides: enough tasks, but no tiny blocks; the cheaper side is split.
    queries, items = similarity.block_plan(150, 100_000, 64)
    assert queries == 1 and 64 <= items < 128
    assert similarity.block_plan(10, 10, 64) == (1, 1) and similarity.block_plan(0, 0, 8) == (1, 1)
    queries, items = similarity.block_plan(1_000_000, 5_000, 512)
    assert queries * items >= 512 and items <= 2


def test_rows_of_equal_scores_keep_the_first_items():
    scores = np.zeros((3, 1_000))
    scores[1, [900, 5, 7]] = [2.0, 1.0, 1.0]
    scores[2] = -1.0
    rows, cols, rank = similarity.best_per_row(scores, 4)
    assert cols.reshape(3, 4).tolist() == [[0, 1, 2, 3], [900, 5, 7, 0], [0, 1, 2, 3]]
    assert rank.reshape(3, 4).tolist() == [[1, 2, 3, 4]] * 3
