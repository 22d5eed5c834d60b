"""Scores of given pairs through blocks of vectors against single dot products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunewright.operators import embeddings, pair_dots, ranking


@pytest.mark.parametrize("user_rows, song_rows", [(1_000, 1_000), (7, 5), (100, 1)])
def test_each_pair_once_with_its_dots(spark, monkeypatch, user_rows, song_rows):
    monkeypatch.setattr(pair_dots, "PAIR_ROWS", 9)
    rng = np.random.default_rng(user_rows)
    users, songs = {f"u{i}": rng.normal(size=4) for i in range(40)}, {i: rng.normal(size=4) for i in range(30)}
    liked = {u: rng.normal(size=4) for u in list(users)[::2]}
    pairs = [(u, int(s), j) for u in [*users, "stranger"] for j, s in enumerate(rng.choice(33, 6, replace=False))]
    # One user with very many pairs, a repeated pair, and null ids.
    pairs += [("u3", i % 33, 100 + i) for i in range(400)] + [("u1", 2, 7), ("u1", 2, 7), (None, 3, 8), ("u2", None, 9)]
    table = spark.createDataFrame(pairs, "user_id string, song_id int, cand_pos int").repartition(3)
    left = spark.createDataFrame([(u, v.tolist()) for u, v in users.items()] + [("short", [1.0])], "user_id string, vector array<double>")
    likes = spark.createDataFrame([(u, v.tolist()) for u, v in liked.items()], "user_id string, vector array<double>")
    right = spark.createDataFrame([(s, v.tolist()) for s, v in songs.items()] + [(31, None), (32, [1.0, None, 1.0, 1.0])],
                                  "song_id int, vector array<double>")
    got = pair_dots.pair_dots(table, {"user": left, "liked": likes}, {"song": right},
                              {"a": ("user", "song"), "b": ("liked", "song")}, user_rows, song_rows)
    assert got.columns == ["user_id", "song_id", "cand_pos", "a", "b"]

    def dot(side, u, s):
        return pytest.approx(float(side[u] @ songs[s])) if u in side and s in songs else None

    key = lambda r: tuple((x is None, str(x)) for x in r[:3])
    rows = sorted((tuple(r) for r in got.collect()), key=key)
    assert rows == [(u, s, c, dot(users, u, s), dot(liked, u, s)) for u, s, c in sorted(pairs, key=key)]


def test_nothing_to_score(spark):
    pairs = spark.createDataFrame([], "user_id int, song_id int")
    vectors = spark.createDataFrame([(1, [1.0])], "user_id int, vector array<double>")
    songs = spark.createDataFrame([], "song_id int, vector array<double>")
    assert pair_dots.pair_dots(pairs, {"u": vectors}, {"s": songs}, {"d": ("u", "s")}).collect() == []
    one = spark.createDataFrame([(1, 2)], "user_id int, song_id int")
    assert [tuple(r) for r in pair_dots.pair_dots(one, {"u": vectors}, {"s": songs}, {"d": ("u", "s")}).collect()] == [(1, 2, None)]


@pytest.mark.parametrize("user_rows, song_rows", [(1_000, 1_000), (3, 2)])
def test_columns_of_the_songs_travel_with_the_vectors(spark, user_rows, song_rows):
    pairs = [(u, s, u * 10 + s) for u in range(8) for s in range(6)] + [(1, None, 7), (None, 2, 8), (1, 2, 12)]
    table = spark.createDataFrame(pairs, "user_id int, song_id int, cand_pos int")
    left = spark.createDataFrame([(u, [float(u)]) for u in range(7)], "user_id int, vector array<double>")
    right = spark.createDataFrame([(s, [2.0]) for s in range(1, 9)], "song_id int, vector array<double>")
    beside = spark.createDataFrame([(s, f"a{s}" if s else None, s / 4) for s in range(5)], "song_id int, artist_id string, fresh double")
    got = pair_dots.pair_dots(table, {"u": left}, {"s": right}, {"d": ("u", "s")}, user_rows, song_rows, beside)
    assert got.columns == ["user_id", "song_id", "cand_pos", "artist_id", "fresh", "d"]
    want = [(u, s, c, f"a{s}" if s else None, s / 4, 2.0 * u if s and u is not None and u < 7 else None)
            for u, s, c in pairs if s is not None and s < 5]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_ranking_features_need_no_exchange_by_song(spark):
    songs = spark.sql("SELECT id AS song_id, id AS song_ord, 'a' AS artist_id, TIMESTAMP'2001-01-01' AS released, 0.5D AS popularity_norm FROM range(20)")
    found = spark.sql("SELECT id AS user_id, id % 4 AS song_id, 1 AS cand_pos FROM range(5)")
    both = spark.sql("SELECT id AS song_id, array(1.0D, 2.0D) AS embedding FROM range(20)")
    users = spark.sql("SELECT id AS user_id, array(1.0D, 2.0D) AS embedding FROM range(5)")
    features = ranking.rank_features(found, songs, F.lit("2001-12-31").cast("timestamp"),
                                     song_vectors=both, user_vectors=users)
    plan = features._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan
    assert [r.content_similarity for r in features.collect()] == [1.0] * 5


def test_collaborative_scores_come_from_blocks(spark):
    rng = np.random.default_rng(3)
    songs = {s: rng.normal(size=3) for s in range(12)}
    unit = {s: v / np.linalg.norm(v) for s, v in songs.items()}
    log = [(int(u), int(s), int(rng.random() < 0.6)) for u, s in rng.integers(0, 12, size=(80, 2))]
    pairs = [(u, s, u + s) for u in range(14) for s in range(14)]
    got = embeddings.collaborative_score(
        spark.createDataFrame(pairs, "user_id int, song_id int, bought int"), spark.createDataFrame(log, "user_id int, song_id int, label int"),
        spark.createDataFrame([(s, v.tolist()) for s, v in songs.items()], "song_id int, embedding array<double>"))
    # A join would lay a vector beside each pair.
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    liked = {u: [unit[s] for v, s, label in log if v == u and label] for u in range(14)}
    want = [(u, s, b, pytest.approx(float(np.mean([unit[s] @ v for v in liked[u]])) if s in unit and liked[u] else 0.0, abs=1e-8)) for u, s, b in pairs]
    assert got.columns == ["user_id", "song_id", "bought", "collaborative_score"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_vector_sums_are_not_exchanged(spark):
    log = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1)], "user_id int, song_id int, label int")
    songs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "song_id int, embedding array<double>")
    sums = embeddings.user_embedding(log, F.broadcast(songs))
    assert sorted((r["user_id"], r["embedding"], r["n_liked"]) for r in sums.collect()) == [(1, [0.5, 1.5], 2), (2, [1.0, 0.0], 1)]
    # One exchange counts the likes, one brings them to their user; the vectors come by broadcast.
    plan = sums._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1]
    assert initial.count("Exchange hashpartitioning") == 2
