"""Pools, rankings, histories, explanations, metrics and splits on small hand-made data."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tunewright.functions import ordering
from tunewright.operators import artists, candidates, evaluation, explain, history, ranking, training


def as_of():
    return F.lit("2024-01-01").cast("timestamp")


@pytest.mark.parametrize("at_least, count", [(1, 2), (3, 3), (4, 5), (6, 7)])
def test_freshness_window_relaxes(spark, at_least, count):
    days = ["2023-12-20", "2023-11-01", "2023-08-01", "2023-02-01", "2023-01-15", "1999-01-01", None]
    songs = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "song_id int, d string").select(
        "song_id", F.col("d").cast("timestamp").alias("released"))
    assert candidates.fresh_songs(songs, as_of(), at_least=at_least).count() == count


def test_ordered_union(spark):
    first = spark.createDataFrame([(1, 5, 1), (1, 3, 2)], "user_id int, song_id int, pos int")
    second = spark.createDataFrame([(1, 3, 1), (1, 9, 2), (1, 11, 3), (2, 3, 1)], "user_id int, song_id int, pos int")
    got = candidates.ordered_union(first, second, 3).orderBy("user_id", "cand_pos").collect()
    assert [tuple(r) for r in got] == [(1, 5, 1), (1, 3, 2), (1, 9, 3), (2, 3, 1)]


def test_pool_without_vectors_is_the_name_match(spark):
    songs = spark.createDataFrame([(i, i, ["a"] if i % 2 else ["b", "c"], "x") for i in range(300)],
                                  "song_id int, song_ord int, artists array<string>, artist_id string").withColumn(
        "released", F.lit("2023-12-31").cast("timestamp"))
    users = spark.createDataFrame([(1, ["a", "c"], ["zz"]), (2, ["c"], []), (3, [], [])],
                                  "user_id int, favorite_artists array<string>, recent_artists array<string>")
    pool = candidates.candidate_pool(songs, users, as_of())
    per_user = {u: sorted((r["cand_pos"], r["song_id"]) for r in pool.where(F.col("user_id") == u).collect()) for u in (1, 2, 3)}
    assert [s for _, s in per_user[1]] == list(range(200))
    assert [s for _, s in per_user[2]] == list(range(0, 300, 2))
    assert per_user[3] == []


def test_diversity_penalty(spark):
    rows = spark.createDataFrame([(1, i, a, i) for i, a in enumerate("ABAA")], "user_id int, song_id int, artist_id string, cand_pos int")
    got = ranking.diversity_penalty(rows).orderBy("cand_pos").collect()
    assert [r["diversity_penalty"] for r in got] == [0, 0, 1, 2]


def test_ranking_ties_keep_candidate_order(spark):
    rows = spark.createDataFrame([(1, 7, 2, 0.5), (1, 8, 1, 0.5), (1, 9, 3, 0.9)], "user_id int, song_id int, cand_pos int, score double")
    assert [r["song_id"] for r in ranking.rank_topn(rows, 2).orderBy("rank").collect()] == [9, 8]


def test_features_without_vectors_are_zero(spark):
    songs = spark.createDataFrame([(1, 1, "a", 0.5)], "song_id int, song_ord int, artist_id string, popularity_norm double").withColumn(
        "released", F.lit(None).cast("timestamp"))
    wanted = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "user_id int, song_id int, cand_pos int")
    rows = ranking.rank_features(wanted, songs, as_of()).collect()
    assert len(rows) == 1
    assert [rows[0][c] for c in ranking.fixed.FEATURES] == [0.0, 0.0, 0.0, 0.5, 0.0, 0.0]
    assert ranking.feature_matrix(ranking.rank_features(wanted, songs, as_of())).first()["features"].size == 6


def test_history_sentences(spark):
    log = spark.createDataFrame(
        [("a", 1, 1, 0), ("b", 1, 1, 1), ("b", 2, 1, 2), ("b", 3, 0, 3), ("b", 9, 1, 4), ("b", 2, 1, 5), ("c", 1, 0, 6)],
        "user_id string, song_id int, label int, log_ord bigint")
    genres = spark.createDataFrame([(1, "jazz"), (2, "pop"), (3, "folk")], "song_id int, genre string")
    users = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "user_id string")
    got = {r["user_id"]: r["summary"] for r in history.history_summary(log, genres, users).collect()}
    assert got == {
        "a": "Liked 1 song. Mostly jazz.",
        "b": "Liked 4 songs. Skipped 1. Mostly pop, jazz, unknown.",
        "c": "Liked 0 songs. Skipped 1.",
        "d": "No listening history yet.",
    }


def test_explanations(spark):
    answers = [
        (1, '{"explanations": [{"song_id": "5", "explanation": "x"}, {"explanation": "lost"}, {"song_id": "5", "explanation": "y"}, {"song_id": "6"}]}'),
        (2, "not json"), (3, '{"other": 1}'), (4, None),
    ]
    rows = spark.createDataFrame(answers, "user_id int, response string")
    got = explain.parse_explanations(rows)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "5", "y"), (1, "6", "")]
    ranked = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 5, 1)], "user_id int, song_id int, rank int")
    joined = explain.ranked_join_explanations(ranked, got).orderBy("user_id", "rank").collect()
    assert [r["explanation"] for r in joined] == ["y", "", ""]
    assert explain.ranked_join_explanations(ranked, None).first()["explanation"] == ""


def test_prompt(spark):
    listed = spark.createDataFrame([(1, 2, 8, "B", "b", 0.5), (1, 1, 7, 'A "q"', "a", 0.12345)],
                                   "user_id int, rank int, song_id int, title string, artist string, score double")
    asked = spark.createDataFrame([(1, "calm 100%", "No listening history yet.")], "user_id int, intent string, summary string")
    text = explain.explanation_prompt(listed, asked, 2).first()["prompt"]
    assert 'A listener searched for: "calm 100%"' in text and "these 2 songs" in text
    assert '[{"rank":1,"song_id":"7","title":"A \\"q\\"","artist":"a","ml_score":0.1235},{"rank":2,' in text


def test_gate(spark):
    rows = spark.createDataFrame([("x", True), (" ", True), (None, True), ("x", False)], "i string, s boolean")
    assert [r[0] for r in rows.select(explain.explanation_gate("i", "s")).collect()] == [True, False, False, False]


def scored(spark, rows):
    return spark.createDataFrame([(u, l, float(s), i) for i, (u, l, s) in enumerate(rows)], "user_id int, label int, score double, row_ord int")


def test_metrics(spark):
    rows = scored(spark, [(1, 1, 9), (1, 0, 8), (1, 1, 7), (2, 1, 3), (2, 1, 2), (2, 1, 1), (3, 0, 1), (3, 0, 2), (3, 0, 3), (4, 1, 1)])
    got = {r["user_id"]: r for r in evaluation.user_metrics(rows, 3).collect()}
    assert got[1]["ndcg"] == pytest.approx(1.5 / (1 + 1 / math.log2(3)), abs=1e-9)
    assert (got[2]["precision"], got[2]["recall"], got[2]["ndcg"]) == (1.0, 1.0, 1.0)
    assert (got[3]["precision"], got[3]["recall"], got[3]["ndcg"]) == (0.0, 0.0, 0.0)
    average = evaluation.macro_average(evaluation.user_metrics(rows, 3), 3).first()
    assert average["n_users"] == 2 and sorted(r["user_id"] for r in evaluation.eligible_users(rows, 3).collect()) == [1, 2]


def test_auc(spark):
    rng = random.Random(5)
    rows = [(1, rng.randrange(2), rng.randrange(30)) for _ in range(400)]
    pos, neg = [s for _, l, s in rows if l], [s for _, l, s in rows if not l]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluation.auc(scored(spark, rows)).first()["auc"] == pytest.approx(want)
    assert evaluation.auc(scored(spark, [(1, 1, 1), (1, 1, 2)])).first()["auc"] is None


def test_ranks_in_buckets_equal_one_window(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(rng.choice("aaab"), rng.randrange(50), i) for i in range(500)], "k string, v int, i int")
    cuts = ordering.cut_points(rows, F.col("v"), 8)
    assert 0 < len(cuts) < 8
    ranked = ordering.rank_in_buckets(rows, ["k"], ordering.bucket_of(F.col("v"), cuts), [F.col("v"), F.col("i")], "p", "n")
    want = rows.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("v", "i"))).withColumn(
        "n", F.count("*").over(Window.partitionBy("k")))
    assert sorted(map(tuple, ranked.select("k", "v", "i", "p", "n").collect())) == sorted(map(tuple, want.collect()))


def test_running_totals(spark):
    rows = spark.createDataFrame([(float(i * 7 % 101), i) for i in range(101)], "v double, a int")
    got = ordering.running_totals(rows, "v", ["a"], 7).orderBy("v").collect()
    total = 0
    for r in got:
        total += r["a"]
        assert r["a_upto"] == total


def test_group_split_keeps_users_whole(spark):
    rows = spark.createDataFrame([(u, i) for u in range(11) for i in range(3)], "user_id int, log_ord int")
    split = training.group_split(rows)
    per_user = split.groupBy("user_id").agg(F.count_distinct("is_test").alias("n"), F.first("is_test").alias("t")).collect()
    assert all(r["n"] == 1 for r in per_user) and sum(r["t"] for r in per_user) == 3
    single = training.group_split(rows.where("user_id = 1").withColumn("log_ord", F.col("log_ord")))
    assert [r["is_test"] for r in single.orderBy("log_ord").collect()] == [False, False, True]


def test_top_artists_and_search(spark):
    songs = spark.createDataFrame([(1, "Red Sky", "Ann; Bob", 0.5, 1), (2, "Blue", "Bob", 0.9, 2), (3, "Infrared", ";Cy", 0.1, 3)],
                                  "song_id int, title string, artist_name string, popularity double, song_ord int").withColumn(
        "genre", F.lit("")).withColumn("artists", F.transform(F.split("artist_name", ";"), lambda x: F.trim(x)))
    assert [r["artist"] for r in artists.top_artists(songs, 2).collect()] == ["Ann", "Bob"]
    assert [r["song_id"] for r in artists.song_search(songs, "rEd").collect()] == [1, 3]
    chosen = spark.createDataFrame([(1,)], "song_id int")
    assert [r["song_id"] for r in artists.song_search(songs, "red", chosen).collect()] == [3]
    assert artists.song_search(songs, "  ").count() == 0


def test_search_of_many_texts_equals_single_searches(spark):
    songs = spark.createDataFrame([(i, f"Tune {i * 37 % 50}", f"Ann {i % 7};Bob", i) for i in range(80)],
                                  "song_id int, title string, artist_name string, song_ord int").withColumn("genre", F.lit(""))
    texts = {1: "E 1", 2: "ann 3", 3: "none", 4: " ", 5: "bob", 6: "BOB"}
    queries = spark.createDataFrame(list(texts.items()), "query_id int, text string")
    chosen = spark.createDataFrame([(5, 0), (5, 1), (2, 3), *[(6, i) for i in range(70)]], "query_id int, song_id int")
    for run in ({}, {"first_run": 3}):
        got = artists.song_search_many(songs, queries, chosen, 5, **run).orderBy("query_id", "pos").collect()
        for q, t in texts.items():
            want = artists.song_search(songs, t, chosen.where(F.col("query_id") == q), 5).collect()
            assert [r["song_id"] for r in got if r["query_id"] == q] == [r["song_id"] for r in want]
            assert [r["pos"] for r in got if r["query_id"] == q] == list(range(1, len(want) + 1))


def test_search_of_many_texts_with_odd_texts(spark):
    """Nulls, blanks, texts of any length, characters outside the basic plane, line breaks, patterns, repeated titles."""
    titles = ["", None, "a", "ab", "abc", "abcd", "ABCABC", "a\nb\nc", "\U0001f3b5\U0001f3b6 song", "x" * 3000 + "yz", "(.*)", "abcd"]
    songs = spark.createDataFrame([(i, t, "b;c" if i % 2 else None, i) for i, t in enumerate(titles)],
                                  "song_id int, title string, artist_name string, song_ord int").withColumn("genre", F.lit(""))
    texts = ["a", "bc", "abc", "bcab", "a\nb", "\U0001f3b5", "\U0001f3b5\U0001f3b6 ", "xyz", "x" * 2000, ".*", "(.*)", "b;c", "cd", None, "  ",
             "d;b", "abcdb"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    got = artists.song_search_many(songs, queries, limit=3, first_run=1).orderBy("query_id", "pos").collect()
    for q, t in enumerate(texts):
        holds = [i for i, title in enumerate(titles) if t and t.strip()
                 and (t in (title or "").lower() or t in ("b;c" if i % 2 else ""))]
        assert [r["song_id"] for r in got if r["query_id"] == q] == holds[:3], t
    assert artists.song_search_many(songs.limit(0), queries).count() == 0
    assert artists.song_search_many(songs, queries.limit(0)).count() == 0


def test_texts_meet_only_songs_with_their_rarest_piece(spark):
    songs = spark.createDataFrame([(i, f"common tune {'zebra' if i == 7 else 'horse'}", "", i) for i in range(50)],
                                  "song_id int, title string, artist_name string, song_ord int")
    texts = spark.createDataFrame([("tune zebra",), ("tune",), ("mon tunes",)], "text string")
    rarest = {r["text"]: r["n_songs"] for r in artists.rarest_grams(texts, artists.song_grams(songs)).collect()}
    assert rarest == {"tune zebra": 1, "tune": 50}


def test_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    data = {"a": rng.integers(0, 9, 501).astype(float), "b": rng.random(640), "c": np.array([3.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "k string, v double")
    for r in ordering.quantiles(rows, "k", "v", [0.25, 0.5, 0.9], 8).collect():
        assert [r["q_0"], r["q_1"], r["q_2"]] == pytest.approx(list(np.quantile(data[r["k"]], [0.25, 0.5, 0.9])))


def test_ranks_by_narrowing_equal_a_sort(spark, monkeypatch):
    """Ties, long tails, extremes, nulls and few cuts, so that several passes are needed."""
    import numpy as np

    rng = np.random.default_rng(9)
    monkeypatch.setattr(ordering, "CUTS", 16)
    monkeypatch.setattr(ordering, "ACCURACY", 256)
    data = {"tied": [0.0] * 900 + [1.0] * 50 + list(rng.random(550)), "tail": [float(x) for x in np.exp(rng.normal(0, 40, 1500))],
            "one": [5.0] * 700, "few": [2.0, -1.0, float("inf")]}
    rows = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs] + [("few", None), ("none", None)],
                                 "k string, v double")
    ranks = {"tied": [0, 899, 900, 1449, 1450, 1499], "tail": [0, 1, 700, 750, 1498, 1499], "one": [0, 350, 699], "few": [0, 1, 2]}
    wanted = spark.createDataFrame([(k, i, r) for k, rs in ranks.items() for i, r in enumerate(rs)], "k string, id int, rank long")
    got = {(r["k"], r["id"]): r["value"] for r in ordering.at_ranks(rows, "k", "v", wanted, fit=20).collect()}
    assert got == {(k, i): sorted(data[k])[r] for k, rs in ranks.items() for i, r in enumerate(rs)}
    assert ordering.at_ranks(rows.limit(0), "k", "v", wanted, fit=20).count() == 0


def test_a_burst_is_cut_by_the_tie(spark):
    rows = [(1, 5, i) for i in range(1_000)] + [(1 + i % 3, i % 11, 1_000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v bigint, tie bigint")
    marked = df.withColumn("b", ordering.ordered_buckets(df, F.col("v"), F.col("tie"), 16))
    got = marked.collect()
    order = [(r["b"], r["v"], r["tie"]) for r in got]
    assert [x[1:] for x in sorted(order)] == sorted((r["v"], r["tie"]) for r in got)
    assert marked.groupBy("k", "b").count().agg(F.max("count")).first()[0] <= 150


def test_long_lists_of_cuts(spark):
    cuts = list(range(0, 3_000, 7))
    rows = spark.range(-5, 3_010)
    wrong = rows.withColumn("b", ordering.bucket_of(F.col("id"), cuts)).where(
        F.col("b") != F.when(F.col("id") < 0, 0).otherwise(F.least(F.floor(F.col("id") / 7) + 1, F.lit(len(cuts)))))
    assert wrong.count() == 0
    assert ordering.bucket_count(10) == 64 and ordering.bucket_count(200_000_000) == 200 and ordering.bucket_count(10**12) == 4_096
