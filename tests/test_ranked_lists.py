"""Features and ranks of packed candidate lists against those of single rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  # registers the queries
from tunewright.functions import fixed
from tunewright.operators import boosting, candidates, pair_dots, ranking
from tunewright.plans import text_queries


def as_of():
    return F.lit("2001-12-31").cast("timestamp")


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)
    vector = lambda: rng.normal(size=4).tolist()
    # Song 40 has two catalog rows, 41 no artist, 42 no popularity, 43 a NaN; 44 and above are not in the catalog.
    songs = [(s, s, None if s == 41 else f"a{s % 5}", None if s == 42 else float("nan") if s == 43 else s % 7 / 7) for s in range(44)] + [(40, 99, "b", 0.9)]
    catalog = spark.createDataFrame(songs, "song_id long, song_ord long, artist_id string, popularity_norm double").withColumn(
        "released", F.lit("2001-11-30").cast("timestamp"))
    found = [(u, int(s), p) for u in range(60) for p, s in enumerate(rng.permutation(47)[:u % 13 + 1], 1)] + [(None, 3, 1), (70, 45, 1)]
    return {
        "songs": catalog,
        "found": spark.createDataFrame(found, "user_id long, song_id long, cand_pos int").repartition(3),
        "log": spark.createDataFrame(rng.integers(0, [50, 40, 2], size=(300, 3)).tolist(), "user_id long, song_id long, label int"),
        "song_vectors": spark.createDataFrame([(s, vector()) for s in range(40)] + [(42, None), (43, [1.0])], "song_id long, embedding array<double>"),
        "user_vectors": spark.createDataFrame([(u, vector()) for u in range(0, 60, 2)], "user_id long, embedding array<double>"),
        "artist_vectors": spark.createDataFrame([(f"a{i}", vector()) for i in range(4)], "artist_id string, embedding array<double>"),
        "user_artist_vectors": spark.createDataFrame([(u, vector()) for u in range(0, 60, 3)], "user_id long, artist_vector array<double>"),
    }


def features(tables, found, **without):
    names = [n for n in ("song_vectors", "user_vectors", "artist_vectors", "user_artist_vectors") if n not in without]
    return ranking.rank_features(found, tables["songs"], as_of(), None if "log" in without else tables["log"], **{n: tables[n] for n in names})


def ordered(df):
    columns = ["user_id", "song_id", "cand_pos", *fixed.FEATURES, *[c for c in ("score", "rank") if c in df.columns]]
    return sorted((tuple(str(x) for x in r) for r in df.select(*columns).collect()))


@pytest.mark.parametrize("list_rows", [1, 7, 4_096])
@pytest.mark.parametrize("without", [[], ["artist_vectors"], ["song_vectors", "user_vectors", "artist_vectors", "log"]])
def test_lists_have_the_features_of_rows(tables, monkeypatch, list_rows, without):
    monkeypatch.setattr(pair_dots, "LIST_ROWS", list_rows)
    left_out = dict.fromkeys(without)
    lists = features(tables, candidates.listed(tables["found"], "cand_pos"), **left_out)
    rows = features(tables, tables["found"], **left_out)
    assert ranking.packed(lists) and not ranking.packed(rows)
    assert ranking.feature_rows(lists).schema.simpleString() == rows.schema.simpleString()
    assert ordered(ranking.feature_rows(lists)) == ordered(rows)
    for top_n in (3, 50):
        best, want = ranking.rank(lists, top_n=top_n), ranking.rank(rows, top_n=top_n)
        assert best.columns == want.columns and ordered(best) == ordered(want)


def test_union_of_lists_equals_union_of_rows(spark):
    rng = np.random.default_rng(5)
    rows = {side: [(u, int(s), p) for u in users for p, s in enumerate(rng.permutation(30)[:12], 1)]
            for side, users in (("first", range(0, 20, 3)), ("second", [*range(0, 20, 2), None]))}
    first, second = (spark.createDataFrame(rows[side], "user_id int, song_id int, pos int") for side in ("first", "second"))
    want = candidates.ordered_union(first, second, 15)
    got = candidates.ordered_union(candidates.listed(first), candidates.listed(second), 15)
    assert got.columns == ["user_id", "songs"]
    spread = got.select("user_id", F.posexplode("songs").alias("p", "song_id")).select("user_id", "song_id", F.col("p") + 1)
    assert sorted(map(str, map(tuple, spread.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_blocks_follow_the_users_and_rows_are_not_sorted(tables, monkeypatch):
    """Users without vectors count too: the rows of a block do not grow with the number of users."""
    monkeypatch.setattr(pair_dots, "LIST_ROWS", 5)
    found = tables["found"].where("user_id IS NOT NULL").select((F.col("user_id") + 1_000).alias("user_id"), "song_id", "cand_pos")
    pool = candidates.listed(found, "cand_pos")
    ranked = ranking.rank(features(tables, pool), top_n=2)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapCoGroupsInArrow" in plan
    block = ranked._jdf.queryExecution().optimizedPlan().toString()
    # 61 users in blocks of 5.
    assert "pmod(xxhash64(user_id" in block and ", 13)" in block
    known = found.where("song_id < 44").groupBy("user_id").count()
    assert ranked.count() == sum(min(2, r["count"]) for r in known.collect())


def test_a_model_scores_the_rows_of_lists(tables, monkeypatch):
    monkeypatch.setattr(ranking, "score_model", lambda rows, model: rows.withColumn("score", F.col("content_similarity") - F.col("diversity_penalty")))
    lists, rows = (features(tables, found) for found in (candidates.listed(tables["found"], "cand_pos"), tables["found"]))
    assert ordered(ranking.rank(lists, model=object(), top_n=3)) == ordered(ranking.rank(rows, model=object(), top_n=3))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are absent")
def test_explained_lists_are_ranked_once(spark):
    joined = text_queries.ranked_join_explanations(spark, "/root/testdata/sf0.001")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" not in plan


def test_workers_need_no_copy_of_the_package(spark, monkeypatch):
    from pyspark import cloudpickle

    sent = []
    packed = spark.createDataFrame([], "user_id long, song_id array<long>, cand_pos array<int>, content_similarity array<double>")
    monkeypatch.setattr(type(packed), "mapInArrow", lambda self, rows, schema: sent.append(rows))
    ranking.fallback_ranked(packed)
    assert b"tunewright.functions" not in cloudpickle.dumps(sent[0])


def random_trees(rng, count, splits, cuts=40):
    trees = []
    for _ in range(count):
        tree = boosting.Tree()
        ends = [tree.add(float(rng.normal()))]
        for _ in range(splits):
            node = ends.pop(int(rng.integers(len(ends))))
            tree.feature[node], tree.threshold[node] = int(rng.integers(len(fixed.FEATURES))), float(rng.integers(cuts) / cuts)
            tree.left[node], tree.right[node] = tree.add(float(rng.normal())), tree.add(float(rng.normal()))
            ends += [tree.left[node], tree.right[node]]
        trees.append(tree)
    return trees


@pytest.mark.parametrize("splits", [0, 1, 5, 30, 31, 40, 63, 70])
def test_tables_find_the_leaves_of_a_walk(monkeypatch, splits):
    monkeypatch.setattr(boosting, "SCORED_ROWS", 300)
    rng = np.random.default_rng(splits)
    trees = random_trees(rng, 7, splits)
    columns = np.where(rng.random((6, 1_000)) < 0.5, rng.integers(0, 41, (6, 1_000)) / 40, rng.random((6, 1_000)) * 1.4 - 0.2)
    columns[rng.random((6, 1_000)) < 0.05] = np.nan
    columns[rng.random((6, 1_000)) < 0.02] = -np.inf
    want = np.zeros(1_000)
    for tree in trees:
        want += np.array(tree.value)[tree.leaf_of(columns)]
    scorer = boosting.Scorer(trees, 6)
    assert np.array_equal(scorer.margin(columns), want)
    assert (scorer.words is None) == (splits > 63)


def test_a_ranker_ranks_lists_where_they_lie(tables):
    model = boosting.Ranker(list(fixed.FEATURES), random_trees(np.random.default_rng(2), 9, 12))
    lists, rows = (features(tables, found) for found in (candidates.listed(tables["found"], "cand_pos"), tables["found"]))
    for top_n in (3, 50):
        best = ranking.rank(lists, model, top_n)
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Generate" not in plan.split("FlatMapCoGroupsInArrow")[0]
        assert ordered(best) == ordered(ranking.rank(rows, model, top_n))


def test_hits_reach_their_users_as_lists(spark):
    from tunewright.plans import jobs

    hits = spark.createDataFrame([(f"q{q}", 10 * q + (p * 7) % 5, p) for q in range(4) for p in range(1, 6)], "query_id string, song_id long, pos int")
    asking = spark.createDataFrame([(u, f"q{u % 5}") for u in range(40)] + [(7, "q0"), (None, "q1")], "user_id long, intent string")
    lists = jobs.listed_hits(asking, hits)
    rows = asking.join(hits, F.col("intent") == F.col("query_id")).select("user_id", "song_id", "pos")
    want = candidates.listed(rows, "pos")
    assert lists.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, lists.collect())) == sorted(map(str, want.collect()))
    # No row per user and hit is made.
    plan = lists._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "collect_list(hits" in plan
