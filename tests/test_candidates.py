"""Songs by artist in blocks of users against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tunewright.operators import candidates


def first_songs(asked, songs, limit):
    want = []
    for user in {u for u, _ in asked}:
        names = {a for u, a in asked if u == user}
        listed = sorted({(o, s) for s, o, artists in songs if names & set(artists)})
        want += [(user, s, o, p) for p, (o, s) in enumerate(listed[:limit], 1)]
    return sorted(want, key=str)


@pytest.mark.parametrize("limit, rows", [(5, 1), (40, 7), (200, 100_000)])
def test_first_songs_of_known_artists(spark, monkeypatch, limit, rows):
    monkeypatch.setattr(candidates, "ASKED_ROWS", rows)
    rng = random.Random(limit)
    songs = [(f"s{i}", i * 3, rng.sample("abcdefgh", rng.choice([1, 1, 2, 3]))) for i in range(120)]
    asked = [(u, a) for u in range(25) for a in rng.sample("abcdefghxyz", 4)] + [(99, "nobody"), (99, None), (98, "a"), (98, "a")]
    table = spark.createDataFrame(songs, "song_id string, song_ord long, artists array<string>")
    users = spark.createDataFrame(asked, "user_id long, artist string").groupBy("user_id").agg(
        F.collect_list("artist").alias("favorite_artists")).withColumn("recent_artists", F.lit(None).cast("array<string>"))
    got = candidates.known_artist_songs(table, users, limit)
    assert sorted((tuple(r) for r in got.collect()), key=str) == first_songs(asked, songs, limit)
    by_one = [(s, o, [a]) for s, o, artists in songs for a in artists]
    one = spark.createDataFrame([(s, o, a[0]) for s, o, a in by_one], "song_id string, song_ord long, artist_id string")
    near = spark.createDataFrame(asked, "user_id long, artist_id string")
    got = candidates.similar_artist_songs(one, near, limit)
    assert sorted((tuple(r) for r in got.collect()), key=str) == first_songs(asked, by_one, limit)


def test_no_row_per_user_and_offered_song(spark):
    songs = spark.range(3000).select(F.col("id").alias("song_id"), F.col("id").alias("song_ord"), F.array(F.lit("a")).alias("artists"))
    users = spark.range(50).select(F.col("id").alias("user_id"), F.array(F.lit("a")).alias("favorite_artists"),
                                   F.array().cast("array<string>").alias("recent_artists"))
    got = candidates.known_artist_songs(songs, users, 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # The join that ships lists meets (block, artist), never a user.
    assert all("user_id" not in line for line in plan.splitlines() if "Join" in line) and "CoGroup" in plan
    assert sorted(r.pos for r in got.collect()) == sorted([1, 2, 3] * 50)


def test_nobody_asks_and_nothing_is_offered(spark):
    songs = spark.createDataFrame([], "song_id long, song_ord long, artists array<string>")
    users = spark.createDataFrame([(1, ["a"], None)], "user_id long, favorite_artists array<string>, recent_artists array<string>")
    assert candidates.known_artist_songs(songs, users).collect() == []
    assert candidates.known_artist_songs(songs, users.limit(0)).collect() == []
