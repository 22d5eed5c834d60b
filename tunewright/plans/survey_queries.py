"""Queries over first-run lists and onboarding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunewright import session
from tunewright.operators import coldstart
from tunewright.plans import jobs
from tunewright.plans.catalog_queries import users
from tunewright.plans.oracle import check
from tunewright.plans.register import query
from tunewright.plans.vector_queries import brands
from tunewright.sources import bindings as b


def _pairs(spark, sf):
    return coldstart.pair_scores(b.purchases(spark, sf), b.songs(spark, sf), users(spark, sf), b.ITEM_GENRES)


def _written_pairs(spark, sf):
    """Read several times: the scores, and what a pool needs beside them."""
    return session.settle(_pairs(spark, sf).select(
        "user_id", "song_id", "song_ord", "artists", "familiar", "familiar_score", "discovery_score"), "scored-pairs")


def _pool(pairs, familiar):
    score = "familiar_score" if familiar else "discovery_score"
    return pairs.where(F.col("familiar") == F.lit(familiar)).select(
        "user_id", "song_id", "song_ord", "artists", F.col(score).alias("score"))


@query("pool_sort", check("""
  SELECT user_id, song_id, familiar, score, pos FROM (SELECT user_id, song_id, familiar, score,
      row_number() OVER (PARTITION BY user_id, familiar ORDER BY score DESC, song_ord) AS pos
    FROM (SELECT *, CASE WHEN familiar THEN familiar_score ELSE discovery_score END AS score FROM scored_pairs)) WHERE pos <= 10""",
    "scored_pairs"), doubles=("score",))
def pool_sort(spark, sf):
    rows = _pairs(spark, sf).withColumn("score", F.when(
        F.col("familiar"), F.col("familiar_score")).otherwise(F.col("discovery_score")))
    return coldstart.pool_sort(rows, 10).select("user_id", "song_id", "familiar", "score", "pos")


@query("artist_cap_pick", check("SELECT user_id, song_id, score, pos FROM bought_fam", "bought_fam"),
       doubles=("score",))
def artist_cap_pick(spark, sf):
    quotas = coldstart.slot_counts(users(spark, sf), 10).select("user_id", F.col("familiar_slots").alias("quota"))
    return coldstart.artist_cap_pick(_pool(_written_pairs(spark, sf), True), quotas, 10, True).drop("song_ord")


@query("pad_remaining", check("SELECT user_id, song_id, score, pos FROM bought_disc", "bought_disc"), doubles=("score",))
def pad_remaining(spark, sf):
    pairs = _written_pairs(spark, sf)
    found = coldstart.artist_cap_pick(
        _pool(pairs, True),
        coldstart.slot_counts(users(spark, sf), 10).select("user_id", F.col("familiar_slots").alias("quota")), 10, True)
    counts = found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    quotas = users(spark, sf).select("user_id").join(counts, "user_id", "left").select(
        "user_id", (F.lit(10) - F.coalesce("n", F.lit(0))).cast("int").alias("quota"))
    return coldstart.artist_cap_pick(_pool(pairs, False), quotas, 10, False, prefix=8).drop("song_ord")


@query("slot_reservation", check("SELECT user_id, song_id, score, familiar, rank FROM bought_list", "bought_list"),
       doubles=("score",))
def slot_reservation(spark, sf):
    pairs = _written_pairs(spark, sf)
    return coldstart.slot_reservation(
        _pool(pairs, True), _pool(pairs, False), users(spark, sf), 10).drop("song_ord")


@query("cold_start_recommend", check("SELECT user_id, song_id, score, familiar, rank FROM cold_list", "cold_list"),
       doubles=("score",))
def cold_start_recommend(spark, sf):
    return coldstart.cold_start_recommend(b.songs(spark, sf), users(spark, sf), 10, b.ITEM_GENRES).drop("song_ord")


@query("cold_start_with_artist_vectors", check("SELECT user_id, song_id, score, familiar, rank FROM vector_cold_list", "vector_cold_list"),
       doubles=("score",))
def cold_start_with_artist_vectors(spark, sf):
    by_brand, wanted = brands(spark, sf)
    return coldstart.cold_start_recommend(
        b.songs(spark, sf), users(spark, sf), 10, b.ITEM_GENRES,
        user_artist_vectors=wanted, artist_vectors=by_brand).drop("song_ord")


@query("cold_start_short_lists", check("SELECT user_id, song_id, score, familiar, rank FROM cold_list", "cold_list"),
       doubles=("score",))
def cold_start_short_lists(spark, sf):
    """Lists of two rows are too short for most users, so longer ones follow."""
    return coldstart.cold_start_recommend(b.songs(spark, sf), users(spark, sf), 10, b.ITEM_GENRES, list_rows=2).drop("song_ord")


def _answers(spark, sf):
    """The survey answers, some of them without the artists that a profile needs."""
    return b.answers(spark, sf).withColumn(
        "favorite_artists", F.when(F.col("user_id") % 50 == 7, F.array().cast("array<string>")).otherwise(F.col("favorite_artists")))


@query("onboarding_with_artist_vectors", check(
    "SELECT user_id, song_id, score, familiar, rank FROM vector_cold_list SEMI JOIN accepted USING (user_id)",
    "vector_cold_list", "accepted"), doubles=("score",))
def onboarding_with_artist_vectors(spark, sf):
    by_brand, wanted = brands(spark, sf)
    picks = b.interactions(spark, sf).select("user_id", "song_id", "label")
    return jobs.onboard_users(_answers(spark, sf), b.songs(spark, sf), picks, b.song_vectors(spark, sf), b.ITEM_GENRES, 10,
                              user_artist_vectors=wanted, artist_vectors=by_brand)["first_lists"].drop("song_ord")


# All five outputs as rows (output, user_id, item, text, value, place).
@query("user_onboarding_batch", check("""
  SELECT 'rejected' AS output, user_id, CAST(NULL AS BIGINT) AS item, 'favorite_artists needs 3 to 5' AS text, 0.0 AS value, 0 AS place
    FROM users WHERE user_id % 50 = 7
  UNION ALL SELECT 'profiles', user_id, NULL, name || '|' || array_to_string(favorite_artists, ','), exploration_weight, 0 FROM accepted
  UNION ALL SELECT 'profiles', user_id, -1, 'targets', te + 10 * tv, 0 FROM accepted
  UNION ALL SELECT 'first_lists', user_id, song_id, CASE WHEN familiar THEN 'familiar' ELSE 'discovery' END, score, rank
    FROM cold_list SEMI JOIN accepted USING (user_id)
  UNION ALL SELECT 'log_rows', user_id, song_id, '2024-03-01 09:00:00', label + 10 * label, count(*)
    FROM log SEMI JOIN accepted USING (user_id) GROUP BY user_id, song_id, label
  UNION ALL SELECT 'user_vectors', user_id, n_liked, '', x, pos FROM user_vec_long SEMI JOIN accepted USING (user_id)""",
    "accepted", "cold_list", "log", "user_vec_long"), doubles=("value",), wholes=("user_id", "item", "place"))
def user_onboarding_batch(spark, sf):
    answers = _answers(spark, sf)
    picks = b.interactions(spark, sf).select("user_id", "song_id", "label")
    done = jobs.onboard_users(answers, b.songs(spark, sf), picks, b.song_vectors(spark, sf), b.ITEM_GENRES,
                              at=F.lit("2024-03-01 09:00:00"))

    def rows(output: str, df, item, text, value, place):
        return df.select(F.lit(output).alias("output"), F.col("user_id").cast("long").alias("user_id"), item.cast("long").alias("item"),
                         text.alias("text"), value.cast("double").alias("value"), place.cast("long").alias("place"))

    none, zero = F.lit(None), F.lit(0)
    profiles, logged = done["profiles"], done["log_rows"].groupBy("user_id", "song_id", "label", "play_count", "timestamp").count()
    parts = [
        rows("rejected", done["rejected"], none, F.array_join("problems", ","), zero, zero),
        rows("profiles", profiles, none, F.concat_ws("|", "name", F.array_join("favorite_artists", ",")), F.col("exploration_weight"), zero),
        rows("profiles", profiles, F.lit(-1), F.lit("targets"),
             F.col("mood_targets.target_energy") + 10 * F.col("mood_targets.target_valence"), zero),
        rows("first_lists", done["first_lists"], F.col("song_id"),
             F.when(F.col("familiar"), "familiar").otherwise("discovery"), F.col("score"), F.col("rank")),
        rows("log_rows", logged, F.col("song_id"), F.col("timestamp"), F.col("label") + 10 * F.col("play_count"), F.col("count")),
        rows("user_vectors", done["user_vectors"].select("user_id", "n_liked", F.posexplode("embedding").alias("pos", "x")),
             F.col("n_liked"), F.lit(""), F.col("x"), F.col("pos")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
