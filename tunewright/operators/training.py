"""Training rows, splits, the gradient-boosted ranker and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright import session
from tunewright.functions import fixed, ordering, scalars, vectors
from tunewright.operators import boosting, embeddings


def known_songs_only(interactions: DataFrame, song_vectors: DataFrame, songs: DataFrame) -> DataFrame:
    """Rows whose song has both a vector and a catalog row."""
    return interactions.join(song_vectors.select("song_id"), "song_id", "left_semi").join(
        songs.select("song_id"), "song_id", "left_semi")


def training_set(interactions: DataFrame, songs: DataFrame, song_vectors: DataFrame,
                 artist_vectors: DataFrame, as_of: Column) -> DataFrame:
    """One row per interaction with a known song: the six features and the label.

    User vectors come from all likes without a blend; the collaborative score
    leaves the row's own song out; the penalty is 0.0. The log is read twice:
    once counted per (user, song), from which come one row per user and the
    features of each pair, and once for the labels. Vectors meet a pair once, in
    one row per song and one per user.
    """
    counted = session.settle(interactions.groupBy("user_id", "song_id").agg(
        F.count_if(F.col("label") == 1).alias("likes")), "counted-log")
    by_song = session.settle(
        songs.select("song_id", "artist_id", "released", "popularity_norm")
        .join(song_vectors.select("song_id", F.col("embedding").alias("_song"), vectors.unit("embedding").alias("direction")), "song_id")
        .join(artist_vectors.select("artist_id", F.col("embedding").alias("_artist")), "artist_id", "left"), "song-rows")
    by_user = session.settle(
        embeddings.user_embedding(counted, song_vectors).select("user_id", F.col("embedding").alias("_user"))
        .join(embeddings.liked_direction(counted, song_vectors), "user_id", "full")
        .join(embeddings.user_artist_vector(counted, songs, artist_vectors).select(
            "user_id", F.col("artist_vector").alias("_taste")), "user_id", "full"), "user-rows")
    rows = counted.join(by_song, "song_id").join(by_user, "user_id", "left")
    features = rows.select(
        "user_id", "song_id", vectors.cosine("_user", "_song").alias("content_similarity"),
        vectors.cosine("_taste", "_artist").alias("artist_similarity"),
        scalars.freshness("released", as_of).alias("freshness"),
        F.col("popularity_norm").alias("popularity"), embeddings.others_cosine().alias("collaborative_score"),
        F.lit(0.0).alias("diversity_penalty"))
    return interactions.select("user_id", "song_id", "label", "log_ord").join(features, ["user_id", "song_id"])


def dataset_profile(interactions: DataFrame) -> DataFrame:
    """One row: rows, distinct users and songs, likes and skips."""
    return interactions.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("user_id").alias("n_users"),
        F.count_distinct("song_id").alias("n_songs"),
        F.count_if(F.col("label") == 1).alias("n_liked"),
        F.count_if(F.col("label") == 0).alias("n_skipped"))


def feature_profile(features: DataFrame, columns: list[str] = fixed.FEATURES) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum per feature, 3 decimals."""
    long = features.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("e")).select("e.feature", "e.value")
    stats = long.groupBy("feature").agg(
        F.count("value").alias("n_rows"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = ordering.quantiles(long, "feature", "value", [0.25, 0.5, 0.75])
    named = stats.join(quartiles, "feature").withColumnsRenamed({"q_0": "q25", "q_1": "q50", "q_2": "q75"})
    numbers = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return named.select("feature", "n_rows", *[F.round(c, 3).alias(c) for c in numbers])


def group_split(rows: DataFrame, test_share: float = fixed.TEST_SHARE, seed: int = fixed.SEED) -> DataFrame:
    """Adds ``is_test``: the first ceil(share * users) users in hash order.

    With a single user, the last rows by ``log_ord`` are the test rows instead.
    Users are ranked in hash buckets, never in one task.
    """
    users = rows.select("user_id").distinct().withColumn(
        "_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("user_id").cast("string"))))
    n_users = users.count()
    if n_users < 2:
        total = rows.count()
        cuts = ordering.cut_points(rows, F.col("log_ord"))
        ranked = ordering.rank_in_buckets(rows, ["user_id"], ordering.bucket_of(F.col("log_ord"), cuts),
                                          [F.col("log_ord")])
        return ranked.withColumn("is_test", F.col("position") > int(total * (1 - test_share))).drop("position")
    n_test = -int(-(test_share * n_users) // 1)
    ranked = ordering.rank_in_buckets(users.withColumn("_all", F.lit(0)), ["_all"], F.left("_h", F.lit(3)),
                                      [F.col("_h"), F.col("user_id")])
    test = ranked.where(F.col("position") <= n_test).select("user_id", F.lit(True).alias("is_test"))
    return rows.join(test, "user_id", "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def group_split_join(rows: DataFrame, test_users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, test) by membership of the row's user."""
    picked = test_users.select("user_id")
    return rows.join(picked, "user_id", "left_anti"), rows.join(picked, "user_id", "left_semi")


def positive_rate(split: DataFrame) -> DataFrame:
    return split.groupBy("is_test").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("label").cast("double")).alias("positive_rate"))


def class_weights(rows: DataFrame) -> DataFrame:
    """``label, weight``: rows / (2 * rows of the class)."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select("label", (total / (F.lit(2.0) * F.col("n"))).alias("weight"))


def train_ranker(train: DataFrame, trees: int = fixed.TREES, validation_share: float = fixed.TEST_SHARE,
                 seed: int = fixed.SEED, patience: int = fixed.PATIENCE, leaves: int = fixed.LEAVES) -> boosting.Ranker:
    """Gradient-boosted trees on balanced classes, grown leaf by leaf.

    Early stopping watches users held out of the training rows, so the test
    users stay unseen. One run: it ends once ``patience`` trees brought no new
    least loss, and keeps the trees up to that least loss.
    """
    split = group_split(train, validation_share, seed + 1)
    # One row per class: the broadcast is bounded.
    weighted = split.join(F.broadcast(class_weights(train)), "label").select(
        *fixed.FEATURES, F.col("label").cast("double").alias("label"), "weight",
        F.col("is_test").alias("held_out"))
    return boosting.fit(weighted, fixed.FEATURES, trees, leaves, fixed.LEARNING_RATE, patience)


def feature_importance(model: boosting.Ranker) -> DataFrame:
    """``feature, importance``, most important first."""
    rows = list(zip(model.features, model.importance(), strict=True))
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")
