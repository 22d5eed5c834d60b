"""Listening history per user: counts, genres, one-line summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunewright.functions import fixed
from tunewright.sources.interactions import liked

NO_HISTORY = "No listening history yet."


def history_join_genre(interactions: DataFrame, genres: DataFrame) -> DataFrame:
    """Interactions with their song's genre, ``unknown`` for songs outside the catalog."""
    return interactions.join(genres.select("song_id", "genre"), "song_id", "left").withColumn(
        "genre", F.coalesce("genre", F.lit("unknown")))


def history_counts(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("user_id").agg(
        F.count_if(F.col("label") == 1).alias("likes"),
        F.count_if(~F.col("label").eqNullSafe(1)).alias("skips"))


def liked_genre_counts(interactions: DataFrame, genres: DataFrame) -> DataFrame:
    """Likes per user and genre, with the log position of the first one.

    Likes are summed per (user, song) before the catalog is joined.
    """
    per_song = liked(interactions).groupBy("user_id", "song_id").agg(
        F.count(F.lit(1)).alias("likes"), F.min("log_ord").alias("first_ord"))
    return history_join_genre(per_song, genres).groupBy("user_id", "genre").agg(
        F.sum("likes").alias("likes"), F.min("first_ord").alias("first_ord"))


def history_summary(interactions: DataFrame, genres: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """``user_id, summary``: likes, skips and the three most liked genres in one line.

    Genre ties go to the genre liked first. With ``users``, those without any
    interaction get the empty-history sentence.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("likes"), "first_ord")
    top = liked_genre_counts(interactions, genres).withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= fixed.SUMMARY_GENRES)
    named = top.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_n", "genre"))).alias("_top"))
    rows = history_counts(interactions).join(named, "user_id", "left")
    if users is not None:
        rows = users.select("user_id").join(rows, "user_id", "left")
    likes, skips = F.coalesce("likes", F.lit(0)), F.coalesce("skips", F.lit(0))
    text = F.concat_ws(
        " ",
        F.concat(F.lit("Liked "), likes.cast("string"), F.when(likes == 1, " song.").otherwise(" songs.")),
        F.when(skips > 0, F.concat(F.lit("Skipped "), skips.cast("string"), F.lit("."))),
        F.when(F.col("_top").isNotNull(), F.concat(
            F.lit("Mostly "), F.array_join(F.col("_top.genre"), ", "), F.lit("."))),
    )
    return rows.select("user_id", F.when((likes == 0) & (skips == 0), NO_HISTORY).otherwise(text).alias("summary"))
