"""The driver's tables seen as catalog, users, interactions, vectors and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.functions import vectors
from tunewright.sources import catalog

AS_OF = "2001-12-31"
# The words item names are made of, and the item types, sorted.
ARTIST_WORDS = [
    "anvil", "blue", "bolt", "cold", "gear", "gizmo", "hot", "large", "new", "old", "plate", "red",
    "ring", "rod", "small", "widget",
]
ITEM_GENRES = ["economy", "large", "medium", "promo", "small", "standard"]
SEGMENT_MOODS = {
    "AUTOMOBILE": "Energetic", "BUILDING": "Calm", "FURNITURE": "Melancholic",
    "HOUSEHOLD": "Upbeat", "MACHINERY": "Intense",
}


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` under the catalog's column names."""
    key = F.col("p_partkey")
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(key * 37, F.lit(2500)).cast("int"))
    numbers = {
        "energy": F.col("p_size") / F.lit(50.0),
        "tempo_bpm": F.lit(60.0) + F.lit(2.0) * F.col("p_size"),
        "valence": (F.col("p_retailprice") - F.lit(900.0)) / F.lit(100.0),
        "danceability": F.pmod(key, F.lit(7)) / F.lit(7.0),
        "acousticness": F.pmod(key, F.lit(11)) / F.lit(11.0),
        "instrumentalness": F.pmod(key, F.lit(10)) / F.lit(10.0),
        "speechiness": F.pmod(key, F.lit(20)) / F.lit(100.0),
        "liveness": F.pmod(key, F.lit(13)) / F.lit(13.0),
        "loudness": -(F.pmod(key, F.lit(17)).cast("double")),
        "popularity": F.pmod(key, F.lit(101)).cast("double"),
        "popularity_norm": F.pmod(key, F.lit(101)) / F.lit(100.0),
    }
    return table(spark, sf_dir, "part").select(
        key.alias("song_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist_id"),
        F.replace("p_name", F.lit(" "), F.lit(";")).alias("artist_name"),
        F.lower("p_type").alias("genre"),
        F.lit("").alias("mood"),
        F.date_format(day, "yyyy-MM-dd").alias("release_date"),
        *[c.cast("double").alias(n) for n, c in numbers.items()],
        key.alias("song_ord"),
    )


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.type_catalog(raw_catalog(spark, sf_dir))


def text_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog with every column as text, as a CSV file would hold it."""
    raw = raw_catalog(spark, sf_dir)
    return raw.select(*[F.col(c).cast("string").alias(c) for c in catalog.TEXT_COLUMNS], "song_ord")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as survey answers."""
    key = F.col("c_custkey")
    words = F.array(*[F.lit(w) for w in ARTIST_WORDS])
    genres = F.array(*[F.lit(g) for g in ITEM_GENRES])
    moods = F.create_map(*[F.lit(x) for kv in SEGMENT_MOODS.items() for x in kv])

    def word(shift: int):
        return F.get(words, F.pmod(key + shift, F.lit(16)).cast("int"))

    def genre(shift: int):
        return F.get(genres, F.pmod(key + shift, F.lit(6)).cast("int"))

    level = F.pmod(F.col("c_nationkey"), F.lit(3))
    return table(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        F.col("c_name").alias("name"),
        F.array(word(0), word(5), word(9)).alias("favorite_artists"),
        F.array(word(2), word(5)).alias("recent_artists"),
        F.array(genre(0), genre(2)).alias("favorite_genres"),
        F.array(moods[F.col("c_mktsegment")]).alias("moods"),
        F.when(level == 0, "familiar").when(level == 1, "mixed").otherwise("discover").alias("exploration"),
        F.lit(None).cast("string").alias("purpose"),
        F.lit(None).cast("string").alias("popularity"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as likes (purchase, click) and skips (all else), numbered by ``event_id``."""
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("song_id"),
        F.when(F.col("event_type").isin("purchase", "click"), 1).otherwise(0).alias("label"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("log_ord"),
    )


def song_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("song_id"),
        F.col("vec_id").alias("song_ord"),
        F.col("label").alias("artist_id"),
        vectors.doubles("embedding").alias("embedding"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, song) pairs with how often the customer bought the part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("song_id"))
        .agg(F.count(F.lit(1)).alias("bought"))
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("song_id"), F.col("doc_id").alias("song_ord"), "text")


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
