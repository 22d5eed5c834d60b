"""User profiles: one JSON document per user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
    user_id string, name string, created_at string,
    favorite_artists array<string>, recent_artists array<string>, favorite_genres array<string>,
    selected_moods array<string>, genre_vector array<double>,
    mood_targets struct<target_energy: double, target_valence: double>,
    purpose string, exploration_weight double, popularity_preference string,
    artist_vector array<double>
"""


def scan_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from a folder of JSON files, one object or one array of objects each, indented or not."""
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def append_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("append").json(path)


def read_profile_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def current_profile(profiles: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The most recently confirmed profile (per key when keys are given)."""
    row = F.struct(*[F.col(c) for c in profiles.columns])
    stamp = F.struct("created_at", "user_id")
    return profiles.groupBy(*keys).agg(F.max_by(row, stamp).alias("row")).select("row.*")
