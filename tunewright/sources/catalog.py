"""Song catalog: CSV scan, typed layer, latest row per id, projections, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunewright import session
from tunewright.functions import scalars

TEXT_COLUMNS = [
    "song_id", "title", "artist_id", "artist_name", "genre", "mood", "release_date", "energy",
    "tempo_bpm", "valence", "danceability", "acousticness", "instrumentalness", "speechiness",
    "liveness", "loudness", "popularity", "popularity_norm",
]
NUMBER_COLUMNS = TEXT_COLUMNS[7:]
LEGACY_COLUMNS = [
    "id", "title", "artist", "genre", "mood", "energy", "tempo_bpm", "valence", "danceability",
    "acousticness",
]


def scan_catalog(spark: SparkSession, path: str, columns: list[str] = TEXT_COLUMNS,
                 quoted_line_breaks: bool = False) -> DataFrame:
    """Header CSV as text columns plus ``song_ord``, the row's place in file order.

    Large files are split. Files with line breaks inside quotes cannot be:
    ``quoted_line_breaks`` reads each of them in one task. The text is read once
    and written; the order of the file splits comes from two written columns.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = (
        spark.read.schema(schema)
        .csv(path, header=True, quote='"', escape='"', multiLine=quoted_line_breaks,
             encoding="UTF-8", enforceSchema=True, nullValue="\u0000", emptyValue="")
    )
    rows = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )
    rows = session.settle(rows, "catalog-rows")
    # One row per file split; ordering them needs no more than a short list.
    splits = rows.select("_file", "_start").distinct().withColumn(
        "_split", F.row_number().over(Window.orderBy("_file", "_start"))
    )
    return (
        rows.join(splits, ["_file", "_start"])
        .withColumn("song_ord", F.shiftleft(F.col("_split").cast("long"), 33) + F.col("_row"))
        .select(*columns, "song_ord")
    )


def type_catalog(raw: DataFrame) -> DataFrame:
    """Typed catalog: numbers parsed or 0.0, artist list, release midnight, mood levels.

    Columns that already hold numbers are only cast.
    """
    types = {f.name: f.dataType for f in raw.schema}
    absent = [c for c in TEXT_COLUMNS if c not in types]
    full = raw.select("*", *[F.lit(None).cast("string").alias(c) for c in absent])

    def number(c: str):
        if isinstance(types.get(c), T.NumericType):
            return F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        return scalars.safe_float(c)

    def level(c: str):
        if isinstance(types.get(c), T.NumericType):
            return F.coalesce(F.col(c).cast("double"), F.lit(0.5))
        return scalars.mood_level(c)

    return full.select(
        *[F.col(c).cast("string").alias(c) if c != "song_id" else F.col(c) for c in TEXT_COLUMNS[:7]],
        *[number(c).alias(c) for c in NUMBER_COLUMNS],
        level("energy").alias("mood_energy"),
        level("valence").alias("mood_valence"),
        scalars.split_artists("artist_name").alias("artists"),
        scalars.parse_release("release_date").alias("released"),
        "song_ord",
    )


def legacy_to_catalog(legacy: DataFrame) -> DataFrame:
    """The ten-column catalog under the current column names, still text."""
    return legacy.withColumnRenamed("id", "song_id").withColumnRenamed("artist", "artist_name")


def catalog_latest(songs: DataFrame) -> DataFrame:
    """One row per ``song_id``: the last in file order."""
    row = F.struct(*[F.col(c) for c in songs.columns])
    latest = songs.groupBy("song_id").agg(F.max_by(row, F.col("song_ord")).alias("row"))
    return latest.select("row.*")


def drop_blank_ids(df: DataFrame, key: str = "song_id") -> DataFrame:
    return df.where(scalars.strip(F.col(key).cast("string")) != "")


def catalog_meta(songs: DataFrame) -> DataFrame:
    """``song_id, title, artist`` with trimmed text and the first artist only."""
    return catalog_latest(drop_blank_ids(songs).select(
        "song_id",
        F.coalesce(scalars.strip("title"), F.lit("Unknown")).alias("title"),
        F.coalesce(scalars.primary_artist("artist_name"), F.lit("Unknown")).alias("artist"),
        "song_ord",
    )).drop("song_ord")


def catalog_genre_map(songs: DataFrame) -> DataFrame:
    """``song_id, genre``; an absent genre becomes ``unknown``, a blank one stays blank."""
    return catalog_latest(drop_blank_ids(songs).select(
        "song_id", scalars.strip(F.coalesce("genre", F.lit("unknown"))).alias("genre"), "song_ord",
    )).drop("song_ord")


def standard_id(c) -> F.Column:
    """Ids compared without case or surrounding blanks."""
    return F.lower(scalars.strip(scalars.col(c).cast("string")))


def merge_sources(songs: DataFrame, interactions: DataFrame) -> DataFrame:
    """Interactions joined to audio features on standardised ids, songs de-duplicated first."""
    kept = catalog_latest(songs.withColumn("song_id", standard_id("song_id")))
    logged = interactions.withColumn("song_id", standard_id("song_id"))
    return logged.join(kept, "song_id")
