"""Song, artist and user vectors, and the similarity features built on them."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.functions import fixed, scalars, vectors
from tunewright.operators import pair_dots
from tunewright.sources.interactions import liked


def standardise_stats(songs: DataFrame, features: list[str] = fixed.AUDIO_FEATURES) -> DataFrame:
    """One row: mean and population deviation per feature (0 deviation counts as 1)."""
    spread = [F.stddev_pop(f) for f in features]
    return songs.agg(
        *[F.avg(f).alias(f"{f}_mean") for f in features],
        *[F.when(s > 0, s).otherwise(1.0).alias(f"{f}_std") for f, s in zip(features, spread)],
    )


def scale_features(songs: DataFrame, features: list[str] = fixed.AUDIO_FEATURES) -> DataFrame:
    """(x - mean) / deviation per feature; the statistics are one driver-side row."""
    stats = standardise_stats(songs, features).first()
    scaled = [
        ((F.col(f) - F.lit(stats[f"{f}_mean"] or 0.0)) / F.lit(stats[f"{f}_std"] or 1.0)).alias(f"{f}_z")
        for f in features
    ]
    return songs.select("song_id", *scaled)


def fit_pca(songs: DataFrame, features: list[str] = fixed.AUDIO_FEATURES,
            components: int = fixed.MAX_COMPONENTS) -> PipelineModel:
    """Standardise and project; the component count never exceeds the feature count."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        PCA(k=min(components, len(features)), inputCol="_scaled", outputCol="_pca"),
    ]).fit(songs)


def pca_embedding(songs: DataFrame, features: list[str] = fixed.AUDIO_FEATURES,
                  components: int = fixed.MAX_COMPONENTS, model: PipelineModel | None = None) -> DataFrame:
    model = model or fit_pca(songs, features, components)
    keep = [c for c in ("song_id", "song_ord", "artist_id") if c in songs.columns]
    projected = vectors.tagged(vector_to_array("_pca"), "embedding", model.stages[-1].getK())
    return model.transform(songs).select(*keep, projected)


def explained_variance(model: PipelineModel) -> list[float]:
    """Share of the variance that each component keeps."""
    return [float(share) for share in model.stages[-1].explainedVariance.toArray()]


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str, count: str,
                 weight: str | None = None) -> DataFrame:
    dim = vectors.dimension(df, vector)
    sums = vectors.sum_vectors(df, keys, vector, dim, weight, **{count: f"sum({weight or 1})"})
    return sums.select(*keys, vectors.tagged(vectors.divide("vector_sum", F.col(count)), out, dim), count)


def artist_embedding(song_vectors: DataFrame) -> DataFrame:
    """Mean song vector per non-blank ``artist_id``."""
    named = song_vectors.where(scalars.strip(F.col("artist_id").cast("string")) != "")
    return mean_vectors(named, ["artist_id"], "embedding", "embedding", "n_songs")


def liked_counts(interactions: DataFrame) -> DataFrame:
    """(user, song) -> number of likes: one row per pair leaves every later join.

    A log that is counted already (with a column ``likes``) is taken as it is.
    """
    if "likes" in interactions.columns:
        return interactions.where(F.col("likes") > 0).select("user_id", "song_id", "likes")
    return liked(interactions).groupBy("user_id", "song_id").agg(F.count(F.lit(1)).alias("likes"))


def user_embedding(interactions: DataFrame, song_vectors: DataFrame,
                   artist_vectors: DataFrame | None = None, blend_below: int = fixed.BLEND_BELOW) -> DataFrame:
    """Mean vector of liked songs, repeats counted; users without one get no row.

    With ``artist_vectors(user_id, artist_vector)``, users with fewer than
    ``blend_below`` likes are blended 0.7 / 0.3 with a vector of the same length.
    """
    # Counts are exchanged by user, so sums of vectors need not be.
    pairs = liked_counts(interactions).repartition("user_id").join(song_vectors.select("song_id", "embedding"), "song_id")
    dim = vectors.dimension(song_vectors, "embedding")
    sums = vectors.sum_vectors(pairs, ["user_id"], "embedding", dim, "likes", n_liked="sum(likes)")
    means = sums.select(
        "user_id", vectors.tagged(vectors.divide("vector_sum", F.col("n_liked")), "embedding", dim), "n_liked")
    if artist_vectors is None:
        return means
    blend = F.zip_with(
        "embedding", "artist_vector",
        lambda b, s: F.lit(fixed.BEHAVIOUR_WEIGHT) * b + F.lit(fixed.SURVEY_WEIGHT) * s)
    few = (F.col("n_liked") < blend_below) & (F.size("artist_vector") == F.size("embedding"))
    return means.join(artist_vectors.select("user_id", "artist_vector"), "user_id", "left").select(
        "user_id", vectors.tagged(F.when(few, blend).otherwise(F.col("embedding")), "embedding", dim), "n_liked")


def user_artist_vector(interactions: DataFrame, songs: DataFrame, artist_vectors: DataFrame) -> DataFrame:
    """Mean artist vector over liked songs, one term per like.

    Likes are summed per (user, artist) before the vectors are joined.
    """
    by_artist = (
        liked_counts(interactions).join(songs.select("song_id", "artist_id"), "song_id")
        .groupBy("user_id", "artist_id").agg(F.sum("likes").alias("likes"))
    )
    named = by_artist.join(artist_vectors.select("artist_id", "embedding"), "artist_id")
    dim = vectors.dimension(artist_vectors, "embedding")
    sums = vectors.sum_vectors(named, ["user_id"], "embedding", dim, "likes", n_liked="sum(likes)")
    mean = vectors.divide("vector_sum", F.col("n_liked"))
    return sums.select("user_id", vectors.tagged(mean, "artist_vector", dim))


def liked_direction(interactions: DataFrame, song_vectors: DataFrame) -> DataFrame:
    """Per user, the sum of unit vectors of liked songs and their number.

    The mean cosine of a song to all liked songs equals the dot product of its
    unit vector with this sum, divided by the number: no pairs are formed.
    """
    directions = song_vectors.select("song_id", vectors.unit("embedding").alias("direction"))
    pairs = liked_counts(interactions).repartition("user_id").join(directions, "song_id")
    dim = vectors.dimension(song_vectors, "embedding")
    sums = vectors.sum_vectors(pairs, ["user_id"], "direction", dim, "likes", n_directions="sum(likes)")
    return sums.withColumnRenamed("vector_sum", "liked_sum")


def collaborative_score(pairs: DataFrame, interactions: DataFrame, song_vectors: DataFrame) -> DataFrame:
    """Mean cosine of each (user, song) to the user's liked songs; 0.0 without either.

    Pairs meet the vectors in blocks: no vector lies beside a pair.
    """
    directions = song_vectors.select("song_id", vectors.unit("embedding").alias("vector"))
    likes = liked_direction(interactions, song_vectors).select(
        "user_id", vectors.divide("liked_sum", F.col("n_directions")).alias("vector"))
    scored = pair_dots.pair_dots(pairs, {"liked": likes}, {"song": directions}, {"_dot": ("liked", "song")})
    kept = [c for c in pairs.columns if c not in ("user_id", "song_id")]
    return scored.select("user_id", "song_id", *kept, F.round(F.coalesce("_dot", F.lit(0.0)), vectors.SCORE_DIGITS).alias("collaborative_score"))


def mean_cosine() -> Column:
    value = vectors.dot("direction", "liked_sum") / F.col("n_directions")
    return F.round(F.coalesce(value, F.lit(0.0)), vectors.SCORE_DIGITS)


def collaborative_loo(rated: DataFrame, interactions: DataFrame, song_vectors: DataFrame) -> DataFrame:
    """As ``collaborative_score`` but with every like of the row's own song left out."""
    directions = song_vectors.select("song_id", vectors.unit("embedding").alias("direction"))
    joined = (
        rated.join(directions, "song_id", "left")
        .join(liked_direction(interactions, song_vectors), "user_id", "left")
        .join(liked_counts(interactions), ["user_id", "song_id"], "left")
    )
    return joined.withColumn("collaborative_score", others_cosine()).drop(
        "direction", "liked_sum", "n_directions", "likes")


def others_cosine() -> Column:
    """Mean cosine to the liked songs but the row's own, which was liked ``likes`` times."""
    own = F.coalesce("likes", F.lit(0))
    left_over = F.col("n_directions") - own
    itself = vectors.dot("direction", "direction")
    value = (vectors.dot("direction", "liked_sum") - own * itself) / left_over
    score = F.when(left_over > 0, F.coalesce(value, F.lit(0.0))).otherwise(0.0)
    return F.round(score, vectors.SCORE_DIGITS)


def content_similarity(pairs: DataFrame, user_vectors: DataFrame, song_vectors: DataFrame) -> DataFrame:
    """Cosine of user and song vector per pair; rows without a vector score 0.0."""
    joined = (
        pairs.join(song_vectors.select("song_id", F.col("embedding").alias("_song")), "song_id", "left")
        .join(user_vectors.select("user_id", F.col("embedding").alias("_user")), "user_id", "left")
    )
    return joined.withColumn("content_similarity", vectors.cosine("_user", "_song")).drop("_song", "_user")


def artist_similarity(pairs: DataFrame, user_artist_vectors: DataFrame, artist_vectors: DataFrame) -> DataFrame:
    """Cosine of the user's artist vector and the artist's vector; 0.0 when either is missing."""
    joined = (
        pairs.join(artist_vectors.select("artist_id", F.col("embedding").alias("_artist")), "artist_id", "left")
        .join(user_artist_vectors.select("user_id", F.col("artist_vector").alias("_user")), "user_id", "left")
    )
    return joined.withColumn("artist_similarity", vectors.cosine("_user", "_artist")).drop("_artist", "_user")


def group_cosine_mean(song_vectors: DataFrame, group: str = "artist_id") -> DataFrame:
    """Row means of the pairwise cosine matrix within each group, from one vector sum per group."""
    directions = song_vectors.select("song_id", group, vectors.unit("embedding").alias("direction"))
    dim = vectors.dimension(song_vectors, "embedding")
    sums = vectors.sum_vectors(directions, [group], "direction", dim, n_directions="count(1)")
    joined = directions.join(sums.withColumnRenamed("vector_sum", "liked_sum"), group)
    return joined.select("song_id", group, mean_cosine().alias("mean_cosine"))
