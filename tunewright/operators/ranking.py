"""Ranking features, scores and top-n lists per user."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunewright.functions import fixed, scalars, vectors
from tunewright.operators import boosting, embeddings, pair_dots
from tunewright.sources.catalog import catalog_latest

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Held here as well, since executors need no copy of this package.
FALLBACK = fixed.FALLBACK_WEIGHTS


def candidates_join_catalog(candidates: DataFrame, songs: DataFrame) -> DataFrame:
    """Candidates with their catalog row; unknown ids drop out, ``cand_pos`` is kept."""
    return candidates.join(catalog_latest(songs), "song_id")


def diversity_penalty(candidates: DataFrame) -> DataFrame:
    """Number of earlier candidates of the same user by the same artist."""
    earlier = Window.partitionBy("user_id", F.coalesce("artist_id", F.lit(""))).orderBy("cand_pos")
    return candidates.withColumn("diversity_penalty", (F.row_number().over(earlier) - 1).cast("double"))


def rank_features(candidates: DataFrame, songs: DataFrame, as_of: Column,
                  interactions: DataFrame | None = None, song_vectors: DataFrame | None = None,
                  user_vectors: DataFrame | None = None, artist_vectors: DataFrame | None = None,
                  user_artist_vectors: DataFrame | None = None) -> DataFrame:
    """The six ranking features per (user, candidate).

    Absent inputs leave their feature at 0.0; a song without a vector keeps its
    row. Candidates meet the catalog and their vectors in blocks: no vector lies
    beside a candidate. They are exchanged once for the blocks and once by user,
    which also serves a ranking per user.

    Candidates packed as one list ``songs`` per user are exchanged once, as lists,
    and give lists: ``user_id`` and an array per column, see ``feature_rows``.
    """
    catalog = songs.select("song_id", "song_ord", F.col("artist_id").cast("string").alias("artist_id"),
                           "released", "popularity_norm")
    described = ["artist_id", scalars.freshness("released", as_of).alias("freshness"), F.col("popularity_norm").alias("popularity")]
    by_user, by_song, wanted = {}, {}, {}
    if song_vectors is not None:
        by_song["song"] = song_vectors.select("song_id", vectors.unit("embedding").alias("vector"))
        if user_vectors is not None:
            by_user["user"] = user_vectors.select("user_id", vectors.unit("embedding").alias("vector"))
            wanted["_content"] = ("user", "song")
        if interactions is not None:
            # The mean cosine to the liked songs is one dot product with the mean of their directions.
            by_user["liked"] = embeddings.liked_direction(interactions, song_vectors).select(
                "user_id", vectors.divide("liked_sum", F.col("n_directions")).alias("vector"))
            wanted["_collaborative"] = ("liked", "song")
    if artist_vectors is not None and user_artist_vectors is not None:
        named = artist_vectors.select(F.col("artist_id").cast("string").alias("artist_id"), vectors.unit("embedding").alias("vector"))
        by_song["artist"] = catalog_latest(catalog).join(named, "artist_id").select("song_id", "vector")
        by_user["taste"] = user_artist_vectors.select("user_id", vectors.unit("artist_vector").alias("vector"))
        wanted["_artist"] = ("taste", "artist")
    if "songs" in candidates.columns:
        beside = catalog_latest(catalog).select("song_id", *described)
        lists = pair_dots.list_dots(candidates, by_user, by_song, wanted, beside, ("artist_id", "diversity_penalty"), vectors.SCORE_DIGITS)

        def listed(feature: str, name: str) -> Column:
            return (F.col(name) if name in wanted else F.array_repeat(F.lit(0.0), F.size("song_id"))).alias(feature)

        return lists.select("user_id", "song_id", "cand_pos", listed("content_similarity", "_content"), listed("artist_similarity", "_artist"),
                            "freshness", "popularity", listed("collaborative_score", "_collaborative"), "diversity_penalty")
    if wanted:
        rows = pair_dots.pair_dots(candidates, by_user, by_song, wanted, beside=catalog_latest(catalog).select("song_id", *described))
    else:
        rows = candidates_join_catalog(candidates, catalog).select(*candidates.columns, *described)

    def similarity(name: str) -> Column:
        return F.round(F.coalesce(name, F.lit(0.0)), vectors.SCORE_DIGITS) if name in wanted else F.lit(0.0)

    scored = rows.select(
        "user_id", "song_id", "cand_pos", "artist_id",
        similarity("_content").alias("content_similarity"), similarity("_artist").alias("artist_similarity"),
        "freshness", "popularity", similarity("_collaborative").alias("collaborative_score"),
    )
    return diversity_penalty(scored.repartition("user_id")).select("user_id", "song_id", "cand_pos", *fixed.FEATURES)


def packed(df: DataFrame) -> bool:
    """Whether each user's rows lie in arrays of one row."""
    return isinstance(df.schema["cand_pos"].dataType, T.ArrayType)


def feature_rows(features: DataFrame) -> DataFrame:
    """One row per (user, candidate) of packed features; others are taken as they are."""
    if not packed(features):
        return features
    return features.select("user_id", F.inline(F.arrays_zip(*[c for c in features.columns if c != "user_id"])))


def feature_matrix(features: DataFrame) -> DataFrame:
    """The six features as one vector column, in their fixed order."""
    features = feature_rows(features)
    return VectorAssembler(inputCols=fixed.FEATURES, outputCol="features").transform(features)


def score_model(features: DataFrame, model: boosting.Ranker | PipelineModel) -> DataFrame:
    """Probability of a like, by the ranker or by a fitted Spark pipeline."""
    if isinstance(model, boosting.Ranker):
        return features.withColumn("score", model.probability())
    out = model.transform(features)
    return out.select(*features.columns, vector_to_array("probability")[1].alias("score"))


def rank_topn(scored: DataFrame, top_n: int = fixed.RANKED_ROWS) -> DataFrame:
    """Best ``top_n`` rows per user by score; ties keep candidate order."""
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "cand_pos")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n)


def fallback_ranked(features: DataFrame, top_n: int = fixed.RANKED_ROWS) -> DataFrame:
    """Score by fixed weights and the best ``top_n`` rows per user; lists are scored and cut where they lie."""
    if not packed(features):
        return rank_topn(features.withColumn("score", scalars.fallback_score()), top_n)

    def score(flat: dict[str, pa.Array]) -> np.ndarray:
        # The terms of scalars.fallback_score in their order, so that sums are the same to the bit.
        return sum(weight * flat[name].fill_null(0.0).to_numpy(zero_copy_only=False) for name, weight in FALLBACK.items())

    return ranked_lists(features, score, top_n)


def ranked_lists(features: DataFrame, score_of: Callable[[dict[str, pa.Array]], np.ndarray], top_n: int) -> DataFrame:
    """The best ``top_n`` rows of each list by the score of its columns, as ``rank_topn``."""
    names = [c for c in features.columns if c != "user_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("song_id").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            flat = {name: batch.column(name).flatten() for name in names}
            score = score_of(flat)
            # As Spark orders falling scores, NaN counts as the largest value.
            odd = np.isnan(score)
            order = np.lexsort((flat["cand_pos"].to_numpy(zero_copy_only=False), np.where(odd, 0.0, -score), ~odd, owner))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
            kept = rank <= top_n
            chosen = pa.array(order[kept])
            yield pa.RecordBatch.from_arrays(
                [batch.column("user_id").take(pa.array(owner[kept])), *[flat[name].take(chosen) for name in names],
                 pa.array(score).take(chosen), pa.array(rank[kept], pa.int32())], names=["user_id", *names, "score", "rank"])

    fields = [T.StructField(name, features.schema[name].dataType.elementType) for name in names]
    return features.mapInArrow(cut, T.StructType([
        features.schema["user_id"], *fields, T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))


def model_ranked(features: DataFrame, model: boosting.Ranker, top_n: int = fixed.RANKED_ROWS) -> DataFrame:
    """Score lists by the ranker and cut them where they lie: no list is spread to rows, and none is exchanged."""
    scorer, needed = model.scorer(), model.features

    def score(flat: dict[str, pa.Array]) -> np.ndarray:
        # What is null is not known, as NaN.
        columns = [flat[name].cast(pa.float64()).to_numpy(zero_copy_only=False) for name in needed]
        return scorer.probability(np.array(columns))

    return ranked_lists(features, score, top_n)


def rank(features: DataFrame, model: boosting.Ranker | PipelineModel | None = None,
         top_n: int = fixed.RANKED_ROWS) -> DataFrame:
    """Score by the model when there is one, else by fixed weights, and keep the best."""
    if model is None:
        return fallback_ranked(features, top_n)
    if isinstance(model, boosting.Ranker) and packed(features):
        return model_ranked(features, model, top_n)
    return rank_topn(score_model(feature_rows(features), model), top_n)
