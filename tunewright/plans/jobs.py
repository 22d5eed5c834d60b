"""End-to-end jobs over DataFrames: build, retrieve, rank, explain, train."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright import session
from tunewright.functions import fixed, scalars
from tunewright.operators import (
    candidates, coldstart, embeddings, evaluation, explain, history, profiles, ranking, text, training,
)
from tunewright.operators.boosting import Ranker
from tunewright.sources import catalog, interactions as log, tables


def build_embeddings(songs: DataFrame, path: str | None = None,
                     features: list[str] = fixed.AUDIO_FEATURES) -> dict[str, DataFrame]:
    """Song and artist vectors from audio features, written when a path is given."""
    song_vectors = embeddings.pca_embedding(songs, features)
    artist_vectors = embeddings.artist_embedding(song_vectors)
    built = {"songs": song_vectors, "artists": artist_vectors}
    if path is not None:
        tables.write_vectors(path, **built)
        built = {name: tables.read_vectors(songs.sparkSession, path, name) for name in built}
    return built


def describe_songs(songs: DataFrame) -> DataFrame:
    """``song_id, title, artist, text`` for every song with an id."""
    return catalog.drop_blank_ids(songs).select(
        "song_id", "song_ord",
        F.coalesce(scalars.strip("title"), F.lit("Unknown")).alias("title"),
        F.coalesce(scalars.primary_artist("artist_name"), F.lit("Unknown")).alias("artist"),
        scalars.song_description().alias("text"))


def build_text_index(songs: DataFrame, path: str | None = None,
                     max_terms: int = fixed.MAX_TERMS) -> dict[str, DataFrame]:
    """Text index over song descriptions, written under ``path``.

    Descriptions are made once, by as many tasks as there are cores however few files the catalog lies in, and written:
    the index reads its texts several times.
    """
    cores = songs.sparkSession.sparkContext.defaultParallelism
    if songs.rdd.getNumPartitions() < cores:
        # Before the texts are made: the catalog's own columns cost less to deal than to describe.
        songs = songs.repartition(cores, "song_id")
    return text.build_text_index(session.settle(describe_songs(songs), "descriptions"), path, "song_id", max_terms)


def rank_users(songs: DataFrame, users: DataFrame, as_of: Column, interactions: DataFrame,
               song_vectors: DataFrame, user_vectors: DataFrame | None = None,
               model: Ranker | PipelineModel | None = None, top_n: int = fixed.RANKED_ROWS,
               **artist_inputs) -> DataFrame:
    """Candidate pool, features and ranked list for every user."""
    if user_vectors is None:
        user_vectors = session.settle(embeddings.user_embedding(interactions, song_vectors), "user-vectors")
    pool = candidates.candidate_pool(songs, users, as_of, user_vectors, song_vectors, packed=True, **artist_inputs)
    features = ranking.rank_features(pool, songs, as_of, interactions, song_vectors, user_vectors, **artist_inputs)
    return ranking.rank(features, model, top_n)


def listed_hits(asking: DataFrame, hits: DataFrame) -> DataFrame:
    """``user_id, songs``: the hits of each user's intent, best first; users are dealt before they meet lists, not rows."""
    lists = hits.groupBy(F.col("query_id").alias("_asked")).agg(F.collect_list(F.struct("pos", "song_id")).alias("hits"))
    spark = asking.sparkSession
    # Few bytes until the lists are joined: without a number they would be put into one task.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = asking.select("user_id", "intent").repartition(tasks, "user_id").join(lists, F.col("intent") == F.col("_asked"))
    # A user with several intents gets the hits of all, as one list.
    merged = met.groupBy("user_id").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    return merged.select("user_id", F.col("hits.song_id").alias("songs"))


def recommend(songs: DataFrame, users: DataFrame, as_of: Column, interactions: DataFrame,
              song_vectors: DataFrame, intents: DataFrame, index: dict[str, DataFrame] | None,
              model: Ranker | PipelineModel | None = None, responses: DataFrame | None = None,
              k: int = fixed.FINAL_ROWS, artist_vectors: DataFrame | None = None,
              user_artist_vectors: DataFrame | None = None, blend_below: int = fixed.BLEND_BELOW) -> DataFrame:
    """Final lists for all users: ``user_id, rank, song_id, title, artist, score, explanation``.

    ``intents(user_id, intent)`` with text are answered by text search, all
    other users by the candidate pool, as are users whose search finds nothing.
    Equal intents are searched once. ``responses(user_id, response)`` are the
    explanation answers, if any; only users answered by search get theirs.
    ``artist_vectors`` and ``user_artist_vectors`` choose candidates by artist,
    enter the features, and are blended into the vectors of users with fewer
    than ``blend_below`` likes.
    """
    built = embeddings.user_embedding(interactions, song_vectors, user_artist_vectors, blend_below)
    user_vectors = session.settle(built, "user-vectors")
    artists = {"artist_vectors": artist_vectors, "user_artist_vectors": user_artist_vectors}
    artists = artists if artist_vectors is not None and user_artist_vectors is not None else {}
    wanted = users.select("user_id").join(intents, "user_id", "left").withColumn(
        "intent", scalars.strip(F.coalesce("intent", F.lit(""))))
    searched = None
    quiet = users
    # An index without documents finds nothing.
    if index is not None and not index["documents"].isEmpty():
        asking = wanted.where(F.col("intent") != "")
        distinct = asking.select(F.col("intent").alias("query_id"), F.col("intent").alias("text")).distinct()
        hits = text.indexed_search(distinct, index, songs)
        searched = session.settle(listed_hits(asking, hits), "searched")
        quiet = users.join(searched.select("user_id"), "user_id", "left_anti")
    found = candidates.candidate_pool(songs, quiet, as_of, user_vectors, song_vectors, packed=True, **artists)
    if searched is not None:
        found = found.unionByName(searched)
    features = ranking.rank_features(found, songs, as_of, interactions, song_vectors, user_vectors, **artists)
    top = explain.final_topk(ranking.rank(features, model, min(k, fixed.RANKED_ROWS)), k)
    listed = explain.ranked_join_meta(top, catalog.catalog_meta(songs))
    explanations = None
    if responses is not None and searched is not None:
        answered = responses.join(searched.select("user_id"), "user_id", "left_semi")
        explanations = explain.parse_explanations(answered)
    return explain.ranked_join_explanations(listed, explanations).select(
        "user_id", "rank", "song_id", "title", "artist", "score", "explanation")


def request_prompts(listed: DataFrame, interactions: DataFrame, songs: DataFrame, users: DataFrame,
                    intents: DataFrame, index: dict[str, DataFrame] | None, k: int = fixed.FINAL_ROWS) -> DataFrame:
    """Explanation requests for the users whose intent was searched; none without an index."""
    summaries = history.history_summary(interactions, catalog.catalog_genre_map(songs), users)
    asked = intents.where(explain.explanation_gate("intent", F.lit(index is not None)))
    requests = asked.join(summaries, "user_id").select("user_id", "intent", "summary")
    return explain.explanation_prompt(listed, requests, k)


def train_and_evaluate(interactions: DataFrame, songs: DataFrame, song_vectors: DataFrame,
                       artist_vectors: DataFrame, as_of: Column, k: int = fixed.FINAL_ROWS,
                       trees: int = fixed.TREES, path: str | None = None) -> dict:
    """Training rows, user split, fitted ranker and metrics on unseen users."""
    rows = training.training_set(interactions, songs, song_vectors, artist_vectors, as_of)
    split = session.settle(training.group_split(rows), "training-rows")
    model = training.train_ranker(split.where(~F.col("is_test")).drop("is_test"), trees)
    if path is not None:
        tables.save_model(model, path)
    test = ranking.score_model(split.where("is_test"), model).withColumnRenamed("log_ord", "row_ord")
    scored = session.settle(test.select("user_id", "label", "score", "row_ord"), "scored-rows")
    metrics = evaluation.user_metrics(scored, k)
    return {
        "model": model,
        "scored": scored,
        "importance": training.feature_importance(model),
        "report": evaluation.macro_average(metrics, k).withColumn("auc", evaluation.auc(scored).scalar()),
    }


def evaluate_all_users(interactions: DataFrame, songs: DataFrame, song_vectors: DataFrame,
                       users: DataFrame, as_of: Column, k: int = fixed.FINAL_ROWS) -> DataFrame:
    """Rank from each user's earlier half and judge against all likes in the later half.

    One row per user, and one with a null ``user_id`` that holds the means over
    the users with a later like and at least k ranked songs.
    """
    parts = session.settle(evaluation.temporal_split(interactions), "time-halves")
    train, later = parts.where(F.col("part") == "train"), parts.where(F.col("part") == "eval")
    active = users.join(train.select("user_id").distinct(), "user_id", "left_semi")
    ranked = session.settle(rank_users(songs, active, as_of, train, song_vectors).select(
        "user_id", "song_id", "score", "rank", "popularity"), "ranked")
    wins = session.settle(log.liked(later).select("user_id", "song_id").distinct(), "later-likes")
    # A list is bounded; the likes it is judged against are not: they are counted apart.
    judged = ranked.join(wins.withColumn("label", F.lit(1)), ["user_id", "song_id"], "left").withColumn(
        "label", F.coalesce("label", F.lit(0))).withColumn("row_ord", F.col("rank"))
    totals = wins.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_positive"))
    metrics = evaluation.user_metrics(judged.select("user_id", "label", "score", "row_ord"), k, totals)
    listed = ranked.join(songs.select("song_id", "artist_id"), "song_id")
    each = session.settle(metrics.join(evaluation.diversity_at_k(listed, k), "user_id", "left").join(
        evaluation.novelty_at_k(listed, k), "user_id", "left"), "evaluation")
    return each.unionByName(evaluation.mean_row(each, k))


def onboard_users(answers: DataFrame, songs: DataFrame, picks: DataFrame, song_vectors: DataFrame,
                  vocabulary: list[str] = fixed.GENRES, top_n: int = fixed.FINAL_ROWS,
                  at: Column | None = None, user_artist_vectors: DataFrame | None = None,
                  artist_vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """Survey answers to profiles, first lists, log rows and user vectors.

    ``picks(user_id, song_id, label)`` are the ratings of the first lists, or
    seed songs chosen by search. With artist vectors, familiar songs of accepted
    users who have a vector of their own are scored by its cosine.
    """
    checked = profiles.validate_profiles(answers)
    accepted = profiles.build_profile(checked.where("valid"), vocabulary, keep_ids=True, at=at)
    rated = picks.join(accepted.select("user_id"), "user_id", "left_semi")
    return {
        "rejected": checked.where(~F.col("valid")).select("user_id", "problems"),
        "profiles": accepted,
        "first_lists": coldstart.cold_start_recommend(
            songs, accepted, top_n, vocabulary, user_artist_vectors=user_artist_vectors, artist_vectors=artist_vectors),
        "log_rows": log.interaction_rows(rated, at),
        "user_vectors": embeddings.user_embedding(rated, song_vectors),
    }
