"""Queries over vectors, candidate pools, ranking features and ranked lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tunewright import session
from tunewright.functions import fixed, vectors
from tunewright.operators import candidates, embeddings, explain, ranking, similarity
from tunewright.plans import jobs
from tunewright.plans.catalog_queries import brand_vectors, users
from tunewright.plans.oracle import MANY_LIKES, check
from tunewright.plans.register import query
from tunewright.sources import bindings as b
from tunewright.sources import catalog

FEATURES = tuple(fixed.FEATURES)


def _long(df, key, vector="embedding", *extra):
    return df.select(key, *extra, F.posexplode(vector).alias("pos", "x"))


def user_vectors(spark, sf):
    """User vectors as a table, since most queries read them more than once."""
    built = embeddings.user_embedding(b.interactions(spark, sf), b.song_vectors(spark, sf))
    return session.settle(built, "user-vectors")


def taste(spark, sf):
    songs = b.song_vectors(spark, sf)
    return embeddings.user_artist_vector(b.interactions(spark, sf), songs, embeddings.artist_embedding(songs))


# ---- vectors per artist and user

@query("artist_embedding", check("SELECT artist_id, n_songs, pos, x FROM artist_vec_long", "artist_vec_long"),
       doubles=("x",), wholes=("artist_id", "pos"))
def artist_embedding(spark, sf):
    return _long(embeddings.artist_embedding(b.song_vectors(spark, sf)), "artist_id", "embedding", "n_songs")


@query("user_embedding", check("SELECT user_id, n_liked, pos, x FROM user_vec_long", "user_vec_long"),
       doubles=("x",), wholes=("pos",))
def user_embedding(spark, sf):
    built = embeddings.user_embedding(b.interactions(spark, sf), b.song_vectors(spark, sf))
    return _long(built, "user_id", "embedding", "n_liked")


@query("user_embedding_blend", check(f"""
  SELECT user_id, n_liked, m.pos, CASE WHEN n_liked < {MANY_LIKES} AND t.x IS NOT NULL
    THEN 0.7::DOUBLE * m.x + 0.3::DOUBLE * t.x ELSE m.x END AS x
  FROM user_vec_long m LEFT JOIN taste_long t USING (user_id, pos)""", "user_vec_long", "taste_long"),
    doubles=("x",), wholes=("pos",))
def user_embedding_blend(spark, sf):
    built = embeddings.user_embedding(b.interactions(spark, sf), b.song_vectors(spark, sf), taste(spark, sf), MANY_LIKES)
    return _long(built, "user_id", "embedding", "n_liked")


@query("user_artist_vector", check("SELECT user_id, pos, x FROM taste_long", "taste_long"), doubles=("x",), wholes=("pos",))
def user_artist_vector(spark, sf):
    return _long(taste(spark, sf), "user_id", "artist_vector")


# ---- cosines

@query("cosine", check("""
  SELECT song_id, round(list_cosine_similarity(v.embedding, a.embedding), 9) AS cosine
  FROM vec v JOIN artist_vec a USING (artist_id)""", "vec", "artist_vec"), doubles=("cosine",))
def cosine(spark, sf):
    songs = b.song_vectors(spark, sf)
    named = songs.join(embeddings.artist_embedding(songs).select(
        "artist_id", F.col("embedding").alias("mean")), "artist_id")
    return named.select("song_id", vectors.cosine("embedding", "mean").alias("cosine"))


_NEAREST = """
  SELECT user_id, song_id, similarity, rank FROM (SELECT user_id, song_id, similarity,
      row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, song_id) AS rank
    FROM (SELECT u.user_id, v.song_id, round(list_cosine_similarity(u.embedding, v.embedding), 9) AS similarity
      FROM user_vec u CROSS JOIN vec v)) WHERE rank <= {k}"""


def _nearest(spark, sf, k, **blocks):
    found = similarity.similar_songs_topk(user_vectors(spark, sf), b.song_vectors(spark, sf), k, **blocks)
    return found.drop("item_ord")


@query("user_x_song", check(_NEAREST.format(k=10), "user_vec", "vec"), doubles=("similarity",))
def user_x_song(spark, sf):
    return _nearest(spark, sf, 10)


@query("user_x_song_by_angle", check(_NEAREST.format(k=5), "user_vec", "vec"), doubles=("similarity",))
def user_x_song_by_angle(spark, sf):
    return _nearest(spark, sf, 5, item_rows=128, worth_pairs=0)


@query("cosine_batch", check(_NEAREST.format(k=1), "user_vec", "vec"), doubles=("similarity",))
def cosine_batch(spark, sf):
    return _nearest(spark, sf, 1, item_rows=128)


@query("similar_songs_topk", check(
    "SELECT user_id, song_id, similarity, pos AS rank FROM near_songs", "near_songs"), doubles=("similarity",))
def similar_songs_topk(spark, sf):
    fresh = candidates.fresh_songs(b.songs(spark, sf), b.as_of()).select("song_id")
    offered = b.song_vectors(spark, sf).join(fresh, "song_id", "left_semi")
    return similarity.similar_songs_topk(user_vectors(spark, sf), offered, 100).drop("item_ord")


def brands(spark, sf):
    """(artist vectors, user artist vectors) under the catalog's artist ids."""
    by_brand = embeddings.artist_embedding(brand_vectors(spark, sf))
    return by_brand, embeddings.user_artist_vector(b.interactions(spark, sf), b.songs(spark, sf), by_brand)


@query("similar_artists_topk", check("SELECT * FROM near_artists", "near_artists"), doubles=("similarity",))
def similar_artists_topk(spark, sf):
    by_brand, wanted = brands(spark, sf)
    return similarity.similar_artists_topk(wanted, by_brand, fixed.SIMILAR_ARTISTS)


@query("cosine_matrix", check("""
  SELECT a.song_id, a.artist_id, round(avg(list_cosine_similarity(a.embedding, b.embedding)), 9) AS mean_cosine
  FROM vec a JOIN vec b USING (artist_id) GROUP BY ALL""", "vec"), doubles=("mean_cosine",), wholes=("artist_id",))
def cosine_matrix(spark, sf):
    return embeddings.group_cosine_mean(b.song_vectors(spark, sf))


# ---- features over given pairs

@query("candidates_join_song_vec", check("""
  SELECT p.user_id, p.song_id, coalesce(round(list_cosine_similarity(u.embedding, v.embedding), 9), 0.0) AS content_similarity
  FROM pairs p LEFT JOIN user_vec u USING (user_id) LEFT JOIN vec v ON v.song_id = p.song_id""",
    "pairs", "user_vec", "vec"), doubles=("content_similarity",))
def candidates_join_song_vec(spark, sf):
    pairs = b.purchases(spark, sf).select("user_id", "song_id")
    return embeddings.content_similarity(pairs, user_vectors(spark, sf), b.song_vectors(spark, sf))


@query("content_similarity", check("""
  SELECT l.user_id, l.song_id, coalesce(round(list_cosine_similarity(u.embedding, v.embedding), 9), 0.0) AS content_similarity
  FROM (SELECT DISTINCT user_id, song_id FROM log) l LEFT JOIN user_vec u USING (user_id)
  LEFT JOIN vec v ON v.song_id = l.song_id""", "log", "user_vec", "vec"), doubles=("content_similarity",))
def content_similarity(spark, sf):
    pairs = b.interactions(spark, sf).select("user_id", "song_id").distinct()
    return embeddings.content_similarity(pairs, user_vectors(spark, sf), b.song_vectors(spark, sf))


@query("song_join_artist_vec", check("""
  SELECT song_id, artist_id, a.embedding IS NOT NULL AS has_vector,
    coalesce(sqrt(list_dot_product(a.embedding, a.embedding)), 0.0) AS length
  FROM songs LEFT JOIN brand_vec a USING (artist_id)""", "songs", "brand_vec"), doubles=("length",))
def song_join_artist_vec(spark, sf):
    by_brand, _ = brands(spark, sf)
    joined = b.songs(spark, sf).select("song_id", "artist_id").join(
        by_brand.select("artist_id", "embedding"), "artist_id", "left")
    return joined.select("song_id", "artist_id", F.col("embedding").isNotNull().alias("has_vector"),
                         F.coalesce(vectors.norm("embedding"), F.lit(0.0)).alias("length"))


@query("artist_similarity", check("""
  SELECT p.user_id, p.song_id, coalesce(round(list_cosine_similarity(t.artist_vector, a.embedding), 9), 0.0) AS artist_similarity
  FROM pairs p JOIN songs s USING (song_id) LEFT JOIN brand_taste t USING (user_id)
  LEFT JOIN brand_vec a ON a.artist_id = s.artist_id""", "pairs", "songs", "brand_taste", "brand_vec"),
       doubles=("artist_similarity",))
def artist_similarity(spark, sf):
    by_brand, wanted = brands(spark, sf)
    pairs = b.purchases(spark, sf).select("user_id", "song_id").join(
        b.songs(spark, sf).select("song_id", "artist_id"), "song_id")
    return embeddings.artist_similarity(pairs, wanted, by_brand).drop("artist_id")


_COLLAB = """
  SELECT p.user_id, p.song_id, coalesce(c.c, 0.0) AS collaborative_score FROM {pairs} p LEFT JOIN (
    SELECT q.user_id, q.song_id, round(avg(list_cosine_similarity(v.embedding, w.embedding)), 9) AS c
    FROM {pairs} q JOIN vec v ON v.song_id = q.song_id JOIN liked l ON l.user_id = q.user_id
    JOIN vec w ON w.song_id = l.song_id GROUP BY ALL) c ON c.user_id = p.user_id AND c.song_id = p.song_id"""


@query("collaborative_score", check(_COLLAB.format(pairs="pairs"), "pairs", "vec", "liked"),
       doubles=("collaborative_score",))
def collaborative_score(spark, sf):
    pairs = b.purchases(spark, sf).select("user_id", "song_id")
    return embeddings.collaborative_score(pairs, b.interactions(spark, sf), b.song_vectors(spark, sf))


@query("candidate_x_liked", check(_COLLAB.format(pairs="(SELECT DISTINCT user_id, song_id FROM log)"), "log", "vec", "liked"),
       doubles=("collaborative_score",))
def candidate_x_liked(spark, sf):
    pairs = b.interactions(spark, sf).select("user_id", "song_id").distinct()
    return embeddings.collaborative_score(pairs, b.interactions(spark, sf), b.song_vectors(spark, sf))


@query("collaborative_loo", check("""
  SELECT l.user_id, l.song_id, l.log_ord, l.label, coalesce(round(c.c, 9), 0.0) AS collaborative_score
  FROM log l LEFT JOIN loo c ON c.user_id = l.user_id AND c.song_id = l.song_id""", "log", "loo"),
       doubles=("collaborative_score",), wholes=("label",))
def collaborative_loo(spark, sf):
    rated = b.interactions(spark, sf).select("user_id", "song_id", "log_ord", "label")
    return embeddings.collaborative_loo(rated, b.interactions(spark, sf), b.song_vectors(spark, sf))


@query("exclude_self", check("""
  SELECT p.user_id, p.song_id, count(l.song_id) AS other_likes FROM (SELECT DISTINCT user_id, song_id FROM log) p
  LEFT JOIN liked l ON l.user_id = p.user_id AND l.song_id <> p.song_id GROUP BY ALL""", "log", "liked"))
def exclude_self(spark, sf):
    """Likes of the user for any other song: total minus own, without pairing rows."""
    interactions = b.interactions(spark, sf)
    counts = embeddings.liked_counts(interactions)
    totals = counts.groupBy("user_id").agg(F.sum("likes").alias("total"))
    rows = interactions.select("user_id", "song_id").distinct().join(totals, "user_id", "left").join(
        counts, ["user_id", "song_id"], "left")
    return rows.select("user_id", "song_id", (
        F.coalesce("total", F.lit(0)) - F.coalesce("likes", F.lit(0))).alias("other_likes"))


# ---- candidate pools

@query("window_counts", check("SELECT * FROM windows", "windows"))
def window_counts(spark, sf):
    return candidates.window_counts(b.songs(spark, sf), b.as_of())


@query("fresh_songs", check("SELECT song_id, release_date FROM fresh", "fresh"))
def fresh_songs(spark, sf):
    return candidates.fresh_songs(b.songs(spark, sf), b.as_of()).select("song_id", "release_date")


@query("similar_artist_songs", check("SELECT user_id, song_id, pos FROM near_artist_songs", "near_artist_songs"))
def similar_artist_songs(spark, sf):
    by_brand, wanted = brands(spark, sf)
    near = similarity.similar_artists_topk(wanted, by_brand, fixed.SIMILAR_ARTISTS)
    fresh = candidates.fresh_songs(b.songs(spark, sf), b.as_of())
    return candidates.similar_artist_songs(fresh, near).select("user_id", "song_id", "pos")


@query("known_artist_songs", check("SELECT user_id, song_id, pos FROM known_songs", "known_songs"))
def known_artist_songs(spark, sf):
    fresh = candidates.fresh_songs(b.songs(spark, sf), b.as_of())
    return candidates.known_artist_songs(fresh, users(spark, sf)).select("user_id", "song_id", "pos")


def pool(spark, sf):
    return candidates.candidate_pool(
        b.songs(spark, sf), users(spark, sf), b.as_of(), user_vectors(spark, sf), b.song_vectors(spark, sf))


@query("candidate_pool", check("SELECT user_id, song_id, cand_pos FROM pool", "pool"))
def candidate_pool(spark, sf):
    return pool(spark, sf)


@query("ordered_union", """
  SELECT user_id, song_id, cand_pos FROM (SELECT user_id, song_id,
      row_number() OVER (PARTITION BY user_id ORDER BY src, pos) AS cand_pos FROM (
    SELECT user_id, song_id, min(src) AS src, arg_min(pos, src) AS pos FROM (
      SELECT user_id, song_id, src, line * 1000000 + song_id AS pos FROM (
        SELECT o_custkey AS user_id, l_partkey AS song_id, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS src,
          min(l_orderkey * 8 + l_linenumber) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL))
    GROUP BY user_id, song_id)) WHERE cand_pos <= 200""")
def ordered_union(spark, sf):
    lines = b.table(spark, sf, "lineitem").join(b.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("song_id"),
                         (F.col("l_returnflag") == "R").alias("returned")).agg(
        F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("first_line"))
    rows = rows.withColumn("pos", F.col("first_line") * 1_000_000 + F.col("song_id"))
    return candidates.ordered_union(rows.where("returned"), rows.where("NOT returned"))


@query("unrated_only", check("""
  SELECT p.user_id, p.song_id, p.cand_pos FROM pool p ANTI JOIN log l ON l.user_id = p.user_id AND l.song_id = p.song_id""",
    "pool", "log"))
def unrated_only(spark, sf):
    return candidates.unrated_only(pool(spark, sf), b.interactions(spark, sf))


def _listed_candidates(spark, sf):
    """Logged songs as candidates in log order; ids from 2 * 1,000 on are outside a small catalog."""
    order = Window.partitionBy("user_id").orderBy("first_ord")
    seen = b.interactions(spark, sf).groupBy("user_id", (F.col("song_id") * 40).alias("song_id")).agg(
        F.min("log_ord").alias("first_ord"))
    return seen.select("user_id", "song_id", F.row_number().over(order).alias("cand_pos"))


_LISTED = """(SELECT user_id, song_id * 40 AS song_id, row_number() OVER (PARTITION BY user_id ORDER BY min(log_ord)) AS cand_pos
  FROM log GROUP BY user_id, song_id)"""


@query("candidates_join_catalog", check(f"""
  SELECT user_id, song_id, cand_pos, title FROM {_LISTED} JOIN songs USING (song_id)""", "log", "songs"))
def candidates_join_catalog(spark, sf):
    return ranking.candidates_join_catalog(_listed_candidates(spark, sf), b.songs(spark, sf)).select(
        "user_id", "song_id", "cand_pos", "title")


@query("diversity_penalty", check(f"""
  SELECT user_id, song_id, cand_pos, row_number() OVER (PARTITION BY user_id, artist_id ORDER BY cand_pos) - 1 AS diversity_penalty
  FROM {_LISTED} JOIN songs USING (song_id)""", "log", "songs"), doubles=("diversity_penalty",))
def diversity_penalty(spark, sf):
    rows = ranking.candidates_join_catalog(_listed_candidates(spark, sf), b.songs(spark, sf).select(
        "song_id", "song_ord", "artist_id"))
    return ranking.diversity_penalty(rows).select("user_id", "song_id", "cand_pos", "diversity_penalty")


# ---- features, scores, ranked lists

def pool_features(spark, sf):
    """Features of every user's pool, packed as lists."""
    songs, mine = b.songs(spark, sf), user_vectors(spark, sf)
    found = candidates.candidate_pool(songs, users(spark, sf), b.as_of(), mine, b.song_vectors(spark, sf), packed=True)
    return ranking.rank_features(found, songs, b.as_of(), b.interactions(spark, sf), b.song_vectors(spark, sf), mine)


_FEATURE_SQL = "SELECT user_id, song_id, cand_pos, " + ", ".join(FEATURES)


@query("rank_features", check(f"{_FEATURE_SQL} FROM pool_features", "pool_features"), doubles=FEATURES)
def rank_features(spark, sf):
    return ranking.feature_rows(pool_features(spark, sf))


@query("feature_matrix", check("SELECT user_id, song_id, unnest(range(0, 6)) AS pos, unnest([" + ", ".join(FEATURES)
                              + "]) AS x FROM pool_features", "pool_features"), doubles=("x",), wholes=("pos",))
def feature_matrix(spark, sf):
    from pyspark.ml.functions import vector_to_array
    return ranking.feature_matrix(pool_features(spark, sf)).select(
        "user_id", "song_id", F.posexplode(vector_to_array("features")).alias("pos", "x"))


@query("fallback_score", check("SELECT user_id, song_id, rank, score FROM pool_ranked", "pool_ranked"), doubles=("score",))
def fallback_score(spark, sf):
    return ranking.fallback_ranked(pool_features(spark, sf)).select("user_id", "song_id", "rank", "score")


@query("rank", check("SELECT user_id, song_id, cand_pos, score, rank, " + ", ".join(FEATURES) + " FROM pool_ranked", "pool_ranked"),
       doubles=("score", *FEATURES))
def rank(spark, sf):
    return jobs.rank_users(b.songs(spark, sf), users(spark, sf), b.as_of(), b.interactions(spark, sf),
                           b.song_vectors(spark, sf))


@query("rank_with_artist_vectors", check(
    "SELECT user_id, song_id, cand_pos, score, rank, " + ", ".join(FEATURES) + " FROM artist_pool_ranked", "artist_pool_ranked"),
    doubles=("score", *FEATURES))
def rank_with_artist_vectors(spark, sf):
    by_brand, wanted = brands(spark, sf)
    return jobs.rank_users(b.songs(spark, sf), users(spark, sf), b.as_of(), b.interactions(spark, sf),
                           b.song_vectors(spark, sf), artist_vectors=by_brand, user_artist_vectors=wanted)


@query("rank_with_fallback", check("SELECT user_id, count(*) AS n_ranked, max(score) AS best FROM pool_ranked GROUP BY user_id",
                                   "pool_ranked"), doubles=("best",))
def rank_with_fallback(spark, sf):
    return ranking.rank(pool_features(spark, sf)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_ranked"), F.max("score").alias("best"))


@query("rank_topn", """
  SELECT user_id, song_id, cand_pos, score, rank FROM (SELECT o_custkey AS user_id, o_orderkey AS song_id, o_orderkey AS cand_pos,
      round(o_totalprice, -4) AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -4) DESC, o_orderkey) AS rank
    FROM orders) WHERE rank <= 50""", doubles=("score",))
def rank_topn(spark, sf):
    rows = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("song_id"),
        F.col("o_orderkey").alias("cand_pos"), F.round("o_totalprice", -4).alias("score"))
    return ranking.rank_topn(rows)


@query("final_topk", check("SELECT user_id, song_id, rank, score FROM pool_ranked WHERE rank <= 10", "pool_ranked"),
       doubles=("score",))
def final_topk(spark, sf):
    return explain.final_topk(rank(spark, sf)).select("user_id", "song_id", "rank", "score")


@query("rank_number", check("SELECT user_id, song_id, rank FROM pool_ranked WHERE rank <= 10", "pool_ranked"))
def rank_number(spark, sf):
    return explain.final_topk(ranking.rank(pool_features(spark, sf), top_n=10)).select("user_id", "song_id", "rank")


@query("ranked_join_meta", check(f"""
  SELECT l.user_id, l.song_id, cand_pos AS rank, coalesce(title, 'Unknown') AS title, coalesce(first_artist, 'Unknown') AS artist
  FROM {_LISTED} l LEFT JOIN songs USING (song_id)""", "log", "songs"))
def ranked_join_meta(spark, sf):
    listed = _listed_candidates(spark, sf).withColumnRenamed("cand_pos", "rank")
    return explain.ranked_join_meta(listed, catalog.catalog_meta(b.songs(spark, sf))).select(
        "user_id", "song_id", "rank", "title", "artist")


@query("scale_features", check("SELECT song_id, " + ", ".join(
    f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}_z" for f in fixed.AUDIO_FEATURES) + " FROM songs", "songs"),
       doubles=tuple(f"{f}_z" for f in fixed.AUDIO_FEATURES))
def scale_features(spark, sf):
    return embeddings.scale_features(b.songs(spark, sf))


@query("standardise_stats", check("SELECT " + ", ".join(
    f"avg({f}) AS {f}_mean, stddev_pop({f}) AS {f}_std" for f in fixed.AUDIO_FEATURES) + " FROM songs", "songs"),
       doubles=tuple(f"{f}_{s}" for f in fixed.AUDIO_FEATURES for s in ("mean", "std")))
def standardise_stats(spark, sf):
    return embeddings.standardise_stats(b.songs(spark, sf))


@query("pca_embedding", check("SELECT song_id, " + " + ".join(
    f"pow(({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER (), 2)" for f in fixed.AUDIO_FEATURES) + " AS squared_length FROM songs", "songs"),
    doubles=("squared_length",))
def pca_embedding(spark, sf):
    """Squared lengths: with all components the projection only turns the scaled features."""
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)
    return embeddings.pca_embedding(b.songs(spark, sf)).select("song_id", square.alias("squared_length"))


@query("pca_cosine", check("""
  SELECT a.song_id, count(*) AS n_songs, round(avg(list_cosine_similarity(a.z, c.z)), 9) AS mean_cosine
  FROM scaled a JOIN scaled c USING (artist_id) GROUP BY a.song_id""", "scaled"), doubles=("mean_cosine",))
def pca_cosine(spark, sf):
    """Row means of cosines in the projected space, equal to those of the scaled features."""
    projected = embeddings.pca_embedding(b.songs(spark, sf))
    means = embeddings.group_cosine_mean(projected)
    sizes = projected.groupBy("artist_id").agg(F.count(F.lit(1)).alias("n_songs"))
    return means.join(sizes, "artist_id").select("song_id", "n_songs", "mean_cosine")


@query("explained_variance", check("""
  SELECT least(len(any_value(z)), count(*)) AS components, 1.0 AS share, TRUE AS falling FROM scaled""", "scaled"),
    doubles=("share",))
def explained_variance(spark, sf):
    """Number of components, the sum of their shares, and whether no share is larger than the one before."""
    shares = embeddings.explained_variance(embeddings.fit_pca(b.songs(spark, sf)))
    table = spark.createDataFrame(list(enumerate(shares)), "component long, share double")
    # At most as many rows as features.
    before = F.lag("share").over(Window.orderBy("component"))
    falling = table.withColumn("ok", F.coalesce(before + F.lit(1e-9) >= F.col("share"), F.lit(True)))
    return falling.agg(F.count(F.lit(1)).alias("components"), F.sum("share").alias("share"), F.bool_and("ok").alias("falling"))


@query("build_embeddings", check("""
  SELECT artist_id, count(*) AS n_songs, round(avg(mean_cosine), 8) AS mean_cosine FROM (
    SELECT a.artist_id, a.song_id, round(avg(list_cosine_similarity(a.z, c.z)), 9) AS mean_cosine
    FROM scaled a JOIN scaled c USING (artist_id) GROUP BY a.artist_id, a.song_id) GROUP BY artist_id""", "scaled"),
    doubles=("mean_cosine",))
def build_embeddings(spark, sf):
    """Per artist of the written tables: songs, and the mean cosine between any two of them."""
    built = jobs.build_embeddings(b.songs(spark, sf), session.shared_path(spark, "vectors"))
    means = embeddings.group_cosine_mean(built["songs"]).groupBy("artist_id").agg(F.avg("mean_cosine").alias("mean_cosine"))
    return built["artists"].join(means, "artist_id").select("artist_id", "n_songs", "mean_cosine")
