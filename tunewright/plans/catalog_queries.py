"""Queries over scans, sinks and row-wise expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunewright import session
from tunewright.functions import scalars
from tunewright.operators import artists, candidates, coldstart, embeddings, profiles, text
from tunewright.plans import jobs
from tunewright.plans.oracle import AS_OF, GENRES, WORDS, check
from tunewright.plans.register import query
from tunewright.sources import bindings as b
from tunewright.sources import catalog, interactions as log, profiles as stored, tables

TITLE_SQL = "SELECT song_id, title, artist_id, artist_name, genre, release_date"


def users(spark, sf):
    """Customers as finished profiles, with their own ids."""
    return profiles.build_profile(b.answers(spark, sf), b.ITEM_GENRES, keep_ids=True)


# ---- scans, sources, sinks

@query("scan_catalog", check(
    "SELECT CAST(song_id AS VARCHAR) AS song_id, title, artist_id, artist_name, genre, release_date, energy, "
    "tempo_bpm, popularity_norm, row_number() OVER (ORDER BY song_ord) AS place FROM songs", "songs"),
    doubles=("energy", "tempo_bpm", "popularity_norm"))
def scan_catalog(spark, sf):
    path = session.shared_path(spark, "catalog-csv")
    rows = b.text_catalog(spark, sf).repartitionByRange("song_ord").sortWithinPartitions("song_ord")
    rows.drop("song_ord").write.csv(path, header=True, quote='"', escape='"', emptyValue="")
    read = catalog.type_catalog(catalog.scan_catalog(spark, path))
    # Place in file order, counted per file split and never in one task.
    from tunewright.functions import ordering
    placed = ordering.rank_in_buckets(read.withColumn("_all", F.lit(0)), ["_all"],
                                      F.shiftright("song_ord", 33), [F.col("song_ord")], "place")
    return placed.select("song_id", "title", "artist_id", "artist_name", "genre", "release_date", "energy",
                         "tempo_bpm", "popularity_norm", "place")


@query("catalog_latest", """
  SELECT o_custkey AS song_id, max(o_orderkey) AS song_ord, arg_max(o_orderstatus, o_orderkey) AS title,
    arg_max(o_totalprice, o_orderkey) AS popularity FROM orders GROUP BY o_custkey""", doubles=("popularity",))
def catalog_latest(spark, sf):
    rows = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("song_id"), F.col("o_orderkey").alias("song_ord"),
        F.col("o_orderstatus").alias("title"), F.col("o_totalprice").alias("popularity"))
    return catalog.catalog_latest(rows)


@query("catalog_meta", check("SELECT song_id, title, first_artist AS artist FROM songs", "songs"))
def catalog_meta(spark, sf):
    return catalog.catalog_meta(b.songs(spark, sf))


@query("catalog_genre_map", check("SELECT song_id, genre FROM songs", "songs"))
def catalog_genre_map(spark, sf):
    return catalog.catalog_genre_map(b.songs(spark, sf))


_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query("scan_interactions", check(f"""
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(song_id AS VARCHAR) AS song_id, label, label AS play_count,
    {_STAMP} AS at FROM log""", "log"), wholes=("label", "play_count"))
def scan_interactions(spark, sf):
    path = session.shared_path(spark, "log-csv")
    rows = b.interactions(spark, sf)
    log.interaction_rows(rows, F.col("ts")).write.csv(path, header=True)
    read = log.scan_interactions(spark, path)
    return read.select("user_id", "song_id", "label", "play_count", F.date_format("ts", log.STAMP).alias("at"))


@query("scan_profiles", check("""
  SELECT CAST(user_id AS VARCHAR) AS user_id, name, array_to_string(favorite_artists, ',') AS favourites,
    array_to_string(favorite_genres, ',') AS genres, te, tv, exploration_weight, 'relax' AS purpose FROM users""", "users"),
    doubles=("te", "tv", "exploration_weight"))
def scan_profiles(spark, sf):
    path = session.shared_path(spark, "profiles-json")
    rows = users(spark, sf).withColumn("user_id", F.col("user_id").cast("string"))
    # One indented array per file, 64 profiles or so in each.
    files = rows.groupBy(F.floor(F.xxhash64("user_id") / F.lit(2.0 ** 57)).alias("file")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns)), {"pretty": "true"}).alias("value"))
    files.write.partitionBy("file").text(path)
    return stored.scan_profiles(spark, path).select(
        "user_id", "name", F.array_join("favorite_artists", ",").alias("favourites"),
        F.array_join("favorite_genres", ",").alias("genres"), F.col("mood_targets.target_energy").alias("te"),
        F.col("mood_targets.target_valence").alias("tv"), "exploration_weight", "purpose")


@query("current_profile", """
  SELECT o_custkey AS name, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS user_id,
    arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS purpose FROM orders GROUP BY o_custkey""")
def current_profile(spark, sf):
    rows = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("user_id"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("purpose"))
    return stored.current_profile(rows, ("name",)).drop("created_at")


@query("append_interactions", check("""
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(song_id AS VARCHAR) AS song_id, label, label AS play_count,
    CASE WHEN label = 1 THEN '2024-02-01 10:00:00' ELSE '2024-02-01 11:00:00' END AS at FROM log""", "log"),
    wholes=("label", "play_count"))
def append_interactions(spark, sf):
    path = session.shared_path(spark, "log-csv")
    rows = b.interactions(spark, sf)
    log.append_interactions(rows.where("label = 1"), path, F.lit("2024-02-01 10:00:00"))
    log.append_interactions(rows.where("label = 0"), path, F.lit("2024-02-01 11:00:00"))
    return log.scan_interactions(spark, path).select(
        "user_id", "song_id", "label", "play_count", F.date_format("ts", log.STAMP).alias("at"))


@query("write_embeddings", check("""
  SELECT 'song' AS kind, song_id AS id, pos, x FROM vec_long
  UNION ALL SELECT 'artist', artist_id, pos, x FROM artist_vec_long
  UNION ALL SELECT 'user', user_id, pos, x FROM user_vec_long""", "vec_long", "artist_vec_long", "user_vec_long"),
    doubles=("x",), wholes=("id", "pos"))
def write_embeddings(spark, sf):
    path = session.shared_path(spark, "vectors")
    songs = b.song_vectors(spark, sf)
    tables.write_vectors(path, songs=songs, artists=embeddings.artist_embedding(songs),
                         users=embeddings.user_embedding(b.interactions(spark, sf), songs))
    rows = None
    for kind, key in (("song", "song_id"), ("artist", "artist_id"), ("user", "user_id")):
        part = tables.read_vectors(spark, path, f"{kind}s").select(
            F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"),
            F.posexplode("embedding").alias("pos", "x"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query("write_text_index", check(
    "SELECT id AS song_id, term, weight FROM doc_w", "doc_w"), doubles=("weight",))
def write_text_index(spark, sf):
    path = session.shared_path(spark, "text-index")
    text.build_text_index(b.documents(spark, sf), path)
    return tables.read_text_index(spark, path)["postings"].select("song_id", "term", "weight")


@query("merge_sources", """
  WITH logged AS (SELECT 'p' || l_partkey AS song_id, l_orderkey, l_linenumber FROM lineitem)
  SELECT l.song_id, l.l_orderkey AS order_id, l.l_linenumber AS line, p.p_size / 50.0::DOUBLE AS energy
  FROM logged l JOIN part p ON 'p' || p.p_partkey = l.song_id""", doubles=("energy",), wholes=("line",))
def merge_sources(spark, sf):
    raw = b.raw_catalog(spark, sf).select("song_id", "energy", "song_ord")
    plain = raw.withColumn("song_id", F.concat(F.lit("P"), "song_id"))
    again = raw.withColumn("song_id", F.concat(F.lit(" p"), F.col("song_id").cast("string"), F.lit(" "))).withColumn(
        "song_ord", F.col("song_ord") + F.lit(1 << 40))
    bought = b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), "l_partkey", F.lit(" ")).alias("song_id"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"))
    return catalog.merge_sources(plain.unionByName(again), bought).select("song_id", "order_id", "line", "energy")


# ---- projections, filters, predicates

_NUMBER_TEXT = """CASE o_orderkey % 4 WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN o_orderpriority
  WHEN 2 THEN ' ' || CAST(o_orderkey AS VARCHAR) || ' ' ELSE '' END"""


@query("safe_float", f"""
  SELECT o_orderkey AS song_id, coalesce(TRY_CAST(trim({_NUMBER_TEXT}) AS DOUBLE), 0.0) AS value FROM orders""",
       doubles=("value",))
def safe_float(spark, sf):
    key = F.col("o_orderkey")
    raw = (
        F.when(key % 4 == 0, F.col("o_totalprice").cast("string")).when(key % 4 == 1, F.col("o_orderpriority"))
        .when(key % 4 == 2, F.concat(F.lit(" "), key.cast("string"), F.lit(" "))).otherwise("")
    )
    return b.table(spark, sf, "orders").select(key.alias("song_id"), scalars.safe_float(raw).alias("value"))


@query("split_artists", check("""
  SELECT song_id, unnest(artists) AS artist FROM songs""", "songs"))
def split_artists(spark, sf):
    return b.raw_catalog(spark, sf).select("song_id", F.explode(scalars.split_artists("artist_name")).alias("artist"))


@query("primary_artist", check("SELECT song_id, first_artist AS artist FROM songs", "songs"))
def primary_artist(spark, sf):
    return b.raw_catalog(spark, sf).select("song_id", scalars.primary_artist("artist_name").alias("artist"))


@query("parse_release", """
  SELECT o_orderkey AS song_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS released FROM orders""")
def parse_release(spark, sf):
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = (
        F.when(key % 5 == 0, F.col("o_orderpriority")).when(key % 5 == 1, F.concat(day, F.lit(" 10:00")))
        .when(key % 5 == 2, F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.concat(F.lit(" "), day))
    )
    return b.table(spark, sf, "orders").select(
        key.alias("song_id"), F.date_format(scalars.parse_release(raw), "yyyy-MM-dd").alias("released"))


@query("genre_multi_hot", check(f"""
  SELECT user_id, pos, CASE WHEN list_contains(favorite_genres, {GENRES}[pos + 1]) THEN 1.0 ELSE 0.0 END AS value
  FROM answers, range(0, 6) AS r(pos)""", "answers"), doubles=("value",), wholes=("pos",))
def genre_multi_hot(spark, sf):
    hot = scalars.genre_multi_hot("favorite_genres", b.ITEM_GENRES)
    return b.answers(spark, sf).select("user_id", F.posexplode(hot).alias("pos", "value"))


@query("mood_targets", check("SELECT user_id, te, tv FROM answers", "answers"), doubles=("te", "tv"))
def mood_targets(spark, sf):
    targets = b.answers(spark, sf).select("user_id", profiles.mood_targets("moods").alias("t"))
    return targets.select("user_id", F.col("t.target_energy").alias("te"), F.col("t.target_valence").alias("tv"))


@query("exploration_weight", check("SELECT user_id, exploration_weight FROM answers", "answers"),
       doubles=("exploration_weight",))
def exploration_weight(spark, sf):
    return b.answers(spark, sf).select("user_id", scalars.exploration_weight("exploration").alias("exploration_weight"))


@query("build_profile", check("""
  SELECT user_id, name, 'relax' AS purpose, 'mixed' AS popularity_preference, exploration_weight, te, tv, mood AS moods,
    array_to_string(recent_artists, ',') AS recent FROM answers""", "answers"),
       doubles=("exploration_weight", "te", "tv"))
def build_profile(spark, sf):
    return users(spark, sf).select(
        "user_id", "name", "purpose", "popularity_preference", "exploration_weight",
        F.col("mood_targets.target_energy").alias("te"), F.col("mood_targets.target_valence").alias("tv"),
        F.array_join("selected_moods", ",").alias("moods"), F.array_join("recent_artists", ",").alias("recent"))


def _flawed_answers(spark, sf):
    key = F.col("user_id")
    words = F.array(*[F.lit(w) for w in b.ARTIST_WORDS])
    return b.answers(spark, sf).select(
        "user_id",
        F.when(key % 11 == 0, " ").when(key % 17 == 0, F.repeat("name", 4)).otherwise(F.col("name")).alias("name"),
        F.slice(words, F.lit(1), (key % 7).cast("int")).alias("favorite_artists"),
        F.slice(words, F.lit(3), (key % 4).cast("int")).alias("recent_artists"),
        F.slice("favorite_genres", F.lit(1), (key % 3).cast("int")).alias("favorite_genres"),
        F.when(key % 13 == 0, F.array(F.lit("Dreamy"))).otherwise(
            F.slice("moods", F.lit(1), (key % 5).cast("int"))).alias("moods"))


@query("validate_profiles", """
  SELECT user_id, problems, problems = '' AS valid FROM (SELECT c_custkey AS user_id, array_to_string(list_filter([
    CASE WHEN c_custkey % 11 = 0 THEN 'name is blank' END,
    CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 17 = 0 THEN 'name is longer than 60' END,
    CASE WHEN NOT (c_custkey % 7 BETWEEN 3 AND 5) THEN 'favorite_artists needs 3 to 5' END,
    CASE WHEN NOT (c_custkey % 4 BETWEEN 2 AND 3) THEN 'recent_artists needs 2 to 3' END,
    CASE WHEN c_custkey % 3 = 0 THEN 'favorite_genres needs 1' END,
    CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 5 = 0 THEN 'moods needs 1' END,
    CASE WHEN c_custkey % 13 = 0 THEN 'moods holds an unknown mood' END], lambda x: x IS NOT NULL), '; ') AS problems
  FROM customer)""")
def validate_profiles(spark, sf):
    return profiles.validate_profiles(_flawed_answers(spark, sf)).select(
        "user_id", F.array_join("problems", "; ").alias("problems"), "valid")


@query("validate_seed_picks", """
  SELECT l_orderkey AS user_id, count(DISTINCT l_partkey) AS n_seeds, count(DISTINCT l_partkey) BETWEEN 2 AND 5 AS valid
  FROM lineitem GROUP BY l_orderkey""")
def validate_seed_picks(spark, sf):
    return profiles.validate_seed_picks(b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("user_id"), F.col("l_partkey").alias("song_id")))


def _songs_with(spark, sf, name, value):
    return b.songs(spark, sf).select("song_id", value.alias(name))


@query("energy_band", check("""
  SELECT song_id, CASE WHEN energy >= 0.8 THEN 'very high energy' WHEN energy >= 0.6 THEN 'high energy'
    WHEN energy >= 0.4 THEN 'moderate energy' WHEN energy >= 0.2 THEN 'low energy' ELSE 'very calm' END AS band
  FROM songs""", "songs"))
def energy_band(spark, sf):
    return _songs_with(spark, sf, "band", scalars.energy_band("energy"))


@query("valence_band", check("""
  SELECT song_id, CASE WHEN valence >= 0.7 THEN 'very upbeat' WHEN valence >= 0.5 THEN 'positive'
    WHEN valence >= 0.3 THEN 'neutral' ELSE 'melancholy' END AS band FROM songs""", "songs"))
def valence_band(spark, sf):
    return _songs_with(spark, sf, "band", scalars.valence_band("valence"))


@query("popularity_band", check("""
  SELECT song_id, CASE WHEN popularity_norm >= 0.8 THEN 'very popular' WHEN popularity_norm >= 0.6 THEN 'popular'
    WHEN popularity_norm >= 0.4 THEN 'moderately popular' ELSE 'niche underground' END AS band FROM songs""", "songs"))
def popularity_band(spark, sf):
    return _songs_with(spark, sf, "band", scalars.popularity_band("popularity_norm"))


@query("use_case_tags", check("""
  SELECT song_id, regexp_extract(text, 'Good for (.*)\\.$', 1) AS tags FROM descriptions""", "descriptions"))
def use_case_tags(spark, sf):
    return _songs_with(spark, sf, "tags", scalars.use_case_tags())


@query("release_era", check("""
  SELECT song_id, CAST(CAST(left(release_date, 4) AS INTEGER) // 10 * 10 AS VARCHAR) || 's' AS era FROM songs""", "songs"))
def release_era(spark, sf):
    return _songs_with(spark, sf, "era", scalars.release_era("release_date"))


@query("song_description", check("SELECT song_id, title, artist, text FROM descriptions", "descriptions"))
def song_description(spark, sf):
    return jobs.describe_songs(b.songs(spark, sf)).drop("song_ord")


def _pairs(spark, sf):
    return coldstart.pair_scores(b.purchases(spark, sf), b.songs(spark, sf), users(spark, sf), b.ITEM_GENRES)


def _pair_query(name, column, doubles=True):
    @query(name, check(f"SELECT user_id, song_id, {column} FROM scored_pairs", "scored_pairs"),
           doubles=(column,) if doubles else ())
    def build(spark, sf):
        return _pairs(spark, sf).select("user_id", "song_id", column)


@query("familiar_flag", check("SELECT user_id, song_id, bought, familiar FROM scored_pairs JOIN pairs USING (user_id, song_id)",
                              "scored_pairs", "pairs"))
def familiar_flag(spark, sf):
    return coldstart.familiar_flag(b.purchases(spark, sf), b.songs(spark, sf), users(spark, sf)).select(
        "user_id", "song_id", "bought", "familiar")


_pair_query("genre_similarity", "genre_similarity")
_pair_query("mood_compatibility", "mood_compatibility")
_pair_query("score_familiar", "familiar_score")
_pair_query("score_discovery", "discovery_score")


@query("artist_similarity_cold", check("""
  SELECT p.user_id, p.song_id, CASE WHEN t.artist_vector IS NOT NULL AND a.embedding IS NOT NULL
    THEN round(list_cosine_similarity(t.artist_vector, a.embedding), 9) ELSE p.artist_similarity END AS artist_similarity
  FROM scored_pairs p JOIN songs s USING (song_id) LEFT JOIN brand_taste t USING (user_id)
  LEFT JOIN brand_vec a ON a.artist_id = s.artist_id""", "scored_pairs", "songs", "brand_taste", "brand_vec"),
       doubles=("artist_similarity",))
def artist_similarity_cold(spark, sf):
    songs = b.songs(spark, sf)
    by_brand = embeddings.artist_embedding(brand_vectors(spark, sf))
    taste = embeddings.user_artist_vector(b.interactions(spark, sf), songs, by_brand)
    pairs = b.purchases(spark, sf).select("user_id", "song_id")
    return coldstart.artist_similarity_cold(pairs, songs, users(spark, sf), taste, by_brand)


def brand_vectors(spark, sf):
    """Song vectors under the catalog's artist ids."""
    return b.song_vectors(spark, sf).drop("artist_id").join(
        b.songs(spark, sf).select("song_id", "artist_id"), "song_id")


@query("freshness", check(f"""
  SELECT song_id, exp(-0.01::DOUBLE * greatest(0.0::DOUBLE, floor(date_diff('second', released, {AS_OF}) / 86400.0::DOUBLE)))
    AS freshness FROM songs""", "songs"), doubles=("freshness",))
def freshness(spark, sf):
    return _songs_with(spark, sf, "freshness", scalars.freshness("released", b.as_of()))


@query("popularity_feature", check("SELECT song_id, popularity_norm AS popularity FROM songs", "songs"),
       doubles=("popularity",))
def popularity_feature(spark, sf):
    return b.text_catalog(spark, sf).select(
        F.col("song_id").cast("bigint").alias("song_id"), scalars.safe_float("popularity_norm").alias("popularity"))


@query("song_search", check("""
  SELECT song_id, title, artist_name, genre FROM songs
  WHERE (contains(lower(title), 'red') OR contains(lower(artist_name), 'red'))
    AND song_id NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7)
  ORDER BY song_ord LIMIT 20""", "songs"))
def song_search(spark, sf):
    chosen = b.purchases(spark, sf).where("user_id = 7").select("song_id")
    return artists.song_search(b.songs(spark, sf), "Red", chosen).drop("song_ord")


@query("song_search_many", check(f"""
  SELECT query_id, song_id, title, pos FROM (SELECT c_custkey AS query_id, songs.song_id, title,
      row_number() OVER (PARTITION BY c_custkey ORDER BY song_ord) AS pos
    FROM customer JOIN songs ON contains(lower(title), {WORDS}[c_custkey % 16 + 1][1:2])
      OR contains(lower(artist_name), {WORDS}[c_custkey % 16 + 1][1:2])
    ANTI JOIN pairs ON pairs.user_id = c_custkey AND pairs.song_id = songs.song_id) WHERE pos <= 20""", "songs", "pairs"))
def song_search_many(spark, sf):
    asked = b.answers(spark, sf).select(
        F.col("user_id").alias("query_id"), F.upper(F.left(F.col("favorite_artists")[0], F.lit(2))).alias("text"))
    chosen = b.purchases(spark, sf).select(F.col("user_id").alias("query_id"), "song_id")
    return artists.song_search_many(b.songs(spark, sf), asked, chosen)


@query("song_search_words", check(f"""
  SELECT query_id, song_id, title, pos FROM (SELECT c_custkey AS query_id, songs.song_id, title,
      row_number() OVER (PARTITION BY c_custkey ORDER BY song_ord) AS pos
    FROM customer JOIN songs ON contains(lower(title), {WORDS}[c_custkey % 16 + 1])
      OR contains(lower(artist_name), {WORDS}[c_custkey % 16 + 1])) WHERE pos <= 20""", "songs"))
def song_search_words(spark, sf):
    """Whole words, which are longer than the pieces of the index."""
    asked = b.answers(spark, sf).select(F.col("user_id").alias("query_id"), F.col("favorite_artists")[0].alias("text"))
    return artists.song_search_many(b.songs(spark, sf), asked)


@query("drop_blank_ids", check("SELECT CAST(song_id AS VARCHAR) AS song_id, title FROM songs WHERE song_id % 10 <> 0", "songs"))
def drop_blank_ids(spark, sf):
    rows = b.raw_catalog(spark, sf).select(
        F.when(F.col("song_id") % 10 == 0, "  ").otherwise(F.col("song_id").cast("string")).alias("song_id"), "title")
    return catalog.drop_blank_ids(rows)


@query("legacy_weighted_score", check("""
  SELECT song_id, 0.4::DOUBLE * energy + 0.3::DOUBLE * valence + 0.1::DOUBLE * danceability + 0.1::DOUBLE * acousticness
    + 0.001::DOUBLE * tempo_bpm + CASE WHEN genre = 'promo' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS score
  FROM songs ORDER BY score DESC, song_ord LIMIT 10""", "songs"), doubles=("score",))
def legacy_weighted_score(spark, sf):
    weights = {"energy": 0.4, "valence": 0.3, "danceability": 0.1, "acousticness": 0.1, "tempo_bpm": 0.001}
    score = scalars.weighted_score(weights, genre="promo", genre_weight=0.2)
    return b.songs(spark, sf).withColumn("score", score).orderBy(F.desc("score"), "song_ord").limit(10).select(
        "song_id", "score")


# ---- sets of artists

@query("known_artists", check("SELECT user_id, unnest(known) AS artist FROM users", "users"))
def known_artists(spark, sf):
    return candidates.known_artists(b.answers(spark, sf))


@query("artist_overlap", check("""
  SELECT user_id, song_id, list_has_any(artists, recent_artists) AS overlaps
  FROM pairs JOIN songs USING (song_id) JOIN users USING (user_id)""", "pairs", "songs", "users"))
def artist_overlap(spark, sf):
    rows = b.purchases(spark, sf).join(b.songs(spark, sf).select("song_id", "artists"), "song_id").join(
        b.answers(spark, sf).select("user_id", "recent_artists"), "user_id")
    return rows.select("user_id", "song_id", F.arrays_overlap("artists", "recent_artists").alias("overlaps"))


@query("distinct_artist_ids", check("SELECT DISTINCT artist_id FROM songs", "songs"))
def distinct_artist_ids(spark, sf):
    return artists.distinct_artist_ids(b.songs(spark, sf))


@query("top_artists", check("""
  SELECT artist, max(popularity) AS peak_popularity FROM (SELECT unnest(artists) AS artist, popularity FROM songs)
  GROUP BY artist ORDER BY peak_popularity DESC, artist LIMIT 500""", "songs"), doubles=("peak_popularity",))
def top_artists(spark, sf):
    return artists.top_artists(b.songs(spark, sf))
