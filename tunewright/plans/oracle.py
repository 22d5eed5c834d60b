"""SQL building blocks of the checks: the driver's tables under the engine's names."""

from __future__ import annotations

from tunewright.functions import fixed
from tunewright.sources import bindings


def _texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


WORDS = _texts(bindings.ARTIST_WORDS)
GENRES = _texts(bindings.ITEM_GENRES)
AS_OF = f"TIMESTAMP '{bindings.AS_OF}'"


def _case(column: str, values: dict) -> str:
    return "CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_TE = _case("c_mktsegment", {s: f"{fixed.MOODS[m][0]}::DOUBLE" for s, m in bindings.SEGMENT_MOODS.items()})
_TV = _case("c_mktsegment", {s: f"{fixed.MOODS[m][1]}::DOUBLE" for s, m in bindings.SEGMENT_MOODS.items()})
_MOOD = _case("c_mktsegment", {s: f"'{m}'" for s, m in bindings.SEGMENT_MOODS.items()})


def python_round(expression: str, digits: int) -> str:
    """printf rounds the exact binary value half to even."""
    return f"CAST(printf('%.{digits}f', {expression}) AS DOUBLE)"


PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def part(name: str, sql: str, *needs: str) -> None:
    PARTS[name] = (sql, needs)


def check(final: str, *needs: str) -> str:
    """``final`` with the parts it needs, and theirs, as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name not in ordered:
            for other in PARTS[name][1]:
                add(other)
            ordered.append(name)

    for name in needs:
        add(name)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({PARTS[n][0]})" for n in ordered) + " " + final


part("songs", """
  SELECT p_partkey AS song_id, p_partkey AS song_ord, p_name AS title, p_brand AS artist_id,
    replace(p_name, ' ', ';') AS artist_name, list_distinct(string_split(p_name, ' ')) AS artists,
    string_split(p_name, ' ')[1] AS first_artist, lower(p_type) AS genre, '' AS mood,
    strftime(DATE '1995-01-01' + CAST((p_partkey * 37) % 2500 AS INTEGER), '%Y-%m-%d') AS release_date,
    CAST(DATE '1995-01-01' + CAST((p_partkey * 37) % 2500 AS INTEGER) AS TIMESTAMP) AS released,
    p_size / 50.0::DOUBLE AS energy, 60.0::DOUBLE + 2.0::DOUBLE * p_size AS tempo_bpm,
    (p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE AS valence,
    (p_partkey % 7) / 7.0::DOUBLE AS danceability, (p_partkey % 11) / 11.0::DOUBLE AS acousticness,
    (p_partkey % 10) / 10.0::DOUBLE AS instrumentalness, (p_partkey % 20) / 100.0::DOUBLE AS speechiness,
    (p_partkey % 13) / 13.0::DOUBLE AS liveness, -((p_partkey % 17)::DOUBLE) AS loudness,
    (p_partkey % 101)::DOUBLE AS popularity, (p_partkey % 101) / 100.0::DOUBLE AS popularity_norm
  FROM part""")

# Audio features with mean 0 and deviation 1.
part("scaled", "SELECT song_id, artist_id, [" + ", ".join(
    f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER ()" for f in fixed.AUDIO_FEATURES) + "] AS z FROM songs", "songs")

part("answers", f"""
  SELECT c_custkey AS user_id, c_name AS name, c_nationkey % 3 AS level, {_MOOD} AS mood,
    [{WORDS}[c_custkey % 16 + 1], {WORDS}[(c_custkey + 5) % 16 + 1], {WORDS}[(c_custkey + 9) % 16 + 1]] AS favorite_artists,
    [{WORDS}[(c_custkey + 2) % 16 + 1], {WORDS}[(c_custkey + 5) % 16 + 1]] AS recent_artists,
    [{GENRES}[c_custkey % 6 + 1], {GENRES}[(c_custkey + 2) % 6 + 1]] AS favorite_genres,
    {_TE} AS te, {_TV} AS tv,
    CASE c_nationkey % 3 WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS exploration_weight
  FROM customer""")

part("users", """
  SELECT *, list_distinct(list_concat(favorite_artists, recent_artists)) AS known FROM answers""", "answers")

part("log", """
  SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS song_id,
    CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS label, ts, event_id AS log_ord
  FROM events""")
part("liked", "SELECT user_id, song_id, log_ord FROM log WHERE label = 1", "log")

part("vec", """
  SELECT vec_id AS song_id, vec_id AS song_ord, label AS artist_id,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings""")
part("vec_long", """
  SELECT song_id, artist_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM vec""", "vec")
part("user_vec_long", """
  SELECT user_id, pos, avg(x) AS x, count(*) AS n_liked FROM liked JOIN vec_long USING (song_id) GROUP BY ALL""",
     "liked", "vec_long")
part("user_vec", """
  SELECT user_id, list(x ORDER BY pos) AS embedding, any_value(n_liked) AS n_liked FROM user_vec_long GROUP BY user_id""",
     "user_vec_long")
part("artist_vec_long", "SELECT artist_id, pos, avg(x) AS x, count(*) AS n_songs FROM vec_long GROUP BY ALL", "vec_long")
part("artist_vec", """
  SELECT artist_id, list(x ORDER BY pos) AS embedding FROM artist_vec_long GROUP BY artist_id""", "artist_vec_long")
part("taste_long", """
  SELECT user_id, pos, avg(x) AS x FROM (
    SELECT l.user_id, v.artist_id FROM liked l JOIN vec v USING (song_id)) JOIN artist_vec_long USING (artist_id)
  GROUP BY ALL""", "liked", "vec", "artist_vec_long")
part("taste", "SELECT user_id, list(x ORDER BY pos) AS artist_vector FROM taste_long GROUP BY user_id", "taste_long")

# The same with the catalog's own artists (brands) for songs that have a vector.
part("brand_vec_long", """
  SELECT s.artist_id, pos, avg(x) AS x FROM vec_long v JOIN songs s USING (song_id) GROUP BY ALL""", "vec_long", "songs")
part("brand_vec", "SELECT artist_id, list(x ORDER BY pos) AS embedding FROM brand_vec_long GROUP BY artist_id",
     "brand_vec_long")
part("brand_taste_long", """
  SELECT user_id, pos, avg(x) AS x FROM (
    SELECT l.user_id, s.artist_id FROM liked l JOIN songs s USING (song_id)) JOIN brand_vec_long USING (artist_id)
  GROUP BY ALL""", "liked", "songs", "brand_vec_long")
part("brand_taste", "SELECT user_id, list(x ORDER BY pos) AS artist_vector FROM brand_taste_long GROUP BY user_id",
     "brand_taste_long")

part("pairs", """
  SELECT o_custkey AS user_id, l_partkey AS song_id, count(*) AS bought
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")

_MOOD_FIT = python_round("1.0::DOUBLE - (abs(energy - te) + abs(valence - tv)) / 2.0::DOUBLE", 4)
_DISCOVERY = python_round("0.40::DOUBLE * genre_similarity + 0.35::DOUBLE * mood_compatibility + 0.25::DOUBLE * popularity_norm", 4)
_BY_NAME = """CASE WHEN list_has_any(artists, favorite_artists) THEN 1.0::DOUBLE
           WHEN list_has_any(artists, recent_artists) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END"""


def scored(name: str, source: str, artist_similarity: str, *needs: str) -> None:
    """First-run scores of (user, song) rows."""
    part(name, f"""
  SELECT *, 0.5::DOUBLE * artist_similarity + 0.3::DOUBLE * genre_similarity + 0.2::DOUBLE * popularity_norm AS familiar_score,
    {_DISCOVERY} AS discovery_score
  FROM (SELECT user_id, song_id, song_ord, artists, popularity_norm, exploration_weight,
      list_has_any(artists, known) AS familiar,
      {artist_similarity} AS artist_similarity,
      CASE WHEN list_contains(favorite_genres, genre) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS genre_similarity,
      {_MOOD_FIT} AS mood_compatibility
    FROM {source})""", *needs)


scored("scored_pairs", "pairs JOIN songs USING (song_id) JOIN users USING (user_id)", _BY_NAME, "pairs", "songs", "users")
scored("scored_all", "songs CROSS JOIN users", _BY_NAME, "songs", "users")
part("brand_match", """
  SELECT user_id, artist_id, round(list_cosine_similarity(t.artist_vector, a.embedding), 9) AS by_vector
  FROM brand_taste t CROSS JOIN brand_vec a""", "brand_taste", "brand_vec")
scored("scored_by_vector", "songs CROSS JOIN users LEFT JOIN brand_match USING (user_id, artist_id)",
       f"coalesce(by_vector, {_BY_NAME})", "songs", "users", "brand_match")


def greedy(pool: str, quota: str, name: str, strict: bool, *needs: str) -> None:
    """Best-first picks, one song per artist, as a recursive walk over the ranked pool."""
    part(f"{name}_best", f"""
      SELECT user_id, song_id, song_ord, artists, score, row_number() OVER (
        PARTITION BY user_id ORDER BY score DESC, song_ord) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id, list_sort(artists)
              ORDER BY score DESC, song_ord) AS n FROM {pool}) WHERE n = 1""", *needs)
    part(f"{name}_walk", f"""
      SELECT user_id, 0 AS pos, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS song_id, CAST([] AS VARCHAR[]) AS used,
        quota FROM {quota}
      UNION ALL
      SELECT w.user_id, w.pos + 1, min(b.place), arg_min(b.song_id, b.place),
        list_concat(any_value(w.used), arg_min(b.artists, b.place)), w.quota
      FROM {name}_walk w JOIN {name}_best b ON b.user_id = w.user_id AND b.place > w.place
      WHERE w.pos < w.quota AND NOT list_has_any(b.artists, w.used)
      GROUP BY w.user_id, w.pos, w.quota""", f"{name}_best")
    part(f"{name}_strict", f"""
      SELECT w.user_id, w.song_id, p.song_ord, p.score, w.pos FROM {name}_walk w
      JOIN {name}_best p ON p.user_id = w.user_id AND p.song_id = w.song_id WHERE w.pos > 0""", f"{name}_walk")
    if strict:
        part(name, f"SELECT * FROM {name}_strict", f"{name}_strict")
        return
    part(f"{name}_left", f"""
      SELECT p.user_id, p.song_id, p.song_ord, p.score,
        row_number() OVER (PARTITION BY p.user_id ORDER BY p.score DESC, p.song_ord) AS n
      FROM {pool} p ANTI JOIN {name}_strict s ON s.user_id = p.user_id AND s.song_id = p.song_id""", f"{name}_strict")
    part(name, f"""
      SELECT * FROM {name}_strict UNION ALL
      SELECT l.user_id, l.song_id, l.song_ord, l.score, coalesce(h.have, 0) + l.n AS pos
      FROM {name}_left l JOIN {quota} q USING (user_id)
      LEFT JOIN (SELECT user_id, count(*) AS have FROM {name}_strict GROUP BY user_id) h USING (user_id)
      WHERE l.n <= q.quota - coalesce(h.have, 0)""", f"{name}_left")


def slot_lists(prefix: str, source: str, top_n: int) -> None:
    """Familiar and discovery picks and their merged list for one scored pair table."""
    part(f"{prefix}_fam_pool", f"SELECT user_id, song_id, song_ord, artists, familiar_score AS score FROM {source} WHERE familiar", source)
    part(f"{prefix}_disc_pool", f"SELECT user_id, song_id, song_ord, artists, discovery_score AS score FROM {source} WHERE NOT familiar", source)
    part(f"{prefix}_fam_quota", f"""
      SELECT user_id, {top_n} - CAST(printf('%.0f', {top_n}.0::DOUBLE * exploration_weight) AS INTEGER) AS quota FROM users""", "users")
    greedy(f"{prefix}_fam_pool", f"{prefix}_fam_quota", f"{prefix}_fam", True, f"{prefix}_fam_pool", f"{prefix}_fam_quota")
    part(f"{prefix}_disc_quota", f"""
      SELECT user_id, CAST({top_n} - coalesce(n, 0) AS INTEGER) AS quota FROM users
      LEFT JOIN (SELECT user_id, count(*) AS n FROM {prefix}_fam GROUP BY user_id) USING (user_id)""", "users", f"{prefix}_fam")
    greedy(f"{prefix}_disc_pool", f"{prefix}_disc_quota", f"{prefix}_disc", False, f"{prefix}_disc_pool", f"{prefix}_disc_quota")
    part(f"{prefix}_list", f"""
      SELECT user_id, song_id, song_ord, score, familiar,
        row_number() OVER (PARTITION BY user_id ORDER BY score DESC, familiar DESC, pos) AS rank
      FROM (SELECT *, TRUE AS familiar FROM {prefix}_fam UNION ALL SELECT *, FALSE AS familiar FROM {prefix}_disc)""",
         f"{prefix}_fam", f"{prefix}_disc")


# Users whose survey passes; the others leave their favourites blank.
part("accepted", "SELECT * FROM users WHERE user_id % 50 <> 7", "users")

slot_lists("cold", "scored_all", 10)
slot_lists("vector_cold", "scored_by_vector", 10)
slot_lists("bought", "scored_pairs", 10)

part("windows", "SELECT " + ", ".join(
    f"count(*) FILTER (released >= {AS_OF} - INTERVAL {w} DAY) AS within_{w}" for w in fixed.FRESH_WINDOWS) + " FROM songs", "songs")
part("fresh", "SELECT s.* FROM songs s, (SELECT CASE " + " ".join(
    f"WHEN within_{w} >= {fixed.MIN_FRESH} THEN {w}" for w in fixed.FRESH_WINDOWS)
    + f" END AS days FROM windows) WHERE days IS NULL OR released >= {AS_OF} - to_days(CAST(days AS INTEGER))", "songs", "windows")


def near(name: str, user_vec: str) -> None:
    """The 100 fresh songs nearest to each user vector, and those of users with a profile."""
    part(name, f"""
      SELECT * FROM (SELECT user_id, song_id, similarity,
          row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, song_ord) AS pos
        FROM (SELECT u.user_id, f.song_id, f.song_ord, round(list_cosine_similarity(u.embedding, v.embedding), 9) AS similarity
          FROM {user_vec} u CROSS JOIN fresh f JOIN vec v ON v.song_id = f.song_id)) WHERE pos <= 100""",
         user_vec, "fresh", "vec")
    part(f"{name}_of_users", f"SELECT n.* FROM {name} n SEMI JOIN users u ON u.user_id = n.user_id", name, "users")


near("near_songs", "user_vec")
part("known_songs", """
  SELECT * FROM (SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY song_ord) AS pos
    FROM users JOIN fresh ON list_has_any(known, artists)) WHERE pos <= 200""", "users", "fresh")


def pool(name: str, first: str, second: str) -> None:
    part(name, f"""
      SELECT user_id, song_id, cand_pos FROM (
        SELECT user_id, song_id, row_number() OVER (PARTITION BY user_id ORDER BY src, pos) AS cand_pos
        FROM (SELECT user_id, song_id, min(src) AS src, arg_min(pos, src) AS pos FROM (
            SELECT user_id, song_id, 0 AS src, pos FROM {first} UNION ALL
            SELECT user_id, song_id, 1 AS src, pos FROM {second}) GROUP BY user_id, song_id))
      WHERE cand_pos <= 200""", first, second)


pool("pool", "near_songs_of_users", "known_songs")


part("near_artists", """
  SELECT user_id, artist_id, similarity, rank FROM (SELECT user_id, artist_id, similarity,
      row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, artist_id) AS rank
    FROM (SELECT t.user_id, a.artist_id, round(list_cosine_similarity(t.artist_vector, a.embedding), 9) AS similarity
      FROM brand_taste t CROSS JOIN brand_vec a)) WHERE rank <= 10""", "brand_taste", "brand_vec")
part("near_artist_songs", """
  SELECT user_id, song_id, pos FROM (SELECT n.user_id, f.song_id,
      row_number() OVER (PARTITION BY n.user_id ORDER BY f.song_ord) AS pos
    FROM near_artists n JOIN fresh f USING (artist_id)) WHERE pos <= 200""", "near_artists", "fresh")
part("artist_part", """
  SELECT user_id, song_id, pos FROM near_artist_songs
  UNION ALL SELECT k.user_id, k.song_id, k.pos FROM known_songs k ANTI JOIN brand_taste t ON t.user_id = k.user_id""",
     "near_artist_songs", "known_songs", "brand_taste")
pool("artist_pool", "near_songs_of_users", "artist_part")


def features(name: str, source: str, with_artist: bool = False, liked: str = "liked", user_vec: str = "user_vec") -> None:
    artist = "coalesce(round(list_cosine_similarity(t.artist_vector, a.embedding), 9), 0.0)" if with_artist else "0.0::DOUBLE"
    joins = "LEFT JOIN brand_taste t USING (user_id) LEFT JOIN brand_vec a ON a.artist_id = s.artist_id" if with_artist else ""
    part(f"{name}_collab", f"""
      SELECT p.user_id, p.song_id, avg(list_cosine_similarity(v.embedding, w.embedding)) AS c
      FROM {source} p JOIN vec v ON v.song_id = p.song_id JOIN {liked} l ON l.user_id = p.user_id
      JOIN vec w ON w.song_id = l.song_id GROUP BY ALL""", source, "vec", liked)
    part(name, f"""
      SELECT p.user_id, p.song_id, p.cand_pos,
        coalesce(round(list_cosine_similarity(u.embedding, v.embedding), 9), 0.0) AS content_similarity,
        {artist} AS artist_similarity,
        exp(-0.01::DOUBLE * greatest(0.0::DOUBLE, floor(date_diff('second', s.released, {AS_OF}) / 86400.0::DOUBLE))) AS freshness,
        s.popularity_norm AS popularity, coalesce(round(c.c, 9), 0.0) AS collaborative_score,
        CAST(row_number() OVER (PARTITION BY p.user_id, s.artist_id ORDER BY p.cand_pos) - 1 AS DOUBLE) AS diversity_penalty
      FROM {source} p JOIN songs s USING (song_id) LEFT JOIN {user_vec} u USING (user_id)
      LEFT JOIN vec v ON v.song_id = p.song_id LEFT JOIN {name}_collab c ON c.user_id = p.user_id AND c.song_id = p.song_id
      {joins}""", source, "songs", user_vec, "vec", f"{name}_collab", *(("brand_taste", "brand_vec") if with_artist else ()))


def ranked(name: str, source: str) -> None:
    part(name, f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, cand_pos) AS rank
        FROM (SELECT *, 0.35::DOUBLE * content_similarity + 0.25::DOUBLE * collaborative_score
            + 0.20::DOUBLE * artist_similarity + 0.10::DOUBLE * freshness + 0.10::DOUBLE * popularity AS score FROM {source}))
      WHERE rank <= 50""", source)


features("pool_features", "pool")
ranked("pool_ranked", "pool_features")

features("artist_pool_features", "artist_pool", True)
ranked("artist_pool_ranked", "artist_pool_features")

part("descriptions", """
  SELECT song_id, song_ord, title, string_split(artist_name, ';')[1] AS artist,
    '"' || title || '" by ' || string_split(artist_name, ';')[1] || CASE WHEN genre <> '' THEN ' — ' || genre ELSE '' END
    || ' ' || CAST(CAST(left(release_date, 4) AS INTEGER) // 10 * 10 AS VARCHAR) || 's. '
    || CASE WHEN energy >= 0.8 THEN 'very high energy' WHEN energy >= 0.6 THEN 'high energy'
         WHEN energy >= 0.4 THEN 'moderate energy' WHEN energy >= 0.2 THEN 'low energy' ELSE 'very calm' END
    || ' ' || printf('%.0f', tempo_bpm) || ' BPM '
    || CASE WHEN valence >= 0.7 THEN 'very upbeat' WHEN valence >= 0.5 THEN 'positive'
         WHEN valence >= 0.3 THEN 'neutral' ELSE 'melancholy' END
    || ' valence ' || printf('%.2f', valence)
    || CASE WHEN instrumentalness >= 0.5 THEN ' instrumental no lyrics' ELSE '' END || '. '
    || CASE WHEN popularity_norm >= 0.8 THEN 'very popular' WHEN popularity_norm >= 0.6 THEN 'popular'
         WHEN popularity_norm >= 0.4 THEN 'moderately popular' ELSE 'niche underground' END
    || '. Good for ' || tags || '.' AS text
  FROM (SELECT *, CASE WHEN len(list_filter(cases, lambda c: c IS NOT NULL)) = 0 THEN 'general listening'
          ELSE array_to_string(list_filter(cases, lambda c: c IS NOT NULL), ' ') END AS tags
    FROM (SELECT *, [
        CASE WHEN energy >= 0.7 AND tempo_bpm >= 120 THEN 'working out exercise gym' END,
        CASE WHEN energy <= 0.5 AND instrumentalness >= 0.4 AND speechiness < 0.1 THEN 'studying focus concentration' END,
        CASE WHEN valence >= 0.6 AND energy >= 0.5 THEN 'uplifting happy cheerful' END,
        CASE WHEN valence <= 0.35 AND energy <= 0.5 THEN 'melancholy sad reflection emotional' END,
        CASE WHEN energy <= 0.35 AND instrumentalness >= 0.5 THEN 'sleeping relaxing meditation calm' END,
        CASE WHEN energy >= 0.6 AND valence >= 0.5 THEN 'party dancing social' END] AS cases FROM songs))""", "songs")


def text_index(prefix: str, docs: str, queries: str, *needs: str) -> None:
    """TF-IDF of ``docs(id, text)`` and of ``queries(id, text)`` against its vocabulary."""
    def counts(name: str, source: str) -> None:
        part(f"{name}_tokens", f"SELECT id, regexp_extract_all(lower(text), '{fixed.TOKEN_PATTERN}') AS t FROM ({source})", *needs)
        part(f"{name}_tf", f"""
          SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(list_concat(t, list_transform(
            range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM {name}_tokens) GROUP BY ALL""",
             f"{name}_tokens")

    counts(prefix, docs)
    part(f"{prefix}_vocab", f"""
      SELECT term, cf, df, ln((1.0::DOUBLE + (SELECT count(*) FROM ({docs}))) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf
      FROM (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM {prefix}_tf GROUP BY term
            ORDER BY cf DESC, term LIMIT {fixed.MAX_TERMS})""", f"{prefix}_tf")

    def weights(name: str) -> None:
        part(f"{name}_w", f"""
          SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight
          FROM (SELECT id, term, (1.0::DOUBLE + ln(tf)) * idf AS raw FROM {name}_tf JOIN {prefix}_vocab USING (term))""",
             f"{name}_tf", f"{prefix}_vocab")

    weights(prefix)
    counts(f"{prefix}_q", queries)
    weights(f"{prefix}_q")
    part(f"{prefix}_hits", f"""
      SELECT query_id, song_id, score, pos FROM (
        SELECT q.id AS query_id, d.id AS song_id, round(coalesce(s.score, 0.0), 9) AS score,
          row_number() OVER (PARTITION BY q.id ORDER BY round(coalesce(s.score, 0.0), 9) DESC, d.id) AS pos
        FROM (SELECT id FROM ({queries})) q CROSS JOIN (SELECT id FROM ({docs})) d
        LEFT JOIN (SELECT a.id AS qid, b.id AS did, sum(a.weight * b.weight) AS score
                   FROM {prefix}_q_w a JOIN {prefix}_w b USING (term) GROUP BY ALL) s
          ON s.qid = q.id AND s.did = d.id) WHERE pos <= {fixed.SEARCH_HITS}""", f"{prefix}_q_w", f"{prefix}_w", *needs)


text_index("doc", "SELECT doc_id AS id, text FROM documents", "SELECT item_id AS id, text FROM benchmark")

part("user_intents", """
  SELECT user_id, CASE WHEN user_id % 3 = 0 THEN favorite_artists[1] || ' ' || favorite_genres[1] || ' high energy' ELSE '' END AS intent
  FROM answers""", "answers")
text_index("song", "SELECT song_id AS id, text FROM descriptions",
           "SELECT DISTINCT intent AS id, intent AS text FROM user_intents WHERE intent <> ''", "descriptions", "user_intents")

part("mixed_pool", """
  SELECT user_id, song_id, cand_pos FROM pool JOIN user_intents USING (user_id) WHERE intent = ''
  UNION ALL SELECT user_id, song_id, pos AS cand_pos FROM user_intents JOIN song_hits ON query_id = intent""",
     "pool", "user_intents", "song_hits")
features("mixed_features", "mixed_pool")
ranked("mixed_ranked", "mixed_features")

# User vectors with the artist vector blended in below a number of likes, and lists made from them.
MANY_LIKES = 26
part("blend_vec_long", f"""
  SELECT user_id, n_liked, m.pos, CASE WHEN n_liked < {MANY_LIKES} AND t.x IS NOT NULL
    THEN 0.7::DOUBLE * m.x + 0.3::DOUBLE * t.x ELSE m.x END AS x
  FROM user_vec_long m LEFT JOIN brand_taste_long t USING (user_id, pos)""", "user_vec_long", "brand_taste_long")
part("blend_vec", "SELECT user_id, list(x ORDER BY pos) AS embedding FROM blend_vec_long GROUP BY user_id", "blend_vec_long")
near("blend_near_songs", "blend_vec")
pool("blend_pool", "blend_near_songs_of_users", "artist_part")
part("blend_mixed_pool", """
  SELECT user_id, song_id, cand_pos FROM blend_pool JOIN user_intents USING (user_id) WHERE intent = ''
  UNION ALL SELECT user_id, song_id, pos AS cand_pos FROM user_intents JOIN song_hits ON query_id = intent""",
     "blend_pool", "user_intents", "song_hits")
features("blend_mixed_features", "blend_mixed_pool", True, user_vec="blend_vec")
ranked("blend_mixed_ranked", "blend_mixed_features")

# Lists made from the earlier half of each user's log, judged by the likes of the later half.
part("halves", "SELECT *, ntile(2) OVER (PARTITION BY user_id ORDER BY ts, log_ord) AS half FROM log", "log")
part("half_liked", "SELECT user_id, song_id, log_ord FROM halves WHERE half = 1 AND label = 1", "halves")
part("half_vec", """
  SELECT user_id, list(x ORDER BY pos) AS embedding FROM (
    SELECT user_id, pos, avg(x) AS x FROM half_liked JOIN vec_long USING (song_id) GROUP BY ALL) GROUP BY user_id""",
     "half_liked", "vec_long")
near("half_near_songs", "half_vec")
part("half_known_songs", "SELECT k.* FROM known_songs k SEMI JOIN halves h ON h.user_id = k.user_id", "known_songs", "halves")
pool("half_pool", "half_near_songs_of_users", "half_known_songs")
features("half_features", "half_pool", liked="half_liked", user_vec="half_vec")
ranked("half_ranked", "half_features")
part("later_likes", "SELECT DISTINCT user_id, song_id FROM halves WHERE half = 2 AND label = 1", "halves")
part("half_metrics", """
  SELECT user_id, n_rows, n_positive, precision,
    CASE WHEN n_positive > 0 THEN hits / n_positive::DOUBLE ELSE 0.0 END AS recall,
    CASE WHEN n_positive > 0 THEN dcg / list_sum(list_transform(range(1, least(n_positive, 10) + 1), lambda i: 1 / log2(i + 1)))
      ELSE 0.0 END AS ndcg, diversity, novelty
  FROM (SELECT r.user_id, count(*) AS n_rows, coalesce(any_value(t.n), 0) AS n_positive,
      avg(CASE WHEN w.song_id IS NULL THEN 0 ELSE 1 END) FILTER (rank <= 10) AS precision,
      count(w.song_id) FILTER (rank <= 10) AS hits,
      sum(CASE WHEN w.song_id IS NULL THEN 0.0::DOUBLE ELSE 1 / log2(rank + 1) END) FILTER (rank <= 10) AS dcg,
      count(DISTINCT artist_id) FILTER (rank <= 10) / count(*) FILTER (rank <= 10) AS diversity,
      avg(-ln(popularity)) FILTER (rank <= 10 AND popularity > 0) AS novelty
    FROM half_ranked r JOIN (SELECT song_id, artist_id FROM songs) s USING (song_id)
    LEFT JOIN later_likes w ON w.user_id = r.user_id AND w.song_id = r.song_id
    LEFT JOIN (SELECT user_id, count(*) AS n FROM later_likes GROUP BY user_id) t ON t.user_id = r.user_id
    GROUP BY r.user_id)""", "half_ranked", "songs", "later_likes")

part("genres_by_song", "SELECT song_id, genre FROM songs", "songs")
part("history", """
  SELECT user_id, likes, skips,
    CASE WHEN likes = 0 AND skips = 0 THEN 'No listening history yet.' ELSE
      'Liked ' || likes || CASE WHEN likes = 1 THEN ' song.' ELSE ' songs.' END
      || CASE WHEN skips > 0 THEN ' Skipped ' || skips || '.' ELSE '' END
      || CASE WHEN top IS NOT NULL THEN ' Mostly ' || array_to_string(top, ', ') || '.' ELSE '' END END AS summary
  FROM (SELECT user_id, count(*) FILTER (label = 1) AS likes, count(*) FILTER (label <> 1) AS skips FROM log GROUP BY user_id)
  LEFT JOIN (SELECT user_id, list(genre ORDER BY n) AS top FROM (
      SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(log_ord)) AS n
      FROM liked JOIN genres_by_song USING (song_id) GROUP BY user_id, genre) WHERE n <= 3 GROUP BY user_id) USING (user_id)""",
     "log", "liked", "genres_by_song")

part("training", f"""
  SELECT l.user_id, l.song_id, l.label, l.log_ord,
    coalesce(round(list_cosine_similarity(u.embedding, v.embedding), 9), 0.0) AS content_similarity,
    coalesce(round(list_cosine_similarity(t.artist_vector, a.embedding), 9), 0.0) AS artist_similarity,
    exp(-0.01::DOUBLE * greatest(0.0::DOUBLE, floor(date_diff('second', s.released, {AS_OF}) / 86400.0::DOUBLE))) AS freshness,
    s.popularity_norm AS popularity, coalesce(round(c.c, 9), 0.0) AS collaborative_score, 0.0::DOUBLE AS diversity_penalty
  FROM log l JOIN songs s USING (song_id) JOIN vec v ON v.song_id = l.song_id LEFT JOIN user_vec u ON u.user_id = l.user_id
  LEFT JOIN brand_taste t ON t.user_id = l.user_id LEFT JOIN brand_vec a ON a.artist_id = s.artist_id
  LEFT JOIN loo c ON c.user_id = l.user_id AND c.song_id = l.song_id""",
     "log", "songs", "vec", "user_vec", "brand_taste", "brand_vec", "loo")
part("loo", """
  SELECT p.user_id, p.song_id, avg(list_cosine_similarity(v.embedding, w.embedding)) AS c
  FROM (SELECT DISTINCT user_id, song_id FROM log) p JOIN vec v ON v.song_id = p.song_id
  JOIN liked l ON l.user_id = p.user_id AND l.song_id <> p.song_id JOIN vec w ON w.song_id = l.song_id GROUP BY ALL""",
     "log", "liked", "vec")

# Model-free scores of logged rows, for the metrics.
part("judged", """
  SELECT log.user_id, label, log_ord AS row_ord, round(value, 1) AS score FROM log JOIN events ON event_id = log_ord""", "log")


def topk_metrics(name: str, source: str, k: int) -> None:
    part(f"{name}_rn", f"""
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, row_ord) AS rn,
        row_number() OVER (PARTITION BY user_id ORDER BY label DESC) AS ideal FROM {source}""", source)
    part(name, f"""
      SELECT user_id, n_rows, n_positive, precision,
        CASE WHEN n_positive > 0 THEN hits / n_positive ELSE 0.0 END AS recall,
        CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg
      FROM (SELECT user_id, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positive,
          avg(label) FILTER (rn <= {k}) AS precision, CAST(sum(label) FILTER (rn <= {k}) AS DOUBLE) AS hits,
          sum(label / log2(rn + 1)) FILTER (rn <= {k}) AS dcg, sum(label / log2(ideal + 1)) FILTER (ideal <= {k}) AS idcg
        FROM {name}_rn GROUP BY user_id)""", f"{name}_rn")


topk_metrics("metrics", "judged", 10)
