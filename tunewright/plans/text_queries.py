"""Queries over the text index, search, histories and explanation data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunewright import session
from tunewright.operators import explain, history, text
from tunewright.plans import jobs
from tunewright.plans.catalog_queries import users
from tunewright.plans.oracle import MANY_LIKES, check
from tunewright.plans.register import query
from tunewright.plans.vector_queries import brands, rank
from tunewright.sources import bindings as b
from tunewright.sources import catalog


def doc_vocab(spark, sf):
    return session.settle(text.vocabulary(b.documents(spark, sf)), "vocabulary")


@query("tokenize", check("""
  SELECT song_id, pos, t[pos] AS token FROM (
    SELECT id AS song_id, t, unnest(range(1, len(t) + 1)) AS pos FROM doc_tokens)""", "doc_tokens"))
def tokenize(spark, sf):
    tokens = b.documents(spark, sf).select("song_id", text.tokenize("text").alias("t"))
    return tokens.select("song_id", F.posexplode("t").alias("pos", "token")).withColumn("pos", F.col("pos") + 1)


@query("ngrams_1_2", check("""
  SELECT id AS song_id, len(t) AS n_tokens, CASE WHEN len(t) > 1 THEN len(t) - 1 ELSE 0 END AS n_pairs,
    CASE WHEN len(t) > 1 THEN t[len(t) - 1] || ' ' || t[len(t)] ELSE t[1] END AS last FROM doc_tokens""", "doc_tokens"))
def ngrams_1_2(spark, sf):
    rows = b.documents(spark, sf).select("song_id", text.tokenize("text").alias("t"))
    grams = rows.select("song_id", F.size("t").alias("n_tokens"), text.ngrams_1_2("t").alias("g"))
    return grams.select("song_id", "n_tokens", (F.size("g") - F.col("n_tokens")).alias("n_pairs"),
                        F.try_element_at("g", F.lit(-1)).alias("last"))


@query("term_counts", check("SELECT id AS song_id, term, tf FROM doc_tf", "doc_tf"))
def term_counts(spark, sf):
    return text.term_counts(b.documents(spark, sf))


@query("vocab_stats", check("SELECT term, cf, df FROM doc_vocab", "doc_vocab"))
def vocab_stats(spark, sf):
    return text.most_frequent(text.term_stats(b.documents(spark, sf), max_terms=text.fixed.MAX_TERMS))


@query("idf", check("SELECT term, idf FROM doc_vocab", "doc_vocab"), doubles=("idf",))
def idf(spark, sf):
    return text.vocabulary(b.documents(spark, sf)).select("term", "idf")


@query("tfidf_weights", check("SELECT id AS song_id, term, weight FROM doc_w", "doc_w"), doubles=("weight",))
def tfidf_weights(spark, sf):
    vocab = doc_vocab(spark, sf)
    counts = text.term_counts(b.documents(spark, sf), vocab=vocab)
    return text.tfidf_weights(counts, vocab).select("song_id", "term", "weight")


@query("l2_norm", check("""
  SELECT id AS song_id, sqrt(sum(raw * raw)) AS length FROM (
    SELECT id, (1.0::DOUBLE + ln(tf)) * idf AS raw FROM doc_tf JOIN doc_vocab USING (term)) GROUP BY id""", "doc_tf", "doc_vocab"),
       doubles=("length",))
def l2_norm(spark, sf):
    counts = text.term_counts(b.documents(spark, sf))
    # The vocabulary holds at most 30,000 rows: the broadcast is bounded.
    raw = counts.join(F.broadcast(doc_vocab(spark, sf).select("term", "idf")), "term").withColumn(
        "raw", (F.lit(1.0) + F.log("tf")) * F.col("idf"))
    return raw.groupBy("song_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))


@query("query_vector", check("SELECT id AS query_id, term, weight FROM doc_q_w", "doc_q_w"), doubles=("weight",))
def query_vector(spark, sf):
    vocab = doc_vocab(spark, sf)
    asked = text.query_vectors(b.intents(spark, sf), vocab)
    return text.postings(asked, vocab, "query_id").select("query_id", "term", "weight")


@query("build_text_index", check("SELECT id AS song_id, term, weight FROM song_w", "song_w"), doubles=("weight",))
def build_text_index(spark, sf):
    index = jobs.build_text_index(b.songs(spark, sf), session.shared_path(spark, "text-index"))
    return index["postings"].select("song_id", "term", "weight")


_POOLED = """(SELECT d.id AS song_id, d.term, d.weight * q.asked AS contribution
  FROM doc_w d JOIN (SELECT term, sum(weight) AS asked FROM doc_q_w GROUP BY term) q USING (term))"""


def _contributions(spark, sf):
    docs, vocab = b.documents(spark, sf), doc_vocab(spark, sf)
    index = text.tfidf_weights(text.term_counts(docs, vocab=vocab), vocab)
    return text.query_join_postings(text.pooled_query(b.intents(spark, sf), vocab), index)


@query("query_join_postings", check(f"SELECT song_id, term, contribution FROM {_POOLED}", "doc_w", "doc_q_w"),
       doubles=("contribution",))
def query_join_postings(spark, sf):
    return _contributions(spark, sf)


@query("score_docs", check(f"SELECT song_id, sum(contribution) AS score FROM {_POOLED} GROUP BY song_id", "doc_w", "doc_q_w"),
       doubles=("score",))
def score_docs(spark, sf):
    return text.score_docs(_contributions(spark, sf))


def _search(spark, sf, **options):
    docs, vocab = b.documents(spark, sf), doc_vocab(spark, sf)
    return text.text_search(b.intents(spark, sf), vocab, text.weighted_documents(docs, vocab), docs, **options)


@query("text_search", check("SELECT query_id, song_id, score, pos FROM doc_hits", "doc_hits"), doubles=("score",))
def text_search(spark, sf):
    return _search(spark, sf)


# The published number of hits for every intent, from small shards.
@query("text_search_topk", check("SELECT query_id, song_id, score, pos FROM doc_hits", "doc_hits"), doubles=("score",))
def text_search_topk(spark, sf):
    return _search(spark, sf, item_rows=256)


@query("text_search_cost")
def text_search_cost(spark, sf):
    """What a search over the written index meets and reads, per query."""
    docs = b.documents(spark, sf)
    index = text.build_text_index(docs)
    return text.search_cost(b.intents(spark, sf), index, docs)


# ---- history

@query("history_join_genre", check("""
  SELECT log_ord, coalesce(genre, 'unknown') AS genre FROM log LEFT JOIN (SELECT song_id // 40 AS song_id, genre FROM songs
    WHERE song_id % 40 = 0) USING (song_id)""", "log", "songs"))
def history_join_genre(spark, sf):
    rows = b.interactions(spark, sf).withColumn("song_id", F.col("song_id") * 40)
    return history.history_join_genre(rows, catalog.catalog_genre_map(b.songs(spark, sf))).select("log_ord", "genre")


@query("history_counts", check("SELECT user_id, likes, skips FROM history", "history"))
def history_counts(spark, sf):
    return history.history_counts(b.interactions(spark, sf))


@query("liked_genre_counts", check("""
  SELECT user_id, genre, count(*) AS likes, min(log_ord) AS first_ord FROM liked JOIN genres_by_song USING (song_id) GROUP BY ALL""",
    "liked", "genres_by_song"))
def liked_genre_counts(spark, sf):
    return history.liked_genre_counts(b.interactions(spark, sf), catalog.catalog_genre_map(b.songs(spark, sf)))


@query("history_summary", check("""
  SELECT user_id, coalesce(summary, 'No listening history yet.') AS summary FROM users LEFT JOIN history USING (user_id)""",
    "users", "history"))
def history_summary(spark, sf):
    return history.history_summary(b.interactions(spark, sf), catalog.catalog_genre_map(b.songs(spark, sf)), users(spark, sf))


# ---- explanations

def user_intents(spark, sf):
    text_ = F.concat_ws(" ", F.col("favorite_artists")[0], F.col("favorite_genres")[0], F.lit("high energy"))
    return b.answers(spark, sf).select(
        "user_id", F.when(F.col("user_id") % 3 == 0, text_).otherwise("").alias("intent"))


def responses(spark, sf):
    """Answers of the explanation service, made from whole conversation turns; every fifth one is cut off."""
    turns = b.table(spark, sf, "conversations").where("role = 'assistant'")
    item = lambda song, words: F.struct(
        song.cast("string").alias("song_id"), words.alias("explanation"))
    good = F.to_json(F.struct(F.array(
        item(F.col("conv_id"), F.col("text")), item(F.col("turn"), F.concat(F.lit("In turn: "), "text")),
        item(F.col("conv_id"), F.concat("text", F.lit(" (again)")))).alias("explanations")))
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("user_id"),
        F.when(F.col("conv_id") % 5 == 0, F.left(good, F.lit(30))).otherwise(good).alias("response"))


@query("parse_explanations", """
  WITH turns AS (SELECT * FROM conversations WHERE role = 'assistant' AND conv_id % 5 <> 0),
  items AS (SELECT conv_id || '-' || turn AS user_id, CAST(conv_id AS VARCHAR) AS song_id, text || ' (again)' AS explanation FROM turns
    UNION ALL SELECT conv_id || '-' || turn, CAST(turn AS VARCHAR), 'In turn: ' || text FROM turns WHERE turn <> conv_id)
  SELECT * FROM items""")
def parse_explanations(spark, sf):
    return explain.parse_explanations(responses(spark, sf))


@query("explanation_gate", check("SELECT user_id, intent <> '' AS allowed FROM user_intents", "user_intents"))
def explanation_gate(spark, sf):
    return user_intents(spark, sf).select("user_id", explain.explanation_gate("intent", F.lit(True)).alias("allowed"))


@query("ranked_join_explanations", check("""
  SELECT user_id, song_id, rank, CASE WHEN rank % 2 = 0 THEN '' ELSE 'Pick ' || song_id END AS explanation
  FROM pool_ranked WHERE rank <= 10""", "pool_ranked"))
def ranked_join_explanations(spark, sf):
    # Read twice: once for the texts, once for the lists that get them.
    top = session.settle(explain.final_topk(rank(spark, sf)).select("user_id", "song_id", "rank"), "listed")
    texts = top.where(F.col("rank") % 2 == 1).select(
        "user_id", F.col("song_id").cast("string").alias("song_id"),
        F.concat(F.lit("Pick "), F.col("song_id").cast("string")).alias("explanation"))
    return explain.ranked_join_explanations(top, texts).select("user_id", "song_id", "rank", "explanation")


def _index(spark, sf):
    return jobs.build_text_index(b.songs(spark, sf), session.shared_path(spark, "text-index"))


def _recommend(spark, sf, index, **more):
    return jobs.recommend(b.songs(spark, sf), users(spark, sf), b.as_of(), b.interactions(spark, sf),
                          b.song_vectors(spark, sf), user_intents(spark, sf), index, **more)


_FINAL = """SELECT user_id, rank, song_id, title, first_artist AS artist, score, '' AS explanation
  FROM mixed_ranked JOIN songs USING (song_id) WHERE rank <= 10"""


@query("recommend", check(_FINAL, "mixed_ranked", "songs"), doubles=("score",))
def recommend(spark, sf):
    return _recommend(spark, sf, _index(spark, sf))


# Users whose number ends in 0 or 3 get an answer that explains their first two songs; the gate lets only searched ones through.
@query("recommend_with_answers", check("""
  SELECT user_id, rank, song_id, title, first_artist AS artist, score,
    CASE WHEN intent <> '' AND user_id % 10 IN (0, 3) AND rank <= 2 THEN 'Because of ' || title ELSE '' END AS explanation
  FROM mixed_ranked JOIN songs USING (song_id) JOIN user_intents USING (user_id) WHERE rank <= 10""",
    "mixed_ranked", "songs", "user_intents"), doubles=("score",))
def recommend_with_answers(spark, sf):
    index = _index(spark, sf)
    listed = session.settle(_recommend(spark, sf, index), "listed")
    item = F.struct(F.col("song_id").cast("string").alias("song_id"),
                    F.concat(F.lit("Because of "), "title").alias("explanation"))
    answers = listed.where((F.col("user_id") % 10).isin(0, 3) & (F.col("rank") <= 2)).groupBy("user_id").agg(
        F.to_json(F.struct(F.collect_list(item).alias("explanations"))).alias("response"))
    return _recommend(spark, sf, index, responses=answers)


# Artist vectors of every user with a like: they choose candidates, enter the features and are blended into few likes.
@query("recommend_with_artist_vectors", check("""
  SELECT user_id, rank, song_id, title, first_artist AS artist, score, '' AS explanation
  FROM blend_mixed_ranked JOIN songs USING (song_id) WHERE rank <= 10""", "blend_mixed_ranked", "songs"), doubles=("score",))
def recommend_with_artist_vectors(spark, sf):
    by_brand, wanted = brands(spark, sf)
    return _recommend(spark, sf, _index(spark, sf), artist_vectors=by_brand, user_artist_vectors=wanted,
                      blend_below=MANY_LIKES)


@query("recommend_without_hits", check("""
  SELECT user_id, rank, song_id, title, first_artist AS artist, score, '' AS explanation
  FROM pool_ranked JOIN songs USING (song_id) WHERE rank <= 10""", "pool_ranked", "songs"), doubles=("score",))
def recommend_without_hits(spark, sf):
    """An index without documents finds nothing: all users are answered by the candidate pool, without explanations."""
    empty = {name: table.limit(0) for name, table in _index(spark, sf).items()}
    answers = user_intents(spark, sf).select("user_id", F.lit('{"explanations": [{"song_id": "1"}]}').alias("response"))
    return _recommend(spark, sf, empty, responses=answers)


@query("explanation_prompt", check("""
  SELECT user_id, 'A listener searched for: "' || intent || '"' || chr(10)
    || 'What the log says about this listener: ' || coalesce(summary, 'No listening history yet.') || chr(10) || chr(10)
    || 'From the catalog these 10 songs were chosen, best first:' || chr(10) || chr(10) || chr(10)
    || 'Write one plain sentence per song, at most twenty words, on how it answers the search. '
    || 'Take every fact from the list.' || chr(10) || chr(10)
    || 'The answer is JSON and nothing else:' || chr(10)
    || '{"explanations": [{"song_id": "...", "explanation": "..."}]}' AS head, songs
  FROM (SELECT user_id, list({'rank': rank, 'song_id': CAST(song_id AS VARCHAR), 'title': title, 'artist': first_artist,
      'ml_score': CAST(printf('%.4f', score) AS DOUBLE)} ORDER BY rank)::JSON::VARCHAR AS songs
    FROM mixed_ranked JOIN songs USING (song_id) WHERE rank <= 10 GROUP BY user_id)
  JOIN user_intents USING (user_id) LEFT JOIN history USING (user_id) WHERE intent <> ''""",
    "mixed_ranked", "songs", "user_intents", "history"))
def explanation_prompt(spark, sf):
    """The request split back into its JSON list and the rest of the text."""
    index = _index(spark, sf)
    prompts = jobs.request_prompts(_recommend(spark, sf, index), b.interactions(spark, sf), b.songs(spark, sf),
                                   users(spark, sf), user_intents(spark, sf), index)
    listed = F.regexp_extract("prompt", r"(?m)^(\[\{.*\}\])$", 1)
    return prompts.select("user_id", F.replace("prompt", listed, F.lit("")).alias("head"), listed.alias("songs"))
