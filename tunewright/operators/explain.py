"""Final lists and the data around explanation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.functions import fixed, scalars

# The request, from intent, history, number of songs and the songs as JSON. Only the form of the answer must stay.
REQUEST = """A listener searched for: "%s"
What the log says about this listener: %s

From the catalog these %s songs were chosen, best first:
%s

Write one plain sentence per song, at most twenty words, on how it answers the search. Take every fact from the list.

The answer is JSON and nothing else:
{"explanations": [{"song_id": "...", "explanation": "..."}]}"""

_RESPONSE = "struct<explanations: array<string>>"
_ITEM = "struct<song_id: string, explanation: string>"


def final_topk(ranked: DataFrame, k: int = fixed.FINAL_ROWS) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def ranked_join_meta(ranked: DataFrame, meta: DataFrame) -> DataFrame:
    """Ranked rows with title and artist, ``Unknown`` where the catalog has none."""
    return ranked.join(meta.select("song_id", "title", "artist"), "song_id", "left").withColumns({
        "title": F.coalesce("title", F.lit("Unknown")),
        "artist": F.coalesce("artist", F.lit("Unknown")),
    })


def explanation_prompt(listed: DataFrame, requests: DataFrame, k: int = fixed.FINAL_ROWS) -> DataFrame:
    """``user_id, prompt``: the request, the history and the top k songs as JSON.

    ``listed`` has ``user_id, rank, song_id, title, artist, score``;
    ``requests`` has ``user_id, intent, summary``.
    """
    song = F.struct(
        "rank", F.col("song_id").cast("string").alias("song_id"), "title", "artist",
        scalars.round_half_even("score", 4).alias("ml_score"))
    songs = final_topk(listed, k).groupBy("user_id").agg(
        F.to_json(F.array_sort(F.collect_list(song))).alias("songs"))
    text = F.format_string(REQUEST, "intent", "summary", F.lit(str(k)), "songs")
    return songs.join(requests, "user_id").select("user_id", text.alias("prompt"))


def parse_explanations(responses: DataFrame, key: str = "user_id", response: str = "response") -> DataFrame:
    """``key, song_id, explanation`` from JSON answers.

    Entries without a ``song_id`` are ignored, the last of equal ids counts,
    an unreadable answer gives no rows.
    """
    items = responses.select(key, F.from_json(response, _RESPONSE)["explanations"].alias("items"))
    each = items.select(key, F.posexplode("items").alias("pos", "item")).select(
        key, "pos", F.from_json("item", _ITEM).alias("item")).where(F.col("item.song_id").isNotNull())
    return each.groupBy(key, F.col("item.song_id").alias("song_id")).agg(
        F.max_by(F.coalesce("item.explanation", F.lit("")), "pos").alias("explanation"))


def explanation_gate(intent: Column | str, searched: Column | str) -> Column:
    """Explanations are asked for only when a non-blank intent was answered by text search."""
    text = scalars.strip(F.coalesce(scalars.col(intent), F.lit("")))
    return (text != "") & F.coalesce(scalars.col(searched), F.lit(False))


def ranked_join_explanations(ranked: DataFrame, explanations: DataFrame | None) -> DataFrame:
    """Adds ``explanation``, empty where there is none."""
    if explanations is None:
        return ranked.withColumn("explanation", F.lit(""))
    texts = explanations.select("user_id", F.col("song_id").alias("_song"), "explanation")
    keyed = ranked.withColumn("_song", F.col("song_id").cast("string"))
    return keyed.join(texts, ["user_id", "_song"], "left").select(
        *ranked.columns, F.coalesce("explanation", F.lit("")).alias("explanation"))
