"""Artist lists and song lookup for the survey."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunewright import session
from tunewright.functions import fixed, ordering, scalars


def top_artists(songs: DataFrame, limit: int = fixed.TOP_ARTISTS) -> DataFrame:
    """The ``limit`` artists with the highest peak popularity, listed alphabetically.

    Equal peaks are cut by name.
    """
    credits = songs.select(F.explode("artists").alias("artist"), "popularity").where(F.col("artist") != "")
    peaks = credits.groupBy("artist").agg(F.max("popularity").alias("peak_popularity"))
    return peaks.orderBy(F.desc("peak_popularity"), "artist").limit(limit).orderBy("artist")


def distinct_artist_ids(songs: DataFrame) -> DataFrame:
    """Non-blank artist ids, once each; sorted by whoever lists them."""
    ids = songs.select("artist_id").where(scalars.strip(F.col("artist_id").cast("string")) != "").distinct()
    return ids.orderBy("artist_id")


def song_search(songs: DataFrame, query: str, selected: DataFrame | None = None,
                limit: int = fixed.SONG_MATCHES) -> DataFrame:
    """Songs whose title or artist holds the text, in catalog order; a blank query finds none."""
    text = F.lit(query.lower())
    hit = F.lower("title").contains(text) | F.lower("artist_name").contains(text)
    found = songs.where(hit & F.lit(bool(query.strip())))
    if selected is not None:
        found = found.join(selected.select("song_id"), "song_id", "left_anti")
    return found.orderBy("song_ord").limit(limit).select("song_id", "title", "artist_name", "genre", "song_ord")


#: Characters of a gram, and the postings of a gram that a text meets in its first round.
GRAM = 3
FIRST_RUN = 4_096


def _grams(text: str | Column, size: int) -> Column:
    """All pieces of ``size`` characters, also overlapping ones, by one pass of a look-ahead."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _searchable(songs: DataFrame) -> DataFrame:
    return songs.select(
        "song_id", "song_ord", F.lower(F.coalesce("title", F.lit(""))).alias("low_title"),
        F.lower(F.coalesce("artist_name", F.lit(""))).alias("low_names"))


def song_grams(songs: DataFrame) -> DataFrame:
    """``gram, song_id, song_ord``: every piece of one to three characters of title and artists, once per song."""
    both = F.concat_ws("\0", "low_title", "low_names")
    pieces = F.array_distinct(F.concat(*[_grams(both, size) for size in range(1, GRAM + 1)]))
    return _searchable(songs).select(F.explode(pieces).alias("gram"), "song_id", "song_ord")


def rarest_grams(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """``text, gram, n_songs``: per distinct text the gram that the fewest songs hold.

    Texts of up to three characters are a gram themselves. A text with a gram that no song holds finds nothing and is left out.
    """
    asked = texts.select("text").distinct().select(
        "text", F.explode(F.array_distinct(
            F.when(F.length("text") <= GRAM, F.array("text")).otherwise(_grams("text", GRAM)))).alias("gram"))
    held = grams.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(
        F.count(F.lit(1)).alias("n_songs"))
    # Ties go to the smaller gram: the smallest pair of count and gram.
    return asked.join(held, "gram", "left").groupBy("text").agg(
        F.min(F.struct(F.coalesce("n_songs", F.lit(0)).alias("n_songs"), F.col("gram"))).alias("best")).where(
        "best.n_songs > 0").select("text", "best.gram", "best.n_songs")


def gram_postings(grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram, song_id, place``: songs of the wanted grams, numbered per gram from 1 in catalog order.

    A gram held by a third of all songs is numbered in ranges of the catalog, never in one task.
    """
    rows = session.settle(grams.join(wanted.select("gram").distinct(), "gram", "left_semi"), "gram-songs")
    bucket = ordering.bucket_of(F.col("song_ord"), ordering.cut_points(rows, F.col("song_ord")))
    return ordering.rank_in_buckets(rows, ["gram"], bucket, [F.col("song_ord"), F.col("song_id")], "place").select(
        "gram", "song_id", "place")


def song_search_many(songs: DataFrame, queries: DataFrame, selected: DataFrame | None = None,
                     limit: int = fixed.SONG_MATCHES, first_run: int = FIRST_RUN) -> DataFrame:
    """``song_search`` for many queries: ``query_id, song_id, title, pos``.

    Each distinct text looks only at the songs that hold its rarest three characters, in catalog order and in runs that
    grow fourfold; a query that has its ``limit`` songs reads no further run. ``selected(query_id, song_id)`` are left
    out per query. Null and blank texts find nothing.
    """
    asked = session.settle(
        queries.select("query_id", F.lower("text").alias("text")).where(scalars.strip("text") != ""), "searches")
    grams = song_grams(songs)
    rarest = session.settle(rarest_grams(asked, grams), "rarest-grams")
    postings = session.settle(gram_postings(grams, rarest), "gram-postings")
    offered = _searchable(songs)
    order = Window.partitionBy("query_id").orderBy("song_ord", "song_id")
    waiting = asked.join(rarest, "text").withColumn("need", F.lit(limit).cast("long"))
    if selected is None:
        waiting = waiting.withColumn("n_selected", F.lit(0).cast("long"))
    else:
        chosen = selected.select("query_id", "song_id").distinct()
        sizes = chosen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_selected"))
        waiting = waiting.join(sizes, "query_id", "left").withColumn("n_selected", F.coalesce("n_selected", F.lit(0)))
    waiting = session.settle(waiting, "searches")
    last, most = waiting.agg(F.max("n_songs"), F.max("n_selected")).first()
    last, most = last or 0, most or 0
    runs, start, end = [], 0, first_run
    while True:
        texts = waiting.select("text", "gram").distinct()
        run = postings.where((F.col("place") > start) & (F.col("place") <= end))
        hit = F.col("low_title").contains(F.col("text")) | F.col("low_names").contains(F.col("text"))
        hits = texts.join(run, "gram").join(offered, "song_id").where(hit).select("text", "song_id", "song_ord")
        # A query uses at most the songs it needs and as many as are left out for it.
        best = Window.partitionBy("text").orderBy("song_ord", "song_id")
        hits = hits.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= limit + most)
        found = waiting.join(hits, "text").where(F.col("nth") <= F.col("need") + F.col("n_selected"))
        if selected is not None:
            found = found.join(chosen, ["query_id", "song_id"], "left_anti")
        found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.col("need")).withColumn(
            "pos", F.lit(limit) - F.col("need") + F.col("nth"))
        runs.append(session.settle(found.select("query_id", "song_id", F.col("pos").cast("int").alias("pos")), "search-hits"))
        if end >= last:
            break
        more = runs[-1].groupBy("query_id").agg(F.count(F.lit(1)).alias("more"))
        waiting = session.settle(
            waiting.where(F.col("n_songs") > end).join(more, "query_id", "left")
            .withColumn("need", F.col("need") - F.coalesce("more", F.lit(0))).drop("more").where(F.col("need") > 0),
            "searches")
        if waiting.isEmpty():
            break
        start, end = end, 4 * end
    done = reduce(DataFrame.unionByName, runs)
    return done.join(songs.select("song_id", "title"), "song_id").select("query_id", "song_id", "title", "pos")
