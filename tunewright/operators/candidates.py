"""Candidate pools: fresh songs, artist matches, ordered union."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunewright import session
from tunewright.functions import fixed
from tunewright.operators import similarity

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SECOND_LIST = 1 << 60
#: (user, artist) rows per block of users, on average.
ASKED_ROWS = 16_384


def _days(count: int) -> Column:
    return F.make_dt_interval(F.lit(count))


def window_counts(songs: DataFrame, as_of: Column, windows: list[int] = fixed.FRESH_WINDOWS) -> DataFrame:
    """One row: how many songs were released within each window, in a single pass."""
    return songs.agg(*[
        F.count_if(F.col("released") >= as_of - _days(w)).alias(f"within_{w}") for w in windows
    ])


def fresh_songs(songs: DataFrame, as_of: Column, windows: list[int] = fixed.FRESH_WINDOWS,
                at_least: int = fixed.MIN_FRESH) -> DataFrame:
    """Songs of the first window that holds enough of them, else all songs.

    The counts are a scalar subquery, so the choice is made inside the job.
    """
    choice = None
    for w in windows:
        enough = F.col(f"within_{w}") >= at_least
        choice = F.when(enough, w) if choice is None else choice.when(enough, w)
    window = window_counts(songs, as_of, windows).select(choice.alias("days")).scalar()
    cutoff = as_of - F.make_dt_interval(window)
    return songs.where(window.isNull() | (F.col("released") >= cutoff))


def known_artists(users: DataFrame) -> DataFrame:
    """One row per user and favourite or recent artist."""
    names = F.array_union(
        F.coalesce("favorite_artists", F.array().cast("array<string>")),
        F.coalesce("recent_artists", F.array().cast("array<string>")))
    return users.select("user_id", F.explode(names).alias("artist"))


def _leading(songs: DataFrame, key: str, limit: int) -> DataFrame:
    first = Window.partitionBy(key).orderBy("song_ord")
    return songs.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit).drop("_n")


def dense_rank(values: pa.Array) -> np.ndarray:
    """Place of each value among the distinct ones, from 0; a null is the smallest."""
    return pc.rank(values, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64) - 1


def merged(asked: pa.Table, lists: pa.Table, limit: int) -> tuple[pa.Array, pa.Array, pa.Array, np.ndarray]:
    """(user, song_id, song_ord, pos): per user the first songs in catalog order of all lists asked for, each song once."""
    users = asked.column("user_id").combine_chunks().dictionary_encode(null_encoding="encode")
    held = lists.column("songs").combine_chunks()
    songs = held.flatten()
    ords, ids = songs.field("song_ord"), songs.field("song_id")
    if not len(songs):
        return users.dictionary.slice(0, 0), ids, ords, np.zeros(0, dtype=np.int32)
    by_id = dense_rank(ids)
    entry, place = np.unique(dense_rank(ords) * (by_id.max() + 1) + by_id, return_index=True, return_inverse=True)[1:]
    at = pc.index_in(asked.column("artist"), value_set=lists.column("named").combine_chunks(), skip_nulls=True)
    known = at.combine_chunks().is_valid().to_numpy(zero_copy_only=False)
    at = at.drop_null().to_numpy()
    lengths = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    user = users.indices.to_numpy(zero_copy_only=False)[known].astype(np.int64)
    # Every asked list end to end, as places in the order of songs; one number orders users and songs.
    n = lengths[at]
    where = np.repeat(begins[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    key = np.sort(np.repeat(user, n) * len(entry) + place[where])
    # A sort and its steps: np.unique takes many times as long here.
    key = key[np.diff(key, prepend=-1) != 0]
    user, place = np.divmod(key, len(entry))
    begins = np.flatnonzero(np.diff(user, prepend=-1))
    pos = np.arange(len(user)) - np.repeat(begins, np.diff(np.append(begins, len(user)))) + 1
    kept = pos <= limit
    taken = pa.array(entry[place[kept]])
    return users.dictionary.take(pa.array(user[kept])), ids.take(taken), ords.take(taken), pos[kept].astype(np.int32)


def _leading_per_user(asked: DataFrame, offered: DataFrame, limit: int, packed: bool = False) -> DataFrame:
    """First ``limit`` distinct songs per user in catalog order, numbered ``pos``, or one list ``songs`` per user.

    ``asked`` has ``user_id, artist``, ``offered`` each artist's leading songs. Users are hashed into blocks of bounded
    size; an artist's songs go once, as one list, to each block that asks for them, so no row per user and offered song
    is made but those that are kept.
    """
    asked = session.settle(asked, "asked-artists")
    parallel = asked.sparkSession.sparkContext.defaultParallelism
    # Counting a written table reads file footers only.
    blocks = max(parallel, -(-asked.count() // ASKED_ROWS))
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int"))
    lists = offered.groupBy(F.col("artist").alias("named")).agg(F.collect_list(F.struct("song_ord", "song_id")).alias("songs"))
    wanted = asked.select(F.col("_block").alias("_to"), F.col("artist").alias("named")).distinct().join(lists, "named")

    def first(some: pa.Table, theirs: pa.Table) -> pa.Table:
        user, song, ords, pos = merged(some, theirs, limit)
        if packed:
            at = np.flatnonzero(pos == 1)
            return pa.table({"user_id": user.take(pa.array(at)),
                             "songs": pa.ListArray.from_arrays(pa.array(np.append(at, len(pos)), pa.int32()), song)})
        return pa.table({"user_id": user, "song_id": song, "song_ord": ords, "pos": pa.array(pos)})

    if packed:
        kinds = [asked.schema["user_id"], T.StructField("songs", T.ArrayType(offered.schema["song_id"].dataType))]
        return asked.groupBy("_block").cogroup(wanted.groupBy("_to")).applyInArrow(first, T.StructType(kinds))
    kinds = [asked.schema["user_id"], offered.schema["song_id"], offered.schema["song_ord"]]
    schema = T.StructType([*[T.StructField(k.name, k.dataType) for k in kinds], T.StructField("pos", T.IntegerType())])
    return asked.groupBy("_block").cogroup(wanted.groupBy("_to")).applyInArrow(first, schema)


def similar_artist_songs(songs: DataFrame, top_artists: DataFrame,
                         limit: int = fixed.POOL_SIZE, packed: bool = False) -> DataFrame:
    """Songs by each user's nearest artists, the first ``limit`` in catalog order.

    A user's first ``limit`` songs can only come from the first ``limit`` songs
    of each artist, so artists are cut before the join.
    """
    offered = _leading(songs.select(F.col("artist_id").alias("artist"), "song_id", "song_ord"), "artist", limit)
    return _leading_per_user(top_artists.select("user_id", F.col("artist_id").alias("artist")), offered, limit, packed)


def known_artist_songs(songs: DataFrame, users: DataFrame, limit: int = fixed.POOL_SIZE, packed: bool = False) -> DataFrame:
    """Songs any of whose artists the user knows, the first ``limit`` in catalog order."""
    credits = songs.select(F.explode("artists").alias("artist"), "song_id", "song_ord")
    return _leading_per_user(known_artists(users), _leading(credits, "artist", limit), limit, packed)


def listed(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """``user_id, songs``: each user's bounded rows ``song_id, pos`` as one list in their order."""
    held = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), "song_id")))
    return rows.groupBy("user_id").agg(held["song_id"].alias("songs"))


def _union_of_lists(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    none = F.lit(None).cast(second.schema["songs"].dataType)
    both = first.select("user_id", F.col("songs").cast(second.schema["songs"].dataType).alias("first"), none.alias("second")).unionByName(
        second.select("user_id", none.alias("first"), F.col("songs").alias("second")))
    held = both.groupBy("user_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("first", "second")])
    songs = F.concat(*[F.coalesce(c, F.array().cast(second.schema["songs"].dataType)) for c in ("first", "second")])
    return held.select("user_id", F.slice(F.array_distinct(songs), 1, limit).alias("songs"))


def ordered_union(first: DataFrame, second: DataFrame, limit: int = fixed.POOL_SIZE) -> DataFrame:
    """``user_id, song_id, cand_pos``: the first list, then new songs of the second, cut at ``limit``.

    Both lists carry ``pos``. One exchange by user serves the de-duplication and
    the numbering; a user has at most the two list lengths. Lists that are packed
    already, ``user_id, songs`` with one row per user, stay so: ``user_id, songs``.
    """
    if "songs" in first.columns:
        return _union_of_lists(first, second, limit)
    pos = F.col("pos").cast("long")
    # One number orders both lists, which keeps the de-duplication a hash aggregate.
    both = (
        first.select("user_id", "song_id", pos.alias("place"))
        .unionByName(second.select("user_id", "song_id", (pos + F.lit(_SECOND_LIST)).alias("place")))
        .repartition("user_id")
    )
    placed = both.groupBy("user_id", "song_id").agg(F.min("place").alias("place"))
    order = Window.partitionBy("user_id").orderBy("place")
    numbered = placed.withColumn("cand_pos", F.row_number().over(order))
    return numbered.where(F.col("cand_pos") <= limit).select("user_id", "song_id", "cand_pos")


def unrated_only(candidates: DataFrame, interactions: DataFrame) -> DataFrame:
    """Candidates the user has neither liked nor skipped (off by default in the jobs)."""
    rated = interactions.select("user_id", "song_id").distinct()
    return candidates.join(rated, ["user_id", "song_id"], "left_anti")


def candidate_pool(songs: DataFrame, users: DataFrame, as_of: Column,
                   user_vectors: DataFrame | None = None, song_vectors: DataFrame | None = None,
                   user_artist_vectors: DataFrame | None = None, artist_vectors: DataFrame | None = None,
                   pool_size: int = fixed.POOL_SIZE, packed: bool = False) -> DataFrame:
    """At most 200 fresh songs per user: nearest songs first, then artist matches.

    Users with an artist vector get songs of their nearest artists, all others
    songs of the artists they named. Absent vectors leave that part out.
    ``user_id, song_id, cand_pos``, or with ``packed`` one list ``songs`` per user.
    """
    def pool(lists: DataFrame) -> DataFrame:
        if packed:
            return lists
        return lists.select("user_id", F.posexplode("songs").alias("cand_pos", "song_id")).select(
            "user_id", "song_id", (F.col("cand_pos") + 1).alias("cand_pos"))

    pool_size = min(pool_size, fixed.POOL_SIZE)
    fresh = fresh_songs(songs, as_of)
    by_artist = users
    parts = []
    if user_artist_vectors is not None and artist_vectors is not None:
        asked = user_artist_vectors.join(users.select("user_id"), "user_id", "left_semi")
        near = similarity.similar_artists_topk(asked, artist_vectors, fixed.SIMILAR_ARTISTS)
        parts.append(similar_artist_songs(fresh, near, pool_size, packed=True))
        by_artist = users.join(user_artist_vectors, "user_id", "left_anti")
    parts.append(known_artist_songs(fresh, by_artist, pool_size, packed=True))
    artist_part = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if user_vectors is None or song_vectors is None:
        return pool(ordered_union(artist_part.limit(0), artist_part, pool_size))
    k = max(fixed.MIN_FRESH, pool_size // 2)
    offered = fresh.select("song_id", "song_ord").join(song_vectors.select("song_id", "embedding"), "song_id")
    asked = user_vectors.join(users.select("user_id"), "user_id", "left_semi")
    near = listed(similarity.similar_songs_topk(asked, offered, k), "rank")
    return pool(ordered_union(near, artist_part, pool_size))
