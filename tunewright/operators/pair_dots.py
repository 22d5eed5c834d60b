"""Dot products of given (user, song) pairs; vectors travel beside blocks of pairs, never beside a pair.

Users and songs are hashed into blocks of bounded size. Pairs are grouped by (user block, song block), a user's vectors
are sent to each song block and a song's to each user block once, and one task scores the pairs of two blocks. Columns of
the songs travel the same way, so the pairs are exchanged once and never sorted by song.

Bounded lists of songs, one per user, need no song blocks: a block of users gets each song that its lists name once.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunewright import session
from tunewright.operators import similarity

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Users and songs per block at most, and pairs multiplied at a time.
USER_ROWS, SONG_ROWS, PAIR_ROWS = 32_768, 32_768, 4_096
#: The role of a song's columns.
BESIDE = "beside"
#: Users with a list per block, on average.
LIST_ROWS = 4_096


def matrix(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, and which of them have the width; the others are zero."""
    known = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width
    out = np.zeros((len(values), width))
    out[known] = values.filter(pa.array(known)).flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), width)
    return out, known


def pair_dots(pairs: DataFrame, by_user: dict[str, DataFrame], by_song: dict[str, DataFrame],
              wanted: dict[str, tuple[str, str]], user_rows: int | None = None, song_rows: int | None = None,
              beside: DataFrame | None = None) -> DataFrame:
    """``pairs`` with one more column per entry of ``wanted``: the dot product of a vector of the user and one of the song.

    ``by_user`` has tables ``user_id, vector`` by role, ``by_song`` tables ``song_id, vector``; ids are unique in each.
    The product is null where a vector is missing, holds a null, or has another length than the song's side.
    ``beside`` has one row per ``song_id`` and further columns: they are added to the pairs, and pairs without it drop out.
    """
    spark = pairs.sparkSession

    def gathered(tables: dict[str, DataFrame], key: str) -> DataFrame:
        whole = F.when(~F.exists("vector", F.isnull), F.col("vector").cast("array<double>"))
        parts = [t.select(F.lit(role).alias("role"), F.col(key), whole.alias("vector")) for role, t in tables.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return session.settle(out, "pair-vectors")

    users, songs = gathered(by_user, "user_id"), gathered(by_song, "song_id")
    user_blocks, song_blocks = similarity.block_plan(
        users.count() // len(by_user), songs.count() // len(by_song), spark.sparkContext.defaultParallelism,
        user_rows or USER_ROWS, song_rows or SONG_ROWS)

    def block(key: str, blocks: int):
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = pairs.select(block("user_id", user_blocks).alias("_ub"), block("song_id", song_blocks).alias("_sb"), *[F.col(c) for c in pairs.columns])
    user_kind, song_kind = pairs.schema["user_id"].dataType, pairs.schema["song_id"].dataType
    sent = users.select(block("user_id", user_blocks).alias("ub"), every(song_blocks).alias("sb"), "role",
                        F.col("user_id").cast(user_kind).alias("of_user"), F.lit(None).cast(song_kind).alias("of_song"), "vector")
    sent = sent.unionByName(songs.select(
        every(user_blocks).alias("ub"), block("song_id", song_blocks).alias("sb"), "role",
        F.lit(None).cast(user_kind).alias("of_user"), F.col("song_id").cast(song_kind).alias("of_song"), "vector"))
    names, added = pairs.columns, []
    if beside is not None:
        added = [f for f in beside.schema.fields if f.name != "song_id"]
        sent = sent.unionByName(beside.select(
            every(user_blocks).alias("ub"), block("song_id", song_blocks).alias("sb"), F.lit(BESIDE).alias("role"),
            F.col("song_id").cast(song_kind).alias("of_song"), F.struct(*[f.name for f in added]).alias("columns")),
            allowMissingColumns=True)

    def score(some: pa.Table, vectors: pa.Table) -> pa.Table:
        some = some.select(names)
        held = {}
        if added:
            table = vectors.filter(pc.equal(vectors.column("role"), BESIDE)).combine_chunks()
            at = pc.index_in(some.column("song_id"), value_set=table.column("of_song").combine_chunks(), skip_nulls=True)
            known = at.is_valid()
            some, at = some.filter(known), at.filter(known).combine_chunks()
            columns = table.column("columns").combine_chunks()
            for f in added:
                some = some.append_column(f.name, columns.field(f.name).take(at))
        for name, (user_role, song_role) in wanted.items():
            ids = {}
            for role, key, column in ((user_role, "user_id", "of_user"), (song_role, "song_id", "of_song")):
                if role not in held:
                    table = vectors.filter(pc.equal(vectors.column("role"), role)).combine_chunks()
                    held[role] = table.column(column).combine_chunks(), table.column("vector").combine_chunks()
                at = pc.index_in(some.column(key), value_set=held[role][0], skip_nulls=True)
                ids[role] = at.combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
            lengths = held[song_role][1].value_lengths()
            width = pc.max(lengths).as_py() or 0
            (u, u_known), (s, s_known) = (matrix(held[role][1], width) for role in (user_role, song_role))
            at_u, at_s = ids[user_role], ids[song_role]
            both = (at_u >= 0) & (at_s >= 0)
            both[both] = u_known[at_u[both]] & s_known[at_s[both]]
            rows = np.flatnonzero(both)
            out = np.zeros(some.num_rows)
            for first in range(0, len(rows), PAIR_ROWS):
                run = rows[first:first + PAIR_ROWS]
                out[run] = np.einsum("ij,ij->i", u[at_u[run]], s[at_s[run]])
            some = some.append_column(name, pa.array(out, mask=~both))
        return some

    schema = T.StructType([*pairs.schema.fields, *[T.StructField(f.name, f.dataType) for f in added], *[T.StructField(name, T.DoubleType()) for name in wanted]])
    return left.groupBy("_ub", "_sb").cogroup(sent.groupBy("ub", "sb")).applyInArrow(score, schema)


def dots(u: np.ndarray, s: np.ndarray, at_u: np.ndarray, at_s: np.ndarray) -> np.ndarray:
    """Dot products of the rows that two lists of places name."""
    out = np.zeros(len(at_u))
    for first in range(0, len(at_u), PAIR_ROWS):
        run = slice(first, first + PAIR_ROWS)
        out[run] = np.einsum("ij,ij->i", u[at_u[run]], s[at_s[run]])
    return out


def earlier_alike(owner: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Per row the number of earlier rows of the same owner and kind."""
    key = owner * (int(kind.max(initial=0)) + 1) + kind
    order = np.argsort(key, kind="stable")
    begins = np.flatnonzero(np.diff(key[order], prepend=-1))
    out = np.empty(len(key))
    out[order] = np.arange(len(key)) - np.repeat(begins, np.diff(np.append(begins, len(key))))
    return out


def list_dots(lists: DataFrame, by_user: dict[str, DataFrame], by_song: dict[str, DataFrame], wanted: dict[str, tuple[str, str]],
              beside: DataFrame, alike: tuple[str, str], digits: int, list_rows: int | None = None) -> DataFrame:
    """``user_id`` and parallel arrays ``song_id, cand_pos``, those of ``beside`` and of ``wanted``, for lists ``user_id, songs``.

    As ``pair_dots``, with products rounded to ``digits`` and 0.0 for none. Songs without a row in ``beside`` leave their list,
    places in it are kept; a list without any other has no row. ``alike`` names a text column of ``beside``, which is not
    returned, and the column that counts earlier songs of the list with the same one (null as blank).
    """
    spark = lists.sparkSession
    lists = session.settle(lists.select("user_id", "songs"), "candidate-lists")
    # Counting a written table reads file footers only.
    blocks = max(spark.sparkContext.defaultParallelism, -(-lists.count() // (list_rows or LIST_ROWS)))
    user_kind, song_kind = lists.schema["user_id"].dataType, lists.schema["songs"].dataType.elementType

    def block(key: str = "user_id"):
        return F.pmod(F.xxhash64(F.col(key).cast(user_kind)), F.lit(blocks)).cast("int")

    def whole(name: str):
        return F.when(~F.exists("vector", F.isnull), F.col("vector").cast("array<double>")).alias(name)

    named = lists.select(block().alias("ub"), F.explode("songs").alias("of_song")).distinct()
    sent = named.join(beside.withColumnRenamed("song_id", "of_song"), "of_song")
    for role, table in by_song.items():
        sent = sent.join(table.select(F.col("song_id").alias("of_song"), whole(f"song_{role}")), "of_song", "left")
    sent = sent.withColumn("of_song", F.col("of_song").cast(song_kind))
    for role, table in by_user.items():
        sent = sent.unionByName(table.select(block().alias("ub"), F.col("user_id").cast(user_kind).alias("of_user"), whole(f"user_{role}")),
                                allowMissingColumns=True)
    if not by_user:
        sent = sent.withColumn("of_user", F.lit(None).cast(user_kind))
    kept = [f for f in beside.schema.fields if f.name not in ("song_id", alike[0])]

    def vectors_of(table: pa.Table, column: str, width: int) -> tuple[np.ndarray, np.ndarray]:
        return matrix(table.column(column).combine_chunks(), width)

    def score(some: pa.Table, held: pa.Table) -> pa.Table:
        songs = held.filter(pc.is_valid(held.column("of_song")))
        listed, users = some.column("songs").combine_chunks(), some.column("user_id").combine_chunks()
        lengths = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(len(users)), lengths)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        song = listed.flatten()
        at = pc.index_in(song, value_set=songs.column("of_song").combine_chunks(), skip_nulls=True)
        known = at.is_valid()
        mask = known.to_numpy(zero_copy_only=False)
        song, at, owner, place = song.filter(known), at.filter(known).to_numpy(zero_copy_only=False), owner[mask], place[mask]
        columns = {"song_id": song, "cand_pos": pa.array(place, pa.int32())}
        for f in kept:
            columns[f.name] = songs.column(f.name).combine_chunks().take(pa.array(at))
        for name, (user_role, song_role) in wanted.items():
            theirs = held.filter(pc.is_valid(held.column(f"user_{user_role}")))
            width = pc.max(songs.column(f"song_{song_role}").combine_chunks().value_lengths()).as_py() or 0
            (u, u_known), (s, s_known) = vectors_of(theirs, f"user_{user_role}", width), vectors_of(songs, f"song_{song_role}", width)
            row = pc.index_in(users, value_set=theirs.column("of_user").combine_chunks(), skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
            mine = row[owner]
            both = mine >= 0
            both[both] = u_known[mine[both]] & s_known[at[both]]
            out = np.zeros(len(owner))
            # Adding zero makes a negative zero a plain one.
            out[both] = np.round(dots(u, s, mine[both], at[both]), digits) + 0.0
            columns[name] = pa.array(out)
        kind = pc.fill_null(songs.column(alike[0]).combine_chunks(), "").dictionary_encode().indices.to_numpy(zero_copy_only=False)
        columns[alike[1]] = pa.array(earlier_alike(owner, kind[at].astype(np.int64)))
        begins = np.flatnonzero(np.diff(owner, prepend=-1))
        offsets = pa.array(np.append(begins, len(owner)), pa.int32())
        return pa.table({"user_id": users.take(pa.array(owner[begins])),
                         **{name: pa.ListArray.from_arrays(offsets, values) for name, values in columns.items()}})

    fields = [T.StructField("song_id", song_kind), T.StructField("cand_pos", T.IntegerType()), *kept,
              *[T.StructField(name, T.DoubleType()) for name in (*wanted, alike[1])]]
    schema = T.StructType([lists.schema["user_id"], *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields]])
    left = lists.select(block().alias("_ub"), "user_id", "songs")
    return left.groupBy("_ub").cogroup(sent.groupBy("ub")).applyInArrow(score, schema)
