"""Exact top-k of every query against every item, without emitting the pairs.

Queries and items are hashed into blocks of bounded size. One task meets one
query block and one item block, scores them with a matrix product and keeps k
items per query; a rank over those survivors gives the answer. What is shuffled
is each block once per opposite block, plus k rows per query and item block.

Large cosine searches place the items by direction instead: a first pass over the
nearest blocks gives each query a floor, and only blocks whose bound reaches it
are asked again (``operators/near_blocks.py``).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunewright import session
from tunewright.functions import vectors
from tunewright.functions.vectors import SCORE_DIGITS
from tunewright.operators import near_blocks

# Block scorers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUERY_ROWS = 65_536
ITEM_ROWS = 16_384
SCORE_CELLS = 4_000_000
LEAST_ROWS = 256
#: Pairs from which on two passes with bounds cost less than scoring every pair.
WORTH_PAIRS = 4_000_000_000
#: The floor of a query that has none, and (query, item, score) cells that are held until only the best are kept.
NO_FLOOR, HELD_CELLS = -2.0, 2_000_000
#: Pairs that cost about as much to score as one row costs to send.
ROW_PAIRS = 64


def block_plan(n_queries: int, n_items: int, spread: int = 1, query_rows: int = QUERY_ROWS,
               item_rows: int = ITEM_ROWS) -> tuple[int, int]:
    """(query blocks, item blocks): as few as the bounds allow, then more until ``spread`` tasks are busy.

    A query is shipped once per item block and an item once per query block, so
    each step splits the side that adds fewer shipped rows, and no block below
    ``LEAST_ROWS`` rows. A product that is large enough already is left alone.
    """
    query_blocks = max(1, math.ceil(n_queries / query_rows))
    item_blocks = max(1, math.ceil(n_items / item_rows))
    while query_blocks * item_blocks < spread:
        more_queries = n_queries // (2 * query_blocks) >= LEAST_ROWS
        more_items = n_items // (2 * item_blocks) >= LEAST_ROWS
        if not more_queries and not more_items:
            break
        if more_queries and (not more_items or n_items * query_blocks <= n_queries * item_blocks):
            query_blocks *= 2
        else:
            item_blocks *= 2
    return query_blocks, item_blocks


def best_per_row(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank) of the k highest cells per row; ties go to the lower column.

    Of the cells at a row's lowest kept score only the first few are taken, so
    a row of equal scores (no hit at all) is never sorted as a whole.
    """
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above = scores > least
    equal = scores == least
    wanted = k - above.sum(axis=1, keepdims=True)
    rows, cols = np.nonzero(above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= wanted)))
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(scores.shape[0]))
    rank = np.arange(len(rows)) - first[rows]
    kept = rank < k
    return rows[kept], cols[kept], rank[kept] + 1


def paired_topk(queries: DataFrame, items: DataFrame, scorer: Callable, k: int,
                query_rows: int = QUERY_ROWS, item_rows: int = ITEM_ROWS) -> DataFrame:
    """``query_id, item_id, item_ord, score, rank`` with the k best items per query.

    ``queries`` has ``query_id`` and payload columns, ``items`` has ``item_id,
    item_ord`` and payload columns. ``scorer(query_table, item_table)`` yields
    score matrices for consecutive runs of query rows; item rows arrive in
    ``item_ord`` order.
    """
    # Both sides are computed once; counting a written table reads file footers only.
    queries, items = session.settle(queries, "topk-queries"), session.settle(items, "topk-items")
    return _whole_topk(queries, items, queries.count(), items.count(), scorer, k, query_rows, item_rows)


def _whole_topk(queries: DataFrame, items: DataFrame, n_queries: int, n_items: int, scorer: Callable, k: int,
                query_rows: int, item_rows: int) -> DataFrame:
    """Every query block meets every item block.

    ``item_rows`` bounds the items scored at a time; what travels is as large as ``ITEM_ROWS`` allows, since a query is
    copied once per item block.
    """
    spread = queries.sparkSession.sparkContext.defaultParallelism
    query_blocks, item_blocks = block_plan(n_queries, n_items, spread, query_rows, max(item_rows, ITEM_ROWS))

    def side(df: DataFrame, key: str, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    left = side(queries, "query_id", "_qb", query_blocks, "_ib", item_blocks)
    right = side(items, "item_id", "_ib", item_blocks, "_qb", query_blocks)
    survivors = _scored(left, right, scorer, k, item_rows)
    return survivors if item_blocks == 1 else _best(survivors, k)


def _best(survivors: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_ord")
    return survivors.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def best_in_runs(queries: pa.Table, items: pa.Table, scorer: Callable, k: int, item_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, item) of the k best items per query, best first, from at most ``item_rows`` items at a time; no item is -1."""
    k = min(k, items.num_rows)
    best, at = np.full((queries.num_rows, k), -np.inf), np.full((queries.num_rows, k), -1)
    for first in range(0, items.num_rows, item_rows):
        start = 0
        for scores in scorer(queries, items.slice(first, item_rows)):
            run = slice(start, start + len(scores))
            # The best so far stand first: they win ties against later items.
            held = k if first else 0
            scores = np.hstack([best[run, :held], np.round(scores, SCORE_DIGITS)])
            rows, cols, rank = best_per_row(scores, k)
            item = np.where(cols < held, at[run][rows, np.minimum(cols, k - 1)], first + cols - held)
            best[run], at[run] = -np.inf, -1
            best[start + rows, rank - 1], at[start + rows, rank - 1] = scores[rows, cols], item
            start += len(scores)
    return best, at


def _scored(left: DataFrame, right: DataFrame, scorer: Callable, k: int, item_rows: int | None = None) -> DataFrame:
    """The k best items per query of each (``_qb``, ``_ib``) that both sides name; ``item_rows`` are scored at a time."""
    queries, items = left, right
    fields = {**{f.name: f.dataType.simpleString() for f in queries.select("query_id").schema},
              **{f.name: f.dataType.simpleString() for f in items.select("item_id", "item_ord").schema}}
    schema = ", ".join(f"{n} {t}" for n, t in fields.items()) + ", score double, rank int"

    def score_blocks(query_part: pa.Table, item_part: pa.Table) -> pa.Table:
        ids = query_part.column("query_id").combine_chunks()
        if item_part.num_rows == 0 or query_part.num_rows == 0:
            none = pa.array([], pa.int32())
            return pa.table({"query_id": ids.slice(0, 0), "item_id": item_part.column("item_id").slice(0, 0),
                             "item_ord": item_part.column("item_ord").slice(0, 0),
                             "score": pa.array([], pa.float64()), "rank": none})
        item_part = item_part.sort_by("item_ord").combine_chunks()
        best, at = best_in_runs(query_part.combine_chunks(), item_part, scorer, k, item_rows or item_part.num_rows)
        rows, place = np.nonzero(at >= 0)
        at_q, at_i = pa.array(rows), pa.array(at[rows, place])
        return pa.table({
            "query_id": ids.take(at_q),
            "item_id": item_part.column("item_id").take(at_i),
            "item_ord": item_part.column("item_ord").take(at_i),
            "score": pa.array(best[rows, place]),
            "rank": pa.array((place + 1).astype(np.int32)),
        })

    return left.groupBy("_qb", "_ib").cogroup(right.groupBy("_qb", "_ib")).applyInArrow(score_blocks, schema)


def bounded_topk(queries: DataFrame, items: DataFrame, n_queries: int, n_items: int, k: int,
                 query_rows: int = QUERY_ROWS, item_rows: int = ITEM_ROWS,
                 always: bool = True) -> tuple[DataFrame, DataFrame] | None:
    """The k best items per query by cosine, and (``query_id``, ``_ib``) of every block that was asked.

    ``queries`` and ``items`` are written tables with vectors of length 1 or 0. None where no item has a direction, and,
    without ``always``, where the bounds leave out so little that scoring every pair costs less.
    """
    spread = queries.sparkSession.sparkContext.defaultParallelism
    placed = near_blocks.item_blocks(items, n_items, item_rows)
    if placed is None:
        return None
    n_blocks, n_groups = block_plan(n_queries, n_items, spread, query_rows, max(item_rows, ITEM_ROWS))
    bands = placed[1]
    # Small blocks travel in groups, so that a query is copied once per group.
    group = max(1, -(-int(bands.blocks.sum()) // n_groups))
    offered = session.settle(placed[0].withColumn("_sb", F.floor(F.col("_ib") / group).cast("int")), "topk-items-by-direction")
    asking = near_blocks.query_blocks(queries, n_queries, n_blocks, query_rows)
    asking = session.settle(near_blocks.first_bands(asking, bands, k), "topk-first-bands").withColumn("_floor", F.lit(NO_FLOOR))

    def searched(asking: DataFrame, again: bool) -> DataFrame:
        # Bounds are made twice, which costs less than to write the vectors of all that is asked.
        asked = near_blocks.asked_groups(asking, bands, again, group, ["query_id", "vector", "_floor", "_qb"])
        pairs = session.settle(near_blocks.asked_groups(asking, bands, again, group, ["_qb"]).select(
            F.col("_qb").alias("_asking"), F.col("_sb").alias("_wanted")).distinct(), "topk-asked")
        # A group of items goes to the query blocks that ask any of it, each once.
        right = offered.join(pairs, F.col("_sb") == F.col("_wanted")).drop("_wanted").withColumnRenamed("_asking", "_qb")
        return _scored_groups(asked, right, k, group)

    found = session.settle(_best(searched(asking, False), k), "topk-found-first")
    floors = found.groupBy(F.col("query_id").alias("_id")).agg(
        F.when(F.count(F.lit(1)) == k, F.min("score")).alias("_least"))
    later = asking.drop("_floor").join(floors, F.col("query_id") == F.col("_id"), "left").withColumn(
        "_floor", F.coalesce("_least", F.lit(NO_FLOOR))).drop("_id", "_least")
    # Few rows may lie in one file, yet each of them meets all bounds.
    later = session.settle(later.repartition(max(spread, asking.rdd.getNumPartitions())), "topk-floors")
    if not always:
        copies = near_blocks.asked_again(later, bands).agg(F.sum("n")).first()[0] or 0
        whole = n_queries * (ROW_PAIRS * math.ceil(n_items / max(item_rows, ITEM_ROWS)) + n_items)
        if copies * (ROW_PAIRS + item_rows) >= whole:
            return None
    everything = found.unionByName(searched(later, True))
    met = near_blocks.asked_blocks(asking, bands, again=False).unionByName(near_blocks.asked_blocks(later, bands, again=True))
    return _best(everything, k), met


def best_of_groups(wanted: np.ndarray, floor: np.ndarray, asked: np.ndarray, offered: np.ndarray, block: np.ndarray,
                   place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score): the k best items per query that reach its ``floor``, from the blocks that it asks.

    ``asked`` has a row per query and a column per block, ``block`` rises over the items, ties go to the lower ``place``.
    Where a query has a floor, only the few cells that reach it are looked at further.
    """
    floor = floor.copy()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def reduce() -> None:
        rows, items, scores = (np.concatenate([h[i] for h in held]) for i in range(3))
        order = np.lexsort((place[items], -scores, rows))
        rows, items, scores = rows[order], items[order], scores[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        full = rank == k - 1
        floor[rows[full]] = np.maximum(floor[rows[full]], scores[full])
        held[:] = [(rows[rank < k], items[rank < k], scores[rank < k])]

    numbers, starts = np.unique(block, return_index=True)
    grown = 0
    for number, first, last in zip(numbers, starts, [*starts[1:], len(block)]):
        some, rows = offered[first:last].T, np.flatnonzero(asked[:, number])
        step = max(1, SCORE_CELLS // (last - first))
        for at in range(0, len(rows), step):
            run = rows[at:at + step]
            scores = wanted[run] @ some
            open_ = floor[run] <= NO_FLOOR
            reach = scores >= (floor[run] - 2 * 10.0 ** -SCORE_DIGITS)[:, None]
            reach[open_] = False
            row, col = np.nonzero(reach)
            parts = [(run[row], first + col, np.round(scores[row, col], SCORE_DIGITS))]
            if open_.any():
                # Without a floor, the k best of a block.
                among = np.argsort(place[first:last], kind="stable")
                rounded = np.round(scores[open_][:, among], SCORE_DIGITS)
                row, col, _ = best_per_row(rounded, k)
                parts.append((run[open_][row], first + among[col], rounded[row, col]))
            for part in parts:
                reached = part[2] >= floor[part[0]]
                held.append(tuple(column[reached] for column in part))
                grown += int(reached.sum())
            if grown > HELD_CELLS:
                reduce()
                grown = 0
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    reduce()
    return held[0]


def _scored_groups(left: DataFrame, right: DataFrame, k: int, group: int) -> DataFrame:
    """The k best items per query of each (``_qb``, ``_sb``), from the blocks that the query's ``_bits`` name."""
    fields = {**{f.name: f.dataType.simpleString() for f in left.select("query_id").schema},
              **{f.name: f.dataType.simpleString() for f in right.select("item_id", "item_ord").schema}}
    schema = ", ".join(f"{n} {t}" for n, t in fields.items()) + ", score double, rank int"

    def score(query_part: pa.Table, item_part: pa.Table) -> pa.Table:
        ids = query_part.column("query_id").combine_chunks()
        rows, items, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(ids) and item_part.num_rows:
            item_part = item_part.sort_by([("_ib", "ascending"), ("item_ord", "ascending")]).combine_chunks()
            place = np.empty(item_part.num_rows, np.int64)
            place[pc.sort_indices(item_part.column("item_ord")).to_numpy()] = np.arange(item_part.num_rows)
            packed = np.frombuffer(b"".join(query_part.column("_bits").to_pylist()), np.uint8).reshape(len(ids), -1)
            asked = np.unpackbits(packed, axis=1, count=group).astype(bool)
            rows, items, scores = best_of_groups(
                matrix(query_part.column("vector")), query_part.column("_floor").to_numpy(), asked, matrix(item_part.column("vector")),
                item_part.column("_ib").to_numpy() - query_part.column("_sb")[0].as_py() * group, place, k)
        at_q, at_i = pa.array(rows), pa.array(items)
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
        return pa.table({
            "query_id": ids.take(at_q), "item_id": item_part.column("item_id").take(at_i),
            "item_ord": item_part.column("item_ord").take(at_i), "score": pa.array(scores), "rank": pa.array(rank.astype(np.int32))})

    return left.groupBy("_qb", "_sb").cogroup(right.groupBy("_qb", "_sb")).applyInArrow(score, schema)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def cosine_scores(queries: pa.Table, items: pa.Table):
    """Score runs for ``vector`` payloads that already have length 1 (or 0)."""
    wanted = matrix(queries.column("vector"))
    offered = matrix(items.column("vector")).T
    step = max(1, SCORE_CELLS // offered.shape[1])
    for at in range(0, len(wanted), step):
        yield wanted[at:at + step] @ offered


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, query_id: str = "user_id",
                query_vector: str = "embedding", item_id: str = "song_id", item_ord: str = "song_ord",
                item_vector: str = "embedding", out: str = "similarity", query_rows: int = QUERY_ROWS,
                item_rows: int = ITEM_ROWS, worth_pairs: int = WORTH_PAIRS) -> DataFrame:
    """The k items with the highest cosine per query; rows without a vector take no part.

    From ``worth_pairs`` pairs on, blocks of items that cannot enter a query's list are left out. Same rows either way.
    """
    asked = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("query_id"), vectors.unit(query_vector).alias("vector"))
    offered = items.where(F.col(item_vector).isNotNull()).select(
        F.col(item_id).alias("item_id"), F.col(item_ord).alias("item_ord"),
        vectors.unit(item_vector).alias("vector"))
    asked, offered = session.settle(asked, "topk-queries"), session.settle(offered, "topk-items")
    n_queries, n_items = asked.count(), offered.count()
    found = None
    if n_queries * n_items >= worth_pairs:
        found = bounded_topk(asked, offered, n_queries, n_items, k, query_rows, item_rows, always=worth_pairs <= 0)
    if found is None:
        best = _whole_topk(asked, offered, n_queries, n_items, cosine_scores, k, query_rows, item_rows)
    else:
        best = found[0]
    return best.select(
        F.col("query_id").alias(query_id), F.col("item_id").alias(item_id),
        F.col("item_ord").alias("item_ord"), F.col("score").alias(out), "rank")


def similar_songs_topk(user_vectors: DataFrame, songs: DataFrame, k: int, **blocks) -> DataFrame:
    """Per user, the k songs nearest to the user vector by cosine, ties by ``song_ord``."""
    return cosine_topk(user_vectors, songs, k, **blocks)


def similar_artists_topk(user_artist_vectors: DataFrame, artist_vectors: DataFrame, k: int,
                         **blocks) -> DataFrame:
    """Per user, the k artists nearest to the user's artist vector, ties by ``artist_id``."""
    return cosine_topk(user_artist_vectors, artist_vectors, k, query_vector="artist_vector",
                       item_id="artist_id", item_ord="artist_id", **blocks).drop("item_ord")
