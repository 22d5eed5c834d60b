"""Inverted index in blocks with largest weights, and search that reads only what can still enter the best.

Documents are laid out by their heaviest term, so neighbours are alike, and cut into shards of bounded size; a shard
keeps one posting list per term, in blocks of BLOCK_DOCS documents with the largest weight of each. The weights of a query
times the largest weights bound what any document of a shard, or of a block, can score. A query first meets the shard
with its highest bound; the k-th score found there is a floor, and only shards whose bound reaches the floor are met in
the second step. Within a shard, blocks are scored from the highest bound down until the next bound is below the k-th
score so far. Results are exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunewright import session
from tunewright.functions.vectors import SCORE_DIGITS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Documents per shard at most, per shard at least where there are idle cores, and per block.
SHARD_DOCS, LEAST_DOCS, BLOCK_DOCS = 8_192, 256, 64
#: Shards of one task, in the numbers that shards get.
SUBSHARDS = 1 << 20
#: Queries that one task meets in a shard.
QUERY_ROWS = 16_384
#: Bounds are sums in another order than scores, which are rounded.
SLACK = 2 * 10.0 ** -SCORE_DIGITS
#: The smallest rounded score above nothing.
SMALLEST = 10.0 ** -SCORE_DIGITS / 2
#: (shard, run, term) triples up to which they are broadcast (some 30 MB).
BROADCAST_LISTS = 1_000_000


def lists_of(values: np.ndarray, firsts: np.ndarray) -> pa.ListArray:
    """``values`` as lists that begin at ``firsts``."""
    return pa.ListArray.from_arrays(pa.array(np.append(firsts, len(values)), pa.int32()), pa.array(values))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, ..., start + length - 1`` of each span, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def build_blocks(documents: DataFrame, key: str = "song_id", shard_docs: int | None = None) -> DataFrame:
    """The index of written, weighted documents: one row per shard and term, and one per shard (term_id -1) with its ``keys``.

    ``docs`` are the documents' numbers in the shard, rising, with their ``weights``; ``numbers`` are the blocks that hold
    some, ``starts`` where each begins in ``docs`` and ``largest`` its largest weight.
    """
    spark = documents.sparkSession
    shard_docs = shard_docs or SHARD_DOCS
    n = documents.count()
    cores = spark.sparkContext.defaultParallelism
    # A task makes as many small shards as hold the documents of a large one.
    parts = max(-(-n // max(shard_docs, SHARD_DOCS)), min(cores, n // LEAST_DOCS), 1)
    heaviest = F.element_at("terms", F.array_position("weights", F.array_max("weights")).cast("int"))
    laid = documents.select(F.col(key).alias("key"), "terms", "weights", heaviest.alias("heaviest"))
    laid = laid.repartitionByRange(parts, "heaviest", "key").sortWithinPartitions("heaviest", "key")

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, waiting, rows = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            while batch.num_rows:
                head = batch.slice(0, shard_docs - rows)
                batch = batch.slice(head.num_rows)
                waiting.append(head)
                rows += head.num_rows
                if rows == shard_docs:
                    yield from shard(part * SUBSHARDS + made, waiting)
                    made, waiting, rows = made + 1, [], 0
        if rows:
            yield from shard(part * SUBSHARDS + made, waiting)

    def shard(number: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches).combine_chunks()
        keys, terms = held.column("key").combine_chunks(), held.column("terms").combine_chunks()
        doc = np.repeat(np.arange(len(keys), dtype=np.int32), terms.value_lengths().to_numpy())
        term = terms.flatten().to_numpy()
        weight = held.column("weights").combine_chunks().flatten().to_numpy()
        order = np.argsort(term, kind="stable")
        doc, term, weight = doc[order], term[order], weight[order]
        # A block begins where the term or the block of the document changes, a list where the term does.
        block = doc // BLOCK_DOCS
        starts = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        largest = np.maximum.reduceat(weight, starts) if len(starts) else weight
        firsts = np.flatnonzero(np.diff(term, prepend=-1))
        in_blocks = np.searchsorted(starts, firsts)
        listed = len(firsts)
        own = np.repeat(firsts, np.diff(np.append(in_blocks, len(starts))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([number] * listed, pa.int64()), pa.array(term[firsts], pa.int32()), pa.nulls(listed, pa.list_(keys.type)),
             lists_of(doc, firsts), lists_of(weight, firsts), lists_of(block[starts], in_blocks),
             lists_of((starts - own).astype(np.int32), in_blocks), lists_of(largest, in_blocks)], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
             *[pa.nulls(1, pa.list_(t)) for t in (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64())]], names=names)

    names = ["shard", "term_id", "keys", "docs", "weights", "numbers", "starts", "largest"]
    kind = documents.schema[key].dataType.simpleString()
    return laid.mapInArrow(invert, f"shard bigint, term_id int, keys array<{kind}>, docs array<int>, weights array<double>, "
                                   "numbers array<int>, starts array<int>, largest array<double>")


def members(blocks: DataFrame, key: str = "song_id") -> DataFrame:
    """``shard, doc, key``: which document each number stands for."""
    return blocks.where(F.col("term_id") < 0).select("shard", F.posexplode("keys").alias("doc", key))


def shard_bounds(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """``query_id, shard, bound`` for the shards that hold a term of the query; ``asked`` is ``query_id, terms, weights``."""
    terms = asked.select("query_id", F.explode(F.arrays_zip("terms", "weights")).alias("e"))
    terms = terms.select("query_id", F.col("e.terms").alias("term_id"), F.col("e.weights").alias("weight"))
    tops = blocks.where(F.col("term_id") >= 0).select("shard", "term_id", F.array_max("largest").alias("top"))
    return terms.join(tops, "term_id").groupBy("query_id", "shard").agg(F.sum(F.col("weight") * F.col("top")).alias("bound"))


class Lists:
    """The posting lists of one shard as flat arrays."""

    def __init__(self, table: pa.Table):
        table = table.filter(pc.greater_equal(table.column("term_id"), 0)).combine_chunks()
        terms = table.column("term_id").to_numpy()
        order = np.argsort(terms)
        self.terms = terms[order]
        flat, first = {}, {}
        for name in ("docs", "weights", "numbers", "starts", "largest"):
            lists = table.column(name).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat[name] = lists.flatten().to_numpy(zero_copy_only=False)
            first[name] = np.concatenate([[0], np.cumsum(lengths)])
        self.docs, self.weights, self.numbers, self.largest = (flat[n] for n in ("docs", "weights", "numbers", "largest"))
        # Per term its blocks, per block its postings.
        self.first, self.count = first["numbers"][:-1][order], np.diff(first["numbers"])[order]
        self.begin = flat["starts"] + np.repeat(first["docs"][:-1], np.diff(first["starts"]))
        self.size = np.diff(np.append(self.begin, len(self.docs)))

    def rows(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the terms have a list, and its row."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), dtype=bool)
        return known, at[known]


def best_of_shard(terms: np.ndarray, weights: np.ndarray, floor: float, lists: Lists, ords: np.ndarray, allowed: np.ndarray,
                  k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(documents, scores, blocks read, blocks): the k best of one query in one shard that reach the floor, ties by ord."""
    known, rows = lists.rows(terms)
    each = spans(lists.first[rows], lists.count[rows])
    weight = np.repeat(weights[known], lists.count[rows])
    number = lists.numbers[each]
    n_blocks = -(-len(ords) // BLOCK_DOCS)
    bounds = np.bincount(number, weight * lists.largest[each], n_blocks)
    order = np.argsort(-bounds, kind="stable")
    held = int(np.count_nonzero(bounds))
    docs, scores = np.empty(0, dtype=np.int64), np.empty(0)
    done, step = 0, max(1, -(-2 * k // BLOCK_DOCS))
    while done < held and bounds[order[done]] + SLACK >= floor:
        # Twice as many blocks each time, but none below the floor.
        chosen = order[done:min(done + step, held)]
        chosen = chosen[bounds[chosen] + SLACK >= floor]
        done, step = done + len(chosen), 2 * step
        flag = np.zeros(n_blocks, dtype=bool)
        flag[chosen] = True
        wanted = flag[number]
        sizes = lists.size[each[wanted]]
        at = spans(lists.begin[each[wanted]], sizes)
        total = np.bincount(lists.docs[at], np.repeat(weight[wanted], sizes) * lists.weights[at], len(ords))
        got = np.round(total, SCORE_DIGITS)
        new = np.flatnonzero(allowed & (got >= max(floor, SMALLEST)))
        docs, scores = np.concatenate([docs, new]), np.concatenate([scores, got[new]])
        if len(docs) >= k:
            if len(docs) > k:
                # Only what reaches the k-th score is put in order.
                reach = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                docs, scores = docs[reach], scores[reach]
                best = np.lexsort((ords[docs], -scores))[:k]
                docs, scores = docs[best], scores[best]
            floor = max(floor, scores.min())
    return docs, scores, done, n_blocks


def met(pairs: DataFrame, blocks: DataFrame, asked: DataFrame, ords: DataFrame, k: int) -> DataFrame:
    """``query_id, shard, doc, ord, score, read, blocks`` of the (query_id, shard, floor) pairs; doc -1 has the counts."""
    runs = max(1, -(-asked.count() // QUERY_ROWS))
    left = pairs.join(asked, "query_id").withColumn("run", F.pmod(F.xxhash64("query_id"), F.lit(runs)))
    wanted = session.settle(left.select("shard", "run", F.explode("terms").alias("term_id")).distinct(), "wanted-lists")
    if wanted.count() <= BROADCAST_LISTS:
        wanted = F.broadcast(wanted)
    lists = blocks.drop("keys").where(F.col("term_id") >= 0).join(wanted, ["shard", "term_id"])
    orders = left.select("shard", "run").distinct().join(ords, "shard")
    group = [F.col("shard").alias("in_shard"), F.col("run").alias("in_run")]
    right = lists.select(*group, "term_id", "docs", "weights", "numbers", "starts", "largest", F.lit(None).cast("array<bigint>").alias("ords"))
    empty = {"weights": "double", "numbers": "int", "starts": "int", "largest": "double"}
    right = right.unionByName(orders.select(*group, F.lit(-1).alias("term_id"), "docs", "ords",
                                            *[F.lit(None).cast(f"array<{t}>").alias(n) for n, t in empty.items()]))
    kind = asked.schema["query_id"].dataType.simpleString()

    def score(some: pa.Table, table: pa.Table) -> pa.Table:
        ids = some.column("query_id").combine_chunks()
        owner, docs, orders_, scores, read, blocks_ = [], [], [], [], [], []
        order = table.filter(pc.less(table.column("term_id"), 0))
        if order.num_rows:
            numbers = order.column("docs").combine_chunks().flatten().to_numpy()
            # Lists may name documents that are not offered.
            size = int(table.column("docs").combine_chunks().flatten().to_numpy().max()) + 1
            ords_, allowed = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
            ords_[numbers], allowed[numbers] = order.column("ords").combine_chunks().flatten().to_numpy(), True
            lists = Lists(table)
            floors = some.column("floor").to_numpy()
            asked_terms, asked_weights = (some.column(c).combine_chunks() for c in ("terms", "weights"))
            ends = np.cumsum(asked_terms.value_lengths().to_numpy()).tolist()
            asked_terms, asked_weights = (c.flatten().to_numpy() for c in (asked_terms, asked_weights))
            for i, (a, z) in enumerate(zip([0, *ends], ends)):
                d, s, r, b = best_of_shard(asked_terms[a:z], asked_weights[a:z], floors[i], lists, ords_, allowed, k)
                owner += [i] * (len(d) + 1)
                docs += [*d.tolist(), -1]
                orders_ += [*ords_[d].tolist(), None]
                scores += [*s.tolist(), None]
                read += [None] * len(d) + [r]
                blocks_ += [None] * len(d) + [b]
        at = pa.array(owner, pa.int64())
        return pa.table({
            "query_id": ids.take(at), "shard": some.column("shard").combine_chunks().take(at), "doc": pa.array(docs, pa.int32()),
            "ord": pa.array(orders_, pa.int64()), "score": pa.array(scores, pa.float64()), "read": pa.array(read, pa.int64()),
            "blocks": pa.array(blocks_, pa.int64())})

    return left.groupBy("shard", "run").cogroup(right.groupBy("in_shard", "in_run")).applyInArrow(
        score, f"query_id {kind}, shard bigint, doc int, ord bigint, score double, read bigint, blocks bigint")


def search(asked: DataFrame, blocks: DataFrame, orders: DataFrame, hits: int, key: str = "song_id") -> tuple[DataFrame, DataFrame]:
    """The ``hits`` best documents of each written ``query_id, terms, weights`` with a positive score, and what was read.

    ``orders`` gives ``key, song_ord``: documents without a row there are not offered. First table: ``query_id, key, ord,
    score, pos``. Second one, per query: ``shards`` and ``blocks`` that hold a term of it, ``shards_met``, ``blocks_read``.
    """
    asked = asked.where(F.size("terms") > 0)
    placed = members(blocks, key).join(orders.select(key, F.col("song_ord").cast("bigint").alias("ord")), key)
    packed = placed.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("doc", "ord"))).alias("all"))
    ords = session.settle(packed.select("shard", F.col("all.doc").alias("docs"), F.col("all.ord").alias("ords")), "shard-orders")
    bounds = session.settle(shard_bounds(asked, blocks), "shard-bounds")
    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "shard"))
    first = bounds.withColumn("near", nearest).where(F.col("near") == 1).select("query_id", "shard", F.lit(0.0).alias("floor"))
    probed = session.settle(met(first, blocks, asked, ords, hits), "first-hits")
    # A query has a floor once it has all its hits; a shard below it cannot change them.
    floors = probed.where(F.col("doc") >= 0).groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= hits, F.min("score")).otherwise(0.0).alias("floor"))
    done = first.select("query_id", "shard")
    rest = bounds.join(done, ["query_id", "shard"], "left_anti").join(floors, "query_id", "left").select(
        "query_id", "shard", F.coalesce("floor", F.lit(0.0)).alias("floor"), "bound")
    second = rest.where(F.col("bound") + SLACK >= F.col("floor")).drop("bound")
    later = session.settle(met(second, blocks, asked, ords, hits), "second-hits")
    every = probed.unionByName(later)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    top = every.where(F.col("doc") >= 0).withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= hits)
    found = top.join(members(blocks, key), ["shard", "doc"]).select("query_id", key, "ord", "score", "pos")
    counted = every.where(F.col("doc") < 0).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("shards_met"), F.sum("read").alias("blocks_read"), F.sum("blocks").alias("blocks_met"))
    total = bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("shards"))
    return found, total.join(counted, "query_id", "left").select(
        "query_id", "shards", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("shards_met", "blocks_met", "blocks_read")])
