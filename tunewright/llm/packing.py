"""Best-two-fit packing of tokenized documents into sequences of bounded length.

Only the number of pieces of each length decides the packing, and there are at most ``capacity`` lengths: the plan is
made on that histogram (bounded by the sequence length, not by the data) as bin patterns with a multiplicity. A bin is
filled greedily with the longest pieces that fit; then its smallest piece is taken out again if two unpacked pieces fit
the wider gap more tightly. Pieces are numbered per length in salted groups and find their place by that number, so no
length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunewright.llm import tokens
from tunewright.llm.common import beside, row_key, text_of
from tunewright.session import settle

CAPACITY = 4096
END_ID = 1
#: Pieces per salt, and the least number of salts, of the numbering within one length.
PER_SALT, LEAST_SALTS = 50_000, 64


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """(doc_id, row_key, piece, start, length, ids_crc32[, ids]): each document's ids and end id, cut at capacity."""
    df = beside(docs, doc_id=F.col("doc_id").cast("long"), text=text_of())
    df = df.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    schema = "doc_id long, row_key binary, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, ids, lengths in tokens.documents(tokenizer_path, batch.column("text"), end_id):
                pieces = -(-lengths // capacity)
                whose = np.repeat(np.arange(len(lengths)), pieces)
                piece = np.arange(len(whose)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, lengths[whose] - start)
                ends = np.cumsum(length)
                sums = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip((ends - length).tolist(), ends.tolist())),
                                   dtype=np.int64, count=len(ends))
                rows = pa.array(first + whose)
                columns = [batch.column("doc_id").take(rows), batch.column("row_key").take(rows), pa.array(piece, pa.int32()),
                           pa.array(start), pa.array(length), pa.array(sums)]
                if with_ids:
                    places = np.concatenate([[0], ends]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(places, pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names[:len(columns)])

    return df.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (number of bins, piece lengths, longest first) that pack ``counts[length]`` pieces of each length.

    Each pattern is used as often as its pieces last. A length can end a pattern at most ``capacity // length + 1``
    times, so there are at most about ``capacity * ln(capacity)`` patterns whatever the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    patterns = []
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            return patterns
        used: dict[int, int] = {}
        gap = capacity
        at = len(lengths) - 1
        while at >= 0 and gap > 0:
            at = min(at, int(np.searchsorted(lengths, gap, side="right")) - 1)
            if at < 0:
                break
            size = int(lengths[at])
            take = min(int(left[size]), gap // size)
            used[size] = take
            gap -= take * size
            at -= 1
        if gap > 0:
            smallest = min(used)
            wide = gap + smallest
            rest = left.copy()
            for size, n in used.items():
                rest[size] -= n
            open_ = np.flatnonzero(rest[:wide])  # lengths below the wide gap that still have pieces
            if len(open_):
                # For each first piece the longest second one that fits, itself only where two are left.
                partner = np.searchsorted(open_, np.minimum(wide - open_, open_), side="right") - 1
                single = (partner >= 0) & (open_[partner] == open_) & (rest[open_] < 2)
                partner = partner - single
                sums = np.where(partner >= 0, open_ + open_[partner], 0)
                best = int(np.argmax(sums))
                if sums[best] > smallest:
                    used[smallest] -= 1
                    for size in (int(open_[best]), int(open_[partner[best]])):
                        used[size] = used.get(size, 0) + 1
        used = {size: n for size, n in used.items() if n}
        times = min(int(left[size]) // n for size, n in used.items())
        for size, n in used.items():
            left[size] -= times * n
        patterns.append((times, sorted((s for s, n in used.items() for _ in range(n)), reverse=True)))


def places(patterns: list[tuple[int, list[int]]], capacity: int) -> tuple[np.ndarray, ...]:
    """Runs sorted by (length, first number): pieces ``first, first + 1, ...`` of a length go to sequences
    ``sequence, sequence + 1, ...`` at ``offset``."""
    next_number = np.zeros(capacity + 1, dtype=np.int64)
    rows = []
    sequence = 0
    for times, lengths in patterns:
        offset = 0
        for size in lengths:
            rows.append((size, next_number[size], sequence, offset))
            next_number[size] += times
            offset += size
        sequence += times
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def numbered(pieces: DataFrame, rows: int) -> DataFrame:
    """``number``: 0, 1, ... within each length, from salted groups and the sizes of the groups before."""
    salts = max(LEAST_SALTS, rows // PER_SALT)
    salt = F.pmod(F.xxhash64("row_key", "piece"), F.lit(salts))
    df = pieces.withColumn("salt", salt)
    sizes = df.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("length").alias("_length"), F.col("salt").alias("_salt"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row_key")
    df = df.withColumn("at", F.row_number().over(within) - 1)
    df = df.join(bases, (F.col("length") == F.col("_length")) & (F.col("salt") == F.col("_salt")))
    return df.withColumn("number", F.col("at") + F.col("base")).drop("_length", "_salt", "base", "salt", "at")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; any table with a ``length`` of 1 to capacity, row_key, doc_id, piece."""
    spark = pieces.sparkSession
    pieces = settle(pieces, "token-pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().toLocalIterator():  # at most one row per length
        counts[row["length"]] = row["count"]
    # At most capacity * ln(capacity) patterns, independent of the data: bounded for the driver and for a broadcast.
    plan = spark.sparkContext.broadcast(places(best_two_fit(counts, capacity), capacity))
    ready = numbered(pieces, int(counts.sum()))
    names = [c for c in ready.columns if c != "number"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != "number")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, sequences, offsets = plan.value
        starts = np.searchsorted(lengths, np.arange(capacity + 2))
        top = int(counts.max()) + 1
        keys = lengths * top + firsts
        for batch in batches:
            size = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            run = np.searchsorted(keys, size * top + number, side="right") - 1
            run = np.maximum(run, starts[size])
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(sequences[run] + number - firsts[run]), pa.array(offsets[run])],
                names=[*names, "sequence_id", "offset"])

    return ready.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    Null or empty text: the end id alone. Repeated rows: packed once each. Null doc_id: packed like any other. Empty
    table: empty result. Further input columns are not carried.
    """
    return pack(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), capacity).drop("row_key")
