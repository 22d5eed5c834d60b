"""Placement of unit vectors by angle, and the blocks that a query cannot leave out.

Items go to the nearest of a bounded sample of routing vectors; a crowded region is cut into bands by the angle to its
routing vector, and a band that is still crowded (equal vectors) is spread by hash. A band's items lie between two
angles from its routing vector, so a query at angle t from it reaches at most cos(distance from t to that interval).
What travels to the tasks is bounded: ``ROUTES`` vectors and ``ROUTES * BANDS`` bands, whatever the number of items.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright import session

# Placement travels with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROUTES = 1_024
BANDS = 16
#: Regions that a smaller table is cut into, as far as they keep ``LEAST_ROWS`` items each.
FINE, LEAST_ROWS = 64, 256
#: Bands that a query meets first.
FIRST = 2
#: Allowance for the rounding of angles and of scores.
SLACK = 1e-6
CELLS = 2_000_000


@dataclass
class Bands:
    """Routing vectors and, per band, its region, angles, number of items and the blocks it is spread over."""

    routes: np.ndarray
    region: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    first_block: np.ndarray
    blocks: np.ndarray

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """The highest cosine that each vector can have with an item of each band."""
        angles = np.arccos(np.clip(vectors @ self.routes.T, -1, 1))
        # Vectors of length 0 have cosine 0 with everything; region -1 holds the items of that kind.
        angles = np.concatenate([angles, np.zeros((len(vectors), 1))], axis=1)[:, self.region]
        reach = np.cos(np.maximum(0, np.maximum(angles - self.high, self.low - angles)))
        reach[:, self.region < 0] = 0
        reach[~vectors.any(axis=1)] = 0
        return reach + SLACK


def sample(df: DataFrame, name: str, number: int) -> np.ndarray:
    """At most ``number`` vectors other than zero, chosen by the hash of ``name``."""
    some = df.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64(name), name).select("vector").limit(number)
    return np.array([row["vector"] for row in some.collect()], dtype=np.float64)


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def with_region(df: DataFrame, routes: np.ndarray) -> DataFrame:
    """``_region`` (the nearest routing vector; -1 for vectors of length 0) and ``_angle`` of each row."""
    schema = df.withColumn("_region", F.lit(0)).withColumn("_angle", F.lit(0.0)).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = as_matrix(batch.column(batch.schema.get_field_index("vector")))
            near = vectors @ routes.T
            region = near.argmax(axis=1).astype(np.int32)
            angle = np.arccos(np.clip(near[np.arange(len(near)), region], -1, 1))
            zero = ~vectors.any(axis=1)
            region[zero], angle[zero] = -1, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(region), pa.array(angle)], names=[*batch.schema.names, "_region", "_angle"])

    return df.mapInArrow(place, schema)


def item_blocks(items: DataFrame, n_items: int, block_rows: int) -> tuple[DataFrame, Bands] | None:
    """Items with their block ``_ib``, and the bands; None where no item has a direction."""
    wanted = max(-(-n_items // block_rows), min(FINE, n_items // LEAST_ROWS), 1)
    routes = sample(items, "item_id", min(ROUTES, wanted))
    if not len(routes):
        return None
    placed = session.settle(with_region(items, routes), "topk-placed-items")
    cuts = [i / BANDS for i in range(1, BANDS)]
    regions = placed.groupBy(F.col("_region").alias("_of")).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_angle", cuts, 1_000).alias("_cuts"))
    banded = placed.join(regions, F.col("_region") == F.col("_of"))
    pieces = F.least(F.lit(BANDS), F.ceil(F.col("_n") / block_rows)).cast("int")
    passed = F.size(F.filter("_cuts", lambda c: c < F.col("_angle")))
    banded = banded.withColumn("_band", F.floor(passed * pieces / BANDS).cast("int")).drop("_of", "_n", "_cuts")
    banded = session.settle(banded, "topk-bands")
    # At most (ROUTES + 1) * BANDS rows.
    found = banded.groupBy("_region", "_band").agg(
        F.count(F.lit(1)).alias("n"), F.min("_angle").alias("low"), F.max("_angle").alias("high")).collect()
    found.sort(key=lambda row: (row["_region"], row["_band"]))
    rows = np.array([row["n"] for row in found], np.int64)
    blocks = -(-rows // block_rows)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    bands = Bands(routes, np.array([row["_region"] for row in found]), np.array([row["low"] for row in found]),
                  np.array([row["high"] for row in found]), rows, first, blocks)
    named = items.sparkSession.createDataFrame(
        [(row["_region"], row["_band"], int(f), int(b)) for row, f, b in zip(found, first, blocks, strict=True)],
        "_r int, _b int, _first int, _blocks int")
    out = banded.join(named, (F.col("_region") == F.col("_r")) & (F.col("_band") == F.col("_b")))
    block = F.col("_first") + F.pmod(F.xxhash64("item_id"), F.col("_blocks")).cast("int")
    return out.select(*items.columns, block.alias("_ib")), bands


def query_blocks(queries: DataFrame, n_queries: int, blocks: int, block_rows: int) -> DataFrame:
    """Queries with their block ``_qb``: near queries together, in blocks of about ``block_rows`` rows."""
    routes = sample(queries, "query_id", min(ROUTES, blocks))
    if not len(routes):
        return queries.withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    placed = session.settle(with_region(queries, routes), "topk-placed-queries")
    sizes = placed.groupBy(F.col("_region").alias("_of")).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_parts"))
    # At most ROUTES + 1 rows.
    sizes = sorted((row["_of"], row["_parts"]) for row in sizes.collect())
    first = np.cumsum([0, *(parts for _, parts in sizes)])
    named = queries.sparkSession.createDataFrame(
        [(region, int(at), parts) for (region, parts), at in zip(sizes, first, strict=False)], "_of int, _first int, _parts int")
    block = F.col("_first") + F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int")
    return placed.join(named, F.col("_region") == F.col("_of")).select(*queries.columns, block.alias("_qb"))


def first_bands(queries: DataFrame, bands: Bands, k: int) -> DataFrame:
    """Queries with ``_met``: the ``FIRST`` bands of the highest bounds, and more until they hold k items."""
    schema = queries.withColumn("_met", F.array(F.lit(0))).schema

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(bands.region))
        for batch in batches:
            vectors = as_matrix(batch.column(batch.schema.get_field_index("vector"))) if batch.num_rows else np.zeros((0, 1))
            met = []
            for at in range(0, len(vectors), step):
                order = np.argsort(-bands.bounds(vectors[at:at + step]), axis=1, kind="stable")
                held = np.cumsum(bands.rows[order], axis=1)
                need = np.maximum(FIRST, (held < k).sum(axis=1) + 1)
                met += [row[:n].astype(np.int32) for row, n in zip(order, need, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(met, pa.list_(pa.int32()))], names=[*batch.schema.names, "_met"])

    return queries.mapInArrow(choose, schema)


def wanted_bands(batch: pa.RecordBatch, bands: Bands, again: bool) -> np.ndarray:
    """(row, band) cells that are asked: a row's ``_met`` bands, or ``again`` the others whose bound reaches its ``_floor``."""
    met = batch.column(batch.schema.get_field_index("_met"))
    asked = np.zeros((batch.num_rows, len(bands.region)), bool)
    lengths = np.asarray([len(m) for m in met])
    asked[np.repeat(np.arange(len(lengths)), lengths), met.flatten().to_numpy()] = True
    if not again:
        return asked
    floor = batch.column(batch.schema.get_field_index("_floor")).to_numpy()
    vectors = as_matrix(batch.column(batch.schema.get_field_index("vector")))
    return (bands.bounds(vectors) >= floor[:, None]) & ~asked


def asked_again(queries: DataFrame, bands: Bands) -> DataFrame:
    """``n``: how many rows ``asked_blocks`` would give the second time, in parts, without making them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(bands.region))
        for whole in batches:
            n = sum(int((wanted_bands(whole.slice(at, step), bands, True) @ bands.blocks).sum()) for at in range(0, whole.num_rows, step))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return queries.mapInArrow(count, "n bigint")


def asked_blocks(queries: DataFrame, bands: Bands, again: bool) -> DataFrame:
    """``query_id, _ib``: one row per block that a query asks.

    First the blocks of its ``_met`` bands. ``again``: those of the other bands whose bound reaches its ``_floor``.
    """
    schema = queries.select("query_id", F.lit(0).alias("_ib")).schema

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(bands.region))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                row, band = np.nonzero(wanted_bands(batch, bands, again))
                copies = bands.blocks[band]
                start = np.cumsum(copies) - copies
                block = np.repeat(bands.first_block[band] - start, copies) + np.arange(copies.sum())
                asking = batch.column(batch.schema.get_field_index("query_id")).take(pa.array(np.repeat(row, copies)))
                yield pa.RecordBatch.from_arrays([asking, pa.array(block.astype(np.int32))], names=["query_id", "_ib"])

    return queries.mapInArrow(ask, schema)


def asked_groups(queries: DataFrame, bands: Bands, again: bool, group: int, kept: list[str]) -> DataFrame:
    """The ``kept`` columns, ``_sb`` and ``_bits``: one row per group of blocks of which a query asks any.

    A group is ``group`` neighbouring blocks, ``_bits`` says which of them are asked (see ``asked_blocks``): a query
    travels once per group, however small the blocks are.
    """
    schema = queries.select(*kept, F.lit(0).alias("_sb"), F.lit(b"").alias("_bits")).schema
    of_block = np.repeat(np.arange(len(bands.blocks)), bands.blocks)
    groups = -(-len(of_block) // group)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(len(bands.region), groups * group))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                cells = np.zeros((batch.num_rows, groups * group), bool)
                cells[:, :len(of_block)] = wanted_bands(batch, bands, again)[:, of_block]
                cells = cells.reshape(batch.num_rows, groups, group)
                row, number = np.nonzero(cells.any(axis=2))
                bits = np.packbits(cells[row, number], axis=1)
                for part in range(0, len(row), 16_384):
                    run = slice(part, part + 16_384)
                    taken = batch.select(kept).take(pa.array(row[run]))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(number[run].astype(np.int32)), pa.array([b.tobytes() for b in bits[run]], pa.binary())],
                        names=[*kept, "_sb", "_bits"])

    return queries.mapInArrow(ask, schema)
