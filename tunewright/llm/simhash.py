"""SimHash near-dedup: fingerprints of word shingles, linked within a Hamming radius, grouped into components.

Meet in the middle: two fingerprints at most ``radius`` bits apart share a variant that is within half the radius of
both. Every distinct fingerprint therefore meets every other one on its ball of variants (2,081 of them for radius 4).
Variants are dealt out by a few of their bits: only the fingerprint travels to each cell its ball touches, and the
variants that lie in the cell are written out there. Fingerprints that share a variant are all within the radius of each
other, so a chain through them loses no link and no group of copies is ever expanded into pairs; every link is verified.

Components come from rounds of contraction: each node joins its least neighbour in a fresh random order, the links are
relabelled and made distinct, until none is left. All rows of one fingerprint are one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import beside, row_key, text_of
from tunewright.session import settle

SHINGLE = 4
RADIUS = 4
BITS = 64
SEED = 42
#: Fingerprints (with repeats) per cell that the number of cells is chosen for.
PER_CELL = 20_000
#: Variants written out at once inside a cell.
BLOCK = 1_000_000


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """XXH64 of every run of ``shingle`` words, repeats included; of all words where there are fewer."""
    words = text.encode("utf-8").lower().split()  # on bytes both look at ASCII only
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    last = max(len(words) - shingle, 0)
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:last + 1], ends[min(shingle, len(words)) - 1:])]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the shingles' bits; zero without a word."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at:at + 65_536], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, print): one row per document row, texts left behind."""
    df = beside(docs, doc_id=F.col("doc_id").cast("long"), text=text_of())
    df = df.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "row_key", "print"])

    return df.mapInArrow(marked, "doc_id long, row_key binary, print long")


def _masks(bits: int, most: int, first: int = 0) -> np.ndarray:
    """All words with at most ``most`` of the bits [first, bits) set."""
    found = [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(first, bits), k)]
    return np.array(found, dtype=np.uint64)


class Forest:
    """Union-find over positions, used on the fingerprints of one cell."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, at: int) -> int:
        parent = self.parent
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    def roots(self) -> np.ndarray:
        """The root of every position."""
        at = np.array(self.parent, dtype=np.int64)
        while True:
            up = at[at]
            if (up == at).all():
                return at
            at = up

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def cell_variants(prints: np.ndarray, cell: int, cell_bits: int, radius: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The variants inside one cell and the positions of the prints they belong to, sorted by variant.

    The cell is the value of a variant's lowest ``cell_bits`` bits. A fingerprint that differs from it in k of these
    bits has k flips spent already. Variants are written out block by block of their next bits, so memory stays
    bounded whatever the number of fingerprints with a large ball.
    """
    half = radius // 2
    low = np.uint64((1 << cell_bits) - 1)
    moved = (prints & ~low) | np.uint64(cell)
    spent = np.bitwise_count(prints ^ moved)
    masks = [_masks(bits, half - k, cell_bits) for k in range(half + 1)]
    total = sum(int((spent == k).sum()) * len(masks[k]) for k in range(half + 1))
    # Blocks by the next bits of the variant: each flips with it, so a block filters what is written out.
    parts = max(1, -(-total // BLOCK))
    part_bits = min((parts - 1).bit_length(), bits - cell_bits)
    shift, part_mask = np.uint64(cell_bits), np.uint64((1 << part_bits) - 1)
    for part in range(1 << part_bits):
        variants, owners = [], []
        for k in range(half + 1):
            own = np.flatnonzero(spent == k)
            bases = (moved[own] >> shift) & part_mask
            for flip in np.unique((masks[k] >> shift) & part_mask):
                chosen = own[bases == (np.uint64(part) ^ flip)]
                if len(chosen):
                    fitting = masks[k][((masks[k] >> shift) & part_mask) == flip]
                    variants.append((moved[chosen][:, None] ^ fitting[None, :]).ravel())
                    owners.append(np.repeat(chosen, len(fitting)))
        if not variants:
            continue
        variants, owners = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(variants)
        yield variants[order], owners[order]


def cell_links(prints: np.ndarray, cell: int, cell_bits: int, radius: int = RADIUS, bits: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links that the variants inside one cell show.

    Any two owners of a variant are within the radius, so neighbours among the sorted owners connect them all.
    """
    prints = np.unique(prints)
    forest, links = Forest(len(prints)), []
    for variants, owners in cell_variants(prints, cell, cell_bits, radius, bits):
        meet = np.flatnonzero(variants[1:] == variants[:-1])
        left, right = owners[meet], owners[meet + 1]
        pairs = np.unique(np.minimum(left, right) * len(prints) + np.maximum(left, right))
        left, right = pairs // len(prints), pairs % len(prints)
        # What earlier blocks have joined already is left out before the loop.
        roots = forest.roots()
        new = roots[left] != roots[right]
        left, right = left[new], right[new]
        apart = np.bitwise_count(prints[left] ^ prints[right])
        # The closest first: they are the links that last.
        order = np.argsort(apart, kind="stable")[:np.count_nonzero(apart <= radius)]
        for a, b in zip(left[order].tolist(), right[order].tolist(), strict=True):
            if forest.join(a, b):
                links.append((a, b))
    return [(int(prints[a]), int(prints[b])) for a, b in links]


def links(prints: DataFrame, rows: int, radius: int = RADIUS) -> DataFrame:
    """Distinct links (a, b) that connect every two of the distinct ``prints`` within the radius."""
    half = radius // 2
    cells = max(16, -(-rows * 4 // PER_CELL))
    cell_bits = min(24, (cells - 1).bit_length())
    spread = [sum(1 << b for b in chosen) for k in range(half + 1) for chosen in combinations(range(cell_bits), k)]
    low = F.col("print").bitwiseAND(F.lit((1 << cell_bits) - 1))
    dealt = prints.select("print", F.explode(F.transform(
        F.array(*[F.lit(m) for m in spread]), lambda m: low.bitwiseXOR(m))).alias("cell"))

    def linked(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = cell_links(frame["print"].to_numpy().view(np.uint64), int(key[0]), cell_bits, radius)
        both = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    return dealt.groupBy("cell").applyInPandas(linked, "a long, b long").distinct()


def components(edges: DataFrame, salt: str = "components") -> DataFrame:
    """(node, component) of every node that has a link; ``component`` is some node of it, the same for all."""
    edges = settle(edges, salt)
    labels = None
    turn = 0
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("o"), F.col(c).alias("n"))  # noqa: B023, E731
        least = both.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a")))["n"].alias("to"))
        least = settle(least.withColumnRenamed("a", "from"), salt)
        if labels is None:
            labels = least.select(F.col("from").alias("node"), F.col("to").alias("component"))
        else:
            labels = labels.join(least, F.col("component") == F.col("from"), "left").select(
                "node", F.coalesce("to", "component").alias("component"))
        labels = settle(labels, salt)
        ends = edges.join(least, F.col("a") == F.col("from")).select(F.col("to").alias("_a"), "b")
        ends = ends.join(least, F.col("b") == F.col("from")).select("_a", F.col("to").alias("_b"))
        apart = ends.filter("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        edges = settle(apart.distinct(), salt)
        turn += 1
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels


def component_ids(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(print, component_id) of all ``nodes`` (print, least doc_id) from the components of those with links."""
    named = nodes.join(found, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("component", "print").alias("component"))
    named = settle(named, "simhash-named")
    # Joins of two plain exchanges are those that adaptive execution can split at a hot component or print.
    smallest = settle(named.groupBy(F.col("component").alias("_component")).agg(F.min("least").alias("component_id")),
                      "simhash-smallest")
    named = named.join(smallest, F.col("component") == F.col("_component")).select("print", "component_id")
    return settle(named, "simhash-groups")


def groups(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(print, component_id): each distinct print with the smallest doc_id reachable over links."""
    nodes = settle(marked.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(links(nodes.select("print"), nodes.count(), radius), "simhash-links")
    return component_ids(nodes, found)


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, row_key, print, component_id) of each document row.

    Null or blank text: fingerprint zero, linked like any other. Fewer words than a shingle: the whole sequence is
    one. Null doc_id: no candidate for the smallest id; a component of such rows only has a null id. Repeated rows:
    one row each, in one component. Empty table: empty result.
    """
    marked = settle(fingerprints(docs, shingle), "simhash-prints")
    ids = groups(marked, radius).withColumnRenamed("print", "_print")
    return marked.join(ids, F.col("print") == F.col("_print")).drop("_print")


# ---- similarity of whole texts: several fingerprints of fewer bits

#: Fingerprints per text, and the bits of each that are searched within the radius.
TABLES, TABLE_BITS = 16, 48
WORDS, SIMILARITY = 5, 0.8
_GOLDEN, _FIRST, _SECOND = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """An independent hash of each hash (the splitmix64 finisher)."""
    x = hashes + np.uint64(_GOLDEN * (table + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def signature(text: str, shingle: int = WORDS, tables: int = TABLES) -> np.ndarray:
    """One fingerprint per table; zeros without a word."""
    hashes = np.array(shingle_hashes(text, shingle), dtype=np.uint64)
    counts = np.zeros((tables, BITS), dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536]
        for table in range(tables):
            bits = np.unpackbits(_mixed(part, table).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            # Sums of at most 65,536 ones, in runs short enough for one byte.
            whole = len(bits) // 255 * 255
            counts[table] += np.add.reduce(bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8), axis=0, dtype=np.int64)
            counts[table] += bits[whole:].sum(axis=0, dtype=np.int64)
    packed = np.packbits((2 * counts > len(hashes)).astype(np.uint8), axis=1)
    return packed.view(">u8").reshape(-1).astype(np.uint64)


def signatures(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """(doc_id, row_key, node, signature) of each document row; node stands for its signature."""
    df = beside(docs, doc_id=F.col("doc_id").cast("long"), text=text_of())
    df = df.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.concatenate([signature(t.as_py(), shingle) for t in batch.column(2)] or [np.array([], np.uint64)])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.view(np.int64)), TABLES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "row_key", "signature"])

    out = df.mapInArrow(marked, "doc_id long, row_key binary, signature array<long>")
    return out.withColumn("node", F.xxhash64("signature"))


def most_bits(similarity: float, bits: int = TABLES * BITS) -> int:
    """Differing bits up to which texts of a Jaccard similarity are expected, and one standard deviation more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * (share + np.sqrt(share * (1 - share) / bits)))


def verified_links(prints: np.ndarray, signatures: np.ndarray, cell: int, cell_bits: int, most: int, radius: int = RADIUS,
                   bits: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest, as positions, of the pairs that share a variant in the cell and differ in at most ``most`` bits of their signatures.

    Every pair of owners of a variant is looked at, unless links that hold connect it already, so a pair that fails
    never stands in for one that holds. A run of owners that is connected is done; pairs are made one distance
    between owners at a time, so no more are held than the block has variants.
    """
    forest, links = Forest(len(prints)), []
    for variants, owners in cell_variants(prints, cell, cell_bits, radius, bits):
        begins = np.flatnonzero(np.concatenate(([True], variants[1:] != variants[:-1])))
        lengths = np.diff(np.append(begins, len(variants)))
        gap = 0
        while True:
            gap += 1
            longer = lengths > gap
            begins, lengths = begins[longer], lengths[longer]
            if not len(begins):
                break
            # The runs that are left, end to end; those in one tree by now are dropped.
            starts = np.cumsum(lengths) - lengths
            owners = owners[np.repeat(begins - starts, lengths) + np.arange(lengths.sum())]
            begins = starts
            roots = forest.roots()
            trees = roots[owners]
            apart = np.minimum.reduceat(trees, begins) != np.maximum.reduceat(trees, begins)
            if not apart.any():
                break
            begins, lengths = begins[apart], lengths[apart]
            counts = lengths - gap
            left = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            left, right = owners[left], owners[left + gap]
            new = roots[left] != roots[right]
            pairs = np.unique(np.minimum(left, right)[new] * len(prints) + np.maximum(left, right)[new])
            left, right = pairs // len(prints), pairs % len(prints)
            differ = np.zeros(len(pairs), dtype=np.int64)
            for word in range(signatures.shape[1]):
                differ += np.bitwise_count(signatures[left, word] ^ signatures[right, word])
            order = np.argsort(differ, kind="stable")[:np.count_nonzero(differ <= most)]
            for a, b in zip(left[order].tolist(), right[order].tolist(), strict=True):
                if forest.join(a, b):
                    links.append((a, b))
    return links


def dealt_tables(marked: DataFrame, cell_bits: int, radius: int) -> DataFrame:
    """The rows (with a ``print``) once for every cell that the ball of their print touches."""
    half = radius // 2
    spread = [sum(1 << b for b in chosen) for k in range(half + 1) for chosen in combinations(range(cell_bits), k)]
    low = F.col("print").bitwiseAND(F.lit((1 << cell_bits) - 1))
    return marked.select("*", F.explode(F.transform(
        F.array(*[F.lit(m) for m in spread]), lambda m: low.bitwiseXOR(m))).alias("cell"))


def similar_links(nodes: DataFrame, rows: int, similarity: float, radius: int = RADIUS) -> DataFrame:
    """Distinct links (a, b): nodes within the radius in one table, verified on all bits of their signatures.

    Each table is a ball search of its own over the first bits of its fingerprint. A first pass over the fingerprints
    alone names the nodes that have a neighbour in a table. Only they travel again, with their signatures, and a pair
    is verified before it may join a cell's forest, so a group of near copies gives about as many links as it has texts.
    """
    cell_bits = min(24, max(3, (-(-rows * 4 // PER_CELL) - 1).bit_length() - 3))
    most = most_bits(similarity)
    cut = F.shiftrightunsigned(F.col("print"), BITS - TABLE_BITS)
    marked = nodes.select("node", F.posexplode("signature").alias("table", "print")).select("node", "table", cut.alias("print"))

    def met(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        prints, owners = frame["print"].to_numpy().view(np.uint64), frame["node"].to_numpy()
        distinct, at, count = np.unique(prints, return_inverse=True, return_counts=True)
        found = cell_links(distinct, int(key[1]), cell_bits, radius, TABLE_BITS)
        near = count > 1
        near[np.searchsorted(distinct, np.array(found, dtype=np.uint64).ravel())] = True
        return pd.DataFrame({"node": owners[near[at]], "table": np.int32(key[0])})

    def linked(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # In a fixed order, so that a task run again finds the same links.
        frame = frame.sort_values(["print", "node"])
        whole = np.stack(frame["signature"].to_numpy()).view(np.uint64)
        owners = frame["node"].to_numpy()
        found = verified_links(frame["print"].to_numpy().view(np.uint64), whole, int(key[1]), cell_bits, most, radius, TABLE_BITS)
        ends = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": owners[ends[:, 0]], "b": owners[ends[:, 1]]})

    near = dealt_tables(marked, cell_bits, radius).groupBy("table", "cell").applyInPandas(met, "node long, table int")
    near = settle(near.groupBy("node").agg(F.collect_set("table").alias("tables")), "simhash-near")
    again = near.withColumnRenamed("node", "_node").join(nodes, F.col("_node") == F.col("node"))
    again = again.select("node", "signature", F.explode("tables").alias("table"))
    again = again.select("*", F.shiftrightunsigned(F.get("signature", F.col("table")), BITS - TABLE_BITS).alias("print"))
    found = dealt_tables(again, cell_bits, radius).groupBy("table", "cell").applyInPandas(linked, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def group_links(marked: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) from the least node of each group of ``known`` (from ``simhash_groups``) to its other nodes."""
    group = [F.col("component_id").alias("_group"), F.when(F.col("component_id").isNull(), F.col("print")).alias("_name")]
    member = known.select(F.col("row_key").alias("_key"), *group).distinct()
    nodes = settle(marked.select("row_key", "node").distinct().join(member, F.col("row_key") == F.col("_key")).select(
        "_group", "_name", "node").distinct(), "simhash-group-nodes")
    least = nodes.groupBy(F.col("_group").alias("_g"), F.col("_name").alias("_n")).agg(F.min("node").alias("a"))
    same = F.col("_group").eqNullSafe(F.col("_g")) & F.col("_name").eqNullSafe(F.col("_n"))
    return nodes.join(least, same).where("a != node").select("a", F.col("node").alias("b"))


def similar_groups(docs: DataFrame, shingle: int = WORDS, similarity: float = SIMILARITY,
                   known: DataFrame | None = None) -> DataFrame:
    """(doc_id, row_key, node, component_id): document rows grouped over links of texts at least ``similarity`` alike.

    Null or blank text: all alike. Null doc_id, repeated rows, empty table: as in ``simhash_groups``. Texts whose
    signatures have equal 64-bit hashes count as one node. Documents that ``simhash_groups`` of the same documents, given
    as ``known``, put into one group stay in one, and links of either kind go on from there.
    """
    marked = settle(signatures(docs, shingle), "simhash-signatures")
    nodes = settle(marked.groupBy("node").agg(F.min("signature").alias("signature"), F.min("doc_id").alias("least")), "simhash-nodes")
    edges = similar_links(nodes, nodes.count(), similarity)
    if known is not None:
        edges = edges.unionByName(group_links(marked, known)).distinct()
    found = components(edges, "simhash-links")
    ids = component_ids(nodes.withColumnRenamed("node", "print").drop("signature"), found).withColumnRenamed("print", "_node")
    return marked.drop("signature").join(ids, F.col("node") == F.col("_node")).drop("_node")


def hex_of(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def keep_one(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One document of each component: the smallest doc_id's (of equal ids, the least row), columns unchanged.

    ``grouped`` comes from ``simhash_groups`` or ``similar_groups`` of the same documents.
    """
    # A component of null ids only has no id: each of its prints keeps a row.
    own = "print" if "print" in grouped.columns else "node"
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    name = F.when(F.col("component_id").isNull(), F.col(own))
    winners = grouped.groupBy("component_id", name.alias("name")).agg(F.min(first)["row_key"].alias("_winner"))
    df = beside(docs, row_key=row_key(F.col("doc_id"), text_of()))
    df = df.join(winners.select("_winner").distinct(), F.col("row_key") == F.col("_winner"))
    # Rows alike in id and text: the least by its other columns.
    return df.groupBy("row_key").agg(F.min("_row").alias("_row")).select("_row.*")
