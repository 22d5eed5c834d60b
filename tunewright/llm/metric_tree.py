"""Exact top-k search by inner product: best-first search in M-trees of metric pages.

Inner products become distances: every vector gets one more component that brings it to the greatest length of all, a
query gets zero there; the nearest vectors are then those of highest inner product. Vectors go to the nearest of a
bounded sample of routing vectors; the vectors of one routing vector are split into blocks of bounded size, so no
region, however crowded, lands in one task. Each block becomes a tree of pages: entries with a covering radius and the
distance to the parent. A search visits pages in the order of their lower bounds and skips an entry without computing
its distance where the stored distances and the triangle inequality rule it out. Pruning is by bounds with a margin
for rounding; scores are exact integers.

Every query first searches a block near it; the score found there prunes the regions it has to visit afterwards. All
other (query, region) pairs are grouped by (block, share of the queries) and searched where the block's pages are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunewright.llm.common import beside
from tunewright.session import settle

TOP = 5
#: Vectors per block (tree) that the number of blocks is chosen for, queries per share, entries per page.
BLOCK_ROWS, SHARE_ROWS, PAGE = 4_096, 4_096, 128
#: Routing vectors at most: a bounded sample. More vectors than this many blocks hold make more blocks per region.
REGIONS = 256


def scaled(embedding: Column) -> Column:
    """floor(256 * x) of each component as long; null for a vector that takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(embedding.isNotNull() & ~F.coalesce(bad, F.lit(False)),
                  F.transform(embedding, lambda x: F.floor(x.cast("double") * 256)))


def matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    out = np.zeros((len(column), dims), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the component that brings each to length ``sqrt(longest)``."""
    real = rows.astype(np.float64)
    rest = np.maximum(longest - np.einsum("ij,ij->i", real, real), 0.0)
    return np.hstack([real, np.sqrt(rest)[:, None]])


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    gap = points - to
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


# ---- pages ----

PAGE_SCHEMA = "block long, node int, leaf boolean, ids array<long>, vectors binary, radii binary, to_parent binary"


def build_pages(ids: np.ndarray, rows: np.ndarray, longest: float, page: int = PAGE) -> list[dict]:
    """Pages of one tree, the root first. ``ids`` of an inner page are page numbers, of a leaf vector ids.

    Entries of a page: vector (of an inner entry: its routing vector, a member of the subtree), covering radius, and
    distance to the routing vector of the page's own entry in the parent (zero in the root).
    """
    points = lifted(rows, longest)
    pages: list[dict] = []

    def add(members: np.ndarray, routing: np.ndarray | None) -> int:
        number = len(pages)
        pages.append({})
        from_parent = lambda chosen: np.zeros(len(chosen)) if routing is None else distances(points[chosen], routing)
        if len(members) <= page:
            pages[number] = {"leaf": True, "ids": ids[members], "rows": rows[members], "radii": np.zeros(len(members)),
                             "to_parent": from_parent(members)}
            return number
        # Routing vectors evenly spread over the members' order; each member goes to the nearest.
        ways = min(page, -(-2 * len(members) // page))
        chosen = members[np.linspace(0, len(members) - 1, ways).astype(np.int64)]
        square = np.einsum("ij,ij->i", points[chosen], points[chosen])
        nearest = np.argmin(square[None, :] - 2 * (points[members] @ points[chosen].T), axis=1)
        parts = [members[nearest == w] for w in range(ways)]
        if max(map(len, parts)) == len(members):  # members too alike to tell apart: cut evenly
            parts = np.array_split(members, ways)
        parts = [p for p in parts if len(p)]
        heads = np.array([p[0] for p in parts])
        for w, p in enumerate(parts):  # the head is the member nearest to the middle
            heads[w] = p[np.argmin(distances(points[p], points[p].mean(axis=0)))]
        radii = np.array([distances(points[p], points[h]).max() for p, h in zip(parts, heads, strict=True)])
        children = [add(p, points[h]) for p, h in zip(parts, heads, strict=True)]
        pages[number] = {"leaf": False, "ids": np.array(children), "rows": rows[heads], "radii": radii,
                         "to_parent": from_parent(heads)}
        return number

    if len(ids):
        add(np.arange(len(ids)), None)
    return pages


def search(pages: dict[int, dict], query: np.ndarray, own: int, top: int, best: list[tuple[int, int]],
           longest: float) -> list[tuple[int, int]]:
    """Best-first search of one tree; ``best`` holds (score, -id) pairs, at most ``top``, and is improved."""
    best = sorted(best)
    wide = np.append(query.astype(np.float64), 0.0)
    square = float(wide @ wide)
    slack = 1e-9 * (1.0 + square + longest)

    def reach() -> float:
        """Distance beyond which nothing can enter the list; ties must still be seen."""
        return np.inf if len(best) < top else np.sqrt(max(square + longest - 2.0 * best[0][0], 0.0) + slack) + slack

    limit = reach()
    queue: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
    while queue:
        bound, number, to_head = heapq.heappop(queue)
        if bound > limit:
            break
        node = pages[number]
        keep = np.arange(len(node["ids"]))
        if to_head >= 0 and limit < np.inf:
            # |d(query, head) - d(head, entry)| - radius bounds the distance to anything below the entry.
            keep = np.flatnonzero(np.abs(to_head - node["to_parent"]) - node["radii"] <= limit + slack)
            if not len(keep):
                continue
        if node["leaf"]:
            keep = keep[node["ids"][keep] != own]
            scores = node["rows"][keep] @ query
            if len(best) == top:
                near = scores >= best[0][0]
                keep, scores = keep[near], scores[near]
            if len(keep) > top:
                order = np.lexsort((node["ids"][keep], -scores))[:top]
                keep, scores = keep[order], scores[order]
            for vec_id, score in zip(node["ids"][keep].tolist(), scores.tolist(), strict=True):
                if len(best) < top:
                    best.append((score, -vec_id))
                    best.sort()
                elif (score, -vec_id) > best[0]:
                    best[0] = (score, -vec_id)
                    best.sort()
            limit = reach()
        else:
            far = distances(node["points"][keep], wide)
            lower = np.maximum(far - node["radii"][keep] - slack, 0.0)
            for entry, least, to_entry in zip(keep.tolist(), lower.tolist(), far.tolist(), strict=True):
                if least <= limit:
                    heapq.heappush(queue, (max(least, bound), int(node["ids"][entry]), to_entry))
    return best


# ---- jobs ----

def prepared(vectors: DataFrame, id_name: str, vector_name: str) -> DataFrame:
    df = beside(vectors, vec_id=F.col(f"`{id_name}`").cast("long"), vec=scaled(F.col(f"`{vector_name}`")))
    return df.filter(F.col("vec").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "vec")


def top_k(vectors: DataFrame, is_query: Column, top: int = TOP, id_name: str = "vec_id",
          vector_name: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` highest integer inner products of each query.

    ``is_query`` is a condition on ``vec_id``. A vector that is null or holds null or non-finite components takes no
    part, nor does one without id. Rows with a query's own id are no candidates of it; of repeated query rows one is
    asked; repeated candidates count as often as they occur. Shorter vectors are filled up with zeros. Ties go to the
    smaller id. Empty table: empty result. Further columns are not carried.
    """
    spark = vectors.sparkSession
    known = settle(prepared(vectors, id_name, vector_name), "tree-vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = known.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"), F.max(square).alias("longest")).first()
    n, dims, longest = size["n"], size["dims"] or 0, size["longest"] or 0.0
    # Blocks by rows and by bytes per row: a block stays bounded for long vectors as well.
    block_rows = max(PAGE, min(BLOCK_ROWS, 2 ** 22 // max(dims, 1)))
    regions = max(1, min(REGIONS, -(-n // block_rows)))
    # A bounded sample in a random but fixed order.
    sample = known.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(regions).toPandas()
    heads = spark.sparkContext.broadcast(lifted(matrix(sample["vec"], dims), longest))

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points = heads.value
        squares = np.einsum("ij,ij->i", points, points)
        for batch in batches:
            own = lifted(matrix(batch["vec"], dims), longest)
            region = np.argmin(squares[None, :] - 2 * (own @ points.T), axis=1)
            yield batch.assign(region=region, far=distances(own, points[region]))

    placed = settle(known.mapInPandas(routed, "vec_id long, vec array<long>, region long, far double"), "tree-regions")
    # At most REGIONS rows.
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("radius")).toPandas()
    blocks = {int(r): max(1, -(-int(k) // block_rows)) for r, k in zip(sizes["region"], sizes["rows"], strict=True)}
    radius = {int(r): float(x) for r, x in zip(sizes["region"], sizes["radius"], strict=True)}
    most = max(blocks.values(), default=1)
    split = F.element_at(F.create_map(*[F.lit(x) for r, b in blocks.items() for x in (r, b)] or [F.lit(0), F.lit(1)]), F.col("region").cast("int"))
    within = F.pmod(F.xxhash64("vec_id", F.lit("block")), split)
    placed = placed.withColumn("block", F.col("region") * most + within)

    def paged(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        pages = build_pages(frame["vec_id"].to_numpy(), matrix(frame["vec"], dims), longest)
        return pd.DataFrame([{
            "block": key[0], "node": number, "leaf": p["leaf"], "ids": p["ids"], "vectors": p["rows"].astype("<i8").tobytes(),
            "radii": p["radii"].tobytes(), "to_parent": p["to_parent"].tobytes()} for number, p in enumerate(pages)])

    index = settle(placed.select("block", "vec_id", "vec").groupBy("block").applyInPandas(paged, PAGE_SCHEMA), "tree-pages")
    queries = settle(placed.filter(is_query).dropDuplicates(["vec_id", "vec"]).select(
        F.col("vec_id").alias("query_id"), "vec", "block", F.xxhash64("vec").alias("query_key")), "tree-queries")
    shares = max(1, -(-queries.count() // SHARE_ROWS))

    def found(key: tuple, pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        tree = {}
        for p in pages.itertuples():
            rows = np.frombuffer(p.vectors, dtype="<i8").reshape(len(p.ids), dims)
            tree[p.node] = {"leaf": p.leaf, "ids": np.asarray(p.ids), "rows": rows, "radii": np.frombuffer(p.radii),
                            "to_parent": np.frombuffer(p.to_parent), "points": None if p.leaf else lifted(rows, longest)}
        out = []
        wanted = matrix(asked["vec"], dims)
        for i, (query_id, query_key, least) in enumerate(zip(asked["query_id"], asked["query_key"], asked["least"], strict=True)):
            # Scores known from elsewhere only prune: entries that no id can beat on a tie.
            floor = [] if least is None or pd.isna(least) else [(int(least), -(2 ** 63 - 1))] * top
            best = search(tree, wanted[i], query_id, top, floor, longest) if tree else []
            out += [(query_id, query_key, -m, s) for s, m in best if m != -(2 ** 63 - 1)]
        return pd.DataFrame(out, columns=["query_id", "query_key", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        """Hits of (query, block) rows; ``least`` is a score already reached by ``top`` candidates."""
        share = F.pmod(F.xxhash64("query_id", "query_key"), F.lit(shares))
        by_query = asked.withColumn("share", share).groupBy("block", "share")
        copies = index.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
        return copies.groupBy("block", "share").cogroup(by_query).applyInPandas(
            found, "query_id long, query_key long, vec_id long, score long")

    near = settle(searched(queries.withColumn("least", F.lit(None).cast("long"))), "tree-near")
    reached = near.groupBy("query_id", "query_key").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("hits"))
    ready = queries.join(reached.select(
        F.col("query_id").alias("_id"), F.col("query_key").alias("_key"), F.when(F.col("hits") >= top, F.col("least")).alias("least")),
        (F.col("query_id") == F.col("_id")) & (F.col("query_key") == F.col("_key")), "left").drop("_id", "_key")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Every block of each region that can hold a better candidate, but the one searched already."""
        points = heads.value
        numbers = np.array(sorted(blocks), dtype=np.int64)
        reaches = np.array([radius[int(r)] for r in numbers])
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start:start + 256]
                rows = matrix(part["vec"], dims).astype(np.float64)
                wide = np.hstack([rows, np.zeros((len(rows), 1))])
                squares = np.einsum("ij,ij->i", wide, wide)
                slack = 1e-9 * (1.0 + squares + longest)
                least = part["least"].astype("float64").to_numpy()
                limit = np.where(np.isnan(least), np.inf, np.sqrt(np.maximum(squares + longest - 2 * least, 0) + slack) + slack)
                far = np.stack([distances(wide, points[r]) for r in numbers], axis=1)
                able = far - reaches[None, :] <= (limit + slack)[:, None]
                row, at = np.nonzero(able)
                counts = np.array([blocks[int(r)] for r in numbers])[at]
                row = np.repeat(row, counts)
                block = np.concatenate([np.arange(c) for c in counts]) + np.repeat(numbers[at], counts) * most if len(at) else at
                keep = block != part["block"].to_numpy()[row]
                yield part.iloc[row[keep]].assign(block=block[keep])

    far_asked = ready.select("query_id", "vec", "block", "query_key", "least").mapInPandas(
        spread, "query_id long, vec array<long>, block long, query_key long, least long")
    hits = near.unionByName(searched(far_asked))
    order = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score")
