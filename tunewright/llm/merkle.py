"""Merkle manifest of a dataset: a tree of hashes per source, a tree over the sources, a proof per document.

Documents get their exact place within their source first (range partitions and the sizes of those before). Per level,
windows over the runs of FAN nodes give each node the hashes before and after it in its run, from lag and lead columns of
fixed offsets that are masked by slot and run length; the first node of a run hashes the run to its parent. A level has
one FAN-th of the nodes below it. Proofs go down again: a node has its own siblings and its parent's path, joined by
(group, parent), so a run is all that ever meets in one window and no source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunewright.functions.ordering import rank_in_buckets
from tunewright.llm.common import ascii_lower
from tunewright.session import settle

#: Children of a node; part of the definition of a digest.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One document in so many is altered by ``tampered_text``.
EVERY = 5


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(F.concat(*[field(c) for c in columns.values()]))


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where EVERY divides the checksum of the id, else null."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % EVERY == 0, ascii_lower(text))


def group_of(source: Column) -> Column:
    """A name that is never null and sorts like the source, null first."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit(""))


def placed(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Adds ``idx`` (from 0 within ``grp``, in the given order) and ``size`` of the group; ``rows`` are written ones.

    Rows are dealt by ranges of (grp, order), so a large group lies in many ranges; a range is ranked by itself and the
    sizes of those before it are added.
    """
    dealt = settle(rows.repartitionByRange("grp", *order).withColumn("part", F.spark_partition_id()), f"{label}-ranges")
    ranked = rank_in_buckets(dealt, ["grp"], F.col("part"), [F.col(c).asc_nulls_first() for c in order], "place", "size")
    idx = (F.col("place") - 1).cast("long")
    return settle(ranked.select(*[c for c in rows.columns if c not in order[1:]], idx.alias("idx"), F.col("size").cast("long").alias("size"),
                                F.floor(idx / FAN).alias("parent")), f"{label}-nodes")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds ``left`` and ``right``: the hashes before and after each node in its run, as one string each."""
    run = Window.partitionBy("grp", "parent").orderBy("idx")
    slot = F.col("idx") % FAN
    length = F.least(F.lit(FAN), F.col("size") - F.col("parent") * FAN)
    before = [F.when(slot >= k, F.lag("hash", k).over(run)) for k in range(FAN - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("hash", k).over(run)) for k in range(1, FAN)]
    return nodes.select("*", F.concat_ws("", *before).alias("left"), F.concat_ws("", *after).alias("right"))


def climbed(nodes: DataFrame, label: str) -> list[DataFrame]:
    """The levels (grp, idx, size, parent, hash) from ``nodes`` up to one node per group, each written.

    The number of levels is the logarithm of the largest group; a group that is down to one node keeps it as it is.
    """
    levels = [nodes]
    size = nodes.agg(F.max("size")).first()[0] or 1
    while size > 1:
        first = with_siblings(levels[-1]).where(F.col("idx") % FAN == 0)
        folded = F.when(F.col("size") > 1, digest(F.concat("hash", "right"))).otherwise(F.col("hash"))
        up = first.select("grp", F.col("parent").alias("idx"), F.ceil(F.col("size") / FAN).alias("size"),
                          F.floor(F.col("parent") / FAN).alias("parent"), folded.alias("hash"))
        levels.append(settle(up, f"{label}-level-{len(levels)}"))
        size = -(-size // FAN)
    return levels


def descended(levels: list[DataFrame], tops: DataFrame, label: str) -> DataFrame:
    """The lowest level with ``lefts``, ``rights`` (its path, nearest first, then that of ``tops``) and ``top``.

    ``tops`` gives (grp, lefts, rights) for what follows above each group's last node.
    """
    paths = levels[-1].select("*", F.col("hash").alias("top")).join(tops, "grp")
    for depth in range(len(levels) - 2, -1, -1):
        above = paths.select("grp", F.col("idx").alias("parent"), "lefts", "rights", "top")
        own = with_siblings(levels[depth])
        more = F.col("size") > 1
        paths = own.join(above, ["grp", "parent"]).select(
            *levels[depth].columns, "top",
            *[F.when(more, F.concat(F.array(one), many)).otherwise(F.col(many)).alias(many)
              for one, many in (("left", "lefts"), ("right", "rights"))])
        if depth:
            paths = settle(paths, f"{label}-path-{depth}")
    return paths


def proofs(leaves: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of (grp, doc_id, leaf, claimed).

    ``folded_root`` is recomputed from ``claimed`` (the leaf, where that is null) and the siblings of the tree of ``leaf``.
    Leaves of a group are ordered by doc_id, null first, and those of one doc_id by leaf.
    """
    rows = settle(leaves.select("grp", "doc_id", F.col("leaf").alias("hash"), "claimed", F.monotonically_increasing_id().alias("row")),
                  "merkle-leaves")
    ordered = rows.select("grp", "doc_id", "hash", "row", "claimed", F.col("doc_id").alias("id"), F.col("hash").alias("leaf"))
    nodes = placed(ordered, ["doc_id", "hash", "row"], "documents")
    nodes = nodes.select("grp", "idx", "size", "parent", F.col("leaf").alias("hash"), "id", "claimed")
    levels = climbed(nodes, "documents")
    subroots = levels[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("hash").alias("subroot"))
    roots = placed(settle(subroots.withColumn("by", F.col("name")), "subroots"), ["by"], "sources")
    tree = climbed(roots.select("grp", "idx", "size", "parent", F.col("subroot").alias("hash"), "name"), "sources")
    nothing = F.array().cast("array<string>")
    ends = tree[-1].select("grp", nothing.alias("lefts"), nothing.alias("rights"))
    over = descended(tree, ends, "sources").select(F.col("name").alias("grp"), "lefts", "rights", F.col("top").alias("root"))
    over = settle(over, "source-paths")
    paths = descended(levels, over.select("grp", "lefts", "rights"), "documents")
    # One value for the whole table.
    root = over.agg(F.max("root")).first()[0]
    steps = F.arrays_zip("lefts", "rights")
    folded = F.aggregate(steps, F.coalesce("claimed", "hash"),
                         lambda h, s: digest(F.concat(s["lefts"], h, s["rights"])))
    siblings = F.array_join(F.transform(steps, lambda s: F.concat(s["lefts"], s["rights"])), "")
    return paths.select(F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), F.col("top").alias("subroot"),
                        F.lit(root).cast("string").alias("root"), digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf covers doc_id, source, lang, n_chars and text; nulls have a leaf of their own. ``tampered`` is a text to
    recompute the root from instead of the document's (null: the document as it is); ``verified`` says whether that gives
    the root. Null source: a group of its own, the first. Null doc_id: first of its source. Repeated doc_ids are ordered by
    leaf, repeated rows are leaves each. A source of one document has its leaf as subroot, a single subroot is the root.
    Empty table: empty result. Further input columns take no part, whatever their names.
    """
    parts = {name: F.col(f"`{name}`") for name in FIELDS}
    claimed = F.lit(None).cast("string")
    if tampered is not None:
        claimed = F.when(tampered.isNotNull(), leaf_of(parts | {"text": tampered}))
    leaves = docs.select(group_of(parts["source"]).alias("grp"), parts["doc_id"].cast("long").alias("doc_id"),
                         leaf_of(parts).alias("leaf"), claimed.alias("claimed"))
    return proofs(leaves).withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest, checked against the documents that ``tampered_text`` alters."""
    return manifest(docs, tampered_text(F.col("doc_id").cast("long"), F.col("text")))
