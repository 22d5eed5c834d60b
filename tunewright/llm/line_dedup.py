"""Line dedup: a long line found in many documents stays in one of them only.

Lines become 128-bit hashes, range-partitioned by (hash, document), so the lines of one document and hash stand
together and a hash with a third of all lines spans many partitions. Each partition is sorted by document and position
and read once in that order: of every (hash, document) only its first line goes on. Their sums per hash give
the number of documents and the one that keeps it. The result is a keep bitmap per document, compressed to runs; texts
never travel through the line exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunewright.llm.common import BLANKS, ascii_lower, beside, row_key, text_of, with_results
from tunewright.session import settle

LEAST_CHARS = 40
LEAST_DOCS = 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(line hash, doc_id, row key, position) of every line whose key is long enough."""
    df = beside(docs, doc_id=F.col("doc_id"), text=text_of())
    df = df.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
                   F.posexplode(F.split("text", "\n")).alias("position", "line"))
    df = df.withColumn("line", F.btrim("line", F.lit(BLANKS))).filter(F.length("line") >= least_chars)
    return df.select(F.unhex(F.md5(ascii_lower(F.col("line")))).alias("hash"), "doc_id", "row_key", "position")


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(row_key, dropped): for each document row that loses lines, the places of those lines, rising.

    A line stays in the largest doc_id that holds it, in all its places there. A null doc_id is a document of its
    own, smaller than any other. ``apply_bitmaps`` turns the places into runs of kept lines.
    """
    lines = settle(long_lines(docs, least_chars), "line-hashes")
    ranged = lines.select("hash", "doc_id", "position").repartitionByRange("hash", "doc_id")
    # The ranges hold each (hash, document) in one partition: the window sorts there, without an exchange.
    in_order = Window.partitionBy("hash", "doc_id").orderBy("position")
    firsts = ranged.withColumn("nth", F.row_number().over(in_order)).filter("nth = 1")
    common = firsts.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
    # Written first: a join of two plain exchanges is one that adaptive execution can split at a hot line.
    common = settle(common.filter(F.col("docs") >= least_docs).select(F.col("hash").alias("_hash"), "keeper"), "common-lines")
    lost = lines.join(common, F.col("hash") == F.col("_hash")).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("row_key").agg(F.sort_array(F.collect_set("position")).alias("dropped"))


def runs(dropped: Column, n_lines: Column) -> Column:
    """The keep bitmap as runs (start, length) of kept lines between the dropped ones."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines.cast("int")))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(edges) - 2),
        lambda j: F.struct((F.get(edges, j) + 1).alias("start"),
                           (F.get(edges, j + 1) - F.get(edges, j) - 1).alias("length")))
    return F.filter(gaps, lambda run: run["length"] > 0)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``_row``, kept text, n_lines, n_dropped and the keep runs of every document."""
    # The text travels once, inside its row.
    df = beside(docs, row_key=row_key(F.col("doc_id"), text_of()))
    lost = bitmaps.select(F.col("row_key").alias("_key"), "dropped")
    df = df.join(lost, F.col("row_key") == F.col("_key"), "left").select(
        "_row", text_of("_row", "text").alias("text"), "dropped")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    df = df.select("_row", "text", n_lines.cast("long").alias("n_lines"),
                   F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
    df = df.select("_row", "text", "n_lines", F.size("dropped").cast("long").alias("n_dropped"),
                   runs(F.col("dropped"), F.col("n_lines")).alias("keep"), F.split("text", "\n").alias("_lines"))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice("_lines", r["start"] + 1, r["length"]))), "\n")
    return df.select("_row", "n_lines", "n_dropped", "keep",
                     F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept).alias("kept_text"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents' columns with n_lines, n_dropped, keep (runs of kept lines) and kept_text.

    Null or empty text: one empty line, kept. Repeated rows: one document, so each row gets the same lines. Empty
    table: empty result. An input column named like a result is replaced by the result.
    """
    out = apply_bitmaps(docs, keep_bitmaps(docs))
    return out.select(*with_results(docs.columns, {c: F.col(c) for c in ("n_lines", "n_dropped", "keep", "kept_text")}))
