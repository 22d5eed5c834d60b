"""Shared pieces of the text operators: whole rows beside private columns, row keys, ASCII case and white space."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of words and lines: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def beside(docs: DataFrame, carry: list[str] | None = None, **columns: Column) -> DataFrame:
    """The input row (or the columns in ``carry``) in ``_row`` and the named columns next to it.

    Names of input columns can then never clash with an operator's own.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    return docs.select(whole.alias("_row"), *[c.alias(n) for n, c in columns.items()])


def text_of(*names: str) -> Column:
    """The text (a column, or a field of one), empty where it is null."""
    return F.coalesce(F.col(".".join(f"`{n}`" for n in names or ("text",))), F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a document row: equal for repeated rows, defined for null ids."""
    named = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(named, F.lit("\n"), text)))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character left alone."""
    return F.translate(text, UPPER, UPPER.lower())


def with_results(docs_columns: list[str], results: dict[str, Column]) -> list[Column]:
    """The input's columns out of ``_row`` and the results; a result replaces an input column of its name."""
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs_columns if c not in results]
    return kept + [c.alias(n) for n, c in results.items()]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application.

    As with ``--py-files``, the archive lies with the driver, which serves it; no executor reads a local path of its own.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="tunewright-code-"), "tunewright_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
