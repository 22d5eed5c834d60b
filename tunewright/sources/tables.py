"""Persisted results: vectors, text index, fitted ranker. An absent table reads as None."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tunewright.functions import fixed
from tunewright.operators import boosting
from tunewright.operators.boosting import Ranker


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_vectors(path: str, **tables: DataFrame) -> None:
    """Song, artist and user vectors, one Parquet table each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_vectors(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    return read_if_present(spark, f"{path}/{name}")


def write_through(table: DataFrame, path: str) -> DataFrame:
    """Write a table and go on from the written copy."""
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def write_postings(postings: DataFrame, path: str, key: str = "song_id") -> None:
    """Postings laid out by (term, document) ranges.

    A term lookup skips files by their min/max, and a term found in a third of
    all documents still spans many files.
    """
    placed = postings.repartitionByRange("term", key).sortWithinPartitions("term", key)
    placed.write.mode("overwrite").parquet(path)


def read_text_index(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    parts = {n: read_if_present(spark, f"{path}/{n}") for n in ("vocabulary", "documents", "blocks", "postings")}
    return None if any(p is None for p in parts.values()) else parts


def save_model(model: Ranker, path: str) -> None:
    """Fitted ranker, one row per node, plus the feature order it expects."""
    boosting.to_table(model).write.mode("overwrite").parquet(f"{path}/model")
    meta = json.dumps({"feature_columns": model.features, "n_components": fixed.MAX_COMPONENTS})
    SparkSession.active().createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[Ranker, dict] | None:
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return boosting.from_table(spark.read.schema(boosting.NODES).parquet(f"{path}/model"), meta["feature_columns"]), meta
