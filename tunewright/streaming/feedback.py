"""The interaction log as a stream: append, running counts, running user vectors, refit signal.

Running results live in Spark's state store and nowhere else: a stream keeps one row per user there, each micro-batch
is committed with its offsets (a repeated batch counts once), and readers take the last committed version of
the store from the stream's checkpoint. Nothing is written per batch that a reader would have to list or fold.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunewright.functions import vectors
from tunewright.operators import history
from tunewright.sources import interactions as log


def stream_interactions(rated: DataFrame, path: str, checkpoint: str, at: Column | None = None) -> StreamingQuery:
    """Append arriving ``user_id, song_id, label`` rows to Parquet, each exactly once.

    Rows of one micro-batch share a timestamp.
    """
    rows = log.interaction_rows(rated, F.current_timestamp() if at is None else at)
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# ---- running results

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keep(totals: DataFrame, checkpoint: str) -> StreamingQuery:
    """Run a streaming aggregate for its state only.

    The state is held by RocksDB, so it may outgrow an executor's heap. A query takes the session's setting
    when it starts, so the setting is put back at once. The number of state partitions is that of
    ``spark.sql.shuffle.partitions`` at the first start.
    """
    conf = totals.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            totals.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:
        if before is None:
            conf.unset(PROVIDER)
        else:
            conf.set(PROVIDER, before)


def _kept(spark: SparkSession, checkpoint: str, keys: list[str], sums: list[str]) -> DataFrame | None:
    """Keys and running sums of the last committed batch, None before the first.

    ``sums`` names the aggregates in the order in which the stream computes them.
    """
    try:
        state = spark.read.format("statestore").load(checkpoint)
    except PySparkException as missing:
        if "STDS_" not in (missing.getCondition() or "") or "COMMITTED" not in missing.getCondition():
            raise
        return None
    # Sums carry the same few names in the state; a cast of the whole row goes by place.
    types = [field.dataType.simpleString() for field in state.schema["value"].dataType.fields]
    row = ", ".join(f"`{name}`: {kind}" for name, kind in zip(sums, types, strict=True))
    return state.select(*[f"key.{k}" for k in keys], F.col("value").cast(f"struct<{row}>").alias("sums")).select(*keys, "sums.*")


def stream_history_counts(interactions: DataFrame, checkpoint: str) -> StreamingQuery:
    """Running likes and skips per user, see ``latest_counts``."""
    return _keep(history.history_counts(interactions), checkpoint)


def latest_counts(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """``user_id, likes, skips`` after the last finished batch; None before the first."""
    return _kept(spark, checkpoint, ["user_id"], ["likes", "skips"])


def stream_user_embedding(interactions: DataFrame, song_vectors: DataFrame, checkpoint: str) -> StreamingQuery:
    """Running sum of liked vectors and their number per user, see ``read_user_embedding``.

    One scalar sum per dimension: likes are summed before they are exchanged, so a very active user sends one row per task.
    Vectors must keep their length over the life of the stream.
    """
    dim = vectors.dimension(song_vectors, "embedding")
    pairs = log.liked(interactions).select("user_id", "song_id").join(song_vectors.select("song_id", "embedding"), "song_id")
    sums = [F.sum(F.get("embedding", F.lit(i))).alias(f"sum_{i}") for i in range(dim)]
    return _keep(pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_liked"), *sums), checkpoint)


def read_user_embedding(spark: SparkSession, checkpoint: str, dim: int) -> DataFrame | None:
    """User vectors of length ``dim`` over all finished batches; equal to the batch result without a blend."""
    sums = [f"sum_{i}" for i in range(dim)]
    state = _kept(spark, checkpoint, ["user_id"], ["n_liked", *sums])
    if state is None:
        return None
    mean = F.array(*[F.col(c) / F.col("n_liked") for c in sums]) if sums else F.array().cast("array<double>")
    return state.select("user_id", vectors.tagged(mean, "embedding", dim), "n_liked")


def stream_refit_signal(interactions: DataFrame, checkpoint: str) -> StreamingQuery:
    """Running number of interactions, for ``refit_due``."""
    return _keep(interactions.groupBy().agg(F.count(F.lit(1)).alias("n_seen")), checkpoint)


def refit_due(spark: SparkSession, checkpoint: str, threshold: int, fitted_rows: int = 0) -> DataFrame:
    """``n_new, due``: interactions beyond the ``fitted_rows`` of the last fit, and whether they reach the threshold."""
    state = _kept(spark, checkpoint, [], ["n_seen"])
    if state is None:
        state = spark.range(0).select(F.col("id").alias("n_seen"))
    new = state.agg((F.coalesce(F.sum("n_seen"), F.lit(0)) - F.lit(fitted_rows)).alias("n_new"))
    return new.withColumn("due", F.col("n_new") >= threshold)
