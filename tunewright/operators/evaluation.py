"""Ranking metrics per user and over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunewright import session
from tunewright.functions import fixed, ordering


def per_user_topk(scored: DataFrame, k: int, order: list[Column] | None = None, out: str = "rn") -> DataFrame:
    """The k best rows per user, numbered; ties go to the smaller ``row_ord``.

    The limit is applied before the exchange, so a user with very many rows
    sends at most k from each task.
    """
    best = Window.partitionBy("user_id").orderBy(*(order or [F.desc("score"), F.col("row_ord")]))
    return scored.withColumn(out, F.row_number().over(best)).where(F.col(out) <= k)


def dcg_discount(position: Column | str) -> Column:
    place = F.col(position) if isinstance(position, str) else position
    return F.lit(1.0) / F.log2(place + F.lit(1))


def best_gain(positives: Column, k: int) -> Column:
    """Discounted gain of a list that starts with ``positives`` hits, as far as k."""
    places = F.sequence(F.lit(1), F.greatest(F.least(positives, F.lit(k)), F.lit(1)).cast("int"))
    total = F.aggregate(places, F.lit(0.0), lambda gain, place: gain + dcg_discount(place))
    return F.when(positives > 0, total).otherwise(0.0)


def user_totals(scored: DataFrame) -> DataFrame:
    return scored.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_positive"))


def user_metrics(scored: DataFrame, k: int = fixed.FINAL_ROWS, positives: DataFrame | None = None) -> DataFrame:
    """Precision, recall and NDCG at k for every user.

    ``scored`` has ``user_id, label, score, row_ord`` with labels 0 and 1.
    ``positives(user_id, n_positive)`` counts the positives of users whose rows
    are not all in ``scored``; without it they are counted there. Precision
    divides by the rows found when there are fewer than k; recall and NDCG are
    0.0 for users without a positive.
    """
    top = per_user_topk(scored, k)
    found = top.groupBy("user_id").agg(
        F.avg(F.col("label").cast("double")).alias("precision"),
        F.sum("label").alias("hits"),
        F.sum(F.col("label") * dcg_discount("rn")).alias("dcg"))
    totals = user_totals(scored)
    if positives is not None:
        totals = totals.drop("n_positive").join(positives.select("user_id", "n_positive"), "user_id", "left").withColumn(
            "n_positive", F.coalesce("n_positive", F.lit(0)))
    joined = totals.join(found, "user_id").withColumn("idcg", best_gain(F.col("n_positive"), k))
    positive = F.col("n_positive") > 0
    return joined.select(
        "user_id", "n_rows", "n_positive", "precision",
        F.when(positive, F.col("hits") / F.col("n_positive")).otherwise(0.0).alias("recall"),
        F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def eligible_users(scored: DataFrame, k: int = fixed.FINAL_ROWS) -> DataFrame:
    """Users with at least k rows and one positive: only they enter the averages."""
    return user_totals(scored).where((F.col("n_rows") >= k) & (F.col("n_positive") > 0))


def macro_average(metrics: DataFrame, k: int = fixed.FINAL_ROWS) -> DataFrame:
    """Mean of the per-user metrics over eligible users."""
    eligible = metrics.where((F.col("n_rows") >= k) & (F.col("n_positive") > 0))
    return eligible.agg(
        F.count(F.lit(1)).alias("n_users"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))


def mean_row(metrics: DataFrame, k: int = fixed.FINAL_ROWS) -> DataFrame:
    """One row without user: rows and positives of eligible users added up, every other column averaged."""
    eligible = metrics.where((F.col("n_rows") >= k) & (F.col("n_positive") > 0))
    counts = ("n_rows", "n_positive")
    means = [c for c in metrics.columns if c not in ("user_id", *counts)]
    row = eligible.agg(*[F.sum(c).alias(c) for c in counts], *[F.avg(c).alias(c) for c in means])
    return row.withColumn("user_id", F.lit(None).cast(metrics.schema["user_id"].dataType)).select(*metrics.columns)


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve over all rows; null when one class is missing.

    Rows are first counted per distinct score. Each positive counts the
    negatives below it plus half of those at the same score.
    """
    counts = scored.groupBy("score").agg(
        F.sum(F.col("label").cast("double")).alias("pos"),
        F.sum(F.lit(1.0) - F.col("label")).alias("neg"))
    running = ordering.running_totals(session.settle(counts, "score-counts"), "score", ["neg"])
    below = F.col("neg_upto") - F.col("neg")
    totals = running.agg(
        F.sum(F.col("pos") * (below + F.col("neg") / 2)).alias("wins"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return totals.select(F.when(both, F.col("wins") / (F.col("p") * F.col("n"))).alias("auc"))


def diversity_at_k(listed: DataFrame, k: int = fixed.FINAL_ROWS) -> DataFrame:
    """Share of distinct artists among each user's first k rows."""
    return listed.where(F.col("rank") <= k).groupBy("user_id").agg(
        (F.count_distinct("artist_id") / F.count(F.lit(1))).alias("diversity"))


def novelty_at_k(listed: DataFrame, k: int = fixed.FINAL_ROWS) -> DataFrame:
    """Mean of -ln(popularity) over each user's first k rows that have a popularity above 0."""
    top = listed.where((F.col("rank") <= k) & (F.col("popularity") > 0))
    return top.groupBy("user_id").agg(F.avg(-F.log("popularity")).alias("novelty"))


def temporal_split(interactions: DataFrame, buckets: int | None = None) -> DataFrame:
    """Adds ``part``: ``train`` for the earlier half of each user's rows, else ``eval``.

    The odd row goes to the earlier half. A user's rows are ranked in buckets of
    time, cut by ``log_ord`` where one moment fills a bucket, so one very active
    user is spread over many tasks, also in a burst.
    """
    bucket = ordering.ordered_buckets(interactions, F.unix_micros("ts"), F.col("log_ord"), buckets)
    ranked = ordering.rank_in_buckets(interactions, ["user_id"], bucket,
                                      [F.col("ts"), F.col("log_ord")], "position", "n_rows")
    first_half = F.col("position") * 2 <= F.col("n_rows") + 1
    return ranked.withColumn("part", F.when(first_half, "train").otherwise("eval")).drop("position", "n_rows")
