"""Queries over training rows, the fitted ranker, metrics and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tunewright import session
from tunewright.functions import fixed, vectors
from tunewright.operators import embeddings, evaluation, ranking, training
from tunewright.plans import jobs
from tunewright.plans.catalog_queries import brand_vectors, users
from tunewright.plans.oracle import check
from tunewright.plans.register import query
from tunewright.plans.vector_queries import pool_features, rank
from tunewright.sources import bindings as b
from tunewright.sources import tables
from tunewright.streaming import feedback

FEATURES = tuple(fixed.FEATURES)


def training_rows(spark, sf):
    by_brand = embeddings.artist_embedding(brand_vectors(spark, sf))
    return training.training_set(b.interactions(spark, sf), b.songs(spark, sf), b.song_vectors(spark, sf), by_brand, b.as_of())


def judged(spark, sf):
    """Logged rows with a score that needs no model, ties included."""
    value = b.table(spark, sf, "events").select(F.col("event_id").alias("row_ord"), F.round("value", 1).alias("score"))
    rows = b.interactions(spark, sf).select("user_id", "label", F.col("log_ord").alias("row_ord"))
    return rows.join(value, "row_ord")


@query("training_set", check("SELECT user_id, song_id, label, log_ord, " + ", ".join(FEATURES) + " FROM training", "training"),
       doubles=FEATURES, wholes=("label",))
def training_set(spark, sf):
    return training_rows(spark, sf)


@query("known_songs_only", """
  SELECT l_orderkey AS user_id, l_linenumber AS line, l_partkey AS song_id FROM lineitem
  WHERE l_partkey IN (SELECT vec_id FROM embeddings) AND l_partkey IN (SELECT p_partkey FROM part)""", wholes=("line",))
def known_songs_only(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("user_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("song_id"))
    return training.known_songs_only(rows, b.song_vectors(spark, sf), b.songs(spark, sf))


@query("dataset_profile", check("""
  SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT song_id) AS n_songs,
    count(*) FILTER (label = 1) AS n_liked, count(*) FILTER (label = 0) AS n_skipped FROM log""", "log"))
def dataset_profile(spark, sf):
    return training.dataset_profile(b.interactions(spark, sf))


_DESCRIBE = " UNION ALL ".join(f"""
  SELECT '{c}' AS feature, count(*) AS n_rows, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min,
    round(quantile_cont({c}, 0.25), 3) AS q25, round(quantile_cont({c}, 0.5), 3) AS q50, round(quantile_cont({c}, 0.75), 3) AS q75,
    round(max({c}), 3) AS max FROM training""" for c in FEATURES)


@query("feature_profile", check(_DESCRIBE, "training"), doubles=("mean", "std", "min", "q25", "q50", "q75", "max"))
def feature_profile(spark, sf):
    return training.feature_profile(session.settle(training_rows(spark, sf), "training-rows"))


_SPLIT = f"""(SELECT *, user_id IN (SELECT user_id FROM (SELECT user_id, row_number() OVER (
    ORDER BY md5('{fixed.SEED}:' || user_id), user_id) AS place, count(*) OVER () AS n
    FROM (SELECT DISTINCT user_id FROM log)) WHERE place <= ceil({fixed.TEST_SHARE} * n)) AS is_test FROM log)"""


@query("group_split", check(f"SELECT user_id, log_ord, label, is_test FROM {_SPLIT}", "log"), wholes=("label",))
def group_split(spark, sf):
    return training.group_split(b.interactions(spark, sf).select("user_id", "log_ord", "label"))


@query("group_split_join", check("""
  SELECT user_id, log_ord, CASE WHEN c_mktsegment = 'BUILDING' THEN 'test' ELSE 'train' END AS part
  FROM log LEFT JOIN customer ON c_custkey = user_id""", "log"))
def group_split_join(spark, sf):
    picked = b.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    train, test = training.group_split_join(b.interactions(spark, sf).select("user_id", "log_ord"), picked)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query("positive_rate", check(f"""
  SELECT is_test, count(*) AS n_rows, avg(label) AS positive_rate FROM {_SPLIT} GROUP BY is_test""", "log"), doubles=("positive_rate",))
def positive_rate(spark, sf):
    return training.positive_rate(training.group_split(b.interactions(spark, sf)))


@query("class_weights", check("""
  SELECT label, (SELECT count(*) FROM log) / (2.0::DOUBLE * count(*)) AS weight FROM log GROUP BY label""", "log"),
       doubles=("weight",), wholes=("label",))
def class_weights(spark, sf):
    return training.class_weights(b.interactions(spark, sf))


_models: dict = {}


def _fitted(spark, sf):
    """Training rows and one ranker fitted on them, shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _models:
        rows = session.settle(training_rows(spark, sf), "training-rows")
        _models[key] = rows, training.train_ranker(rows)
    return _models[key]


@query("train_ranker", check("SELECT label, count(*) AS n_rows, TRUE AS trees_fit FROM training GROUP BY label", "training"),
       wholes=("label",))
def train_ranker(spark, sf):
    rows, model = _fitted(spark, sf)
    fits = 1 <= len(model.trees) <= fixed.TREES and all(t.leaves() <= fixed.LEAVES for t in model.trees)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("trees_fit", F.lit(fits))


@query("score_model", check("SELECT user_id, song_id, log_ord, TRUE AS is_share FROM training", "training"))
def score_model(spark, sf):
    rows, model = _fitted(spark, sf)
    return ranking.score_model(rows, model).select(
        "user_id", "song_id", "log_ord", F.col("score").between(0.0, 1.0).alias("is_share"))


@query("rank_with_model", check("SELECT user_id, count(*) AS n_ranked, TRUE AS falling FROM pool_ranked GROUP BY user_id", "pool_ranked"))
def rank_with_model(spark, sf):
    """Lists by the model: as long as by the weights, scores falling from 1 to 0 at most."""
    ranked = ranking.rank(pool_features(spark, sf), _fitted(spark, sf)[1])
    scores = F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda r: r["score"])
    # At most RANKED_ROWS scores per user.
    lists = ranked.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_ranked"), scores.alias("scores"))
    falling = F.forall(F.sequence(F.lit(0), F.size("scores") - 1), lambda i: F.get("scores", i).between(
        F.coalesce(F.get("scores", i + 1), F.lit(0.0)), F.lit(1.0)))
    return lists.select("user_id", "n_ranked", falling.alias("falling"))


_NAMES = ", ".join(f"('{c}')" for c in FEATURES)


@query("feature_importance", f"SELECT feature, 1.0 AS total, TRUE AS positive FROM (VALUES {_NAMES}) AS f(feature)", doubles=("total",))
def feature_importance(spark, sf):
    """Each feature with the sum over all of them."""
    table = training.feature_importance(_fitted(spark, sf)[1])
    total = table.agg(F.sum("importance").alias("total"))
    # One row.
    return table.join(F.broadcast(total)).select("feature", "total", (F.col("importance") >= 0).alias("positive"))


@query("importance_sort", f"SELECT row_number() OVER () AS place, TRUE AS falling FROM (VALUES {_NAMES}) AS f(feature)")
def importance_sort(spark, sf):
    table = training.feature_importance(_fitted(spark, sf)[1])
    from pyspark.sql import Window
    # Six rows, one per feature, numbered as they come.
    order = Window.orderBy(F.monotonically_increasing_id())
    numbered = table.coalesce(1).withColumn("place", F.row_number().over(order))
    return numbered.select("place", F.coalesce(
        F.lag("importance").over(Window.orderBy("place")) >= F.col("importance"), F.lit(True)).alias("falling"))


@query("save_model", check(f"SELECT count(*) AS n_rows, 0.0 AS difference, '{','.join(FEATURES)}' AS features FROM training", "training"),
       doubles=("difference",))
def save_model(spark, sf):
    """Largest difference between the scores of the model and of the one read back."""
    path = session.shared_path(spark, "ranker")
    rows, model = _fitted(spark, sf)
    tables.save_model(model, path)
    loaded, meta = tables.load_model(spark, path)
    both = ranking.score_model(ranking.score_model(rows, model).withColumnRenamed("score", "before").select(
        *FEATURES, "before"), loaded)
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("score") - F.col("before"))).alias("difference")).withColumn(
        "features", F.lit(",".join(meta["feature_columns"])))


@query("train_and_evaluate", check(f"""
  SELECT count(*) AS n_users, TRUE AS within FROM (
    SELECT t.user_id FROM training t JOIN (
        SELECT user_id, row_number() OVER (ORDER BY md5('{fixed.SEED}:' || user_id), user_id) AS place, count(*) OVER () AS n
        FROM (SELECT DISTINCT user_id FROM training)) u ON u.user_id = t.user_id
    WHERE place <= ceil({fixed.TEST_SHARE} * n)
    GROUP BY t.user_id HAVING count(*) >= 10 AND sum(label) > 0)""", "training"))
def train_and_evaluate(spark, sf):
    """Users that enter the averages, and whether all averages are shares."""
    by_brand = embeddings.artist_embedding(brand_vectors(spark, sf))
    report = jobs.train_and_evaluate(b.interactions(spark, sf), b.songs(spark, sf), b.song_vectors(spark, sf),
                                     by_brand, b.as_of())["report"]
    shares = [F.col(c).between(0.0, 1.0) for c in ("precision", "recall", "ndcg", "auc")]
    return report.select("n_users", (shares[0] & shares[1] & shares[2] & shares[3]).alias("within"))


# ---- metrics

@query("per_user_topk", check("SELECT user_id, row_ord, score, rn FROM metrics_rn WHERE rn <= 10", "metrics_rn"), doubles=("score",))
def per_user_topk(spark, sf):
    return evaluation.per_user_topk(judged(spark, sf), 10).select("user_id", "row_ord", "score", "rn")


@query("dcg_discount", check("SELECT user_id, row_ord, label / log2(rn + 1) AS gain FROM metrics_rn WHERE rn <= 10", "metrics_rn"),
       doubles=("gain",))
def dcg_discount(spark, sf):
    return evaluation.per_user_topk(judged(spark, sf), 10).select(
        "user_id", "row_ord", (F.col("label") * evaluation.dcg_discount("rn")).alias("gain"))


@query("ideal_rank", check("SELECT user_id, ideal, label FROM metrics_rn WHERE ideal <= 10", "metrics_rn"), wholes=("label",))
def ideal_rank(spark, sf):
    return evaluation.per_user_topk(judged(spark, sf), 10, [F.desc("label")], "ideal").select("user_id", "ideal", "label")


def _metric(name, column):
    @query(name, check(f"SELECT user_id, {column} FROM metrics", "metrics"), doubles=(column,))
    def build(spark, sf):
        return evaluation.user_metrics(judged(spark, sf)).select("user_id", column)


_metric("precision_at_k", "precision")
_metric("recall_at_k", "recall")
_metric("ndcg_at_k", "ndcg")


@query("eligible_users", """
  SELECT o_custkey AS user_id, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'P') AS n_positive FROM orders
  GROUP BY o_custkey HAVING count(*) >= 10 AND count(*) FILTER (o_orderstatus = 'P') > 0""")
def eligible_users(spark, sf):
    rows = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("label"))
    return evaluation.eligible_users(rows)


@query("macro_average", check("""
  SELECT count(*) AS n_users, avg(precision) AS precision, avg(recall) AS recall, avg(ndcg) AS ndcg FROM metrics
  WHERE n_rows >= 10 AND n_positive > 0""", "metrics"), doubles=("precision", "recall", "ndcg"))
def macro_average(spark, sf):
    return evaluation.macro_average(evaluation.user_metrics(judged(spark, sf)))


@query("auc", check("""
  SELECT sum(CASE WHEN label = 1 THEN below + same / 2.0::DOUBLE END)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))::DOUBLE AS auc
  FROM (SELECT label, coalesce(sum(1 - label) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
      - sum(1 - label) OVER (PARTITION BY score) AS below, sum(1 - label) OVER (PARTITION BY score) AS same FROM judged)""",
    "judged"), doubles=("auc",))
def auc(spark, sf):
    return evaluation.auc(judged(spark, sf))


@query("diversity_at_k", check("""
  SELECT user_id, count(DISTINCT artist_id) / count(*) AS diversity FROM pool_ranked JOIN songs USING (song_id)
  WHERE rank <= 10 GROUP BY user_id""", "pool_ranked", "songs"), doubles=("diversity",))
def diversity_at_k(spark, sf):
    listed = rank(spark, sf).join(b.songs(spark, sf).select("song_id", "artist_id"), "song_id")
    return evaluation.diversity_at_k(listed)


@query("novelty_at_k", check("""
  SELECT user_id, avg(-ln(popularity)) AS novelty FROM pool_ranked WHERE rank <= 10 AND popularity > 0 GROUP BY user_id""",
    "pool_ranked"), doubles=("novelty",))
def novelty_at_k(spark, sf):
    return evaluation.novelty_at_k(rank(spark, sf))


@query("temporal_split", check("""
  SELECT user_id, log_ord, CASE WHEN ntile(2) OVER (PARTITION BY user_id ORDER BY ts, log_ord) = 1 THEN 'train' ELSE 'eval' END AS part
  FROM log""", "log"))
def temporal_split(spark, sf):
    return evaluation.temporal_split(b.interactions(spark, sf)).select("user_id", "log_ord", "part")


@query("evaluate_all_users", check("""
  SELECT * FROM half_metrics
  UNION ALL SELECT NULL, CAST(sum(n_rows) AS BIGINT), CAST(sum(n_positive) AS BIGINT), avg(precision), avg(recall), avg(ndcg),
    avg(diversity), avg(novelty) FROM half_metrics WHERE n_rows >= 10 AND n_positive > 0""", "half_metrics"),
    doubles=("precision", "recall", "ndcg", "diversity", "novelty"))
def evaluate_all_users(spark, sf):
    return jobs.evaluate_all_users(b.interactions(spark, sf), b.songs(spark, sf), b.song_vectors(spark, sf),
                                   users(spark, sf), b.as_of())


# ---- streams

def _arriving(spark, sf):
    """The log written as files and read back as a stream."""
    path = session.shared_path(spark, "arriving")
    rows = b.interactions(spark, sf)
    rows.repartition(4).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


@query("stream_interactions", check(
    "SELECT user_id, song_id, label, label AS play_count FROM log", "log"), wholes=("label", "play_count"))
def stream_interactions(spark, sf):
    path = session.shared_path(spark, "appended")
    feedback.stream_interactions(_arriving(spark, sf), path, session.shared_path(spark, "marks")).awaitTermination()
    return spark.read.parquet(path).select("user_id", "song_id", "label", "play_count")


@query("stream_history_counts", check("SELECT user_id, likes, skips FROM history", "history"))
def stream_history_counts(spark, sf):
    marks = session.shared_path(spark, "marks")
    feedback.stream_history_counts(_arriving(spark, sf), marks).awaitTermination()
    return feedback.latest_counts(spark, marks)


@query("stream_user_embedding", check("SELECT user_id, n_liked, pos, x FROM user_vec_long", "user_vec_long"),
       doubles=("x",), wholes=("pos",))
def stream_user_embedding(spark, sf):
    marks, songs = session.shared_path(spark, "marks"), b.song_vectors(spark, sf)
    feedback.stream_user_embedding(_arriving(spark, sf), songs, marks).awaitTermination()
    rows = feedback.read_user_embedding(spark, marks, vectors.dimension(songs, "embedding"))
    return rows.select("user_id", "n_liked", F.posexplode("embedding").alias("pos", "x"))


@query("retrain_trigger", check("SELECT count(*) AS n_new, count(*) >= 1000 AS due FROM log", "log"))
def retrain_trigger(spark, sf):
    marks = session.shared_path(spark, "marks")
    feedback.stream_refit_signal(_arriving(spark, sf), marks).awaitTermination()
    return feedback.refit_due(spark, marks, 1000)
