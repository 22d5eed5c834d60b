"""Leaf-wise boosting against a plain learner that splits one leaf after the other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunewright.functions import fixed
from tunewright.operators import boosting, training


def plain_tree(x, grad, hess, leaves, rate):
    """Best-first growth on values: ({(path): (feature, threshold)}, {path: value}); a path is a string of L and R."""
    def best(rows):
        g, h, found = grad[rows].sum(), hess[rows].sum(), None
        for f in range(x.shape[1]):
            for value in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= value]
                right = rows[x[rows, f] > value]
                if min(len(left), len(right)) < 20:
                    continue
                gl, hl, gr, hr = grad[left].sum(), hess[left].sum(), grad[right].sum(), hess[right].sum()
                gain = gl * gl / hl + gr * gr / hr - g * g / h
                if gain > boosting.LEAST_GAIN and (found is None or gain > found[0] + 1e-12):
                    found = gain, f, value, left, right
        return found

    ends = {"": np.arange(len(x))}
    options = {"": best(ends[""])}
    splits = {}
    while len(ends) < leaves:
        able = [p for p in ends if options[p]]
        if not able:
            break
        path = max(able, key=lambda p: options[p][0])
        _, f, value, left, right = options[path]
        splits[path] = (f, value)
        del ends[path]
        for side, rows in (("L", left), ("R", right)):
            ends[path + side] = rows
            options[path + side] = best(rows)
    return splits, {p: -rate * grad[r].sum() / hess[r].sum() for p, r in ends.items()}


def paths(tree):
    splits, values = {}, {}

    def walk(node, path):
        if tree.feature[node] < 0:
            values[path] = tree.value[node]
        else:
            splits[path] = (tree.feature[node], tree.threshold[node])
            walk(tree.left[node], path + "L")
            walk(tree.right[node], path + "R")

    walk(0, "")
    return splits, values


@pytest.mark.parametrize("leaves, task_rows", [(2, 0), (9, 0), (31, 0), (31, 10_000)])
def test_trees_equal_a_plain_learner_s(spark, monkeypatch, leaves, task_rows):
    rng = np.random.default_rng(leaves)
    x = np.column_stack([rng.integers(0, 60, 700) / 7, rng.integers(0, 5, 700), rng.random(700).round(2)])
    y = (rng.random(700) < 1 / (1 + np.exp(-(x[:, 0] - 4) * (x[:, 1] - 2)))).astype(float)
    w = np.where(y > 0, 1.3, 0.7)
    table = spark.createDataFrame(
        [(*map(float, r), float(a), float(b), False) for r, a, b in zip(x, y, w)],
        "a double, b double, c double, label double, weight double, held_out boolean").repartition(3)
    monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)
    model = boosting.fit(table, ["a", "b", "c"], 3, leaves, 0.3, 5)
    assert len(model.trees) == 3 and model.losses == []
    margin = np.zeros(700)
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        splits, values = plain_tree(x, w * (p - y), w * p * (1 - p), leaves, 0.3)
        got_splits, got_values = paths(tree)
        assert tree.leaves() == len(values) and got_splits.keys() == splits.keys()
        for path, (f, value) in splits.items():
            assert got_splits[path] == (f, pytest.approx(value))
        assert got_values == {p_: pytest.approx(v, abs=1e-7) for p_, v in values.items()}
        margin += np.array(tree.value)[tree.leaf_of(x.T)]
    scored = table.select(model.probability().alias("p"), "a", "b", "c").collect()
    want = {tuple(r): 1 / (1 + math.exp(-m)) for r, m in zip(x.tolist(), margin)}
    assert all(r["p"] == pytest.approx(want[r["a"], r["b"], r["c"]]) for r in scored)


def learning_table(spark, n=600, noise=0.6):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        x = rng.random(len(fixed.FEATURES))
        rows.append((i % 30, int(rng.random() < 0.2 + noise * x[0]), i, *map(float, x)))
    names = ", ".join(f"{c} double" for c in fixed.FEATURES)
    return spark.createDataFrame(rows, f"user_id long, label int, log_ord long, {names}")


def test_the_best_round_of_the_held_out_users_is_kept(spark):
    table = learning_table(spark)
    model = training.train_ranker(table, trees=25, patience=3)
    best = int(np.argmin(model.losses))
    assert len(model.trees) == best + 1
    # The run ended three trees after the best, or with the last tree; no earlier loss had three worse ones behind it.
    assert len(model.losses) in (best + 4, 25)
    for at in range(best):
        assert min(model.losses[at + 1:at + 4]) < min(model.losses[:at + 1])
    split = training.group_split(table, fixed.TEST_SHARE, fixed.SEED + 1).join(training.class_weights(table), "label")
    loss = split.where("is_test").withColumn("p", model.probability()).agg(
        F.sum(-F.col("weight") * F.log(F.when(F.col("label") == 1, F.col("p")).otherwise(1 - F.col("p"))))).first()[0]
    assert loss == pytest.approx(model.losses[best], rel=1e-6)


def test_one_task_passes_and_written_margins_come_to_the_same_trees(spark, monkeypatch):
    table = learning_table(spark).withColumn("weight", F.lit(1.0)).withColumn("held_out", F.col("user_id") < 6)
    whole = boosting.fit(table, fixed.FEATURES, 4, 8, 0.2, 50)
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    monkeypatch.setattr(boosting, "MARGIN_TREES", 2)
    again = boosting.fit(table.repartition(5), fixed.FEATURES, 4, 8, 0.2, 50)
    assert whole.losses == pytest.approx(again.losses)
    for a, b in zip(whole.trees, again.trees, strict=True):
        assert a.feature == b.feature and a.threshold == b.threshold and a.value == pytest.approx(b.value)


def test_nulls_few_rows_and_no_rows(spark):
    schema = "a double, b double, label int, weight double, held_out boolean"
    rows = [(None if i % 3 == 0 else float(i % 3), float("nan") if i % 2 else 1.0, int(i % 3 == 0), 1.0, False) for i in range(120)]
    model = boosting.fit(spark.createDataFrame(rows, schema), ["a", "b"], 5, 31, 0.5, 3)
    got = spark.createDataFrame(rows, schema).withColumn("p", model.probability()).collect()
    assert all((r["p"] > 0.5) == (r["a"] is None) for r in got)
    few = boosting.fit(spark.createDataFrame(rows[:15], schema), ["a", "b"], 2, 31, 0.5, 3)
    assert [t.leaves() for t in few.trees] == [1, 1]
    assert boosting.fit(spark.createDataFrame([], schema), ["a", "b"], 2, 31, 0.5, 3).trees == []


def test_a_pass_is_one_job_and_comes_to_the_trees_of_one_task(spark, monkeypatch):
    table = learning_table(spark).withColumn("weight", F.lit(1.0)).withColumn("held_out", F.col("user_id") < 6)
    whole = boosting.fit(table, fixed.FEATURES, 4, 8, 0.2, 50)
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    monkeypatch.setattr(boosting, "DEALT_ROWS", 200)
    seen, measure = [], boosting.InPasses.measure
    tracker = spark.sparkContext.statusTracker()

    def counted(self, growing, waiting):
        spark.sparkContext.setJobGroup(f"pass-{len(seen)}", "pass")
        found = measure(self, growing, waiting)
        seen.append(len(tracker.getJobIdsForGroup(f"pass-{len(seen)}")))
        return found

    monkeypatch.setattr(boosting.InPasses, "measure", counted)
    dealt = boosting.fit(table, fixed.FEATURES, 4, 8, 0.2, 50)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # The first pass also packs the rows.
    assert len(seen) > 8 and set(seen[1:]) == {1}
    assert whole.trees == dealt.trees and whole.losses == dealt.losses


@pytest.mark.parametrize("tasks", [1, 3])
def test_tasks_that_run_together_come_to_the_trees_of_one_task(spark, monkeypatch, tasks):
    table = learning_table(spark).withColumn("weight", F.when(F.col("label") == 1, 1.7).otherwise(0.6)).withColumn(
        "held_out", F.col("user_id") < 6)
    whole = boosting.fit(table, fixed.FEATURES, 6, 8, 0.2, 50)
    monkeypatch.setattr(boosting, "TASK_ROWS", 0)
    monkeypatch.setattr(boosting, "GANG_ROWS", 0)
    monkeypatch.setattr(boosting, "DEALT_ROWS", 600 // tasks)
    together = []
    answer = boosting.gang_of
    monkeypatch.setattr(boosting, "gang_of", lambda *a: together.append(answer(*a)) or together[-1])
    dealt = boosting.fit(table, fixed.FEATURES, 6, 8, 0.2, 50)
    assert together[0][1] == tasks
    assert whole.trees == dealt.trees and whole.losses == dealt.losses and len(whole.losses) == 6


def test_only_the_smaller_child_is_measured():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 20, (2, 500)).astype(np.uint8)
    label = (rng.random(500) < bins[0] / 20).astype(float)
    part = boosting.Part(bins, np.zeros(500), label, np.ones(500), np.zeros(500, dtype=bool), (2.0 ** 30, 2.0 ** 30))
    rows, growing, asked = boosting.InTask(part), boosting.Growing(), []
    while growing.waiting:
        asked.append(list(growing.waiting))
        growing.measured(rows.measure(growing.tree, growing.waiting)[0])
        for node in asked[-1]:
            if node:
                parent = next(p for p in range(node) if node in (growing.tree.left[p], growing.tree.right[p]))
                other = growing.tree.left[parent] + growing.tree.right[parent] - node
                assert part.rows[node].size <= part.rows[other].size and other not in asked[-1]
                assert np.array_equal(part.sums(other)[2], growing.sums[other].rows)
                assert np.array_equal(part.sums(other)[0] / 2.0 ** 30, growing.sums[other].gradient)
        growing.chosen(6)
    assert len(asked) > 2
