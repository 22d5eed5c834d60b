"""The whole evaluation job against plain Python on a small data set."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunewright.plans import jobs

K = 3


def test_evaluate_all_users(spark):
    rng = np.random.default_rng(9)
    n = 70  # more candidates than a ranked list holds
    vectors = rng.normal(size=(n, 4))
    popularity = [i % 5 / 4 for i in range(n)]
    artists = [f"a{i % 4}" for i in range(n)]
    start = datetime.datetime(2024, 1, 1)
    log = [(u, int(rng.integers(0, n)), int(rng.random() < 0.6), start + datetime.timedelta(hours=int(rng.integers(0, 500))), i)
           for i, u in enumerate(rng.integers(0, 5, 400).tolist())]
    users = [(u, [f"a{u % 4}"], []) for u in range(6)]

    spark_log = spark.createDataFrame(log, "user_id bigint, song_id bigint, label int, ts timestamp, log_ord bigint")
    songs = spark.createDataFrame([(i, i, artists[i], [artists[i]], popularity[i]) for i in range(n)],
                                  "song_id bigint, song_ord bigint, artist_id string, artists array<string>, popularity_norm double").withColumn(
        "released", F.lit("2023-12-01").cast("timestamp"))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "song_id bigint, embedding array<double>")
    profiles = spark.createDataFrame(users, "user_id bigint, favorite_artists array<string>, recent_artists array<string>")
    got = {r["user_id"]: r for r in jobs.evaluate_all_users(
        spark_log, songs, table, profiles, F.lit("2024-01-01").cast("timestamp"), K).collect()}

    fresh = math.exp(-0.01 * 31)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    seen = {}
    for u, favourites, _ in users:
        rows = sorted((r for r in log if r[0] == u), key=lambda r: (r[3], r[4]))
        half = (len(rows) + 1) // 2
        train, later = rows[:half], rows[half:]
        if not train:
            continue
        likes = [r[1] for r in train if r[2]]
        pool, content, together = [], [0.0] * n, [0.0] * n
        if likes:
            mean = vectors[likes].mean(axis=0)
            content = np.round(unit @ (mean / np.linalg.norm(mean)), 9).tolist()
            together = np.round((unit @ unit[likes].T).mean(axis=1), 9).tolist()
            pool = sorted(range(n), key=lambda s: (-content[s], s))
        pool += [s for s in range(n) if artists[s] in favourites and s not in pool]
        score = {s: 0.35 * content[s] + 0.25 * together[s] + 0.1 * fresh + 0.1 * popularity[s] for s in pool}
        order = sorted(pool, key=lambda s: (-score[s], pool.index(s)))[:50]
        wins = {r[1] for r in later if r[2]}
        labels = [int(s in wins) for s in order]
        gain = lambda xs: sum(x / math.log2(i + 2) for i, x in enumerate(xs[:K]))
        ideal = gain([1] * len(wins))
        top = order[:K]
        known = [popularity[s] for s in top if popularity[s] > 0]
        seen[u] = (
            sum(labels[:K]) / len(labels[:K]), sum(labels[:K]) / len(wins) if wins else 0.0,
            gain(labels) / ideal if ideal else 0.0, len({artists[s] for s in top}) / len(top),
            sum(-math.log(p) for p in known) / len(known) if known else None)
    means = got.pop(None)
    assert set(got) == set(seen) and len(seen) >= 4
    # Every user has a later like and more than K songs, so all enter the averages.
    wanted = np.mean(np.array(list(seen.values()), dtype=float), axis=0)
    assert [means[c] for c in ("precision", "recall", "ndcg", "diversity", "novelty")] == pytest.approx(wanted.tolist(), abs=1e-7)
    for u, want in seen.items():
        r = got[u]
        assert [r["precision"], r["recall"], r["ndcg"], r["diversity"], r["novelty"]] == pytest.approx(list(want), abs=1e-7)
