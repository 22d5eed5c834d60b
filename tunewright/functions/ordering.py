"""Exact ranks and running totals over groups too large for one task.

A window over a hot key would sort that whole key in one task. Here rows are
first cut into buckets that respect the order, each (key, bucket) is ranked on
its own, and the totals of the earlier buckets are added as an offset.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunewright import session


#: Rows per bucket that the number of buckets is chosen for, and its bounds.
BUCKET_ROWS = 1_000_000
FEWEST, MOST = 64, 4_096
#: Cut points compared one after the other; longer lists are searched in two steps.
RUN = 64


def bucket_count(rows: int) -> int:
    return max(FEWEST, min(MOST, rows // BUCKET_ROWS))


def _quantile_grid(df: DataFrame, value: Column, buckets: int | None) -> list:
    """Rising, possibly repeated values at equal shares of the rows; without a number, one for the rows there are."""
    # A count of a written table reads its footers only.
    buckets = buckets or bucket_count(df.count())
    shares = [i / buckets for i in range(1, buckets)]
    return df.select(F.percentile_approx(value, shares, max(1000, 10 * buckets))).first()[0] or []


def cut_points(df: DataFrame, value: Column, buckets: int | None = None) -> list:
    """At most ``buckets - 1`` rising values that cut the rows into similar shares.

    Without a number, one for the rows there are. Any cut points give exact
    results; close quantiles only balance the tasks.
    """
    return sorted(set(_quantile_grid(df, value, buckets)))


def bucket_of(value: Column, cuts: list) -> Column:
    """Number of cut points at or below the value: later buckets hold larger values."""
    def below(points: Column) -> Column:
        return F.size(F.filter(points, lambda c: c <= value))

    if not cuts:
        return F.lit(0)
    if len(cuts) <= RUN:
        return below(F.array(*[F.lit(c) for c in cuts]))
    runs = [cuts[i:i + RUN] for i in range(0, len(cuts), RUN)]
    run = below(F.array(*[F.lit(r[0]) for r in runs]))
    inside = below(F.get(F.array(*[F.array(*[F.lit(c) for c in r]) for r in runs]), run - 1))
    return F.when(run > 0, (run - 1) * RUN + inside).otherwise(F.lit(0))


def ordered_buckets(df: DataFrame, value: Column, tie: Column, buckets: int | None = None) -> Column:
    """Bucket in the order of (value, tie), both whole numbers.

    A value that fills a bucket by itself, as in a burst of rows with one time
    stamp, is cut further by the tie.
    """
    grid = _quantile_grid(df, value, buckets)
    heavy = sorted({a for a, b in zip(grid, grid[1:]) if a == b})
    cuts = sorted(set(grid) | set(heavy) | {v + 1 for v in heavy})
    if not heavy:
        return bucket_of(value, cuts)
    crowded = value.isin(*heavy)
    ties = cut_points(df.where(crowded), tie, buckets)
    return bucket_of(value, cuts) * (len(ties) + 1) + F.when(crowded, bucket_of(tie, ties)).otherwise(0)


def rank_in_buckets(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                    out: str = "position", total: str | None = None) -> DataFrame:
    """1-based position of each row within its key, ordered by (bucket, order).

    The offsets table holds one row per (key, bucket), so its window is short.
    """
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *([F.sum("_rows").over(by_key).alias(total)] if total else []),
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    return (
        marked.withColumn("_row", F.row_number().over(within))
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_row") + F.col("_before"))
        .drop("_row", "_before", "_bucket")
    )


def running_totals(df: DataFrame, value: str, amounts: list[str], buckets: int | None = None) -> DataFrame:
    """Inclusive running totals ``<amount>_upto`` over all rows in rising ``value`` order.

    ``value`` must be distinct. The only window without a key runs over the
    bucket totals, at most ``MOST`` rows.
    """
    cuts = cut_points(df, F.col(value), buckets)
    marked = df.withColumn("_bucket", bucket_of(F.col(value), cuts))
    sums = marked.groupBy("_bucket").agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_bucket",
        *[F.coalesce(F.sum(f"_{a}").over(earlier), F.lit(0)).alias(f"_before_{a}") for a in amounts],
    )
    within = (
        Window.partitionBy("_bucket").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    for a in amounts:
        marked = marked.withColumn(f"_in_{a}", F.sum(a).over(within))
    # At most MOST offset rows: the broadcast is bounded.
    joined = marked.join(F.broadcast(offsets), "_bucket")
    for a in amounts:
        joined = joined.withColumn(f"{a}_upto", F.col(f"_in_{a}") + F.col(f"_before_{a}"))
    drop = ["_bucket", *[f"_in_{a}" for a in amounts], *[f"_before_{a}" for a in amounts]]
    return joined.drop(*drop)


#: Rows of one key that are sorted together to read off a rank; cuts per narrowing pass; their accuracy (ranks err by 1 / ACCURACY).
FIT = 1_000_000
CUTS = 1_024
ACCURACY = 16 * CUTS


def at_ranks(df: DataFrame, key: str, value: str, wanted: DataFrame, fit: int = FIT) -> DataFrame:
    """``key, id, value``: the values at the 0-based ``rank`` asked for by ``wanted(key, id, rank)``.

    Distributed selection: a pass puts CUTS approximate quantiles on the rows of a key, which name two values around each wanted
    rank; exact counts of the rows below, at and between the two say where the rank lies; only rows between go on, about
    2 / CUTS of them. What a row meets is a pair of values, never a list of cuts. Rows are sorted once ``fit`` or
    fewer are left for a rank. Null values are no rows; NaN is larger than any number.
    """
    rows = df.select(key, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    asked = session.settle(wanted.select(key, "id", F.col("rank").cast("long").alias("rank")), "ranks-asked")
    done, by, slack = [], [key], 2
    while True:
        sizes = session.settle(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "rank-sizes")
        if (sizes.agg(F.max("_n")).first()[0] or 0) <= fit:
            order = Window.partitionBy(*by).orderBy("_v")
            placed = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1).join(asked, [*by, "rank"])
            done.append(placed.select(key, "id", F.col("_v").alias("value")))
            break
        cuts = rows.groupBy(*by).agg(
            F.min("_v").alias("_least"), F.max("_v").alias("_most"),
            F.percentile_approx("_v", [i / CUTS for i in range(1, CUTS)], ACCURACY).alias("_cuts"))
        cuts = cuts.join(sizes, by).join(asked, by)
        cell = F.floor(F.col("rank") * CUTS / F.col("_n")).cast("int")
        # Cut i (from 1) stands at place i - 1; beyond the first and the last cut lie the extremes.
        low = F.when(cell - slack >= 1, F.get("_cuts", cell - slack - 1)).otherwise(F.col("_least"))
        high = F.when(cell + 1 + slack < CUTS, F.get("_cuts", cell + slack)).otherwise(F.col("_most"))
        around = session.settle(cuts.select(key, "id", "rank", low.alias("_low"), high.alias("_high")), "rank-cells")
        met, v = rows.join(around, by), F.col("_v")
        sums = met.groupBy(key, "id", "rank", "_low", "_high").agg(
            F.count_if(v < F.col("_low")).alias("_below"), F.count_if(v == F.col("_low")).alias("_at_low"),
            F.count_if((v > F.col("_low")) & (v < F.col("_high"))).alias("_inside"),
            F.count_if(v <= F.col("_high")).alias("_upto"))
        after_low = F.col("_below") + F.col("_at_low")
        sums = session.settle(sums.withColumn("_place", F.when(F.col("rank") < F.col("_below"), "missed")
                                              .when(F.col("rank") < after_low, "low")
                                              .when(F.col("rank") < after_low + F.col("_inside"), "inside")
                                              .when(F.col("rank") < F.col("_upto"), "high").otherwise("missed")), "rank-places")
        places = {r["_place"]: r["n"] for r in sums.groupBy("_place").agg(F.count(F.lit(1)).alias("n")).collect()}
        if "missed" in places:
            # The quantiles are approximate: look in a wider pair; at last between the extremes, which cannot miss.
            slack *= 4
            continue
        done.append(sums.where("_place IN ('low', 'high')").select(
            key, "id", F.when(F.col("_place") == "low", F.col("_low")).otherwise(F.col("_high")).alias("value")))
        if "inside" not in places:
            break
        open_ = sums.where("_place = 'inside'")
        asked = session.settle(open_.select(key, "id", (F.col("rank") - after_low).alias("rank")), "ranks-asked")
        inside = rows.join(open_.select(key, "id", "_low", "_high"), by).where((v > F.col("_low")) & (v < F.col("_high")))
        rows, by, slack = session.settle(inside.select(key, "id", "_v"), "rank-rows"), [key, "id"], 2
    return reduce(DataFrame.unionByName, done)


def quantiles(df: DataFrame, key: str, value: str, shares: list[float], fit: int = FIT) -> DataFrame:
    """Exact, linearly interpolated quantiles ``q_0, q_1, ...`` of ``value`` per key, for keys with very many rows too."""
    df = session.settle(df.select(key, value).where(F.col(value).isNotNull()), "quantile-rows")
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    place = {i: F.lit(float(share)) * (F.col("_total") - 1) for i, share in enumerate(shares)}
    ends = [F.struct(F.lit(2 * i + side).alias("id"), end(at).cast("long").alias("rank"))
            for i, at in place.items() for side, end in enumerate((F.floor, F.ceil))]
    found = at_ranks(df, key, value, totals.select(key, F.inline(F.array(*ends))), fit)
    wide = found.groupBy(key).agg(*[F.max(F.when(F.col("id") == i, F.col("value"))).alias(f"_{i}") for i in range(2 * len(shares))])

    def between(i: int) -> Column:
        low, high = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}")
        return low + (high - low) * (place[i] - F.floor(place[i]))

    return wide.join(totals, key).select(key, *[between(i).alias(f"q_{i}") for i in place])
