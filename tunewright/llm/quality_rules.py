"""Quality rules: fixed limits, then robust multivariate outliers per language and source.

Word, symbol and repetition statistics of each document are turned into a short vector. For each (lang, source) a
minimum-covariance-determinant estimate of centre and scatter is found by concentration steps: the three quarters of
the rows closest to the present estimate give the next one. Documents whose Mahalanobis distance from the final
estimate exceeds the cut are rejected.

All of it is DataFrame work. A group's rows never meet in one task: a concentration step sums rows per (group,
distance cell) with map-side partial sums, and the cells of a group (a fixed grid, at most a few hundred) are then
cumulated. Joins with the estimates use a salted key, so a source with a third of all rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunewright.llm.common import BLANK_CLASS, beside, text_of, with_results
from tunewright.session import settle

# Base limits.
LEAST_WORDS = 20
REPEAT_SHARE = 30
WINDOW = 8

# Choices of this library.
VECTOR = ["x0", "x1", "x2", "x3"]
#: Standard deviations below which a difference counts as noise; added to every scatter estimate, so a statistic
#: that is zero nearly everywhere (symbols, repeated lines) does not reject a document for a single occurrence. Where
#: a group shows no spread, more than 4 repeated lines or 7 repeated words per hundred words, beyond ONCE, reject.
NOISE = [0.15, 0.6, 0.3, 0.4]
#: What a single occurrence counts in repeated lines and repeated words (both windows); it is not held against a text
#: of any length.
ONCE = {"n_dup_lines": 1, "n_repeat_words": 2 * WINDOW}
#: Rows' worth of the language's estimate in each group's estimate. A group of few rows leans on its language.
PRIOR_ROWS = 50.0
#: Share of the rows that the determinant is minimised over.
CORE = 0.75
STEPS = 3
#: Squared Mahalanobis distance beyond which a document is an outlier: the 1 - 1e-5 quantile of chi-square with
#: four degrees of freedom. Statistics of text have heavier tails than the normal law.
CUT = 28.5
#: A normal sample's scatter over that of its closest CORE in four dimensions.
CONSISTENCY = 1.49
SALTS = 16
#: Cells of the distance grid per doubling of the squared distance, and of the start grid per unit.
CELLS = 8
START_CELLS = 50


def statistics(text: Column) -> dict[str, Column]:
    """Names and expressions up to the word hashes; the rest needs them as columns (see ``annotate``)."""
    words = F.filter(F.split(text, f"{BLANK_CLASS}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    return {"_words": words, "_lines": lines,
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long")}


def annotate(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``_row`` (the columns in ``carry``, or all) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of each document."""
    df = beside(docs, carry, text=text_of(), lang=F.col("lang"), source=F.col("source"))
    df = df.select("_row", "lang", "source", *[c.alias(n) for n, c in statistics(F.col("text")).items()])
    df = df.select(
        "_row", "lang", "source", "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    stats = ["_row", "lang", "source", "n_symbols", "n_words", "word_chars", "n_dup_lines"]
    window = F.when(
        F.size("_hashes") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("_hashes") - WINDOW, F.lit(0))),
                    lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])))
    df = df.select(*stats, F.coalesce(window, F.array().cast("array<bigint>")).alias("_windows"))
    # Only a text with two equal windows has its windows sorted.
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select(*stats, placed.alias("_sorted"))
    at = lambda j: F.get("_sorted", j)
    same = lambda j, k: at(j)["h"].eqNullSafe(at(k)["h"])
    hits = F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda j: same(j, j - 1) | same(j, j + 1)),
        lambda j: at(j)["i"])))
    df = df.select(*stats, hits.alias("_hits"))
    # Each repeated window covers eight words, less what the one before it covers already.
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_hits") - 1), F.lit(0).cast("long"),
        lambda acc, j: acc + F.when(j == 0, F.lit(WINDOW)).otherwise(
            F.least(F.lit(WINDOW), F.get("_hits", j) - F.get("_hits", j - 1))).cast("long"))
    df = df.select(*stats, F.when(F.col("_hits").isNull(), F.lit(0).cast("long")).otherwise(covered)
                   .alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def vector() -> list[Column]:
    """Log shares: mean word length, symbols, repeated lines and repeated words beyond ONCE, each per hundred words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    parts = [F.log(1.0 + F.col("word_chars") / words)]
    beyond = {c: F.greatest(F.col(c) - ONCE.get(c, 0), F.lit(0)) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")}
    parts += [F.log(1.0 + 100.0 * c / words) for c in beyond.values()]
    return [p.alias(n) for p, n in zip(parts, VECTOR, strict=True)]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]


def start(rows: DataFrame) -> DataFrame:
    """Median and quartile spread of each statistic per group, on a fixed grid: partial counts, then short windows."""
    cells = rows.select("lang", "source", F.posexplode(F.array(*VECTOR)).alias("part", "value")).groupBy(
        "lang", "source", "part", F.floor(F.col("value") * START_CELLS).alias("cell")
    ).agg(F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy("lang", "source", "part")
    upto = by_part.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = cells.select("*", F.sum("n").over(upto).alias("upto"), F.sum("n").over(by_part).alias("total"))
    value = (F.col("cell") + 0.5) / START_CELLS

    def quantile(share: float) -> Column:
        return F.min(F.when(F.col("upto") >= share * F.col("total"), value))

    spread = ranked.groupBy("lang", "source", "part").agg(
        quantile(0.5).alias("mid"), ((quantile(0.75) - quantile(0.25)) / 1.349).alias("sd"),
        F.max("total").alias("n"))
    by = {i: F.col("part") == i for i in range(len(VECTOR))}
    return spread.groupBy("lang", "source").agg(
        F.max("n").cast("double").alias("n"),
        *[F.max(F.when(by[i], F.col("mid"))).alias(f"m{i}") for i in by],
        *[(F.max(F.when(by[i], F.col("sd") * F.col("sd"))) if i == j else F.lit(0.0)).alias(f"s{i}{j}")
          for i, j in _pairs()])


def whitening(estimate: DataFrame) -> DataFrame:
    """Cholesky factor ``l<i><j>`` of scatter plus noise, one row per (group, salt), written so its size is known."""
    df = estimate
    for i in range(len(VECTOR)):
        for j in range(i + 1):
            left = F.col(f"s{i}{j}") + (F.lit(NOISE[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(left) if i == j else left / F.col(f"l{j}{j}"))
    df = df.select("lang", "source", *[f"m{i}" for i in range(len(VECTOR))], *[f"l{i}{j}" for i, j in _pairs()],
                   F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return settle(df, "quality-estimate")


def with_distance(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` of each row from its group's estimate (null without one)."""
    given = factors.withColumnsRenamed({"lang": "_lang", "source": "_source", "salt": "_salt"})
    on = (F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
          & (F.col("salt") == F.col("_salt")))
    df = rows.join(given, on, "left")
    own = rows.columns
    # Forward substitution, one column at a time.
    for i, x in enumerate(VECTOR):
        left = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            left = left - F.col(f"l{i}{k}") * F.col(f"y{k}")
        df = df.withColumn(f"y{i}", left / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(len(VECTOR)):
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return df.select(*own, total.alias("d2"))


def concentrate(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """One concentration step: centre and scatter of each group's closest rows, leaning on the language's."""
    cell = F.floor(CELLS * F.log2(F.col("d2") + F.lit(2.0 ** -10)))
    near = with_distance(rows, factors).withColumn("cell", cell)
    sums = [F.sum(x).alias(f"t{i}") for i, x in enumerate(VECTOR)]
    sums += [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}{j}") for i, j in _pairs()]
    cells = near.groupBy("lang", "source", "cell").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)
    group = Window.partitionBy("lang", "source")
    before = group.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    core = cells.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0.0)),
                              "total": F.sum("n").over(group)})
    core = core.filter(F.col("before") < CORE * F.col("total"))
    names = ["n", *[f"t{i}" for i in range(len(VECTOR))], *[f"q{i}{j}" for i, j in _pairs()]]
    groups = core.groupBy("lang", "source").agg(*[F.sum(c).alias(c) for c in names])
    return moments(groups, names)


def moments(groups: DataFrame, names: list[str]) -> DataFrame:
    """Centre and scatter from sums; each group gets PRIOR_ROWS rows' worth of its language's mean sums."""
    groups = settle(groups, "quality-sums")
    langs = groups.groupBy(F.col("lang").alias("_lang")).agg(*[F.sum(c).alias(f"a_{c}") for c in names])
    both = groups.join(langs, F.col("lang").eqNullSafe(F.col("_lang")))
    part = {c: F.col(c) + PRIOR_ROWS * F.col(f"a_{c}") / F.col("a_n") for c in names}
    df = both.select("lang", "source", *[p.alias(c) for c, p in part.items()])
    mean = [F.col(f"t{i}") / F.col("n") for i in range(len(VECTOR))]
    scatter = {(i, j): F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j] for i, j in _pairs()}
    return df.select("lang", "source", "n", *[m.alias(f"m{i}") for i, m in enumerate(mean)],
                     *[(CONSISTENCY * (F.greatest(s, F.lit(0.0)) if i == j else s)).alias(f"s{i}{j}")
                       for (i, j), s in scatter.items()])


def judge(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``_row``, the statistics and ``kept``; the written statistics are read again for each step."""
    noted = settle(annotate(docs, carry), "quality-statistics")
    salt = F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "n_repeat_words"), F.lit(SALTS)).cast("int")
    rows = noted.filter(~F.col("base_failed")).select("lang", "source", *vector(), salt.alias("salt"))
    factors = whitening(start(rows))
    for _ in range(STEPS):
        factors = whitening(concentrate(rows, factors))
    judged = with_distance(noted.select("*", *vector(), salt.alias("salt")), factors)
    inside = F.coalesce(F.col("d2") <= CUT, F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & inside)


def quality_rules(docs: DataFrame) -> DataFrame:
    """The documents' columns, their statistics, ``base_failed`` and ``kept``.

    ``docs`` has doc_id, text, lang and source. Null text: no words, so base_failed. Null lang or source: a group
    like any other. Repeated rows: each is judged, alike. Empty table: empty result. An input column named like a
    result is replaced by the result.
    """
    results = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                     "base_failed", "kept")}
    return judge(docs).select(*with_results(docs.columns, results))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, columns unchanged."""
    return judge(docs).filter("kept").select("_row.*")
