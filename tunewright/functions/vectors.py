"""Vector arithmetic on ``array<double>`` columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Similarities are rounded to this many decimals before they are compared, so
# that the order of a floating-point sum (which changes with partitioning and
# with a retried task) never decides a tie.
SCORE_DIGITS = 9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda total, x: total + x * x))


def unit(a: Column | str) -> Column:
    """Vector scaled to length 1; a zero vector stays zero.

    The norm is an argument of ``array_repeat`` and so is computed once per row.
    """
    lengths = F.array_repeat(norm(a), F.size(_col(a)))
    return F.zip_with(_col(a), lengths, lambda x, n: F.when(n > 0, x / n).otherwise(0.0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in [-1, 1]; 0.0 when either vector is zero or missing."""
    lengths = norm(a) * norm(b)
    value = F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)
    return F.round(F.coalesce(value, F.lit(0.0)), SCORE_DIGITS)


def tagged(c: Column, name: str, dim: int) -> Column:
    """The column with its vector length noted in the schema."""
    return c.alias(name, metadata={"dim": dim})


def dimension(df: DataFrame, vector: str) -> int:
    """Vector length: from the schema where noted, else from the first non-null row (0 for none)."""
    noted = df.schema[vector].metadata.get("dim")
    if noted is not None:
        return noted
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).first()
    return row["d"] if row else 0


def sum_vectors(df: DataFrame, keys: list[str], vector: str, dim: int,
                weight: str | None = None, **extra: str) -> DataFrame:
    """Element-wise sum per key as ``vector_sum``, weighted by a column when one is named.

    ``extra`` maps output names to further SQL aggregates. One scalar sum per
    dimension keeps this a code-generated hash aggregate with map-side partial
    sums, so a hot key sends one row per map task.
    """
    times = f" * `{weight}`" if weight else ""
    sums = ", ".join(f"sum(get(`{vector}`, {i}){times})" for i in range(dim))
    total = f"array({sums})" if dim else "cast(array() as array<double>)"
    named = ", ".join([f"`{k}`" for k in keys] + [f"{sql} AS `{name}`" for name, sql in extra.items()])
    by = ", ".join(f"`{k}`" for k in keys)
    summed = df.sparkSession.sql(
        f"SELECT {named}, {total} AS vector_sum FROM {{rows}} GROUP BY {by}", rows=df)
    return summed.withMetadata("vector_sum", {"dim": dim})


def divide(vector: Column | str, by: Column) -> Column:
    return F.transform(_col(vector), lambda x: x / by)
