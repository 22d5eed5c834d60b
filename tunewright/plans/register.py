"""Named queries over the driver's tables, each with its SQL check where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}

DIGITS = 6
# Similarities lie on a 9-decimal grid, so some fall on a midpoint of the
# 6-decimal one, where engines round apart; the nudge takes them off it.
NUDGE = 2e-11


def comparable(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 decimals (without a negative zero), whole numbers as bigint."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(name: str, check: str | None = None, doubles: tuple[str, ...] = (), wholes: tuple[str, ...] = ()):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under ``name``.

    ``check`` is DuckDB SQL; its ``doubles`` are rounded and its ``wholes`` cast
    like the Spark side.
    """
    def keep(build: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: comparable(build(spark, sf_dir))
        if check is not None:
            parts = [f"round(CAST({c} AS DOUBLE) + {NUDGE}::DOUBLE, {DIGITS}) + 0.0 AS {c}" for c in doubles]
            parts += [f"CAST({c} AS BIGINT) AS {c}" for c in wholes]
            replace = f" REPLACE ({', '.join(parts)})" if parts else ""
            CHECKS[name] = f"SELECT *{replace} FROM ({check}) AS result"
        return build
    return keep
