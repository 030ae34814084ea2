"""Where query modules put their Spark function and, when SQL can say the same, its oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.adapters import Tables
from .views_sql import resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_OPEN: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, root: str) -> Tables:
    """One catalog per application and folder, so that queries share the stored tables."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _OPEN:
        _OPEN[key] = Tables(spark, root)
    return _OPEN[key]


def forget_tables() -> None:
    """Drop the catalogs; the next query builds its stored tables again (used by the bench)."""
    _OPEN.clear()


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` together with its oracle SQL."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, root: fn(tables(spark, root))
        if sql is not None:
            ORACLES[name] = resolve(sql)
        return fn

    return wrap


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Round for comparison as the oracle does: halves of the scaled double away from zero; adding zero turns -0.0 into 0.0.

    ``round(x, digits)`` would round x's shortest decimals instead: 9.797907499999999 down, though scaled it is 9797907.5."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.round(x * 10.0**digits) / 10.0**digits + F.lit(0.0)


def rnd_sql(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rnd(c, digits) for c in cols})


def unit_sql(text: str) -> str:
    """The oracle's form of the hashed uniform number; ``text`` joins the parts by bars."""
    return f"(CAST('0x' || substr(md5({text}), 1, 10) AS BIGINT) / 1099511627776e0)"
