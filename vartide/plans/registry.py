"""Registry of queries: each name has a function over (spark, sf_dir) and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Shape:
    """The columns of a result: keys as they are, counts as BIGINT, measures as DOUBLE at `digits` places."""

    def __init__(self, keys: str, counts: str = "", measures: str = "", digits: int = 8):
        self.keys, self.counts, self.measures, self.digits = keys.split(), counts.split(), measures.split(), digits

    def of(self, df: DataFrame) -> DataFrame:
        # adding zero turns -0.0 into 0.0
        return df.select(*self.keys, *[F.col(c).cast("long").alias(c) for c in self.counts], *[(F.round(F.col(c).cast("double"), self.digits) + F.lit(0.0)).alias(c) for c in self.measures])

    def sql(self, ctes: str, source: str) -> str:
        cols = [*self.keys, *[f"CAST({c} AS BIGINT) AS {c}" for c in self.counts], *[f"round(CAST({c} AS DOUBLE), {self.digits}) + 0.0::DOUBLE AS {c}" for c in self.measures]]
        return f"WITH {ctes}\nSELECT {', '.join(cols)} FROM {source}"


def query(shape: Shape | None = None, ctes: str = "", source: str = "", sql: str = ""):
    """Register the decorated function under its name; with a shape it applies to the result and the SQL."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = (lambda spark, sf_dir: shape.of(f(spark, sf_dir))) if shape else f
        if sql or ctes:
            ORACLE_SQL[f.__name__] = sql or shape.sql(ctes, source)
        return f

    return wrap
