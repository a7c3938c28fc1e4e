"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


REGISTRY: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Shape:
    """Output columns of a query: kept as they are, dates and times as text, and rounded doubles."""

    keys: Sequence[str] = ()
    dates: Sequence[str] = ()
    plain: Sequence[str] = ()
    fine: Sequence[str] = ()
    coarse: Sequence[str] = ()
    times: Sequence[str] = ()
    cents: Sequence[str] = ()

    def spark(self, df: DataFrame) -> DataFrame:
        return df.select(
            *self.keys,
            *[F.col(c).cast("date").cast("string").alias(c) for c in self.dates],
            *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in self.times],
            *self.plain,
            *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in self.fine],
            *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in self.coarse],
            *[(F.round(F.col(c).cast("double"), 2) + 0.0).alias(c) for c in self.cents],
        )

    def sql(self) -> str:
        # Spark rounds the shortest decimal form of a double, half up; going through text does the same here
        parts = [
            *[f'"{c}"' for c in self.keys],
            *[f"CAST(CAST(\"{c}\" AS DATE) AS VARCHAR) AS \"{c}\"" for c in self.dates],
            *[f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S') AS \"{c}\"" for c in self.times],
            *[f'"{c}"' for c in self.plain],
            *[f'CAST(round(CAST(CAST(CAST("{c}" AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), 6) AS DOUBLE) + 0.0 AS "{c}"' for c in self.fine],
            *[f'CAST(round(CAST(CAST(CAST("{c}" AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) + 0.0 AS "{c}"' for c in self.coarse],
            *[f'CAST(round(CAST(CAST(CAST("{c}" AS DOUBLE) AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE) + 0.0 AS "{c}"' for c in self.cents],
        ]
        return ", ".join(parts)


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None
    shape: Shape | None = None

    def body(self) -> str:
        """The CTEs of the twin, ``res`` the last of them."""
        return self.sql.removeprefix("WITH RECURSIVE ").rpartition("\nSELECT ")[0]


def query(name: str, shape: Shape, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame``; ``sql`` must define a relation ``res``."""

    def wrap(fn: Run) -> Run:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape.spark(fn(spark, sf_dir))

        text = None if sql is None else f"WITH RECURSIVE {sql.strip()}\nSELECT {shape.sql()} FROM res"
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, text, shape)
        return run

    return wrap
