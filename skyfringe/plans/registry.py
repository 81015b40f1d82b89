"""Named queries: a Spark plan, and where SQL can express it a DuckDB statement over the same views.

Both sides return the same keys as 64-bit integers or text and the same figures as doubles on a grid of 2 ** -20 (about
1e-6). A binary grid has no ties that decimal data could fall on, so the last bit of a sum seldom decides the rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfringe.sources.fixtures import duckdb_sql, view

Views = Callable[[str], DataFrame]


#: Steps of the grid in 1.
GRID = float(1 << 20)


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Views], DataFrame]
    keys: tuple[str, ...]
    figures: tuple[str, ...]
    sql: str | None
    grid: float = GRID

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.plan(lambda name: view(spark, sf_dir, name))
        kinds = dict(df.dtypes)
        keys = [F.col(k) if kinds[k] in ("string", "boolean") else F.col(k).cast("long").alias(k) for k in self.keys]
        return df.select(*keys, *((F.rint(F.col(c).cast("double") * self.grid) / self.grid + 0.0).alias(c) for c in self.figures))

    @property
    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        keys = [f"CAST({k} AS BIGINT) AS {k}" if not k.endswith("_name") else k for k in self.keys]
        return duckdb_sql(f"SELECT {', '.join([*keys, *(f'round(CAST({c} AS DOUBLE) * {self.grid!r}) / {self.grid!r} + 0e0 AS {c}' for c in self.figures)])} FROM ({self.sql}) q")


ALL: dict[str, Query] = {}


def register(name: str, keys: str, figures: str, sql: str | None = None, *, grid: float = GRID):
    """Put a query under its name. ``grid``: steps in 1 of its figures, fewer where they are sums of many large terms."""

    def put(plan: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        ALL[name] = Query(name, plan, tuple(keys.split()), tuple(figures.split()), sql, grid)
        return plan

    return put
