"""Registry of named queries. Each has a Spark plan over the given tables and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.session import tune

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    plan: Plan
    oracle: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Plan], Plan]:
    """Register a plan under its operator name.

    ``dates`` leave both sides as text, because clients of the two engines show SQL dates differently.
    """
    if oracle is not None and dates:
        texts = ", ".join(f'CAST("{d}" AS VARCHAR) AS "{d}"' for d in dates)
        oracle = f"SELECT * REPLACE ({texts}) FROM ({oracle})"

    def register(plan: Plan) -> Plan:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = plan(tune(spark), sf_dir)
            return df.withColumns({d: F.col(d).cast("string") for d in dates}) if dates else df

        QUERIES[name] = Query(name, run, oracle)
        return plan

    return register
