"""Query registry: each entry pairs a Spark builder with its SQL oracle."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from studiolake.plans import spec as SP
from studiolake.plans.oracle_base import with_base


@dataclass
class Entry:
    name: str
    build: Callable[[dict[str, DataFrame]], DataFrame]   # canonical tables -> result
    spec: str
    sql: str | None = None            # SELECT producing the spec columns (as CTE "result")
    ctes: tuple[str, ...] = field(default_factory=tuple)
    sources: str = "canonical"        # "canonical" | "raw" (driver tables)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return SP.to_spec(self.build(_inputs(spark, sf_dir, self.sources)), self.spec)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return with_base(SP.sql_select(self.spec), *self.ctes, f"result AS (\n{self.sql}\n)")


# Lazy input DataFrames per (session, directory, kind).  Building the adapter's
# DataFrames is pure plan construction (no data is read), so sharing them
# between queries only saves driver-side planning calls.
_INPUTS: dict[tuple, tuple] = {}


def _inputs(spark: SparkSession, sf_dir: str, kind: str) -> dict[str, DataFrame]:
    from studiolake.sources.adapter import canonical, read_driver
    key = (id(spark), sf_dir, kind)
    hit = _INPUTS.get(key)
    if hit is not None and hit[0] is spark and spark.sparkContext._jsc is not None:
        return hit[1]
    t = read_driver(spark, sf_dir) if kind == "raw" else canonical(spark, sf_dir)
    _INPUTS[key] = (spark, t)
    return t

