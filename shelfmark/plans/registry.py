"""Register of queries: a Spark plan, the operators it exercises, and its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .bindings import ROLES, Tables, role_sql


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Tables(spark, sf_dir))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        used = [r for r in ROLES if re.search(rf"\b{r}\b", self.sql)]
        extra = [role_sql(r) for r in used]
        text = self.sql.strip()
        if not extra:
            return text
        if text[:5].upper() == "WITH ":
            return "WITH " + ", ".join(extra) + ", " + text[5:]
        return "WITH " + ", ".join(extra) + " " + text


QUERIES: dict[str, Query] = {}


def query(*covers: str, sql: str | None = None):
    """Register a plan under its function name."""

    def register(plan):
        name = plan.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, covers, plan, sql)
        return plan

    return register
