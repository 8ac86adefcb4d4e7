"""Names of queries, their plans and, where there is one, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def add(f: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"{name} is registered twice")
            self.plans[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
