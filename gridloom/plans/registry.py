"""Named queries: a plan builder and, where SQL can express it, the same query as text for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name. `add` serves as a decorator."""

    def __init__(self) -> None:
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
        def register(plan: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"two queries are named {name}")
            self.plans[name] = plan
            if sql:
                self.sql[name] = sql
            return plan

        return register
