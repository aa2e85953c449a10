"""Named queries with their oracles, and named DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name; an oracle is the DuckDB SQL of the same result."""

    def __init__(self) -> None:
        self.runs: dict[str, Run] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Run], Run]:
        def keep(f: Run) -> Run:
            key = name or f.__name__
            self.runs[key] = f
            if sql:
                self.sql[key] = sql
            return f

        return keep


class Transforms:
    """Registry of DataFrame -> DataFrame steps by name; an unknown name is an error."""

    def __init__(self) -> None:
        self._by_name: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, f: Callable[..., DataFrame]) -> None:
        self._by_name[name] = f

    def apply(self, name: str, df: DataFrame, **options) -> DataFrame:
        if name not in self._by_name:
            raise ValueError(f"unknown transform {name!r}; known: {', '.join(sorted(self._by_name))}")
        return df.transform(self._by_name[name], **options)
