"""A Python data source for loading scripts: a function that yields rows for one of several parts."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class ScriptSource(DataSource):
    """format('script') with the options path (a Python file with SCHEMA, PARTS and rows(part)); no network."""

    @classmethod
    def name(cls) -> str:
        return "script"

    def _module(self):
        spec = importlib.util.spec_from_file_location("loading_script", self.options["path"])
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        return module

    def schema(self) -> str:
        return self._module().SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: ScriptSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.source._module().PARTS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.source._module().rows(partition.value)
