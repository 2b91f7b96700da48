"""Where queries start: named tables of a session, and versioned tables that can be written."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from thicket.operators.nest import NestSpec, hydrate
from thicket.operators.query import Query, key_tuple
from thicket.plans.spec import QuerySpec, Shape


class Tables:
    """Tables by name: frames, paths of Parquet files, or names of the session's catalog."""

    def __init__(self, spark: SparkSession, tables: dict[str, Any] | None = None, folder: str | None = None):
        self.spark, self._tables, self._folder = spark, dict(tables or {}), folder

    def __getitem__(self, name: str) -> DataFrame:
        table = self._tables.get(name)
        if isinstance(table, DataFrame):
            return table
        if isinstance(table, str):
            return self.spark.read.parquet(table)
        if table is not None:
            return table.current()
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet") if self._folder else self.spark.table(name)

    __call__ = __getitem__


class Engine:
    """Gives queries their first frame; ``engine.tables`` is what callbacks get."""

    def __init__(self, spark: SparkSession, tables: Tables | dict[str, Any] | None = None, folder: str | None = None):
        self.spark = spark
        self.tables = tables if isinstance(tables, Tables) else Tables(spark, tables, folder)

    def _frame(self, source: DataFrame | str | Callable[[Tables], DataFrame]) -> DataFrame:
        if isinstance(source, DataFrame):
            return source
        return self.tables[source] if isinstance(source, str) else source(self.tables)

    def select_as(self, alias: str, source: DataFrame | str | Callable[[Tables], DataFrame], key_by: str | list[str] = "id") -> Query:
        return Query(QuerySpec(alias, self._frame(source), Shape(keys=key_tuple(key_by))), self.tables)

    def insert_as(self, alias: str, write: Any, key_by: str | list[str] = "id") -> Query:
        """A query whose base is what a write returns."""
        return Query(QuerySpec(alias, write.returning, Shape(keys=key_tuple(key_by)), write=write), self.tables)

    update_as = delete_as = insert_as

    def write_as(self, alias: str, writes: Any, select: Callable[[dict[str, DataFrame]], DataFrame], key_by: str | list[str] = "id") -> Query:
        """A query over what several writes return, done together."""
        return Query(QuerySpec(alias, select(writes.returned), Shape(keys=key_tuple(key_by)), write=writes), self.tables)

    def hydrate(self, rows: Any, spec: NestSpec | Callable) -> DataFrame:
        return hydrate(rows, spec, self.spark)
