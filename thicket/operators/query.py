"""The query builder: immutable, lazily compiled to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import types as T

from thicket.errors import NestedWriteError, NoResultError, UnknownCollectionError, translated
from thicket.functions.ordering import Order, parse
from thicket.plans.compiler import Compiler, shaped
from thicket.plans.spec import Collection, QuerySpec, Scope, Shape


def key_tuple(key_by: str | Iterable[str]) -> tuple[str, ...]:
    return (key_by,) if isinstance(key_by, str) else tuple(key_by)


class ShapeMethods:
    """Methods that queries and nest specs share; ``_shape`` and ``_with_shape`` are theirs."""

    def extras(self, columns: dict[str, Callable[[Scope], Any]]):
        """Computed columns, each from the row as it came in; extras don't see each other."""
        return self._with_shape(extras=tuple({**dict(self._shape.extras), **columns}.items()))

    def extend(self, fn: Callable[[Scope], dict]):
        """A function that gives several columns; applied after extras."""
        return self._with_shape(extenders=(*self._shape.extenders, fn))

    def map_fields(self, columns: dict[str, Callable]):
        return self._with_shape(mapped_fields=tuple({**dict(self._shape.mapped_fields), **columns}.items()))

    def omit(self, names: Iterable[str]):
        """Input columns that don't come out; extras of the same name do, and so do fields mapped later."""
        names = frozenset(names)
        kept = tuple((k, f) for k, f in self._shape.mapped_fields if k not in names)
        return self._with_shape(omitted=self._shape.omitted | names, mapped_fields=kept)

    def order_by(self, by: str | Callable, direction: str = "asc", nulls: str | None = None):
        descending, first = parse(direction, nulls)
        return self._with_shape(orders=(*self._shape.orders, Order(by, descending, first)))

    def clear_order_by(self):
        return self._with_shape(orders=())

    def order_by_keys(self, on: bool = True):
        return self._with_shape(order_by_keys=on)


class Query(ShapeMethods):
    def __init__(self, spec: QuerySpec, tables: Any = None):
        self.spec, self._tables = spec, tables

    @property
    def _shape(self) -> Shape:
        return self.spec.shape

    def _with_shape(self, **changes: Any) -> Query:
        return self._with(shape=replace(self.spec.shape, **changes))

    def _with(self, **changes: Any) -> Query:
        return Query(replace(self.spec, **changes), self._tables)

    # the base

    def where(self, condition: Any) -> Query:
        """Filters the base, before any relation; a column, SQL text, or a function of the base's scope."""
        return self.modify(lambda df: df.where(condition(Scope({c: df[c] for c in df.columns})) if callable(condition) and not hasattr(condition, "_jc") else condition))

    def modify(self, target: str | Callable, change: Callable | None = None) -> Query:
        """Change the base frame, or with a key first, that collection's query (or what its fetch gave)."""
        if callable(target):
            return self._with(base=target(self.spec.base))
        collections = dict(self.spec.collections)
        if target not in collections:
            raise UnknownCollectionError(f"no collection {target!r}")
        if change is None:
            raise TypeError("modify(key, change) needs the change")
        c = collections[target]
        if c.method == "attach":
            c = replace(c, changes=(*c.changes, change))
        else:
            c = replace(c, child=change(Query(c.child, self._tables)).spec)
        return self._with(collections=tuple({**collections, target: c}.items()))

    def call(self, fn: Callable[[Query], Any]) -> Any:
        return fn(self)

    def limit(self, n: int) -> Query:
        """At most n entities, whatever their relations; 0 gives none."""
        return self._with(limit=n)

    def offset(self, n: int) -> Query:
        return self._with(offset=n)

    def clear_limit(self) -> Query:
        return self._with(limit=None)

    def clear_offset(self) -> Query:
        return self._with(offset=0)

    def hint(self, name: str, *arguments: Any) -> Query:
        """A Spark hint on the base."""
        return self._with(hints=(*self.spec.hints, (name, arguments)))

    modify_front = hint

    def modify_end(self, fn: Callable[[DataFrame], DataFrame]) -> Query:
        """A change of the page's frame, where there is a limit or an offset, before relations meet it."""
        return self._with(ends=(*self.spec.ends, fn))

    def map(self, fn: Callable[[Scope], Any]) -> Query:
        """A last step over finished entities: gives a dict of columns, or one column named ``value``."""
        return self._with_shape(maps=(*self.spec.shape.maps, fn))

    def merge(self, other: Any) -> Query:
        """Another spec's shape on top of this one; the keys must be the same."""
        return self._with(shape=self.spec.shape.merged(other._shape))

    # relations

    def _relation(self, key: str, child: Any, on: tuple, mode: str, method: str, lateral: bool) -> Query:
        if callable(child) and not isinstance(child, Query):
            child = child(lambda df, key_by="id": Query(QuerySpec(key, df, Shape(keys=key_tuple(key_by))), self._tables))
        elif isinstance(child, DataFrame):
            child = Query(QuerySpec(key, child), self._tables)
        if child.spec.write is not None:
            raise NestedWriteError(f"{key}: a write can't be joined")
        if len(on) == 2:
            on = tuple(on)
        elif len(on) == 1 and callable(on[0]):
            on = on[0]
        elif not on and method == "cross":
            on = None
        else:
            raise TypeError("a relation needs two columns, or a function of the scope that gives its condition")
        spec = replace(child.spec, alias=key)
        return Query(self.spec.with_collection(key, Collection(mode, method, spec, on, lateral)), self._tables)

    def inner_join_one(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "one", "inner", False)

    def inner_join_many(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "many", "inner", False)

    def left_join_one(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "one", "left", False)

    def left_join_one_or_throw(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "one_or_throw", "left", False)

    def left_join_many(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "many", "left", False)

    def cross_join_many(self, key: str, child: Any) -> Query:
        return self._relation(key, child, (), "many", "cross", False)

    # Of a lateral child, order, limit and offset count for each parent.

    def inner_join_lateral_one(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "one", "inner", True)

    def inner_join_lateral_many(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "many", "inner", True)

    def left_join_lateral_one(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "one", "left", True)

    def left_join_lateral_one_or_throw(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "one_or_throw", "left", True)

    def left_join_lateral_many(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "many", "left", True)

    def cross_join_lateral_many(self, key: str, child: Any, *on: Any) -> Query:
        return self._relation(key, child, on, "many", "inner" if on else "cross", True)

    def _attached(self, key: str, fetch: Callable, match_child: Any, to_parent: Any, mode: str, fold: Callable | None = None) -> Query:
        c = Collection(mode, "attach", fetch, match_child=key_tuple(match_child), to_parent=key_tuple(to_parent) if to_parent else (), fold=fold)
        return Query(self.spec.with_collection(key, c), self._tables)

    def attach_many(self, key: str, fetch: Callable[[DataFrame], Any], match_child: Any, to_parent: Any = None, fold: Callable[[Column], Column] | None = None) -> Query:
        """Rows that ``fetch`` gives for all parents at once: a frame, a query, or Python rows.

        ``fold``: what becomes of the array of a parent's rows; done once for all parents that share the array.
        """
        return self._attached(key, fetch, match_child, to_parent, "many", fold)

    def attach_one(self, key: str, fetch: Callable[[DataFrame], Any], match_child: Any, to_parent: Any = None) -> Query:
        return self._attached(key, fetch, match_child, to_parent, "one")

    def attach_one_or_throw(self, key: str, fetch: Callable[[DataFrame], Any], match_child: Any, to_parent: Any = None) -> Query:
        return self._attached(key, fetch, match_child, to_parent, "one_or_throw")

    # writes

    def insert(self, write: Any) -> Query:
        """The rows that a write returns become the base; relations see the tables as they were before it."""
        return self._with(base=write.returning, write=write)

    update = delete = write = insert

    # results

    @property
    def compiler(self) -> Compiler:
        return Compiler(self.spec)

    def base_df(self) -> DataFrame:
        return self.spec.base

    def joined_df(self) -> DataFrame:
        return self.compiler.joined()

    def query_df(self) -> DataFrame:
        """The flat rows of the page's entities, ``key$$column`` names, exploded by relations."""
        flat, page = self.joined_df(), self.compiler.page(self.spec).df
        if self.spec.limit is None and not self.spec.offset:
            return flat
        return flat.join(page.select(*self.spec.shape.keys), list(self.spec.shape.keys), "left_semi")

    def nested_df(self, by_key: bool = False) -> DataFrame:
        """One row for each entity, relations as native structs and arrays; sorted only if an order or a page was asked for, or with ``by_key``."""
        return self.compiler.nested(by_key)

    def assert_type(self, schema: T.StructType | str) -> Query:
        """This query; an error if its rows don't have these names and types."""
        want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if (have := self.nested_df().schema.simpleString()) != want.simpleString():
            raise TypeError(f"rows are {have}, not {want.simpleString()}")
        return self

    def plan_text(self) -> str:
        """The optimized logical plan of what ``nested_df`` computes."""
        return self.nested_df()._jdf.queryExecution().optimizedPlan().toString()

    def count_df(self) -> DataFrame:
        return self.compiler.count()

    def exists_df(self) -> DataFrame:
        return self.compiler.exists()

    def execute(self) -> list[Row]:
        with translated():
            df = self.nested_df(by_key=True)
            if self.spec.write is not None:
                df = self.spec.write.finish(df)
            return df.collect()

    def execute_count(self, cast: Callable = int) -> Any:
        with translated():
            return cast(self.count_df().first()[0])

    def execute_exists(self) -> bool:
        with translated():
            return bool(self.exists_df().first()[0])

    def execute_take_first(self) -> Row | None:
        one = 1 if self.spec.limit is None else min(1, self.spec.limit)
        rows = (self.limit(one) if self.spec.write is None else self).execute()
        return rows[0] if rows else None

    def execute_take_first_or_throw(self, error: Callable[[], Exception] | type[Exception] = NoResultError) -> Row:
        row = self.execute_take_first()
        if row is None:
            raise error()
        return row

    def hydrate(self, rows: Any) -> DataFrame:
        """Rows already fetched, flat and exploded, nested as this query would."""
        from thicket.operators.nest import spec_of

        return spec_of(self.spec).apply(rows, self._tables.spark if self._tables else None)

    def explain(self, mode: str = "formatted") -> None:
        self.nested_df().explain(mode)


__all__ = ["Query", "ShapeMethods", "key_tuple", "shaped"]
