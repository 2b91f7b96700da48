"""Nesting of rows that are flat and exploded already: grouping by key at each level, from the inside out."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.errors import MappedSpecError
from thicket.functions.ordering import Order, ordered_array
from thicket.operators.query import ShapeMethods, key_tuple
from thicket.plans.compiler import guarded, ref, shaped, struct_of
from thicket.plans.spec import SEPARATOR, QuerySpec, Scope, Shape

_AT = "__at"


@dataclass(frozen=True)
class NestSpec(ShapeMethods):
    """What a level's entities look like. Without ``auto`` only fields and extras come out."""

    _shape: Shape = field(default_factory=lambda: Shape(fields=()))
    children: tuple[tuple[str, tuple[str, str, NestSpec]], ...] = ()  # key -> (mode, prefix, spec)
    attached: tuple[tuple[str, tuple], ...] = ()  # key -> (mode, fetch, match_child, to_parent, fold)
    auto: bool = False

    def _with_shape(self, **changes: Any) -> NestSpec:
        if self._shape.maps and set(changes) - {"maps", "orders", "order_by_keys"}:
            raise MappedSpecError("map comes last")
        return replace(self, _shape=replace(self._shape, **changes))

    def fields(self, columns: dict[str, Any] | Iterable[str]) -> NestSpec:
        """Columns that come out: {name: True or a function}, or names."""
        new = columns if isinstance(columns, dict) else dict.fromkeys(columns, True)
        dropped = {k for k, f in new.items() if f is False}
        have = {**dict(self._shape.fields or ()), **{k: f for k, f in new.items() if f is not False}}
        return self._with_shape(fields=tuple(have.items()), omitted=(self._shape.omitted | dropped) - {k for k, f in new.items() if f is not False})

    def has(self, mode: str, key: str, prefix: str, child: NestSpec | Callable[[Callable], NestSpec]) -> NestSpec:
        if self._shape.maps:
            raise MappedSpecError("map comes last")
        child = child(nest_spec) if callable(child) else child
        return replace(self, children=tuple({**dict(self.children), key: (mode, prefix, child)}.items()))

    def has_many(self, key: str, prefix: str, child: Any) -> NestSpec:
        return self.has("many", key, prefix, child)

    def has_one(self, key: str, prefix: str, child: Any) -> NestSpec:
        return self.has("one", key, prefix, child)

    def has_one_or_throw(self, key: str, prefix: str, child: Any) -> NestSpec:
        return self.has("one_or_throw", key, prefix, child)

    def attach(self, mode: str, key: str, fetch: Callable, match_child: Any, to_parent: Any = None, fold: Callable | None = None) -> NestSpec:
        """Rows fetched once for the root's entities; ``fold``: what becomes of their array."""
        what = (mode, fetch, key_tuple(match_child), key_tuple(to_parent) if to_parent else (), fold)
        return replace(self, attached=tuple({**dict(self.attached), key: what}.items()))

    def map(self, fn: Callable[[Scope], Any]) -> NestSpec:
        return self._with_shape(maps=(*self._shape.maps, fn))

    def merge(self, other: NestSpec) -> NestSpec:
        return replace(self, _shape=self._shape.merged(other._shape), children=tuple({**dict(self.children), **dict(other.children)}.items()), attached=tuple({**dict(self.attached), **dict(other.attached)}.items()), auto=self.auto or other.auto)

    # nesting

    def apply(self, rows: Any, spark: SparkSession | None = None, sort: str = "all") -> DataFrame | Row:
        """A frame with a row for each entity of ``rows``: a flat frame, or Python rows. ``sort``: all levels, nested ones only, or none.

        Entities of Python rows, or sorted on all levels, come in the order of their first rows where no ordering tells them apart; one
        row (a dict or Row) gives one Row, whatever its key.
        """
        if sort not in ("all", "nested", "none"):
            raise ValueError(f"sort must be all, nested or none, not {sort!r}")
        if isinstance(rows, (dict, Row)):
            row = rows.asDict() if isinstance(rows, Row) else rows
            kinds = spark.createDataFrame([{k: v for k, v in row.items() if v is not None}]).schema
            schema = T.StructType([T.StructField(k, kinds[k].dataType if k in kinds.names else T.StringType()) for k in row])
            return self._applied(spark.createDataFrame([tuple(row.values())], schema), sort, True, True).first()
        frame = isinstance(rows, DataFrame)
        return self._applied(rows if frame else spark.createDataFrame(list(rows)), sort, not frame, False)

    def _applied(self, df: DataFrame, sort: str, in_order: bool, any_key: bool) -> DataFrame:
        df = df.withColumn(_AT, F.monotonically_increasing_id())
        made, columns = self._level(df, "", [], sort, any_key=any_key)
        orders = [o.sort(columns) for o in self._orders()] if sort == "all" else []
        if orders or in_order or sort == "all":
            made = made.orderBy(*orders, ref(_AT))
        out = self._out(columns, self._own(df, ""), self._collected(made))
        return made.select(*[c.alias(n) for n, c in out.items()])

    def _orders(self) -> list[Order]:
        own = list(self._shape.orders)
        if self._shape.order_by_keys:
            own += [Order(k) for k in self._shape.keys if k not in {o.by for o in own}]
        return own

    def _own(self, df: DataFrame, prefix: str) -> list[str]:
        """Plain names of this level's columns: those under the prefix, but under no child's."""
        below = tuple(prefix + p for _, (_, p, _) in self.children)
        names = [c for c in df.columns if c.startswith(prefix) and c != _AT and not c.startswith("__")]
        return [c[len(prefix) :] for c in names if not (below and c.startswith(below)) and SEPARATOR not in c[len(prefix) :]]

    def _out(self, scope: Scope, raw: list[str], results: dict[str, Column]) -> dict[str, Column]:
        shape = replace(self._shape, fields=None) if self.auto and not self._shape.fields else self._shape
        return shaped(shape, scope, raw, results, self.auto)

    def _collected(self, df: DataFrame) -> dict[str, Column]:
        return {key: self._result(df, key, mode) for key, (mode, _, _) in self.children} | {key: (fold or (lambda x: x))(self._result(df, key, mode)) for key, (mode, *_, fold) in self.attached}

    @staticmethod
    def _result(df: DataFrame, key: str, mode: str) -> Column:
        name = f"__many{SEPARATOR}{key}"
        array = F.coalesce(ref(name), F.array().cast(df.schema[name].dataType))
        return array if mode == "many" else guarded(F.size(array), F.get(array, F.lit(0)), mode, key)

    def _level(self, df: DataFrame, prefix: str, above: list[str], sort: str, exploded: bool = False, any_key: bool = False) -> tuple[DataFrame, Scope]:
        """(a row for each entity within each of the entities above, with its children's arrays; its columns).

        ``exploded``: an ancestor has several relations, so that rows repeat. Where they don't and there are no children, rows are entities.
        """
        keys = [prefix + k for k in self._shape.keys]
        for k in [] if any_key else keys:
            df = df.where(ref(k).isNotNull())
        by, raw = [*above, *keys], [prefix + c for c in self._own(df, prefix)]
        rest = [c for c in raw if c not in by]
        modes = [mode for _, (mode, _, _) in self.children]
        exploded = exploded or ("many" in modes and len(modes) > 1)
        if not self.children and not exploded:
            made = df.select(*[ref(c) for c in dict.fromkeys([*by, *rest, _AT])])
        else:
            first = F.min_by(F.struct(*[ref(c) for c in rest], ref(_AT)), ref(_AT)).alias("__first") if rest else F.struct(F.min(ref(_AT)).alias(_AT)).alias("__first")
            made = df.groupBy(*[ref(c) for c in by]).agg(first).select(*[ref(c) for c in by], *[F.col("__first")[c].alias(c) for c in [*rest, _AT]])
        for key, (_, under, child) in self.children:
            kids, scope = child._level(df, prefix + under, by, sort, exploded)
            value = struct_of(child._out(scope, [c for c in child._own(df, prefix + under)], child._collected(kids)))
            orders = child._orders() if sort != "none" else []
            columns = [o.column(scope) for o in orders] + [ref(_AT)]
            kinds = [f.dataType for f in kids.select(*[c.alias(f"c{i}") for i, c in enumerate([*columns, value])]).schema]
            array = ordered_array([*orders, Order(lambda _: ref(_AT))], scope, kinds, value).alias(f"__many{SEPARATOR}{key}")
            links = {c: f"__on{SEPARATOR}{i}" for i, c in enumerate(by)}
            lists = kids.groupBy(*[ref(c).alias(n) for c, n in links.items()]).agg(array)
            made = made.join(lists, [ref(c).eqNullSafe(ref(n)) for c, n in links.items()], "left").drop(*links.values())
        for key, (_, fetch, match_child, to_parent, _) in self.attached:
            made = self._attach(made, key, fetch, match_child, [prefix + p for p in to_parent] or keys, {c: c[len(prefix) :] for c in raw})
        return made, Scope({c[len(prefix) :]: ref(c) for c in raw})

    @staticmethod
    def _attach(made: DataFrame, key: str, fetch: Callable, match_child: tuple[str, ...], to_parent: list[str], names: dict[str, str]) -> DataFrame:
        fetched = fetch(made.select(*[ref(c).alias(n) for c, n in names.items()]).distinct())
        fetched = fetched.nested_df() if hasattr(fetched, "nested_df") else fetched if isinstance(fetched, DataFrame) else made.sparkSession.createDataFrame(list(fetched))
        value = F.struct(*[ref(c) for c in fetched.columns])
        array = ordered_array([Order(lambda _: F.col("__fetched"))], Scope({}), [fetched.withColumn("__fetched", F.monotonically_increasing_id()).schema["__fetched"].dataType], value)
        links = [f"__on{SEPARATOR}{i}" for i in range(len(match_child))]
        present = fetched.withColumn("__fetched", F.monotonically_increasing_id()).dropna(subset=list(match_child))
        lists = present.groupBy(*[ref(m).alias(x) for m, x in zip(match_child, links)]).agg(array.alias(f"__many{SEPARATOR}{key}"))
        return made.join(lists, [ref(p) == ref(x) for p, x in zip(to_parent, links)], "left").drop(*links)


def nest_spec(key_by: str | Iterable[str] = "id") -> NestSpec:
    return NestSpec(Shape(keys=key_tuple(key_by), fields=()))


def hydrate(rows: Any, spec: NestSpec | Callable[[Callable], NestSpec], spark: SparkSession | None = None, sort: str = "all") -> DataFrame:
    """Nest flat rows: a frame, or Python rows with a session."""
    return (spec(nest_spec) if callable(spec) else spec).apply(rows, spark, sort)


def spec_of(spec: QuerySpec) -> NestSpec:
    """How a query's flat rows nest."""
    keys_on = spec.shape.order_by_keys is not False
    out = NestSpec(replace(spec.shape, fields=spec.shape.fields or (), order_by_keys=keys_on), auto=spec.shape.fields is None)
    for key, c in spec.collections:
        if c.method == "attach":
            out = out.attach(c.mode, key, c.child, c.match_child, c.to_parent or None, c.fold)
        else:
            out = replace(out, children=(*out.children, (key, (c.mode, key + SEPARATOR, spec_of(c.child)))))
    return out
