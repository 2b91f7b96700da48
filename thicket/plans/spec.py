"""Immutable descriptions of queries; methods of the builder return changed copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame

from thicket.errors import KeyMismatchError
from thicket.functions.ordering import Order

SEPARATOR = "$$"


class Scope(Mapping):
    """A level's columns by plain name; ``alias.name`` and, for one-relations, ``key$$name`` also work."""

    def __init__(self, columns: Mapping[str, Column], aliases: Mapping[str, Mapping[str, Column]] | None = None):
        self._columns, self._aliases = dict(columns), dict(aliases or {})

    def __getitem__(self, name: str) -> Column:
        if name in self._columns:
            return self._columns[name]
        alias, dot, rest = name.partition(".")
        if dot and alias in self._aliases and rest in self._aliases[alias]:
            return self._aliases[alias][rest]
        raise KeyError(f"no column {name!r}; there are {sorted(self._columns)} and aliases {sorted(self._aliases)}")

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._columns)

    def __len__(self) -> int:
        return len(self._columns)


@dataclass(frozen=True)
class Shape:
    """What becomes of a level's rows on their way out."""

    keys: tuple[str, ...] = ("id",)
    fields: tuple[tuple[str, Any], ...] | None = None  # None: all columns
    omitted: frozenset[str] = frozenset()
    mapped_fields: tuple[tuple[str, Callable], ...] = ()
    extras: tuple[tuple[str, Callable], ...] = ()
    extenders: tuple[Callable, ...] = ()
    maps: tuple[Callable, ...] = ()
    orders: tuple[Order, ...] = ()
    order_by_keys: bool | None = None

    def merged(self, other: Shape) -> Shape:
        if self.keys != other.keys:
            raise KeyMismatchError(f"keys {self.keys} and {other.keys} differ")
        fields = self.fields if not other.fields else tuple({**dict(self.fields or ()), **dict(other.fields)}.items())
        return replace(
            self,
            fields=fields,
            omitted=self.omitted | other.omitted,
            mapped_fields=tuple({**dict(self.mapped_fields), **dict(other.mapped_fields)}.items()),
            extras=tuple({**dict(self.extras), **dict(other.extras)}.items()),
            extenders=self.extenders + other.extenders,
            maps=self.maps + other.maps,
            orders=self.orders + other.orders,
            order_by_keys=self.order_by_keys if other.order_by_keys is None else other.order_by_keys,
        )


@dataclass(frozen=True)
class Collection:
    """A relation of an entity: a join, or rows fetched for all parents at once."""

    mode: str  # many, one, one_or_throw
    method: str  # inner, left, cross, attach
    child: Any = None  # QuerySpec, or the fetch function of an attach
    on: tuple[str, str] | Callable | None = None
    lateral: bool = False
    match_child: tuple[str, ...] = ()
    to_parent: tuple[str, ...] = ()
    changes: tuple[Callable, ...] = ()
    fold: Callable | None = None  # what becomes of an attach's arrays

    @property
    def filters(self) -> bool:
        return self.method in ("inner", "cross")


@dataclass(frozen=True)
class QuerySpec:
    alias: str
    base: DataFrame
    shape: Shape = field(default_factory=Shape)
    collections: tuple[tuple[str, Collection], ...] = ()
    limit: int | None = None
    offset: int = 0
    hints: tuple[tuple[str, tuple], ...] = ()
    ends: tuple[Callable, ...] = ()
    write: Any = None

    def with_shape(self, **changes: Any) -> QuerySpec:
        return replace(self, shape=replace(self.shape, **changes))

    def with_collection(self, key: str, collection: Collection) -> QuerySpec:
        return replace(self, collections=tuple({**dict(self.collections), key: collection}.items()))

    def orders(self) -> list[Order]:
        """Own orderings, then the keys that they don't name."""
        own = list(self.shape.orders)
        if self.shape.order_by_keys is not False:
            named = {o.by for o in own}
            own += [Order(k) for k in self.shape.keys if k not in named]
        return own

    def page_orders(self) -> list[Order]:
        """The orderings that choose a page: always down to the key, so that a page is the same each time it is computed."""
        own = self.orders()
        return own + [Order(k) for k in self.shape.keys if k not in {o.by for o in own}]
