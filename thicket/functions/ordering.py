"""Ordering with explicit places for nulls: last when ascending, first when descending, unless stated."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Order:
    """One sort key: a column name, or a function from a scope to a column."""

    by: str | Callable
    descending: bool = False
    nulls_first: bool | None = None

    @property
    def first(self) -> bool:
        return self.descending if self.nulls_first is None else self.nulls_first

    def column(self, scope) -> Column:
        return scope[self.by] if isinstance(self.by, str) else self.by(scope)

    def sort(self, scope) -> Column:
        c = self.column(scope)
        if self.descending:
            return c.desc_nulls_first() if self.first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.first else c.asc_nulls_last()


def parse(direction: str = "asc", nulls: str | None = None) -> tuple[bool, bool | None]:
    if direction not in ("asc", "desc"):
        raise ValueError(f"direction must be asc or desc, not {direction!r}")
    if nulls not in (None, "first", "last"):
        raise ValueError(f"nulls must be first or last, not {nulls!r}")
    return direction == "desc", None if nulls is None else nulls == "first"


def _reversed(c: Column, kind: T.DataType) -> Column | None:
    """A column in the opposite order, where the type has one."""
    if isinstance(kind, T.BooleanType):
        return ~c
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return -c.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return -c
    if isinstance(kind, T.LongType):
        return -c.cast("decimal(20,0)")
    if isinstance(kind, T.DateType):
        return -F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return -F.unix_micros(c)
    return None


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def ordered_array(orders: list[Order], scope, kinds: list[T.DataType], value: Column) -> Column:
    """collect_list of ``value`` in the given order; sorted natively where the types allow, else by a comparator.

    kinds: the types of the orders' columns, and after them the value's.
    """
    keys, native = [], True
    for i, (o, kind) in enumerate(zip(orders, kinds)):
        c = o.column(scope)
        null = F.when(c.isNull(), F.lit(0 if o.first else 1)).otherwise(F.lit(1 if o.first else 0))
        key = _reversed(c, kind) if o.descending else c
        if key is None:
            native, key = False, c
        keys += [null.alias(f"n{i}"), key.alias(f"k{i}")]
    if not keys:
        return F.collect_list(value)
    pairs = F.collect_list(F.struct(F.struct(*keys).alias("order"), value.alias("value")))
    if native and len(kinds) > len(orders) and orderable(kinds[-1]):
        return F.transform(F.sort_array(pairs), lambda x: x["value"])  # values decide only between equal keys
    if native:
        # Values may not be orderable, so their places are sorted with the keys.
        placed = F.transform(pairs, lambda x, i: F.struct(x["order"].alias("order"), i.alias("at")))
        return F.transform(F.sort_array(placed), lambda x: F.get(pairs, x["at"])["value"])
    return F.transform(F.array_sort(pairs, _compare(orders, kinds)), lambda x: x["value"])


def _compare(orders: list[Order], kinds: list[T.DataType]) -> Callable[[Column, Column], Column]:
    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for i in reversed(range(len(orders))):
            a, b = x["order"][f"k{i}"], y["order"][f"k{i}"]
            m, n = x["order"][f"n{i}"], y["order"][f"n{i}"]
            back = orders[i].descending and _reversed(a, kinds[i]) is None
            less, more = (1, -1) if back else (-1, 1)
            out = F.when(m < n, -1).when(m > n, 1).when(a < b, less).when(a > b, more).otherwise(out)
        return out

    return compare
