"""Where output columns come from, read off the analysed plan, and decoding by it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.errors import AmbiguousColumnError
from thicket.functions.types import ColumnType


@dataclass(frozen=True)
class Provenance:
    """kind: column (of ``table``.``column``), derived (an expression), or unresolved."""

    kind: str
    table: str | None = None
    column: str | None = None


DERIVED, UNRESOLVED = Provenance("derived"), Provenance("unresolved")


def _items(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


class _Tracer:
    def __init__(self, tables: dict[str, DataFrame] | None):
        self.of: dict[str, Provenance] = {}
        self.named: dict[tuple[str, ...], str] = {}
        self.shared: dict[int, list[Provenance]] = {}  # of common table expressions
        for name, df in (tables or {}).items():
            for leaf in self._leaves(df._jdf.queryExecution().analyzed()):
                self.named[self._source(leaf)] = name

    def _leaves(self, plan: Any) -> list[Any]:
        kids = _items(plan.children())
        return [x for k in kids for x in self._leaves(k)] if kids else [plan]

    @staticmethod
    def _source(leaf: Any) -> tuple[str, ...]:
        """What tells one source from another: files, or a local relation's attributes by name and content."""
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation":
            location = leaf.relation().location() if hasattr(leaf.relation(), "location") else None
            return ("files", *sorted(p.toString() for p in _items(location.rootPaths()))) if location is not None else (leaf.relation().toString(),)
        if kind == "LogicalRDD":
            return (kind, str(leaf.rdd().id()))
        return (kind, *(f"{a.name()}#{a.exprId().id()}" for a in _items(leaf.output()))) if kind != "LocalRelation" else (kind, str(leaf.data().hashCode()), *(a.name() for a in _items(leaf.output())))

    @staticmethod
    def _id(attribute: Any) -> str:
        return f"{attribute.exprId().id()}-{attribute.exprId().jvmId()}"

    def _expression(self, e: Any) -> Provenance:
        kind = e.getClass().getSimpleName()
        if kind == "AttributeReference":
            return self.of.get(self._id(e), UNRESOLVED)
        return self._expression(e.child()) if kind == "Alias" else DERIVED

    def visit(self, plan: Any, view: str | None = None) -> None:
        kind = plan.getClass().getSimpleName()
        if kind == "SubqueryAlias" and plan.child().getClass().getSimpleName() in ("View", "LogicalRelation"):
            view = plan.identifier().name()
        kids = _items(plan.children())
        for k in kids:
            self.visit(k, view if len(kids) == 1 and kind in ("SubqueryAlias", "View", "Project") else None)
        if kind == "CTERelationRef":
            for a, p in zip(_items(plan.output()), self.shared.get(plan.cteId(), [])):
                self.of[self._id(a)] = p
            return
        if kind == "CTERelationDef":
            self.shared[plan.id()] = [self.of.get(self._id(a), UNRESOLVED) for a in _items(kids[0].output())]
            return
        if not kids:
            table = self.named.get(self._source(plan)) or view
            for a in _items(plan.output()):
                self.of[self._id(a)] = Provenance("column", table, a.name()) if table else UNRESOLVED
            return
        if kind in ("Project", "Aggregate"):
            for e in _items(plan.projectList() if kind == "Project" else plan.aggregateExpressions()):
                a = e.toAttribute()
                if self._id(a) not in self.of or e.getClass().getSimpleName() == "Alias":
                    self.of[self._id(a)] = self._expression(e)
            return
        if kind in ("Union", "Intersect", "Except"):
            sides = [[self.of.get(self._id(a), UNRESOLVED) for a in _items(k.output())] for k in kids]
            for i, a in enumerate(_items(plan.output())):
                own = {s[i] for s in sides}
                self.of[self._id(a)] = own.pop() if len(own) == 1 else DERIVED
            return
        for a in _items(plan.output()):  # windows, generators and the like make new attributes
            self.of.setdefault(self._id(a), DERIVED)


def trace(df: DataFrame, tables: dict[str, DataFrame] | None = None) -> dict[str, Provenance]:
    """Output column -> provenance. Tables are the session's views, and ``tables`` by name."""
    plan, tracer = df._jdf.queryExecution().analyzed(), _Tracer(tables)
    tracer.visit(plan)
    out: dict[str, Provenance] = {}
    for a in _items(plan.output()):
        if a.name() in out:
            raise AmbiguousColumnError(f"two columns are named {a.name()!r}")
        out[a.name()] = tracer.of.get(tracer._id(a), UNRESOLVED)
    return out


@dataclass(frozen=True)
class Mapped:
    """An expression with functions to apply to its decoded value, inner ones first."""

    column: Column
    functions: tuple[Callable[[Column], Column], ...]


def mapped(what: Column | Mapped, fn: Callable[[Column], Column]) -> Mapped:
    return Mapped(what.column, (*what.functions, fn)) if isinstance(what, Mapped) else Mapped(what, (fn,))


class Decoder:
    """Decodes the output columns that come from typed table columns; derived ones pass through."""

    def __init__(self, types: dict[str, dict[str, ColumnType]], tables: dict[str, DataFrame] | None = None):
        self.types, self.tables = types, tables

    def select(self, df: DataFrame, columns: dict[str, Column | Mapped | str]) -> DataFrame:
        """Select, decode what lineage finds, then apply mapped functions."""
        plain = {n: c.column if isinstance(c, Mapped) else F.col(c) if isinstance(c, str) else c for n, c in columns.items()}
        out = self.apply(df.select(*[c.alias(n) for n, c in plain.items()]))
        made = []
        for n, c in columns.items():
            x = F.col(f"`{n}`")
            for f in c.functions if isinstance(c, Mapped) else ():
                x = f(x)
            made.append(x.alias(n))
        return out.select(*made)

    def apply(self, df: DataFrame) -> DataFrame:
        found = trace(df, self.tables)
        return df.select(*[self._decode(found[c])(F.col(f"`{c}`")).alias(c) for c in df.columns])

    def _decode(self, p: Provenance) -> Callable[[Column], Column]:
        kind = self.types.get(p.table or "", {}).get(p.column or "")
        return kind.from_driver if kind else lambda c: c
