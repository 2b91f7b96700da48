"""From a spec to DataFrames.

Each relation is aggregated by its join key before it meets its parent, so that siblings never multiply rows
and a page of parents stays a page. Equi-joins aggregate the child by its side of the condition; other conditions
meet the parents' keys first. With a page, children are first cut down to the page's parents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.errors import NestedWriteError, UnknownCollectionError, message
from thicket.functions.ordering import Order, ordered_array
from thicket.plans.spec import SEPARATOR, Collection, QuerySpec, Scope, Shape

#: A page of at most so many parents is broadcast to cut its children down.
PAGE_BROADCAST = 10_000

#: About so many parents meet an array in one place; arrays that more of them share go to several.
SHARING = 64


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _attribute(e: Any) -> Any | None:
    """The column that an expression is, perhaps as a wider whole number."""
    if e.getClass().getSimpleName() == "Cast" and {e.dataType().typeName(), e.child().dataType().typeName()} <= {"byte", "short", "integer", "long"}:
        e = e.child()
    return e if e.getClass().getSimpleName() == "AttributeReference" else None


def comparisons(joined: DataFrame) -> list[tuple[str, str, str]] | None:
    """(left frame's column, operator, right frame's column) of each part of a join's condition, or None if some part isn't such a comparison."""
    plan = joined._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "Join" or not plan.condition().isDefined():
        return None
    signs = {"EqualTo": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">="}
    turned = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
    out, parts = [], [plan.condition().get()]
    while parts:
        e = parts.pop()
        kind = e.getClass().getSimpleName()
        if kind == "And":
            parts += [e.left(), e.right()]
        elif kind != "Literal" or e.toString() != "true":
            a, b = (_attribute(e.left()), _attribute(e.right())) if kind in signs else (None, None)
            if a is None or b is None:
                return None
            if plan.left().outputSet().contains(a) and plan.right().outputSet().contains(b):
                out.append((a.name(), signs[kind], b.name()))
            elif plan.left().outputSet().contains(b) and plan.right().outputSet().contains(a):
                out.append((b.name(), turned[signs[kind]], a.name()))
            else:
                return None
    return out


class Level:
    """A compiled level: a frame with one row for each entity, and where its relations' results lie in it."""

    def __init__(self, spec: QuerySpec, df: DataFrame, raw: list[str]):
        self.spec, self.df, self.raw = spec, df, raw
        self.ones: dict[str, list[str]] = {}  # hoisted columns of one-relations
        self.results: dict[str, Column] = {}

    def scope(self) -> Scope:
        columns = {c: ref(c) for c in self.raw}
        aliases = {self.spec.alias: dict(columns)}
        for key, names in self.ones.items():
            columns |= {f"{key}{SEPARATOR}{c}": ref(f"{key}{SEPARATOR}{c}") for c in names}
            aliases[key] = {c: ref(f"{key}{SEPARATOR}{c}") for c in names}
        return Scope(columns, aliases)


def shaped(shape: Shape, scope: Scope, raw: list[str], results: Mapping[str, Column], auto: bool = True) -> dict[str, Column]:
    """A level's output columns: fields, extras, extenders, collections, then maps; later ones win."""
    changed = dict(shape.mapped_fields)
    out: dict[str, Column] = {}
    if shape.fields is None and auto:
        for c in raw:
            if c not in shape.omitted or c in changed:
                out[c] = changed[c](scope[c]) if c in changed else scope[c]
    else:
        for c, f in shape.fields or ():
            if c not in shape.omitted or c in changed:
                f = changed.get(c, f)
                out[c] = f(scope[c]) if callable(f) else scope[c]
    for name, f in shape.extras:
        out[name] = f(scope)
    for f in shape.extenders:
        out |= f(scope)
    out |= results
    for f in shape.maps:
        made = f(Scope(out))
        out = dict(made) if isinstance(made, Mapping) else {"value": made}
    return out


def struct_of(columns: Mapping[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def _kinds(df: DataFrame, columns: list[Column]) -> list[T.DataType]:
    return [f.dataType for f in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).schema]


def guarded(n: Column, value: Column, mode: str, what: str) -> Column:
    """``value`` if there is one row, as the mode asks; the check is part of the emitted value, so it isn't pruned away."""
    several = F.raise_error(F.lit(message("cardinality", f"{what}: more than one row where one was expected")))
    out = F.when(n > 1, several)
    if mode == "one_or_throw":
        return out.when(n.isNull() | (n == 0), F.raise_error(F.lit(message("missing", f"{what}: no row where one was expected")))).otherwise(value)
    return out.when(n == 1, value)


def _local(name: str, alias: str) -> str | None:
    """The plain name of a column of ``alias``, or None if it belongs to another."""
    head, dot, rest = name.partition(".")
    return rest if dot and head == alias else None if dot else name


class Compiler:
    def __init__(self, spec: QuerySpec):
        self.spec = spec

    # the base and its page

    def base(self, spec: QuerySpec) -> DataFrame:
        df = spec.base
        for name, arguments in spec.hints:
            df = df.hint(name, *arguments)
        return df

    def keyed(self, spec: QuerySpec) -> DataFrame:
        """The base's rows that are entities: those without a null in their key."""
        df = self.base(spec)
        for k in spec.shape.keys:
            if k in df.columns:
                df = df.where(ref(k).isNotNull())
        return df

    def _needs(self, spec: QuerySpec, key: str) -> bool:
        """Whether the orderings refer to the one-relation ``key``, as far as one can tell."""
        return any(not isinstance(o.by, str) or o.by.startswith((key + SEPARATOR, key + ".")) for o in spec.shape.orders)

    def filtered(self, spec: QuerySpec, restrict: Callable[[DataFrame], DataFrame] | None = None) -> Level:
        """Entities that all inner and cross relations leave, one row each; inner relations only filter here."""
        df = self.keyed(spec)
        level = Level(spec, restrict(df) if restrict else df, df.columns)
        for key, c in spec.collections:
            if c.filters:
                self._semi(level, key, c)
        return level

    def _semi(self, level: Level, key: str, c: Collection) -> None:
        child = self.filtered(c.child)
        if c.on is None and c.method == "cross":
            some = child.df.select(F.lit(1).alias("one")).limit(1)
            level.df = level.df.crossJoin(F.broadcast(some)).drop("one")  # one row at most
            return
        kid, renamed = self._renamed(child.df, child.raw, key)
        on = self._condition(level, c, key, renamed)
        level.df = level.df.join(kid, on, "left_semi")

    @staticmethod
    def _renamed(df: DataFrame, raw: list[str], key: str) -> tuple[DataFrame, dict[str, Column]]:
        names = {c: f"{key}{SEPARATOR}{SEPARATOR}{c}" for c in raw}
        return df.select(*[ref(c).alias(n) for c, n in names.items()]), {c: ref(n) for c, n in names.items()}

    def _condition(self, level: Level, c: Collection, key: str, child: Mapping[str, Column]) -> Column:
        own = level.scope()
        scope = Scope({**child, **own}, {**own._aliases, key: child})
        if callable(c.on):
            made = c.on(scope)
            parts = made if isinstance(made, (list, tuple)) else [made]
            out = F.lit(True)
            for p in parts:
                out = out & p
            return out
        if c.on is None:
            return F.lit(True)
        k, p = self._sides(level, c, key)
        return child[k] == own[p]

    @staticmethod
    def _sides(level: Level, c: Collection, key: str) -> tuple[str, str]:
        """(child's column, parent's column) of an equi-join written in either order."""
        a, b = c.on
        if a.startswith(key + "."):
            return _local(a, key), _local(b, level.spec.alias) or b
        if b.startswith(key + "."):
            return _local(b, key), _local(a, level.spec.alias) or a
        return a, _local(b, level.spec.alias) or b

    def page(self, spec: QuerySpec) -> Level:
        """The entities of the page, in no particular order."""
        level = self.filtered(spec)
        for key, c in spec.collections:
            if c.mode != "many" and c.method != "attach" and self._needs(spec, key):
                self._join(level, key, c, None)
        if spec.limit is not None or spec.offset:
            df = level.df.orderBy(*[o.sort(level.scope()) for o in spec.page_orders()])
            df = df.offset(spec.offset) if spec.offset else df
            level.df = df.limit(spec.limit) if spec.limit is not None else df
            for end in spec.ends:
                level.df = end(level.df)
        return level

    # relations

    def level(self, spec: QuerySpec, restrict: Callable[[DataFrame], DataFrame] | None = None) -> Level:
        """The page with all its relations."""
        level = self.page(spec) if restrict is None else self.filtered(spec, restrict)
        small = spec.limit is not None and spec.limit <= PAGE_BROADCAST
        page = level.df if spec.limit is not None or restrict is not None else None
        fetched = self._fetched(level)
        for key, c in spec.collections:
            if key in level.results:
                continue
            if c.method == "attach":
                self._attach(level, key, c, fetched[key])
            else:
                self._join(level, key, c, page, small)
        level.results = {key: level.results[key] for key, _ in spec.collections}
        return level

    def _child(self, key: str, c: Collection, restrict: Callable | None) -> Level:
        spec = c.child
        if spec.write is not None:
            raise NestedWriteError(f"{key}: a write can't be joined")
        if c.lateral or (spec.limit is None and not spec.offset):
            # Of a lateral child, limit and offset count for each parent.
            return self.level(QuerySpec(spec.alias, spec.base, spec.shape, spec.collections, hints=spec.hints), restrict or (lambda df: df))
        return self.level(spec)

    def _join(self, level: Level, key: str, c: Collection, page: DataFrame | None, small: bool = False) -> None:
        equal = isinstance(c.on, tuple)
        restrict = None
        if equal and page is not None:
            child_column, parent_column = self._sides(level, c, key)
            if parent_column in level.raw:
                keys = page.select(ref(parent_column).alias("__page")).distinct()
                keys = F.broadcast(keys) if small else keys  # at most PAGE_BROADCAST rows

                def restrict(df: DataFrame) -> DataFrame:
                    return df.join(keys, ref(child_column) == F.col("__page"), "left_semi")

        child = self._child(key, c, restrict)
        value = struct_of(shaped(child.spec.shape, child.scope(), child.raw, child.results))
        orders = child.spec.orders()
        if c.on is None and c.method == "cross":
            self._cross(level, key, child, value, orders)
        elif equal:
            self._equal(level, key, c, child, value, orders)
        else:
            self._theta(level, key, c, child, value, orders)

    def _listed(self, child: Level, value: Column, orders: list[Order]) -> Column:
        return ordered_array(orders, child.scope(), _kinds(child.df, [*(o.column(child.scope()) for o in orders), value]), value)

    def _cross(self, level: Level, key: str, child: Level, value: Column, orders: list[Order]) -> None:
        """Every parent gets the same array, made once; a cross-joined relation is meant to be small."""
        name = f"{key}{SEPARATOR}"
        array = child.df.agg(self._listed(child, value, orders).alias(name)).where(F.size(ref(name)) > 0)
        level.df = level.df.crossJoin(array)
        level.results[key] = ref(name)

    def _ranked(self, child: Level, by: list[Column], spec: QuerySpec) -> Level:
        """Children within limit and offset for each parent."""
        if spec.limit is None and not spec.offset:
            return child
        orders = [o.sort(child.scope()) for o in spec.orders()] or [F.lit(1)]
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*orders))
        child.df = self._within(child.df.withColumn("__place", place), spec).drop("__place")
        return child

    @staticmethod
    def _within(df: DataFrame, spec: QuerySpec) -> DataFrame:
        within = F.col("__place") > spec.offset
        if spec.limit is not None:
            within = within & (F.col("__place") <= spec.offset + spec.limit)
        return df.where(within)

    def _equal(self, level: Level, key: str, c: Collection, child: Level, value: Column, orders: list[Order]) -> None:
        child_column, parent_column = self._sides(level, c, key)
        on = child.scope()[child_column]
        if c.lateral:
            self._ranked(child, [on], c.child)
        link, name = f"{key}{SEPARATOR}{SEPARATOR}on", f"{key}{SEPARATOR}"
        parent = level.scope()[parent_column]
        how = "inner" if c.filters else "left"
        if c.mode == "many":
            # A list of structs has no orderable type, so this is a sort- or object-hash aggregate after one exchange on the key.
            lists = child.df.where(on.isNotNull()).groupBy(on.alias(link)).agg(self._listed(child, value, orders).alias(name))
            level.df = self._shared(level, lists, [parent], [link], how, [_local(parent_column, level.spec.alias) or parent_column])
            kind = lists.schema[name].dataType
            level.results[key] = F.coalesce(ref(name), F.array().cast(kind)) if how == "left" else ref(name)
            return
        columns = list(child.scope())
        row = F.struct(*[child.scope()[x].alias(x) for x in columns], value.alias(SEPARATOR))
        ones = child.df.where(on.isNotNull()).groupBy(on.alias(link)).agg(F.first(row).alias(name), F.count("*").alias(name + "n"))
        level.df = self._hoisted(level.df.join(ones, parent == ref(link), how).drop(link), key, columns)
        level.ones[key] = columns
        level.results[key] = guarded(ref(name + "n"), ref(name)[SEPARATOR], c.mode, key)

    @staticmethod
    def _hoisted(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
        name = f"{key}{SEPARATOR}"
        return df.select("*", *[ref(name)[x].alias(name + x) for x in columns])

    @staticmethod
    def _shared(level: Level, lists: DataFrame, parent: list[Column], links: list[str], how: str, names: Iterable[str]) -> DataFrame:
        """Parents with their arrays, of which there is one for each value of ``links``.

        Where the parents aren't one for each value, results are larger than what they are made from, and what a task makes doesn't show
        in what it reads. So the parents of an array are dealt into parts of about SHARING, each with its copy of the array: results
        are then at most about SHARING times what is read, and tasks are cut by that. No side is broadcast, else the parents stay
        in as few tasks as they are read in.
        """
        keys = level.spec.shape.keys
        if set(keys) <= set(names):
            return level.df.join(lists, [p == ref(x) for p, x in zip(parent, links)], how).drop(*links)
        sizes = level.df.groupBy(*[p.alias(f"__of{i}") for i, p in enumerate(parent)]).agg(F.ceil(F.count("*") / SHARING).cast("int").alias("__parts"))
        of = [F.col(f"__of{i}") for i in range(len(parent))]
        given = [f"__of{i}" for i in range(len(parent))] + ["__parts"]
        copies = lists.join(sizes, [ref(x) == o for x, o in zip(links, of)], "inner").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop(*given)
        dealt = level.df.join(sizes, [p == o for p, o in zip(parent, of)], "left").withColumn("__part", F.pmod(F.xxhash64(*[ref(k) for k in keys]), F.col("__parts")).cast("int")).drop(*given)
        on = [*(p == ref(x) for p, x in zip(parent, links)), F.col("__part") == F.col("__copy")]
        return dealt.join(copies.hint("merge"), on, how).drop(*links, "__part", "__copy")

    def _theta(self, level: Level, key: str, c: Collection, child: Level, value: Column, orders: list[Order]) -> None:
        """Any condition: the parents' columns meet the children, and the matches are aggregated by parent key."""
        name, keys = f"{key}{SEPARATOR}", list(level.spec.shape.keys)
        columns = list(child.scope())
        inner = {x: f"{key}{SEPARATOR}{SEPARATOR}{x}" for x in columns}
        kid = child.df.select(*[child.scope()[x].alias(n) for x, n in inner.items()], value.alias("__value"))
        renamed = {x: ref(n) for x, n in inner.items()}
        parents = level.df.select(*[ref(x) for x in level.raw], *[ref(f"{k}{SEPARATOR}{x}") for k, names in level.ones.items() for x in names])
        met = parents.join(kid, self._condition(level, c, key, renamed), "inner")
        scope = Scope(renamed, {child.spec.alias: renamed})
        if c.lateral and (c.child.limit is not None or c.child.offset):
            sort = [o.sort(scope) for o in c.child.orders()] or [F.lit(1)]
            near = self._nearest(met, parents, kid, keys, c.child, inner, sort)
            if near is None:
                place = F.row_number().over(Window.partitionBy(*[ref(k) for k in keys]).orderBy(*sort))
                met = self._within(met.withColumn("__place", place), c.child)
            else:
                met = near
        how = "inner" if c.filters else "left"
        by = [ref(k).alias(f"__key{i}") for i, k in enumerate(keys)]
        join = lambda df: level.df.join(df, [ref(k) == F.col(f"__key{i}") for i, k in enumerate(keys)], how).drop(*[f"__key{i}" for i in range(len(keys))])
        if c.mode == "many":
            lists = met.groupBy(*by).agg(ordered_array(orders, scope, _kinds(met, [*(o.column(scope) for o in orders), F.col("__value")]), F.col("__value")).alias(name))
            level.df = join(lists)
            level.results[key] = F.coalesce(ref(name), F.array().cast(lists.schema[name].dataType)) if how == "left" else ref(name)
            return
        row = F.struct(*[ref(n).alias(x) for x, n in inner.items()], F.col("__value").alias(SEPARATOR))
        ones = met.groupBy(*by).agg(F.first(row).alias(name), F.count("*").alias(name + "n"))
        level.df = self._hoisted(join(ones), key, columns)
        level.ones[key] = columns
        level.results[key] = guarded(ref(name + "n"), ref(name)[SEPARATOR], c.mode, key)

    def _nearest(self, met: DataFrame, parents: DataFrame, kid: DataFrame, keys: list[str], spec: QuerySpec, inner: Mapping[str, str], sort: list[Column]) -> DataFrame | None:
        """A lateral child's matches within limit and offset, without making all matches; None if the condition has another form.

        The condition has equalities and at most one inequality, which is on the column that the child is ordered by first. Then a
        parent's matches are the end of its group in that order: their places follow from how many children come before the
        parent, and only the children at the wanted places are joined.
        """
        found = comparisons(met)
        if found is None:
            return None
        equal = [(a, b) for a, op, b in found if op == "="]
        other = [(a, op, b) for a, op, b in found if op != "="]
        orders = spec.orders()
        if len(other) > 1 or not (equal or other):
            return None
        if other and not (orders and isinstance(orders[0].by, str) and inner.get(orders[0].by) == other[0][2] and orders[0].descending == (other[0][1][0] == ">")):
            return None
        for _, _, b in found:
            kid = kid.where(ref(b).isNotNull())
        kid = kid.withColumn("__place", F.row_number().over(Window.partitionBy(*[ref(b) for _, b in equal]).orderBy(*sort)))
        on = [ref(a) == ref(b) for a, b in equal]
        if not other:
            return parents.join(self._within(kid, spec), on, "inner")
        (a, op, b), groups = other[0], [f"__group{i}" for i in range(len(equal))]
        for x, _, _ in found:
            parents = parents.where(ref(x).isNotNull())
        # Of equal values, children come before the parent if they don't match.
        turn = F.lit(1 if op in "<>" else -1)
        marks = parents.select(*[ref(x).alias(g) for (x, _), g in zip(equal, groups)], ref(a).alias("__value0"), turn.alias("__turn"), F.lit(0).alias("__kid"), *[ref(k) for k in keys])
        own = kid.select(*[ref(x).alias(g) for (_, x), g in zip(equal, groups)], ref(b).alias("__value0"), F.lit(0).alias("__turn"), F.lit(1).alias("__kid"), *[F.lit(None).cast(parents.schema[k].dataType).alias(k) for k in keys])
        group = Window.partitionBy(*[ref(g) for g in groups])
        value = F.col("__value0").desc() if orders[0].descending else F.col("__value0").asc()
        before = F.sum("__kid").over(group.orderBy(value, "__turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        marks = marks.unionByName(own).withColumn("__before", before).withColumn("__all", F.sum("__kid").over(group)).where("__kid = 0")
        first, last = F.col("__before") + spec.offset + 1, F.col("__all")
        if spec.limit is not None:
            last = F.least(last, F.col("__before") + spec.offset + spec.limit)
        wanted = marks.select("*", first.alias("__first"), last.alias("__last")).where("__first <= __last")
        wanted = wanted.select(*groups, *[ref(k) for k in keys], F.explode(F.sequence("__first", "__last")).alias("__wanted"))
        on = [ref(g) == ref(x) for (_, x), g in zip(equal, groups)]
        return wanted.join(kid, [*on, F.col("__wanted") == F.col("__place")], "inner")

    def _fetched(self, level: Level) -> dict[str, DataFrame]:
        """What the fetch functions of a level give, each called once with all parents; they run at the same time."""
        attached = [(key, c) for key, c in level.spec.collections if c.method == "attach"]
        if not attached:
            return {}
        parents = level.df.select(*[ref(x) for x in level.raw])

        def fetch(c: Collection) -> DataFrame:
            rows = c.child(parents)
            if not isinstance(rows, DataFrame) and not hasattr(rows, "nested_df"):
                rows = level.df.sparkSession.createDataFrame(list(rows))
            for change in c.changes:
                rows = change(rows)
            return rows.nested_df() if hasattr(rows, "nested_df") else rows

        with ThreadPoolExecutor(len(attached)) as pool:
            return dict(zip((key for key, _ in attached), pool.map(fetch, (c for _, c in attached))))

    def _attach(self, level: Level, key: str, c: Collection, fetched: DataFrame) -> None:
        """Fetched rows are matched by key columns."""
        name = f"{key}{SEPARATOR}"
        links = [f"{key}{SEPARATOR}{SEPARATOR}{i}" for i in range(len(c.match_child))]
        value = F.struct(*[ref(x) for x in fetched.columns])
        present = fetched
        for m in c.match_child:
            present = present.where(ref(m).isNotNull())
        # Lists keep the fetched order, as far as a frame has one.
        present = present.withColumn("__at", F.monotonically_increasing_id())
        listed = ordered_array([Order(lambda _: F.col("__at"))], Scope({}), _kinds(present, [F.col("__at"), value]), value)
        groups = present.groupBy(*[ref(m).alias(x) for m, x in zip(c.match_child, links)]).agg(listed.alias(name))
        to_parent = c.to_parent or level.spec.shape.keys
        if c.mode == "many":
            none = F.array().cast(groups.schema[name].dataType)
            if c.fold is not None:
                groups = groups.withColumn(name, F.struct(c.fold(ref(name)).alias("folded")))
            level.df = self._shared(level, groups, [ref(p) for p in to_parent], links, "left", to_parent)
            level.results[key] = F.coalesce(ref(name), none) if c.fold is None else F.when(ref(name).isNull(), c.fold(none)).otherwise(ref(name)["folded"])
        else:
            level.df = level.df.join(groups, [ref(p) == ref(x) for p, x in zip(to_parent, links)], "left").drop(*links)
            level.results[key] = guarded(F.size(F.coalesce(ref(name), F.array().cast(groups.schema[name].dataType))), F.get(ref(name), F.lit(0)), c.mode, key)

    # results

    def nested(self, by_key: bool = False) -> DataFrame:
        """Sorted if an order was asked for or there is a page; with ``by_key`` always."""
        level = self.level(self.spec)
        sort = by_key or self.spec.shape.orders or self.spec.limit is not None or self.spec.offset
        orders = [o.sort(level.scope()) for o in self.spec.orders()] if sort else []
        df = level.df.orderBy(*orders) if orders else level.df
        out = shaped(self.spec.shape, level.scope(), level.raw, level.results)
        return df.select(*[c.alias(n) for n, c in out.items()])

    def count(self) -> DataFrame:
        """One row with the number of entities; limits and orders don't count, left relations aren't joined."""
        return self.filtered(self.spec).df.agg(F.count("*").alias("count"))

    def exists(self) -> DataFrame:
        some = self.filtered(self.spec).df.select(F.lit(1).alias("one")).limit(1)
        return some.agg((F.count("*") > 0).alias("exists"))

    def joined(self, spec: QuerySpec | None = None) -> DataFrame:
        """The exploded flat rows with ``key$$column`` names, for inspection; no limit, no order."""
        spec = spec or self.spec
        df = self.keyed(spec)
        level = Level(spec, df, df.columns)
        for key, c in spec.collections:
            if c.method == "attach":
                continue
            flat = self.joined(c.child)
            kid = flat.select(*[ref(x).alias(f"{key}{SEPARATOR}{x}") for x in flat.columns])
            child = {x: ref(f"{key}{SEPARATOR}{x}") for x in flat.columns}
            on = self._condition(level, c, key, child)
            level.df = level.df.join(kid, on, {"cross": "inner"}.get(c.method, c.method))
        return level.df

    def collection(self, key: str) -> Collection:
        try:
            return dict(self.spec.collections)[key]
        except KeyError:
            raise UnknownCollectionError(f"no collection {key!r}") from None
