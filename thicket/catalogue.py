"""Queries that show each capability on the relational tables, each with DuckDB SQL for the same rows.

Nested results are reported by digests (how many, and the keys in order), so that any client can compare them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.lineage import Decoder, mapped, trace
from thicket.functions.types import embedded_timestamp, json
from thicket.operators.nest import hydrate, nest_spec
from thicket.sources.engine import Engine
from thicket.sources.versioned import VersionedTable, Writes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(fn: Callable[[Engine], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Engine(spark, folder=sf_dir))
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def n(array: str | Column) -> Column:
    return F.size(array).cast("long")


def keys(array: str | Column, *path: str) -> Column:
    """The keys of nested rows in order, as text."""
    column = F.col(array) if isinstance(array, str) else array
    for p in path[:-1]:
        column = F.flatten(F.transform(column, _field(p)))
    return F.array_join(F.transform(column, lambda x: x[path[-1]].cast("string")), ",")


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def customers(e: Engine, *columns: str):
    return e.select_as("customer", lambda t: t["customer"].select("c_custkey", *columns), "c_custkey")


def orders(t, *columns: str) -> DataFrame:
    return t["orders"].select("o_orderkey", "o_custkey", *columns)


def lines(t, *columns: str) -> DataFrame:
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *columns)


LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ORDER_LIST = "coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey), '')"


def with_orders(e: Engine):
    return customers(e, "c_name").left_join_many("orders", lambda qs: qs(orders(e.tables), "o_orderkey"), "orders.o_custkey", "customer.c_custkey")


@query(f"""
with page as (select c_custkey, c_name from customer order by c_custkey limit 20),
l as (select l_orderkey, count(*) as n, string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber, l_partkey, l_suppkey) as ls from lineitem group by l_orderkey),
o as (select o_custkey, o_orderkey, coalesce(l.n, 0) as n, l.ls from orders left join l on l_orderkey = o_orderkey)
select c_custkey, c_name, count(o_orderkey) as n_orders, {ORDER_LIST} as order_keys, cast(coalesce(sum(n), 0) as bigint) as n_lines,
  coalesce(string_agg(ls, ',' order by o_orderkey), '') as line_numbers
from page left join o on o_custkey = c_custkey group by c_custkey, c_name""")
def entity_page(e: Engine) -> DataFrame:
    """A page of customers with their orders and these with their lines; the limit counts customers."""
    q = customers(e, "c_name").left_join_many(
        "orders",
        lambda qs: qs(orders(e.tables), "o_orderkey").left_join_many("lines", lambda qs: qs(lines(e.tables), LINE_KEY), "lines.l_orderkey", "orders.o_orderkey"),
        "orders.o_custkey",
        "customer.c_custkey",
    )
    d = q.limit(20).nested_df()
    return d.select("c_custkey", "c_name", n("orders").alias("n_orders"), keys("orders", "o_orderkey").alias("order_keys"), n(F.flatten("orders.lines")).alias("n_lines"), keys("orders", "lines", "l_linenumber").alias("line_numbers"))


@query("select c_custkey, n_name from customer join nation on n_nationkey = c_nationkey")
def inner_join_one(e: Engine) -> DataFrame:
    q = customers(e, "c_nationkey").inner_join_one("nation", lambda qs: qs(e.tables["nation"], "n_nationkey"), "nation.n_nationkey", "customer.c_nationkey")
    return q.nested_df().select("c_custkey", F.col("nation.n_name").alias("n_name"))


@query(f"select c_custkey, count(*) as n_orders, {ORDER_LIST} as order_keys from customer join orders on o_custkey = c_custkey and o_totalprice > 150000 group by c_custkey")
def inner_join_many(e: Engine) -> DataFrame:
    """Customers without such an order are dropped."""
    big = orders(e.tables, "o_totalprice").where("o_totalprice > 150000")
    q = customers(e).inner_join_many("orders", lambda qs: qs(big, "o_orderkey"), "orders.o_custkey", "customer.c_custkey")
    return q.nested_df().select("c_custkey", n("orders").alias("n_orders"), keys("orders", "o_orderkey").alias("order_keys"))


@query("select d.doc_id, quality, l.doc_id is not null as labelled from documents d left join labels l on l.doc_id = d.doc_id")
def left_join_one(e: Engine) -> DataFrame:
    q = e.select_as("document", lambda t: t["documents"].select("doc_id"), "doc_id").left_join_one("label", lambda qs: qs(e.tables["labels"].select("doc_id", "quality"), "doc_id"), "label.doc_id", "document.doc_id")
    return q.nested_df().select("doc_id", F.col("label.quality").alias("quality"), F.col("label").isNotNull().alias("labelled"))


@query("select s_suppkey, n_name, r_name from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey")
def left_join_one_or_throw(e: Engine) -> DataFrame:
    """Each supplier must have a nation, and that a region."""
    nation = lambda qs: qs(e.tables["nation"], "n_nationkey").left_join_one_or_throw("region", lambda qs: qs(e.tables["region"], "r_regionkey"), "region.r_regionkey", "nation.n_regionkey")
    q = e.select_as("supplier", "supplier", "s_suppkey").left_join_one_or_throw("nation", nation, "nation.n_nationkey", "supplier.s_nationkey")
    return q.nested_df().select("s_suppkey", F.col("nation.n_name").alias("n_name"), F.col("nation.region.r_name").alias("r_name"))


@query(f"select c_custkey, count(o_orderkey) as n_orders, {ORDER_LIST} as order_keys from customer left join orders on o_custkey = c_custkey group by c_custkey")
def left_join_many(e: Engine) -> DataFrame:
    return with_orders(e).nested_df().select("c_custkey", n("orders").alias("n_orders"), keys("orders", "o_orderkey").alias("order_keys"))


@query("select n_nationkey, string_agg(r_name, ',' order by r_regionkey) as regions from nation cross join region group by n_nationkey")
def cross_join_many(e: Engine) -> DataFrame:
    q = e.select_as("nation", "nation", "n_nationkey").cross_join_many("regions", lambda qs: qs(e.tables["region"], "r_regionkey"))
    return q.nested_df().select("n_nationkey", keys("regions", "r_name").alias("regions"))


TOP = """with top as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders)
select c_custkey, {0} from customer {1} join top on o_custkey = c_custkey and k <= {2} group by c_custkey"""
TOP_LIST = "coalesce(string_agg(cast(o_orderkey as varchar), ',' order by k), '') as order_keys"


def top_orders(e: Engine, k: int):
    return lambda qs: qs(orders(e.tables, "o_totalprice"), "o_orderkey").order_by("o_totalprice", "desc").limit(k)


@query(TOP.format(TOP_LIST, "left", 3))
def left_join_lateral_many(e: Engine) -> DataFrame:
    """The three largest orders of each customer."""
    q = customers(e).left_join_lateral_many("top", top_orders(e, 3), "top.o_custkey", "customer.c_custkey")
    return q.nested_df().select("c_custkey", keys("top", "o_orderkey").alias("order_keys"))


@query(TOP.format(TOP_LIST, "", 2))
def inner_join_lateral_many(e: Engine) -> DataFrame:
    q = customers(e).inner_join_lateral_many("top", top_orders(e, 2), "top.o_custkey", "customer.c_custkey")
    return q.nested_df().select("c_custkey", keys("top", "o_orderkey").alias("order_keys"))


@query(TOP.format("max(o_orderkey) as o_orderkey", "left", 1))
def left_join_lateral_one(e: Engine) -> DataFrame:
    q = customers(e).left_join_lateral_one("top", top_orders(e, 1), "top.o_custkey", "customer.c_custkey")
    return q.nested_df().select("c_custkey", F.col("top.o_orderkey").alias("o_orderkey"))


@query(TOP.format("max(o_orderkey) as o_orderkey", "", 1))
def inner_join_lateral_one(e: Engine) -> DataFrame:
    q = customers(e).inner_join_lateral_one("top", top_orders(e, 1), "top.o_custkey", "customer.c_custkey")
    return q.nested_df().select("c_custkey", F.col("top.o_orderkey").alias("o_orderkey"))


@query("""with m as (select s.s_suppkey, t.s_suppkey as other, row_number() over (partition by s.s_suppkey order by t.s_acctbal, t.s_suppkey) as k
  from supplier s left join supplier t on t.s_nationkey = s.s_nationkey and t.s_acctbal > s.s_acctbal)
select s_suppkey, coalesce(string_agg(cast(other as varchar), ',' order by k), '') as others from m where k <= 2 group by s_suppkey""")
def lateral_by_inequality(e: Engine) -> DataFrame:
    """For each supplier the two next richer ones of its nation: a condition that isn't an equality."""
    s = e.tables["supplier"].select("s_suppkey", "s_nationkey", "s_acctbal")
    richer = lambda qs: qs(s, "s_suppkey").order_by("s_acctbal").limit(2)
    q = e.select_as("supplier", s, "s_suppkey").left_join_lateral_many("richer", richer, lambda c: [c["richer.s_nationkey"] == c["supplier.s_nationkey"], c["richer.s_acctbal"] > c["supplier.s_acctbal"]])
    return q.nested_df().select("s_suppkey", keys("richer", "s_suppkey").alias("others"))


@query("""with p as (select n_nationkey from nation), s as (select s_suppkey, row_number() over (order by s_acctbal desc, s_suppkey) as k from supplier)
select n_nationkey, (select string_agg(cast(s_suppkey as varchar), ',' order by k) from s where k <= 3) as suppliers from p""")
def cross_join_lateral_many(e: Engine) -> DataFrame:
    top = e.tables["supplier"].select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(3)
    q = e.select_as("nation", "nation", "n_nationkey").cross_join_lateral_many("suppliers", lambda qs: qs(top, "s_suppkey").order_by("s_acctbal", "desc"))
    return q.nested_df().select("n_nationkey", keys("suppliers", "s_suppkey").alias("suppliers"))


@query("""with o as (select o_custkey, count(*) as n from orders group by 1), v as (select user_id, count(*) as n, max(event_id) as last from events group by 1)
select c_custkey, n_name, cast(coalesce(o.n, 0) as bigint) as n_orders, cast(coalesce(v.n, 0) as bigint) as n_events, last as last_event
from customer join nation on n_nationkey = c_nationkey left join o on o_custkey = c_custkey left join v on user_id = c_custkey""")
def sibling_collections(e: Engine) -> DataFrame:
    """Two many-relations and a one-relation side by side: rows don't multiply."""
    q = (
        customers(e, "c_nationkey")
        .inner_join_one("nation", lambda qs: qs(e.tables["nation"], "n_nationkey"), "nation.n_nationkey", "customer.c_nationkey")
        .left_join_many("orders", lambda qs: qs(orders(e.tables), "o_orderkey"), "orders.o_custkey", "customer.c_custkey")
        .left_join_many("events", lambda qs: qs(e.tables["events"].select("event_id", "user_id"), "event_id"), "events.user_id", "customer.c_custkey")
    )
    return q.nested_df().select("c_custkey", F.col("nation.n_name").alias("n_name"), n("orders").alias("n_orders"), n("events").alias("n_events"), F.element_at(F.when(F.size("events") > 0, F.col("events")), -1)["event_id"].alias("last_event"))


@query("""with page as (select c_custkey, n_name, c_acctbal from customer join nation on n_nationkey = c_nationkey
  where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') order by n_name desc, c_acctbal, c_custkey limit 15 offset 5)
select c_custkey, n_name, count(*) as n_orders from page join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by c_custkey, n_name""")
def ordered_page(e: Engine) -> DataFrame:
    """Ordered by a relation's column, limited and offset, with a relation that filters."""
    final = orders(e.tables, "o_orderstatus").where("o_orderstatus = 'F'")
    q = (
        customers(e, "c_nationkey", "c_acctbal")
        .left_join_one("nation", lambda qs: qs(e.tables["nation"], "n_nationkey"), "nation.n_nationkey", "customer.c_nationkey")
        .inner_join_many("orders", lambda qs: qs(final, "o_orderkey"), "orders.o_custkey", "customer.c_custkey")
        .order_by("nation$$n_name", "desc")
        .order_by("c_acctbal")
        .limit(15)
        .offset(5)
    )
    return q.nested_df().select("c_custkey", F.col("nation.n_name").alias("n_name"), n("orders").alias("n_orders"))


@query("select count(*) as count from customer where c_acctbal > 0 and exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def entity_count(e: Engine) -> DataFrame:
    """Entities, not joined rows; the limit doesn't count."""
    big = orders(e.tables, "o_totalprice").where("o_totalprice > 250000")
    q = customers(e, "c_acctbal").where("c_acctbal > 0").inner_join_many("big", lambda qs: qs(big, "o_orderkey"), "big.o_custkey", "customer.c_custkey")
    return q.left_join_many("orders", lambda qs: qs(orders(e.tables), "o_orderkey"), "orders.o_custkey", "customer.c_custkey").limit(3).count_df()


@query("select exists (select 1 from orders where o_totalprice > 1e12) as exists")
def entity_exists(e: Engine) -> DataFrame:
    return e.select_as("order", lambda t: orders(t, "o_totalprice"), "o_orderkey").where("o_totalprice > 1e12").exists_df()


@query("""select c_custkey, upper(c_name) as c_name, c_acctbal * 2 as doubled, 'seg:' || c_mktsegment as segment, length(c_name) as name_length from customer""")
def shaped_fields(e: Engine) -> DataFrame:
    """Fields mapped, added, extended and left out."""
    q = (
        customers(e, "c_name", "c_acctbal", "c_mktsegment")
        .map_fields({"c_name": F.upper})
        .extras({"doubled": lambda r: r["c_acctbal"] * 2})
        .extend(lambda r: {"segment": F.concat(F.lit("seg:"), r["c_mktsegment"]), "name_length": F.length(r["c_name"]).cast("long")})
        .omit(["c_acctbal", "c_mktsegment"])
    )
    return q.nested_df()


@query("""select c_custkey, count(o_orderkey) as n_orders, coalesce(max(o_totalprice), 0.0) as largest from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def mapped_entities(e: Engine) -> DataFrame:
    """A terminal map that sees finished children, which were mapped before it."""
    price = lambda qs: qs(orders(e.tables, "o_totalprice"), "o_orderkey").map(lambda o: {"price": o["o_totalprice"]})
    q = customers(e).left_join_many("orders", price, "orders.o_custkey", "customer.c_custkey")
    return q.map(lambda c: {"c_custkey": c["c_custkey"], "n_orders": n(c["orders"]), "largest": F.coalesce(F.array_max(c["orders"]["price"]), F.lit(0.0))}).nested_df()


@query("select c_custkey, count(o_orderkey) as n_orders from customer left join orders on o_custkey = c_custkey and o_orderpriority = '1-URGENT' where c_mktsegment = 'BUILDING' group by c_custkey")
def modified_queries(e: Engine) -> DataFrame:
    """A query's base and one of its relations changed afterwards."""
    q = customers(e, "c_mktsegment").left_join_many("orders", lambda qs: qs(orders(e.tables, "o_orderpriority"), "o_orderkey"), "orders.o_custkey", "customer.c_custkey")
    q = q.modify("orders", lambda o: o.where("o_orderpriority = '1-URGENT'")).where(lambda c: c["c_mktsegment"] == "BUILDING")
    return q.nested_df().select("c_custkey", n("orders").alias("n_orders"))


@query(f"select c_custkey, count(o_orderkey) as n_orders, {ORDER_LIST} as order_keys from customer left join orders on o_custkey = c_custkey where c_acctbal < 0 group by c_custkey")
def attach_many(e: Engine) -> DataFrame:
    """Rows fetched once for all parents."""
    fetch = lambda parents: orders(e.tables).join(parents.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    q = customers(e, "c_acctbal").where("c_acctbal < 0").attach_many("orders", fetch, match_child="o_custkey", to_parent="c_custkey")
    d = q.nested_df().select("c_custkey", n("orders").alias("n_orders"), F.array_sort(F.transform("orders", lambda o: o["o_orderkey"])).alias("k"))
    return d.select("c_custkey", "n_orders", F.array_join(F.col("k").cast("array<string>"), ",").alias("order_keys"))


@query("select s_suppkey, n_name from supplier left join nation on n_nationkey = s_nationkey and n_regionkey = 1")
def attach_one(e: Engine) -> DataFrame:
    nations = e.select_as("nation", lambda t: t["nation"].where("n_regionkey = 1"), "n_nationkey")
    q = e.select_as("supplier", "supplier", "s_suppkey").attach_one("nation", lambda _: nations, match_child="n_nationkey", to_parent="s_nationkey")
    return q.nested_df().select("s_suppkey", F.col("nation.n_name").alias("n_name"))


@query(f"select c_custkey, c_name, count(o_orderkey) as n_orders, {ORDER_LIST} as order_keys from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name")
def hydrated_rows(e: Engine) -> DataFrame:
    """Flat, exploded rows nested again."""
    flat = with_orders(e).joined_df()
    spec = nest_spec("c_custkey").fields(["c_custkey", "c_name"]).has_many("orders", "orders$$", nest_spec("o_orderkey").fields(["o_orderkey"]).order_by_keys())
    return hydrate(flat, spec, sort="nested").select("c_custkey", "c_name", n("orders").alias("n_orders"), keys("orders", "o_orderkey").alias("order_keys"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, s_name from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey where l_quantity >= 49""")
def composite_keys(e: Engine) -> DataFrame:
    q = (
        e.select_as("line", lambda t: lines(t, "l_quantity"), LINE_KEY)
        .where("l_quantity >= 49")
        .left_join_one_or_throw("part", lambda qs: qs(e.tables["part"].select("p_partkey", "p_brand"), "p_partkey"), "part.p_partkey", "line.l_partkey")
        .left_join_one_or_throw("supplier", lambda qs: qs(e.tables["supplier"].select("s_suppkey", "s_name"), "s_suppkey"), "supplier.s_suppkey", "line.l_suppkey")
    )
    return q.nested_df().select(*LINE_KEY, F.col("part.p_brand").alias("p_brand"), F.col("supplier.s_name").alias("s_name"))


@query("""select r_name, count(n_nationkey) as n_nations, coalesce(string_agg(n_name, ',' order by n_name desc), '') as nations,
  cast(sum(k) as bigint) as n_suppliers from region left join (select n.*, (select count(*) from supplier where s_nationkey = n_nationkey) as k from nation n) on n_regionkey = r_regionkey group by r_name""")
def four_levels(e: Engine) -> DataFrame:
    """Regions, nations, suppliers, nested and ordered by text, descending."""
    suppliers = lambda qs: qs(e.tables["supplier"].select("s_suppkey", "s_nationkey"), "s_suppkey")
    nations = lambda qs: qs(e.tables["nation"], "n_nationkey").order_by("n_name", "desc").left_join_many("suppliers", suppliers, "suppliers.s_nationkey", "nations.n_nationkey")
    q = e.select_as("region", "region", "r_regionkey").left_join_many("nations", nations, "nations.n_regionkey", "region.r_regionkey")
    return q.nested_df().select("r_name", n("nations").alias("n_nations"), keys("nations", "n_name").alias("nations"), n(F.flatten("nations.suppliers")).alias("n_suppliers"))


NULLED = "coalesce(string_agg(cast(o_orderkey as varchar), ',' order by nullif(o_orderstatus, 'O') {0}, o_orderkey), '')"


@query(f"""select c_custkey, {NULLED.format('desc nulls last')} as down, {NULLED.format('asc nulls first')} as up, {NULLED.format('asc nulls last')} as up_last from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def null_ordering(e: Engine) -> DataFrame:
    """Relations ordered by a column with nulls, at either end."""
    own = orders(e.tables, "o_orderstatus").withColumn("status", F.nullif("o_orderstatus", F.lit("O")))
    q = customers(e)
    for key, direction, nulls in (("down", "desc", "last"), ("up", "asc", "first"), ("up_last", "asc", "last")):
        q = q.left_join_many(key, lambda qs, d=direction, x=nulls: qs(own, "o_orderkey").order_by("status", d, x), f"{key}.o_custkey", "customer.c_custkey")
    return q.nested_df().select("c_custkey", *[keys(k, "o_orderkey").alias(k) for k in ("down", "up", "up_last")])


@query("""select conv_id, count(*) as n_turns, string_agg(role, ',' order by turn) as roles, max(length(text)) as longest from conversations group by conv_id""")
def grouped_turns(e: Engine) -> DataFrame:
    """Conversations nested from their turns."""
    turns = e.tables["conversations"].select("conv_id", F.col("conv_id").alias("turns$$conv_id"), F.col("turn").alias("turns$$turn"), F.col("role").alias("turns$$role"), F.col("text").alias("turns$$text"))
    turn = nest_spec(["conv_id", "turn"]).fields({"turn": True, "role": True, "text": F.length}).order_by("turn")
    d = hydrate(turns, nest_spec("conv_id").fields(["conv_id"]).has_many("turns", "turns$$", turn), sort="nested")
    return d.select("conv_id", n("turns").alias("n_turns"), keys("turns", "role").alias("roles"), F.array_max("turns.text").cast("long").alias("longest"))


@query("""select event_id, cast(json_extract(props, '$.k') as bigint) as k, epoch_ms(cast(event_id * 1000 as bigint)) as at, event_id + 1 as next from events""")
def decoded_columns(e: Engine) -> DataFrame:
    """Typed columns decoded by lineage; derived ones pass through."""
    events = e.tables["events"].select("event_id", (F.col("event_id") * 1000).alias("at"), "props")
    table = events.select("event_id", "at", "props")
    d = Decoder({"events": {"props": json()}}, {"events": e.tables["events"]})
    out = d.select(table, {"event_id": "event_id", "k": mapped(F.col("props"), lambda v: F.try_variant_get(v, "$.k", "bigint")), "at": "at", "next": F.col("event_id") + 1})
    return out.withColumn("at", embedded_timestamp().from_driver(F.col("at")).cast("timestamp_ntz"))


@query("select * from (values ('c', 'column', 'customer', 'c_custkey'), ('name', 'column', 'customer', 'c_name'), ('n', 'derived', null, null), ('up', 'derived', null, null), ('w', 'derived', null, null)) as t(name, kind, \"table\", \"column\")")
def lineage(e: Engine) -> DataFrame:
    customer = e.tables["customer"]
    counted = e.tables["orders"].groupBy("o_custkey").agg(F.count("*").alias("n"))
    df = customer.alias("x").join(counted, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("c"), F.col("c_name").alias("name"), "n", F.upper("c_name").alias("up"), F.expr("row_number() over (order by c_custkey)").alias("w"))
    found = trace(df, {"customer": customer, "orders": e.tables["orders"]})
    return e.spark.createDataFrame([(k, p.kind, p.table, p.column) for k, p in found.items()], "name string, kind string, `table` string, `column` string")


def _scratch(e: Engine, name: str) -> str:
    folder = e.spark.conf.get("spark.checkpoint.dir", None) or e.spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="thicket-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _supplier_table(e: Engine) -> VersionedTable:
    old = e.tables["supplier"]
    table = VersionedTable(e.spark, _scratch(e, "supplier"), old.schema.simpleString()[7:-1].replace(":", " "), "s_suppkey")
    table.save(old)
    return table


def _returned(e: Engine, write) -> DataFrame:
    q = e.update_as("supplier", write, "s_suppkey").left_join_one("nation", lambda qs: qs(e.tables["nation"], "n_nationkey"), "nation.n_nationkey", "supplier.s_nationkey")
    d = q.spec.write.finish(q.nested_df())
    return d.select("s_suppkey", "s_name", "s_acctbal", F.col("nation.n_name").alias("n_name"))


@query("select s_suppkey, s_name, s_acctbal + 100 as s_acctbal, n_name from supplier join nation on n_nationkey = s_nationkey where s_acctbal < 0")
def update_returning(e: Engine) -> DataFrame:
    return _returned(e, _supplier_table(e).update({"s_acctbal": F.col("s_acctbal") + 100}, "s_acctbal < 0"))


@query("select s_suppkey, s_name, s_acctbal, n_name from supplier join nation on n_nationkey = s_nationkey where s_nationkey = 3")
def delete_returning(e: Engine) -> DataFrame:
    return _returned(e, _supplier_table(e).delete("s_nationkey = 3"))


@query("select max(s_suppkey) + 1 as s_suppkey, 'New' as s_name, cast(1.5 as double) as s_acctbal, (select n_name from nation where n_nationkey = 7) as n_name from supplier")
def insert_returning(e: Engine) -> DataFrame:
    return _returned(e, _supplier_table(e).insert([{"s_name": "New", "s_nationkey": 7, "s_acctbal": 1.5}]))


@query("select s_suppkey, s_name, (select count(*) from supplier where s_nationkey = 4) as n_deleted from supplier where s_nationkey = 3")
def several_writes(e: Engine) -> DataFrame:
    """Two writes under names, and a query over what they return."""
    one, two = _supplier_table(e), _supplier_table(e)
    writes = Writes(changed=one.update({"s_acctbal": 0.0}, "s_nationkey = 3"), deleted=two.delete("s_nationkey = 4"))
    q = e.write_as("supplier", writes, lambda w: w["changed"].join(w["deleted"].agg(F.count("*").alias("n_deleted")), how="inner"), "s_suppkey")
    return q.spec.write.finish(q.nested_df()).select("s_suppkey", "s_name", "n_deleted")
