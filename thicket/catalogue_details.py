"""More registered queries: what the ones of ``catalogue`` don't show, compared by nested field values."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.catalogue import LINE_KEY, _scratch, _supplier_table, customers, lines, n, orders, query
from thicket.errors import EngineError
from thicket.operators.nest import hydrate, nest_spec
from thicket.sources.engine import Engine
from thicket.sources.versioned import VersionedTable


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("long")


def listed(array: str | Column, *fields: str) -> Column:
    """Nested rows in order, as text: their fields with colons between."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ",")


PRICED = "coalesce(string_agg(concat_ws(':', o_orderkey, cents, o_orderstatus), ',' order by {0}), '')"
ORDERS = "(select *, cast(round(o_totalprice * 100) as bigint) as cents from orders)"


def priced(e: Engine, *more: str) -> DataFrame:
    return orders(e.tables, "o_totalprice", "o_orderstatus", *more).withColumn("cents", cents(F.col("o_totalprice")))


def price_list(array: str | Column = "orders") -> Column:
    return listed(array, "o_orderkey", "cents", "o_orderstatus")


def of_customer(e: Engine, change=lambda q: q, key: str = "orders"):
    return customers(e, "c_name").left_join_many(key, lambda qs: change(qs(priced(e), "o_orderkey")), f"{key}.o_custkey", "customer.c_custkey")


@query(f"select c_custkey, c_name, {PRICED.format('o_orderkey')} as orders from customer left join {ORDERS} on o_custkey = c_custkey group by all")
def nested_values(e: Engine) -> DataFrame:
    """Several fields of nested rows in the key's order."""
    return of_customer(e).nested_df().select("c_custkey", "c_name", price_list().alias("orders"))


@query("""select o_orderkey, c_custkey, c_name, n_name from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey""")
def left_join_lateral_one_or_throw(e: Engine) -> DataFrame:
    """For each order the first customer with its id, which there must be, and that one's nation."""
    nation = lambda qs: qs(e.tables["nation"], "n_nationkey").limit(1)
    customer = lambda qs: qs(e.tables["customer"].select("c_custkey", "c_name", "c_nationkey"), "c_custkey").limit(1).left_join_lateral_one_or_throw("nation", nation, "nation.n_nationkey", "customer.c_nationkey")
    q = e.select_as("o", lambda t: orders(t), "o_orderkey").left_join_lateral_one_or_throw("customer", customer, "customer.c_custkey", "o.o_custkey")
    return q.nested_df().select("o_orderkey", F.col("customer.c_custkey").alias("c_custkey"), F.col("customer.c_name").alias("c_name"), F.col("customer.nation.n_name").alias("n_name"))


@query("""with r as (select r_regionkey, r_name, n_nationkey, n_name, row_number() over (partition by r_regionkey order by n_name desc) as k from region join nation on n_regionkey = r_regionkey)
select r_regionkey, string_agg(n_nationkey || ':' || n_name, ',' order by k) as nations from r where k <= 2 group by r_regionkey""")
def cross_join_lateral_correlated(e: Engine) -> DataFrame:
    """A cross lateral relation with a condition and a limit for each parent."""
    nations = lambda qs: qs(e.tables["nation"], "n_nationkey").order_by("n_name", "desc").limit(2)
    q = e.select_as("region", "region", "r_regionkey").cross_join_lateral_many("nations", nations, lambda c: c["nations.n_regionkey"] == c["region.r_regionkey"])
    return q.nested_df().select("r_regionkey", listed("nations", "n_nationkey", "n_name").alias("nations"))


@query(f"select c_custkey, c_name, {PRICED.format('cents desc, o_orderkey')} as orders from customer left join (select * from {ORDERS} where o_orderstatus = 'F') on o_custkey = c_custkey group by all")
def key_overwrite(e: Engine) -> DataFrame:
    """A collection defined again under its name replaces the earlier one."""
    q = of_customer(e)
    final = lambda qs: qs(priced(e).where("o_orderstatus = 'F'"), "o_orderkey").order_by("cents", "desc")
    return q.left_join_many("orders", final, "orders.o_custkey", "customer.c_custkey").nested_df().select("c_custkey", "c_name", price_list().alias("orders"))


@query(f"""with o as (select * from {ORDERS} where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity >= 45))
select c_custkey, c_name, {PRICED.format('o_orderkey')} as orders, (select count(*) from events where user_id = c_custkey) as n_events
from customer left join o on o_custkey = c_custkey group by all""")
def nested_isolation(e: Engine) -> DataFrame:
    """An inner relation within a left one filters that one, neither its parents nor its siblings."""
    returned = lines(e.tables, "l_returnflag", "l_quantity").where("l_returnflag = 'R' and l_quantity >= 45")
    q = of_customer(e, lambda o: o.inner_join_many("lines", lambda qs: qs(returned, LINE_KEY), "lines.l_orderkey", "orders.o_orderkey"))
    q = q.left_join_many("events", lambda qs: qs(e.tables["events"].select("event_id", "user_id"), "event_id"), "events.user_id", "customer.c_custkey")
    return q.nested_df().select("c_custkey", "c_name", price_list().alias("orders"), n("events").alias("n_events"))


@query("select s_suppkey, n_nationkey, n_name from supplier join nation on n_nationkey = s_nationkey")
def attach_one_or_throw(e: Engine) -> DataFrame:
    """Rows from outside (Python rows), of which each parent must have one."""
    fetched = lambda _: [r.asDict() for r in e.tables["nation"].select("n_nationkey", "n_name").collect()]
    q = e.select_as("supplier", "supplier", "s_suppkey").attach_one_or_throw("nation", fetched, match_child="n_nationkey", to_parent="s_nationkey")
    return q.nested_df().select("s_suppkey", F.col("nation.n_nationkey").cast("int").alias("n_nationkey"), F.col("nation.n_name").alias("n_name"))


@query("""with s as (select n_nationkey, n_regionkey, n_name || '=' || coalesce(string_agg(s_suppkey, '+' order by s_suppkey), '') as x from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey, n_regionkey, n_name)
select r_regionkey, string_agg(x, ',' order by n_nationkey) as nations from region join s on n_regionkey = r_regionkey group by r_regionkey""")
def nested_attach(e: Engine) -> DataFrame:
    """Rows attached to nested entities; the fetch gets those entities' plain columns."""
    fetch = lambda nations: e.tables["supplier"].select("s_suppkey", "s_nationkey").join(nations.select(F.col("n_nationkey").alias("s_nationkey")).distinct(), "s_nationkey", "left_semi")
    nation = lambda qs: qs(e.tables["nation"], "n_nationkey").attach_many("suppliers", fetch, match_child="s_nationkey", to_parent="n_nationkey")
    q = e.select_as("region", "region", "r_regionkey").left_join_many("nations", nation, "nations.n_regionkey", "region.r_regionkey")
    one = lambda x: F.concat(x["n_name"], F.lit("="), F.array_join(F.sort_array(F.transform(x["suppliers"], lambda s: s["s_suppkey"])).cast("array<string>"), "+"))
    return q.nested_df().select("r_regionkey", F.array_join(F.transform("nations", one), ",").alias("nations"))


@query("""select s_suppkey, s_nationkey, coalesce(string_agg(c_custkey, ',' order by c_custkey), '') as customers from supplier
  left join (select c_custkey, c_nationkey, c_custkey % 7 as bucket from customer) on c_nationkey = s_nationkey and bucket = s_suppkey % 7 group by all""")
def composite_attach(e: Engine) -> DataFrame:
    """Matched by two columns; many suppliers share their customers, of which the text is made once."""
    suppliers = e.tables["supplier"].select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 7).alias("bucket"))
    found = e.tables["customer"].select("c_custkey", "c_nationkey", (F.col("c_custkey") % 7).alias("b"))
    text = lambda customers: F.array_join(F.sort_array(F.transform(customers, lambda c: c["c_custkey"])).cast("array<string>"), ",")
    q = e.select_as("supplier", suppliers, "s_suppkey").attach_many("customers", lambda _: found, match_child=["c_nationkey", "b"], to_parent=["s_nationkey", "bucket"], fold=text)
    return q.nested_df().select("s_suppkey", "s_nationkey", "customers")


@query("select c_custkey, coalesce(string_agg(o_orderkey, ',' order by o_orderkey), '') as orders from customer left join (select * from orders where o_totalprice > 200000) on o_custkey = c_custkey where c_acctbal < 0 group by c_custkey")
def modified_attach(e: Engine) -> DataFrame:
    """What a fetch gave, changed afterwards."""
    q = customers(e, "c_acctbal").where("c_acctbal < 0").attach_many("orders", lambda _: orders(e.tables, "o_totalprice"), match_child="o_custkey", to_parent="c_custkey")
    q = q.modify("orders", lambda fetched: fetched.where("o_totalprice > 200000"))
    return q.nested_df().select("c_custkey", F.array_join(F.sort_array(F.transform("orders", lambda o: o["o_orderkey"])).cast("array<string>"), ",").alias("orders"))


@query(f"select c_custkey, c_name, {PRICED.format('o_orderkey')} as orders from customer left join {ORDERS} on o_custkey = c_custkey group by all")
def cleared_order(e: Engine) -> DataFrame:
    """An order taken back leaves the key's."""
    return of_customer(e, lambda o: o.order_by("cents", "desc").clear_order_by()).nested_df().select("c_custkey", "c_name", price_list().alias("orders"))


@query("""select n_nationkey, coalesce(string_agg(s_suppkey || ':' || s_name, ',' order by s_acctbal desc), '') as suppliers from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey""")
def without_key_order(e: Engine) -> DataFrame:
    """Only the order asked for, not the key's after it."""
    suppliers = lambda qs: qs(e.tables["supplier"], "s_suppkey").order_by("s_acctbal", "desc").order_by_keys(False)
    q = e.select_as("nation", "nation", "n_nationkey").left_join_many("suppliers", suppliers, "suppliers.s_nationkey", "nation.n_nationkey")
    return q.nested_df().select("n_nationkey", listed("suppliers", "s_suppkey", "s_name").alias("suppliers"))


@query("select c_custkey, c_mktsegment, (select count(*) from orders where o_custkey = c_custkey) as n_orders from customer")
def cleared_page(e: Engine) -> DataFrame:
    """A limit and an offset taken back: all entities again."""
    q = customers(e, "c_mktsegment").left_join_many("orders", lambda qs: qs(orders(e.tables), "o_orderkey"), "orders.o_custkey", "customer.c_custkey")
    return q.limit(3).offset(2).clear_limit().clear_offset().nested_df().select("c_custkey", "c_mktsegment", n("orders").alias("n_orders"))


@query("""with top as (select s_suppkey, s_name, s_nationkey from supplier order by s_acctbal desc, s_suppkey limit 10)
select n_nationkey, coalesce(string_agg(s_suppkey || ':' || s_name, ',' order by t.k), '') as suppliers from nation
left join (select *, row_number() over () as k from top) t on s_nationkey = n_nationkey group by n_nationkey""")
def nested_limit(e: Engine) -> DataFrame:
    """A limit of a relation that isn't lateral counts its rows, whatever their parents."""
    suppliers = lambda qs: qs(e.tables["supplier"], "s_suppkey").order_by("s_acctbal", "desc").limit(10)
    q = e.select_as("nation", "nation", "n_nationkey").left_join_many("suppliers", suppliers, "suppliers.s_nationkey", "nation.n_nationkey")
    return q.nested_df().select("n_nationkey", listed("suppliers", "s_suppkey", "s_name").alias("suppliers"))


@query(f"""with f as (select * from customer order by c_acctbal desc, c_custkey limit 1)
select c_custkey, c_name, {PRICED.format('o_orderkey')} as orders from f left join {ORDERS} on o_custkey = c_custkey group by all""")
def take_first(e: Engine) -> DataFrame:
    """The first entity with its relations."""
    q = customers(e, "c_name", "c_acctbal").left_join_many("orders", lambda qs: qs(priced(e), "o_orderkey"), "orders.o_custkey", "customer.c_custkey").order_by("c_acctbal", "desc")
    row = q.execute_take_first_or_throw()
    text = ",".join(f"{o.o_orderkey}:{o.cents}:{o.o_orderstatus}" for o in row.orders)
    return e.spark.createDataFrame([(row.c_custkey, row.c_name, text)], "c_custkey long, c_name string, orders string")


@query(f"select c_custkey as id, c_name as label, {PRICED.format('o_orderkey')} as bought from customer left join {ORDERS} on o_custkey = c_custkey group by all")
def column_aliases(e: Engine) -> DataFrame:
    """Columns under other names, at both levels; conditions and keys use the new ones."""
    base = e.tables["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    child = priced(e).select(F.col("o_orderkey").alias("no"), F.col("o_custkey").alias("id"), F.col("cents").alias("amount"), F.col("o_orderstatus").alias("label"))
    q = e.select_as("c", base, "id").left_join_many("bought", lambda qs: qs(child, "no"), "bought.id", "c.id")
    return q.nested_df().select("id", "label", listed("bought", "no", "amount", "label").alias("bought"))


@query(f"select c_custkey, upper(c_name) as c_name, length(c_name) as letters, {PRICED.format('o_orderkey')} as orders from customer left join {ORDERS} on o_custkey = c_custkey group by all")
def merged_shapes(e: Engine) -> DataFrame:
    """Another spec's fields and extras on top of a query's own."""
    other = nest_spec("c_custkey").extras({"letters": lambda r: F.length(r["c_name"]).cast("long")}).map_fields({"c_name": F.upper})
    q = of_customer(e).map_fields({"c_name": F.lower}).merge(other)
    return q.call(lambda x: x.nested_df()).select("c_custkey", "c_name", "letters", price_list().alias("orders"))


@query("select 'A1' as s_name, n_nationkey as s_nationkey, cast(7.5 as double) as s_acctbal, n_name from nation where n_nationkey = 3 union all select 'A2', n_nationkey, 8.5, n_name from nation where n_nationkey = 4")
def write_on_a_query(e: Engine) -> DataFrame:
    """A query whose base becomes what an insert returns; its relation stays."""
    table = _supplier_table(e)
    q = e.select_as("supplier", table.current(), "s_suppkey").left_join_one("nation", lambda qs: qs(e.tables["nation"], "n_nationkey"), "nation.n_nationkey", "supplier.s_nationkey")
    q = q.where("s_acctbal > 0").insert(table.insert([{"s_name": "A1", "s_nationkey": 3, "s_acctbal": 7.5}, {"s_name": "A2", "s_nationkey": 4, "s_acctbal": 8.5}]))
    return q.spec.write.finish(q.nested_df()).select("s_name", "s_nationkey", "s_acctbal", F.col("nation.n_name").alias("n_name"))


@query("""select n_nationkey, n_name, coalesce(string_agg(s_suppkey || ':' || s_name, ',' order by s_suppkey), '') as suppliers, count(s_suppkey) as n_before, cast(0 as bigint) as n_after
from nation left join supplier on s_nationkey = n_nationkey where n_regionkey = 2 group by all""")
def writes_see_the_past(e: Engine) -> DataFrame:
    """Rows deleted from two tables: relations show the rows as they were; afterwards they are gone."""
    old = e.tables["nation"]
    nations = VersionedTable(e.spark, _scratch(e, "nation"), "n_nationkey int, n_name string, n_regionkey int", "n_nationkey")
    nations.save(old.selectExpr("cast(n_nationkey as int) n_nationkey", "n_name", "cast(n_regionkey as int) n_regionkey"))
    suppliers = _supplier_table(e)
    before = suppliers.current()
    gone = [r.n_nationkey for r in old.where("n_regionkey = 2").collect()]
    cascade = suppliers.delete(F.col("s_nationkey").isin(gone))
    q = e.delete_as("nation", nations.delete("n_regionkey = 2"), "n_nationkey").left_join_many("suppliers", lambda qs: qs(before, "s_suppkey"), "suppliers.s_nationkey", "nation.n_nationkey")
    cascade.commit()
    d = q.spec.write.finish(q.nested_df())
    after = suppliers.current().groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("m"))
    return d.join(after, d["n_nationkey"] == after["k"], "left").select(F.col("n_nationkey"), "n_name", listed("suppliers", "s_suppkey", "s_name").alias("suppliers"), n("suppliers").alias("n_before"), F.coalesce("m", F.lit(0).cast("long")).alias("n_after"))


@query("select 'a second write of one version' as what, true as refused, count(*) as n_rows from supplier where s_nationkey <> 3")
def stale_writes(e: Engine) -> DataFrame:
    """Of two writes made from one version the second is refused; none is lost."""
    table = _supplier_table(e)
    one, two = table.delete("s_nationkey = 3"), table.delete("s_nationkey = 4")
    one.commit()
    try:
        two.commit()
        refused = False
    except EngineError:
        refused = True
    return table.current().agg(F.count("*").alias("n_rows")).select(F.lit("a second write of one version").alias("what"), F.lit(refused).alias("refused"), "n_rows")


@query("select quality, count(*) as n from documents d join labels l on l.doc_id = d.doc_id where quality is not null and quality <> 0 group by quality")
def null_keys(e: Engine) -> DataFrame:
    """Rows with a null in their key are no entities, neither at the base nor within a relation."""
    marked = e.tables["documents"].select("doc_id").join(e.tables["labels"].select("doc_id", "quality"), "doc_id", "left")
    kinds = marked.select(F.nullif("quality", F.lit(0)).alias("quality")).distinct()
    rows = marked.select(F.when(F.col("quality").isNotNull(), F.col("doc_id")).alias("doc_id"), F.col("quality").alias("q"))
    q = e.select_as("kind", kinds, "quality").left_join_many("rows", lambda qs: qs(rows, "doc_id"), "rows.q", "kind.quality")
    return q.nested_df().select("quality", n("rows").alias("n"))


@query("""select 1 as id, 'ann' as name, '10:tea,11:milk' as posts, 'a' as bio union all select 2, 'bob', '', 'b' union all select 3, 'cy', '12:rye', null""")
def hydrated_python_rows(e: Engine) -> DataFrame:
    """Flat rows from Python, two relations side by side, rows without a key left out."""
    flat = [
        {"id": 1, "name": "ann", "posts$$id": 11, "posts$$title": "milk", "profile$$id": 5, "profile$$bio": "a"},
        {"id": 1, "name": "ann", "posts$$id": 10, "posts$$title": "tea", "profile$$id": 5, "profile$$bio": "a"},
        {"id": 2, "name": "bob", "posts$$id": None, "posts$$title": None, "profile$$id": 6, "profile$$bio": "b"},
        {"id": None, "name": "nobody", "posts$$id": 99, "posts$$title": "x", "profile$$id": None, "profile$$bio": None},
        {"id": 3, "name": "cy", "posts$$id": 12, "posts$$title": "rye", "profile$$id": None, "profile$$bio": None},
    ]
    spec = nest_spec("id").fields(["id", "name"]).has_many("posts", "posts$$", nest_spec("id").fields(["id", "title"]).order_by_keys()).has_one("profile", "profile$$", nest_spec("id").fields(["bio"]))
    d = hydrate(flat, spec, e.spark)
    return d.select(F.col("id").cast("int").alias("id"), "name", listed("posts", "id", "title").alias("posts"), F.col("profile.bio").alias("bio"))


@query("select 7 as id, 'Ann' as name, '70:tea' as posts union all select null, 'Nobody', '71:milk'")
def hydrated_single_row(e: Engine) -> DataFrame:
    """One row gives one object, whatever its key."""
    spec = nest_spec("id").fields({"id": True, "name": F.initcap}).has_many("posts", "posts$$", nest_spec("id").fields(["id", "title"]))
    rows = [hydrate({"id": i, "name": name, "posts$$id": post, "posts$$title": title}, spec, e.spark) for i, name, post, title in ((7, "ann", 70, "tea"), (None, "nobody", 71, "milk"))]
    return e.spark.createDataFrame([(None if r.id is None else int(r.id), r.name, ",".join(f"{p.id}:{p.title}" for p in r.posts)) for r in rows], "id int, name string, posts string")


@query("select conv_id, turn, role, cast(length(text) as bigint) as letters from conversations")
def hydrated_flat_rows(e: Engine) -> DataFrame:
    """Rows without relations are entities as they are: nothing is grouped."""
    spec = nest_spec("conv_id").fields({"conv_id": True, "turn": True, "role": True}).extras({"letters": lambda r: F.length(r["text"]).cast("long")})
    return hydrate(e.tables["conversations"], spec, sort="none")


@query("""select c_custkey, c_name, coalesce(string_agg(distinct o_orderkey, ',' order by o_orderkey), '') as orders, (select n_name from nation where n_nationkey = c_nationkey) as n_name,
  coalesce((select string_agg(event_id, ',' order by event_id) from events where user_id = c_custkey), '') as events
from customer left join orders on o_custkey = c_custkey where c_custkey in (select user_id from events) group by c_custkey, c_name, c_nationkey""")
def hydrated_siblings(e: Engine) -> DataFrame:
    """Flat rows in which two collections multiplied each other, and a one-relation that must be there."""
    q = (
        customers(e, "c_name", "c_nationkey")
        .inner_join_many("events", lambda qs: qs(e.tables["events"].select("event_id", "user_id"), "event_id"), "events.user_id", "customer.c_custkey")
        .left_join_many("orders", lambda qs: qs(orders(e.tables), "o_orderkey"), "orders.o_custkey", "customer.c_custkey")
        .left_join_one("nation", lambda qs: qs(e.tables["nation"], "n_nationkey"), "nation.n_nationkey", "customer.c_nationkey")
    )
    keyed = lambda k: nest_spec(k).fields([k]).order_by_keys()
    spec = nest_spec("c_custkey").fields(["c_custkey", "c_name"]).has_many("orders", "orders$$", keyed("o_orderkey")).has_many("events", "events$$", keyed("event_id"))
    spec = spec.has_one_or_throw("nation", "nation$$", nest_spec("n_nationkey").fields(["n_name"]))
    d = hydrate(q.joined_df(), spec, sort="nested")
    return d.select("c_custkey", "c_name", listed("orders", "o_orderkey").alias("orders"), F.col("nation.n_name").alias("n_name"), listed("events", "event_id").alias("events"))


@query("select c_custkey, c_name, (select count(*) from orders where o_custkey = c_custkey) as n_orders, (select n_name from nation where n_nationkey = c_nationkey) as n_name from customer")
def scalar_aggregate(e: Engine) -> DataFrame:
    """A correlated count among the base's columns."""
    customer, order = e.tables["customer"], e.tables["orders"]
    counted = customer.alias("c").select("c_custkey", "c_name", "c_nationkey", order.where(F.col("o_custkey") == F.col("c.c_custkey").outer()).select(F.count("*")).scalar().alias("n_orders"))
    q = e.select_as("customer", counted, "c_custkey").left_join_one("nation", lambda qs: qs(e.tables["nation"], "n_nationkey"), "nation.n_nationkey", "customer.c_nationkey")
    return q.nested_df().select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0).cast("long")).alias("n_orders"), F.col("nation.n_name").alias("n_name"))


@query("""select c_nationkey, count(*) as n, n_name, (select count(*) from supplier where s_nationkey = c_nationkey) as n_suppliers from customer join nation on n_nationkey = c_nationkey group by c_nationkey, n_name""")
def grouped_base(e: Engine) -> DataFrame:
    """A base that an aggregation makes, through ``modify``."""
    q = e.select_as("c", "customer", "c_nationkey").modify(lambda df: df.groupBy("c_nationkey").agg(F.count("*").alias("n")))
    q = q.left_join_one("nation", lambda qs: qs(e.tables["nation"], "n_nationkey"), "nation.n_nationkey", "c.c_nationkey")
    q = q.left_join_many("suppliers", lambda qs: qs(e.tables["supplier"].select("s_suppkey", "s_nationkey"), "s_suppkey"), "suppliers.s_nationkey", "c.c_nationkey")
    return q.nested_df().select("c_nationkey", "n", F.col("nation.n_name").alias("n_name"), n("suppliers").alias("n_suppliers"))


@query("select true as some, false as none, (select count(*) from customer where c_acctbal < 0) as n")
def exists_both_ways(e: Engine) -> DataFrame:
    q = customers(e, "c_acctbal").inner_join_many("orders", lambda qs: qs(orders(e.tables), "o_orderkey"), "orders.o_custkey", "customer.c_custkey")
    poor = customers(e, "c_acctbal").where("c_acctbal < 0")
    return e.spark.createDataFrame([(q.execute_exists(), q.where("c_acctbal > 1e9").execute_exists(), poor.execute_count())], "some boolean, none boolean, n long")


@query("select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and (c_name like '%1' or c_acctbal between 0 and 1000 or c_acctbal is null) and not c_mktsegment = 'FURNITURE'")
def comparisons(e: Engine) -> DataFrame:
    """Membership, patterns, ranges, nulls, alternatives and negation in one condition."""
    return customers(e, "c_name", "c_acctbal", "c_mktsegment").where(
        lambda c: c["c_mktsegment"].isin("BUILDING", "MACHINERY") & (c["c_name"].like("%1") | c["c_acctbal"].between(0, 1000) | c["c_acctbal"].isNull()) & ~(c["c_mktsegment"] == "FURNITURE")
    ).nested_df().select("c_custkey", "c_mktsegment")


@query("select o.o_orderkey, n_name, r_name from orders o join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where o_totalprice > 300000")
def prebuilt_source(e: Engine) -> DataFrame:
    """Queries built before, joined into others; each level hoists the next one's columns for order and conditions."""
    region = e.select_as("region", "region", "r_regionkey")
    nation = e.select_as("nation", "nation", "n_nationkey").left_join_one("region", region, "region.r_regionkey", "nation.n_regionkey")
    customer = customers(e, "c_nationkey").left_join_one("nation", nation, "nation.n_nationkey", "customer.c_nationkey")
    q = e.select_as("o", lambda t: orders(t, "o_totalprice").where("o_totalprice > 300000"), "o_orderkey").left_join_one("customer", customer, "customer.c_custkey", "o.o_custkey")
    q = q.assert_type("o_orderkey bigint, o_custkey bigint, o_totalprice double, customer struct<c_custkey:bigint,c_nationkey:int,nation:struct<n_nationkey:int,n_name:string,n_regionkey:int,region:struct<r_regionkey:int,r_name:string>>>")
    return q.nested_df().select("o_orderkey", F.col("customer.nation.n_name").alias("n_name"), F.col("customer.nation.region.r_name").alias("r_name"))


@query("""with page as (select s_suppkey, s_name, s_acctbal from supplier order by s_acctbal desc, s_suppkey limit 12)
select s_suppkey, s_name, (select count(*) from lineitem where l_suppkey = s_suppkey) as n_lines from page""")
def changed_page(e: Engine) -> DataFrame:
    """A hint in front of the base and a change at the end of the page, before relations meet it."""
    q = e.select_as("supplier", lambda t: t["supplier"].select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey").order_by("s_acctbal", "desc").limit(12)
    q = q.modify_front("coalesce", 1).modify_end(lambda page: page.where("s_suppkey is not null"))
    q = q.left_join_many("lines", lambda qs: qs(lines(e.tables), LINE_KEY), "lines.l_suppkey", "supplier.s_suppkey")
    return q.nested_df().select("s_suppkey", "s_name", n("lines").alias("n_lines"))


@query("select n_nationkey, n_name, r_name, row_number() over (order by r_name desc, n_nationkey) as place from nation join region on r_regionkey = n_regionkey")
def objects_sink(e: Engine) -> DataFrame:
    """Entities as Python objects, in their order."""
    q = e.select_as("nation", "nation", "n_nationkey").left_join_one("region", lambda qs: qs(e.tables["region"], "r_regionkey"), "region.r_regionkey", "nation.n_regionkey")
    rows = q.order_by("region$$r_name", "desc").execute()
    return e.spark.createDataFrame([(r.n_nationkey, r.n_name, r.region.r_name, k) for k, r in enumerate(rows, 1)], "n_nationkey int, n_name string, r_name string, place long")
