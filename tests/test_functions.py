import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from tests.fixtures import engine  # noqa: F401
from thicket import errors
from thicket.functions import types as t
from thicket.functions.lineage import DERIVED, UNRESOLVED, Decoder, Provenance, mapped, trace


def decode(spark, kind, value, schema, json=False):
    c = F.col("v")
    out = kind.from_json(c) if json else kind.from_driver(c)
    df = spark.createDataFrame([(value,)], f"v {schema}").select(out.alias("v"))
    if kind.spark_type == "variant":
        df = df.select(F.to_json("v").alias("v"))
    return df.first().v


UTC = datetime.timezone.utc


@pytest.mark.parametrize(
    "kind, value, schema, want",
    [
        (t.bigint(), "9007199254740993", "string", 9007199254740993),
        (t.integer(), "7", "string", 7),
        (t.smallint(), 7, "int", 7),
        (t.double_precision(), "1.5", "string", 1.5),
        (t.numeric(10, 2), "12.30", "string", decimal.Decimal("12.30")),
        (t.boolean(), True, "boolean", True),
        (t.date(), "2024-02-03", "string", datetime.date(2024, 2, 3)),
        (t.timestamp(), "2024-02-03 04:05:06", "string", datetime.datetime(2024, 2, 3, 4, 5, 6)),
        (t.char(4), "ab", "string", "ab  "),
        (t.json(), '{"a": [1]}', "string", '{"a":[1]}'),
        (t.json(), 'not "json" \\', "string", '"not \\"json\\" \\\\"'),
        (t.enum("a", "b"), "b", "string", "b"),
        (t.enum("a", "b"), "c", "string", None),
        (t.array(t.integer()), ["1", "2"], "array<string>", [1, 2]),
        (t.embedded_timestamp(), 1734998400000, "long", datetime.datetime(2024, 12, 24)),
        (t.embedded_timestamp("timestamp"), 1734998400, "long", datetime.datetime(2024, 12, 24)),
        (t.embedded_boolean(), 1, "int", True),
        (t.embedded_boolean(), "0", "string", False),
        (t.blob_json(), b'{"a":1}', "binary", '{"a":1}'),
        (t.text_json(), "[1,2]", "string", "[1,2]"),
        (t.blob_bigint(), b"123456789012345", "binary", 123456789012345),
        (t.embedded_numeric("bigint"), "5", "string", 5),
        (t.uuid(), "u", "string", "u"),
        (t.bigint().as_nullable(), None, "string", None),
        (t.custom("up", "string", F.upper), "x", "string", "X"),
    ],
)
def test_decoding(spark, kind, value, schema, want):
    assert decode(spark, kind, value, schema) == want


def test_decoding_from_json(spark):
    assert decode(spark, t.array(t.integer()), "{1,NULL,3}", "string", True) == [1, None, 3]
    assert decode(spark, t.array(t.text()), '{a,"b, c","d\\"e"}', "string", True) == ["a", "b, c", 'd"e']
    assert decode(spark, t.blob(), "aGk=", "string", True) == b"hi"
    assert t.serial().as_generated(True).generated == "always"
    assert t.decoded(spark.createDataFrame([("1", "x")], "a string, b string"), {"a": t.bigint()}).first() == (1, "x")


def test_lineage(spark, engine):  # noqa: F811
    users, posts = engine.tables["users"], engine.tables["posts"]
    tables = {"users": users, "posts": posts}
    col = lambda table, c: Provenance("column", table, c)
    assert trace(users.select("id", F.col("username").alias("u"), F.upper("email").alias("e"), F.lit(1).alias("one")), tables) == {"id": col("users", "id"), "u": col("users", "username"), "e": DERIVED, "one": DERIVED}
    joined = users.alias("u").join(posts.alias("p"), F.col("u.id") == F.col("p.user_id"), "left").select("u.username", F.col("p.id").alias("post"))
    assert trace(joined, tables) == {"username": col("users", "username"), "post": col("posts", "id")}
    assert trace(posts.groupBy("user_id").agg(F.count("*").alias("n")), tables) == {"user_id": col("posts", "user_id"), "n": DERIVED}
    assert trace(users.select("id").union(users.select("id")), tables)["id"] == col("users", "id")
    assert trace(users.select("id").union(posts.select("id")), tables)["id"] == DERIVED
    assert trace(users.select("id"))["id"] == UNRESOLVED
    users.createOrReplaceTempView("people")
    found = trace(spark.sql("with x as (select id, username as n from people) select *, row_number() over (order by id) as k, coalesce(n, '') as c from x"))
    assert found == {"id": col("people", "id"), "n": col("people", "username"), "k": DERIVED, "c": DERIVED}
    with pytest.raises(errors.AmbiguousColumnError):
        trace(users.select("id", "id"), tables)


def test_decoding_by_lineage(spark):
    events = spark.createDataFrame([(1734998400000, 1735084800000)], "id long, name long")
    d = Decoder({"events": {"id": t.embedded_timestamp(), "name": t.embedded_timestamp()}}, {"events": events})
    year = mapped(mapped(F.col("id"), F.year), lambda c: c + 1)
    r = d.select(events, {"id": "id", "renamed": F.col("name"), "plus": F.col("id") + 1, "next_year": year}).first()
    assert r.id == datetime.datetime(2024, 12, 24) and r.renamed == datetime.datetime(2024, 12, 25) and r.plus == 1734998400001 and r.next_year == 2025
    assert d.apply(events.agg(F.sum("id").alias("s"))).first().s == 1734998400000
