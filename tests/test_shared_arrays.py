"""Arrays that many parents share."""

import pytest
from pyspark.sql import functions as F

from thicket.sources.engine import Engine


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame([(i, None if i % 50 == 0 else i % 3, i % 2) for i in range(1000)], "id int, team int, side int")


ROWS = [(k, k % 2, k % 5 % 2) for k in range(40)] + [(99, None, 1)]


@pytest.mark.parametrize("fold", [None, lambda a: F.array_join(F.sort_array(F.transform(a, lambda x: x["no"])).cast("array<string>"), "+"), lambda a: F.when(F.size(a) == 0, -1)])
def test_attached_by_two_columns(spark, parents, fold):
    found = spark.createDataFrame(ROWS, "no int, team int, side int")
    q = Engine(spark, {}).select_as("p", parents, "id").attach_many("rows", lambda _: found, ["team", "side"], ["team", "side"], fold=fold)
    rows = q.execute()
    assert [r.id for r in rows] == list(range(1000))
    for r in rows:
        want = [no for no, team, side in ROWS if team is not None and (team, side) == (r.team, r.side)]
        if fold is None:
            assert sorted(x.no for x in r.rows) == want
        else:
            assert r.rows == "+".join(map(str, want)) or r.rows == (None if want else -1)


@pytest.mark.parametrize("method", ["left_join_many", "inner_join_many"])
def test_joined_by_a_column_that_is_no_key(spark, parents, method):
    kids = spark.createDataFrame([(no, team) for no, team, _ in ROWS], "no int, team int")
    q = getattr(Engine(spark, {}).select_as("p", parents, "id"), method)("rows", lambda qs: qs(kids, "no"), "rows.team", "p.team")
    want = {t: [no for no, team, _ in ROWS if team is not None and team == t] for t in (None, 0, 1, 2)}
    rows = q.execute()
    assert [(r.id, [x.no for x in r.rows]) for r in rows] == [(p.id, want[p.team]) for p in parents.collect() if method[0] == "l" or want[p.team]]


def test_a_shared_array_goes_to_several_places(spark, parents):
    """About 330 parents share each array: it has several copies, and no task must make all of its results."""
    found = spark.createDataFrame(ROWS, "no int, team int, side int")
    q = Engine(spark, {}).select_as("p", parents, "id").attach_many("rows", lambda _: found, "team", "team")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        places = q.nested_df().where("size(rows) > 0").groupBy("team", F.spark_partition_id().alias("at")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(places) >= 8 and sum(r["count"] for r in places) == sum(i % 50 > 0 and i % 3 < 2 for i in range(1000))
