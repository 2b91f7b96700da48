import random

import pytest

from tests.llm.brute import Union
from thicket.llm.components import components, join_back


@pytest.mark.parametrize("at_once", [0, 10_000])
def test_components(spark, at_once):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 230)] + [(300, k) for k in range(301, 340)] + [(7, 7)]
    groups = Union({x for e in edges for x in e})
    for u, v in edges:
        groups.tie(u, v)
    df = spark.createDataFrame(edges, "u long, v long")
    linked = {x for u, v in edges if u != v for x in (u, v)}
    want = sorted((x, groups.find(x)) for x in linked)
    assert sorted(map(tuple, components(df, at_once).collect())) == want
    named = df.selectExpr("encode(lpad(u, 5, '0'), 'UTF-8') as u", "encode(lpad(v, 5, '0'), 'UTF-8') as v")
    assert sorted((int(bytes(a)), int(bytes(b))) for a, b in components(named, at_once).collect()) == want
    assert components(df.limit(0), at_once).count() == 0


def test_hot_keys_are_joined_too(spark):
    rows = spark.createDataFrame([(1, k) for k in range(500)] + [(k, 0) for k in range(2, 1500)], "key long, x long")
    groups = rows.groupBy("key").count().withColumnRenamed("count", "n")
    out = join_back(rows, groups, "key")
    assert out.count() == rows.count() and out.where("key = 1 and n = 500").count() == 500


def test_nodes_with_one_edge_are_set_aside(spark, monkeypatch):
    """Of pairs and stars nothing is left for rounds of stars, however many there are."""
    monkeypatch.setattr("thicket.llm.components._stars", None)
    edges = [(10_000 + k, k) for k in range(400)] + [(500, 20_000 + k) for k in range(300)]
    got = sorted(map(tuple, components(spark.createDataFrame(edges, "u long, v long"), 0).collect()))
    assert got == sorted([(x, k) for k in range(400) for x in (k, 10_000 + k)] + [(500, 500)] + [(20_000 + k, 500) for k in range(300)])


def test_more_links_join_groups(spark):
    from thicket.llm.linked import _joined

    labels = spark.createDataFrame([(1, 1), (5, 1), (2, 2), (6, 2), (3, 3), (7, 3)], "node long, label long")
    found = spark.createDataFrame([(6, 5), (9, 7), (11, 10), (5, 1)], "u long, v long")
    assert sorted(map(tuple, _joined(labels, found).collect())) == [(1, 1), (2, 1), (3, 3), (5, 1), (6, 1), (7, 3), (9, 3), (10, 10), (11, 10)]
