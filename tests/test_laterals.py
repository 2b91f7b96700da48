"""Lateral relations whose matches aren't all made before they are cut."""

import math
import random

import pytest

from thicket.sources.engine import Engine

OPS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


def key_of(x):
    return (math.isnan(x), 0.0 if math.isnan(x) else x)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    value = lambda: r.choice([None, float("nan"), -0.0, 0.0, *map(float, range(1, 9))])
    return [(i, r.choice([None, 1, 2, 3]), value()) for i in range(120)]


def related(spark, rows, on, direction, limit, skip):
    t = spark.createDataFrame(rows, "id int, team int, score double")
    q = Engine(spark, {}).select_as("own", t, "id")
    child = lambda qs: (lambda x: x.limit(limit) if limit is not None else x)(qs(t, "id").order_by("score", direction).offset(skip))
    return q.left_join_lateral_many("near", child, on)


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("limit, skip, teams", [(2, 0, True), (3, 1, True), (None, 5, True), (2, 1, False)])
def test_nearest_by_inequality(spark, rows, op, limit, skip, teams):
    down = op[0] == "<"
    compared = lambda c: {">": c["near.score"] > c["own.score"], ">=": c["own.score"] <= c["near.score"], "<": c["own.score"] > c["near.score"], "<=": c["near.score"] <= c["own.score"]}[op]
    q = related(spark, rows, lambda c: [c["near.team"] == c["own.team"], compared(c)] if teams else compared(c), "desc" if down else "asc", limit, skip)
    for own in q.execute():
        near = [x for x in rows if own.score is not None and x[2] is not None and OPS[op](key_of(x[2]), key_of(own.score)) and (not teams or x[1] is not None and x[1] == own.team)]
        near.sort(key=lambda x: x[0])
        near.sort(key=lambda x: key_of(x[2]), reverse=down)
        # Descending, NaN comes first where matches are cut but last in the array.
        placed = sorted if down else list
        assert placed(n.id for n in own.near) == placed(x[0] for x in near[skip:][:limit]), own


def test_nearest_by_equality(spark, rows):
    q = related(spark, rows, lambda c: c["own.team"] == c["near.team"], "desc", 2, 1)
    for own in q.execute():
        near = sorted((x for x in rows if x[1] is not None and x[1] == own.team), key=lambda x: (x[2] is not None, tuple(-float(k) for k in key_of(x[2] or 0.0)), x[0]))
        assert sorted(n.id for n in own.near) == sorted(x[0] for x in near[1:3]), own


def test_not_all_matches_are_made(spark):
    """600 rows of one group have 180,000 matches by inequality, of which 2 for each are wanted."""
    q = related(spark, [(i, 1, float(i)) for i in range(600)], lambda c: [c["near.team"] == c["own.team"], c["near.score"] > c["own.score"]], "asc", 2, 0)
    d = q.nested_df()
    assert sum(len(r.near) for r in d.collect()) == 2 * 600 - 3
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join" in x and ">" in x.split("Join", 1)[1]]


def test_other_conditions_meet_all(spark, rows):
    q = related(spark, rows, lambda c: [c["near.team"] == c["own.team"], c["near.score"] + 1 > c["own.score"]], "asc", 2, 0)
    for own in q.execute():
        near = sorted((x for x in rows if None not in (x[1], x[2], own.score, own.team) and x[1] == own.team and key_of(x[2] + 1) > key_of(own.score)), key=lambda x: (key_of(x[2]), x[0]))
        assert [n.id for n in own.near] == [x[0] for x in near][:2]
