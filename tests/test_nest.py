import pytest
from pyspark.sql import functions as F

from tests.fixtures import child, engine, ids, posts_of  # noqa: F401
from thicket import errors
from thicket.operators.nest import hydrate, nest_spec

FLAT = [(1, "Ann", 10, "p10", 100, "c100"), (1, "Ann", 10, "p10", 101, "c101"), (1, "Ann", 11, "p11", None, None), (2, "Bo", None, None, None, None), (None, "x", 5, "y", 6, "z")]
SCHEMA = "id int, name string, `posts$$id` int, `posts$$title` string, `posts$$comments$$id` int, `posts$$comments$$content` string"


def spec():
    comments = nest_spec().fields(["id", "content"]).order_by_keys()
    posts = nest_spec().fields({"id": True, "title": F.upper}).order_by_keys().has_many("comments", "comments$$", comments)
    return nest_spec().fields(["id", "name"]).order_by_keys().has_many("posts", "posts$$", posts)


def test_three_levels(spark):
    rows = hydrate(spark.createDataFrame(FLAT, SCHEMA), spec()).collect()
    assert ids(rows) == [1, 2] and rows[1].posts == []
    assert [(p.id, p.title, ids(p.comments)) for p in rows[0].posts] == [(10, "P10", [100, 101]), (11, "P11", [])]


def test_siblings_multiplied_by_the_join(spark):
    rows = [(1, c, t) for c in (3, 1, 2) for t in (8, 7)]
    df = spark.createDataFrame(rows, "id int, `c$$id` int, `t$$id` int")
    s = nest_spec().fields(["id"]).has_many("c", "c$$", nest_spec().fields(["id"]).order_by_keys()).has_many("t", "t$$", nest_spec().fields(["id"]).order_by("id", "desc"))
    r = hydrate(df, s).collect()[0]
    assert ids(r.c) == [1, 2, 3] and ids(r.t) == [8, 7]


def test_modes_and_keys(spark):
    df = spark.createDataFrame([(1, "a", "x", 3), (2, "b", None, None)], "id int, name string, `profile$$name` string, `profile$$age` int")
    one = lambda mode: nest_spec().fields(["id"]).has(mode, "profile", "profile$$", nest_spec("name").fields(["name", "age"]))
    rows = hydrate(df, one("one").order_by_keys()).collect()
    assert rows[0].profile.age == 3 and rows[1].profile is None
    with pytest.raises(errors.MissingEntityError), errors.translated():
        hydrate(df, one("one_or_throw")).collect()
    twice = df.limit(1).union(spark.createDataFrame([(1, "a", "y", 4)], df.schema))
    with pytest.raises(errors.CardinalityError), errors.translated():
        hydrate(twice, one("one")).collect()


def test_composite_keys_with_nulls(spark):
    df = spark.createDataFrame([("a", 1, "v"), ("a", 1, "w"), ("a", None, "x"), (None, 1, "y"), ("b", 2, "z")], "k1 string, k2 int, value string")
    rows = hydrate(df, nest_spec(["k1", "k2"]).fields(["k1", "k2", "value"]).order_by_keys()).collect()
    assert [(r.k1, r.k2, r.value) for r in rows] == [("a", 1, "v"), ("a", 1, "w"), ("b", 2, "z")]  # without relations rows are entities


def test_shapes_sorting_and_sources(spark):
    rows = [{"id": 2, "n": 5}, {"id": 1, "n": 7}]
    s = nest_spec().fields(["id"]).extras({"twice": lambda r: r["n"] * 2}).extend(lambda r: {"more": r["n"] + 1}).order_by("n", "desc")
    assert [(r.id, r.twice, r.more) for r in hydrate(rows, s, spark).collect()] == [(1, 14, 8), (2, 10, 6)]
    assert sorted(r.id for r in hydrate(rows, s, spark, sort="none").collect()) == [1, 2]
    attached = s.attach("many", "tags", lambda parents: [{"of": 1, "t": "x"}], "of")
    assert [len(r.tags) for r in hydrate(rows, attached, spark).collect()] == [1, 0]
    mapped = s.map(lambda r: {"v": r["id"] + r["twice"]})
    assert [r.v for r in hydrate(rows, mapped, spark).collect()] == [15, 12]
    with pytest.raises(errors.MappedSpecError):
        mapped.fields(["n"])
    merged = nest_spec().fields(["id"]).merge(nest_spec().fields({"n": lambda c: c + 1}))
    assert sorted(tuple(r) for r in hydrate(rows, merged, spark).collect()) == [(1, 8), (2, 6)]
    with pytest.raises(errors.KeyMismatchError):
        s.merge(nest_spec("n"))
    assert hydrate(rows, s.fields({"id": False}), spark).columns == ["twice", "more"]
    with pytest.raises(ValueError):
        hydrate(rows, s, spark, sort="some")


def test_a_query_nests_its_own_flat_rows(engine):  # noqa: F811
    comments = child(engine, "comments")
    q = engine.select_as("user", "users").left_join_many(*posts_of(engine, lambda p: p.left_join_many("comments", comments, "comments.post_id", "posts.id"))).left_join_one("profile", child(engine, "profiles"), "profile.user_id", "user.id")
    assert sorted(map(repr, q.hydrate(q.joined_df()).collect())) == sorted(map(repr, q.nested_df().collect()))
