import pytest
from pyspark.sql import functions as F

from tests.fixtures import child, engine, ids, posts_of  # noqa: F401
from thicket import errors


def users(engine):  # noqa: F811
    return engine.select_as("user", "users")


def test_left_join_many_keeps_childless(engine):  # noqa: F811
    rows = users(engine).left_join_many(*posts_of(engine)).execute()
    assert ids(rows) == list(range(1, 11))
    assert rows[0].posts == [] and ids(rows[1].posts) == [1, 2, 5, 12]
    assert rows[1].posts[0].asDict() == {"id": 1, "user_id": 2, "title": "Post 1"}


def test_inner_join_many_filters_and_counts_entities(engine):  # noqa: F811
    q = users(engine).inner_join_many(*posts_of(engine))
    assert ids(q.execute()) == list(range(2, 11)) and q.execute_count() == 9 and q.limit(2).execute_count() == 9


def test_sides_may_be_swapped_and_plain(engine):  # noqa: F811
    for on in (("user.id", "posts.user_id"), ("user_id", "id"), ("posts.user_id", "id")):
        rows = users(engine).left_join_many("posts", child(engine, "posts"), *on).execute()
        assert ids(rows[1].posts) == [1, 2, 5, 12]
    rows = users(engine).left_join_many("posts", child(engine, "posts"), lambda s: s["posts.user_id"] == s["user.id"]).execute()
    assert rows[0].posts == [] and ids(rows[1].posts) == [1, 2, 5, 12]


def test_one_relations(engine):  # noqa: F811
    rows = users(engine).inner_join_one("profile", child(engine, "profiles"), "profile.user_id", "user.id").execute()
    assert rows[3].profile.bio == "Bio for user 4"
    some = lambda q: q.where("user_id < 3")
    q = users(engine).left_join_one("profile", child(engine, "profiles", some), "profile.user_id", "user.id")
    assert [r.profile is None for r in q.execute()] == [False] * 2 + [True] * 8 and q.execute_count() == 10
    assert ids(users(engine).inner_join_one("profile", child(engine, "profiles", some), "profile.user_id", "user.id").execute()) == [1, 2]


def test_cardinality_is_enforced(engine):  # noqa: F811
    for method in ("inner_join_one", "left_join_one", "left_join_one_or_throw"):
        with pytest.raises(errors.CardinalityError):
            getattr(users(engine).where("id > 1"), method)("post", child(engine, "posts"), "post.user_id", "user.id").execute()
    with pytest.raises(errors.MissingEntityError):
        users(engine).left_join_one_or_throw("post", child(engine, "posts", lambda q: q.where("id = 1")), "post.user_id", "user.id").execute()
    fine = users(engine).where("id = 6").left_join_one_or_throw("post", child(engine, "posts"), "post.user_id", "user.id").execute()
    assert fine[0].post.id == 7


def test_cross_join_many(engine):  # noqa: F811
    two = lambda q: q.where("id <= 2")
    assert [ids(r.posts) for r in users(engine).limit(3).cross_join_many("posts", child(engine, "posts", two)).execute()] == [[1, 2]] * 3
    none = users(engine).cross_join_many("posts", child(engine, "posts", lambda q: q.where("id < 0")))
    assert none.execute() == [] and none.execute_count() == 0 and not none.execute_exists()


def test_four_levels(engine):  # noqa: F811
    replies = child(engine, "replies")
    comments = child(engine, "comments", lambda q: q.left_join_many("replies", replies, "replies.comment_id", "comments.id"))
    posts = child(engine, "posts", lambda q: q.left_join_many("comments", comments, "comments.post_id", "posts.id"))
    for limit in (None, 4):
        rows = users(engine).left_join_many("posts", posts, "posts.user_id", "user.id").limit(limit).execute()
        bob = rows[1].posts
        assert [ids(p.comments) for p in bob] == [[1, 2], [3], [5], []]
        assert ids(bob[0].comments[0].replies) == [2, 4] and ids(bob[1].comments[0].replies) == [1, 5]


def test_siblings_do_not_multiply(engine):  # noqa: F811
    q = users(engine).left_join_many(*posts_of(engine)).left_join_many("comments", child(engine, "comments"), "comments.user_id", "user.id").left_join_one("profile", child(engine, "profiles"), "profile.user_id", "user.id")
    bob = q.execute()[1]
    assert ids(bob.posts) == [1, 2, 5, 12] and ids(bob.comments) == [1, 11] and bob.profile.id == 2
    assert len(q.joined_df().where("id = 2").collect()) == 8  # the flat rows do


@pytest.mark.parametrize("equal", [True, False])
def test_laterals(engine, equal):  # noqa: F811
    on = ("posts.user_id", "user.id") if equal else (lambda s: s["posts.user_id"] == s["user.id"],)
    top = lambda n, skip=0: child(engine, "posts", lambda q: q.order_by("id", "desc").limit(n).offset(skip))
    rows = users(engine).left_join_lateral_many("posts", top(2), *on).execute()
    assert rows[0].posts == [] and ids(rows[1].posts) == [12, 5] and ids(rows[2].posts) == [15, 3]
    rows = users(engine).inner_join_lateral_many("posts", top(2, 1), *on).limit(2).execute()
    assert ids(rows) == [2, 3] or ids(rows) == [2, 3, 4]
    assert ids(rows[0].posts) == [5, 2]
    rows = users(engine).left_join_lateral_one("posts", top(1), *on).execute()
    assert rows[0].posts is None and rows[1].posts.id == 12
    with pytest.raises(errors.MissingEntityError):
        users(engine).left_join_lateral_one_or_throw("posts", top(1), *on).execute()
    with pytest.raises(errors.CardinalityError):
        users(engine).inner_join_lateral_one("posts", top(2), *on).execute()


def test_paging_counts_entities(engine):  # noqa: F811
    q = users(engine).left_join_many(*posts_of(engine))
    assert ids(q.limit(2).offset(1).execute()) == [2, 3] and q.limit(0).execute() == []
    assert ids(q.limit(2).clear_limit().offset(8).execute()) == [9, 10] and ids(q.offset(3).clear_offset().limit(1).execute()) == [1]
    assert q.limit(2).query_df().select("id").distinct().count() == 2


def test_ordering(engine):  # noqa: F811
    q = users(engine)
    assert [r.username for r in q.order_by("username", "desc").limit(3).execute()] == ["judy", "ivan", "heidi"]
    one = q.left_join_one("profile", child(engine, "profiles", lambda p: p.where("id > 7")), "profile.user_id", "user.id")
    assert ids(one.order_by("profile$$bio").limit(4).execute()) == [10, 8, 9, 1]
    assert ids(one.order_by("profile$$bio", "desc").limit(8).execute()) == [1, 2, 3, 4, 5, 6, 7, 9]
    assert ids(one.order_by("profile$$bio", "desc", "last").limit(3).execute()) == [9, 8, 10]
    assert ids(one.order_by(lambda s: s["id"] % 3).order_by("id", "desc").limit(4).execute()) == [9, 6, 3, 10]
    assert ids(q.order_by("username", "desc").clear_order_by().limit(2).execute()) == [1, 2]
    nested = lambda o: q.left_join_many(*posts_of(engine, o)).execute()[1].posts
    assert ids(nested(lambda p: p.order_by("id", "desc"))) == [12, 5, 2, 1]
    assert ids(nested(lambda p: p.order_by("title", "desc"))) == [5, 2, 12, 1]
    assert ids(nested(lambda p: p.order_by(lambda s: s["id"] % 2).order_by("title"))) == [12, 2, 1, 5]
    assert sorted(ids(nested(lambda p: p.order_by_keys(False)))) == [1, 2, 5, 12]
    with pytest.raises(ValueError):
        q.order_by("id", "up")


def test_shapes(engine):  # noqa: F811
    q = users(engine).where("id = 2").map_fields({"username": F.upper}).extras({"n": lambda s: F.length(s.username), "both": lambda s: F.concat(s["username"], s["email"])})
    r = q.extend(lambda s: {"tag": F.concat(F.lit("#"), s["username"])}).omit(["email"]).execute()[0]
    assert r.asDict() == {"id": 2, "username": "BOB", "n": 3, "both": "bobbob@example.com", "tag": "#bob"}
    r = q.omit(["username"]).map_fields({"username": F.length}).execute()[0]
    assert r.username == 3
    q = users(engine).left_join_many(*posts_of(engine, lambda p: p.map(lambda o: {"t": o["title"]}))).map(lambda u: {"id": u["id"], "titles": u["posts"]["t"]}).map(lambda u: {"id": u["id"], "n": F.size(u["titles"])})
    assert [r.n for r in q.execute()][:3] == [0, 4, 2]
    assert users(engine).limit(1).map(lambda u: F.upper(u["username"])).execute()[0].value == "ALICE"
    assert users(engine).limit(1).merge(users(engine).extras({"x": lambda s: F.lit(1)})).execute()[0].x == 1
    with pytest.raises(errors.KeyMismatchError):
        users(engine).merge(engine.select_as("user", "users", "username"))


def test_modify(engine):  # noqa: F811
    q = users(engine).left_join_many(*posts_of(engine)).attach_many("tags", lambda _: [{"post": 1, "user": 2}], "user")
    q = q.modify("posts", lambda p: p.where("id > 2").extras({"x": lambda s: s["id"] + 1})).modify("tags", lambda df: df.withColumn("post", F.col("post") * 10)).where(lambda s: s["id"] <= 2)
    rows = q.execute()
    assert ids(rows) == [1, 2] and [(p.id, p.x) for p in rows[1].posts] == [(5, 6), (12, 13)] and rows[1].tags[0].post == 10
    with pytest.raises(errors.UnknownCollectionError):
        q.modify("nothing", lambda x: x)
    with pytest.raises(TypeError):
        q.modify("posts")
    again = q.left_join_one("posts", child(engine, "profiles"), "posts.user_id", "user.id").execute()
    assert again[1].posts.bio == "Bio for user 2"


def test_attach(engine):  # noqa: F811
    calls = []

    def fetch(parents):
        calls.append(sorted(r.id for r in parents.collect()))
        return engine.tables["posts"].orderBy("id")

    rows = users(engine).limit(3).attach_many("posts", fetch, match_child="user_id").execute()
    assert calls == [[1, 2, 3]] and rows[0].posts == [] and sorted(ids(rows[1].posts)) == [1, 2, 5, 12]
    one = users(engine).attach_one("profile", lambda _: engine.select_as("profile", "profiles").where("id > 5"), "user_id", "id").execute()
    assert one[0].profile is None and one[9].profile.bio == "Bio for user 10"
    with pytest.raises(errors.CardinalityError):
        users(engine).attach_one("post", lambda _: engine.tables["posts"], "user_id").execute()
    with pytest.raises(errors.MissingEntityError):
        users(engine).attach_one_or_throw("post", lambda _: engine.tables["posts"].where("id = 1"), "user_id").execute()
    pairs = [{"a": 2, "b": "bob", "v": 1}, {"a": 2, "b": "eve", "v": 2}, {"a": None, "b": "bob", "v": 3}]
    both = users(engine).limit(2).attach_many("x", lambda _: pairs, ["a", "b"], ["id", "username"]).execute()
    assert [[x.v for x in r.x] for r in both] == [[], [1]]
    inner = child(engine, "posts", lambda q: q.attach_many("comments", lambda p: engine.tables["comments"], "post_id"))
    rows = users(engine).left_join_many("posts", inner, "posts.user_id", "user.id").execute()
    assert [sorted(ids(p.comments)) for p in rows[1].posts] == [[1, 2], [3], [5], []]


def test_first_rows(engine):  # noqa: F811
    assert users(engine).execute_take_first().id == 1 and users(engine).where("id < 0").execute_take_first() is None
    with pytest.raises(errors.NoResultError):
        users(engine).where("id < 0").execute_take_first_or_throw()
    with pytest.raises(LookupError):
        users(engine).where("id < 0").execute_take_first_or_throw(LookupError)
    assert users(engine).call(lambda q: q.limit(1).execute_count(str)) == "10"


def test_null_keys_are_no_entities(spark, engine):  # noqa: F811
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id int, name string")
    q = engine.select_as("thing", df)
    assert ids(q.execute()) == [1] and q.execute_count() == 1
    inside = users(engine).limit(1).left_join_many("things", lambda qs: qs(df), lambda s: F.lit(True)).execute()
    assert ids(inside[0].things) == [1]


def test_a_page_prunes_and_pushes_down(engine, spark, tmp_path):  # noqa: F811
    engine.tables["posts"].write.parquet(str(tmp_path / "posts.parquet"))
    posts = spark.read.parquet(str(tmp_path / "posts.parquet")).select("id", "user_id", "title")
    q = users(engine).left_join_many("posts", lambda qs: qs(posts.where("id > 3")).omit(["title"]), "posts.user_id", "user.id")
    plan = q.nested_df()._jdf.queryExecution().toString()
    scan = plan[plan.rindex("FileScan") :]
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)" in scan and "title" not in scan[scan.index("ReadSchema") : scan.index("ReadSchema") + 80]
