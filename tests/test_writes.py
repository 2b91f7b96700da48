import pytest
from pyspark.sql import functions as F

from tests.fixtures import child, engine, frames, ids, posts_of  # noqa: F401
from thicket import errors
from thicket.sources.versioned import VersionedTable, Writes


@pytest.fixture
def users(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "users"), "id int, username string, email string")
    table.save(frames(spark)["users"])
    return table


def test_insert_returns_rows_with_ids(engine, users):  # noqa: F811
    q = engine.insert_as("user", users.insert([{"username": f"user{k}"} for k in range(3)]))
    rows = q.execute()
    assert [(r.id, r.username, r.email) for r in rows] == [(11, "user0", None), (12, "user1", None), (13, "user2", None)]
    assert users.current().count() == 13 and users.at(1).count() == 10


def test_update_and_relations(engine, users):  # noqa: F811
    write = users.update({"email": F.upper("email"), "username": lambda df: F.concat(df["username"], F.lit("!"))}, "id <= 2")
    rows = engine.update_as("user", write).left_join_many(*posts_of(engine)).execute()
    assert [(r.username, r.email, len(r.posts)) for r in rows] == [("alice!", "ALICE@EXAMPLE.COM", 0), ("bob!", "BOB@EXAMPLE.COM", 4)]
    assert {r.username for r in users.current().where("id < 4").collect()} == {"alice!", "bob!", "carol"}
    assert engine.update_as("user", users.update({"email": "x"}, "id > 99")).execute() == []


def test_delete_sees_the_state_before(engine, users):  # noqa: F811
    rows = engine.delete_as("user", users.delete(lambda df: df["id"] == 2)).left_join_many(*posts_of(engine)).left_join_one("same", lambda qs: qs(users.current()), "same.id", "user.id").execute()
    assert rows[0].username == "bob" and ids(rows[0].posts) == [1, 2, 5, 12] and rows[0].same.id == 2
    assert users.current().where("id = 2").count() == 0


def test_several_writes(engine, users, spark, tmp_path):  # noqa: F811
    posts = VersionedTable(spark, str(tmp_path / "posts"), "id int, user_id int, title string")
    posts.save(engine.tables["posts"])
    writes = Writes(user=users.update({"email": "new"}, "id = 1"), audit=posts.insert([{"user_id": 1, "title": "Audit post"}]))
    q = engine.write_as("user", writes, lambda w: w["user"]).left_join_many("posts", lambda qs: qs(writes.returned["audit"]), "posts.user_id", "user.id")
    row = q.limit(1).execute()[0]
    assert row.email == "new" and [(p.id, p.title) for p in row.posts] == [(16, "Audit post")]
    assert posts.current().count() == 16 and users.current().where("email = 'new'").count() == 1


def test_writes_on_a_query(engine, users):  # noqa: F811
    q = engine.select_as("user", "users").left_join_many(*posts_of(engine)).omit(["email"])
    row = q.where("id > 100").update(users.update({"username": "X"}, "id = 3")).execute()[0]
    assert row.asDict().keys() == {"id", "username", "posts"} and row.username == "X" and len(row.posts) == 2
    with pytest.raises(errors.NestedWriteError):
        q.left_join_many("x", engine.delete_as("x", users.delete("id = 1")), "x.id", "user.id")


def test_stale_writes_are_refused(users):
    one, two = users.delete("id = 1"), users.delete("id = 2")
    one.commit()
    with pytest.raises(errors.EngineError):
        two.commit()
    with pytest.raises(errors.EngineError):
        VersionedTable(users.spark, users.path + "-none")
