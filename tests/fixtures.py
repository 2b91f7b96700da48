"""A small social network: users, posts, comments, profiles, replies."""

import pytest

from thicket.sources.engine import Engine

NAMES = "alice bob carol dave eve frank grace heidi ivan judy".split()
POSTS = [2, 2, 3, 4, 2, 5, 6, 7, 8, 9, 10, 2, 4, 5, 3]
COMMENTS = [(1, 2), (1, 3), (2, 1), (4, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10), (10, 1), (11, 2), (14, 6), (15, 7)]
REPLIES = [(3, 6), (1, 9), (5, 4), (1, 4), (3, 5), (6, 6)]


def frames(spark):
    return {
        "users": spark.createDataFrame([(i, n, f"{n}@example.com") for i, n in enumerate(NAMES, 1)], "id int, username string, email string"),
        "posts": spark.createDataFrame([(i, u, f"Post {i}") for i, u in enumerate(POSTS, 1)], "id int, user_id int, title string"),
        "comments": spark.createDataFrame([(i, p, u, f"Comment {i}") for i, (p, u) in enumerate(COMMENTS, 1)], "id int, post_id int, user_id int, content string"),
        "profiles": spark.createDataFrame([(i, i, f"Bio for user {i}") for i in range(1, 11)], "id int, user_id int, bio string"),
        "replies": spark.createDataFrame([(i, c, u) for i, (c, u) in enumerate(REPLIES, 1)], "id int, comment_id int, user_id int"),
    }


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, frames(spark))


def child(engine, table, change=lambda q: q, key_by="id"):
    return lambda qs: change(qs(engine.tables[table], key_by))


def posts_of(engine, change=lambda q: q):
    return ("posts", child(engine, "posts", change), "posts.user_id", "user.id")


def ids(rows):
    return [r.id for r in rows]
