import datetime as dt

from acreage.operators import accounts as ac, texts as tx


def users(spark):
    return spark.createDataFrame([(1, "ann", "A@X.com ", "pw", "admin", True, " "), (2, "bob", "b@x.com", "pw", "user", True, "Bob")],
                                 "id int, username string, email string, password string, role string, is_active boolean, full_name string")


def test_latest_given_value_of_each_field_wins(spark):
    changes = spark.createDataFrame(
        [(1, 5, "update", "New", None), (1, 7, "update", None, "ann2"), (1, 3, "update", "Old", "older"), (2, 1, "delete", None, None),
         (2, 2, "update", "Late", None), (3, 1, "create", "Cat", "cat")],
        "id int, seq int, op string, full_name string, username string")
    got = {r["id"]: (r["username"], r["full_name"], r["is_active"]) for r in ac.apply_changes(users(spark), changes).collect()}
    assert got == {1: ("ann2", "New", True), 2: ("bob", "Late", False), 3: ("cat", "Cat", True)}


def test_keys_and_conflicts(spark):
    row = ac.normalise_keys(users(spark)).orderBy("id").first()
    assert (row["email"], row["full_name"]) == ("a@x.com", None)
    new = spark.createDataFrame([(10, "zoe", " a@x.COM"), (11, "bob", "n@x.com"), (12, "eve", "e@x.com"), (13, "eve", "f@x.com")],
                                "id int, username string, email string")
    got = sorted(tuple(r) for r in ac.key_conflicts(new, users(spark)).collect())
    assert got == [(10, "email", "existing"), (11, "username", "existing"), (12, "username", "batch"), (13, "username", "batch")]


def test_public_listing_and_labels(spark):
    assert "password" not in ac.public_users(users(spark)).columns
    row = ac.status_label(users(spark)).orderBy("id").first()
    assert (row["role_badge"], row["status"]) == ("active", "Active")


def test_recent_predictions_push_the_limit_below_the_shuffle(spark):
    rows = [(i, i % 3 if i % 5 else None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i // 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, user_id int, created_at timestamp")
    got = ac.recent_predictions(df, 2)
    by_user = {}
    for r in got.collect():
        by_user.setdefault(r["user_id"], set()).add(r["id"])
    for user, ids in by_user.items():
        mine = sorted(((t, i) for i, u, t in rows if u == user), reverse=True)[:2]
        assert ids == {i for _, i in mine}
    assert set(by_user) == {0, 1, 2}
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_intent_takes_the_first_keyword(spark):
    df = spark.createDataFrame([("This is fine",), ("What RENT?",), ("   ",), (None,), ("ok",), ("price of a loan",)], "text string")
    assert [r["intent"] for r in tx.intent(df).collect()] == ["hi", "rent", "empty", "empty", "default", "price"]


def test_block_kinds(spark):
    text = "MARKET OUTLOOK: 2024\n\n1. Location: matters\nmore\n\n- one\n- two\n\nKey point: short\n\n\n\nA plain paragraph. End: yes.\n\n  "
    rows = tx.blocks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("position").collect()
    assert [r["kind"] for r in rows] == ["heading", "numbered", "bullets", "subheading", "paragraph"]
