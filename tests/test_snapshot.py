"""Stored tables that are brought up to date in batches."""

import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acreage.operators import accounts as ac
from acreage.operators.snapshot import Snapshot
from acreage.streaming.scoring import read_requests
from acreage.streaming.user_stats import latest_user_stats, user_stats_stream

USER = "id int, username string, email string, password string, role string, is_active boolean, full_name string"
CHANGE = "id int, seq int, op string, full_name string"


def users(spark, n=40):
    return spark.createDataFrame([(i, f"u{i}", f"{i}@x.com", "pw", "user", True, None) for i in range(n)], USER)


def files(root):
    return sorted(glob.glob(f"{root}/data/**/*.parquet", recursive=True))


def rows(df):
    return sorted(map(str, df.collect()))


def test_batches_equal_one_update(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path), "id", buckets=8)
    assert table.read() is None and table.version() is None
    table.apply(users(spark), lambda _, new: new, 0)
    events = [(3, 1, "update", "Three"), (3, 2, "delete", None), (3, 3, "update", "After"), (4, 4, "delete", None), (4, 5, "create", "Back"), (99, 6, "create", "New"), (99, 7, "update", "Newer"),
              (5, 8, "update", "Five"), (5, 9, "update", None)]
    whole = ac.apply_changes(users(spark), spark.createDataFrame(events, CHANGE))
    for number in range(3):
        ac.update_users(table, spark.createDataFrame(events[3 * number:3 * number + 3], CHANGE), number + 1)
    assert rows(table.read()) == rows(whole)
    got = {r["id"]: (r["is_active"], r["full_name"]) for r in table.read().filter("id in (3, 4, 99, 5)").collect()}
    assert got == {3: (False, "After"), 4: (True, "Back"), 99: (True, "Newer"), 5: (True, "Five")}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path), "id", buckets=8)
    table.apply(users(spark), lambda _, new: new)
    before = table.folders()
    change = spark.createDataFrame([(7, 1, "update", "Seven")], CHANGE)
    ac.update_users(table, change)
    touched = change.select(table.bucket()).first()[0]
    after = table.folders()
    assert {b for b in after if after[b] != before[b]} == {touched} and len(after) == len(before) > 3
    assert table.read(0).filter("full_name is not null").isEmpty()  # the version before is still there


def test_files_do_not_grow_with_batches(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path), "id", buckets=4)
    table.apply(users(spark), lambda _, new: new, 0)
    for number in range(1, 8):
        ac.update_users(table, spark.createDataFrame([(number, number, "update", f"n{number}")], CHANGE), number)
    assert len(files(tmp_path)) <= 4 + 2 and table.version() == 7
    assert table.read().filter("full_name is not null").count() == 7


def test_a_batch_counts_once_and_a_dead_one_not_at_all(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path), "id", buckets=4)
    add = lambda old, new: new if old is None else old.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"))
    part = spark.createDataFrame([(1, 5), (2, 6)], "id int, n long")
    table.apply(part, add, 0)
    table.apply(part, add, 1)
    assert table.apply(part, add, 1) == 1 and rows(table.read()) == ["Row(id=1, n=10)", "Row(id=2, n=12)"]

    def fails(old, new):
        return old.unionByName(new).withColumn("n", F.raise_error(F.lit("dies")).cast("long"))
    with pytest.raises(Exception, match="dies"):
        table.apply(part, fails, 2)
    assert rows(table.read()) == ["Row(id=1, n=10)", "Row(id=2, n=12)"]
    table.apply(part, add, 2)
    assert rows(table.read()) == ["Row(id=1, n=15)", "Row(id=2, n=18)"]
    table.apply(part, lambda old, new: old.limit(0), 3)
    assert table.read().count() == 0 and table.read().columns == ["id", "n"]
    table.apply(part.limit(0), add, 4)
    table.apply(spark.createDataFrame([(None, 1)], "id int, n long"), add, 5)
    assert rows(table.read()) == ["Row(id=None, n=1)"]
    with pytest.raises(ValueError):
        table.apply(part.filter("id = 1"), lambda old, new: spark.range(20).select(F.col("id").cast("int"), F.lit(1).alias("n")), 6)


def test_stream_of_many_batches(spark, tmp_path):
    folder, out = str(tmp_path / "h"), str(tmp_path / "s")
    schema = T.StructType.fromDDL("id int, user_id int, predicted_price double, created_at timestamp_ntz")
    history = spark.range(90).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") % 7 > 0, F.col("id") % 6).cast("int").alias("user_id"),
                                     F.when(F.col("id") % 5 > 0, F.col("id") * 10).cast("double").alias("predicted_price"), F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("created_at"))
    counts = []
    for low in range(0, 90, 15):
        history.filter(F.col("id").between(low, low + 14)).coalesce(1).write.mode("append").parquet(folder)
        user_stats_stream(read_requests(spark, folder, schema, files_per_batch=1), out, str(tmp_path / "ck"), buckets=4).awaitTermination()
        counts.append(len(files(out)))
    assert counts[-1] <= counts[1]
    assert rows(latest_user_stats(spark, out)) == rows(ac.user_prediction_stats(history))
