"""The files that the catalogue writes."""

import glob
import os

from acreage.catalog import files as cf


def test_no_file_is_written_by_one_task(spark, sf, monkeypatch):
    """The raw rows lie in several partitions; every file has as many parts."""
    raw = spark.range(400).selectExpr("id as row_key", "'c' as city_raw", "'3' as rooms_raw", "'100' as sqft_raw", "'1' as price_raw", "'5' as plain_price_raw", "'no' as parking_raw",
                                      "'0' as count_raw", "'1990' as year_raw", "'Furnished' as furnishing_raw").repartition(4)
    monkeypatch.setattr(cf, "view", lambda *_: raw)
    monkeypatch.setattr(cf, "stored", lambda df, _: df)
    root = cf._data_folder(spark, sf, ("usa", "japan"))
    assert {p: len(glob.glob(f"{root}/{p}/part-*")) for p in ("USA/kc_house_data.csv", "JAPAN/01.csv", "JAPAN/02.csv")} == {
        "USA/kc_house_data.csv": 4, "JAPAN/01.csv": 4, "JAPAN/02.csv": 4}
    assert cf._capped(spark, sf).groupBy("place").count().collect() and cf._capped(spark, sf).count() == 60


def test_source_files_are_packed_and_the_joined_rows_go(spark, tmp_path, monkeypatch):
    from acreage import session
    raw = spark.range(3000).selectExpr("id as row_key", "concat('city \"', id % 50, '\", north') as city_raw", "'3' as rooms_raw", "concat(100 + id % 7, ' sqft') as sqft_raw", "'1' as price_raw",
                                       "cast(id as string) as plain_price_raw", "'no' as parking_raw", "'0' as count_raw", "'1990' as year_raw", "'Furnished' as furnishing_raw")
    monkeypatch.setattr(cf, "view", lambda *_: raw)
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    root = cf._data_folder(spark, "", ("india_rent", "poland"))
    size = sum(os.path.getsize(p) for p in glob.glob(f"{root}/*/*/part-*"))
    assert not glob.glob(f"{os.path.dirname(root)}/joined-*") and not glob.glob(f"{os.path.dirname(root)}/raw-*/part-*")
    frames = [f for name in ("INDIA/*.csv", "POLAND/*.csv") for f in cf.fs.read_file_set(spark, f"{root}/{name}")]
    text = sum(len(",".join(str(v) for v in r)) + 1 for f in frames for r in f.drop(cf.fs.FILE_PATH).collect())
    assert [f.count() for f in frames] == [3000, 3000, 1500] and size < text / 3


def test_the_raw_view_is_joined_once(spark, sf, monkeypatch):
    from acreage.catalog import cleaning as cc
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    raw = cf.view(spark, sf, "raw_listings")
    counted = raw.limit(100).mapInArrow(count, raw.schema)
    monkeypatch.setattr(cc, "view", lambda *_: counted)
    assert cc._all_shapes(spark, sf).count() > 100
    assert seen.value == 100


def _counting(spark, df):
    """The frame, and how many of its rows were made so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    return df.mapInArrow(count, df.schema), seen


def test_views_that_are_read_many_times_are_joined_once(spark, sf, monkeypatch):
    from acreage.catalog import modelling as cm, profiling as cp
    rows = spark.createDataFrame(cf.view(spark, sf, "listings").limit(300).collect())
    counted, seen = _counting(spark, rows)
    monkeypatch.setattr(cm, "listings", lambda *_: counted)
    assert cm._ridge(spark, sf).count() == 1 and seen.value == 300
    assert cm._tree_scores(spark, sf).count() == 300 and seen.value == 600
    raw, seen_raw = _counting(spark, spark.createDataFrame(cf.view(spark, sf, "raw_listings").limit(300).collect()))
    monkeypatch.setattr(cp, "view", lambda *_: raw)
    assert cp.ENTRIES["profile_report"][0](spark, sf).count() > 10 and seen_raw.value == 300
