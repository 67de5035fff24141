import pytest

from acreage.operators import profiling as pf
from acreage.plans.profile import profile, treat_missing


@pytest.fixture
def table(spark):
    rows = [(1.0, "a", None, 5), (2.0, "b", None, 5), (float("nan"), "b", None, 6), (100.0, None, "z", 6)]
    return spark.createDataFrame(rows, "x double, t string, mostly string, k int")


def test_kinds_and_shape(table):
    assert pf.column_kinds(table) == (["x", "k"], ["t", "mostly"])
    columns, head = pf.shape(table)
    assert columns.count() == 4 and columns.first()["rows"] == 4 and head.count() == 4


def test_missing_counts_nan(table):
    got = {r["column"]: (r["missing"], r["missing_pct"]) for r in pf.missing(table).collect()}
    assert got == {"mostly": (3, 75.0), "x": (1, 25.0), "t": (1, 25.0)}
    assert pf.missing_overall(table).first()["missing_pct"] == pytest.approx(500 / 16)


def test_treatment(table):
    done = treat_missing(table)
    assert done.columns == ["x", "t", "k"]
    assert sorted(r["x"] for r in done.collect()) == [1.0, 2.0, 2.0, 100.0]
    assert sorted(r["t"] for r in done.collect()) == ["a", "b", "b", "b"]


def test_mode_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "t string")
    assert [r["t"] for r in pf.impute_mode(df).collect()] == ["Unknown", "Unknown"]


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    assert sorted(r["t"] for r in pf.impute_mode(df).collect()) == ["a", "a", "b"]


def test_histogram_top_edge_and_constant(spark):
    df = spark.createDataFrame([(0.0, 3.0), (5.0, 3.0), (10.0, 3.0)], "x double, c double")
    got = {(r["column"], r["bin"]): r["n"] for r in pf.histogram(df, bins=10).collect()}
    assert got[("x", 9)] == 1 and got[("x", 0)] == 1 and got[("x", 5)] == 1 and sum(n for (c, _), n in got.items() if c == "x") == 3
    assert sum(n for (c, _), n in got.items() if c == "c") == 3 and len(got) == 20


def test_pairwise_correlation_skips_gaps(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 8.0)], "a double, b double")
    assert pf.correlation(df).first()["r"] == pytest.approx(1.0)


def test_sample_skewness(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "x double")
    row = pf.skew_flags(df).first()
    assert row["skewness"] == pytest.approx(1.7636, abs=1e-3) and row["flagged"]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a")], "a int, b string")
    row = pf.duplicate_count(df).first()
    assert (row["rows"], row["duplicates"], row["duplicate_pct"]) == (4, 2, 50.0)


def test_category_flags(spark):
    df = spark.createDataFrame([(str(i), "yn"[i % 2], "k") for i in range(6)], "id string, yes string, one string")
    assert {r["column"]: r["flag"] for r in pf.category_flags(df).collect()} == {"id": "high_cardinality", "yes": "binary", "one": "none"}


def test_approximate_cardinality(table):
    got = {r["column"]: r["n_distinct"] for r in pf.cardinality(table, approx=True).collect()}
    assert got == {"x": 3, "t": 2, "mostly": 1, "k": 2}


def test_whole_profile(spark, tmp_path):
    (tmp_path / "in.csv").write_text("x,t\n1,a\n2,b\n,b\n4,\n")
    out = profile(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    assert out["processed"].count() == 4 and out["missing"].count() == 2
    assert {r["kind"] for r in out["report"].select("kind").distinct().collect()} >= {"missing", "describe", "duplicates", "cardinality"}
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "numerical_statistics")).first()["column"] == "x"


def test_odd_names_and_infinities(spark):
    """Names with a dot or a blank, infinite values, and more columns than any short report."""
    rows = [(float(i), "ab"[i % 2], float("inf") if i == 3 else i * 2.0, None if i < 2 else i) for i in range(20)]
    df = spark.createDataFrame(rows, "`No. of rooms` double, `a.b c` string, `x.y` double, z int")
    assert {r["column"]: r["missing"] for r in pf.missing_counts(df).collect()} == {"No. of rooms": 0, "a.b c": 0, "x.y": 0, "z": 2}
    assert {r["column"] for r in pf.describe(df).collect()} == {"No. of rooms", "x.y", "z"}
    assert sum(r["n"] for r in pf.histogram(df).collect() if r["column"] == "x.y") == 19
    assert pf.impute_median(df).filter("z is null").isEmpty() and pf.impute_mode(df).columns == df.columns
    assert pf.profile_report(df).count() and pf.drop_sparse(df, 0.05).columns == ["No. of rooms", "a.b c", "x.y"]
    wide = df.select(*[pf.quoted("No. of rooms").alias(f"n{i}") for i in range(12)], *[pf.quoted("a.b c").alias(f"t{i}") for i in range(8)])
    assert pf.histogram(wide).select("column").distinct().count() == 12
    assert pf.skew_flags(wide).count() == pf.iqr_outliers(wide).count() == pf.box_stats(wide).count() == 12
    assert pf.category_flags(wide).count() == 8 and pf.top_values(wide).select("column").distinct().count() == 8
