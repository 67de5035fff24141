import math

import numpy as np
import pandas as pd
import pytest

from acreage.operators.quantiles import quantile_frame, quantiles

PROBS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def frame():
    rng = np.random.default_rng(5)
    n = 4000
    return pd.DataFrame({
        "long_tail": rng.lognormal(10, 3, n),
        "hot_value": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 1, n)),
        "binary": rng.integers(0, 2, n).astype(float),
        "huge": rng.standard_cauchy(n) * 1e200,
        "tiny": rng.random(n) * 1e-300,
    })


def test_narrowing_equals_pandas(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf).repartition(5)
    targets = {(c, p): (c, p) for c in pdf for p in PROBS}
    small = quantiles(df, targets)
    narrowed = quantiles(df, targets, sorted_rows=50, buckets=16)
    for (c, p), found in narrowed.items():
        assert found == pytest.approx(pdf[c].quantile(p), rel=1e-9, abs=1e-320)
        assert small[(c, p)] == pytest.approx(found, rel=1e-12, abs=1e-320)


def test_gaps_infinities_and_empty_columns(spark):
    rows = [(float(i), None) for i in range(10)] + [(math.nan, None), (math.inf, None), (-math.inf, None)]
    df = spark.createDataFrame(rows, "x double, none double")
    got = quantiles(df, {"lo": ("x", 0.0), "mid": ("x", 0.5), "hi": ("x", 1.0), "none": ("none", 0.5)}, sorted_rows=2, buckets=4)
    assert got == {"lo": -math.inf, "mid": 4.5, "hi": math.inf, "none": None}


def test_one_row_frame_and_approximation(spark):
    df = spark.range(1001).selectExpr("cast(id as double) as x")
    assert quantile_frame(df, {"q": ("x", 0.5)}).first()["q"] == 500.0
    assert quantiles(df, {"q": ("x", 0.5)}, accuracy=10_000)["q"] == pytest.approx(500, abs=1)


def test_weights_count_as_rows(spark):
    rng = np.random.default_rng(1)
    values, counts = rng.lognormal(3, 2, 500), rng.integers(-1, 60, 500)
    df = spark.createDataFrame([(float(v), int(n)) for v, n in zip(values, counts)] + [(math.nan, 50), (5.0, None)], "x double, n int")
    want = pd.Series(np.repeat(values, np.maximum(counts, 0)))
    for options in ({}, {"sorted_rows": 20, "buckets": 8}):
        got = quantiles(df, {p: ("x", p) for p in PROBS}, weight="n", **options)
        assert got == {p: pytest.approx(want.quantile(p), rel=1e-9) for p in PROBS}


def test_a_rank_outside_its_bracket_is_found_all_the_same(spark, monkeypatch):
    """A sketch as coarse as can be, and no slack."""
    monkeypatch.setattr("acreage.operators.quantiles.SKETCH", 8)
    monkeypatch.setattr("acreage.operators.quantiles.SLACK", 0.0)
    pdf = frame()
    got = quantiles(spark.createDataFrame(pdf).repartition(3), {(c, p): (c, p) for c in pdf for p in PROBS}, sorted_rows=30, buckets=8)
    for (c, p), found in got.items():
        assert found == pytest.approx(pdf[c].quantile(p), rel=1e-9, abs=1e-320)


def test_what_made_the_rows_runs_once_and_three_scans_do(spark):
    """The input is evaluated for one write; a million rows take the sketch, the bracket and the sorting."""
    from pyspark.sql import functions as F
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    n = 1_000_000
    df = spark.range(n).select(F.exp(F.rand(2) * 20).alias("x")).mapInArrow(count, "x double")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("quantiles", "quantiles")
    got = quantiles(df, {p: ("x", p) for p in (0.01, 0.5, 0.99)})
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert seen.value == n
    assert got[0.01] < got[0.5] < got[0.99] and got[0.5] == pytest.approx(math.exp(10), rel=0.05)
    assert len(jobs.getJobIdsForGroup("quantiles")) < 30


def test_intervals_are_looked_up_without_a_join(spark):
    """Intervals of a column that overlap each get their values; the rows are not joined with the intervals."""
    from acreage.operators import quantiles as q
    long = spark.range(100).selectExpr("1L as w", "cast(id % 2 as int) as id", "cast(id as double) as x")
    intervals = [q._Interval(0, 10.0, 20.0, 0, 6), q._Interval(0, 0.0, 98.0, 0, 50), q._Interval(1, 95.0, 99.0, 0, 3), q._Interval(0, 40.0, 44.0, 0, 3)]
    inside = q._inside(long, intervals)
    assert {r["iv"]: r["n"] for r in inside.groupBy("iv").agg({"x": "count"}).withColumnRenamed("count(x)", "n").collect()} == {0: 6, 1: 50, 2: 3, 3: 3}
    assert "Join" not in inside._jdf.queryExecution().optimizedPlan().toString()
