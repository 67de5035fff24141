"""Merged states of parts beside the profile of the whole table."""

import math

import numpy as np
import pandas as pd
import pytest

from acreage.operators.growing_profile import GrowingProfile, merge_states, profile_states


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    n = 60_000
    out = pd.DataFrame({"even": rng.random(n) * 1e6, "tail": rng.lognormal(5, 2, n), "few": rng.integers(0, 9, n), "name": [f"n{i}" for i in rng.integers(0, 20_000, n)],
                        "kind": rng.choice(["a", "b", None], n)})
    out.loc[::7, "tail"] = np.nan
    return out


def test_merged_parts_equal_the_whole_within_the_stated_errors(spark, table, tmp_path):
    grown = GrowingProfile(spark, str(tmp_path))
    cuts = [0, 100, 25_000, 25_001, 60_000]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        grown.add(str(i), spark.createDataFrame(table.iloc[a:b]).repartition(3))
    got = {r["column"]: r for r in grown.profile().collect()}
    for c in ("even", "tail", "few"):
        x = table[c].dropna()
        r = got[c]
        assert (r["rows"], r["missing"], r["min"], r["max"]) == (len(table), len(table) - len(x), x.min(), x.max())
        assert r["mean"] == pytest.approx(x.mean(), rel=1e-12) and r["std"] == pytest.approx(x.std(), rel=1e-10)
        for name, share in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
            below, upto = (x < r[name]).mean(), (x <= r[name]).mean()
            assert below - 0.004 <= share <= upto + 0.004
    for c in table:
        assert got[c]["n_distinct"] == pytest.approx(table[c].nunique(), rel=0.03)
    assert got["few"]["n_distinct"] == 9 and got["kind"]["missing"] == table["kind"].isna().sum()
    assert got["name"]["mean"] is None and got["name"]["kind"] == "text"


def test_a_new_part_is_profiled_alone(spark, table, tmp_path):
    """A part that comes again replaces its state, and the files of the other parts stay as they are."""
    grown = GrowingProfile(spark, str(tmp_path))
    grown.add("one", spark.createDataFrame(table.iloc[:1000]))
    before = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "part=one").iterdir())
    grown.add("two", spark.createDataFrame(table.iloc[1000:1500]))
    grown.add("two", spark.createDataFrame(table.iloc[1000:1200]))
    assert sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "part=one").iterdir()) == before
    assert {r["rows"] for r in grown.profile().collect()} == {1200}


def test_odd_parts(spark):
    schema = "x double, `a.b` string"
    parts = [spark.createDataFrame(rows, schema) for rows in ([(1.0, "p"), (math.nan, None)], [(None, None)], [(math.inf, "q"), (-math.inf, "p")], [])]
    states = [profile_states(p) for p in parts]
    got = {r["column"]: r for r in merge_states(states[0].union(states[1]).union(states[2]).union(states[3])).collect()}
    assert (got["x"]["rows"], got["x"]["missing"], got["x"]["min"], got["x"]["max"]) == (5, 2, -math.inf, math.inf)
    assert (got["a.b"]["rows"], got["a.b"]["missing"], got["a.b"]["n_distinct"], got["a.b"]["q50"]) == (5, 2, 2, None)
    with pytest.raises(ValueError):
        profile_states(spark.createDataFrame([(True,)], "b boolean"))
