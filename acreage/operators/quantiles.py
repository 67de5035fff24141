"""Exact quantiles at any size.

The built-in ``percentile`` keeps every distinct value in the memory of one task. Here the values
are written once, and a column is narrowed down: a mergeable quantile sketch brackets each wanted
rank, the next pass counts what lies below the bracket and in equal-width buckets inside it, and
the one after sorts the bucket that holds the rank. That is three scans of the written values,
whatever the number of columns and probabilities; only a bucket that still has many rows (very
uneven values) is divided again. Each pass sends one row for each bucket. If a sketch errs by more
than its bound, the rank is not in its bracket; it is then looked for in the whole column, so the
result is exact all the same. A column that is small from the start is sorted at once.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.functions.scalars import quoted
from acreage.session import drop_path, local_frame, scratch_path

SORTED_ROWS = 100_000
BUCKETS = 2_048
# of the sketch: its size, and by how much a rank may err, as a share of the rows (three times what is usual for the size)
SKETCH, SLACK = 4_096, 0.002


@dataclass
class _Interval:
    """A closed range of one column whose ends are values of the column."""

    column: int
    lo: float
    hi: float
    below: int
    rows: int
    ranks: set[int] = field(default_factory=set)

    @property
    def half_width(self) -> float:
        # halves keep the width of a huge interval finite
        return self.hi * 0.5 - self.lo * 0.5


def _layers(intervals: list[_Interval]) -> list[dict[int, list[int]]]:
    """The numbers of the intervals by column, in layers in which those of a column lie one above the other."""
    layers: list[dict[int, list[int]]] = []
    for i in sorted(range(len(intervals)), key=lambda i: (intervals[i].lo, i)):
        v = intervals[i]
        layer = next((one for one in layers if v.column not in one or intervals[one[v.column][-1]].hi < v.lo), None)
        if layer is None:
            layers.append(layer := {})
        layer.setdefault(v.column, []).append(i)
    return layers


def _table(values: list, at: Column) -> Column:
    """The entry of a small list that belongs to a row: a look-up, not a join, which would make a row for each interval of the column."""
    return F.get(F.lit(values), at)


def _inside(long: DataFrame, intervals: list[_Interval]) -> DataFrame:
    """The values of every interval, tagged with its number and its ends."""
    codes, columns = [], max(v.column for v in intervals) + 1
    for layer in _layers(intervals):
        code = F
        for k in range(max(map(len, layer.values()))):
            number = [layer[c][k] if k < len(layer.get(c, ())) else None for c in range(columns)]
            lo, hi = ([math.nan if i is None else getattr(intervals[i], end) for i in number] for end in ("lo", "hi"))
            inside = (F.col("x") >= _table(lo, F.col("id"))) & (F.col("x") <= _table(hi, F.col("id")))
            code = code.when(inside, _table([-1 if i is None else i for i in number], F.col("id")))
        codes.append(code)
    tagged = long.withColumn("iv", codes[0]).filter(F.col("iv").isNotNull()) if len(codes) == 1 else long.withColumn("iv", F.explode(F.array_compact(F.array(*codes))))
    return tagged.withColumns({end: _table([getattr(v, end) for v in intervals], F.col("iv")) for end in ("lo", "hi")})


def _slot(buckets: int) -> Column:
    """The bucket of x between lo and hi; halves keep a huge width finite. 0 where both ends are one value."""
    share = F.coalesce(F.try_divide(F.col("x") * 0.5 - F.col("lo") * 0.5, F.col("hi") * 0.5 - F.col("lo") * 0.5), F.lit(0.0))
    return F.least(F.lit(buckets - 1), F.floor(share * buckets).cast("int"))


def _narrow(long: DataFrame, intervals: list[_Interval], buckets: int) -> list[_Interval]:
    """The buckets of each interval that hold its ranks.

    Both ends are values of the column, so they fall into different buckets and every pass makes
    progress.
    """
    found = (_inside(long, intervals).groupBy("iv", _slot(buckets).alias("slot"))
             .agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
    out = []
    for i, v in enumerate(intervals):
        seen = v.below
        for row in sorted((r for r in found if r["iv"] == i), key=lambda r: r["slot"]):
            held = {k for k in v.ranks if seen <= k < seen + row["n"]}
            if held:
                out.append(_Interval(v.column, row["lo"], row["hi"], seen, row["n"], held))
            seen += row["n"]
    return out


def _sorted_values(long: DataFrame, intervals: list[_Interval]) -> dict[tuple[int, int], float]:
    """Sort the few distinct values left in each interval and read those at the ranks."""
    running = F.sum("n").over(Window.partitionBy("iv").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    upto = (_inside(long, intervals).groupBy("iv", "x").agg(F.sum("w").alias("n")).withColumn("upto", running))
    wanted = [(i, k, k - v.below) for i, v in enumerate(intervals) for k in v.ranks]
    ranks = local_frame(long.sparkSession, wanted, "iv int, rank long, place long")
    rows = (upto.join(ranks, "iv").filter(F.col("upto") > F.col("place"))
            .groupBy("iv", "rank").agg(F.min("x").alias("x")).collect())
    return {(intervals[r["iv"]].column, r["rank"]): r["x"] for r in rows}


def _bracketed(long: DataFrame, sketches: DataFrame, whole: list[_Interval], buckets: int) -> list[_Interval]:
    """For each rank of a column the bucket of its sketch's bracket that holds it; the whole column where the bracket does not.

    Brackets of a column that meet are one region. A value lies in the gap below a region or in one of its buckets, and counts once.
    """
    asked = [(v.column, k, (k - v.below) / v.rows) for v in whole for k in v.ranks]
    own = lambda c, share: F.max(F.when(F.col("id") == c, F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, share))))))
    ends = sketches.agg(*[own(c, share + side).alias(f"e{i}_{side > 0}") for i, (c, _, share) in enumerate(asked) for side in (-SLACK, SLACK or 1e-12)]).first()
    regions: dict[int, list[_Interval]] = {v.column: [] for v in whole}
    for lo, hi, c, rank in sorted((ends[2 * i], ends[2 * i + 1], c, rank) for i, (c, rank, _) in enumerate(asked)):
        if regions[c] and lo <= regions[c][-1].hi:
            regions[c][-1].hi = max(regions[c][-1].hi, hi)
        else:
            regions[c].append(_Interval(c, lo, hi, 0, 0))
        regions[c][-1].ranks.add(rank)
    order = [v for c in sorted(regions) for v in regions[c]]
    numbers = {id(v): i for i, v in enumerate(order)}
    most, columns = max(map(len, regions.values())), max(regions) + 1
    region = F
    for k in range(most):  # the first region whose upper end is not below the value
        own_regions = [regions[c][k] if k < len(regions.get(c, ())) else None for c in range(columns)]
        upper = _table([-math.inf if v is None else v.hi for v in own_regions], F.col("id"))
        region = region.when(F.col("x") <= upper, _table([-1 if v is None else numbers[id(v)] for v in own_regions], F.col("id")))
    tagged = long.withColumn("iv", region).filter(F.col("iv").isNotNull()).withColumns({end: _table([getattr(v, end) for v in order], F.col("iv")) for end in ("lo", "hi")})
    rows = (tagged.groupBy("iv", F.when(F.col("x") < F.col("lo"), -1).otherwise(_slot(buckets)).alias("slot"))
            .agg(F.sum("w").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect())
    by_region: dict[int, list] = {}
    for r in rows:
        by_region.setdefault(r["iv"], []).append(r)
    out: dict[tuple, _Interval] = {}
    for column in whole:
        seen, missed = column.below, set(column.ranks)
        for v in regions[column.column]:
            for r in sorted(by_region.get(numbers[id(v)], ()), key=lambda r: r["slot"]):
                held = {k for k in v.ranks if r["slot"] >= 0 and seen <= k < seen + r["n"]}
                if held:
                    out[column.column, r["lo"], r["hi"], seen] = _Interval(column.column, r["lo"], r["hi"], seen, r["n"], held)
                    missed -= held
                seen += r["n"]
        if missed:
            out[column.column, column.lo, column.hi, column.below] = _Interval(column.column, column.lo, column.hi, column.below, column.rows, missed)
    return list(out.values())


def _select(long: DataFrame, intervals: list[_Interval], sorted_rows: int, buckets: int) -> dict[tuple[int, int], float]:
    done: dict[tuple[int, int], float] = {}
    few: list[_Interval] = []
    while intervals:
        wide = []
        for v in intervals:
            if v.lo == v.hi:
                done |= {(v.column, k): v.lo for k in v.ranks}
            elif v.rows <= sorted_rows or v.half_width == 0:
                few.append(v)
            else:
                wide.append(v)
        intervals = _narrow(long, wide, buckets) if wide else []
    return done | (_sorted_values(long, few) if few else {})


def quantiles(df: DataFrame, targets: Mapping[object, tuple[Column | str, float]], accuracy: int | None = None,
              sorted_rows: int = SORTED_ROWS, buckets: int = BUCKETS, weight: Column | str | None = None) -> dict[object, float | None]:
    """Quantiles by linear interpolation, nulls and NaN left out.

    ``targets`` names each wanted value as (column, probability). ``accuracy`` asks for one
    approximate pass instead of exact values. With ``weight``, a column of whole numbers, a row counts as so many rows; one with none or less is left out.
    """
    exprs: list[Column] = []
    ids: dict[str, int] = {}
    wanted: dict[object, tuple[int, float]] = {}
    for key, (c, p) in targets.items():
        label = c if isinstance(c, str) else str(c)
        if label not in ids:
            ids[label] = len(exprs)
            raw = (quoted(c) if isinstance(c, str) else c).cast("double")
            exprs.append(F.when(~F.isnan(raw), raw).alias(f"v{ids[label]}"))
        wanted[key] = (ids[label], float(p))
    if not wanted:
        return {}
    spark = df.sparkSession

    if accuracy is not None:
        if weight is not None:
            raise ValueError("weighted quantiles are exact only")
        row = df.select(*exprs).agg(*[F.percentile_approx(f"v{c}", F.lit(p), accuracy).alias(f"q{i}")
                                      for i, (c, p) in enumerate(wanted.values())]).first()
        return {key: row[f"q{i}"] for i, key in enumerate(wanted)}

    rows = (F.col(weight) if isinstance(weight, str) else weight).cast("long") if weight is not None else F.lit(1).cast("long")
    path = scratch_path(spark, "quantiles")
    df.select(*exprs, rows.alias("w")).write.parquet(path)  # what made the rows is not run again for each pass
    try:
        return _exact(spark.read.parquet(path), len(exprs), wanted, sorted_rows, buckets, weight is None)
    finally:
        drop_path(spark, path)


def _exact(values: DataFrame, columns: int, wanted: Mapping[object, tuple[int, float]], sorted_rows: int, buckets: int, sketched: bool) -> dict[object, float | None]:
    """The wanted (column, probability) of the columns v0, v1, ... with the weight w."""
    long = values.filter("w > 0").select("w", F.inline(F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"v{i}").alias("x"))
                                                                 for i in range(columns)]))).filter(F.col("x").isNotNull())
    bounded = F.when(F.abs("x") < math.inf, F.col("x"))
    weighed = lambda test: F.sum(F.when(test, F.col("w")).otherwise(0))
    path = scratch_path(values.sparkSession, "quantile-stats")
    long.groupBy("id").agg(
        F.sum("w").alias("n"), weighed(F.col("x") == -math.inf).alias("neg"), weighed(F.col("x") == math.inf).alias("pos"), F.min(bounded).alias("lo"), F.max(bounded).alias("hi"),
        *([F.kll_sketch_agg_double(bounded, F.lit(SKETCH)).alias("sketch")] if sketched else [])).write.parquet(path)
    table = values.sparkSession.read.parquet(path)  # a row for each column
    stats = {r["id"]: r for r in table.select("id", "n", "neg", "pos", "lo", "hi").collect()}

    # infinities sit at the ends of the order; the search runs over the finite values between
    found: dict[tuple[int, int], float] = {}
    search = {c: _Interval(c, s["lo"], s["hi"], s["neg"], s["n"] - s["neg"] - s["pos"]) for c, s in stats.items()}
    for c, p in wanted.values():
        if c in stats:
            position = p * (stats[c]["n"] - 1)
            for k in {math.floor(position), math.ceil(position)}:
                if k < stats[c]["neg"]:
                    found[(c, k)] = -math.inf
                elif k >= stats[c]["n"] - stats[c]["pos"]:
                    found[(c, k)] = math.inf
                else:
                    search[c].ranks.add(k)
    finite_only = long.filter(F.abs("x") < math.inf)
    whole = [v for v in search.values() if v.ranks]
    large = [v for v in whole if sketched and v.rows > sorted_rows and v.lo < v.hi]
    if large:
        whole = [v for v in whole if v not in large] + _bracketed(finite_only, table.select("id", "sketch"), large, buckets)
    found |= _select(finite_only, whole, sorted_rows, buckets)
    drop_path(values.sparkSession, path)

    out: dict[object, float | None] = {}
    for key, (c, p) in wanted.items():
        if c not in stats:
            out[key] = None
            continue
        position = p * (stats[c]["n"] - 1)
        low, high = found[(c, math.floor(position))], found[(c, math.ceil(position))]
        out[key] = low if low == high else low + (high - low) * (position - math.floor(position))
    return out


def quantile_frame(df: DataFrame, targets: Mapping[str, tuple[Column | str, float]], **options) -> DataFrame:
    """The same values as a one-row frame."""
    found = quantiles(df, targets, **options)
    return local_frame(df.sparkSession, [tuple(found.values())], ", ".join(f"{k} double" for k in found))
