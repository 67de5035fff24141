"""How a chain of filters interacts: what each one removes in every order, from sorted posting lists of failing documents."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace
from itertools import permutations
from math import factorial

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import Scratch
from acreage.session import local_frame

FILTERS = "ABCDE"
RANGE_ROWS = 16_384  # documents of one id range
_CAPITALS, _MARKS = bytes(range(65, 91)), frozenset(b"#$%&*|")
_CONTINUED = bytes(range(0x80, 0xC0))


def failing(text: bytes) -> int:
    """Bits of the filters A to D that a text fails: few words, few distinct words, many capitals, marks."""
    words = text.split()
    n, points = len(words), len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | (not _MARKS.isdisjoint(text)) << 3


def _flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, high, low = [], [], []
        for text in batch.column("text").to_pylist():
            masks.append(failing(text))
            digest = xxhash.xxh3_128_digest(text)
            high.append(int.from_bytes(digest[:8], "big", signed=True))
            low.append(int.from_bytes(digest[8:], "big", signed=True))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                                         names=["id", "part", "mask", "h1", "h2"])


def gallop(values: list[int], x: int, low: int) -> int:
    """The first place from ``low`` on with a value of ``x`` or more: steps that double, then bisection of the last one."""
    high, step, n = low, 1, len(values)
    while high < n and values[high] < x:
        low = high + 1
        high += step
        step *= 2
    return bisect_left(values, x, low, min(high, n))


def union(lists: list[list[int]]) -> list[int]:
    """Sorted distinct values of sorted lists. The list with the smallest head gives all it has below the others' heads at once."""
    heads = [(x[0], i) for i, x in enumerate(lists) if x]
    heapify(heads)
    places, out, last = [0] * len(lists), [], None
    while len(heads) > 1:
        head, i = heads[0]
        values, a = lists[i], places[i]
        second = min(heads[1:3])[0]
        if head == last:
            a += 1
        b = gallop(values, second, a) if a < len(values) and values[a] < second else a
        if b == a and head != last:  # the same head in two lists
            b = a + 1
        if b > a:
            out += values[a:b]
            last = out[-1]
        places[i] = b
        if b < len(values):
            heapreplace(heads, (values[b], i))
        else:
            heappop(heads)
    for head, i in heads:
        out += lists[i][places[i] + (head == last):]
    return out


def difference(values: list[int], other: list[int]) -> list[int]:
    """Values of one sorted list that another does not have."""
    out, a, b, n, m = [], 0, 0, len(values), len(other)
    while a < n:
        b = gallop(other, values[a], b)
        if b == m:
            return out + values[a:]
        if other[b] == values[a]:
            a += 1
        else:
            c = gallop(values, other[b], a)
            out += values[a:c]
            a = c
    return out


def shared(values: list[int], other: list[int]) -> int:
    """How many values two sorted lists have in common."""
    if len(values) > len(other):
        values, other = other, values
    n, b, m = 0, 0, len(other)
    for x in values:
        b = gallop(other, x, b)
        if b == m:
            break
        n += other[b] == x
    return n


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the rows, which come by id, into ranges; for each range and part the places of the rows that fail each filter."""
    lists: dict[str, list] = {}
    seen = 0

    def flush():
        parts = list(lists)
        columns = list(zip(*lists.values())) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.list_(pa.list_(pa.int32()))),
                                           pa.array(columns[2], pa.list_(pa.int32())), pa.array(columns[3], pa.list_(pa.int32()))], names=["part", "n", "fails", "good", "toxic"])
    for batch in batches:
        for part, mask, good, toxic in zip(*(batch.column(c).to_pylist() for c in ("part", "mask", "good", "toxic"))):
            own = lists.get(part)
            if own is None:
                own = lists[part] = [0, [[] for _ in FILTERS], [], []]
            own[0] += 1
            for k in range(len(FILTERS)):
                if mask >> k & 1:
                    own[1][k].append(seen)
            if good:
                own[2].append(seen)
            if toxic:
                own[3].append(seen)
            seen += 1
            if seen == RANGE_ROWS:
                yield flush()
                lists.clear()
                seen = 0
    if lists:
        yield flush()


def sizes(fails: list[list[int]], good: list[int], toxic: list[int]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """For each set of filters already applied (as bits) and each further filter: documents removed before, removed by it, those of them that are good and toxic,
    and those failing it at all."""
    for before in range(1 << len(fails)):
        gone = union([x for k, x in enumerate(fails) if before >> k & 1])
        for k, own in enumerate(fails):
            if not before >> k & 1:
                removed = difference(own, gone)
                yield before, k, len(gone), len(removed), shared(removed, good), shared(removed, toxic)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "before", "filter", "n", "gone", "removed", "failing", "good", "toxic"]
    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
    for batch in batches:
        for part, n, fails, good, toxic in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "fails", "good", "toxic"))):
            rows = [(part, before, k, n, gone, removed, len(fails[k]), g, t) for before, k, gone, removed, g, t in sizes(fails, good, toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row (id, part, mask, good, toxic) for each document; bit k of the mask: it fails the filter ``FILTERS[k]``."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    flags = scratch.put(rows.mapInArrow(_flags, f"id {kind}, part string, mask int, h1 long, h2 long"))
    # only texts with two ids or more can have a copy with a smaller id
    copies = scratch.put(flags.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("final")).filter("final > first").select("h1", "h2", "first"))
    marks = scratch.put(labels.groupBy(F.col(key).alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
                        .filter("id is not null and (good or toxic)"))
    # left joins of narrow rows: Spark splits a hot text or id of the left side
    met = flags.join(copies, ["h1", "h2"], "left").join(marks, "id", "left")
    return scratch.put(met.select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("first"), 1 << 4).otherwise(0)).alias("mask"),
                                  F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")))


def posting_lists(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, n, fails, good, toxic): for each id range and part the sorted places of failing documents by filter, and of good and of toxic ones.

    The rows are sorted by id over all tasks. Their place in the stored table breaks ties, so rows that share an id are spread like others.
    """
    cuts = max(1, -(-rows.count() // (4 * RANGE_ROWS)))
    spread = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(cuts, "id", "place").sortWithinPartitions("id", "place")
    return scratch.put(spread.select("part", "mask", "good", "toxic").mapInArrow(_post, "part string, n long, fails array<array<int>>, good array<int>, toxic array<int>"))


def _chain() -> list[tuple]:
    """(order, step, filter, filters before as bits) for every order of the filters."""
    return [("".join(order), step + 1, FILTERS.index(f), sum(1 << FILTERS.index(x) for x in order[:step])) for order in permutations(FILTERS) for step, f in enumerate(order)]


def _orders_with(before: Column) -> Column:
    """In how many orders exactly the filters of ``before`` come ahead of a given other one."""
    n = len(FILTERS)
    out = F.lit(0)
    for k in range(n):
        out = F.when(F.bit_count(before) == k, factorial(k) * factorial(n - 1 - k)).otherwise(out)
    return out


def audit(docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """What five filters remove in each of their 120 orders, by part.

    A: under 200 words; B: under half of the words distinct; C: over 3 % capitals A-Z; D: holds one of #$%&*|; E: equal to the text of a smaller id anywhere in the table.
    Returns (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), counts as long, zeros included, for each part in ``docs``.

    Documents failing each filter are kept as sorted lists for each id range and part; unions of the lists of filters applied before, and differences of the next filter's
    list and such a union, are merged by galloping, and their sizes summed over the ranges. No list is longer than a range.

    A null text is empty, a null part the empty string (so both meet the rows that have these). Rows that share an id are documents of their own with the same labels; a null id is neither
    smaller nor larger than another and has no labels. If an id has several labels, it is good or toxic if any says so. Equal texts are told by 128-bit hashes. Further columns are not read.
    An empty table has no parts and so no rows.
    """
    lists = posting_lists(judged(docs, labels, scratch, key, text, part), scratch)
    merged = lists.mapInArrow(_merge, "part string, before int, filter int, n long, gone long, removed long, failing long, good long, toxic long")
    counts = scratch.put(merged.groupBy("part", "before", "filter").agg(*(F.sum(c).alias(c) for c in ("n", "gone", "removed", "failing", "good", "toxic"))))
    others = F.lit((1 << len(FILTERS)) - 1) - F.pow(F.lit(2.0), F.col("filter")).cast("int")
    by_filter = counts.groupBy("part", "filter").agg(F.sum(F.col("removed") * _orders_with(F.col("before"))).alias("shapley"),
                                                     F.sum(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"))
    chain = local_frame(docs.sparkSession, _chain(), "filter_order string, step int, filter int, before int")
    return counts.join(by_filter, ["part", "filter"]).join(F.broadcast(chain), ["before", "filter"]).select(
        "part", "filter_order", "step", (F.col("n") - F.col("gone") - F.col("removed")).alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
