"""Long repeated byte strings, found in run-length compressed Burrows-Wheeler indexes of the places that may repeat."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import Scratch, mix, sha256, text_key

LENGTH, ANCHOR = 200, 32
# Contexts of one anchor that an index takes, as many as fill a part of INDEX_BYTES; the windows of a more frequent anchor's contexts are counted by their hashes
HOT_CONTEXTS = 8_000
INDEX_BYTES = 2_000_000
BETWEEN, LAST = 0xFE, 0xFF  # bytes that UTF-8 never has

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = "id long, text_key long, anchor long, context long, start long, size int"


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Prefixes:
    """Hashes of any substring of one text, from prefix sums modulo 2^64."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, text: np.ndarray):
        n = len(text) + 1
        if len(Prefixes.powers) < n:
            room = max(n, 1 << 16)
            Prefixes.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(room, _BASE)]), dtype=np.uint64)
            Prefixes.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(room, np.uint64(_inverse(int(_BASE))))]), dtype=np.uint64)
        scattered = mix(text.astype(np.uint64) + np.uint64(1))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(scattered * Prefixes.powers[:n - 1], dtype=np.uint64)])

    def of(self, starts: np.ndarray, sizes) -> np.ndarray:
        return mix((self.sums[starts + sizes] - self.sums[starts]) * Prefixes.inverses[starts] + np.uint64(7))


def anchors(prefixes: Prefixes, n: int, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of each anchor, the last smallest hash of ``width`` bytes in a window of ``length`` bytes.

    Which anchor a window has depends on its bytes alone, so equal windows meet at equal anchors; each window has one.
    """
    hashes = prefixes.of(np.arange(n - width + 1), width)
    span = length - width + 1
    # smallest of each run of ``span``: the suffix minimum of one part and the prefix minimum of the next; ties go to the later place
    room = -(-len(hashes) // span) * span
    place = np.arange(room, dtype=np.int64)
    padded = np.full(room, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(hashes)] = hashes
    parts = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(parts, axis=1)
    back = np.minimum.accumulate(parts[:, ::-1], axis=1)[:, ::-1]
    new = np.ones(parts.shape, bool)
    new[:, 1:] = parts[:, 1:] <= ahead[:, :-1]
    ahead_at = np.maximum.accumulate(np.where(new, place.reshape(-1, span), -1), axis=1).ravel()
    new = np.ones(parts.shape, bool)
    new[:, :-1] = parts[:, :-1] < back[:, 1:]
    back_at = np.minimum.accumulate(np.where(new, place.reshape(-1, span), room)[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.arange(n - length + 1)
    last = first + span - 1
    at = np.where(ahead.ravel()[last] <= back.ravel()[first], ahead_at[last], back_at[first])
    turn = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return at[turn], turn, np.append(turn[1:], len(at)) - 1


def _find_places(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """For each anchor its hash, and the context: the bytes of all windows that have it."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for name, key, text in zip(*(batch.column(x).to_pylist() for x in ("id", "text_key", "text"))):
            if text is None or len(text) < length:
                continue
            prefixes = Prefixes(np.frombuffer(text, np.uint8))
            at, first, last = anchors(prefixes, len(text), length, width)
            sizes = last - first + length
            out[2].append(prefixes.of(at, width).view(np.int64))
            out[3].append((prefixes.of(first, sizes) ^ mix((at - first).astype(np.uint64))).view(np.int64))
            out[4].append(first)
            out[5].append(sizes)
            out[0].append(pa.repeat(pa.scalar(name, pa.int64()), len(at)))
            out[1].append(np.full(len(at), key, np.int64))
        if out[2]:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(out[0]), *(pa.array(np.concatenate(x), t) for x, t in zip(out[1:], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())))],
                                             names=["id", "text_key", "anchor", "context", "start", "size"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(c, a, text[s:s + n]) for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist())
               for c, a, s, n in ((p["context"], p["anchor"], p["start"], p["size"]) for p in places)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["context", "anchor", "bytes"])


def eight_bytes(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes, round the end, as one number."""
    n = len(text)
    wrapped = np.resize(text, n + 8).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for i in range(8):
        keys = (keys << np.uint64(8)) | wrapped[i:i + n]
    return keys


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start places of all rotations of ``text`` in their order, by doubling; one byte value stands there only once."""
    n, keys, depth = len(text), eight_bytes(text), 8
    while True:
        order = np.argsort(keys)
        rank = np.empty(n, np.uint64)
        sorted_keys = keys[order]
        ranks = np.cumsum(np.append(0, sorted_keys[1:] != sorted_keys[:-1]))
        rank[order] = ranks
        if ranks[-1] == n - 1 or depth >= n:
            return order
        keys = (rank << np.uint64(32)) | np.roll(rank, -depth)
        depth *= 2


def match_lengths(text: np.ndarray) -> np.ndarray:
    """For each place, how many bytes it shares with the place whose rotation is most alike, from a run-length index.

    The Burrows-Wheeler transform is cut into runs. Only at the ends of runs are a rotation and its neighbour compared; inside a run the neighbours' predecessors are
    neighbours too and share one byte more. So matching lengths stream along the text: one less for each place after a sampled one.
    """
    n = len(text)
    order = suffix_order(text)
    before = text[order - 1]
    change = before[1:] != before[:-1]
    best = np.zeros(n, np.int64)
    words = eight_bytes(text)
    for ends, other in ((np.append(True, change), -1), (np.append(change, True), 1)):
        at = np.flatnonzero(ends)
        neighbour = at + other
        here, there = order[at], order[np.clip(neighbour, 0, n - 1)]
        shared = np.zeros(len(at), np.int64)
        open_ = np.flatnonzero((neighbour >= 0) & (neighbour < n))
        step = 0
        while len(open_):
            differ = words[(here[open_] + step) % n] ^ words[(there[open_] + step) % n]
            shared[open_] += sum((differ < np.uint64(1) << np.uint64(8 * i)).astype(np.int64) for i in range(8))
            open_ = open_[(differ == 0) & (shared[open_] < n)]
            step += 8
        sampled = np.full(n, -1, np.int64)
        sampled[here] = here
        last = np.maximum.accumulate(sampled)  # the place after the last byte, place 0, is always sampled: that byte stands alone
        value = np.zeros(n, np.int64)
        value[here] = shared
        best = np.maximum(best, value[last] - (np.arange(n) - last))
    return best


def _paired(names: np.ndarray, contexts: list[bytes], length: int, width: int) -> np.ndarray:
    """Which contexts may have a window in common with another of their anchor: equal windows have equal bytes on the longer side of it, at least half of what surrounds it.

    The anchor is the last place of a context that has its hash: a later one would be the anchor of the last window.
    """
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    prefixes, at = Prefixes(text), np.full(len(contexts), -1)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    hashes = prefixes.of(np.arange(len(text) - width + 1), width).view(np.int64)
    equal = np.flatnonzero((hashes == names[owner[:len(hashes)]]) & (owner[:len(hashes)] == owner[width - 1:]))
    np.maximum.at(at, owner[equal], equal)
    half = (length - width + 1) // 2
    paired = at < 0
    for start in (at - half, at):
        inside = np.flatnonzero((at >= 0) & (start >= ends - sizes) & (start + half + width <= ends))
        _, which, times = np.unique(prefixes.of(start[inside], half + width), return_inverse=True, return_counts=True)
        paired[inside[times[which] > 1]] = True
    return paired


def _index(part: pd.DataFrame, length: int, width: int) -> pd.DataFrame:
    """Windows of each context that stand elsewhere in the part: merged (start, end) of their bytes."""
    part = part[_paired(part["anchor"].to_numpy(), part["bytes"].to_list(), length, width)]
    if part.empty:
        return pd.DataFrame([], columns=["anchor", "context", "runs"])
    contexts = part["bytes"].to_list()
    text = np.frombuffer(bytes([BETWEEN]).join(contexts) + bytes([BETWEEN, LAST]), np.uint8)
    best, out, at = match_lengths(text), [], 0
    for anchor, name, context in zip(part["anchor"], part["context"], contexts):
        starts = np.flatnonzero(best[at:at + len(context) - length + 1] >= length)
        if len(starts):
            out.append((anchor, name, _merged(starts, length)))
        at += len(context) + 1
    return pd.DataFrame(out, columns=["anchor", "context", "runs"])


def _merged(starts: np.ndarray, length: int) -> list[dict]:
    """Ascending window starts as covered byte runs."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return [{"a": int(a), "b": int(b) + length} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)])]


def _window_hashes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for anchor, name, text in zip(*(batch.column(x).to_pylist() for x in ("anchor", "context", "bytes"))):
            raw = np.frombuffer(text, np.uint8)
            starts = np.arange(len(raw) - length + 1)
            columns = (np.full(len(starts), anchor), np.full(len(starts), name), starts, Prefixes(raw).of(starts, length).view(np.int64),
                       Prefixes(raw ^ 0x5A).of(starts, length).view(np.int64))
            for held, column in zip(out, columns):
                held.append(column)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["anchor", "context", "place", "h1", "h2"])


def _take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, spans, digests, kept = [], [], [], [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
            text, merged = text or b"", []
            for run in sorted(((r["a"], r["b"]) for r in runs or ())):
                if merged and run[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], run[1])
                else:
                    merged.append(list(run))
            edges = [0, *(x for run in merged for x in run), len(text)]
            rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            n.append(len(text))
            removed.append(len(text) - len(rest))
            spans.append([{"a": a, "b": b} for a, b in merged])
            digests.append(sha256(rest))
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                                          pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, width: int = ANCHOR, hot: int = HOT_CONTEXTS, index_bytes: int = INDEX_BYTES, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept_sha256, kept): each text's UTF-8 bytes without those covered by a string of ``length`` bytes that also starts elsewhere.

    Elsewhere is any other place, in the same text too; strings never cross texts and are judged on the input. spans are the removed runs (a, b),
    end exclusive; kept are the remaining bytes. Null and empty texts have no bytes. Rows that share an id are texts of their own, and equal rows repeat each other; a null
    id is an id; further columns are not read; an empty table gives an empty table.

    1. Each window of ``length`` bytes has an anchor, the smallest hash of ``width`` bytes in it. Equal windows have equal anchors, so only contexts (the bytes of the
       windows that share an anchor) of an anchor met twice can repeat. Contexts met twice repeat as a whole; of each different context of an anchor, one copy is cut out of its text.
    2. The contexts go by anchor into parts of about ``index_bytes``. Those that share neither half around the anchor with another context have no window in common with one
       and are left out, by an exact condition; what is left of each part gets a run-length compressed Burrows-Wheeler transform, compared at its
       run ends only; matching lengths stream along the part and mark windows met elsewhere.
    3. An anchor with more than ``hot`` different contexts would fill one part: the hashes (128 bits) of its contexts' windows are counted instead.
    4. The runs go back to all places of the context and are cut out of the texts.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), text_key(F.col(text)).alias("text_key"), F.col(text).cast("binary").alias("text"))
    places = scratch.put(rows.mapInArrow(lambda it: _find_places(it, length, width), _PLACES))
    contexts = places.groupBy("anchor", "context").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("id", "text_key", "start", "size")))
    found = scratch.put(contexts)  # any of a context's places will do, and now it stays the same
    many = scratch.put(found.groupBy("anchor").agg(F.count("*").alias("contexts"), F.sum("n").alias("places")).filter("places > 1").drop("places"))
    live = scratch.put(found.join(many, "anchor"))
    # whole contexts that stand at two places need no look at their bytes
    whole = live.filter("n > 1").select("anchor", "context", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").cast("long").alias("b"))).alias("runs"))
    wanted = live.filter("contexts > 1").groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_list(F.struct("context", "anchor", "start", "size")).alias("places"))
    # the merge hints keep one plan for every size
    cut = rows.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key"))).select("text", "places") \
        .mapInArrow(_cut, "context long, anchor long, bytes binary")
    pieces = scratch.put(cut.join(many.filter("contexts > 1"), "anchor").dropDuplicates(["anchor", "context"]))
    size = pieces.filter(F.col("contexts") <= hot).agg(F.sum(F.length("bytes"))).first()[0] or 0
    parts = int(size // index_bytes) + 1
    indexed = pieces.filter(F.col("contexts") <= hot).withColumn("part", F.pmod(F.xxhash64("anchor"), F.lit(parts))) \
        .groupBy("part").applyInPandas(lambda p: _index(p, length, width), "anchor long, context long, runs array<struct<a:long,b:long>>")
    windows = pieces.filter(F.col("contexts") > hot).select("anchor", "context", "bytes").mapInArrow(
        lambda it: _window_hashes(it, length), "anchor long, context long, place long, h1 long, h2 long")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    counted = windows.join(scratch.put(twice), ["h1", "h2"]).groupBy("anchor", "context").agg(
        F.collect_set(F.struct(F.col("place").alias("a"), (F.col("place") + length).alias("b"))).alias("runs"))
    marked = scratch.put(whole.unionAll(indexed).unionAll(counted))
    runs = places.select("id", "text_key", "anchor", "context", "start").join(marked, ["anchor", "context"]).select("id", "text_key", F.explode(F.transform(
        "runs", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))).alias("run"))
    spans = runs.groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set("run").alias("runs"))
    return rows.join(spans.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & F.col("text_key").eqNullSafe(F.col("_key")), "left").select("id", "text", "runs") \
        .mapInArrow(_take_out, "id long, n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept_sha256 string, kept binary").withColumnRenamed("id", key)
