"""Periodic runs of words: minima of windows repeat one period on, at every scale; short periods are scanned lag by lag."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import mix, sha256

DIRECT = 16  # periods up to this are found by comparing the words at each lag
CHUNK_BYTES = 2_000_000  # texts that are searched together
MIN_LENGTH, MIN_EXPONENT = 6, 4

Run = tuple[int, int, int]  # start, length, period


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of true of at least a length."""
    edges = np.flatnonzero(equal[1:] != equal[:-1]) + 1
    bounds = np.concatenate([[0], edges, [len(equal)]])
    first = 0 if len(equal) and equal[0] else 1
    starts, ends = bounds[first:-1:2], bounds[first + 1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def _divisors(q: int) -> list[int]:
    """q divided by each of its primes."""
    out, rest, r = [], q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            out.append(q // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return out


def _primitive(x: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether the words from start to end, of period q, have no smaller one. (At four periods a smaller one divides q.)"""
    return not any(np.array_equal(x[start:end - d], x[start + d:end]) for d in _divisors(q))


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values two arrays share; read in pieces that double."""
    at, step, n = 0, 64, min(len(a), len(b))
    while at < n:
        end = min(n, at + step)
        same = a[at:end] == b[at:end]
        if not same.all():
            return at + int(same.argmin())
        at, step = end, step * 2
    return n


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` values in a row; width is a power of two."""
    done = 1
    while done < width:
        values = pick(values[:-done], values[done:])
        done *= 2
    return values


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least hash of some window of ``width`` places."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = _slide(hashes, width, np.minimum)
    # the windows that hold a place start at most width - 1 before it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(_slide(padded, width, np.maximum) == hashes)


def find_runs(x: np.ndarray, lengths: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[Run]:
    """The maximal runs in texts of word numbers that stand one after another in ``x``, each text closed by a number of its own; ``lengths`` are those of the texts
    with that number. Starts count from the start of ``x``. ``min_exponent`` is 4 or more.

    A scale reads parts of k words, a power of two, for periods above k / 2 up to k. In a run of such a period equal parts lie whole periods apart, since a part is as long as a period;
    and a window of k / 2 places at the run's start has its least part one period on again. So the next place among the minimizers with the same hash is one period away, and
    extending that pair to both sides gives the run. A hash that is equal by chance only costs a comparison, as all words of a run are compared.
    """
    found: list[Run] = []

    def keep(words: np.ndarray, start: int, end: int, q: int, base) -> None:
        """start, end: of the places that equal the one q further on."""
        length = end + q - start
        if length >= max(min_length, min_exponent * q) and _primitive(words, start, end + q, q):
            found.append((int(base(start)), length, q))

    for q in range(1, min(DIRECT, int(lengths.max(initial=0)) // min_exponent) + 1):
        for start, end in _stretches(x[q:] == x[:-q], max(min_length, min_exponent * q) - q):
            keep(x, start, end, q, lambda place: place)

    offsets = np.cumsum(lengths) - lengths
    words, hashes, place, k = x, mix(x.astype(np.uint64) + np.uint64(1)), np.arange(len(x)), 1
    while True:
        n = len(words)
        if k >= n:
            break
        # the hash of twice as many words; past the end something that nothing equals
        tail = mix(np.arange(n - k, n, dtype=np.uint64) * np.uint64(2) + np.uint64(2**63 + 1))
        hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([hashes[k:], tail]))
        k *= 2
        if k <= DIRECT:
            continue
        long = lengths - 1 >= min_exponent * (k // 2 + 1)
        if not long.any():
            break
        if not long.all():  # only texts that can hold such a period go on
            stays = np.repeat(long, lengths)
            words, hashes, place = words[stays], hashes[stays], place[stays]
            offsets, lengths = offsets[long], lengths[long]
        at = minimizers(hashes, k // 2)
        order = np.argsort(hashes[at], kind="stable")
        at, value = at[order], hashes[at][order]
        gap = np.diff(at)
        pair = np.flatnonzero((value[1:] == value[:-1]) & (gap > k // 2) & (gap <= k))
        seeds = sorted(zip(gap[pair].tolist(), at[pair].tolist()))
        lag, done = 0, 0
        for q, m in seeds:
            if q != lag:
                lag, done = q, 0
            if m < done or words[m] != words[m + q]:
                continue
            end = m + _reach(words[m:], words[m + q:])
            start = m - _reach(words[:m][::-1], words[q:m + q][::-1])
            done = end
            keep(words, start, end, q, lambda p: place[p])
    return found


def runs_of(texts: list[list[bytes]], **least) -> list[list[Run]]:
    """The runs of each text, given as its words, by start and then period."""
    ids: dict[bytes, int] = {}
    for words in texts:
        for word in words:
            ids.setdefault(word, len(ids))
    lengths = np.array([len(words) + 1 for words in texts], np.int64)
    total = int(lengths.sum())
    x = np.empty(total, np.int64)
    offsets = np.cumsum(lengths) - lengths
    for i, (words, a) in enumerate(zip(texts, offsets.tolist())):
        x[a:a + len(words)] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        x[a + len(words)] = len(ids) + i
    out: list[list[Run]] = [[] for _ in texts]
    for start, length, q in find_runs(x, lengths, **least):
        i = int(np.searchsorted(offsets, start, "right")) - 1
        out[i].append((start - int(offsets[i]), length, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _scan(batches: Iterator[pa.RecordBatch], least: dict) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def done(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of(texts, **least)
        rest = [b" ".join(collapsed(words, runs)) for words, runs in zip(texts, found)]
        spans = [[{"start": a, "length": n, "period": q} for a, n, q in runs] for runs in found]
        lines = [sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()) for runs in found]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(spans, kind), pa.array(lines, pa.string()), pa.array(rest, pa.binary()).cast(pa.string())],
                                          names=["id", "runs", "runs_sha256", "collapsed"])
    for batch in batches:
        ids, texts, size, start = [], [], 0, 0
        for i, text in enumerate(batch.column("text").to_pylist()):
            texts.append(text.split() if text else [])
            size += len(text or b"")
            if size >= CHUNK_BYTES:
                yield done([batch.column("id").slice(start, i + 1 - start)], texts)
                texts, size, start = [], 0, i + 1
        if texts:
            yield done([batch.column("id").slice(start)], texts)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(key, runs, runs_sha256, collapsed) for each row of ``docs``: the maximal stretches of words that repeat with a smallest period q over at least ``min_exponent`` periods
    (4 or more) and ``min_length`` words, as structs of start (number of the first word, from 0), length and period, by start and then period; a digest of them as lines
    "start,length,period"; and the text's other words, and of each run the first q, joined by one space.

    Words are what stands between ASCII white space. Null and empty texts have no words and no runs. Each text is searched as a whole by itself, so nothing is shuffled and every row gives one
    row, rows that share an id too; a null id is an id; further columns are not read; an empty table gives an empty table. A task holds a few texts at a time; a long one takes
    some 200 bytes a word.
    """
    least = {"min_length": min_length, "min_exponent": min_exponent}
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _scan(it, least), f"id {kind}, runs array<struct<start:long,length:long,period:long>>, runs_sha256 string, collapsed string").withColumnRenamed("id", key)
