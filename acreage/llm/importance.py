"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acreage.llm.common import Scratch, apart, joined, with_columns

BUCKETS = 1 << 17  # half for words, half for pairs of words
PRIOR, ERRORS, PLAIN = 2.0, 3.0, 0.5
TEMPERATURE = 0.02
BINS = 4000
LOSS = 5.0  # losing a target document counts as much as keeping so many others, in shares
_TOKENS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


class _Cache(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def grams(text: bytes | None, cache: dict) -> np.ndarray:
    """Bucket of each word or run of signs, and of each two in a row. Case stays: shouting is a trait."""
    words = _TOKENS.findall(text) if text else []
    one = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    half = np.uint64(BUCKETS // 2)
    two = joined([one[:-1], one[1:]]) % half + half if len(one) > 1 else one[:0]
    return np.concatenate([one % half, two]).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, raw, target = _Cache(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist()):
            found = np.unique(grams(text, cache))  # a document counts once, or one that repeats itself would make its words suspect
            raw[found] += 1
            if good:
                target[found] += 1
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at], pa.int64()), pa.array(target[at], pa.int64())], names=["bucket", "raw", "target"])


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log of the target model over the raw model for each bucket, less its median over target text, so that ordinary text weighs nothing.

    Both models are smoothed by ``PRIOR`` counts in proportion to the raw model. The ratio is shrunk by ``ERRORS`` times its sampling error, and by
    ``PLAIN`` at least: a rare word says nothing, whether or not it happens to stand in a labelled document, nor does a small difference, which
    long texts would add up.
    """
    out = np.zeros(len(raw))
    for half in (slice(0, BUCKETS // 2), slice(BUCKETS // 2, BUCKETS)):
        r, t = raw[half].astype(float), target[half].astype(float)
        if not r.sum() or not t.sum():
            continue
        expected = r * (t.sum() / r.sum())
        ratio = np.log((t + PRIOR) / (expected + PRIOR))
        order = np.argsort(ratio, kind="stable")
        middle = order[np.searchsorted(np.cumsum(t[order]), t.sum() / 2)]
        ratio -= ratio[middle]
        out[half] = np.sign(ratio) * np.maximum(0, np.abs(ratio) - np.maximum(PLAIN, ERRORS / np.sqrt(expected + 1)))
    return out


def _scored(docs: DataFrame, ratios, temperature: float, key: str, text: str) -> DataFrame:
    """``docs`` with _n_grams, _log_weight and _sample_key; the latter two are null without grams."""
    def score():
        table, cache = ratios.value, _Cache()

        def batch_scores(batch: pa.RecordBatch) -> list[pa.Array]:
            n, scores = [], []
            for one in batch.column(text).cast(pa.binary()).to_pylist():
                found = grams(one, cache)
                n.append(len(found))
                scores.append(float(table[found].sum() / np.sqrt(len(found))) if len(found) else None)
            return [pa.array(n, pa.int64()), pa.array(scores, pa.float64())]
        return batch_scores
    out = with_columns(docs, StructType().add("_n_grams", "long").add("_log_weight", "double"), score)
    uniform = (F.xxhash64(key, text, F.lit(3)).cast("double") / 2.0**64 + 0.5) * (1 - 2.0**-40) + 2.0**-41
    return out.withColumn("_sample_key", F.col("_log_weight") / temperature - F.log(-F.log(uniform)))


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The ``k``-th largest of a column of finite doubles; null if there are fewer, or k is 0.

    Counts in 65,536 equal parts of the range show the part that holds it; that part is divided again until one value is left.
    """
    frame = values.select(F.col(column).alias("x")).filter("x is not null")
    while True:
        low, high, n = frame.agg(F.min("x"), F.max("x"), F.count("*")).first()
        if k <= 0 or k > n:
            return None
        if low == high or k == 1 or k == n:
            return low if k == n else high
        width = (high - low) / 65_536
        place = F.least(F.floor((F.col("x") - low) / width), F.lit(65_535)) if width > 0 else F.when(F.col("x") == high, 1).otherwise(0)
        for row in sorted(frame.groupBy(place.alias("p")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["p"]):
            if row["n"] >= k:
                frame = frame.filter(place == row["p"])
                break
            k -= row["n"]


@apart
def resample(docs: DataFrame, labels: DataFrame, scratch: Scratch, temperature: float = TEMPERATURE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with _n_grams, _log_weight, _sample_key and _kept: which documents resemble the target text.

    Target text are the documents labelled quality 1 and toxic 0 (if an id has several labels, the lower quality and the higher toxicity count; a null is neither);
    raw text are all documents. Words, runs of signs and pairs of them are hashed into 2^17 buckets; over all documents it is counted
    how many have each. A document's weight is the sum of its buckets' log ratios, divided by the root of its number of grams, so that lengths compare.

    The sample takes k documents with the largest weight / ``temperature`` + Gumbel noise, which draws without replacement in proportion to
    exp(weight / temperature). The noise is a hash of the id and the text: reruns agree. k is the number of documents above the weight
    that separates target from other labelled documents with the least loss, see LOSS. The k-th largest key is found by counting.

    Texts without grams (null, empty, white space) have no weight and are not kept. Without target labels, or with target labels only, nothing tells texts apart, and all with a
    weight are kept. A null id has no label. Rows that share an id are documents of their own with the same label; equal rows share their fate. Further columns pass through;
    an empty table gives an empty table. The counts (at most 2^17 rows) pass the driver and are broadcast, nothing else is; texts are shuffled
    once, to meet their labels, and then scored where they are read.
    """
    marks = scratch.put(labels.groupBy(F.col(key).alias("_id")).agg((F.coalesce(F.min("quality"), F.lit(0)) == 1).alias("q"), F.coalesce(F.max("toxic") == 0, F.lit(False)).alias("t"))
                        .filter("_id is not null").select("_id", (F.col("q") & F.col("t")).alias("target")))
    # the merge hint keeps one plan for every size
    met = docs.select(F.col(key).alias("_id"), F.col(text).cast("binary").alias("text")).join(marks.hint("merge"), "_id", "left").select("text", "target")
    found = met.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    scored = _scored(docs, docs.sparkSession.sparkContext.broadcast(log_ratios(raw, target)), temperature, key, text)
    weights = scratch.put(scored.filter("_log_weight is not null").select(F.col(key).alias("_id"), "_log_weight", "_sample_key"))
    edge = _separating(weights.join(marks, "_id"))
    k = weights.count() if edge is None else weights.filter(F.col("_log_weight") >= edge).count()
    least = kth_largest(weights, "_sample_key", k)
    return scored.withColumn("_kept", F.coalesce(F.col("_sample_key") >= F.lit(least).cast("double"), F.lit(False)))


def _separating(labelled: DataFrame) -> float | None:
    """The weight between target and other documents with the least loss, errors of each kind in shares of its own size; null if one kind is missing."""
    squashed = F.col("_log_weight") / (1 + F.abs("_log_weight"))  # -1 .. 1, finest near 0
    counts = labelled.groupBy(F.floor((squashed + 1) * (BINS / 2)).cast("int").alias("bin"), "target").agg(F.count("*").alias("n")).collect()
    hist = {good: np.bincount([r["bin"] for r in counts if r["target"] == good], [r["n"] for r in counts if r["target"] == good], BINS + 2) for good in (True, False)}
    if not hist[True].sum() or not hist[False].sum():
        return None
    below = {good: np.append(0, np.cumsum(h)) / h.sum() for good, h in hist.items()}
    wrong = LOSS * below[True] + 1 - below[False]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    s = float(best[len(best) // 2]) / (BINS / 2) - 1
    return s / (1 - abs(s)) if abs(s) < 1 else float("-inf")
