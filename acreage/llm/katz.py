"""Katz backoff word bigrams with Good-Turing discounts, counted and looked up block by block."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import Scratch, WordHashes, joined, lower_words, pack, squeeze, unpack, unsqueeze

BLOCK_TOKENS, BUCKET_GRAMS = 1_000_000, 1_000_000
ADD, KATZ_LIMIT = 0.1, 5
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)  # stand for no word; a word's hash meets them only by a 64-bit chance
WORDS, PAIRS, TOTALS = 1, 2, -1

_BLOCKS = "n long, ids array<long>, ends binary, vocabulary binary, tokens binary"
_COUNTS = "kind int, bucket long, block long, grams binary, trained binary, unseen binary"
_TOLD = "kind int, bucket long, block long, counts binary, flags binary, totals array<long>"
_SCORED = ("kind int, block long, doc int, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
           "history long, discounted double, covered double, backoffs long")


def held_out(name: int | None) -> bool:
    return zlib.crc32(b"" if name is None else str(name).encode()) % 10 == 0


def discounts(n: list[int], limit: int = KATZ_LIMIT) -> np.ndarray:
    """d_r for r = 0 .. limit from n_1 .. n_(limit+1): Good-Turing as Katz scales it. Where these counts of counts give no ratio
    between 0 and 1 (small or artificial corpora), absolute discounting takes its place."""
    n = [0, *n]
    r = np.arange(1, limit + 1)
    if all(n[1:]):
        a = (limit + 1) * n[limit + 1] / n[1]
        d = np.array([((i + 1) * n[i + 1] / n[i] / i - a) / (1 - a) if a != 1 else 0 for i in r])
        if (d > 0).all() and (d < 1).all():
            return np.append(0, d)
    cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.append(0, (r - cut) / r)


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts less their discount; above the limit the absolute discount at the limit goes on, so that every history keeps mass for the unseen."""
    limit = len(d) - 1
    return np.where(counts <= limit, counts * d[np.minimum(counts, limit)], counts - limit * (1 - d[limit]))


def _pack_blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Whole documents in blocks: ids, where each ends, the block's words and each token's place among them."""
    cache = WordHashes()
    hashes: list[np.ndarray] = []
    names: list = []

    def block() -> pa.RecordBatch:
        vocabulary, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([len(tokens)], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([np.cumsum([len(h) for h in hashes], dtype=np.int64).tobytes()], pa.binary()),
             pa.array([pack(vocabulary)], pa.binary()), pa.array([squeeze(tokens.astype(np.uint32))], pa.binary())], names=["n", "ids", "ends", "vocabulary", "tokens"])

    number = 0
    for batch in batches:
        for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            hashes.append(np.append(cache.of(lower_words(text)), END))
            names.append(name)
            number += len(hashes[-1])
            if number >= block_tokens:
                yield block()
                hashes, names, number = [], [], 0
    if names:
        yield block()


class Block:
    """One block read back, with its distinct pairs of a word and the one before."""

    def __init__(self, ids, ends: bytes, vocabulary: bytes, tokens: bytes):
        self.ids, self.ends = list(ids), np.frombuffer(ends, np.int64)
        self.words, self.tokens = unpack(vocabulary), unsqueeze(tokens, np.uint32)
        self.starts = np.append(0, self.ends[:-1])
        self.doc = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)
        self.held = np.array([held_out(None if n is None or n != n else int(n)) for n in self.ids], bool)
        self.before = np.append(0, self.tokens[:-1])
        self.before[self.starts] = len(self.words)  # START comes after the words
        self.histories = np.append(self.words, START)
        self.grams, self.first, self.gram = np.unique(joined([self.histories[self.before], self.words[self.tokens]]), return_index=True, return_inverse=True)

    def counts(self, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each place occurs in training documents, and whether in held-out ones."""
        held = self.held[self.doc]
        return np.bincount(places[~held], minlength=size), np.bincount(places[held], minlength=size) > 0


def _slices(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bounds of the 2^bits buckets, which are ranges of the hash."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def _count(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["ids"], row["ends"], row["vocabulary"], row["tokens"])
            for kind, grams, places in ((WORDS, block.words, block.tokens), (PAIRS, block.grams, block.gram)):
                trained, unseen = block.counts(places, len(grams))
                at = _slices(grams, bits)
                full = np.flatnonzero(np.diff(at)).tolist()
                parts = [(pack(grams[at[b]:at[b + 1]]), squeeze(trained[at[b]:at[b + 1]]), squeeze(unseen[at[b]:at[b + 1]])) for b in full]
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([kind] * len(full), pa.int32()), "bucket": pa.array(full, pa.int64()), "block": pa.array([row["block"]] * len(full), pa.int64()),
                    **{name: pa.array([p[i] for p in parts], pa.binary()) for i, name in enumerate(("grams", "trained", "unseen"))}})


def _merge(part: pd.DataFrame, limit: int) -> pd.DataFrame:
    """All blocks' counts of one bucket added up. Each block is told, in the order of its own grams, the sums and one flag: for words, that a held-out
    document has it; for pairs, that this block (the first that has it) answers for it."""
    part = part.sort_values("block", ignore_index=True)
    kind, bucket = int(part["kind"].iat[0]), int(part["bucket"].iat[0])
    grams = [unpack(x) for x in part["grams"]]
    every, first, place = np.unique(np.concatenate(grams), return_index=True, return_inverse=True)
    trained = np.zeros(len(every), np.int64)
    np.add.at(trained, place, np.concatenate([unsqueeze(x, np.int64) for x in part["trained"]]))
    if kind == WORDS:
        flag = np.zeros(len(every), bool)
        np.logical_or.at(flag, place, np.concatenate([unsqueeze(x, bool) for x in part["unseen"]]))
        flags, totals = flag[place], [int(trained.sum()), int((trained > 0).sum())]
    else:
        flags, totals = np.zeros(len(place), bool), np.bincount(np.minimum(trained, limit + 2), minlength=limit + 3)[1:limit + 2].tolist()
        flags[first] = True
    ends = np.cumsum([len(g) for g in grams])
    rows = [(kind, bucket, int(b), squeeze(trained[place[e - len(g):e]]), squeeze(flags[e - len(g):e]), None) for b, g, e in zip(part["block"], grams, ends)]
    return pd.DataFrame([*rows, (kind, bucket, TOTALS, None, None, totals)], columns=["kind", "bucket", "block", "counts", "flags", "totals"])


def _score(blocks: pd.DataFrame, told: pd.DataFrame, n: int, v: int, d: np.ndarray, starts: int) -> pd.DataFrame:
    """Three kinds of rows: 0 documents, scored but for backoff weights; 1 what the seen pairs of a history take, from
    the pairs this block answers for; 2 how often a document backs off from a history."""
    row = blocks.iloc[0]
    block = Block(row["ids"], row["ends"], row["vocabulary"], row["tokens"])
    told = told.sort_values("bucket")
    def column(which: int, name: str, kind) -> np.ndarray:
        return np.concatenate([unsqueeze(x, kind) for x in told.loc[told["kind"] == which, name]])

    c1, needed = column(WORDS, "counts", np.int64), column(WORDS, "flags", bool)
    c2, owner = column(PAIRS, "counts", np.int64), column(PAIRS, "flags", bool)
    p1 = (c1 + ADD) / (n + ADD * (v + 1))
    after = np.append(c1, starts)  # how often a history was seen
    needed = np.append(needed, True)
    before, word = block.before[block.first], block.tokens[block.first]  # of each distinct pair
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.where(c2 > 0, np.log10(discounted(c2, d) / after[before]), np.log10(p1[word]))
    size = len(block.ends)
    out = [pd.DataFrame({
        "kind": 0, "doc": np.arange(size), "id": pd.array([None if x is None or x != x else int(x) for x in block.ids], "Int64"), "held_out": block.held,
        "n_tokens": block.ends - block.starts, "n_known": np.bincount(block.doc, c1[block.tokens] > 0, size).astype(np.int64),
        "base_score": np.bincount(block.doc, np.log10(p1)[block.tokens], size), "score": np.bincount(block.doc, step[block.gram], size)})]
    mine = owner & (c2 > 0) & needed[before]
    m = len(block.histories)
    taken, covered = np.bincount(before[mine], discounted(c2[mine], d) / after[before[mine]], m), np.bincount(before[mine], p1[word[mine]], m)
    at = np.flatnonzero(taken)
    out.append(pd.DataFrame({"kind": 1, "history": block.histories[at].view(np.int64), "discounted": taken[at], "covered": covered[at]}))
    back = (c2[block.gram] == 0) & (after[block.before] > 0)
    pairs, often = np.unique(block.doc[back] * m + block.before[back], return_counts=True)
    out.append(pd.DataFrame({"kind": 2, "doc": pairs // m, "history": block.histories[pairs % m].view(np.int64), "backoffs": often}))
    found = pd.concat([x for x in out if len(x)], ignore_index=True)
    found["block"] = int(row["block"])
    whole = {c: pd.array(found[c], "Int64") for c in ("doc", "id", "n_tokens", "n_known", "history", "backoffs") if c in found}
    return found.assign(**whole).reindex(columns=[x.split()[0] for x in _SCORED.split(", ")])


def katz_scores(docs: DataFrame, scratch: Scratch, limit: int = KATZ_LIMIT, block_tokens: int = BLOCK_TOKENS, bucket_grams: int = BUCKET_GRAMS,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Tokens are the text's words (runs of other than ASCII white space, A-Z in lower case) and one end. Documents whose crc32(id as text) mod 10 is 0 are held out;
    the rest trains. base_score adds log10 of the word probabilities (c + 0.1) / (N + 0.1 (V + 1)). score is the bigram model's log10 probability:

        P(w | h) = d(c(h w)) c(h w) / c(h)  if the pair was seen in training,  else  a(h) P(w),   and P(w) for a history never seen

    with Good-Turing discounts d (Katz, up to ``limit``) and a(h) = (1 - seen P(w | h)) / (1 - seen P(w)), so each history's probabilities sum to 1. The history of the first
    token is the start. Null and empty texts are the end alone; a null id counts as the empty id, which is held out; rows that share an id are documents
    of their own; further columns are not read; an empty table gives an empty table.

    Documents are packed into blocks of about ``block_tokens`` tokens. Each block adds up its own grams and sends them in ranges of the hash; one
    task adds up a range of about ``bucket_grams`` grams (a gram has one entry for each block that has it) and tells each block the sums of its own grams. Tables are stored by kind, range and block.
    What a history's seen pairs take is added up by history, from each pair once. No vocabulary or model is broadcast or held whole.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    blocks = scratch.put(rows.mapInArrow(lambda it: _pack_blocks(it, block_tokens), _BLOCKS).withColumn("block", F.monotonically_increasing_id()))
    size = blocks.agg(F.sum("n")).first()[0] or 0
    bits = int(np.ceil(np.log2(max(1, size / bucket_grams))))
    counts = blocks.mapInArrow(lambda it: _count(it, bits), _COUNTS)
    told = scratch.put(counts.groupBy("kind", "bucket").applyInPandas(lambda part: _merge(part, limit), _TOLD))
    totals = told.filter(F.col("block") == TOTALS).select("kind", F.posexplode("totals")).groupBy("kind", "pos").agg(F.sum("col").alias("n")).collect()
    known = {(r["kind"], r["pos"]): r["n"] for r in totals}
    n, v = known.get((WORDS, 0), 0), known.get((WORDS, 1), 0)
    d = discounts([known.get((PAIRS, i), 0) for i in range(limit + 1)], limit)
    starts = docs.filter(F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(10)) != 0).count()
    scored = scratch.put(blocks.groupBy("block").cogroup(told.filter(F.col("block") != TOTALS).drop("totals").groupBy("block"))
                         .applyInPandas(lambda b, t: _score(b, t, n, v, d, starts), _SCORED))
    scratch.drop(blocks)
    scratch.drop(told)
    weights = scratch.put(scored.filter("kind = 1").groupBy("history").agg(
        F.log10((1 - F.sum("discounted")) / (1 - F.sum("covered"))).alias("weight")))
    backs = scored.filter("kind = 2").select("block", "doc", "history", "backoffs").join(weights, "history") \
        .groupBy("block", "doc").agg(F.sum(F.col("backoffs") * F.col("weight")).alias("back"))
    return scored.filter("kind = 0").select("block", "doc", "id", "held_out", "n_tokens", "n_known", "base_score", "score").join(backs, ["block", "doc"], "left").select(
        F.col("id").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("back", F.lit(0.0))).alias("score"))
