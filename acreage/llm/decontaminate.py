"""Benchmark passages found in training text by broadcast sets of word windows, of bounded size each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from acreage.llm.common import apart, joined, with_columns

WINDOW = 13
# Windows that one broadcast holds at most (some 30 bytes each, and their distinct words); a larger benchmark is scanned for part by part
PART_WINDOWS = 1_000_000
# Windows of a piece of an item. Longer words are known by a cryptographic hash
PIECE_WINDOWS, LONG_WORD = 1_024, 64

# bytes of words stay (A-Z in lower case), all other ASCII bytes become blanks; bytes beyond ASCII belong to words
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_ADDED = StructType().add("_n_words", "long").add("_spans", ArrayType(StructType().add("start", "long").add("end", "long"))).add("_items", ArrayType(StringType()))


def words_of(text: bytes | None) -> list[bytes]:
    """Words in order; those over 64 bytes as a zero byte, which no word has, and their SHA-256."""
    words = text.translate(_WORDS).split() if text else []
    return [w if len(w) <= LONG_WORD else b"\0" + hashlib.sha256(w).digest() for w in words]


class Windows:
    """The windows of a part of a benchmark: numbers of words, the texts of its pieces as one row of word numbers, and for each window length the sorted window hashes, with the place and the item of each."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in pieces})
        number = {name: i for i, name in enumerate(self.names)}
        ids = [np.fromiter((self.numbers.setdefault(w, len(self.numbers) + 1) for w in words), np.uint64, len(words)) for _, words in pieces]
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
        ends = np.cumsum([0] + [len(x) for x in ids])
        found: dict[int, list] = {}
        for (name, _), start, row in zip(pieces, ends, ids):
            n = min(window, len(row))
            if n:
                count = len(row) - n + 1
                found.setdefault(n, []).append((np.arange(start, start + count), np.full(count, number[name])))
        self.by_length = {}
        for n, parts in found.items():
            at, item = (np.concatenate(x) for x in zip(*parts))
            hashes = joined([self.ids[at + i] for i in range(n)])
            order = np.lexsort((item, hashes))
            hashes, at, item = hashes[order], at[order], item[order]
            # a window that an item holds again is kept once
            again = np.zeros(len(at), bool)
            again[1:] = (hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])
            for i in range(n):
                again[1:] &= self.ids[at[1:] + i] == self.ids[at[:-1] + i]
            self.by_length[n] = (hashes[~again], at[~again].astype(np.int32), item[~again].astype(np.int32))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, frozenset]]:
        """(start, length, items) of each window found in the word numbers; 0 is a word that no item has, or the end of a text. Equal windows share one set of items."""
        if not len(ids):
            return
        upto = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (hashes, at, item) in self.by_length.items():
            starts = np.flatnonzero(upto[n:] == upto[:-n]) if len(ids) >= n else ids[:0].astype(np.int64)
            if not len(starts):
                continue
            found = joined([ids[starts + i] for i in range(n)])
            first = np.searchsorted(hashes, found)
            known: dict[bytes, frozenset] = {}
            for i in np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == found):
                words = ids[starts[i]:starts[i] + n]
                key = words.tobytes()
                if key not in known:  # words decide, not hashes
                    upper = np.searchsorted(hashes, found[i], side="right")
                    same = np.array([np.array_equal(self.ids[a:a + n], words) for a in at[first[i]:upper]], bool)
                    known[key] = frozenset(item[first[i]:upper][same].tolist())
                if known[key]:
                    yield int(starts[i]), n, known[key]


def pieces(benchmark: DataFrame, window: int, item_key: str, item_text: str) -> DataFrame:
    """(name, words, n): items cut into pieces of a bounded number of windows, n; two neighbours share all words of a window but one, so that no window is lost or met twice."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                n = max(1, len(words) - window + 1)
                for start in range(0, n if words else 0, PIECE_WINDOWS):
                    stop = min(n, start + PIECE_WINDOWS)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([words[start:stop + window - 1]], pa.list_(pa.binary())), pa.array([stop - start])], names=["name", "words", "n"])
    items = benchmark.select(F.col(item_key).cast("string").alias("name"), F.col(item_text).cast("binary").alias("text")).filter("name is not null and text is not null")
    return items.mapInArrow(cut, "name string, words array<binary>, n long")


def parts(benchmark: DataFrame, window: int, part_windows: int, item_key: str, item_text: str) -> list[Broadcast]:
    """Broadcasts of at most ``part_windows`` windows each (a piece's, if that is more), built one after the other, so that the driver holds the text of a part and no more.

    The pieces are counted first, then read in as many partitions as keep each below a part.
    """
    cut = pieces(benchmark, window, item_key, item_text)
    total = cut.agg(F.sum("n")).first()[0] or 0
    context, out, held, size = benchmark.sparkSession.sparkContext, [], [], 0
    for row in cut.repartition(1 + 2 * total // part_windows).toLocalIterator():
        if held and size + row["n"] > part_windows:
            out.append(context.broadcast(Windows(held, window)))
            held, size = [], 0
        held.append((row["name"], [bytes(w) for w in row["words"]]))
        size += row["n"]
    return [*out, context.broadcast(Windows(held, window))]


def _found(texts: list[bytes | None], windows: Windows) -> tuple[list[int], Iterator[tuple[int, int, int, frozenset]]]:
    """The number of words of each text, and (row, start, length, items) of each hit."""
    lengths, numbers = [], []
    for one in texts:
        words = words_of(one)
        lengths.append(len(words))
        numbers.append(np.fromiter(map(windows.numbers.get, words, repeat(0)), np.uint64, len(words)))
        numbers.append(np.zeros(1, np.uint64))  # windows never cross texts
    starts = np.cumsum([0] + [n + 1 for n in lengths])

    def hits():
        for start, n, items in windows.hits(np.concatenate(numbers) if numbers else np.zeros(0, np.uint64)):
            row = int(np.searchsorted(starts, start, side="right")) - 1
            yield row, start - int(starts[row]), n, items
    return lengths, hits()


def _scan(batch: pa.RecordBatch, shared: list[Broadcast], text: str) -> list[pa.Array]:
    texts = batch.column(text).cast(pa.binary()).to_pylist()
    spans, items = [[] for _ in texts], [set() for _ in texts]
    for part in shared:
        windows, met = part.value, [set() for _ in texts]
        lengths, hits = _found(texts, windows)
        for row, start, n, found in hits:
            spans[row].append((start, start + n))
            met[row] |= found
        for row, found in enumerate(met):
            items[row] |= {windows.names[i] for i in found}
        if len(shared) > 1:  # a task holds one part at a time; the next batch reads it from the executor's disk again
            windows = hits = None
            vars(part).pop("_value", None)
    merged = []
    for found in spans:
        out: list[dict] = []
        for a, b in sorted(found):
            if out and a <= out[-1]["end"]:
                out[-1]["end"] = max(b, out[-1]["end"])
            else:
                out.append({"start": a, "end": b})
        merged.append(out)
    return [pa.array(lengths, pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array([sorted(x) for x in items], pa.list_(pa.string()))]


@apart
def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_windows: int = PART_WINDOWS, text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with _n_words, _spans and _items: the word spans of each text that benchmark windows cover, and the items they come from.

    Words are runs of ASCII letters (A-Z in lower case), digits and characters beyond ASCII. A window is ``window`` consecutive words of an
    item; an item with fewer words is one window. Spans are merged, end exclusive; items are distinct ids as strings, sorted.

    The benchmark is cut into pieces of items, and these are dealt into parts of at most ``part_windows`` windows, each of which is broadcast; a task holds one part at a time and scans
    each batch of texts for one after the other. So no benchmark, item or word is too large. Null and empty texts have no words; items without an id or without words are ignored; each
    row is judged by itself, also if rows share an id or are equal; further columns pass through; an empty table gives an empty table. The texts are not shuffled.
    """
    shared = parts(benchmark, window, part_windows, item_key, item_text)
    return with_columns(docs, _ADDED, lambda: lambda batch: _scan(batch, shared, text))


def judged(found: DataFrame) -> DataFrame:
    """Counts of a result of ``contamination``; contaminated if at least a twentieth of the words are hit."""
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumns({"_n_hit": n_hit, "_n_items": F.size("_items").cast("long"), "_items_sha256": F.sha2(F.array_join("_items", ","), 256)}) \
        .withColumn("_contaminated", (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated rows."""
    return judged(contamination(docs, benchmark, **options)).filter(~F.col("_contaminated")).select(*docs.columns)
