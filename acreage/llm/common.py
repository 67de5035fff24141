"""What the operators of this subpackage share: reading, scratch tables, word hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acreage.session import scratch_path

WHITE = " \t\n\x0b\f\r"
_CACHED_WORDS = 1_000_000
_FILE_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one run below the folder that ``spark.checkpoint.dir`` names.

    A table written here cuts the lineage: a lost executor costs no earlier stage again, and the planner knows the size.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, name), 0

    def put(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """``rows``: about how many to expect at most; fewer than ``_FILE_ROWS`` of them are not worth a task and a file of their own."""
        if rows is not None:
            df = df.coalesce(rows // _FILE_ROWS + 1)
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of this run that no later plan reads."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_at)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def apart(operator: Callable) -> Callable:
    """For operators whose inner and added columns begin with an underscore: columns of the input that do so bear other names while the operator runs, and their own again afterwards, unless the
    operator adds a column of that name, which then takes its place."""
    @wraps(operator)
    def run(docs: DataFrame, *args, **options):
        clashing = [c for c in docs.columns if c.startswith("_")]
        if not clashing:
            return operator(docs, *args, **options)
        away = dict(zip(clashing, free_names(docs, *[f"input{c}" for c in clashing])))
        out = operator(docs.withColumnsRenamed(away), *args, **{k: away.get(v, v) if isinstance(v, str) else v for k, v in options.items()})
        for name, other in away.items():
            if other in out.columns:
                out = out.drop(other) if name in out.columns else out.withColumnRenamed(other, name)
        return out
    return run


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """With the id, this names a row; equal rows share it, which no operator minds."""
    return F.xxhash64(text)


def hash_bound(share: float) -> int:
    """The 64-bit hash that a ``share`` of all hashes do not exceed."""
    return min(2**63 - 1, int((2 * share - 1) * 2**63))


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) to 64-bit hash; forgets all words when it has grown too long."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case (both are what ``bytes`` does by itself)."""
    return text.lower().split() if text else []


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of several words in a row, elementwise."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; the whole sequence if it is shorter, none if empty."""
    n = len(hashes)
    if not n:
        return hashes
    w = min(n, width)
    return np.unique(joined([hashes[i:n - w + 1 + i] for i in range(w)]))


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as small bytes: differences, their bytes grouped by place, compressed."""
    values = values.astype(np.uint64)
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def squeeze(values: np.ndarray) -> bytes:
    """Values as bytes grouped by place, compressed."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=3).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def with_columns(df: DataFrame, added: StructType, compute: Callable) -> DataFrame:
    """``df`` with the columns of ``added``. ``compute()`` is called once in a task and gives a function from an Arrow batch to their arrays;
    all other columns pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compute()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *made(batch)], names=[*batch.schema.names, *added.names])
    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


