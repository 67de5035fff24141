import pyarrow as pa
import pytest


@pytest.fixture(scope="session")
def scratch(spark):
    from acreage.llm.common import Scratch
    return Scratch(spark, "test-llm")


@pytest.fixture
def docs(spark):
    """Documents from (id, text) rows, with columns whose names the operators use inside."""
    def make(rows, sources=None):
        names = [r[0] for r in rows]
        return spark.createDataFrame(pa.table({
            "doc_id": pa.array(names, pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array(["en"] * len(rows), pa.string()),
            "source": pa.array(sources or ["s"] * len(rows), pa.string()), "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()),
            "id": pa.array(["x"] * len(rows), pa.string()), "size": pa.array([None] * len(rows), pa.int64()), "line": pa.array([1] * len(rows), pa.int32())}))
    return make


@pytest.fixture
def real(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    return frame, [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One two three four five six"), (5, "One two three four five six"), (None, "one two three four five six"),
         (6, "\n\n"), (7, "ÄÖ é ñ\n" * 30), (8, "word " * 30_000), (9, "\x00 odd \x0b bytes \x1c"), (10, "İstanbul ﬀ ſ"), (7, "another row")]
