"""Stages of the pipeline, each on its own input."""

import pyarrow as pa
import pytest

import corpus_pipeline as cp
from tests.llm.conftest import EDGES
from tests.llm.test_texts import groups_by_hand, lines_by_hand, passages_by_hand, words_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(frame):
    return sorted([(r["doc_id"], r["text"]) for r in frame.collect()], key=str)


def test_stages(spark, sf):
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "line dedup", "near duplicates", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = cp.quality(spark, docs, sf)
    assert kept.columns == COLUMNS and set(rows_of(kept)) <= set(first)
    marks = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = {i for i, m in marks.items() if m == (1, 0)}
    assert len(good & {i for i, _ in rows_of(kept)}) >= 0.95 * len(good)

    docs = docs.select(*COLUMNS)
    lines = cp.lines(spark, docs, sf)
    assert lines.columns == COLUMNS and rows_of(lines) == sorted([(i, t) for i, _, _, t in lines_by_hand(first, 10)], key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    single = cp.near_duplicates(spark, docs, sf)
    assert single.columns == COLUMNS and [i for i, _ in rows_of(single)] == sorted([i for i, _, _, own in groups_by_hand(first) if own], key=lambda i: str((i, dict(first)[i])))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = cp.decontamination(spark, docs, sf)
    assert clean.columns == COLUMNS and {i for i, _ in rows_of(clean)} == {r[0] for r in passages_by_hand(first, items) if not r[5]}
    mixed = cp.mixing(spark, docs, sf)
    assert set(COLUMNS) < set(mixed.columns) and mixed.groupBy("doc_id", "copy").count().filter("count > 1").isEmpty()
    total = sum(len(words_of(t)) for _, t in first)
    assert sum(len(words_of(r["text"])) for r in mixed.collect()) == pytest.approx(1.5 * total, rel=0.05)


def test_odd_rows(spark, sf):
    frame = spark.createDataFrame(pa.table({
        "doc_id": pa.array([i for i, _ in EDGES], pa.int64()), "text": pa.array([t for _, t in EDGES], pa.string()), "lang": pa.array([None] * len(EDGES), pa.string()),
        "source": pa.array([None] * len(EDGES), pa.string()), "n_chars": pa.array([None] * len(EDGES), pa.int64())}))
    for name, stage in cp.STAGES:
        assert stage(spark, frame.limit(0), sf).count() == 0
        out = stage(spark, frame, sf)
        out.collect()
    assert sum(i == 5 for i, _ in rows_of(cp.near_duplicates(spark, frame, sf))) == 1  # equal rows once


def test_run(spark, sf):
    """The whole run equals its stages one after the other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert rows_of(cp.run(spark, sf)) == rows_of(docs)


INNER = ("_id _h _drops _kept _log_weight _n_grams _sample_key _copies _passes _rest _size _source _threshold _contaminated _i _items _items_sha256 _n _n_hit _n_items _n_words _s _spans _name _key "
         "_NAME row_id row_text id cls comp h1 h2 value run node part mask score size line").split()


def odd_docs(spark, rows, names=INNER):
    return spark.createDataFrame(pa.table({
        "doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "lang": pa.array(["en"] * len(rows)), "source": pa.array(["s"] * len(rows)),
        "n_chars": pa.array([1] * len(rows), pa.int64()), **{n: pa.array([f"own {n}"] * len(rows)) for n in names if n != "_NAME"}}))


def test_columns_named_like_inner_ones(spark, sf):
    """Every stage keeps the input's columns and their values, whatever their names are."""
    frame = odd_docs(spark, EDGES)
    for name, stage in cp.STAGES:
        out = stage(spark, frame, sf)
        assert out.columns[:len(frame.columns)] == frame.columns, name
        for r in out.collect():
            assert all(r[n] == f"own {n}" for n in INNER if n != "_NAME"), name


def test_operators_beside_columns_named_like_inner_ones(spark, sf, scratch):
    from acreage.llm import bottomk, decontaminate, filter_audit, importance, katz, licenses, line_dedup, mixture, periodic, pii, run_index, toxicity
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    calls = {
        "line_dedup": lambda d: line_dedup.drop_common_lines(d, scratch), "importance": lambda d: importance.resample(d, labels, scratch), "mixture": lambda d: mixture.mix_sources(d, scratch),
        "decontaminate": lambda d: decontaminate.judged(decontaminate.contamination(d, items)), "bottomk": lambda d: bottomk.near_duplicates(d, scratch),
        "run_index": lambda d: run_index.repeated_spans(d, scratch), "katz": lambda d: katz.katz_scores(d, scratch), "licenses": lambda d: licenses.scan_licenses(d, scratch),
        "pii": lambda d: pii.find_personal_data(d), "audit": lambda d: filter_audit.audit(d, labels, scratch), "periodic": lambda d: periodic.periodic_runs(d),
        "toxicity": lambda d: toxicity.toxicity(d, labels, scratch, steps=2)}
    rows = [r for r in EDGES if len(r[1] or "") < 1000]
    for name, call in calls.items():
        plain, odd = call(odd_docs(spark, rows, ())), call(odd_docs(spark, rows))
        added = [c for c in plain.columns if c not in odd_docs(spark, rows, ()).columns or c in ("doc_id", "text")]
        assert len(set(odd.columns)) == len(odd.columns), name
        assert sorted(map(str, odd.select(added).collect())) == sorted(map(str, plain.select(added).collect())), name


def test_near_duplicates_keep_rows_not_ids(spark, sf):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, text), (5, other), (5, text), (6, None), (6, ""), (6, None), (None, other), (7, text + " more"), (8, None)]
    kept = rows_of(cp.near_duplicates(spark, odd_docs(spark, rows, ()), sf))
    assert kept == sorted([(1, text), (5, other), (6, None), (6, ""), (8, None)], key=str)  # 3 of 4 runs in common are a link
