"""The toxicity reader beside a plain version, finite differences and held-out labels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acreage.llm import toxicity
from acreage.llm.catalog import op13_toxicity
from tests.llm.conftest import EDGES


def sig(x):
    return 1 / (1 + np.exp(-x))


def features_by_hand(reader, word):
    bare = b"<" + (word.strip(toxicity._SIGNS) or word) + b">"
    bare = bare.ljust(toxicity.GRAM, b">") if len(bare) < toxicity.GRAM else bare
    buckets, _, _ = toxicity.features([word])
    grams = []
    for i in range(len(bare) - toxicity.GRAM + 1):
        value = 0
        for byte in bare[i:i + toxicity.GRAM]:
            value = value * 257 + byte
        grams.append((value * 0x9E3779B97F4A7C15 % 2**64 >> 40) % toxicity.GRAM_BUCKETS)
    return np.concatenate([reader.p["word"][buckets[0]], reader.p["char"][grams].mean(0)])


def logit_by_hand(reader, words):
    """One window, word by word."""
    h, p = toxicity.HIDDEN, {k: v.astype(float) for k, v in reader.p.items()}
    x = [features_by_hand(reader, w) for w in words]
    read = {}
    for d, order in (("f", range(len(x))), ("b", reversed(range(len(x))))):
        state = np.zeros(h)
        for t in order:
            a = x[t] @ p["w" + d] + p["v" + d]
            z, r = sig(a[:h] + state @ p["u" + d][:, :h]), sig(a[h:2 * h] + state @ p["u" + d][:, h:2 * h])
            state = (1 - z) * state + z * np.tanh(a[2 * h:] + (r * state) @ p["u" + d][:, 2 * h:])
            read[d, t] = state
    states = [np.concatenate([read["f", t], read["b", t]]) for t in range(len(x))]
    if not states:
        return float(p["bias"][0])
    share = np.exp([np.tanh(s @ p["att"]) @ p["query"] for s in states])
    return float(sum(a * s for a, s in zip(share / share.sum(), states)) @ p["out"] + p["bias"][0])


@pytest.fixture(scope="module")
def reader():
    out = toxicity.Reader(3)
    out.p["word"] *= 8
    out.p["char"] *= 8
    return out


def test_texts_equal_a_plain_reader(reader, monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK_WORDS", 300)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 40)
    rng = np.random.default_rng(0)
    vocabulary = [b"a", b"the", b"scum,", "ärger".encode(), b"--", b"x" * 300, b"no!", b"<>", *(b"w%d" % i for i in range(90))]
    texts = [[vocabulary[i] for i in rng.integers(0, len(vocabulary), n)] for n in (0, 1, 2, 63, 64, 65, 111, 112, 113, 160, 500, 1)]
    logits, starts = reader.best_windows(texts, toxicity.Known(reader))
    for words, logit, start in zip(texts, logits, starts):
        by_window = {a: logit_by_hand(reader, words[a:b]) for a, b in toxicity.windows_of(len(words))}
        assert logit == pytest.approx(max(by_window.values()), abs=1e-4)
        assert by_window[int(start)] == pytest.approx(max(by_window.values()), abs=1e-4)


def test_windows_cover_all_words():
    for n in range(0, 700):
        cuts = toxicity.windows_of(n)
        assert cuts[0][0] == 0 and cuts[-1][1] == n and all(b - a <= toxicity.WINDOW for a, b in cuts)
        assert all(later[0] == a + toxicity.STRIDE < b for (a, b), later in zip(cuts, cuts[1:]))


def test_gradient(monkeypatch):
    monkeypatch.setattr(toxicity, "WORD_BUCKETS", 40)
    monkeypatch.setattr(toxicity, "GRAM_BUCKETS", 60)
    small = toxicity.Reader(1)
    small.p = {k: v.astype(float) * (3 if k in ("word", "char") else 1) for k, v in small.p.items()}
    words = [b"one", b"two", b"three,", b"four", b"b"]
    cells, live = toxicity.fill([np.array(w) for w in ([0, 1, 2, 3, 0], [4, 2], [1])])
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    grads, _ = small.gradient(words, cells, live, target, weight)
    rng = np.random.default_rng(2)
    for name, value in small.p.items():
        for at in rng.choice(value.size, min(value.size, 25), replace=False):
            flat, kept = value.reshape(-1), value.reshape(-1)[at]
            losses = []
            for step in (1e-5, -1e-5):
                flat[at] = kept + step
                losses.append(small.gradient(words, cells, live, target, weight)[1])
            flat[at] = kept
            assert grads[name].reshape(-1)[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, abs=1e-6), name


def texts_and_labels(spark, rows):
    frame = spark.createDataFrame(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "id": pa.array(["x"] * len(rows)),
                                            "label": pa.array([9] * len(rows)), "score": pa.array([None] * len(rows), pa.float64()), "toxic": pa.array([1] * len(rows))})).repartition(3)
    known = [r for r in rows if r[2] is not None]
    labels = spark.createDataFrame(pa.table({"doc_id": pa.array([r[0] for r in known], pa.int64()), "quality": pa.array([1] * len(known)), "toxic": pa.array([r[2] for r in known], pa.int64())}))
    return frame, labels


def test_held_out_labels(spark, scratch):
    """Stems that only toxic texts have, always with another ending, somewhere in long texts; held-out rows have labels turned round, which must not be learned."""
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 8))) for _ in range(600)]

    def text(is_toxic):
        words = list(rng.choice(plain, int(rng.choice([20, 80, 300]))))
        if is_toxic:
            for at in rng.choice(len(words), max(2, len(words) // 40), replace=False):
                words[at] = "vekkz" + "".join(rng.choice(list("abcde"), 3)) if rng.random() < 0.5 else "Grumpf."
        return " ".join(words)
    import zlib
    rows, truth = [], {}
    for i in range(900):
        truth[i] = int(i % 3 == 0)
        out = zlib.crc32(str(i).encode()) % 5 == 0
        rows.append((i, text(truth[i]), 1 - truth[i] if out else truth[i]))
    frame, labels = texts_and_labels(spark, rows)
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame, labels, scratch, steps=200).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([(got[i] >= 0.5) == truth[i] for i in held])
    assert len(held) > 100 and right >= 0.95, right


def test_odd_rows(spark, scratch):
    rows = [(n, t, i % 2 if i % 3 else None) for i, (n, t) in enumerate(EDGES)]
    frame, labels = texts_and_labels(spark, rows)
    out = toxicity.toxicity(frame, labels.union(labels).union(labels.limit(2)), scratch, steps=3)
    got = out.collect()
    assert out.columns == ["doc_id", "score", "n_windows", "first_word", "last_word"]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows) and all(0 <= r["score"] <= 1 for r in got)
    assert max(r["n_windows"] for r in got) == len(toxicity.windows_of(30_000))
    empty = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    assert toxicity.toxicity(frame.limit(0), labels, scratch).collect() == []
    for kind, value in ((0, 0.0), (1, 1.0)):
        only = labels.filter(F.col("toxic") == kind)
        assert {round(r["score"], 6) for r in toxicity.toxicity(frame, only, scratch).collect()} == {value}
    assert {round(r["score"], 6) for r in toxicity.toxicity(frame, labels.limit(0), scratch).collect()} == {0.0}


def test_query(spark, sf):
    got = op13_toxicity(spark, sf).select("doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
