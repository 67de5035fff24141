"""The audit of filters beside brute force."""

import random
import re
from itertools import permutations

import pyarrow as pa

from acreage.llm import filter_audit
from tests.llm.conftest import EDGES


def fails_by_hand(name, text, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, is_failing in zip("ABCDE", (
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)),
        name is not None and any(n is not None and n < name and (t or "") == text for n, t, _ in rows))) if is_failing}


def audit_by_hand(rows, labels):
    good = {n for n, q, _ in labels if q == 1 and n is not None}
    toxic = {n for n, _, t in labels if t == 1 and n is not None}
    judged = [(part or "", name, fails_by_hand(name, text or "", rows)) for name, text, part in rows]
    out = {}
    for part in {p for p, _, _ in judged}:
        own = [(n, f) for p, n, f in judged if p == part]
        removed = {}
        for order in permutations("ABCDE"):
            rest = own
            for step, f in enumerate(order, 1):
                gone, rest = [x for x in rest if f in x[1]], [x for x in rest if f not in x[1]]
                removed[f] = removed.get(f, 0) + len(gone)
                out[part, "".join(order), step] = [len(rest), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own),
                                                   sum(n in good for n, _ in gone), sum(n in toxic for n, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def found(frame, labels, scratch):
    out = filter_audit.audit(frame, labels, scratch)
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in out.collect())


def marked(spark, rows):
    return spark.createDataFrame(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "quality": pa.array([r[1] for r in rows], pa.int64()),
                                           "toxic": pa.array([r[2] for r in rows], pa.int64()), "part": pa.array(["p"] * len(rows))}))


def test_audit_of_odd_rows(spark, scratch, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", 7)  # many ranges
    rng = random.Random(3)
    rows = [(n, t, None if i % 4 == 0 else "" if i % 4 == 1 else "en") for i, (n, t) in enumerate(EDGES)]
    for i in range(60):
        text = " ".join(rng.choice(["a", "B", "#", "word", str(rng.random())]) for _ in range(rng.choice([0, 5, 199, 200, 400])))
        rows += [(rng.randint(0, 40), text, rng.choice(["en", "de"]))] * rng.choice([1, 1, 3])
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(30)] + [(4, None, None), (4, 1, 1), (None, 1, 1), (6, 0, None)]
    frame = spark.createDataFrame(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "lang": pa.array([r[2] for r in rows], pa.string()),
                                            "part": pa.array(["x"] * len(rows)), "mask": pa.array([None] * len(rows), pa.int32()), "id": pa.array([0] * len(rows))})).repartition(3)
    got = found(frame, marked(spark, labels), scratch)
    assert got == audit_by_hand(rows, labels)
    assert found(frame.limit(0), marked(spark, labels), scratch) == []
    assert found(frame, marked(spark, labels).limit(0), scratch) == audit_by_hand(rows, [])


def test_merges_of_lists():
    rng = random.Random(1)
    for _ in range(2000):
        lists = [sorted(rng.sample(range(90), rng.randint(0, rng.choice([3, 80])))) for _ in range(rng.randint(0, 5))]
        assert filter_audit.union(lists) == sorted(set().union(*lists))
        a, b = (sorted(rng.sample(range(90), rng.randint(0, rng.choice([3, 80])))) for _ in range(2))
        assert filter_audit.difference(a, b) == sorted(set(a) - set(b))
        assert filter_audit.shared(a, b) == len(set(a) & set(b))
        x, low = rng.randint(0, 90), rng.randint(0, len(a))
        assert filter_audit.gallop(a, x, low) == next((i for i in range(low, len(a)) if a[i] >= x), len(a))
