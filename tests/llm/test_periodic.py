"""Periodic runs beside a search of every lag."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from acreage.llm import periodic
from acreage.llm.catalog import with_periods
from tests.llm.conftest import EDGES


def runs_by_hand(w, least=6, exponent=4):
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, exponent * q) and not any(w[i:j + q - d] == w[i + d:j + q] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_by_hand(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_made_up_texts():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 3, 10, 60, 200, 400])
            letters = [str(i).encode() for i in range(rng.choice([1, 2, 3, 20, 100]))]
            w = [rng.choice(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n > 20 else 0):
                p, a = rng.randint(1, n // 4), rng.randint(0, n - 1)
                for i in range(a, rng.randint(a, n)):
                    w[i] = w[a + (i - a) % p]
            texts.append(w)
        assert periodic.runs_of(texts) == [runs_by_hand(w) for w in texts]


@pytest.mark.parametrize("q", [1, 2, 15, 16, 17, 31, 32, 33, 63, 64, 65, 128, 129, 255, 300])
def test_a_run_at_each_edge_of_a_scale(q):
    """Exactly four periods, or one word less, in the middle of other words, whatever the words of the period are."""
    rng = random.Random(q)
    for letters in (2, 5, 10_000):
        period = [str(rng.randrange(letters)).encode() for _ in range(q)]
        for length in (max(6, 4 * q), max(6, 4 * q) - 1):
            w = [b"x%d" % i for i in range(7)] + (period * 7)[:length] + [b"y%d" % i for i in range(700)]
            got = periodic.runs_of([w, w[3:]])
            assert got[0] == runs_by_hand(w)
            assert got[1] == [(a - 3, n, p) for a, n, p in got[0]]


def test_minimizers():
    rng = np.random.default_rng(0)
    for width in (1, 2, 8, 16):
        hashes = rng.integers(0, 30, 100).astype(np.uint64)
        want = {j for i in range(100 - width + 1) for j in range(i, i + width) if hashes[j] == hashes[i:i + width].min()}
        assert set(periodic.minimizers(hashes, width).tolist()) == want
    assert not len(periodic.minimizers(hashes[:3], 8))


def made_by_hand(name, text):
    o = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if name is None:
        return o
    h, n = zlib.crc32(str(name).encode()), len(o)
    g = h // 10
    if h % 10 or not n:
        return o
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return o[:a] + [o[a + (i - a) % p] for i in range(a, n)]


def test_texts(docs, real):
    rng = random.Random(2)
    odd = EDGES + [(100 + i, " \t".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))) for i in range(60)] + [(200, "a b " * 50 + "\n" + "c " * 3000)]
    for frame, rows in (real, (docs(odd), odd)):
        got = periodic.periodic_runs(with_periods(frame))
        assert got.columns == ["doc_id", "runs", "runs_sha256", "collapsed"]
        want = []
        for name, text in rows:
            w = made_by_hand(name, text)
            runs = runs_by_hand(w) if len(w) < 1500 else periodic.runs_of([[x.encode() for x in w]])[0]
            want.append((name, runs, hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest(), kept_by_hand(w, runs)))
        assert sorted([(r[0], [tuple(x) for x in r[1]], r[2], r[3]) for r in got.collect()], key=str) == sorted(want, key=str)
    assert got.limit(0).count() == 0 and periodic.periodic_runs(docs(EDGES).limit(0)).count() == 0


def test_long_text_in_little_time():
    rng = random.Random(4)
    w = [b"%d" % rng.randrange(50) for _ in range(300_000)]
    w[100_000:200_000] = (w[100_000:120_011] * 5)[:100_000]
    start = time.perf_counter()
    found = [(a, n) for a, n, q in periodic.runs_of([w])[0] if q == 20_011]
    assert len(found) == 1 and found[0][0] <= 100_000 and sum(found[0]) >= 200_000
    assert time.perf_counter() - start < 30
