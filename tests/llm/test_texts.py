"""Operators on texts beside brute force, on given and odd rows."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from acreage.llm import bottomk, decontaminate, importance, katz, licenses, line_dedup, mixture, pii, run_index
from acreage.llm.graph import components
from tests.llm.conftest import EDGES

WHITE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# lines

def lines_by_hand(rows, least):
    found = defaultdict(set)
    key = lambda line: line.translate(LOWER).strip(WHITE)
    for name, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                found[key(line)].add(name)
    out = []
    for name, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if not key(x) or len(found[key(x)]) < least]
        out.append((name, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 10])
def test_lines(docs, real, scratch, least):
    for frame, rows in (real, (docs(EDGES), EDGES)):
        out = line_dedup.drop_common_lines(frame, scratch, min_docs=least)
        assert {"lang", "source", "n_chars"} <= set(out.columns)
        assert sorted([tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "text").collect()], key=str) == lines_by_hand(rows, least)


# groups

def groups_by_hand(rows, percent=75):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            low[find(i)] = min(name, low.get(find(i), name))
    return sorted([(name, len(sets[i]), low.get(find(i)), name == low.get(find(i))) for i, (name, _) in enumerate(rows)], key=str)


def found_groups(frame, scratch, **options):
    return sorted([tuple(r) for r in bottomk.near_duplicates(frame, scratch, **options).collect()], key=str)


def test_groups(docs, real, scratch):
    for frame, rows in (real, (docs(EDGES), EDGES)):
        assert found_groups(frame, scratch) == groups_by_hand(rows)


def family(n, seed, length=120, edits=4):
    """Variants of one text, and texts that share a long passage but are no variants."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 10**6, length)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.integers(0, length, int(rng.integers(0, edits + 1))):
            text[at] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(text))
    passage = base[:length // 2]
    out += [" ".join([f"u{x}" for x in rng.integers(0, 10**6, length // 2)] + passage) for _ in range(n)]
    return out


@pytest.mark.parametrize("block,crowd", [(256, 4), (8, 10_000), (8, 0), (256, 0)])
def test_groups_of_variants(docs, scratch, monkeypatch, block, crowd):
    """With small parts, lists that stay mixed are compared part by part; as crowds or pair by pair."""
    monkeypatch.setattr(bottomk, "BLOCK", block)
    monkeypatch.setattr(bottomk, "CROWD", crowd)
    monkeypatch.setattr(bottomk, "ROUNDS", 1 if block == 8 else 4)
    rows = [(i, t) for i, t in enumerate(family(40, 1, edits=8) + family(30, 2, 60, 3) + family(10, 3, 12, 1))]
    assert found_groups(docs(rows), scratch) == groups_by_hand(rows)


def test_sets_without_a_partner_meet_no_block(docs, scratch, monkeypatch):
    """Variants that hold too many values of their own are compared with nobody, however many they are: rows in blocks grow with the group."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]

    def variant(edits):
        text = list(base)
        for at in rng.choice(120, edits, replace=False):
            text[at] = f"e{rng.integers(0, 10**9)}"
        return " ".join(text)
    rows = [(i, variant(1 + i % 2 * 7)) for i in range(120)]
    dealt, made = bottomk._dealt, []

    def counted(*args):
        made.append((args[0].count(), dealt(*args).count()))
        return dealt(*args)
    monkeypatch.setattr(bottomk, "_dealt", counted)
    monkeypatch.setattr(bottomk, "BLOCK", 8)
    monkeypatch.setattr(bottomk, "ROUNDS", 1)
    assert found_groups(docs(rows), scratch) == groups_by_hand(rows)
    assert all(blocks <= 2 * members for members, blocks in made)


def test_components_of_chains_and_stars(spark, scratch):
    links = [(f"{a}".encode(), f"{b}".encode()) for a, b in [(1, 2), (3, 2), (3, 4), (5, 4), (6, 7), (6, 8), (9, 6), (20, 20)]]
    out = components(spark.createDataFrame(links, "a binary, b binary"), scratch)
    assert sorted((int(r["node"]), int(r["root"])) for r in out.collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 6), (8, 6), (9, 6)]


def test_blocks_that_span_frames_are_compared_whole():
    rng = np.random.default_rng(4)
    base = np.sort(rng.integers(-2**63, 2**63 - 1, 64))
    rows = []
    for value in (base[3], base[9]):
        for i in range(9):
            sketch = np.sort(np.r_[base[:50], rng.integers(-2**63, 2**63 - 1, 14)].view(np.uint64)).view(np.int64)
            rows.append({"value": value, "cls": bytes([i]), "comp": bytes([i]), "own": 0, "x": 0, "y": 0, "sketch": sketch, "n": 500, "prefix": 1 << int(np.flatnonzero(sketch == value)[0])})
    whole = pd.DataFrame(rows)

    def found(width):
        frames = [whole.iloc[a:a + width] for a in range(0, len(whole), width)] + [whole.iloc[:0]]
        return sorted(pd.concat(list(bottomk._candidates(iter(frames), 64, 75))).itertuples(index=False, name=None))
    one_by_one = pd.concat([bottomk._candidates_in_block(g, 64, 75) for _, g in whole.groupby("value")])
    assert len(one_by_one) >= 36
    assert found(len(whole)) == found(4) == found(9) == sorted(one_by_one.itertuples(index=False, name=None))


def test_estimate_is_exact_for_whole_sets():
    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(2))
    assert bottomk.estimate(a, b, 64) == pytest.approx(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))


# repeated strings

def repeats_by_hand(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (name, _), t in zip(rows, texts):
        hit = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                hit[i:i + length] = True
        kept = bytes(c for c, h in zip(t, hit) if not h)
        out.append((name, len(t), int(hit.sum()), int((hit[1:] < hit[:-1]).sum()), sha(kept)))
    return sorted(out, key=str)


def found_repeats(frame, scratch, **options):
    out = run_index.repeated_spans(frame, scratch, **options)
    return sorted([(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in out.collect()], key=str)


def test_repeats(docs, real, scratch):
    assert found_repeats(real[0], scratch) == repeats_by_hand(real[1], 200)
    edges = [r for r in EDGES if r[0] != 8] + [(8, "word " * 300), (11, "a" * 1000), (12, "b" * 200), (13, "c" * 201)]
    assert found_repeats(docs(edges), scratch) == repeats_by_hand(edges, 200)


@pytest.mark.parametrize("hot,size", [(8000, 10**6), (2, 500), (1000, 300)])
def test_repeats_with_short_strings(docs, scratch, hot, size):
    """Frequent anchors are counted window by window, many parts are indexed apart: the same result."""
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("ab"), 300))
    rows = [(i, "".join(rng.choice(list("abcd"), int(rng.integers(0, 80)))) + base[(a := int(rng.integers(0, 250))):a + int(rng.integers(0, 60))]
             + "".join(rng.choice(list("abcd"), int(rng.integers(0, 80))))) for i in range(120)]
    assert found_repeats(docs(rows), scratch, length=20, width=6, hot=hot, index_bytes=size) == repeats_by_hand(rows, 20)


def test_contexts_left_out_of_an_index_share_no_window():
    rng = np.random.default_rng(7)
    length, width, left_out = 20, 6, 0
    base = rng.integers(97, 99, 60).astype(np.uint8)
    texts = []
    for _ in range(60):
        text = rng.integers(97, 101, 60).astype(np.uint8)
        a, n = rng.integers(0, 30), rng.integers(5, 30)
        text[a:a + n] = base[a:a + n]
        texts.append(text)
    found = {}
    for text in texts:
        prefixes = run_index.Prefixes(text)
        for at, first, last in zip(*run_index.anchors(prefixes, len(text), length, width)):
            found[text[first:last + length].tobytes(), int(at - first)] = int(prefixes.of(np.array([at]), width).view(np.int64)[0])
    contexts, names = [c for c, _ in found], np.array(list(found.values()))
    paired = run_index._paired(names, contexts, length, width)
    for i, one in enumerate(contexts):
        others = {c[k:k + length] for j, c in enumerate(contexts) if j != i and names[j] == names[i] for k in range(len(c) - length + 1)}
        shared = any(one[k:k + length] in others for k in range(len(one) - length + 1))
        assert paired[i] or not shared
        left_out += bool(others) and not paired[i]
    assert left_out


def test_match_lengths():
    rng = np.random.default_rng(2)
    for n in (3, 9, 40, 300):
        text = np.append(rng.integers(97, 99, n), 255).astype(np.uint8)
        turns = [bytes(np.roll(text, -i)) for i in range(n + 1)]
        alike = lambda a, b: next((i for i in range(n + 1) if a[i] != b[i]), n + 1)
        want = [max(alike(t, u) for j, u in enumerate(turns) if j != i) for i, t in enumerate(turns)]
        assert run_index.match_lengths(text).tolist() == want


# language model

def katz_by_hand(rows):
    start, end = "<start>", "<end>"
    tokens = [words_of(t) + [end] for _, t in rows]
    held = [zlib.crc32(("" if n is None else str(n)).encode()) % 10 == 0 for n, _ in rows]
    c1, c2, follow = Counter(), Counter(), defaultdict(set)
    for t, h in zip(tokens, held):
        if not h:
            c1.update(t)
            c2.update(zip([start, *t], t))
            for a, b in zip([start, *t], t):
                follow[a].add(b)
    n, v = sum(c1.values()), len(c1)
    often = Counter(c2.values())
    d = katz.discounts([often[i] for i in range(1, 7)])
    p1 = lambda w: (c1[w] + 0.1) / (n + 0.1 * (v + 1))
    after = lambda a: sum(c2[a, w] for w in follow[a])
    known = {a: after(a) for a in follow}
    p2 = lambda a, w: float(katz.discounted(np.array([c2[a, w]]), d)[0]) / known[a]
    weight = {a: (1 - sum(p2(a, w) for w in follow[a])) / (1 - sum(p1(w) for w in follow[a])) for a in follow}
    prob = lambda a, w: p1(w) if a not in follow else p2(a, w) if w in follow[a] else weight[a] * p1(w)
    out = [(name, h, len(t), sum(c1[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), sum(math.log10(prob(a, w)) for a, w in zip([start, *t], t)))
           for (name, _), t, h in zip(rows, tokens, held)]
    for a in list(follow)[:50]:  # one word for all that were never seen
        assert sum(prob(a, w) for w in c1) + prob(a, "<never>") == pytest.approx(1)
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{}, {"block_tokens": 3000, "bucket_grams": 5000}])
def test_language_model(docs, real, scratch, sizes):
    for frame, rows in (real, (docs(EDGES), EDGES)):
        got = sorted([tuple(r) for r in katz.katz_scores(frame, scratch, **sizes).collect()], key=str)
        want = katz_by_hand(rows)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


# benchmark passages

def passages_by_hand(rows, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for name, text in items:
        w = split(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n and name is not None else 0):
            windows[tuple(w[i:i + n])].add(str(name))
    lengths, out = {len(w) for w in windows}, []
    for name, text in rows:
        w, hit, found = split(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((name, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit, piece", [(decontaminate.PART_WINDOWS, decontaminate.PIECE_WINDOWS), (20, 7), (1, 1)])
def test_passages(spark, docs, scratch, limit, piece, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", piece)
    rng = np.random.default_rng(7)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, int(n)))) for i, n in enumerate([20, 30, 13, 14, 5, 2, 40, 13])] + [(20, None), (21, "!!"), (None, "v1 v2"), (4, "v1 v2 v3 v4 v5 v6")]
    rows = [(i, "  ".join(rng.choice(vocabulary, 40)) + ", " + items[i % 8][1].upper() + " - " + " ".join(rng.choice(vocabulary, int(rng.integers(0, 400))))) for i in range(30)] + EDGES
    frame = docs(rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.judged(decontaminate.contamination(frame, bench, part_windows=limit))
    assert set(frame.columns) < set(out.columns)
    out = out.select("doc_id", *(f"_{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))
    assert sorted([tuple(r) for r in out.collect()], key=str) == passages_by_hand(rows, items)
    bad = {r[0] for r in passages_by_hand(rows, items) if r[5]}
    left = decontaminate.drop_contaminated(frame, bench)
    assert left.columns == frame.columns and {r["doc_id"] for r in left.collect()} == {r[0] for r in passages_by_hand(rows, items) if not r[5]} and bad


def test_passages_of_one_large_item(spark, docs, monkeypatch):
    """One id holds the whole benchmark, words longer than any bound and the same window over and over."""
    monkeypatch.setattr(decontaminate, "PIECE_WINDOWS", 64)
    rng = np.random.default_rng(8)
    long = ["x" * 70 + str(i) for i in range(5)]
    words = [str(w) for w in rng.choice([f"v{i}" for i in range(200)] + long, 3000)]
    items = [(1, " ".join(words)), (1, " ".join(["again"] * 500)), (2, " ".join(["again"] * 40)), (2, " ".join(words[100:120])), (3, long[0])]
    rows = [(i, " ".join(words[i * 90:i * 90 + 11 + i]) + " other " + "again " * (3 * i) + long[i % 5].upper()) for i in range(30)] + [(40, "x" * 70), (41, "x" * 70 + "00")] + EDGES
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.PART_WINDOWS, 200):
        shared = decontaminate.parts(bench, 13, limit, "item_id", "text")
        assert all(sum(len(at) for _, at, _ in p.value.by_length.values()) <= limit for p in shared) and (len(shared) > 10) == (limit == 200)
        out = decontaminate.judged(decontaminate.contamination(docs(rows), bench, part_windows=limit))
        out = out.select("doc_id", *(f"_{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")))
        assert sorted([tuple(r) for r in out.collect()], key=str) == passages_by_hand(rows, items)


# sources

def test_mixing(docs, scratch):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 50)))) for i in range(400)] + EDGES
    sources = [["a", "b", "B", None, "é", ""][i] for i in rng.choice(6, len(rows), p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05])]
    out = mixture.mix_sources(docs(rows, sources), scratch).collect()
    size, weight = Counter(), {}
    for (_, text), source in zip(rows, sources):
        size[source] += len(words_of(text))
    for i, source in enumerate(sorted(size, key=lambda s: (s is None, s or ""))):
        weight[source] = [5, 2, 1][i % 3]
    target, budget = {}, 1.5 * sum(size.values())
    while True:  # share by weight, fix the full ones, share the rest again
        free = [s for s in size if s not in target]
        share = {s: budget * weight[s] / sum(weight[f] for f in free) for s in free}
        full = [s for s in free if share[s] > 2 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * size[s]
            budget -= target[s]
    taken, largest = Counter(), Counter()
    assert len(out) == len(rows)
    by_target = {round(t, 6): s for s, t in target.items()}
    for r in out:
        source = by_target[round(r["_target"], 6)]
        assert r["_copies"] <= 2 and r["_size"] == len(words_of(r["text"])) and r["source"] == source
        assert r["_source_size"] == size[source]
        taken[source] += r["_size"] * r["_copies"]
        largest[source] = max(largest[source], r["_size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in size)


# quality

def test_resample_keeps_what_resembles_the_target(spark, docs, scratch):
    rng = np.random.default_rng(5)
    prose, junk = [f"word{i}" for i in range(200)], [f"junk{i}" for i in range(20)]
    rows, labels, want = [], [], {}
    for i in range(600):
        bad = i % 4 == 0
        text = [str(w) for w in rng.choice(prose, int(rng.integers(40, 200)))]
        if bad:
            for at in rng.integers(0, len(text), max(3, len(text) // 10)):
                text[at] = str(rng.choice(junk))
        rows.append((i, " ".join(text)))
        want[i] = not bad
        if i % 3 == 0:
            labels.append((i, int(not bad), 0))
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["_kept"] for r in importance.resample(docs(rows), marks, scratch).collect()}
    assert sum(got[i] == want[i] for i in want) >= 595
    empty = {r["doc_id"]: r["_kept"] for r in importance.resample(docs(rows + [(1000, None), (1001, ""), (None, "word1")]), marks, scratch).collect()}
    assert empty[1000] is False and empty[1001] is False and len(empty) == 603
    assert all(r["_kept"] for r in importance.resample(docs(rows[:20]), marks.limit(0), scratch).collect())


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(0, 8, 500), -rng.lognormal(0, 8, 500), [0.5] * 300]).tolist()
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").cache()
    for k in (1, 7, 450, 600, 900, 1300):
        assert importance.kth_largest(frame, "x", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(frame, "x", 0) is None and importance.kth_largest(frame, "x", 1301) is None


# licences

def test_licenses(docs, real, scratch):
    frame, rows = real
    fixed = {"This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
             "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = {(name, i, fixed[line]) for name, text in rows for i, line in enumerate(text.split("\n")) if line in fixed}
    got = {(r["id"], r["line"], r["family"]) for r in licenses.scan_licenses(frame, scratch).collect()}
    assert got == want and got
    odd = [*EDGES, (20, "released under the mit license"), (21, "text\n\nThis file is licensed under the Apache License, version 2.0 only"), (20, "released under the mit license")]
    got = sorted((r["id"], r["line"], r["family"]) for r in licenses.scan_licenses(docs(odd), scratch).collect())
    assert got == [(20, 0, "MIT"), (20, 0, "MIT"), (21, 2, "Apache-2.0")]
    assert licenses.scan_licenses(docs(EDGES).limit(0), scratch).count() == 0


BSD = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
LGPL = ["This library is free software; you can redistribute it and/or", "modify it under the terms of the GNU Lesser General Public",
        "License as published by the Free Software Foundation; either", "version 2.1 of the License, or (at your option) any later version."]
MIT = ['Permission is hereby granted, free of charge, to any person obtaining a copy', 'of this software and associated documentation files (the "Software"), to deal',
       "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
       "copies of the Software, and to permit persons to whom the Software is", "furnished to do so, subject to the following conditions:"]


def test_wrapped_licenses(docs, real, scratch):
    """Notices wrapped over lines, with and without comment marks, several in a text or a line; many wrapped notices do not spoil the training."""
    plain = "\n".join
    two = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    rows = [(1, "\n".join(["int x;", "", *BSD, "", "int y;"])), (2, "\n".join(f" * {x}" for x in LGPL)), (3, "\r\n".join(f"# {x}" for x in ["", *MIT])), (4, two),
            (5, "\n".join(["Released under the MIT License."] * 3)), (6, plain([*BSD, *LGPL, *MIT])), (7, "Licensed under\nCC BY-NC 4.0."), (8, plain(BSD[1:]))]
    want = [(1, 2, "BSD"), (2, 0, "LGPL"), (3, 1, "MIT"), (4, 0, "Apache-2.0"), (4, 0, "MIT"), (5, 0, "MIT"), (5, 1, "MIT"), (5, 2, "MIT"), (6, 0, "BSD"), (6, 3, "LGPL"), (6, 7, "MIT"), (7, 0, "CC-BY-NC")]
    many = [(1000 + i, f"file {i}\n" + plain(f"// {x}" for x in (BSD, LGPL, MIT)[i % 3])) for i in range(60)]
    prose = [(10_000 + i, text) for i, (_, text) in enumerate(real[1][:100])]
    got = sorted((r["id"], r["line"], r["family"]) for r in licenses.scan_licenses(docs([*rows, *many, *prose]), scratch).collect() if r["id"] < 10_000)
    assert got == want + [(1000 + i, 1, ("BSD", "LGPL", "MIT")[i % 3]) for i in range(60)]


REWORDED = [("MIT", "This package is made available under the terms of the MIT licence."), ("Apache-2.0", "This software is distributed under the Apache License, Version 2.0; see the license file."),
            ("GPL", "this is free software: you may redistribute it and/or modify it under the GNU General Public License, either version 3 or any later version"),
            ("LGPL", "The library is released under the GNU Lesser General Public License version 3 or later"),
            ("BSD", "Redistribution and use in source and binary forms, changed or not, are permitted if the following conditions are met"),
            ("MPL-2.0", "These files are subject to the terms of the Mozilla Public License v 2.0"), ("CC-BY", "Our work is licensed under a Creative Commons Attribution 4.0 License"),
            ("CC-BY-SA", "Material is licensed under a Creative Commons Attribution-ShareAlike 4.0 License"), ("CC-BY-NC", "Pictures are licensed under a Creative Commons Attribution-NonCommercial 4.0 International license"),
            ("CC0", "The text is dedicated to the public domain under CC0 1.0"), ("Proprietary", "No part of this book may be reproduced without prior written permission. All rights reserved.")]


def test_reworded_licenses(docs, real, scratch):
    """A reworded notice of each family, amid prose, under the name the classifier gives it."""
    prose = [(10_000 + i, text) for i, (_, text) in enumerate(real[1])]
    rows = [(i, f"{prose[i][1]}\n{text}\n{prose[i + 20][1]}") for i, (_, text) in enumerate(REWORDED)]
    got = {(r["id"], r["line"], r["family"]) for r in licenses.scan_licenses(docs([*rows, *prose]), scratch).collect() if r["id"] < 10_000}
    assert {(i, rows[i][1].split("\n").index(text), family) for i, (family, text) in enumerate(REWORDED)} <= got


def test_unknown_windows_are_those_of_all_texts(spark, docs, scratch):
    """More texts than the sample of an earlier form, against plain Python; every window counts once, notices do not."""
    rng = random.Random(4)
    some = "the of and software licence permission notice shall be included in all copies or substantial portions part may version blue river stone".split()
    rows = [(i, " ".join(rng.choice(some) for _ in range(rng.choice([5, 33, 90])))) for i in range(2_500)]
    rows += [(3_000, rows[7][1]), (3_001, "Released under the MIT License."), *EDGES]
    known = licenses.templates(spark, scratch)
    codes = licenses.Codes(known)
    assert len(codes.names) == len({g for r in known.collect() for g in [*r["words"], *(f"{a} {b}" for a, b in zip(r["words"], r["words"][1:]))]})
    got = licenses.unknown_windows(docs(rows), known, codes, scratch, "text").collect()
    of = {name: c for c, name in codes.names.items()}
    want, templates = set(), [list(zip(r["words"], r["words"][1:])) for r in known.collect()]
    for _, text in rows:
        words = re.findall("[a-z0-9]+", (text or "").translate(LOWER))
        # texts that may hold a notice are left to the other tests
        if any(len(set(zip(words, words[1:])) & set(t)) * 2 >= len(set(t)) for t in templates):
            continue
        last = max(0, math.ceil((len(words) - licenses.WINDOW) / licenses.STEP))
        want |= {tuple(words[k * licenses.STEP:k * licenses.STEP + licenses.WINDOW]) for k in range(last + 1) if words}
    grams = Counter(tuple(sorted({of[g] for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))] if g in of})) for w in want)
    found = Counter(tuple(sorted(r["grams"])) for r in got)
    assert len(want) > 5_000 and not grams - found
    assert abs(sum(r["train"] for r in got) / len(got) - 0.5) < 0.05


def test_license_windows_by_hand(spark, docs, real, scratch):
    """Windows that the classifier passes, against numpy; the bound by which texts are left out loses none."""
    known = licenses.templates(spark, scratch)
    rows = [*real[1][:60], *[(500 + i, f"{real[1][i][1]} {text} {text}") for i, (_, text) in enumerate(REWORDED)], (600, " ".join(t for _, t in licenses.TEMPLATES)), (601, "MIT"), (602, "of the"), *EDGES]
    model = licenses.fit(real[0], known, scratch, "doc_id", "text")
    frame = licenses.texts(docs(rows), "doc_id", "text").withColumn("row", F.col("id"))
    got = {(r["row"], r["start"]) for r in licenses.likely(frame.filter("id is not null"), model).collect()}
    weights, start = {g: np.array(w, float) for g, w in model.rows}, np.array(model.intercepts, float)
    want = set()
    for name, text in rows:
        words = re.findall("[a-z0-9]+", (text or "").translate(LOWER))
        for at in range(0, len(words), licenses.STEP):
            part = words[at:at + licenses.WINDOW]
            found = {*part, *(f"{a} {b}" for a, b in zip(part, part[1:]))} & weights.keys()
            z = (start + sum((weights[g] for g in found), np.zeros(len(start)))) / licenses.SCALE
            p = np.exp(z - z.max())
            if found and name is not None and 1 - p[-1] / p.sum() >= model.least:
                want.add((name, at))
    repeated = {name for name, n in Counter(name for name, _ in rows).items() if n > 1}
    assert {x for x in got if x[0] not in repeated} == {x for x in want if x[0] not in repeated} and len(want) > 20
    kept = {r["doc_id"] for r in docs(rows).filter(licenses.supported(licenses.words(F.col("text")), model)).collect()}
    assert {name for name, _ in want} <= kept and len(kept) < len({name for name, _ in rows})


# personal data

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_by_hand(text):
    out = []
    for k, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and total % 10 == 0,
                    "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TANGLES = ["a@b.c@d.e", "a@b.cd_x@e.f", "@x.y", "a@b", "x..@a.b.c.", "1.2.3.4.5.6.7.8.9", "1.2.3.256 1.2.3.0004", "+1 (017) 555-7713+1 2", "4539 1488 0343 6467-1", "é+49 (0) 30-123456.7 ü",
           "a@b.c-d.e_f@g.h.i", "%+@-.-", "+1", "12 34", "1234 5678 9012 3452", "a@b..c", "0000.0.0.0", "٣.٣.٣.٣", "x@y.z" * 50, "+1(2)3.4-5 67890 ", "1.1.1.1.", "..1.2.3.4"]


def test_rules_equal_patterns(real):
    rng = np.random.default_rng(9)
    made = ["".join(rng.choice(list("a1@.+- ()_4é"), 60)) for _ in range(2000)]
    for text in [*TANGLES, *made, *(t for _, t in real[1])]:
        assert pii.base_spans(text) == spans_by_hand(text), text


def test_personal_data(docs, real, scratch):
    for frame, rows in (real, (docs(EDGES + [(100 + i, t) for i, t in enumerate(TANGLES)]), EDGES + [(100 + i, t) for i, t in enumerate(TANGLES)])):
        got = sorted([tuple(r) for r in pii.find_personal_data(frame, sample_windows=60, epochs=1).select("doc_id", "base_sha256", "spans").collect()], key=str)
        base = {sha(pii.written(spans_by_hand(t))) for _, t in rows}
        assert sorted([g[:2] for g in got], key=str) == sorted([(n, sha(pii.written(spans_by_hand(t)))) for n, t in rows], key=str) and base


def test_tagger_learns(real):
    """Windows of half the documents train, the other half's rule-found spans are found again; written-out forms are found too."""
    def windows(rows):
        out = [pii.window_tags(t, pii.base_spans(t), max(0, (a + b - pii.WINDOW) // 2)) for _, t in rows for a, b in pii.segments(t)]
        return out
    filler = [w for _, t in real[1][:50] for w in t.split() if w.isalpha()]
    rng = np.random.default_rng(0)
    train = windows(real[1][::2])[:300] + [pii.made_up(rng, filler) for _ in range(200)]
    test = windows(real[1][1::2])[:150] + [pii.made_up(rng, filler) for _ in range(100)]

    def arrays(rows):
        chars = np.zeros((len(rows), pii.WINDOW), np.int64)
        for i, (w, _) in enumerate(rows):
            chars[i, :len(w)] = pii.codes(w)
        return chars, np.array([[int(x) for x in t] for _, t in rows])
    tagger = pii.Tagger().train(*arrays(train))
    right = wrong = missed = 0
    for (text, tags), found in zip(test, tagger.spans([pii.codes(w) for w, _ in test])):
        want = set()
        for m in re.finditer("12*|34*|56*|78*", tags):
            want.add((m.start(), (int(m.group()[0]) - 1) // 2, m.end()))
        right, wrong, missed = right + len(want & set(found)), wrong + len(set(found) - want), missed + len(want - set(found))
    assert right / (right + wrong) > 0.8 and right / (right + missed) > 0.6


def test_segments_hold_whole_words():
    text = "Write to firstname.middle.lastname.department (at) example (dot) org.or.a.long.host.name now, " + "word " * 20 + "a@b " + "x" * 100 + "1" + "y" * 100
    parts = [text[a:b] for a, b in pii.segments(text)]
    assert len(parts) == 2 and "firstname.middle.lastname.department (at) example (dot) org.or.a.long.host.name" in parts[0] and parts[1].endswith("x" * 100 + "1" + "y" * 100)
    rng = np.random.default_rng(6)
    for _ in range(300):
        text = "".join(rng.choice(list("ab1@ \n"), 200, p=[.45, .4, .01, .01, .12, .01]))
        want = set()
        for m in re.finditer("[0-9@]", text):
            a, b = max(0, m.start() - pii.MARGIN), min(len(text), m.end() + pii.MARGIN)
            while a and text[a - 1] not in WHITE:
                a -= 1
            while b < len(text) and text[b] not in WHITE:
                b += 1
            want |= set(range(a, b))
        parts = pii.segments(text)
        assert sorted(want) == [i for a, b in parts for i in range(a, b)]


def test_a_long_segment_is_decoded_alone():
    """One digit-dense text among 600 short ones, in little memory; blocks of steps give what the whole gives."""
    tagger, rng = pii.Tagger(), np.random.default_rng(4)
    long = "".join(rng.choice(list("0123456789.;@ "), 1_000_000))
    short = [f"call {rng.integers(10**9)} or write to a{i}@b{i}.org now" for i in range(600)]
    assert pii.segments(long) == [(0, len(long))]
    lengths = [len(long), *map(len, short)]
    groups = pii._groups(lengths)
    assert sorted(i for g in groups for i in g) == list(range(601)) and groups[-1] == [0]
    assert all(len(g) * max(lengths[i] for i in g) <= pii.CELLS for g in groups[:-1])
    parts = [pii.codes(t).astype(np.uint8) for t in [long[:20_000], *short]]
    tracemalloc.start()
    found = tagger.spans(parts, 0.2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and found[0] == tagger.spans(parts[:1], 0.2)[0] and found[1:] == tagger.spans(parts[1:], 0.2)
    emit = rng.normal(0, 1, (700, 3, tagger.tags)).astype(np.float32)
    live = np.arange(700)[:, None] < [700, 650, 90]
    path = tagger._best(emit, live)
    whole = tagger._certainty(emit, live, path)
    marginal, kind = tagger._sums(emit, live)[0], np.maximum(path - 1, 0) // 2
    assert np.allclose(whole, np.take_along_axis(marginal[..., 1::2] + marginal[..., 2::2], kind[..., None].astype(int), 2)[..., 0])
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pii, "STEPS", 64)
        assert np.allclose(tagger._certainty(emit, live, path), whole)


def test_gradient():
    """The model's gradient equals differences of its loss."""
    rng = np.random.default_rng(0)
    tagger = pii.Tagger()
    chars, tags = rng.integers(0, pii.CHARS, (3, 7)), np.array([[0, 1, 2, 0, 3, 4, 4], [5, 6, 0, 0, 7, 8, 8], [0] * 7])

    def loss():
        emit = tagger.emissions(chars, True)[0]
        step = np.where(tagger.allowed, np.exp(tagger.p["t"]), 0)
        total = 0
        for row in range(3):
            now, path = np.exp(emit[0, row]) * np.where(tagger.begin, np.exp(tagger.p["s"]), 0), emit[0, row, tags[row, 0]] + tagger.p["s"][tags[row, 0]]
            for t in range(1, 7):
                now = (now @ step) * np.exp(emit[t, row])
                path += emit[t, row, tags[row, t]] + tagger.p["t"][tags[row, t - 1], tags[row, t]]
            total += np.log(now.sum()) - path
        return total / 3
    got = tagger.gradient(chars, tags)
    for name, p in tagger.p.items():
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(3)] + ([(int(chars[0, 2]), 1)] if name == "e" else []):
            keep = p[at]
            p[at] = keep + 1e-5
            high = loss()
            p[at] = keep - 1e-5
            low = loss()
            p[at] = keep
            assert got[name][at] == pytest.approx((high - low) / 2e-5, abs=1e-6)


# all

def test_empty_tables(spark, docs, scratch):
    none = docs(EDGES).limit(0)
    bench, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_dedup.drop_common_lines(none, scratch).count() == 0
    assert bottomk.near_duplicates(none, scratch).count() == 0
    assert run_index.repeated_spans(none, scratch).count() == 0
    assert katz.katz_scores(none, scratch).count() == 0
    assert mixture.mix_sources(none, scratch).count() == 0
    assert importance.resample(none, labels, scratch).count() == 0
    assert decontaminate.drop_contaminated(none, bench).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert decontaminate.contamination(docs(EDGES), bench).count() == len(EDGES)
