"""Toxicity: a bidirectional gated recurrent network with attention pooling reads overlapping windows of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import Scratch

WINDOW, STRIDE = 64, 48  # words
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 15
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
GRAM = 4  # bytes of a word, its ends marked, that are one character input
SAMPLE_DOCS, SAMPLE_WINDOWS = 3_000, 12  # of each label, a third of them for the calibration; windows of a text that train
LEAST_TEXTS = 3  # in which a bucket must occur in training for its embedding to count
CHUNK_BYTES, CHUNK_WORDS, KEPT_WORDS = 2_000_000, 400_000, 200_000
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case."""
    return text.lower().split() if text else []


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words without the signs at their ends: a bucket for each word, the buckets of all their character grams, and the place of each word's first gram."""
    bare = [b"<" + (word.strip(_SIGNS) or word) + b">" for word in words]
    buckets = np.fromiter((xxhash.xxh32_intdigest(word) for word in bare), np.uint32, len(bare)).astype(np.int64) % WORD_BUCKETS
    data = np.frombuffer(b"".join(word.ljust(GRAM, b">") for word in bare), np.uint8).astype(np.uint64)
    sizes = np.fromiter((max(GRAM, len(word)) for word in bare), np.int64, len(bare))
    ends = np.cumsum(sizes)
    rolled = data[:len(data) - GRAM + 1]
    for i in range(1, GRAM):
        rolled = rolled * np.uint64(257) + data[i:len(data) - GRAM + 1 + i]
    own = np.ones(len(rolled), bool)  # no gram reaches into the next word
    for i in range(1, GRAM):
        own[ends[:-1] - i] = False
    grams = ((rolled[own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % GRAM_BUCKETS
    firsts = np.cumsum(sizes - GRAM + 1) - (sizes - GRAM + 1)
    return buckets, grams, firsts


def windows_of(n: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows over n words; they cover all of them. A text without words has one empty window."""
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)]


class Reader:
    """Word and character embeddings, a gated recurrent layer in each direction, attention over the window's words, and one output.

    A word's input is the embedding of its own bucket beside the mean of the embeddings of its character grams.
    """

    def __init__(self, seed: int = 7):
        rng, inputs = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        self.p = {"word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "char": rng.normal(0, 0.1, (GRAM_BUCKETS, CHAR_DIM)),
                  "att": rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)), "query": rng.normal(0, 0.3, HIDDEN), "out": rng.normal(0, 0.3, 2 * HIDDEN), "bias": np.zeros(1)}
        for d in "fb":  # update gate, reset gate, candidate
            self.p |= {"w" + d: rng.normal(0, 1 / np.sqrt(inputs), (inputs, 3 * HIDDEN)), "u" + d: rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)), "v" + d: np.zeros(3 * HIDDEN)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift = 1.0, 0.0  # of the calibration

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """(words, WORD_DIM + CHAR_DIM)."""
        buckets, grams, firsts = features(words)
        sums = np.add.reduceat(self.p["char"][grams], firsts, axis=0) if len(words) else np.zeros((0, CHAR_DIM), np.float32)
        counts = np.diff(np.append(firsts, len(grams)))[:, None]
        return np.concatenate([self.p["word"][buckets], sums / counts.astype(np.float32)], 1)

    def _gru(self, ahead: np.ndarray, live: np.ndarray, d: str, held: list | None = None) -> np.ndarray:
        """ahead: (time, rows, 3 HIDDEN), the inputs' share of the gates in the order of reading; live: (time, rows). States past a window's end stay as they are."""
        u, h = self.p["u" + d], HIDDEN
        state = np.zeros((ahead.shape[1], h), ahead.dtype)
        out = np.empty((*ahead.shape[:2], h), ahead.dtype)
        for t in range(len(ahead)):
            gates = 1 / (1 + np.exp(-(ahead[t, :, :2 * h] + state @ u[:, :2 * h])))
            z, r = gates[:, :h], gates[:, h:]
            near = np.tanh(ahead[t, :, 2 * h:] + (r * state) @ u[:, 2 * h:])
            new = np.where(live[t][:, None], state + z * (near - state), state)
            if held is not None:
                held.append((state, z, r, near))
            state = out[t] = new
        return out

    def _gru_back(self, grad: np.ndarray, live: np.ndarray, d: str, held: list, into: dict) -> np.ndarray:
        """Gradient by the inputs' share of the gates; adds to those of the recurrent weights."""
        u, h = self.p["u" + d], HIDDEN
        out = np.zeros((*grad.shape[:2], 3 * h), grad.dtype)
        carry = np.zeros_like(grad[0])
        for t in reversed(range(len(grad))):
            state, z, r, near = held[t]
            total = carry + grad[t]
            inner = np.where(live[t][:, None], total, 0)
            d_near = inner * z * (1 - near * near)
            d_held = d_near @ u[:, 2 * h:].T  # by r * state
            d_z, d_r = inner * (near - state) * z * (1 - z), d_held * state * r * (1 - r)
            out[t] = np.concatenate([d_z, d_r, d_near], 1)
            gates = out[t, :, :2 * h]
            into["u" + d][:, :2 * h] += state.T @ gates
            into["u" + d][:, 2 * h:] += (r * state).T @ d_near
            carry = np.where(live[t][:, None], inner * (1 - z) + d_held * r + gates @ u[:, :2 * h].T, total)
        return out

    def _pool(self, states: np.ndarray, live: np.ndarray):
        """Attention over the live words; a window without words is pooled to zeros."""
        key = np.tanh(states @ self.p["att"])
        weight = np.where(live, np.exp(key @ self.p["query"]), 0)
        weight = weight / np.maximum(weight.sum(0), 1e-9)
        return (weight[..., None] * states).sum(0), weight, key

    def window_logits(self, gates: tuple[np.ndarray, np.ndarray], cells: np.ndarray, live: np.ndarray) -> np.ndarray:
        """One logit for each window. gates: each known word's share of the gates in both directions; cells: (time, windows) numbers of words."""
        forward = self._gru(gates[0][cells], live, "f")
        backward = self._gru(gates[1][cells[::-1]], live[::-1], "b")[::-1]
        return self._pool(np.concatenate([forward, backward], 2), live)[0] @ self.p["out"] + self.p["bias"][0]

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"] + self.p["vf"], x @ self.p["wb"] + self.p["vb"]

    def gradient(self, words: list[bytes], cells: np.ndarray, live: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
        """Gradients and loss of windows (as columns of ``cells``, numbers in ``words``) with a target of 0 or 1 each."""
        buckets, grams, firsts = features(words)
        counts = np.diff(np.append(firsts, len(grams)))
        x = self.inputs(words)
        into = {k: np.zeros_like(v) for k, v in self.p.items()}
        held: dict = {"f": [], "b": []}
        ahead = self.shares(x)
        forward = self._gru(ahead[0][cells], live, "f", held["f"])
        backward = self._gru(ahead[1][cells[::-1]], live[::-1], "b", held["b"])[::-1]
        states = np.concatenate([forward, backward], 2)
        pooled, share, key = self._pool(states, live)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        guess = 1 / (1 + np.exp(-logit))
        loss = float((weight * np.where(target > 0, np.logaddexp(0, -logit), np.logaddexp(0, logit))).sum() / weight.sum())
        error = (weight * (guess - target) / weight.sum()).astype(x.dtype)
        into["out"], into["bias"] = pooled.T @ error, error.sum(keepdims=True)
        d_pooled = error[:, None] * self.p["out"]
        d_share = (states * d_pooled).sum(2)
        d_score = share * (d_share - (share * d_share).sum(0))
        d_key = d_score[..., None] * self.p["query"] * (1 - key * key)
        into["query"] = np.einsum("tn,tnk->k", d_score, key)
        into["att"] = np.einsum("tnh,tnk->hk", states, d_key)
        d_states = share[..., None] * d_pooled + d_key @ self.p["att"].T
        d_x = np.zeros_like(x)
        for d, grad, order in (("f", d_states[..., :HIDDEN], slice(None)), ("b", d_states[::-1, :, HIDDEN:], slice(None, None, -1))):
            by_gate = self._gru_back(grad, live[order], d, held[d], into)
            sums = np.zeros((len(x), by_gate.shape[2]), x.dtype)
            np.add.at(sums, cells[order].ravel(), by_gate.reshape(-1, by_gate.shape[2]))
            into["w" + d], into["v" + d] = x.T @ sums, sums.sum(0)
            d_x += sums @ self.p["w" + d].T
        np.add.at(into["word"], buckets, d_x[:, :WORD_DIM])
        np.add.at(into["char"], grams, np.repeat(d_x[:, WORD_DIM:] / counts[:, None].astype(x.dtype), counts, axis=0))
        return into, loss

    def best_windows(self, texts: list[list[bytes]], gates_of) -> tuple[np.ndarray, np.ndarray]:
        """For each text, given as words, the largest logit of its windows, and the window's start. ``gates_of`` gives numbers and shares of the gates of the words of some texts."""
        logits, starts = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_WORDS):
                size += len(texts[end])
                end += 1
            some = texts[at:end]
            numbers, gates = gates_of(some)
            offsets = np.cumsum([0, *map(len, some)])
            cuts = [(i, a, b) for i, words in enumerate(some) for a, b in windows_of(len(words))]
            cuts.sort(key=lambda c: c[2] - c[1])  # windows of like lengths go together
            for low in range(0, len(cuts), 2048):
                part = cuts[low:low + 2048]
                cells, live = fill([numbers[offsets[i] + a:offsets[i] + b] for i, a, b in part])
                found = self.window_logits(gates, cells, live)
                for (i, a, _), value in zip(part, found.tolist()):
                    if value > logits[at + i] or (value == logits[at + i] and a < starts[at + i]):
                        logits[at + i], starts[at + i] = value, a
            at = end
        return logits, starts

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -60, 60)))


def fill(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(time, windows) of word numbers, and whether a cell holds a word."""
    longest = max(1, max(map(len, windows)))
    cells, live = np.zeros((longest, len(windows)), np.int64), np.zeros((longest, len(windows)), bool)
    for i, window in enumerate(windows):
        cells[:len(window), i] = window
        live[:len(window), i] = True
    return cells, live


class Known:
    """Each word's share of the gates, worked out once for each different word of a task; begins anew when it holds ``KEPT_WORDS``."""

    def __init__(self, reader: Reader):
        self.reader, self.numbers = reader, {}
        self.gates = (np.zeros((1, 3 * HIDDEN), np.float32),) * 2  # row 0 is for cells without a word

    def __call__(self, texts: list[list[bytes]]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        if len(self.numbers) > KEPT_WORDS:
            self.__init__(self.reader)
        numbers, first = self.numbers, len(self.numbers)
        found = np.fromiter((numbers.setdefault(word, len(numbers) + 1) for words in texts for word in words), np.int64)
        fresh = list(numbers)[first:]
        if fresh:
            self.gates = tuple(np.concatenate([old, new]) for old, new in zip(self.gates, self.reader.shares(self.reader.inputs(fresh))))
        return found, self.gates


def train(reader: Reader, samples: list[tuple[list[list[bytes]], int]], epochs: int = 8, steps: int = 300, batch: int = 64, rate: float = 0.01, decay: float = 0.01, seed: int = 1) -> Reader:
    """Fit to samples of (windows as words, label), in ``epochs`` rounds or as many as make ``steps`` steps. In the first quarter of the rounds one window of each text, drawn anew, stands for its
    text; from then on the window that the network finds most toxic does, so that a toxic text's clean windows do not count as toxic. Adam; both labels weigh the same. Buckets that occur in
    fewer than ``LEAST_TEXTS`` texts get no embedding, so that a rare word cannot stand for the one text it is in; embeddings shrink by ``decay``."""
    rng, turn = np.random.default_rng(seed), 0
    epochs = max(epochs, -(-steps * batch // max(1, len(samples))))
    seen = {"word": np.zeros(WORD_BUCKETS, np.int64), "char": np.zeros(GRAM_BUCKETS, np.int64)}
    for windows, _ in samples:
        if own := list({word for window in windows for word in window}):
            buckets, grams, _ = features(own)
            seen["word"][np.unique(buckets)] += 1
            seen["char"][np.unique(grams)] += 1
    known = {k: (n >= LEAST_TEXTS).astype(np.float32)[:, None] for k, n in seen.items()}
    for k, mask in known.items():
        reader.p[k] *= mask
    m, v = ({k: np.zeros_like(p) for k, p in reader.p.items()} for _ in range(2))
    labels = np.array([label for _, label in samples])
    weights = np.where(labels > 0, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    flat = [window for windows, _ in samples for window in windows]
    firsts = np.cumsum([0, *(len(windows) for windows, _ in samples)])
    for epoch in range(epochs):
        if epoch < epochs / 4:
            chosen = [flat[rng.integers(a, b)] for a, b in zip(firsts[:-1], firsts[1:])]
        else:
            logits, _ = reader.best_windows(flat, Known(reader))
            chosen = [flat[a + int(np.argmax(logits[a:b]))] for a, b in zip(firsts[:-1], firsts[1:])]
        order = rng.permutation(len(samples))
        for low in range(0, len(order), batch):
            part = order[low:low + batch]
            numbers: dict[bytes, int] = {}
            cells, live = fill([np.array([numbers.setdefault(w, len(numbers)) for w in chosen[i]], np.int64) for i in part])
            if not numbers:
                continue
            turn += 1
            grads, _ = reader.gradient(list(numbers), cells, live, labels[part].astype(np.float32), weights[part].astype(np.float32))
            for k, g in grads.items():
                if k in known:
                    g *= known[k]
                    reader.p[k] *= np.float32(1 - rate * decay)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                reader.p[k] -= (rate * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return reader


def calibrate(reader: Reader, logits: np.ndarray, labels: np.ndarray, rounds: int = 300) -> Reader:
    """Scale and shift of a text's largest logit, by Newton steps with a little shrinkage towards scale 1 and shift 0."""
    x, w = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        grad = x.T @ (p - labels) + 0.1 * (w - [1.0, 0.0])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), grad)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    reader.scale, reader.shift = max(float(w[0]), 1e-3), float(w[1])
    return reader


def is_held_out(key: str) -> Column:
    """Whether the CRC-32 of the id as text is a multiple of 5; such rows' labels are not learned from. False for null."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def _sampled(docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str, text: str, sample_docs: int) -> DataFrame:
    """(label, checks, text) of at most ``sample_docs`` ids of each label, drawn by a hash of the id. Where rows share an id, the text with the smallest hash stands for it."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~is_held_out(key)).groupBy(F.col(key).alias("id")).agg((F.max("toxic") > 0).cast("int").alias("label"))
    drawn = [marks.filter(F.col("label") == label).orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample_docs) for label in (0, 1)]
    ids = scratch.put(drawn[0].union(drawn[1]).withColumn("checks", F.pmod(F.xxhash64("id", F.lit(29)), F.lit(3)) == 0))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    # at most 2 * sample_docs ids are broadcast
    return scratch.put(rows.join(F.broadcast(ids), "id").groupBy("id", "label", "checks").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).drop("id"))


def _some_windows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            words = plain_words(text)
            cuts = windows_of(len(words))
            if len(cuts) > most:
                rng = np.random.default_rng(xxhash.xxh32_intdigest(text))
                cuts = [cuts[i] for i in sorted(rng.choice(len(cuts), most, replace=False))]
            out.append([b" ".join(words[a:b]) for a, b in cuts])
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.binary()))], names=["label", "windows"])


def _text_logits(texts: list[bytes | None], reader: Reader, known: Known) -> tuple[np.ndarray, np.ndarray]:
    return reader.best_windows([plain_words(text) for text in texts], known)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, **options) -> Reader:
    """A reader trained on two thirds of a bounded sample and calibrated on whole texts of the rest (or of all, if that holds under 20 of a label).
    With labels of one kind only, or none, its scores are the share of toxic ones."""
    sample = _sampled(docs, labels, scratch, key, text, sample_docs).select("label", "checks", F.col("text").cast("binary").alias("text"))
    counts = {(r["label"], r["checks"]): r["n"] for r in sample.groupBy("label", "checks").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (counts.get((label, False), 0) + counts.get((label, True), 0) for label in (1, 0))
    reader = Reader()
    if not toxic or not clean:
        reader.scale, reader.shift = 0.0, 60.0 if toxic else -60.0
        return reader
    apart = min(counts.get(x, 0) for x in ((0, True), (1, True))) >= 20
    fitted = sample.filter(~F.col("checks")) if apart else sample
    rows = fitted.select("label", "text").mapInArrow(lambda it: _some_windows(it, sample_windows), "label int, windows array<binary>").collect()
    rows.sort(key=lambda r: (r["label"], [bytes(w) for w in r["windows"]]))
    train(reader, [([plain_words(bytes(w)) for w in r["windows"]], r["label"]) for r in rows], **options)
    shared = docs.sparkSession.sparkContext.broadcast(reader)

    def logits(batches):
        known = Known(shared.value)
        for batch in batches:
            found, _ = _text_logits(batch.column("text").to_pylist(), shared.value, known)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.float64())], names=["label", "logit"])
    checked = (sample.filter("checks") if apart else sample).select("label", "text").mapInArrow(logits, "label int, logit double").collect()
    checked.sort()
    return calibrate(reader, np.array([r["logit"] for r in checked]), np.array([r["label"] for r in checked], float))


def score(docs: DataFrame, reader: Reader, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_windows, first_word, last_word) for each row: the score of its most toxic window, between 0 and 1, the number of overlapping windows, and which words that window holds.

    Every window of the whole text is read. A null text is empty; a text without words is one empty window. Rows that share an id are texts of their own; a null id is an id; further columns are
    not read; an empty table gives an empty table. Equal texts get equal scores but for the order of floating-point sums.
    """
    shared = docs.sparkSession.sparkContext.broadcast(reader)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):  # a few texts at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or b"") <= CHUNK_BYTES):
                    size += len(texts[end] or b"")
                    end += 1
                words = [plain_words(text) for text in texts[at:end]]
                found, starts = shared.value.best_windows(words, known)
                sizes = np.array([len(w) for w in words])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, end - at), pa.array(shared.value.scores(found), pa.float64()), pa.array([len(windows_of(n)) for n in sizes.tolist()], pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(np.minimum(starts + WINDOW, sizes) - 1, pa.int64())], names=["id", "score", "n_windows", "first_word", "last_word"])
                at = end
    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, n_windows long, first_word long, last_word long").withColumnRenamed("id", key)


def toxicity(docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """:func:`score` of all rows of ``docs`` by a reader that is trained here on ``labels`` (key, toxic) of ids that are not held out.

    If an id has several labels, toxic counts; a null label or id is none. Training reads a bounded sample (``sample_docs`` ids of each label, ``sample_windows`` windows of a text) on the driver;
    the calibration and all scores are made where the texts lie, and only the reader, some 2 MB, is broadcast. No text is shuffled but the sample's.
    """
    return score(docs, fit(docs, labels, scratch, key, text, **options), key, text)
