"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions trained in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.llm.common import WHITE, hash_bound, sha256, text_key

KINDS = ("email", "ip", "card", "phone")
# Documents whose rule-found spans train the model, segments of each, and windows of all, at most
SAMPLE_DOCS, SAMPLE_SEGMENTS, SAMPLE_WINDOWS = 4_000, 50, 700
WINDOW, STRIDE, MARGIN = 64, 32, 24
HIDDEN, CHARS, EMBEDDED = 16, 136, 10
CERTAIN = 0.9
# Padded characters that are decoded at once (a longer segment is decoded alone), and steps whose marginals are held
CELLS, STEPS = 1 << 17, 1 << 14

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Every span the model may add has one of these; text without any is all outside
_TRIGGER = re.compile(r"[0-9@]+|[\[({] ?at ?[\])}]| dot ")
_BLANK = re.compile(f"[{WHITE}]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the rules, in code points; matches of a kind do not overlap, those that fail its test are dropped."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, 0, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    for match in _NUMBERS.finditer(text):
        parts = [(m.start(), m.group()) for m in re.finditer("[0-9]+", match.group())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for _, p in four):
                found.append((match.start() + four[0][0], 1, match.start() + four[3][0] + len(four[3][1])))
    for match in _CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    for match in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in match.group()) <= 15:
            found.append((match.start(), 3, match.end()))
    return sorted(found)


def codes(text: str) -> np.ndarray:
    """Number of each character: ASCII by itself, digits all alike, the rest in eight groups."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(raw >= 128, 128 + raw % 8, np.where((raw >= 48) & (raw <= 57), 48, raw))


def segments(text: str) -> list[tuple[int, int]]:
    """Parts of a text round each trigger, up to the next blanks, merged where they touch."""
    out: list[tuple[int, int]] = []
    for match in _TRIGGER.finditer(text):
        done = out[-1][1] if out else -1
        a, b = max(0, match.start() - MARGIN), min(len(text), match.end() + MARGIN)
        if b > done:
            blank = _BLANK.search(text, b)
            b = blank.start() if blank else len(text)
        if a > done:
            a = max(text.rfind(blank, max(done, 0), a) for blank in WHITE) + 1
        if a <= done:
            out[-1] = (out[-1][0], max(b, done))
        else:
            out.append((a, b))
    return out


def _groups(lengths: list[int]) -> list[list[int]]:
    """Parts by length, in groups that have at most CELLS characters when each is padded to the longest; a longer part is a group of its own."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if out and (len(out[-1]) + 1) * lengths[i] <= CELLS:
            out[-1].append(i)
        else:
            out.append([i])
    return out


class Tagger:
    """Bidirectional LSTM over characters, a linear layer, and a CRF over outside, begin and inside of each kind."""

    tags = 1 + 2 * len(KINDS)

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.3, (CHARS, EMBEDDED)), "o": rng.normal(0, 0.3, (2 * HIDDEN, self.tags)), "c": np.zeros(self.tags),
                  "t": np.zeros((self.tags, self.tags)), "s": np.zeros(self.tags)}
        for d in "fb":
            self.p |= {"w" + d: rng.normal(0, 0.25, (EMBEDDED + HIDDEN, 4 * HIDDEN)), "v" + d: np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        # inside follows begin or inside of its kind only
        allowed = np.ones((self.tags, self.tags), bool)
        for k in range(len(KINDS)):
            allowed[:, 2 + 2 * k] = False
            allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
        self.allowed = allowed
        self.begin = np.array([t == 0 or t % 2 == 1 for t in range(self.tags)])

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x: (time, rows, EMBEDDED) in the direction of reading."""
        w, v, n, h = self.p["w" + d].astype(x.dtype), self.p["v" + d].astype(x.dtype), x.shape[1], HIDDEN
        state, cell = np.zeros((n, h), x.dtype), np.zeros((n, h), x.dtype)
        out, held = np.empty((*x.shape[:2], h), x.dtype), []
        ahead = x @ w[:EMBEDDED] + v
        for t in range(len(x)):
            gates = ahead[t] + state @ w[EMBEDDED:]
            sig = 1 / (1 + np.exp(-gates[:, :3 * h]))
            g = np.tanh(gates[:, 3 * h:])
            last, cell = cell, sig[:, h:2 * h] * cell + sig[:, :h] * g
            if keep:
                held.append((sig, g, last, np.tanh(cell), state))
            state = sig[:, 2 * h:] * np.tanh(cell)
            out[t] = state
        return out, held

    def _lstm_back(self, x, d, held, grad, into):
        w, h = self.p["w" + d], HIDDEN
        dh = dc = np.zeros_like(grad[0])
        gx = np.empty_like(x)
        for t in reversed(range(len(x))):
            sig, g, last, tc, state = held[t]
            i, f, o = sig[:, :h], sig[:, h:2 * h], sig[:, 2 * h:]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            d_gates = np.concatenate([dc * g * i * (1 - i), dc * last * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            into["w" + d] += np.concatenate([x[t], state], 1).T @ d_gates
            into["v" + d] += d_gates.sum(0)
            back = d_gates @ w.T
            gx[t], dh, dc = back[:, :EMBEDDED], back[:, EMBEDDED:], dc * f
        return gx

    def emissions(self, chars: np.ndarray, keep: bool = False):
        """chars: (rows, time) to (time, rows, tags)."""
        x = (self.p["e"] if keep else self.p["e"].astype(np.float32))[chars.T]
        forward, hf = self._lstm(x, "f", keep)
        backward, hb = self._lstm(x[::-1], "b", keep)
        both = np.concatenate([forward, backward[::-1]], 2)
        return both @ self.p["o"].astype(x.dtype) + self.p["c"].astype(x.dtype), (x, both, hf, hb)

    def _forward(self, emit: np.ndarray, live: np.ndarray, before: np.ndarray | None = None):
        """Scaled forward sums; before: those of the step ahead of the first, if there is one."""
        step = np.where(self.allowed, np.exp(self.p["t"]), 0)
        local = np.exp(emit - emit.max(2, keepdims=True)).astype(np.float64) + 1e-30
        ahead, scale = np.empty_like(local), np.empty(local.shape[:2])
        now = local[0] * np.where(self.begin, np.exp(self.p["s"]), 0) if before is None else before
        for t in range(len(emit)):
            if t or before is not None:
                now = np.where(live[t][:, None], (now @ step) * local[t], now)
            scale[t] = now.sum(1)
            ahead[t] = now = now / scale[t][:, None]
        return ahead, local, scale, step

    def _sums(self, emit: np.ndarray, live: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None):
        """Marginals (time, rows, tags), pair factors, of scaled forward and backward sums; live: (time, rows), false past a row's end.
        before and after: the sums that come in from the steps on both sides."""
        ahead, local, scale, step = self._forward(emit, live, before)
        back = np.ones_like(local)
        if after is not None:
            back[-1] = after
        for t in range(len(emit) - 2, -1, -1):
            back[t] = np.where(live[t + 1][:, None], (back[t + 1] * local[t + 1]) @ step.T / scale[t + 1][:, None], back[t + 1])
        marginal = ahead * back
        return marginal / marginal.sum(2, keepdims=True), ahead, back, local, scale, step

    def _certainty(self, emit: np.ndarray, live: np.ndarray, path: np.ndarray) -> np.ndarray:
        """(time, rows): the probability of the kind that the path gives. Only the sums between blocks of steps are held for the whole length."""
        starts = range(0, len(emit), STEPS)
        entering, out, after = [None], np.empty(path.shape), None
        for a in starts[:-1]:
            entering.append(self._forward(emit[a:a + STEPS], live[a:a + STEPS], entering[-1])[0][-1])
        for a, before in zip(reversed(starts), reversed(entering)):
            part = slice(a, a + STEPS)
            marginal, _, back, local, scale, step = self._sums(emit[part], live[part], before, after)
            after = np.where(live[a][:, None], (back[0] * local[0]) @ step.T / scale[0][:, None], back[0])
            first = np.maximum(path[part] - 1, 0) // 2 * 2 + 1
            out[part] = np.take_along_axis(marginal, first[..., None], 2)[..., 0] + np.take_along_axis(marginal, first[..., None] + 1, 2)[..., 0]
        return out

    def gradient(self, chars: np.ndarray, tags: np.ndarray) -> dict:
        emit, (x, both, hf, hb) = self.emissions(chars, True)
        live = np.ones(emit.shape[:2], bool)
        marginal, ahead, back, local, scale, step = self._sums(emit, live)
        n = chars.shape[0]
        into = {k: np.zeros_like(v) for k, v in self.p.items()}
        error = marginal.copy()
        rows = np.arange(n)
        for t in range(len(error)):
            error[t, rows, tags[:, t]] -= 1
        right = back[1:] * local[1:] / scale[1:][..., None]
        into["t"] = np.einsum("tna,tnb->ab", ahead[:-1], right) * step
        np.add.at(into["t"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        into["s"] = error[0].sum(0)
        into["o"], into["c"] = np.einsum("tnh,tnk->hk", both, error), error.sum((0, 1))
        d_both = error @ self.p["o"].T
        gx = self._lstm_back(x, "f", hf, d_both[..., :HIDDEN], into) + self._lstm_back(x[::-1], "b", hb, d_both[::-1, :, HIDDEN:], into)[::-1]
        np.add.at(into["e"], chars.T.ravel(), gx.reshape(-1, EMBEDDED))
        return {k: g / n for k, g in into.items()}

    def train(self, chars: np.ndarray, tags: np.ndarray, epochs: int = 10, batch: int = 50, rate: float = 0.02, seed: int = 1) -> Tagger:
        rng, turn = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = rng.permutation(len(chars))
            for a in range(0, len(order), batch):
                turn += 1
                part = order[a:a + batch]
                for k, g in self.gradient(chars[part], tags[part]).items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (0.6 if epoch > epochs * 0.6 else 1) * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.99**turn)) + 1e-8)
        return self

    def _windows(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Emissions of each part. Long parts are read in overlapping windows; where two meet, each counts by how far inside it the character lies."""
        cuts = [(i, a) for i, part in enumerate(parts) for a in [*range(0, max(1, len(part) - WINDOW), STRIDE), max(0, len(part) - WINDOW)]]
        cuts = sorted(set(cuts))
        totals = [np.zeros((len(part), self.tags), np.float32) for part in parts]
        weights = [np.zeros((len(part), 1), np.float32) for part in parts]
        place = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)[:, None] + 1
        for at in range(0, len(cuts), 2048):
            some = cuts[at:at + 2048]
            chars = np.zeros((len(some), WINDOW), np.int64)
            for row, (i, a) in enumerate(some):
                piece = parts[i][a:a + WINDOW]
                chars[row, :len(piece)] = piece
            emit = self.emissions(chars)[0]
            for row, (i, a) in enumerate(some):
                n = min(WINDOW, len(parts[i]) - a)
                totals[i][a:a + n] += emit[:n, row] * place[:n]
                weights[i][a:a + n] += place[:n]
        for t, w in zip(totals, weights):
            t /= w
        return totals

    def spans(self, parts: list[np.ndarray], certain: float = CERTAIN) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) in each part: windows' emissions are joined, then one best path over the whole part decides; a span stays if
        each of its characters has its kind with a probability of ``certain``."""
        out: list[list] = [[] for _ in parts]
        for some in _groups([len(part) for part in parts]):
            n = len(parts[some[-1]])
            emit, live = np.zeros((n, len(some), self.tags), np.float32), np.zeros((n, len(some)), bool)
            for row, (i, e) in enumerate(zip(some, self._windows([parts[i] for i in some]))):
                emit[:len(e), row], live[:len(e), row] = e, True
            path = self._best(emit, live)
            certainty = self._certainty(emit, live, path)
            for row, i in enumerate(some):
                tags = path[:len(parts[i]), row]
                for start in np.flatnonzero(tags % 2 == 1):
                    end = start + 1
                    while end < len(tags) and tags[end] == tags[start] + 1:
                        end += 1
                    if certainty[start:end, row].min() >= certain:
                        out[i].append((int(start), int((tags[start] - 1) // 2), int(end)))
        return out

    def _best(self, emit: np.ndarray, live: np.ndarray) -> np.ndarray:
        step = np.where(self.allowed, self.p["t"], -1e9)
        now = emit[0] + np.where(self.begin, self.p["s"], -1e9)
        back = np.empty(emit.shape, np.int8)
        same = np.arange(self.tags, dtype=np.int8)
        for t in range(1, len(emit)):
            choice = now[:, :, None] + step
            best = choice.argmax(1)
            back[t] = np.where(live[t][:, None], best, same)
            now = np.where(live[t][:, None], np.take_along_axis(choice, best[:, None], 1)[:, 0] + emit[t], now)
        path = np.empty(emit.shape[:2], np.int8)
        path[-1] = now.argmax(1)
        for t in range(len(emit) - 1, 0, -1):
            path[t - 1] = back[t, np.arange(emit.shape[1]), path[t]]
        return path


def window_tags(text: str, spans: list[tuple[int, int, int]], a: int) -> tuple[str, str]:
    """A window of a text with one digit for each character's tag; a span is cut at the window's ends. Later kinds give way to earlier ones."""
    tags = ["0"] * WINDOW
    for start, kind, end in reversed(spans):
        for i in range(max(start, a), min(end, a + WINDOW)):
            tags[i - a] = str(1 + 2 * kind if i == max(start, a) else 2 + 2 * kind)
    return text[a:a + WINDOW], "".join(tags)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        windows = []
        for text in batch.column("text").to_pylist():
            found = base_spans(text or "")
            for a, b in segments(text or "")[:SAMPLE_SEGMENTS]:
                windows.append(window_tags(text, found, max(0, (a + b - WINDOW) // 2)))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in windows], pa.string()), pa.array([t for _, t in windows], pa.string())], names=["window", "tags"])


def made_up(rng: np.random.Generator, filler: list[str]) -> tuple[str, str]:
    """A window with a span written in a way the rules do not know."""
    def number(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))
    name, host = (str(rng.choice(filler)).strip(".,|")[:12] or "name" for _ in range(2))
    at, dot = [(" (at) ", " (dot) "), (" [at] ", " [dot] "), (" (at) ", "."), (" [at] ", " dot ")][rng.integers(4)]
    kind, span = [(0, f"{name}{at}{host}{dot}com"), (3, f"({number(3)}) {number(3)}-{number(4)}"), (3, f"{number(3)}-{number(3)}-{number(4)}"), (3, f"00{number(2)} {number(3)} {number(7)}")][rng.integers(4)]
    left, right = (" ".join(rng.choice(filler, 6)) for _ in range(2))
    cut = int(rng.integers(4, 20))
    text = f"{left[-cut:]} {span} {right}"[:WINDOW].ljust(WINDOW)
    start = min(cut, len(left)) + 1
    return window_tags(text, [(start, kind, min(WINDOW, start + len(span)))], 0)


def fit_tagger(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, **options) -> Tagger:
    """Train on windows round the first ``SAMPLE_SEGMENTS`` segments of each of a bounded sample of texts, labelled by the rules, and on made-up spans in the same texts' words."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    some = docs.filter(F.xxhash64(F.col(key), F.lit(13)) <= hash_bound(share))
    rows = some.select(F.col(text).alias("text")).mapInArrow(_training, "window string, tags string") \
        .orderBy((~F.contains("tags", F.lit("1")) & ~F.contains("tags", F.lit("3")) & ~F.contains("tags", F.lit("5")) & ~F.contains("tags", F.lit("7"))).cast("int")
                 * F.pmod(F.xxhash64("window"), F.lit(2)), F.xxhash64("window")).limit(sample_windows).collect()
    windows = [(r["window"], r["tags"]) for r in rows]
    filler = [w for window, _ in windows for w in window.split() if w.isalpha()] or ["text"]
    rng = np.random.default_rng(3)
    windows += [made_up(rng, filler) for _ in range(sample_windows // 3)]
    chars = np.zeros((len(windows), WINDOW), np.int64)
    for i, (window, _) in enumerate(windows):
        chars[i, :len(window)] = codes(window)
    tags = np.array([[int(t) for t in tags] for _, tags in windows])
    return Tagger().train(chars, tags, **options)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("rule", pa.bool_())])


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    tagger: Tagger = shared.value
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        base, parts, whose = [], [], []
        for i, text in enumerate(texts):
            base.append(base_spans(text))
            for a, b in segments(text):
                parts.append(codes(text[a:b]).astype(np.uint8))
                whose.append((i, a))
        every = [list(x) for x in base]
        for (i, offset), found in zip(whose, tagger.spans(parts) if parts else ()):
            for start, kind, end in found:
                a, b = start + offset, end + offset
                if all(b <= x or a >= y for x, _, y in every[i]) and _TRIGGER.search(texts[i], a, b):
                    every[i].append((a, kind, b))
        spans = [[{"start": a, "kind": KINDS[k], "end": b, "rule": (a, k, b) in set(own)} for a, k, b in sorted(found)] for own, found in zip(base, every)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(spans, pa.list_(_SPAN)), pa.array([sha256(written(x).encode()) for x in base], pa.string()),
                                          pa.array([written(x) for x in every], pa.string())], names=["id", "text_key", "found", "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **sample) -> DataFrame:
    """(key, text_key, found, base_sha256, spans): personal data in each whole text, in code points, end exclusive.

    found has start, kind, end and whether a rule found the span; spans is the same as text ("kind:start:end", by start), base_sha256 the digest of the rules' part. The rules'
    spans always stay. The model reads the text round every digit, at sign and written-out at or dot (a span without any is not believed) in overlapping windows, joins the windows'
    scores, and decodes each part as a whole; certain spans that overlap no other are added.

    Null and empty texts have no spans; rows that share an id are texts of their own; a null id is an id; further columns are not read; an empty table gives
    an empty table. Only the model (a few thousand numbers) is broadcast; nothing is shuffled.
    """
    tagger = fit_tagger(docs, text, key, **sample)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    rows = docs.select(F.col(key).cast("long").alias("id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: _scan(it, shared), "id long, text_key long, found array<struct<start:long,kind:string,end:long,rule:boolean>>, base_sha256 string, spans string") \
        .withColumnRenamed("id", key)


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind}]"]
            done = end
    return "".join([*out, text[done:]])
