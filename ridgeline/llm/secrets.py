"""Secret scans: three patterns, and a character convolutional network over every further candidate.

The patterns find what has a fixed form; their findings always stay. Every other candidate (a long run of token
characters with a digit and a letter in it) is read by a small network in numpy with the characters around it: one-hot
classes of characters plus a mark of the candidate, a convolution, the greatest response of each filter, one linear
layer. It is trained on labelled findings: what the patterns found is a secret; plain tokens, and long candidates made of
plain tokens in a row, are not. Candidates of the texts themselves are to be judged and have no label.

``fit`` reads all documents and takes at most ``SAMPLE`` findings and as many plain examples, those of the least hashes; a
task keeps no more than these. A fifth of the distinct findings, and of the plain examples, is held out before anything else is
made of them. In both parts each secret stands a second time in the context of a plain example: a labelled secret that the
patterns miss. On the held-out part, of secrets never seen, the scores are calibrated (a logistic map) and a threshold is set
that recalls ``RECALL`` of them or more, midway between them and the others. All documents and whole texts are scanned.

Defined cases: a null or empty text has no span; offsets are code points, end exclusive; a candidate longer than the
network's window is read in overlapping windows and has their highest score; with fewer than ``least`` distinct findings
or plain examples to learn from, or a single value in all of them, there is no model and no span is added (``fit`` takes another
``least``, and ``scanned`` takes a model fitted on other documents, for tables that hold few); texts of any length are scanned whole;
repeated rows and null ids are scanned like others; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.texts import column, pieces, strings
from ridgeline.sources.stage import stored

KINDS = ("assign", "access", "hex", "model")
#: The contract's patterns. A run of [0-9a-f] or of what follows AKIA is always taken whole, so asking for
#: the least length inside the pattern drops just the failing matches; for assign that would not hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}+")
PLAIN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{3,}+")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")

#: Characters before a candidate, and in all, that the network reads; the step of windows over a long candidate.
BEFORE, LENGTH, STEP = 20, 84, 48
SAMPLE, LEAST, RECALL = 3000, 20, 0.98
FILTERS, SPAN = 24, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of what the patterns find."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters with a digit and a letter that touch no span of the patterns."""
    out = []
    for m in CANDIDATE.finditer(text):
        if MIXED.match(m[0]) and not any(a < m.end() and m.start() < b for a, _, b in base):
            out.append(m.span())
    return out


def ordinary(text: str, base: list[tuple[int, int, int]], most: int = 6) -> list[tuple[int, int]]:
    """A few plain tokens in a row, from a place by the text's hash on; none touches a span or holds a candidate."""
    at = zlib.crc32(text.encode("utf-8", "replace")) % max(1, len(text))
    out = []
    for m in chain(PLAIN.finditer(text, at), PLAIN.finditer(text, 0, at)):
        if not any(a < m.end() and m.start() < b for a, _, b in base) and not any(MIXED.match(c[0]) for c in CANDIDATE.finditer(m[0])):
            out.append(m.span())
            if len(out) == most:
                break
    return out


def joined(text: str, plain: list[tuple[int, int]]) -> tuple[str, int, int] | None:
    """A text with a long candidate made of plain tokens, as in names and paths, in the place of the first; and its span."""
    if not plain:
        return None
    a, b = plain[0]
    h = zlib.crc32(text[a:b].encode("utf-8", "replace"))
    own = [text[x:y].strip("+/_.=-") for x, y in plain]
    own.insert(h % (len(own) + 1), str(h % 3000))
    name = "-_/"[h // 3000 % 3].join(own[: 3 + h % 5]).replace(".", "-")
    before = text[max(0, a - BEFORE) : a]
    return (before + name + text[b : b + LENGTH], len(before), len(before) + len(name)) if CANDIDATE.fullmatch(name) else None


def classes() -> np.ndarray:
    """ASCII characters each their own class, all others one."""
    return np.minimum(np.arange(0x110000), 128).astype(np.uint8)


CLASS = classes()


def read_windows(text: str, start: int, end: int) -> np.ndarray:
    """Rows of 2 x LENGTH: classes of the characters (128 beyond the text), and whether each is in the candidate."""
    rows = []
    for at in range(start, max(start + 1, end - (LENGTH - BEFORE) + STEP), STEP):
        a = at - BEFORE
        part = text[max(0, a) : a + LENGTH]
        row = np.full((2, LENGTH), 128, np.uint8)
        row[1] = 0
        off = max(0, -a)
        row[0, off : off + len(part)] = CLASS[np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")]
        row[1, max(0, start - a) : max(0, min(LENGTH, end - a))] = 1
        rows.append(row)
    return np.stack(rows)


class Network:
    """Embedding of characters, convolution, rectifier, greatest response, linear layer."""

    def __init__(self, seed: int = 7, width: int = 8):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (129, width)), "w": rng.normal(0, 0.25, (SPAN * (width + 1), FILTERS)), "b": np.zeros(FILTERS), "v": rng.normal(0, 0.3, FILTERS), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        e = np.concatenate([self.p["e"][x[:, 0]], x[:, 1, :, None]], 2)
        cols = np.lib.stride_tricks.sliding_window_view(e, SPAN, 1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - SPAN + 1, -1)
        h = cols @ self.p["w"] + self.p["b"]
        at = h.argmax(1)
        top = np.maximum(np.take_along_axis(h, at[:, None], 1)[:, 0], 0)
        return top @ self.p["v"] + self.p["c"][0], (cols, at, top)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        z, (cols, at, top) = self.forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) / len(x)
        dh = dz[:, None] * self.p["v"] * (top > 0)
        seen = np.take_along_axis(cols, at[:, :, None], 1)  # what each filter's greatest response has read
        dcols = dh[:, :, None] * self.p["w"].T
        de, width = np.zeros_like(self.p["e"]), self.p["e"].shape[1]
        places = at[:, :, None] + np.arange(SPAN)
        letters = x[np.arange(len(x))[:, None, None], 0, places]
        np.add.at(de, letters.reshape(-1), dcols.reshape(*dcols.shape[:2], SPAN, width + 1)[..., :width].reshape(-1, width))
        return {"e": de, "w": np.einsum("nf,nfk->kf", dh, seen), "b": dh.sum(0), "v": dz @ top, "c": dz.sum(keepdims=True)}

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        first, second, t = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)), None, 0
        first, second = first
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                t += 1
                for k, g in self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> Network:
        """A logistic map from held-out scores to probabilities, and the highest threshold of that recall."""
        z = self.forward(x)[0]
        spread = max(float(z.std()), 1e-6)
        a, b = 1.0, 0.0
        u = (z - z.mean()) / spread
        for _ in range(300):
            d = 1 / (1 + np.exp(-(a * u + b))) - y
            a -= 0.5 * (float((d * u).mean()) + 1e-3 * a)
            b -= 0.5 * float(d.mean())
        self.scale, self.shift = a / spread, b - a * float(z.mean()) / spread
        p = np.sort(self.probability(x[y > 0.5]))
        most = float(p[int(np.floor((1 - recall) * len(p)))])
        # Any threshold up to ``most`` keeps the recall; of those that pass the fewest others, the middle one.
        others = self.probability(x[y < 0.5])
        self.threshold = (most + float(others[others < most].max(initial=0.0))) / 2
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([1 / (1 + np.exp(-(self.scale * self.forward(x[i : i + 512])[0] + self.shift))) for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)


def labelled(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """secret, x (the network's input) and its hash: all distinct findings and plain examples, or the ``most`` of the least
    hashes of each that a task has met."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})

        def add(y: int, text: str, a: int, b: int) -> None:
            x = read_windows(text, a, min(b, a + LENGTH - BEFORE))[0].tobytes()
            best[y][x] = xxhash.xxh3_64_intdigest(x) >> 1
            if len(best[y]) > 2 * most:
                shorten(y)

        def shorten(y: int) -> None:
            kept = sorted(best[y].items(), key=lambda e: e[::-1])[:most]
            best[y].clear()
            best[y].update(kept)

        for batch in pieces(batches, most=2 << 20):
            for text in strings(batch, "text"):
                base = base_spans(text)
                for start, kind, end in base:
                    # of an assignment the value alone, as a candidate would be met
                    add(1, text, ASSIGN.match(text, start).start(2) if kind == 0 else start, end)
                plain = ordinary(text, base)
                for a, b in plain[:2]:
                    add(0, text, a, b)
                if made := joined(text, plain):
                    add(0, *made)
        for y in (0, 1):
            shorten(y)
        rows = [(y, x, key) for y in (0, 1) for x, key in best[y].items()]
        arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["secret", "x", "key"])

    return docs.select("text").mapInArrow(read, "secret int, x binary, key long")


def least_hashes(every: DataFrame, y: int, most: int) -> list:
    """The ``most`` distinct rows of class ``y`` of the least hashes; first those under a hash that about twice as many reach."""
    own = every.where(F.col("secret") == y)
    n = own.count()
    cut = min((1 << 63) - 1, 2 * (most + 100) * (1 << 63) // max(n, 1))
    rows = own.where(F.col("key") <= cut).orderBy("key", "x").limit(most).collect()
    return rows if len(rows) == min(n, most) else own.orderBy("key", "x").limit(most).collect()


def moved(real: np.ndarray, other: np.ndarray, seed: int = 7) -> np.ndarray:
    """Each secret after what stands before a plain example."""
    out = real.copy()
    out[:, 0, :BEFORE] = other[np.random.default_rng(seed).integers(0, len(other), len(real)), 0, :BEFORE]
    return out


def value_of(x: np.ndarray) -> bytes:
    """The secret itself, without its context: what the mark covers."""
    return x[0][x[1] > 0].tobytes()


def split(real: np.ndarray, other: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Training and held-out inputs with their labels, split by the secret (or plain token) itself before any is copied."""
    parts = []
    for x in (real, other):
        values = [xxhash.xxh3_64_intdigest(value_of(row)) for row in x]
        least = sorted(set(values))[: -(-len(set(values)) // 5)]
        held = np.isin(np.array(values, np.uint64), np.array(least, np.uint64))
        parts.append((x[~held], x[held]))
    out = []
    for r, o in zip(*parts, strict=True):
        out.append((np.concatenate([r, moved(r, o), o]), np.repeat([1.0, 1.0, 0.0], [len(r), len(r), len(o)])))
    return out[0], out[1]


def fit(docs: DataFrame, least: int = LEAST, recall: float = RECALL) -> Network | None:
    """A trained, calibrated network; None if there is nothing to learn from: under ``least`` findings or plain examples."""
    every = stored(labelled(docs).dropDuplicates(["secret", "x"]), "labelled-tokens")
    rows = [least_hashes(every, y, SAMPLE) for y in (1, 0)]
    if min(map(len, rows)) < max(2, least):
        return None
    real, other = (np.stack([np.frombuffer(r.x, np.uint8).reshape(2, LENGTH) for r in own]) for own in rows)
    if min(len({value_of(x) for x in own}) for own in (real, other)) < 2:
        return None
    train, held = split(real, other)
    return Network().train(*train).calibrate(*held, recall)


def scanned(docs: DataFrame, model: Network | None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end, probability; null for the patterns' own), by start and kind."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = kept.value
        for batch in pieces(batches, most=4 << 20):
            spans, x, owner = [], [], []
            for i, text in enumerate(strings(batch, "text")):
                base = base_spans(text)
                spans.append([(a, k, b, None) for a, k, b in base])
                for a, b in candidates(text, base) if net else ():
                    w = read_windows(text, a, b)
                    x.append(w)
                    owner.append((i, a, b, len(w)))
            if owner:
                p, at = net.probability(np.concatenate(x)), 0
                for i, a, b, n in owner:
                    if (best := float(p[at : at + n].max())) >= net.threshold:
                        spans[i].append((a, 3, b, best))
                    at += n
            out = [[{"kind": KINDS[k], "start": a, "end": b, "probability": q} for a, k, b, q in sorted(own, key=lambda s: s[:2])] for own in spans]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.list_(kind))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, spans array<struct<kind string, start long, end long, probability double>>")
