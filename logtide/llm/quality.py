"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is its own measurements and those of the lines before and after it, each
cut into bins; neighbouring labels are tied by transition weights. Forward-backward gives each line's marginal, and
the marginals weighted by line length, passed through a fitted logistic curve, are the document's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.labelled import held_out, sample

#: Most labelled rows that are learned from, by label.
SAMPLE = {0: 2000, 1: 2000}
#: Lines of a training sequence; longer documents give several. Scoring takes a document whole.
CHUNK = 16
BINS = 10
_SPACE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _PIPE, _MARK, _HIGH = range(8)


def _classes() -> np.ndarray:
    kind = np.full(256, _MARK, np.int64)
    kind[128:] = _HIGH
    for chars, k in ((b" \t\n\x0b\x0c\r", _SPACE), (bytes(range(65, 91)), _UPPER), (bytes(range(97, 123)), _LOWER), (b"0123456789", _DIGIT), (b"#*$%&<>", _SYMBOL), (b"|", _PIPE)):
        kind[list(chars)] = k
    return kind


_CLASS = _classes()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Measurements ``(lines, features)`` and lengths in bytes of a whole text's lines; an empty text has one empty line."""
    data = (text or "").encode("utf-8", "replace")
    lines = data.split(b"\n")
    size = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    line = np.repeat(np.arange(len(lines)), size)[:-1]
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    n = np.bincount(line * 8 + kinds, minlength=8 * len(lines)).reshape(-1, 8).astype(np.float64)
    words = [x.split() for x in lines]
    count = np.fromiter(map(len, words), np.float64, len(lines))
    distinct = np.fromiter((len(set(w)) for w in words), np.float64, len(lines))
    echo = np.fromiter((sum(map(eq, w, w[1:])) for w in words), np.float64, len(lines))
    short = np.fromiter((sum(len(x) < 4 for x in w) for w in words), np.float64, len(lines))
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    times = np.fromiter(map(seen.__getitem__, lines), np.float64, len(lines))
    shown, some = np.maximum(n[:, 1:].sum(axis=1), 1), np.maximum(count, 1)
    letters = np.maximum(n[:, _UPPER] + n[:, _LOWER] + n[:, _HIGH], 1)
    full = n.sum(axis=0)
    same = np.full(len(lines), distinct.sum() / max(count.sum(), 1))
    whole = np.full(len(lines), full[_MARK] / max(full[1:].sum(), 1))
    return np.stack([
        np.log1p(size), n[:, _UPPER] / letters, n[:, _DIGIT] / shown, n[:, _SYMBOL] / shown, n[:, _PIPE] / shown,
        n[:, _MARK] / shown, shown / some, distinct / some, echo / some, short / some, np.minimum(times, 9), same, whole,
        np.full(len(lines), math.log1p(len(lines))), np.full(len(lines), math.log1p(count.sum())),
    ], axis=1).astype(np.float32), size


class LineField:
    """Weights of the field; small, fixed in size, sent to tasks with the function that scores."""

    def __init__(self, cuts: np.ndarray):
        self.cuts = cuts  # (features, BINS - 1)
        self.emit = np.zeros((3, cuts.shape[0], BINS))  # own, previous, next; favours good
        self.bias, self.move, self.curve = 0.0, np.zeros((2, 2)), (1.0, 0.0)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], axis=1)

    def evidence(self, b: np.ndarray) -> np.ndarray:
        f = np.arange(b.shape[1])
        out = self.bias + self.emit[0][f, b].sum(axis=1)
        if len(b) > 1:
            out[1:] += self.emit[1][f, b[:-1]].sum(axis=1)
            out[:-1] += self.emit[2][f, b[1:]].sum(axis=1)
        return out

    def marginals(self, score: np.ndarray) -> np.ndarray:
        """Chance of good for each line of one document, by normalised forward and backward passes."""
        (bb, bg), (gb, gg) = np.exp(self.move).tolist()
        e = np.exp(np.clip(score, -30, 30)).tolist()
        ahead, p, q = [], 1.0, 0.0  # (bad, good) chances before a line
        for k, w in enumerate(e):
            x, y = (1.0, w) if not k else (p * bb + q * gb, w * (p * bg + q * gg))
            p, q = x / (x + y), y / (x + y)
            ahead.append(q)
        out, x, y = [0.0] * len(e), 0.5, 0.5
        for k in range(len(e) - 1, -1, -1):
            good, bad = ahead[k] * y, (1 - ahead[k]) * x
            out[k] = good / (good + bad) if good + bad > 0 else ahead[k]
            x, y = bb * x + bg * e[k] * y, gb * x + gg * e[k] * y
            x, y = x / (x + y), y / (x + y)
        return np.array(out)

    def share(self, x: np.ndarray, size: np.ndarray) -> float:
        """Length-weighted mean of the marginals."""
        return float(np.average(self.marginals(self.evidence(self.bins(x))), weights=size))

    def score(self, good: np.ndarray, size: np.ndarray) -> float:
        """The document's score from its lines' marginals."""
        s = min(max(float(np.average(good, weights=size)), 1e-6), 1 - 1e-6)
        z = self.curve[0] * math.log(s / (1 - s)) + self.curve[1]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _adam(params: list[np.ndarray], grad, steps: int, rate: float) -> None:
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, grad(), m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 120) -> LineField:
    """Fits the field to ``(label, features, lengths)`` of documents.

    Lines carry no labels, so they are set twice: first each line takes its document's label and a chainless field is
    fitted; then lines of bad documents that this field calls good become good, except the worst line of each, and the
    chain is fitted to those sequences by the exact gradient of their likelihood.
    """
    pieces = [(y, x[k : k + CHUNK], s[k : k + CHUNK]) for y, x, s in rows for k in range(0, len(x), CHUNK)]
    every = np.concatenate([p[1] for p in pieces]) if pieces else np.zeros((1, line_features("")[0].shape[1]), np.float32)
    net = LineField(np.quantile(every, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy())
    if len({y for y, _, _ in rows}) < 2:
        net.bias = 30.0 if rows and rows[0][0] else 0.0
        return net
    longest, n, wide = max(len(p[1]) for p in pieces), len(pieces), every.shape[1]
    own = np.full((n, longest + 2, wide), -1, np.int64)
    y, weight = np.zeros((n, longest), np.int64), np.zeros((n, longest))
    for k, (label, x, s) in enumerate(pieces):
        own[k, 1 : len(x) + 1], y[k, : len(x)], weight[k, : len(x)] = net.bins(x), label, 1.0
    there = weight > 0
    code = np.where(own < 0, wide * BINS, own + np.arange(wide) * BINS)
    near = [code[:, 1:-1], code[:, :-2], code[:, 2:]]
    table, bias, move = np.zeros((3, wide * BINS + 1)), np.zeros(1), np.zeros((2, 2))
    labels_weight = np.where(y == 1, 0.5 / max((y[there] == 1).sum(), 1), 0.5 / max((y[there] == 0).sum(), 1)) * there

    def evidence() -> np.ndarray:
        return bias + sum(t[c].sum(axis=2) for t, c in zip(table, near))

    def push(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g = np.stack([np.bincount(c[there].ravel(), np.repeat(d[there], wide), minlength=wide * BINS + 1) for c in near])
        g[:, -1] = 0
        return g + 1e-5 * table, np.array([d.sum()])

    def plain() -> list[np.ndarray]:
        return list(push((1 / (1 + np.exp(-evidence())) - y) * labels_weight))

    _adam([table, bias], plain, steps, 0.05)
    first = np.where(there, evidence(), np.inf)
    bad = np.array([p[0] == 0 for p in pieces])
    y[bad] = (first[bad] > 0) & there[bad]
    y[np.flatnonzero(bad), first[bad].argmin(axis=1)] = 0

    def chain() -> list[np.ndarray]:
        e = np.stack([np.zeros_like(first), np.clip(evidence(), -30, 30)], axis=2)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(a[:, t - 1, :1] + move[0], a[:, t - 1, 1:] + move[1]) + e[:, t]
            a[:, t] = np.where(there[:, t, None], step, a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            z = b[:, t + 1] + e[:, t + 1]
            b[:, t] = np.where(there[:, t + 1, None], np.logaddexp(move[:, 0] + z[:, :1], move[:, 1] + z[:, 1:]), 0)
        total = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        d = (np.exp(a[:, :, 1] + b[:, :, 1] - total[:, None]) - y) * there / n
        both = there[:, 1:]
        pair = np.exp(a[:, :-1, :, None] + move + (e + b)[:, 1:, None, :] - total[:, None, None, None]) * both[..., None, None]
        g = pair.sum(axis=(0, 1))
        np.subtract.at(g, (y[:, :-1][both], y[:, 1:][both]), 1)
        return [*push(d), g / n + 1e-3 * move]

    _adam([table, bias, move], chain, steps, 0.03)
    net.emit, net.bias, net.move = table[:, :-1].reshape(3, wide, BINS), float(bias[0]), move
    share = np.clip([net.share(x, s) for _, x, s in rows], 1e-6, 1 - 1e-6)
    z, want, curve = np.log(share / (1 - share)), np.array([r[0] for r in rows]), [np.ones(1), np.zeros(1)]

    def logistic() -> list[np.ndarray]:
        d = 1 / (1 + np.exp(-np.clip(curve[0] * z + curve[1], -40, 40))) - want
        return [np.array([(d * z).mean()]) + 1e-3 * curve[0], np.array([d.mean()])]

    _adam(curve, logistic, 400, 0.05)
    net.curve = (float(curve[0][0]), float(curve[1][0]))
    return net


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", per_class: dict[int, int] | None = None) -> LineField:
    """Measures a bounded sample of labelled rows on the executors and fits the field to the measurements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [line_features(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([s.tobytes() for _, s in got], pa.binary())], ["id", "label", "x", "s"])

    picked = sample(docs, labels, target, per_class or SAMPLE)
    schema = f"id {dict(picked.dtypes)['id']}, label int, x binary, s binary"
    wide = line_features("")[0].shape[1]
    rows = picked.select("id", "text", "label").mapInArrow(run, schema).collect()
    rows.sort(key=lambda r: r.id)
    return fit([(r.label, np.frombuffer(r.x, np.float32).reshape(-1, wide), np.frombuffer(r.s, np.int64)) for r in rows])


def score(docs: DataFrame, net: LineField, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row for each input row: ``(id_col, held_out, score, predicted, n_lines, n_bad_lines)``.

    Null and empty texts are one empty line and get its score; repeated rows stay repeated; an empty table gives an
    empty table. Only the two named columns are read, other columns may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, lines, bad = [], [], []
            for t in b.column(1):
                x, size = line_features(t.as_py())
                good = net.marginals(net.evidence(net.bins(x)))
                out.append(net.score(good, size))
                lines.append(len(x))
                bad.append(int((good < 0.5).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array(lines, pa.int64()), pa.array(bad, pa.int64())], ["id", "score", "n_lines", "n_bad_lines"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, score double, n_lines long, n_bad_lines long")
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_lines", "n_bad_lines")
