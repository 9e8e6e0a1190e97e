"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own vector (words that the sample holds often enough) beside the mean vector of its character
trigrams. Overlapping windows of words pass through both directions, attention pools their states, and a document's
score is that of its worst window. Every window of every text is scored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.labelled import held_out, sample

#: Most labelled rows that are learned from, by label.
SAMPLE = {0: 2000, 1: 600}
#: Words of a window, and words from one window's start to the next.
WINDOW, STEP = 48, 24
#: Windows that pass through the network together; bounds memory.
TOGETHER = 2048
#: Distinct words that a worker remembers; past that it starts afresh.
REMEMBERED = 200_000
WORD_DIM, CHAR_DIM, HIDDEN, TRIGRAMS, LEAST_DOCS = 16, 8, 12, 4096, 10
#: Share of labels taken to be wrong, so that such a row soon stops pulling.
NOISE = 0.05
_EDGE = regex.compile(r"^[^\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]+$")


def words_of(text: str | None) -> list[str]:
    """White-space words, lower-cased; an empty text has one empty word."""
    return (text or "").lower().split() or [""]


def windows(ids: np.ndarray, window: int = WINDOW, step: int = STEP) -> np.ndarray:
    """All windows of a text's word numbers, one for each row; -1 fills up the last."""
    n = 1 + max(0, -(-(len(ids) - window) // step))
    padded = np.full((n - 1) * step + window, -1, np.int64)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, window)[::step]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights; their size is fixed by the sample's bound, they go to tasks with the function that scores."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        g = np.random.default_rng(seed)
        h, e = HIDDEN, WORD_DIM + CHAR_DIM
        draw = lambda *s, by: (g.standard_normal(s) * by).astype(np.float32)
        self.vocabulary = vocabulary  # word to number from 1; 0 is any other word
        self.w = {
            "word": draw(len(vocabulary) + 1, WORD_DIM, by=0.1), "char": draw(TRIGRAMS, CHAR_DIM, by=0.1),
            "in": draw(e, 6 * h, by=e**-0.5), "b": np.zeros(6 * h, np.float32), "fwd": draw(h, 3 * h, by=h**-0.5), "bwd": draw(h, 3 * h, by=h**-0.5),
            "att": draw(2 * h, h, by=(2 * h) ** -0.5), "att_b": np.zeros(h, np.float32), "att_v": draw(h, by=h**-0.5), "out": draw(2 * h, by=(2 * h) ** -0.5), "out_b": np.full(1, -2, np.float32),
        }

    def parts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, and trigram numbers of all words in one row with the counts by word."""
        bare = [w if w.isalnum() else _EDGE.sub("", w) for w in words]
        number = np.fromiter((self.vocabulary.get(w, 0) for w in bare), np.int64, len(bare))
        marked = [b"<" + (w or " ").encode("utf-8", "replace") + b">" for w in bare]
        size = np.fromiter(map(len, marked), np.int64, len(marked))
        data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
        mixed = (((data[:-2] << np.uint64(16)) + (data[1:-1] << np.uint64(8)) + data[2:]) * np.uint64(2654435761) >> np.uint64(8)) % np.uint64(TRIGRAMS)
        inside = np.ones(len(data), bool)
        inside[np.cumsum(size) - 1] = inside[np.cumsum(size) - 2] = False
        return number, mixed[inside[:-2]].astype(np.int64), size - 2

    def inputs(self, number: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        start = np.cumsum(count) - count
        return np.concatenate([self.w["word"][number], np.add.reduceat(self.w["char"][grams], start) / count[:, None].astype(np.float32)], axis=1)

    def gates(self, words: list[str]) -> np.ndarray:
        """What each word adds to the gates of both directions; found once for each distinct word."""
        return self.inputs(*self.parts(words)) @ self.w["in"] + self.w["b"]

    def _direction(self, gates: np.ndarray, ids: np.ndarray, u: np.ndarray, order, tape: list | None) -> np.ndarray:
        h = HIDDEN
        state, out = np.zeros((len(ids), h), np.float32), np.empty((ids.shape[1], len(ids), h), np.float32)
        for t in order:
            at = ids[:, t]
            x, back = gates[at], state @ u
            zr = _sigmoid(x[:, : 2 * h] + back[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, 2 * h :] + r * back[:, 2 * h :])
            there = (at >= 0)[:, None]
            after = np.where(there, new + z * (state - new), state)
            if tape is not None:
                tape.append((t, state, back, z, r, new, there))
            state = out[t] = after
        return out

    def run(self, gates: np.ndarray, ids: np.ndarray, tapes: tuple[list, list] | None = None):
        """Window logits, and what learning needs of the way there."""
        h, w, steps = HIDDEN, self.w, range(ids.shape[1])
        f, b = tapes or (None, None)
        states = np.concatenate([self._direction(gates[:, : 3 * h], ids, w["fwd"], steps, f), self._direction(gates[:, 3 * h :], ids, w["bwd"], steps[::-1], b)], axis=2)
        seen = np.tanh(states @ w["att"] + w["att_b"])
        weight = np.where(ids.T >= 0, seen @ w["att_v"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        return pooled @ w["out"] + w["out_b"][0], states, seen, weight, pooled

    def learn(self, table: tuple, ids: np.ndarray, want: np.ndarray, scale: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted cross-entropy, under noisy labels, of windows ``ids``, whose words are numbered in ``table``."""
        h, w, tapes = HIDDEN, self.w, ([], [])
        x = self.inputs(*table)
        logit, states, seen, weight, pooled = self.run(x @ w["in"] + w["b"], ids, tapes)
        p = _sigmoid(logit)
        seen_toxic = NOISE + (1 - 2 * NOISE) * p  # chance that the label says toxic
        d = ((seen_toxic - want) / (seen_toxic * (1 - seen_toxic)) * (1 - 2 * NOISE) * p * (1 - p) * scale).astype(np.float32)
        g = {"out": pooled.T @ d, "out_b": d.sum(keepdims=True)}
        dp = d[:, None] * w["out"]
        ds = weight[:, :, None] * dp
        da = np.einsum("tbh,bh->tb", states, dp)
        da = weight * (da - (weight * da).sum(axis=0))
        g["att_v"] = np.einsum("tb,tbh->h", da, seen)
        dt = da[:, :, None] * w["att_v"] * (1 - seen * seen)
        g["att"], g["att_b"] = np.einsum("tbi,tbj->ij", states, dt), dt.sum(axis=(0, 1))
        ds = ds + dt @ w["att"].T
        dx = np.zeros((*ids.T.shape, 6 * h), np.float32)
        for k, (name, tape) in enumerate(zip(("fwd", "bwd"), tapes)):
            u, du, carry = w[name], np.zeros_like(w[name]), np.zeros((len(ids), h), np.float32)
            for t, state, back, z, r, new, there in reversed(tape):
                whole = ds[t, :, k * h : k * h + h] + carry
                live = np.where(there, whole, 0)
                dn = live * (1 - z) * (1 - new * new)
                dz = live * (state - new) * z * (1 - z)
                dr = dn * back[:, 2 * h :] * r * (1 - r)
                dx[t, :, 3 * h * k : 3 * h * (k + 1)] = np.concatenate([dz, dr, dn], axis=1)
                db = np.concatenate([dz, dr, dn * r], axis=1)
                du += state.T @ db
                carry = np.where(there, live * z, whole) + db @ u.T
            g[name] = du
        flat = ids.T.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 0) :]
        used, first = np.unique(flat[order], return_index=True)
        dg = np.add.reduceat(dx.reshape(-1, 6 * h)[order], first)
        g["in"], g["b"] = x[used].T @ dg, dg.sum(axis=0)
        dx = np.zeros_like(x)
        dx[used] = dg @ w["in"].T
        number, grams, count = table
        g["word"], g["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
        np.add.at(g["word"], number, dx[:, :WORD_DIM])
        np.add.at(g["char"], grams, np.repeat(dx[:, WORD_DIM:] / count[:, None].astype(np.float32), count, axis=0))
        return g

    def logits(self, gates: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(gates, ids[k : k + TOGETHER])[0] for k in range(0, len(ids), TOGETHER)])


def fit(rows: list[tuple[str, int]], seed: int = 7, all_windows: int = 2, worst_window: int = 4, rate: float = 0.01, decay: float = 2e-5, batch: int = 128) -> Network:
    """Trains on whole texts ``(text, label)``.

    In the first passes each window takes its document's label. In the later ones a document is judged, as in scoring,
    by its worst window under the weights of the time, so that harmless windows of toxic documents no longer mislead.
    """
    texts = [words_of(t) for t, _ in rows]
    held = Counter(w for t in texts for w in {_EDGE.sub("", x) for x in t} if w)
    net = Network({w: k for k, w in enumerate(sorted(w for w, n in held.items() if n >= LEAST_DOCS), 1)}, seed)
    names = sorted({w for t in texts for w in t})
    index = {w: k for k, w in enumerate(names)}
    if not rows:
        return net
    table = net.parts(names)
    begin = np.cumsum(table[2]) - table[2]
    cut = [windows(np.fromiter(map(index.__getitem__, t), np.int64, len(t))) for t in texts]
    ids, doc = np.concatenate(cut), np.repeat(np.arange(len(cut)), list(map(len, cut)))
    want = np.array([y for _, y in rows], np.float32)
    rng, m, v, t = np.random.default_rng(seed), {k: np.zeros_like(p) for k, p in net.w.items()}, {k: np.zeros_like(p) for k, p in net.w.items()}, 0
    for turn in range(all_windows + worst_window):
        if turn < all_windows:
            chosen = np.arange(0, len(ids))
        else:
            z = net.logits(net.gates(names), ids)
            order = np.lexsort((z, doc))
            chosen = order[np.flatnonzero(np.diff(doc[order], append=-1))]
        rng.shuffle(chosen)
        size = batch if turn < all_windows else batch // 4
        for k in range(0, len(chosen), size):
            part = ids[chosen[k : k + size]]
            used, small = np.unique(part, return_inverse=True)
            small = small.reshape(part.shape) - (used[0] < 0)
            used = used[used >= 0]
            grams = table[1][np.repeat(begin[used] - (np.cumsum(table[2][used]) - table[2][used]), table[2][used]) + np.arange(table[2][used].sum())]
            y = want[doc[chosen[k : k + size]]]
            g = net.learn((table[0][used], grams, table[2][used]), small, y, np.full(len(part), 1 / len(part), np.float32))
            t += 1
            for name, p in net.w.items():
                d = np.clip(g[name], -1, 1) + (decay * p if name in ("word", "char") else 0)
                m[name] += 0.1 * (d - m[name])
                v[name] += 0.005 * (d * d - v[name])
                p -= (rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.995**t)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", per_class: dict[int, int] | None = None) -> Network:
    """Fits the network to a bounded sample of labelled rows."""
    rows = sample(docs, labels, target, per_class or SAMPLE).select("id", "text", "label").collect()
    return fit([(r.text, r.label) for r in sorted(rows, key=lambda r: r.id)])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """One row for each input row: ``(id_col, held_out, score, predicted, n_windows)``.

    Null and empty texts are one empty word and get its score; repeated rows stay repeated; an empty table gives an
    empty table. Only the two named columns are read, other columns may have any name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        gates = np.empty((0, 6 * HIDDEN), np.float32)
        for whole in batches:
            for k in range(0, len(whole), 256):
                batch = whole.slice(k, 256)
                if len(known) > REMEMBERED:
                    known, gates = {}, gates[:0]
                ids, fresh = [], []
                for t in batch.column(1):
                    words = words_of(t.as_py())
                    for w in words:
                        if w not in known:
                            known[w] = len(known)
                            fresh.append(w)
                    ids.append(windows(np.fromiter(map(known.__getitem__, words), np.int64, len(words))))
                if fresh:
                    used = len(known) - len(fresh)
                    if len(known) > len(gates):
                        room = np.empty((max(len(known), 2 * len(gates)), 6 * HIDDEN), np.float32)
                        room[:used] = gates[:used]
                        gates = room
                    gates[used : len(known)] = net.gates(fresh)
                n = np.array(list(map(len, ids)), np.int64)
                worst = np.maximum.reduceat(net.logits(gates, np.concatenate(ids)), np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(worst.astype(np.float64))), pa.array(n)], ["id", "score", "n_windows"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = chosen.mapInArrow(run, f"id {dict(chosen.dtypes)['id']}, score double, n_windows long")
    return rows.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "n_windows")
