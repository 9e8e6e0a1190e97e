import itertools
import math
import zlib

import numpy as np
import pytest

from logtide.llm import quality, queries, toxicity

D = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    net = quality.LineField(np.zeros((1, quality.BINS - 1)))
    net.move = rng.normal(size=(2, 2))
    e = rng.normal(size=6)
    total, good = 0.0, np.zeros(6)
    for labels in itertools.product((0, 1), repeat=6):
        w = math.exp(sum(x for x, y in zip(e, labels) if y) + sum(net.move[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        good += w * np.array(labels)
    assert np.allclose(net.marginals(e), good / total)


def test_network_gradient():
    texts = ["one two three four", "five two", "one"]
    names = sorted({w for t in texts for w in t.split()})
    net = toxicity.Network({"one": 1, "two": 2})
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    table = net.parts(names)
    ids = np.concatenate([toxicity.windows(np.array([names.index(w) for w in t.split()]), 5, 3) for t in texts])
    want, scale = np.array([1, 0, 1.0]), np.full(3, 1 / 3)

    def loss():
        p = 1 / (1 + np.exp(-net.run(net.inputs(*table) @ net.w["in"] + net.w["b"], ids)[0]))
        q = toxicity.NOISE + (1 - 2 * toxicity.NOISE) * p
        return -(scale * np.log(np.where(want == 1, q, 1 - q))).sum()

    g = net.learn(table, ids, want, scale)
    for name, p in net.w.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), p.shape)
        keep, step = p[at], 1e-2
        p[at] = keep + step
        up = loss()
        p[at] = keep - step
        down = loss()
        p[at] = keep
        assert math.isclose((up - down) / (2 * step), g[name][at], rel_tol=0.05, abs_tol=1e-5), name


def test_windows_cover_every_word():
    for n in (1, 47, 48, 49, 72, 73, 500):
        w = toxicity.windows(np.arange(n))
        assert set(w[w >= 0].tolist()) == set(range(n)) and w.shape[1] == toxicity.WINDOW


@pytest.mark.parametrize("query, target, least", [(queries.op3_quality, "quality", 0.97), (queries.op10_toxicity, "toxic", 0.95)])
def test_held_out_accuracy(spark, query, target, least):
    got = query(spark, D).toPandas()
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count() and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got.merge(spark.read.parquet(f"{D}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out]
    assert (both.predicted == both[target]).mean() >= least


@pytest.mark.parametrize("op, net", [(quality, quality.fit([])), (toxicity, toxicity.fit([]))])
def test_odd_rows(spark, op, net):
    rows = [(1, None, 5), (1, None, 5), (None, "", 6), (2, "word " * 50000, 7), (3, "x" * 200000, 7), (4, "\n\n", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = op.score(docs, net).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert op.score(docs.limit(0), net).count() == 0


def test_toxicity_scores_equal_a_plain_forward_pass(spark):
    """One word, one window and one number at a time, from the weights alone."""
    texts = ["the cat sat on the mat, quietly!", "", "x", " ".join(f"w{i % 9}" for i in range(110)), None]
    net = toxicity.Network({"the": 1, "cat": 2, "w3": 3}, seed=3)
    w, h = {k: v.astype(float) for k, v in net.w.items()}, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + math.exp(-x))

    def enter(word):
        bare = word if word.isalnum() else toxicity._EDGE.sub("", word)
        marked = b"<" + (bare or " ").encode() + b">"
        grams = [((marked[k] << 16) + (marked[k + 1] << 8) + marked[k + 2]) * 2654435761 // 256 % toxicity.TRIGRAMS for k in range(len(marked) - 2)]
        x = list(w["word"][net.vocabulary.get(bare, 0)]) + [sum(w["char"][g][j] for g in grams) / len(grams) for j in range(toxicity.CHAR_DIM)]
        return [sum(a * b for a, b in zip(x, w["in"][:, j])) + w["b"][j] for j in range(6 * h)]

    def direction(gates, u):
        state, out = [0.0] * h, []
        for g in gates:
            back = [sum(state[i] * u[i][j] for i in range(h)) for j in range(3 * h)]
            z, r = [sig(g[j] + back[j]) for j in range(h)], [sig(g[h + j] + back[h + j]) for j in range(h)]
            new = [math.tanh(g[2 * h + j] + r[j] * back[2 * h + j]) for j in range(h)]
            state = [new[j] + z[j] * (state[j] - new[j]) for j in range(h)]
            out.append(state)
        return out

    def window(words):
        gates = [enter(x) for x in words]
        ahead, behind = direction([g[: 3 * h] for g in gates], w["fwd"]), direction([g[3 * h :] for g in gates][::-1], w["bwd"])[::-1]
        states = [a + b for a, b in zip(ahead, behind)]
        weight = [math.exp(sum(math.tanh(sum(s[i] * w["att"][i][j] for i in range(2 * h)) + w["att_b"][j]) * w["att_v"][j] for j in range(h))) for s in states]
        return sum(a / sum(weight) * sum(s[i] * w["out"][i] for i in range(2 * h)) for a, s in zip(weight, states)) + w["out_b"][0]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    for i, t in enumerate(texts):
        words = toxicity.words_of(t)
        starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)
        assert math.isclose(got[i].score, sig(max(window(words[k : k + toxicity.WINDOW]) for k in starts)), rel_tol=1e-3), t


def test_quality_scores_equal_all_labellings(spark):
    """Every labelling of the lines weighed by itself."""
    good, bad = "a line of plain words that follow each other\nand one more of these lines\nthe end of it", "BUY $$$ NOW NOW NOW\n### ||| ###\nBUY $$$ NOW NOW NOW\nx x x x"
    rows = [(k % 2, *quality.line_features(good.replace("plain", f"p{k}") if k % 2 else bad + str(k))) for k in range(40)]
    net = quality.fit(rows, steps=30)
    texts = [good, bad, "one line", "", None, good + "\n" + bad]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs, net).collect()}
    for i, t in enumerate(texts):
        x, size = quality.line_features(t)
        bins = [[sum(v > c for c in net.cuts[f]) for f, v in enumerate(line)] for line in x.tolist()]
        part = lambda way, line: sum(net.emit[way][f][b] for f, b in enumerate(line))
        lines = [net.bias + part(0, b) + (part(1, bins[k - 1]) if k else 0) + (part(2, bins[k + 1]) if k + 1 < len(bins) else 0) for k, b in enumerate(bins)]
        total, share = 0.0, 0.0
        for labels in itertools.product((0, 1), repeat=len(lines)):
            weight = math.exp(sum(e for e, y in zip(lines, labels) if y) + sum(net.move[a, b] for a, b in zip(labels, labels[1:])))
            total += weight
            share += weight * sum(s for s, y in zip(size, labels) if y) / sum(size)
        s = min(max(share / total, 1e-6), 1 - 1e-6)
        want = 1 / (1 + math.exp(-max(-40.0, min(40.0, net.curve[0] * math.log(s / (1 - s)) + net.curve[1]))))
        assert math.isclose(got[i].score, want, rel_tol=1e-4, abs_tol=1e-6), t
    assert got[0].score > 0.5 > got[1].score


def test_sample_of_repeated_ids_is_the_same_every_time(spark):
    from logtide.llm import labelled

    docs = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "c", 2), (3, None, 3), (None, "d", 4), (7, "long" * 20, 5), (11, "e", 6), (4, "held out", 7)], "id long, text string, label int").withColumnRenamed("id", "doc_id")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (None, 1), (7, 1), (11, 1), (4, 1)], "doc_id long, toxic int")
    assert {zlib.crc32(str(i).encode()) % 5 == 0 for i in (1, 2, 3, 7, 11)} == {False}
    got = sorted(tuple(r) for r in labelled.sample(docs, labels, "toxic", {0: 5, 1: 5}, longest=50).select("id", "text", "label").collect())
    assert (1, "a", 0) in got and (11, "e", 1) in got and {i for i, _, _ in got} <= {1, 4, 11}
