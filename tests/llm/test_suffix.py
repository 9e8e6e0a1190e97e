import random
from collections import Counter

import pytest

from logtide.llm import skew, suffix


@pytest.mark.parametrize("keep_first, most", [(False, 4096), (True, 4096), (False, 1), (True, 1)])
def test_matches_all_strings(spark, keep_first, most, monkeypatch):
    if most == 1:
        monkeypatch.setattr(skew, "HOT", 3)
        monkeypatch.setattr(skew, "SMALL", 0)
    random.seed(5)
    word = lambda n: " ".join("".join(random.choices("abcé", k=5)) for _ in range(n))
    shared = word(80)
    texts = [None, "", "short", word(100), word(9) + shared + word(60), word(40) + shared, word(150), "ab" * 400, "cb" * 150, shared * 2 + word(3)]
    texts += [texts[6], texts[6][:300] + "X" + texts[6][300:]] + [word(2 + k) + shared[k:] for k in range(6)]
    data = [(t or "").encode() for t in texts]
    L = suffix.LENGTH
    count = Counter(d[i : i + L] for d in data for i in range(len(d) - L + 1))
    seen = set()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, th int")
    got = {r.doc_id: r for r in suffix.dedup(df, keep_first=keep_first, most=most).collect()}
    for i, d in enumerate(data):
        gone = [False] * len(d)
        for k in range(len(d) - L + 1):
            s = d[k : k + L]
            if (s in seen) if keep_first else count[s] > 1:
                gone[k : k + L] = [True] * L
            seen.add(s)
        assert bytes(got[i].kept) == bytes(b for b, g in zip(d, gone) if not g), i
        assert got[i].n_removed == sum(gone)
        assert got[i].n_spans == sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
    assert suffix.dedup(df.limit(0)).count() == 0


def test_repeated_rows_are_one(spark):
    random.seed(6)
    word = lambda n: " ".join("".join(random.choices("abc", k=5)) for _ in range(n))
    shared = word(80)
    a, b = word(30) + shared, shared + word(30)
    df = spark.createDataFrame([(1, a), (1, a), (2, b)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffix.dedup(df).collect())
    assert got == [(1, 0), (1, 0), (2, len(shared))]


def test_factor_lengths():
    rng = random.Random(3)
    for alphabet, n, most in ((b"ab", 120, 20), (b"a", 40, 13), (b"abcdefgh", 90, 7)):
        data = bytes(rng.choices(alphabet, k=n))
        starts = suffix.np.array(sorted(rng.sample(range(n - most), n // 2)))
        common = lambda i, j: next((k for k in range(most) if data[i + k] != data[j + k]), most)
        earlier, later = suffix.longest_factors(suffix.np.frombuffer(data, suffix.np.uint8), starts, most)
        for i, a, b in zip(starts, earlier, later):
            assert a == max((common(i, j) for j in starts if j < i), default=0)
            assert b == max((common(i, j) for j in starts if j > i), default=0)


def test_null_ids_come_first_and_long_texts_are_whole(spark):
    random.seed(7)
    word = lambda n: " ".join("".join(random.choices("abc", k=5)) for _ in range(n))
    shared, long = word(50), word(9000)
    rows = [(3, long + shared, 1), (None, shared + " x", 1), (4, "y" + long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    for most in (4096, 0):
        got = {r.doc_id: bytes(r.kept).decode() for r in suffix.dedup(df, most=most).collect()}
        assert got == {None: shared + " x", 3: long, 4: "y"}
