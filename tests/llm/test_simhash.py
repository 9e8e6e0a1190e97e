import numpy as np

from logtide.llm.simhash import fingerprint, simhash_components


def brute(ids, fps, radius=4):
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    label = np.array(ids)
    while True:
        new = np.where(near, label[None], 1 << 60).min(axis=1)
        if (new == label).all():
            return dict(zip(ids, label.tolist()))
        label = new


def test_components_match_all_pairs(spark):
    base = " ".join(f"w{i}" for i in range(300))
    texts = [base, base, base.replace("w7 ", "x "), "", None, "a b", "A  b", "z " * 9000] + [f"t{i} {base[i:i+90]}" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash_components(docs).collect()}
    fps = np.array([fingerprint(None if t is None else t.encode()) for t in texts], dtype=np.uint64)
    want = brute(list(range(len(texts))), fps)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(int(r.fingerprint, 16) == int(fps[i]) for i, r in got.items())
    assert got[3].fingerprint == "0" * 16 and got[4].component_id == 3


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_fingerprint(text):
    """From the definition, with whole numbers: words by pattern, a string for each shingle, each bit counted by itself."""
    import re

    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    found = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) > 4 else [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_from_the_definition(spark):
    rng = np.random.default_rng(2)
    signs = list("abAB éÉ\t\n\x0b\x0c\r\x1c\x85  1.中")
    texts = ["".join(rng.choice(signs, rng.integers(0, 200))) for _ in range(80)] + [None, "", "one two three four", "One two  three four five", "a " * 40000]
    rows = [(None if i < 3 else i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), int(r.fingerprint, 16)) for r in simhash_components(docs).collect())
    assert got == sorted((str(i), plain_fingerprint(t)) for i, t in rows)
    by = {}
    for i, t in rows:
        by.setdefault(plain_fingerprint(t), []).append(i)
    for r in simhash_components(docs).collect():
        assert r.n_copies == len(by[int(r.fingerprint, 16)])
