import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from logtide.llm import bpe, packed

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip():
    rng = np.random.default_rng(1)
    for ids in ([], [0], [2**32 - 1, 0], rng.integers(0, 50, 5000), np.where(rng.random(3000) < 0.03, 2**31, 7)):
        ids = np.array(ids, dtype=np.uint32)
        assert (packed.unpack(packed.pack(ids)) == ids).all()
        for i, j in ((0, 1), (3, 1025), (1024, 2048), (2000, 4999), (1500, None)):
            assert (packed.unpack(packed.pack(ids), i, j) == ids[i:j]).all()


def test_files(spark):
    texts = [None, "", "some words here", "é " * 3000, "x"]
    df = spark.createDataFrame([(9 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(packed.read_tokens(packed.write_tokens(df, PATH)).collect())
    start = 0
    for r in rows:
        ids = np.array(bpe.tokenizer(PATH).encode(texts[9 - r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == 5 and packed.read_tokens(packed.write_tokens(df.limit(0), PATH)).count() == 0


def test_repeated_null_and_hot_ids_in_many_shards(spark):
    rng = np.random.default_rng(4)
    words = ["one", "two", "three", "four", "it's"]
    rows = [(int(i) if i < 40 else (None if i < 60 else 17), " ".join(rng.choice(words, rng.integers(0, 30))), b"", 5) for i in rng.integers(0, 120, 400)]
    df = spark.createDataFrame(rows + rows[:50], "doc_id long, text string, record binary, shard int")
    got = packed.read_tokens(packed.write_tokens(df, PATH, shards=9)).collect()
    key = lambda x: (x[0] is not None, x[0] or 0)
    ids = [(d, np.array(bpe.tokenizer(PATH).encode(t, add_special_tokens=False).ids + [2], "<u4")) for d, t, _, _ in rows + rows[:50]]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: (key(x), x[1:])) == sorted(((d, len(x), zlib.crc32(x.tobytes())) for d, x in ids), key=lambda x: (key(x), x[1:]))
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [key(r) for r in sorted(got, key=lambda r: r.start)] == sorted(map(key, got))


def test_words_are_encoded_once_and_the_store_of_them_is_bounded(monkeypatch):
    runs = ["", "Word", "word", "word.", "WORD%", "Élan", "ŉx", "İx", "don't", "a-b", "x9", "<|endoftext|>", "naïve!", "q" * 60, "ﬁx", "中文", ".", "µ", "éa", "ok)", "ok))", "Straße"]

    def check(known, words):
        ids, size = known.table(pa.array(words, pa.string()))
        ends = np.cumsum(size)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, size)] == [bpe.tokenizer(PATH).encode(w, add_special_tokens=False).ids for w in words]

    known = bpe.Runs(PATH, bpe.LEAF)
    check(known, runs)
    sent = []
    real = known._words
    monkeypatch.setattr(known, "_words", lambda words: sent.extend(words.to_pylist()) or real(words))
    check(known, runs[::-1] + ["fresh,"])
    assert sent == ["fresh"]
    monkeypatch.setattr(bpe, "SEEN", 10)
    for k in range(6):
        check(known, [f"w{c}{'abcdef'[k]}" for c in "abcdefgh"])
        assert len(known.seen) <= 10
    check(known, [f"v{c}{d}" for c in "abcd" for d in "efgh"])
    check(known, ["", "12"]), check(known, [])
