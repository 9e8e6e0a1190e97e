import hashlib
import random

import public_tokenizers
import pytest

from logtide.llm import bpe, html

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_and_text_match_the_library(spark):
    random.seed(3)
    signs = "ab'stre12éÉ́Σİıß中   ​\u0085\u001c\t\n!?x.—🙂"
    texts = [None, "", "it's<|endoftext|>é"] + ["".join(random.choices(signs, k=60)) for _ in range(60)] + ["abcdé" * 5000]
    t = bpe.tokenizer(PATH)
    df = spark.createDataFrame([(i, x, b"") for i, x in enumerate(texts)], "doc_id long, text string, ids binary")
    for r in bpe.digest(bpe.token_rows(df, PATH, leaf=512)).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("leaf", [3, 7, 64])
def test_tree(leaf):
    random.seed(leaf)
    t = bpe.tokenizer(PATH)
    for _ in range(100):
        text = "".join(random.choices("abcdetioné'1.", k=300))
        assert bpe.tree_encode(PATH, text, leaf) == t.encode(text, add_special_tokens=False).ids


def test_html(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href="/x">menu</a></nav><!-- ad --><div class="ad">Buy the thing of the day</div><article><h1>Head &amp; line</h1><p><b>First<br>one<p>The second of the blocks is long enough to be decided by itself, and it stays.</p><p>End.</p><div class="comments"><p>I like it</p></div></article><footer>&copy; us</footer>'
    rows = html.main_text(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")).collect()
    assert rows[0].text == "Head & line\nFirst one\nThe second of the blocks is long enough to be decided by itself, and it stays.\nEnd."
    assert rows[0].n_chars == len(rows[0].text)
    assert [r.text for r in rows[1:]] == ["", ""]


def test_long_texts_go_up_the_tree_like_the_library(spark):
    random.seed(9)
    words = ["".join(random.choices("abcdétion's1.", k=random.randint(1, 14))) for _ in range(400)] + ["<|endoftext|>", "İx", "é́"]
    gaps = [" ", " ", "\n", "　", "\u0085", "\x1c", "  "]
    texts = ["".join(random.choice(words) + random.choice(gaps) for _ in range(n)) for n in (5, 40, 300, 1500)] + ["x" * 900, " " * 700, "", None, "ab " * 300 + "é" * 800]
    t = bpe.tokenizer(PATH)
    for leaf in (5, 16, 100):
        for got, text in zip(bpe.encode(PATH, [x or "" for x in texts], leaf), texts):
            assert got.tolist() == t.encode(text or "", add_special_tokens=False).ids
    rows = [(None if i == 2 else i, x, i) for i, x in enumerate(texts)] + [(3, texts[3], 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    got = [(r.doc_id, bytes(r.ids), r.decoded) for r in bpe.token_rows(df, PATH, leaf=64, spread=200).collect()]
    ids = [t.encode(x or "", add_special_tokens=False).ids for _, x, _ in rows]
    want = [(r[0], b"".join(i.to_bytes(4, "little") for i in x), t.decode(x, skip_special_tokens=False)) for r, x in zip(rows, ids)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.token_rows(df.limit(0), PATH).count() == 0
