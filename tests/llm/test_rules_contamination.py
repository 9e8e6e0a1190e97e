import hashlib
import re
from collections import Counter

import pytest

from logtide.llm import contamination as decon
from logtide.llm import rules

TEXTS = [None, "", "a b c a b c", "One line\nOne line\n\nx #% é y", "w " * 30000, " ".join(f"q{i}" for i in range(80))]


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if wins[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)]


def test_ledger(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, failed int")
    rows = rules.ledger(df)
    got = {r.doc_id: [r[m] for m in rules.MEASURES[:5]] for r in rows.collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}
    kept = [r.doc_id for r in rows.where(rules.passes("v1")).collect()]
    assert kept == [5]
    assert {r.rule: r.n_failed for r in rules.ablations(rows, "base").collect()} == {"few_words": 4, "repeated_windows": 2}
    assert rules.ledger(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_contamination(spark, shard_bytes):
    long = " ".join(f"k{i}" for i in range(30))
    items = [("1", long), ("2", "Short item"), ("3", None), ("4", ""), ("10", "solo"), ("11", long)]
    docs = [(0, None), (1, ""), (2, f"x {long} y"), (3, "a short-ITEM b solo " + "z " * 400), (4, " ".join(long.split()[:12])), (5, long.replace(" ", "\n") + " é " * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = decon.digest(decon.contamination(df, spark.createDataFrame(items, "item_id string, text string"), shard_bytes=shard_bytes)).collect()
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda t: re.findall(word, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for r in rows:
        words, hit, names = low(dict(docs)[r.doc_id]), set(), set()
        for name, text in items:
            w = low(text)
            for k in range(max(1, len(w) - 12) if w else 0):
                win = w[k : k + 13]
                for at in range(len(words) - len(win) + 1):
                    if words[at : at + len(win)] == win:
                        hit |= set(range(at, at + len(win)))
                        names.add(name)
        assert (r.n_words, r.n_hit, r.n_items) == (len(words), len(hit), len(names))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(words))
