import random

import corpus_pipeline as p
from logtide.llm import near


def jaccard(a, b):
    x, y = (set(near.shingle_set(t.encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def edited(text, n, seed):
    words = text.split()
    for k in random.Random(seed).sample(range(len(words)), n):
        words[k] = f"edit{seed}x{k}"
    return " ".join(words)


def test_edited_copies_go_and_others_stay(spark):
    random.seed(5)
    base = [" ".join(random.choices([f"w{i}" for i in range(900)], k=60 + 40 * k)) for k in range(12)]
    texts = base + [edited(t, n, s) for s, (t, n) in enumerate((t, n) for t in base for n in (1, 2, 3, 5, 8, 13))]
    label = list(range(len(texts)))
    near_ones = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    for _ in texts:
        for i, j in near_ones:
            label[i] = label[j] = min(label[i], label[j])
    assert sum(0.8 <= jaccard(texts[i], texts[j]) < 0.9 for i, j in near_ones) > 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.near_duplicates(spark, docs, "").collect()) == sorted(set(label))


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, "a b")], "doc_id long, text string")
    got = {r.id: r.component for r in near.near_copies(docs).collect()}
    assert got[1] == got[2] == got[3] != got[None]
    assert near.near_copies(docs.limit(0)).count() == 0


def test_dense_group_hands_on_few_pairs_and_splits_nothing(spark):
    rng = random.Random(2)
    text = " ".join(f"v{k}" for k in range(400))
    rows = [(i, edited(text, 2, 100 + i)) for i in range(120)] + [(1000 + i, edited(edited(text, 9, 7), 1 + i % 3, i)) for i in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = {i: i for i, _ in rows}
    links = [(i, j) for i, s in rows for j, t in rows if i < j and jaccard(s, t) >= 0.8]
    for _ in range(6):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    got = {}
    for r in near.near_copies(docs).collect():
        got.setdefault(r.component, []).append(r.id)
    assert {i: min(v) for v in got.values() for i in v} == label
    small = {}
    for r in near.near_copies(docs, tile=4096).collect():
        small.setdefault(r.component, []).append(r.id)
    assert {i: min(v) for v in small.values() for i in v} == label
    nodes = spark.createDataFrame([(n, len(s), n[:16]) for s, n in ((s, near.node(s)) for s in (near.shingle_set(t.encode()) for _, t in rows))], "node binary, size long, label binary")
    found = near.tiles(nodes, 0.8)
    inside = near.tile_pairs(found, near.RADIUS, True)
    assert near.near_pairs(found, inside, forest=True).count() < len(rows) < near.near_pairs(found, inside).count()


def test_sketches_lose_no_pair():
    rng = random.Random(8)
    for n in (3, 40, 300, 1500):
        base = [rng.getrandbits(64) for _ in range(n)]
        rows = []
        for k in range(30):
            keep = rng.sample(base, n - n * k // 90)
            rows.append(near.np.unique(near.np.array(keep + [rng.getrandbits(64) for _ in range(n * k // 90)], near.np.uint64)))
        by = {}
        for k, r in enumerate(rows):
            by.setdefault(near.size_class(len(r), 0.8), []).append((near.node(r) + bytes(near.node(r)[:16]), r))
        sets = {bytes(m[:16]): set(r.tolist()) for v in by.values() for m, r in v}
        for q, v in by.items():
            a = near.Tile([m for m, _ in v])
            for p in (q, q + 1):
                b = a if p == q else near.Tile([m for m, _ in by.get(p, [])]) if p in by else None
                if b is None:
                    continue
                got = {(a.key[i].tobytes(), b.key[j].tobytes()) for i, j in zip(*near.candidates(a, b, 64, 0.8, p == q, False))}
                for i in range(len(a.key)):
                    for j in range(i + 1 if p == q else 0, len(b.key)):
                        x, y = a.key[i].tobytes(), b.key[j].tobytes()
                        if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) and x != y:
                            assert (x, y) in got
