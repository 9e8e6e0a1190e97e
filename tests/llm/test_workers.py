import pyarrow as pa
import public_tokenizers

from logtide.llm import bpe, contamination, near, packed, rules, suffix
from logtide.llm.workers import tidy

PATH = public_tokenizers.path("word_bpe_49k.json")


def remembered(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(bpe._known)] * len(batch))], ["n"])


def test_tasks_drop_what_other_operators_left():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["id"])
    bpe.encode(PATH, ["some words"])
    assert [b.column(0).to_pylist() for b in tidy(remembered, "bpe")(iter([batch]))] == [[1, 1]]
    assert [b.column(0).to_pylist() for b in tidy(remembered)(iter([batch, batch]))] == [[0, 0], [0, 0]]
    assert bpe.encode(PATH, ["some words"])[0].tolist() == bpe.tokenizer(PATH).encode("some words", add_special_tokens=False).ids


def test_every_stage_tidies_its_workers(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(4)], "doc_id long, text string")
    used, real = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, func, schema, *more, **named: used.append(func.__name__) or real(self, func, schema, *more, **named))
    items = docs.selectExpr("string(doc_id) AS item_id", "text")
    for stage in (rules.ledger, near.near_copies, suffix.dedup, lambda d: contamination.contamination(d, items), lambda d: bpe.token_rows(d, PATH), lambda d: packed.read_tokens(packed.write_tokens(d, PATH))):
        stage(docs)
    assert len(used) > 15 and set(used) == {"tidied"}
