"""Memory that a Python worker needs for whole texts."""

import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from tessella.llm import tokens
from tessella.llm.common import text_bytes

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_remembered_pieces_are_counted_with_what_they_take(path, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 100_000)
    coder, most = tokens.Encoder(path), 0
    blocks = [[f"w{block}x{i} the" for i in range(300)] for block in range(12)]
    for texts in blocks:
        ids, counts = coder.encode(*text_bytes(pa.array(texts)))
        most = max(most, len(coder.pieces))
        want = [coder.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [x for row in want for x in row] and counts.tolist() == [len(row) for row in want]
    # a piece of 1 to 6 bytes takes some 200 with its object, entry, number and places
    assert most < 3 * 100_000 / tokens.PIECE


def test_the_library_gets_few_pieces_at_a_time(monkeypatch):
    sizes = []
    coder = tokens.Encoder(WORDS)

    class Counted:
        def encode_batch_fast(self, some, **how):
            sizes.append(len(some))
            return library.encode_batch_fast(some, **how)

    library, coder.library = coder.library, Counted()
    texts = [f"{a}{b}{c}" for a in "abcdefghijklmnopqrstuvwxy" for b in "abcdefghijklmnopqrstuvwxy" for c in "klmnopqrst"]
    ids, counts = coder.encode(*text_bytes(pa.array(texts)))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [x for row in want for x in row] and counts.tolist() == [len(row) for row in want]
    assert len(sizes) > 1 and max(sizes) <= tokens.AT_ONCE


def test_batches_of_a_stage_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def look(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.range(0, 4000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 500) AS text")
    spark.conf.unset(key)
    try:
        corpus_pipeline.personal_data(spark, docs, "")
        rows = docs.mapInArrow(look, "n long, size long").collect()
        assert sum(r.n for r in rows) == 4000 and max(r.size for r in rows) < 6 << 20
        spark.conf.set(key, "1000000")
        corpus_pipeline.personal_data(spark, docs, "")
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)
