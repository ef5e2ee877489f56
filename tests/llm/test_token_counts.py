"""Token counts against the tokenizers library."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessella.llm import tokencount
from tessella.llm.common import text_bytes
from tests.conftest import SF
from tests.llm.conftest import ODD, frame

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def counted(texts):
    return tokencount.Counter(BYTES).counts(*text_bytes(pa.array(texts, pa.string()))).tolist()


def wanted(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_random_texts(library):
    random.seed(4)
    letters = "aab'stmdrevl \n\t.,!0123é日  ́  😀  ''\0"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    assert counted(texts) == wanted(library, texts)


def test_every_character(library):
    codes = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x3000, 0x110000, 997))
    codes = [c for c in codes if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)} b{chr(c)}\n" for c in codes[i : i + 64]) for i in range(0, len(codes), 64)]
    assert counted(texts) == wanted(library, texts)


def test_special_strings_and_long_pieces(library):
    random.seed(5)
    word = "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    texts = ["<|endoftext|>", "a<|endoftext|>'s b <|endoftext|>", "  <|endoftext|>  x", "<|endoftext|><|endoftext|>", "<|endoftext", None, "", " ", "x" * 60_000, "ab" * 9_000, word, "=-" * 3_000 + "a", "é" * 4_000, " " * 3_000 + "a"]
    assert counted(texts) == wanted(library, texts)


def test_long_pieces_by_round_and_by_rank(monkeypatch):
    random.seed(6)
    texts = ["".join(random.choice("aabbbcde") for _ in range(random.randint(2, 300))) for _ in range(200)]
    by_round = counted(texts)
    monkeypatch.setattr(tokencount, "LONG", 2)
    assert counted(texts) == by_round


def test_a_worker_forgets_and_counts_alike(library, monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 100)
    tool = tokencount.Counter(BYTES)
    texts = [f"words number {i} and {i * i}" for i in range(200)]
    for lo in range(0, 200, 20):
        assert tool.counts(*text_bytes(pa.array(texts[lo : lo + 20]))).tolist() == wanted(library, texts[lo : lo + 20])
        assert tool.size < 1000


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        tokencount.Counter(public_tokenizers.path("word_bpe_49k.json"))
    with open(BYTES, encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    path = tmp_path / "turned.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        tokencount.Counter(str(path))


def test_documents(spark, library, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r for r in tokencount.count_tokens(docs, BYTES).collect()}
    for (doc, text), tokens in zip(rows, wanted(library, [t for _, t in rows]), strict=True):
        assert (got[doc].n_bytes, got[doc].n_tokens, got[doc].over_limit) == (len((text or "").encode()), tokens, tokens > 512)
    found = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(odd, BYTES).collect()), key=str)
    expected = zip([r[0] for r in ODD], [len((r[1] or "").encode()) for r in ODD], wanted(library, [r[1] for r in ODD]), strict=True)
    assert found == sorted(expected, key=str)
    assert tokencount.count_tokens(none, BYTES).count() == 0


def test_merges_overlap_from_the_left():
    letters = {c: i for i, c in enumerate(tokencount.byte_characters())}
    merges = tokencount.Merges(letters | {"aa": 256, "aaa": 257}, [["a", "a"], ["aa", "a"]])
    data = np.frombuffer(b"aaaaaa" + b"aaa" + b"b", np.uint8)
    assert merges.survivors(data, np.array([0, 6, 9, 10])).tolist() == [3, 1, 1]


def test_over_limit_is_a_parameter(spark):
    got = tokencount.count_tokens(frame(spark, [(1, "one two three", None, None)]), BYTES, limit=2).first()
    assert (got.n_tokens, got.over_limit) == (3, True)
