"""The prefix table against the library."""

import random

import pytest
import sentencepiece

from quillfund.llm.pieces import default_model, encode_and_decode, load


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=default_model())


def strings(library):
    rng = random.Random(0)
    letters = "  ▁abAB01\n\té한🎉\x00ßeinthe.…" + "".join(chr(rng.randrange(32, 0x3000)) for _ in range(20))
    for k in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        yield " " * rng.randrange(40) + text + " " * rng.randrange(40) if k % 3 == 0 else text
    for _ in range(6000):
        yield "".join(library.id_to_piece(rng.randrange(259, 32000)).replace("▁", " ") for _ in range(rng.randrange(1, 5)))
    yield from ["", " ", "x" * 5000, " " * 3000, "<s> </s> <0x41>", "word " * 2000]


def test_same_as_library(library):
    pieces = load(default_model())
    for text in strings(library):
        ids = library.encode(text)
        assert pieces.encode(text) == ids
        assert pieces.decode(ids) == library.decode(ids)


def test_decode_any_ids(library):
    rng = random.Random(1)
    pieces = load(default_model())
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, *range(3, 300), *range(300, 32000, 97)]) for _ in range(rng.randrange(8))]
        assert pieces.decode(ids) == library.decode(ids)


def test_operator(spark, library):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "y"), (None, "é\n", None), (3, None, None), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, list(r.ids), r.decoded) for r in encode_and_decode(docs, default_model()).collect())
    assert got == sorted((i or 0, library.encode(t or ""), t or "") for i, t, _ in rows)
    assert encode_and_decode(docs.limit(0), default_model()).count() == 0


def test_other_models_are_refused(spark):
    model = default_model()
    for more, what in ((b"\x1a\x04\x12\x02ab", "normalises"), (b"\x1a\x02\x20\x01", "removes white space"), (b"\x1a\x04\x18\x00\x20\x00", "adds no mark"), (b"\x12\x02\x18\x01", "no BPE")):
        with pytest.raises(ValueError, match=what):
            load(model + more)
