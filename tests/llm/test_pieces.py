import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")

from kinset.llm.pieces import PieceModel, UnitCoder, decode_ids, encode_texts  # noqa: E402
from kinset.llm.queries import tokenizer_path  # noqa: E402

LIB = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


@pytest.fixture(scope="module")
def coder():
    return UnitCoder(tokenizer_path())


def ids_of(coder, text):
    raw, decoded = coder.text(text)
    return list(memoryview(raw).cast("i")), decoded


def test_equals_the_library(coder):
    rng = random.Random(1)
    letters = list("  \t\nabcdeethoniz. ,AB09é漢字😀▁-=_<>/(){}\x00")
    pieces = [p for p in coder.model.id_of]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(8000)]
    texts += [" " * k + x for k in range(40) for x in ("", "a", "the", "\n", " x  y")]
    for text in texts:
        ids, decoded = ids_of(coder, text)
        assert ids == LIB.encode(text)
        assert decoded == LIB.decode(ids) == coder.model.decode(ids)


def test_decodes_any_ids(coder):
    rng = random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000)]) for _ in range(10)]
        assert coder.model.decode(ids) == LIB.decode(ids)


def test_every_piece_encodes_to_itself():
    model = PieceModel(tokenizer_path())
    assert set(model.parts) == set(model.id_of.values())


def test_columns(docs, corpus, nothing):
    got = encode_texts(docs, tokenizer_path())
    assert got.columns == [*docs.columns, "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert r.ids == LIB.encode(r.text or "") and r.decoded == (r.text or "")
    back = decode_ids(got.select("text", "ids"), tokenizer_path())
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert encode_texts(nothing, tokenizer_path()).collect() == []
