"""Verified BPE against the tokenizers library."""

import random

import pytest
from tokenizers import Tokenizer

from folioweave.llm import bpe
from folioweave.llm.common import word_bpe_path

ODD = [
    None, "", "  ", "Don't STOP it's we'll ΣΑΣ İstanbul ½ Ⅷ x²  \x1c a\x1db \x85 q​z 　é é ́x", "a<|endoftext|>b <|startoftext|>",
    "<|ENDOFTEXT|>", "日本語テキスト 한국어 🙂👍🏽 العربية हिन्दी", "a" * 1200, "</w> </w></w> a</w>b", "ß ŉ ǅ ﬁ Å Å", "<|endoftext|><|endoftext|>",
    " \n <|endoftext|> \t x", "\0 \x7f", "ab" * 30_000,
]


@pytest.fixture(scope="module")
def model():
    with open(word_bpe_path(), "rb") as file:
        return bpe.WordBpe(file.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe_path())


def cases():
    rnd = random.Random(11)
    mixed = ["".join(rnd.choice("abcdefghijklmnop''  .,!?$0123éßñÜ\n\tЖ日🙂<|>/w") for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    return ODD + mixed + words


def test_ids_and_decoding_equal_the_library(model, library, monkeypatch):
    monkeypatch.setattr(model, "remembered", 700 * bpe.ENTRY)  # forget often
    for at in range(0, len(cases()), 256):
        texts = cases()[at : at + 256]
        for text, line in zip(texts, model.encode(texts)):
            want = library.encode(text or "", add_special_tokens=False).ids
            ids = [int(x) for x in line.split()]
            assert ids == want, text
            assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_both_merge_orders_agree(model):
    rnd = random.Random(2)
    for _ in range(400):
        symbols = model.symbols("".join(rnd.choice("thesandior") for _ in range(rnd.randint(1, 24))))
        assert model._merge_short(symbols) == model._merge_long(symbols)


def test_proposals_fail_and_are_mended(model):
    words = ["".join(random.Random(i).choice("thesandior") for _ in range(9)) for i in range(300)]
    exact = [model.exact(model.symbols(w)) for w in words]
    assert model.encode_pieces(words) == exact
    assert any(model.greedy(w) != e for w, e in zip(words, exact))


def test_tables(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(ODD[:8])] + [(0, "again", 2), (None, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    encoded = bpe.encode_texts(docs, word_bpe_path())
    assert sorted(r.n_tokens for r in encoded.collect()) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in rows)
    decoded = sorted(r.text for r in bpe.decode_ids(encoded, word_bpe_path()).collect())
    assert decoded == sorted(library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for _, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), word_bpe_path(), with_ids=True).count() == 0
