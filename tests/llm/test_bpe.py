import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

from .texts import corpus, frame

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "   ", "Hello<|endoftext|>World <|startoftext|>", "it's I'LL don't x's 123 ١٢ ½", "ΑΣ Σ ς ÀÉ é é ǅ İ ß ﬁ", "a b c\u0085d e\x1cf\x1dg\x00h", "漢字かな😀", "<|endoftext", "</w> a</w>b", "a" * 3000, "ab" * 2000, " ́x", "…--!!??''s 's't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def random_texts(n):
    rng = random.Random(3)
    ranges = [(32, 126), (0xA0, 0x24F), (0x300, 0x400), (0x2000, 0x2070), (0x3000, 0x30FF), (0x1F300, 0x1F600), (0, 32)]
    return ["".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_ids_and_text_equal_the_library(library, vocabulary):
    for text in [*ODD, *random_texts(1500), *(t for _, t in corpus() if t)]:
        want = library.encode(text, add_special_tokens=False).ids
        packed = vocabulary.encode(text.encode())
        assert packed == struct.pack(f"<{len(want)}I", *want), text[:80]
        assert vocabulary.decode(packed) == library.decode(want, skip_special_tokens=False)


def test_forced_boundaries_are_certain(vocabulary):
    for token in list(vocabulary.ids)[:5000]:
        own = token.removesuffix("</w>")
        assert not own or vocabulary.fragments(own) == [own]


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    text = " ".join(t for _, t in corpus() if t).encode()
    before = vocabulary.encode(text)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert [vocabulary.encode(text) for _ in range(3)] == [before] * 3


def test_query(spark, library):
    rows = [*corpus(40), (7, "twice"), (7, "twice"), (None, "no id")]
    docs = frame(spark, [(*r, "x", 5) for r in rows], "doc_id long, text string, decoded string, n_tokens int")
    got = sorted(map(tuple, bpe.digest_query(docs, PATH).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_round_trip_of_packed_ids(spark):
    encoded = bpe.encode_documents(frame(spark, corpus(30)), PATH)
    again = {r.doc_id: r.decoded for r in bpe.decode_documents(encoded, PATH).collect()}
    assert again == {r.doc_id: r.decoded for r in encoded.collect()}


def test_empty_table(spark):
    assert bpe.digest_query(frame(spark, []), PATH).count() == 0
