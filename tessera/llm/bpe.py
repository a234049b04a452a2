"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be joined by a merge, so the text can be
cut there with certainty. ASCII white space is such a place on both sides: documents fall into chunks, chunks
into pre-tokens, pre-tokens into fragments at the remaining forced boundaries. Each fragment is merged by
itself (only a word's last one with the suffix) and the ids are concatenated; chunks and
pre-tokens recur, so the ids of recent ones are remembered.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from .common import as_bytes, map_batches

SCHEMA = "n_tokens long, token_ids binary, decoded string"
#: Longer chunks and pre-tokens are encoded each time; of each kind up to twice so many are remembered.
REMEMBERED_LENGTH, REMEMBERED = 64, 80_000
#: Fixed: the characters with the Unicode property White_Space.
SPACE = r"\t-\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Remembered:
    """Values by key; the older half of them is forgotten when there are too many."""

    def __init__(self):
        self.young, self.old = {}, {}

    def __call__(self, key, make):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is None:
                value = make(key)
            if len(key) <= REMEMBERED_LENGTH:
                self.young[key] = value
        return value

    def aged(self) -> None:
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young


class Vocabulary:
    """A tokenizer file of the word-end kind: NFC, white space dropped, lower case, byte-level merges, a suffix on a word's last token."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) for m in model["merges"]]
        self.inner = BPE(self.ids, merges, cache_capacity=0)
        self.last = BPE(self.ids, merges, cache_capacity=0, end_of_word_suffix=self.suffix) if self.suffix else self.inner
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.alphabet = byte_alphabet()
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split.replace("\\s", SPACE))
        self.inside = self.pairs_inside()
        self.chunks_known, self.pieces_known = Remembered(), Remembered()

    def pairs_inside(self) -> frozenset[str]:
        """The pairs of neighbouring bytes, as characters, that some token has; a boundary is forced at all others."""
        pairs: set[str] = set()
        for token in self.ids:
            own = token.removesuffix(self.suffix) if self.suffix else token
            pairs.update(own[i : i + 2] for i in range(len(own) - 1))
        return frozenset(pairs)

    def fragments(self, piece: str) -> list[str]:
        """A pre-token in byte characters, cut at its forced boundaries."""
        cuts = [0, *(i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in self.inside), len(piece)]
        return [piece[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_piece(self, piece: str) -> bytes:
        """The packed ids of a pre-token."""
        shown = piece if piece.isascii() and piece.isprintable() else "".join([self.alphabet[b] for b in piece.encode()])
        *others, last = self.fragments(shown)
        ids = [t.id for fragment in others for t in self.inner.tokenize(fragment)] + [t.id for t in self.last.tokenize(last)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_part(self, text: str) -> bytes:
        """The packed ids of text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()
        return b"".join([self.pieces_known(p, self.encode_piece) for p in self.pieces.findall(text)])

    def encode_chunk(self, chunk: bytes) -> bytes:
        """The packed ids of text that has no ASCII white space."""
        text = chunk.decode("utf-8", "replace")
        if self.specials and b"<" in chunk:
            return b"".join([struct.pack("<I", self.special[p]) if p in self.special else self.encode_part(p) for p in self.specials.split(text)])
        return self.encode_part(text)

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        known, chunks, encode_chunk = self.chunks_known.young.get, self.chunks_known, self.encode_chunk
        out = b"".join([known(c) or chunks(c, encode_chunk) for c in text.split()])
        chunks.aged()
        self.pieces_known.aged()
        return out

    def decode(self, packed: bytes) -> str:
        """The tokens with a space between, as the file names no decoder; unknown ids are left out."""
        names = self.names
        ids = np.frombuffer(packed, "<u4").tolist()
        try:
            return " ".join([names[i] for i in ids])
        except KeyError:
            return " ".join([names[i] for i in ids if i in names])


_loaded: dict[int, Vocabulary] = {}


def loaded(text: str) -> Vocabulary:
    """One vocabulary for each file and worker."""
    key = hash(text)
    if key not in _loaded:
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens, token_ids (little-endian unsigned 32-bit) and decoded.

    A null text counts as empty and gives no tokens and an empty decoded text; equal rows give equal rows; a
    null id stays null; other columns of docs are not read. The driver reads the vocabulary file and sends it
    to the workers (a few MB, whatever the corpus). No shuffle; memory holds one batch of texts.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        vocabulary = loaded(shared.value)
        packed = [vocabulary.encode(t) if t else b"" for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array([vocabulary.decode(p) for p in packed], pa.string())],
            names=[id_col, "n_tokens", "token_ids", "decoded"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), step, f"`{id_col}` {kind}, {SCHEMA}")


def decode_documents(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id_col and decoded for rows that hold packed ids; null ids give an empty text."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        vocabulary = loaded(shared.value)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vocabulary.decode(p or b"") for p in batch.column(1).to_pylist()], pa.string())], names=[id_col, "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return map_batches(encoded.select(F.col(id_col), F.col(ids_col)), step, f"`{id_col}` {kind}, decoded string")


def digest_query(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The columns of the query: ids and decoded text as SHA-256."""
    encoded = encode_documents(docs, vocabulary_path)
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
