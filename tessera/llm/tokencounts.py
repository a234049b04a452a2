"""Token counts by offset-mapped attribution.

A document's fields are joined and encoded once, as a whole. The tokens' byte lengths give their spans, which
meet the spans of fields and sections in an interval join within the document. A token that crosses a border is
allocated by an explicit rule.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches

RULES = ("start", "most", "share")
#: The library's pattern matcher overflows its stack on longer runs of white space; texts that have one are matched apart.
BLANK_RUN = re.compile(r"\s{50000}")
SCHEMA = "field string, section int, first_char long, past_char long, n_tokens double, n_crossing long"


class Encoder:
    """A byte-level vocabulary file of ranks, whose tokens' bytes make up the text."""

    def __init__(self, data: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte after each token."""
        if BLANK_RUN.search(text):
            ids = [i for piece in self.pieces.finditer(text) for i in self.encoding._encode_single_piece(piece.group().encode())]
        else:
            ids = self.encoding.encode_ordinary(text)
        return np.cumsum(self.lengths[np.array(ids, np.int64)])


_loaded: dict[tuple[int, str], Encoder] = {}


def loaded(data: bytes, pattern: str) -> Encoder:
    key = (hash(data), pattern)
    if key not in _loaded:
        _loaded[key] = Encoder(data, pattern)
    return _loaded[key]


def allocated(ends: np.ndarray, borders: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section; ends: the byte after each token, borders: where sections begin, and the end.

    start: to the section of the token's first byte. most: to the section of most of its bytes, the first of
    equals. share: to each section by its share of the bytes. A crossing token is counted where it starts.
    """
    n = len(borders) - 1
    tokens, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not len(ends):
        return tokens, crossing
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.searchsorted(borders, ends - 1, side="right") - 1
    whole = first == last
    crossing += np.bincount(first[~whole], minlength=n)
    tokens += np.bincount(first if rule == "start" else first[whole], minlength=n)
    for k in np.flatnonzero(~whole) if rule != "start" else ():
        own = np.arange(first[k], last[k] + 1)
        size = np.minimum(ends[k], borders[own + 1]) - np.maximum(starts[k], borders[own])
        if rule == "most":
            tokens[own[np.argmax(size)]] += 1
        else:
            tokens[own] += size / size.sum()
    return tokens, crossing


def sections(fields: list[bytes]) -> tuple[list[int], list[int], np.ndarray]:
    """(field number, section number, borders in bytes) of the sections of fields joined by a line feed: their lines, each with its line feed."""
    of, number, sizes = [], [], []
    for k, text in enumerate(fields):
        lines = text.split(b"\n")
        of += [k] * len(lines)
        number += range(len(lines))
        sizes += [len(line) + 1 for line in lines]
    sizes[-1] -= 1
    return of, number, np.concatenate([[0], np.cumsum(sizes)])


def char_places(joined: bytes, borders: np.ndarray) -> np.ndarray:
    """Byte borders as code point borders."""
    if joined.isascii():
        return borders
    leading = (np.frombuffer(joined, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(leading)])[borders]


def attributed_tokens(docs: DataFrame, ranks_path: str, pattern: str, fields: tuple[str, ...] = ("text",), rule: str = "start", id_col: str = "doc_id") -> DataFrame:
    """One row for each section of each row of docs: id_col, field, section, first_char, past_char, n_tokens, n_crossing.

    The fields are joined by line feeds and encoded once; a section is a line of a field, with the line feed
    after it; first_char and past_char are code points of the joined text. Null fields count as empty, so an
    empty document has one section without tokens for each field. Repeated rows give their sections again, a null
    id stays null, an empty table gives an empty one; very long texts are read whole, other columns not at all.
    A document's tokens add up over its sections whatever the rule. No shuffle; the driver reads the vocabulary
    file, of fixed size, and sends it to the workers.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        encoder = loaded(shared.value, pattern)
        columns: list[list] = [[] for _ in range(7)]
        for row, texts in enumerate(zip(*(as_bytes(batch.column(k + 1)) for k in range(len(fields))))):
            texts = [t or b"" for t in texts]
            of, number, borders = sections(texts)
            joined = b"\n".join(texts)
            tokens, crossing = allocated(encoder.ends(joined.decode("utf-8", "replace")), borders, rule)
            places = char_places(joined, borders).tolist()
            for column, values in zip(columns, ([row] * len(of), [fields[k] for k in of], number, places[:-1], places[1:], tokens.tolist(), crossing.tolist())):
                column.extend(values)
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *map(pa.array, columns[1:], kinds)], names=["id", "field", "section", "first_char", "past_char", "n_tokens", "n_crossing"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), *map(F.col, fields)), step, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def lines_query(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The columns of the query: whole tokens of each line of each document, by where they start."""
    out = attributed_tokens(docs, ranks_path, pattern)
    return out.select("doc_id", "section", "first_char", "past_char", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")
