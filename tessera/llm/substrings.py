"""Substring dedup by relative Lempel-Ziv parsing.

Documents are factored against reference blocks. A window's anchor is its word group of smallest hash, and a
run of windows with one anchor is a block: equal windows have equal anchors, wherever they are, so whatever
repeats meets at its anchor. The index holds each different block once, with the document that has it first.

A document is parsed greedily from left to right: a factor begins at the first block that an earlier document has,
and takes in block after block as long as its source goes on with the same words; then the next factor begins. A
factor's ends lie within blocks that differ from the indexed ones with their anchor; the windows there are checked
one by one against the windows of those blocks, and lengthen the factor or make short ones. Factors of at least a
window's length become duplicate spans. The boundary check touches each different block once, so that neither
copies nor passages with many surroundings are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHashes, as_bytes, list_rows, map_batches, word_hashes, word_runs, written

#: Words of the group that anchors a window.
GROUP = 8


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each full window of so many values the place of its smallest one, the first of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        span += step
    return at[:n]


class Parsed:
    """Range hashes of the words of some documents, one after the other."""

    def __init__(self, words: list[list[bytes]]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.ranges = RangeHashes(word_hashes(words))
        self.n = int(self.ends[-1]) if len(words) else 0

    def blocks(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first window, last window, anchor hash, block hash) of each block; windows are counted in the document."""
        group = min(GROUP, window)
        n_groups = self.n - group + 1
        if self.n < window:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
        groups = self.ranges(np.arange(n_groups), np.arange(group, self.n + 1))
        anchor = leftmost_least(groups, window - group + 1)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[: len(anchor)]
        at = np.flatnonzero(np.arange(len(anchor)) + window <= self.ends[doc])
        if not len(at):
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
        new = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])])
        first = at[new]
        last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
        own = doc[first]
        return own, first - self.starts[own], last - self.starts[own], groups[anchor[first]], self.ranges(first, last + window)


def index_rows(docs: DataFrame, window: int) -> DataFrame:
    """(doc, anchor, block, firsts, windows) for each different block of each of docs (doc, text): where it begins, and its number of windows."""

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        for first, past, words in word_runs(as_bytes(batch.column(1))):
            own, lo, hi, anchor, block = Parsed(words).blocks(window)
            order = np.lexsort((lo, anchor, block, own))
            own, lo, hi, anchor, block = (x[order] for x in (own, lo, hi, anchor, block))
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1])])) if len(own) else np.empty(0, np.int64)
            ids = batch.column(0).slice(first, past - first).take(pa.array(own[new]))
            firsts = pa.ListArray.from_arrays(pa.array(np.append(new, len(own)).astype(np.int32)), pa.array(lo.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(anchor[new].view(np.int64)), pa.array(block[new].view(np.int64)), firsts, pa.array((hi - lo + 1)[new].astype(np.int32))], names=["doc", "anchor", "block", "firsts", "windows"])

    return map_batches(docs, step, f"doc {docs.schema['doc'].dataType.simpleString()}, anchor long, block long, firsts array<int>, windows int")


def window_rows(joined: DataFrame, window: int) -> DataFrame:
    """(doc, anchor, window, at) for the windows of the blocks listed with each document (doc, text, listed); no list, no rows."""

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        batch = batch.filter(batch.column(2).is_valid())
        for first, past, words in word_runs(as_bytes(batch.column(1))):
            parsed = Parsed(words)
            sizes, own = list_rows(batch.column(2).slice(first, past - first))
            row = np.repeat(np.arange(past - first), sizes)
            anchor, lo, hi = own["anchor"], own["first"].astype(np.int64), own["last"].astype(np.int64)
            count = hi - lo + 1
            block = np.repeat(np.arange(len(anchor)), count)
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + lo[block]
            start = parsed.starts[row[block]] + at
            hashes = parsed.ranges(start, start + window)
            ids = batch.column(0).slice(first, past - first).take(pa.array(row[block]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(anchor[block]), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int32))], names=["doc", "anchor", "window", "at"])

    return map_batches(joined, step, f"doc {joined.schema['doc'].dataType.simpleString()}, anchor long, window long, at int")


def factors(first: np.ndarray, windows: np.ndarray, source: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(match that begins it, first word, word after its last) of each factor of a document, by greedy parsing from left to right.

    Matches are runs of windows: where they begin, how many there are, and the document and place that they are
    copied from. A factor goes on as long as the next match follows in the document and in its source.
    """
    order = np.lexsort((windows, first))
    first, windows, source, at = first[order], windows[order], source[order], at[order]
    goes_on = (first[1:] == first[:-1] + windows[:-1]) & (at[1:] == at[:-1] + windows[:-1]) & (source[1:] == source[:-1])
    begins = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(first) else np.empty(0, np.int64)
    ends = np.append(begins[1:], len(first)) - 1 if len(first) else begins
    past = first[ends] + windows[ends] - 1 + window
    long = past - first[begins] >= window
    return order[begins[long]], first[begins[long]], past[long]


def cut_rows(joined: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept_text, removed_spans, factors) from (id, text, matches): runs of windows with their sources."""
    kind = joined.schema["id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        n_words, n_removed, kept, removed, begun, parsed, offsets = [], [], [], [], [], [], [0]
        sizes, own = list_rows(batch.column(2))
        at = np.concatenate([[0], np.cumsum(sizes)])
        for row, text in enumerate(as_bytes(batch.column(1))):
            words = text.split() if text else []
            part = slice(at[row], at[row + 1])
            begin, lo, hi = factors(*(own[c][part] for c in ("first", "windows", "source", "at")), window)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
            left = np.cumsum(edge[:-1]) == 0
            shift = np.diff(np.concatenate([[1], left.view(np.int8), [1]]))
            n_words.append(len(words))
            n_removed.append(len(words) - int(left.sum()))
            kept.append(b" ".join(compress(words, left.tolist()) if len(lo) else words))
            removed.append([{"first": a, "past": b} for a, b in zip(np.flatnonzero(shift == -1).tolist(), np.flatnonzero(shift == 1).tolist())])
            begun.append(begin + at[row])
            parsed.append(np.stack([lo, hi]))
            offsets.append(offsets[-1] + len(begin))
        places = pa.array(np.concatenate([*begun, np.empty(0, np.int64)]).astype(np.int64))
        matches = batch.column(2).flatten()
        lo, hi = np.concatenate([*parsed, np.empty((2, 0), np.int64)], axis=1).astype(np.int32)
        parse = pa.StructArray.from_arrays([pa.array(lo), pa.array(hi), matches.field("source").take(places), matches.field("at").take(places)], names=["first", "past", "source", "source_first"])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(removed, span_type), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parse)],
            names=["id", "n_words", "n_removed", "kept_text", "removed_spans", "factors"],
        )

    spans = "removed_spans array<struct<first:int,past:int>>"
    return map_batches(joined, step, f"id {kind}, n_words long, n_removed long, kept_text string, {spans}, factors array<struct<first:int,past:int,source:{kind},source_first:int>>")


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, kept_text, removed_spans (word ranges) and factors (ranges and their sources).

    A word goes if it lies in a window of so many consecutive words whose sequence also starts in a document
    with a smaller id; windows are judged on the input. Words are unchanged; kept ones are joined by a space.
    Null and empty texts have no words. A row with a null id keeps its words and is no reference. Rows of one
    id count as one document, whether their texts are equal or not: they do not empty each other. An empty table
    gives an empty one; other columns are not read. Hashes of 128 bits stand for blocks and windows, and 64 bits
    tell texts of one id apart.

    Shuffles: two of the index (about 50 bytes for about 22 words), one of the texts, which both joins read, and
    those of the windows at factor boundaries. Hot anchors are aggregated before they are shuffled; the joins
    are on plain keys, whose hot ones Spark splits.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("digest")).alias("doc"), F.col(text_col).alias("text"))
    blocks = written(index_rows(rows.filter("doc.id IS NOT NULL"), window), "blocks")
    index = blocks.groupBy("anchor", "block").agg(F.min(F.struct("doc", "firsts", "windows")).alias("owner"), F.max("doc.id").alias("highest"))
    index = written(index, "index")
    copied = index.filter("highest > owner.doc.id").select("anchor", "block", F.col("owner.doc.id").alias("source"), F.col("owner.firsts")[0].alias("at"))
    matched = blocks.join(copied, ["anchor", "block"]).filter("doc.id > source").select("doc", F.explode("firsts").alias("first"), "windows", "source", "at")

    contested = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    contested = written(contested, "contested")  # as below: both sides of the join are then shuffled for it, and Spark can split hot anchors
    boundary = index.join(contested, "anchor", "left_semi").select("owner.doc", "anchor", F.explode("owner.firsts").alias("first"), F.col("owner.windows").alias("windows"))
    boundary = boundary.select("doc", F.struct("anchor", "first", (F.col("first") + F.col("windows") - 1).alias("last")).alias("block"))
    listed = boundary.groupBy("doc").agg(F.collect_list("block").alias("listed"))
    windows = window_rows(rows.join(listed, "doc", "left").select("doc", "text", "listed"), window)
    windows = written(windows, "windows")
    earlier = windows.groupBy("anchor", "window").agg(F.min(F.struct("doc.id", "at")).alias("owner"), F.max("doc.id").alias("highest")).filter("highest > owner.id")
    earlier = earlier.select("anchor", "window", F.col("owner.id").alias("source"), F.col("owner.at").alias("source_at"))
    earlier = written(earlier, "earlier")  # both sides of the join are then shuffled for it, and Spark can split hot windows
    checked = windows.join(earlier, ["anchor", "window"]).filter("doc.id > source").select("doc", F.col("at").alias("first"), F.lit(1).alias("windows"), "source", F.col("source_at").alias("at"))

    matches = matched.unionByName(checked).groupBy("doc").agg(F.collect_set(F.struct("first", "windows", "source", "at")).alias("matches"))
    return cut_rows(rows.join(matches, "doc", "left").select("doc.id", "text", "matches"), window).withColumnRenamed("id", id_col)


def digest_query(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos, w FROM w WHERE len(w) >= 50),
keyed AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS k FROM win),
least AS (SELECT k, min(doc_id) AS first FROM keyed GROUP BY k),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM keyed JOIN least USING (k), range(0, 50) r(j) WHERE doc_id > first),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM w),
kept AS (SELECT word.doc_id, count(*) AS n_words, count(gone.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY word.pos) FILTER (WHERE gone.pos IS NULL), '') AS text FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.pos = gone.pos GROUP BY word.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
