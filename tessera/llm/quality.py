"""Quality rules with suffix-array repetition.

The words of many documents form one array; prefix doubling sorts the suffixes of each document, refining only
suffixes that are still tied. The longest-common-prefix intervals of neighbours in that order are the maximal
repeated word substrings. Their spans are united; the covered share and the longest repeat are limited.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, word_runs

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, repeat_spans array<struct<first:int,past:int>>"

def numbered(words: list[list[bytes]]) -> np.ndarray:
    """Each word's number, the same for equal words of this call."""
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    get = numbers.__getitem__
    return np.fromiter((i for own in words for i in map(get, own)), np.int64, sum(map(len, words)))


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, class of each sorted key from 0), equal keys in one class."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    return order, np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])


def repeats(symbols: np.ndarray, doc: np.ndarray, end: np.ndarray, least: int) -> np.ndarray:
    """For each position the length of the longest substring from there that occurs again in its document, 0 if below least.

    symbols: a number for each word; doc: its document; end: the position after its document's last word.
    The suffix array comes from prefix doubling. A rank stands for the class of the first h words (cut at the
    document's end), so ranks that are equal at h mean h equal words; the levels give each neighbours' common
    prefix by binary descent.
    """
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    order, cls = dense(doc * (int(symbols.max()) + 1) + symbols)
    rank = np.empty(n, np.int64)
    rank[order] = np.searchsorted(cls, cls, side="left")
    levels, h = [(1, rank.astype(np.int32))], 1
    suffixes = order
    tied = tied_places(rank[suffixes])
    while len(tied):
        own = suffixes[tied]
        follow = np.where(own + h < end[own], rank[np.minimum(own + h, n - 1)] + 1, 0)
        o = np.lexsort((follow, rank[own]))
        own, follow, head = own[o], follow[o], rank[own[o]]
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])])
        suffixes[tied] = own
        start = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        rank[own] = tied[start]
        h *= 2
        levels.append((h, rank.astype(np.int32)))
        tied = tied[tied_places(rank[own])]
    left, right = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    live = np.flatnonzero(doc[left] == doc[right])
    for step, ranks in reversed(levels):
        a, b = left[live] + common[live], right[live] + common[live]
        fits = np.maximum(a, b) + step <= end[left[live]]
        same = fits & (ranks[a.clip(max=n - 1)] == ranks[b.clip(max=n - 1)])
        common[live[same]] += step
    common[common < least] = 0
    np.maximum.at(out, left, common)
    np.maximum.at(out, right, common)
    return out


def tied_places(ranks: np.ndarray) -> np.ndarray:
    """Where neighbours have equal ranks."""
    same = ranks[1:] == ranks[:-1]
    return np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))


def dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def profile(text: bytes | None) -> tuple[int, int, int]:
    """(code points in words, symbols, lines equal to an earlier one)."""
    if not text:
        return 0, 0, 0
    continuing = 0 if text.isascii() else len(text) - len(text.translate(None, bytes(range(0x80, 0xC0))))
    blanks = len(text) - len(text.translate(None, BLANKS))
    return len(text) - continuing - blanks, len(text) - len(text.translate(None, SYMBOLS)), dup_lines(text)


def step(batch: pa.RecordBatch, least: int) -> Iterable[pa.RecordBatch]:
    texts = as_bytes(batch.column(1))
    for first, past, words in word_runs(texts):
        sizes = np.fromiter(map(len, words), np.int64, past - first)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        doc = np.repeat(np.arange(past - first), sizes)
        length = repeats(numbered(words), doc, np.repeat(ends, sizes), least)
        edge = np.zeros(len(length) + 1, np.int64)
        at = np.flatnonzero(length)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length[at], -1)
        covered = np.cumsum(edge[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(covered)])
        longest = np.zeros(past - first, np.int64)
        np.maximum.at(longest, doc[at], length[at])
        shift = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
        span_first, span_past = np.flatnonzero(shift == 1), np.flatnonzero(shift == -1)
        spans = spans_by_document(span_first, span_past, starts, ends)
        own = [profile(t) for t in texts[first:past]]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(first, past - first),
                pa.array(sizes),
                *(pa.array([p[k] for p in own], pa.int64()) for k in range(3)),
                pa.array(total[ends] - total[starts]),
                pa.array(longest),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))),
            ],
            names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "repeat_spans"],
        )


def spans_by_document(first: np.ndarray, past: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[dict]]:
    """Spans of the joint array as spans of each document; one that runs over a border is cut there."""
    out: list[list[dict]] = [[] for _ in starts]
    doc = np.searchsorted(ends, first, side="right")
    for d, a, b in zip(doc.tolist(), first.tolist(), past.tolist()):
        while a < b:
            stop = min(b, int(ends[d]))
            if a < stop:
                out[d].append({"first": a - int(starts[d]), "past": stop - int(starts[d])})
            a, d = max(a, stop), d + 1
    return out


def repetition_profile(docs: DataFrame, least: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and the measures of SCHEMA, over the whole text.

    n_repeat_words counts words that lie in repeated substrings of at least so many words, the first occurrence
    included; repeat_spans are these words' ranges. A null or empty text has no words and zeros everywhere;
    equal rows give equal rows; a null id stays null; other columns of docs are not read. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col), F.col(text_col)), lambda batch: step(batch, least), f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def quality_rules(docs: DataFrame, min_words: int = 20, max_covered_percent: int = 30, max_longest: int = 200, max_longest_percent: int = 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repetition_profile with base_failed and kept.

    base_failed: fewer words than min_words, or more than max_covered_percent of them in repeats. kept: not
    base_failed, and the longest repeat has at most max_longest words and max_longest_percent of the text's. Half of
    what may be covered is what a passage and its copy leave to each; a longer one overlaps itself, as a loop does.

    Null and empty texts have no words and fail; equal rows give equal rows; a null id stays null; an empty table
    gives an empty one; texts are read whole, other columns not at all.
    """
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_covered_percent)
    out = repetition_profile(docs, id_col=id_col, text_col=text_col).withColumn("base_failed", failed)
    long = (F.col("longest_repeat") > max_longest) | (F.col("longest_repeat") * 100 > F.col("n_words") * max_longest_percent)
    return out.withColumn("kept", ~F.col("base_failed") & ~long)


def rules_query(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame, min_words: int = 20, max_covered_percent: int = 30, max_longest: int = 200, max_longest_percent: int = 15, text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns unchanged, filtered in one pass without a join.

    Null and empty texts go; repeated rows stay or go alike; ids are not looked at.
    """
    at = docs.columns.index(text_col)

    def kept_rows(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        numbers = pa.array(np.arange(batch.num_rows))
        for part in step(pa.RecordBatch.from_arrays([numbers, batch.column(at)], names=["id", "text"]), 8):
            n, covered, longest = (part.column(k).to_numpy() for k in ("n_words", "n_repeat_words", "longest_repeat"))
            good = (n >= min_words) & (covered * 100 <= n * max_covered_percent) & (longest <= max_longest) & (longest * 100 <= n * max_longest_percent)
            yield batch.take(part.column("id").filter(pa.array(good)))

    return map_batches(docs, kept_rows, docs.schema)


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS pos, w FROM w WHERE len(w) >= 8),
keyed AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 7], ' ')) AS k FROM win),
twice AS (SELECT doc_id, pos, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT pos + j) AS n FROM twice, range(0, 8) r(j) GROUP BY doc_id),
size AS (SELECT doc_id, w, least(201, greatest(8, len(w) * 15 // 100 + 1)) AS n FROM w),
long AS (SELECT doc_id, md5(array_to_string(size.w[pos:pos + n - 1], ' ')) AS k FROM twice JOIN size USING (doc_id) WHERE pos + n - 1 <= len(size.w)),
longer AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, k FROM long GROUP BY doc_id, k HAVING count(*) > 1)),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, longer.doc_id IS NOT NULL AS long
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN longer USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT * EXCLUDE (long), NOT base_failed AND NOT long AS kept FROM f
"""
