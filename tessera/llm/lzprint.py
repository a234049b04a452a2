"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases, each the shortest string from the current place that is not a phrase yet. The
phrase set is hashed and its smallest hashes are the fingerprint: texts that compress alike share phrases, so
the share of equal smallest hashes estimates the likeness of their phrase sets.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches

#: Hashes in a fingerprint, of 32 bits each.
SIZE = 64
#: Documents that a range of ids is made for, ranges at most, and sampled keys for each.
RANGE_DOCS, RANGES, SAMPLE = 400, 65_536, 8


class Phrases:
    """The phrase set of a text so far, and the phrase that is not ended yet."""

    def __init__(self, seen: set[str] | None = None, open_phrase: str = ""):
        self.seen, self.open = set() if seen is None else seen, open_phrase

    def copy(self) -> Phrases:
        return Phrases(self.seen.copy(), self.open)

    def read(self, text: str) -> Phrases:
        seen, phrase = self.seen, self.open
        add = seen.add
        for c in text:
            phrase += c
            if phrase not in seen:
                add(phrase)
                phrase = ""
        self.open = phrase
        return self

    def fingerprint(self) -> list[int]:
        """The SIZE smallest distinct hashes, sorted. A text that is over before its last phrase is new adds nothing for it."""
        if not self.seen:
            return []
        return np.unique(np.fromiter(map(xxhash.xxh32_intdigest, self.seen), np.uint32, len(self.seen)))[:SIZE].tolist()


def likeness(a: list[int], b: list[int]) -> float:
    """The estimated share of common phrases in all phrases of both, from the smallest hashes of the union; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    own, other = set(a), set(b)
    union = sorted(own | other)
    if max(len(a), len(b)) == SIZE:  # else both sets are whole
        union = union[:SIZE]
    return len(own.intersection(union) & other) / len(union)


def shown(fingerprint: list[int]) -> str:
    return struct.pack(f">{len(fingerprint)}I", *fingerprint).hex()


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and fingerprint (hex of the sorted smallest hashes). A null text counts as empty and has an empty fingerprint. No shuffle."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [shown(Phrases().read(t or "").fingerprint()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def range_cuts(rows: DataFrame) -> list[tuple]:
    """The lowest key of each range but the first, for keys (named, id, digest): ranges of about RANGE_DOCS rows, RANGES of them at most.

    The bounds are quantiles of a sample: the keys whose hashes are below a bound, about SAMPLE for each range.
    """
    n = rows.count()
    ranges = max(1, min(RANGES, n // RANGE_DOCS))
    if ranges == 1:
        return []
    below = int(min(1.0, SAMPLE * ranges / n) * (1 << 31))
    some = rows.select("key").filter(F.shiftrightunsigned(F.xxhash64("key", F.lit(5)), 33) < below).distinct()
    own = sorted((tuple(r.key) for r in some.collect()), key=order_of)
    if not own:
        return []
    return sorted({own[k * len(own) // ranges] for k in range(1, ranges)}, key=order_of)


def order_of(key: tuple) -> tuple:
    """A key (named, id, digest) as Python orders it: nulls below all ids."""
    named, own, digest = key
    return (True, own, digest) if named else (False, digest)


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, with the fingerprint of its text, of its edited text and of the next document.

    The next document is the next lower id_col, of whatever type (null lowest, equal ids by digest of the text);
    after the last comes the first. The edited text has the last floor(n/3) code points replaced by the first as many
    (or all) of the next document. Null texts count as empty; a single document is its own next; an empty table gives
    an empty one; other columns are not read.

    Documents are dealt by ranges of ids and digests, one shuffle of the texts; the highest document of each range
    also goes to the range above as its lookahead. Workers pass each range in order and hold two documents at a time.
    Rows of equal id and text share a range. The bounds of the ranges (RANGES at most) and the sample that they are
    taken from are the only data on the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).isNotNull().alias("named"), F.col(id_col).alias("id"), (-F.shiftright(F.xxhash64(text), 1)).alias("digest"))
    rows = docs.select(key.alias("key"), text.alias("text"))
    cuts = [order_of(c) for c in range_cuts(rows)]

    @F.pandas_udf("int")
    def range_of(named, own, digest):
        import pandas as pd

        keys = ((True, i, d) if n else (False, d) for n, i, d in zip(named, own, digest))
        return pd.Series([bisect_right(cuts, k) for k in keys], dtype="int32")

    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    own_id = F.coalesce("key.id", F.lit(0)) if whole else F.col("key.id")  # pandas would make whole numbers with nulls floats
    part = range_of("key.named", own_id, "key.digest")
    heads = sorted((r.part, tuple(r.key)) for r in rows.groupBy(part.alias("part")).agg(F.max("key").alias("key")).collect())
    ahead = {key: heads[(k + 1) % len(heads)][0] for k, (_, key) in enumerate(heads)}

    @F.pandas_udf("int")
    def lookahead_of(named, own, digest):
        import pandas as pd

        return pd.Series([ahead.get((bool(n), i if n else None, d), -1) for n, i, d in zip(named, own, digest)], dtype="int32")

    dealt = rows.withColumn("part", part).withColumn("ahead", lookahead_of("key.named", own_id, "key.digest"))
    places = F.when(F.col("ahead") < 0, F.array(F.struct(F.col("part"), F.lit(0).alias("later")))).otherwise(F.array(F.struct(F.col("part"), F.lit(0).alias("later")), F.struct(F.col("ahead").alias("part"), F.lit(1).alias("later"))))
    dealt = dealt.withColumn("place", F.explode(places)).select(F.col("place.part").alias("part"), F.col("place.later").alias("later"), "key", "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(partitions, "part").sortWithinPartitions("part", "later", F.desc("key"))
    small_batches(spark)
    kind = docs.schema[id_col].dataType
    out = ordered.select("part", "later", F.col("key.id").alias("id"), "text").mapInArrow(lambda batches: passed(batches, to_arrow_type(kind)), f"id {kind.simpleString()}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


class Pending:
    """A document that waits for the next one."""

    def __init__(self, doc_id, text: str):
        self.id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 3
        self.prefix = Phrases().read(text[: self.cut])
        self.print = self.prefix.copy().read(text[self.cut :]).fingerprint()

    def row(self, following: Pending) -> tuple:
        tail = following.text[: len(self.text) - self.cut]
        edited = self.prefix.read(tail).fingerprint()
        return (self.id, len(self.text), self.text[: self.cut] + tail, shown(self.print), shown(edited), likeness(self.print, edited), likeness(self.print, following.print))


def passed(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of (part, later, id, text) in order to result rows; of the later rows of a part only the first counts."""
    names = ["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: Pending | None = None
    held_part = None
    for batch in batches:
        done: list[tuple] = []
        for part, later, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if later and (held is None or part != held_part):
                continue
            now = Pending(doc_id, text)
            if held is not None:
                done.append(held.row(now))
            held, held_part = (None, None) if later else (now, part)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)


def digest_query(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return with_edited(docs).select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
