"""A pipeline over documents: each stage keeps the columns of documents, the last encodes the texts.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any
further names; what becomes of them is said by the stage. Ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, quality, simhash, templates
from tessera.llm.common import discarded, read_table, written
from tessera.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go, repeated rows stay or go alike, ids are not looked at."""
    return quality.kept_documents(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of recurring templates; null texts stay null, rows without an id keep their lines."""
    return templates.deduped_rows(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    The one of smallest id stays, one without an id only if the group has none; repeated rows and null or empty texts are
    copies of each other.
    """
    return simhash.representatives(docs, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: all at least once, none of a source more often than 1.25 times on average.

    A null source is one of its own; a source without any words is not taken; repeated rows are taken alike.
    """
    return mixing.mixed_rows(docs, mixing.Mix(max_repeats=1.25))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the text that they decode to, a row for each row; a null text has no ids."""
    return bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("quality", quality_stage), ("lines", lines_stage), ("simhash", simhash_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: XXH64 shingles, connected components and BPE merges are not expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again, and deleted when the next one is."""
    docs, held = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if held is not None:
            discarded(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
