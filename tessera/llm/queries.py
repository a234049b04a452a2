"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, lzprint, mixing, quality, simhash, substrings, templates, tokencounts, urls, warc
from .common import read_table


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_query(read_table(spark, sf_dir, "documents"))


def op2_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.digest_query(read_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_query(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.rules_query(read_table(spark, sf_dir, "pages"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.lines_query(read_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest_query(read_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules_query(read_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_query(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencounts.lines_query(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixture, op2_lz_fingerprint, op3_substring_dedup, op4_url_filter, op5_line_templates, op6_simhash, op7_quality_rules, op8_warc, op9_bpe, op10_token_counts)
}

#: Queries 2, 6, 9 and 10 parse, hash or merge in ways that SQL has no functions for; the tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_mixture": mixing.ORACLE,
    "op3_substring_dedup": substrings.ORACLE,
    "op4_url_filter": urls.ORACLE,
    "op5_line_templates": templates.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op8_warc": warc.ORACLE,
}
