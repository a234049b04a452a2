"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: first by its number of tokens, then by its leading tokens, where a token
with a digit counts as a variable field. In a leaf, a token stays constant at its place if enough lines have it
there; other places are variable fields too. Lines with the same constants share a template. Templates that
recur across documents are dropped, but in the first document that has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh, map_batches, written

DIGIT = re.compile(rb"[0-9]")
FIELD = b"<*>"


def token_hash(token: bytes) -> int:
    """Hash of a token; 0 for one with a digit."""
    return 0 if DIGIT.search(token) else xxhash.xxh64_intdigest(token) >> 1


def leaf(tokens: list[bytes], depth: int) -> int:
    """The leaf of a line: its number of tokens and its leading ones."""
    leading = [FIELD if DIGIT.search(t) else t for t in tokens[:depth]]
    return xxhash.xxh64_intdigest(b"%d " % len(tokens) + b" ".join(leading))


def line_rows(docs: DataFrame, depth: int) -> DataFrame:
    """(id, line, leaf) for each line with a token of docs (id, text)."""

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        rows, lines, leaves = [], [], []
        for row, text in enumerate(as_bytes(batch.column(1))):
            for number, line in enumerate(text.split(b"\n") if text else []):
                if tokens := line.split():
                    rows.append(row)
                    lines.append(number)
                    leaves.append(leaf(tokens, depth))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.int32()), pa.array(np.array(leaves, np.uint64).view(np.int64))], names=["id", "line", "leaf"])

    return map_batches(docs, step, f"id {docs.schema['id'].dataType.simpleString()}, line int, leaf long")


def token_rows(joined: DataFrame, depth: int) -> DataFrame:
    """(id, line, leaf, content, tokens) for the lines listed with each document (id, text, listed): tokens are hashes, 0 for a field."""

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        out: list[tuple] = []
        rows = []
        for row, (text, listed) in enumerate(zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())):
            split = text.split(b"\n") if text and listed else []
            for number in set(listed or []):
                if number < len(split) and (tokens := split[number].split()):
                    own = np.fromiter(map(token_hash, tokens), np.int64, len(tokens))
                    rows.append(row)
                    out.append((number, leaf(tokens, depth), xxhash.xxh64_intdigest(own.tobytes()), own))
        lines, leaves, contents, tokens = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.int32()), *(pa.array(np.array(c, np.uint64).view(np.int64)) for c in (leaves, contents)), pa.array(tokens, pa.list_(pa.int64()))],
            names=["id", "line", "leaf", "content", "tokens"],
        )

    return map_batches(joined, step, f"id {joined.schema['id'].dataType.simpleString()}, line int, leaf long, content long, tokens array<long>")


def recurring_lines(rows: DataFrame, depth: int, constant_share: float, min_docs: int, keep_first: bool) -> DataFrame:
    """(id, dropped) for the rows (id, text) that have lines of recurring templates; id is a struct of id and digest of the text."""
    lines = written(line_rows(rows.filter("id.id IS NOT NULL"), depth), "lines")
    often = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).select("leaf")
    often = written(often, "often")  # as below: both sides of the join are then shuffled for it, and Spark can split hot leaves
    listed = lines.join(often, "leaf", "left_semi").groupBy("id").agg(F.collect_list("line").alias("listed"))
    parsed = token_rows(rows.join(listed.hint("merge"), "id", "left").select("id", "text", "listed"), depth)  # the same plan at every size
    parsed = written(parsed, "parsed")

    different = written(parsed.groupBy("leaf", "content").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "different")
    places = different.select("leaf", "content", "n", F.posexplode("tokens").alias("at", "token")).filter("token <> 0")
    constants = places.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).drop("n")
    kept = places.join(constants, ["leaf", "at", "token"]).groupBy("leaf", "content").agg(F.bit_xor(F.xxhash64("at", "token")).alias("template"), F.count(F.lit(1)).alias("constants"))
    sized = kept.join(different.select("leaf", "content", F.size("tokens").alias("size")), ["leaf", "content"])
    sized = sized.filter(F.col("constants") >= F.col("size") * constant_share).select("leaf", "content", "template")
    sized = written(sized, "sized")  # both sides of the join are then shuffled for it, and Spark can split hot lines

    told = written(parsed.select("id", "line", "leaf", "content").join(sized, ["leaf", "content"]).select("id", "line", "leaf", "template"), "told")
    spread = told.select("leaf", "template", "id.id").distinct().groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first"))
    spread = written(spread.filter(F.col("docs") >= min_docs).drop("docs"), "spread")
    gone = told.join(spread, ["leaf", "template"])
    return (gone.filter("id.id > first") if keep_first else gone).groupBy("id").agg(F.collect_set("line").alias("dropped"))


def without_templates(docs: DataFrame, depth: int = 3, constant_share: float = 0.5, min_docs: int = 10, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", name: str = "parsed") -> DataFrame:
    """The rows of docs, all columns unchanged, with `kept_text`, `n_lines` and `n_dropped` in a struct column of the given name.

    A line is dropped if its template has constants at a share of at least constant_share of its places and is in
    at least min_docs documents; with keep_first the document of smallest id keeps it. A token is constant in a
    leaf's place if at least min_docs lines have it there and it has no digit. Lines without a token stay.
    n_lines counts the lines with a token. Null texts stay null, empty ones empty. A row with a null id keeps its
    lines and does not count; rows of one id count as one document, whether their texts are equal or not. An empty table gives an empty one. Other columns
    may have any name but that of the struct, which is an error.

    Leaves, places and templates are aggregated, never gathered; different lines count once, so a hot line is one
    row from its leaf on.
    """
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"There is a column {name} already")
    digest = F.xxhash64(F.coalesce(text_col, F.lit("")))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), digest.alias("digest")).alias("id"), F.col(text_col).alias("text"))
    dropped = recurring_lines(rows, depth, constant_share, min_docs, keep_first)
    own_id, own_digest, gone, lines = (fresh(docs, c) for c in ("dropped_id", "dropped_digest", "dropped_lines", "split_lines"))
    dropped = dropped.select(F.col("id.id").alias(own_id), F.col("id.digest").alias(own_digest), F.col("dropped").alias(gone))
    same = (F.col(f"`{id_col}`") == F.col(own_id)) & (digest == F.col(own_digest))
    out = docs.join(dropped.hint("merge"), same, "left").drop(own_id, own_digest)
    out = out.withColumn(lines, F.split(F.col(text_col), "\n"))  # a column, so that it is not split again for each line
    split = F.col(lines)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))  # by a hash set, in order
    kept = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    n_lines = F.size(F.filter(F.coalesce(split, F.array().cast("array<string>")), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n_dropped = F.coalesce(F.size(F.col(gone)), F.lit(0))
    return out.withColumn(name, F.struct(kept.alias("kept_text"), n_lines.cast("long").alias("n_lines"), F.greatest(n_dropped, F.lit(0)).cast("long").alias("n_dropped"))).drop(gone, lines)


def lines_query(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    out = without_templates(docs.select("doc_id", "text"))
    return out.select("doc_id", "parsed.n_lines", "parsed.n_dropped", F.sha2(F.coalesce(F.col("parsed.kept_text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def deduped_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs with the kept lines as their text; n_chars, where there is one, follows the text.

    Nulls, empty texts, repeated rows and other columns as in without_templates(): every row stays.
    """
    name = fresh(docs, "parsed")
    out = without_templates(docs, name=name).withColumn("text", F.col(f"{name}.kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM split),
tok AS (SELECT doc_id, ln, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM line),
mask AS (SELECT doc_id, ln, line, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM tok),
leafed AS (SELECT doc_id, ln, t, len(t) AS n, t[1:3] AS lead FROM mask WHERE len(t) > 0),
place AS (SELECT doc_id, ln, n, lead, unnest(range(1, n + 1)) AS pos, unnest(t) AS token FROM leafed),
const AS (SELECT n, lead, pos, token FROM place WHERE token <> '<*>' GROUP BY ALL HAVING count(*) >= 10),
skel AS (SELECT doc_id, ln, n, lead, list({'pos': pos, 'token': token} ORDER BY pos) AS tpl FROM place JOIN const USING (n, lead, pos, token) GROUP BY ALL HAVING count(*) >= n * 0.5),
spread AS (SELECT n, lead, tpl, min(doc_id) AS first FROM skel GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10),
gone AS (SELECT doc_id, ln FROM skel JOIN spread USING (n, lead, tpl) WHERE doc_id > first),
flagged AS (SELECT m.doc_id, m.ln, m.line, len(m.t) > 0 AS real, g.ln IS NOT NULL AS dropped FROM mask m LEFT JOIN gone g ON m.doc_id = g.doc_id AND m.ln = g.ln),
kept AS (SELECT doc_id, sum(real::INT)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE NOT dropped), '') AS text FROM flagged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""
