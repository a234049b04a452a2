"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant within r bits of both, and two that share one
differ in at most 2r bits. Every distinct fingerprint therefore stands for all its variants within half the
radius; those of equal leading bits meet in one bucket, where fingerprints that share a variant are linked to
the smallest of them. A fingerprint travels once for each way of flipping leading bits, not once for each
variant: the flips of the remaining bits are made inside the bucket. Buckets with too many variants are dealt
out over more leading bits, up to single variants, which can have only so many fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh, hex64, map_batches, written
from .graph import components

BITS = 64
#: Variants that a bucket is made for, and those beyond which it is dealt out further.
VARIANTS_AIM, VARIANTS_MOST = 1_500_000, 12_000_000
#: Bits that a bucket with too many variants is dealt out over.
DEEPER = 8


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The majority of the bits of the XXH64 (seed 42) of all word shingles of the text, A-Z lower-cased; 0 without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        at = list(accumulate((len(w) + 1 for w in words), initial=0))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(at, at[shingle:])], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[k : k + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col and fp, the fingerprint as a signed long. A null text counts as empty: 0."""

    def step(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        fps = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), step, f"`{id_col}` {kind}, fp long")


def ball(bits: int, radius: int) -> list[tuple[int, int]]:
    """(mask, set bits) of all masks over so many bits with at most radius set."""
    return [(sum(1 << b for b in own), k) for k in range(min(bits, radius) + 1) for own in combinations(range(bits), k)]


def ball_size(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(min(bits, radius) + 1))


def deal(rows: DataFrame, depth: int, more: int, radius: int, bits: int = BITS) -> DataFrame:
    """Rows of (fp, bucket, rest, others) over `more` further leading bits: bucket has the leading bits of the variants, rest the flips that remain."""
    low = bits - depth - more
    own = F.shiftrightunsigned("fp", low).bitwiseAND((1 << more) - 1) if low else F.col("fp").bitwiseAND((1 << more) - 1)
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("used")) for m, k in ball(more, radius)])
    out = rows.withColumn("flip", F.explode(F.filter(flips, lambda x: x["used"] <= F.col("rest"))))
    bucket = F.shiftleft("bucket", more).bitwiseOR(own.bitwiseXOR(F.col("flip.mask")))
    others = [c for c in rows.columns if c not in ("bucket", "rest")]
    return out.select(*others, bucket.alias("bucket"), (F.col("rest") - F.col("flip.used")).alias("rest"))


def weight(low: int, radius: int):
    """The variants that a row of deal() has in its bucket."""
    sizes = F.array(*[F.lit(ball_size(low, r)).cast("long") for r in range(radius + 1)])
    return F.element_at(sizes, F.col("rest") + 1)


def bucket_links(fps: np.ndarray, rests: np.ndarray, low: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest of its group) among fingerprints that share a variant of the bucket, as a star for each group.

    Only the low bits of variants differ here. Pairs that collide are verified against the radius. Groups that share a fingerprint are joined before they are
    returned, so that each fingerprint has one link at most.
    """
    keep = np.uint64((1 << low) - 1)
    variants, owners = [], []
    for rest in range(int(rests.max()) + 1):
        at = np.flatnonzero(rests == rest)
        if len(at):
            masks = np.array([m for m, _ in ball(low, rest)], np.uint64)
            variants.append(((fps[at] & keep)[:, None] ^ masks).ravel())
            owners.append(np.repeat(at, len(masks)).astype(np.int32))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    same = np.flatnonzero(variant[1:] == variant[:-1])
    root = np.arange(len(fps))
    a, b = owner[same].astype(np.int64), owner[same + 1].astype(np.int64)
    pair = np.unique(np.minimum(a, b) * len(fps) + np.maximum(a, b))
    a, b = pair // len(fps), pair % len(fps)
    far = np.bitwise_count(fps[a] ^ fps[b])
    near = (far > 0) & (far <= radius)
    a, b = a[near], b[near]
    while True:
        low_root = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low_root)
        np.minimum.at(root, root[b], low_root)
        root = root[root]
        if np.array_equal(before, root):
            break
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v), u > v, that connect all fingerprints of `distinct` (column fp, each once) differing in at most radius bits.

    Links stand for pairs within the radius or for chains of such pairs. Each bucket
    holds at most VARIANTS_MOST variants in memory. One job counts the fingerprints, and one each level of
    dealing looks for buckets that are too large.
    """
    if radius % 2:
        raise ValueError("the radius must be even, so that half of it is one")
    half = radius // 2
    n = distinct.count()
    depth = 4
    while depth < 30 and n * ball_size(BITS, half) > VARIANTS_AIM << depth:
        depth += 1
    rows = deal(distinct.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(half).alias("rest")), 0, depth, half)
    found = []
    while True:
        low = BITS - depth
        heavy = rows.groupBy("bucket").agg(F.sum(weight(low, half)).alias("variants")).filter(F.col("variants") > VARIANTS_MOST)
        deeper = low > 0 and not heavy.isEmpty()
        heavy = written(heavy.select("bucket"), "heavy") if deeper else heavy
        light = rows.join(heavy, "bucket", "left_anti") if deeper else rows
        found.append(linked_within(light, low, radius))
        if not deeper:
            break
        more = min(DEEPER, low)
        rows = deal(rows.join(heavy, "bucket", "left_semi"), depth, more, half)
        depth += more
    out = found[0]
    for more_links in found[1:]:
        out = out.unionByName(more_links)
    return out


def linked_within(rows: DataFrame, low: int, radius: int) -> DataFrame:
    def step(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        u, v = bucket_links(fps, table.column("rest").to_numpy(), low, radius)
        big, small = np.maximum(u.view(np.int64), v.view(np.int64)), np.minimum(u.view(np.int64), v.view(np.int64))
        return pa.table({"u": big, "v": small})

    return rows.groupBy("bucket").applyInArrow(step, "u long, v long")


def rooted(marked: DataFrame, least, radius: int) -> DataFrame:
    """(fp, least) for each distinct fp of marked: the aggregate `least` over the whole component."""
    named = written(marked.groupBy("fp").agg(F.min(least).alias("least")), "distinct")
    roots = components(links(named.select("fp"), radius)).withColumnRenamed("node", "fp")
    own = written(named.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    whole = written(own.groupBy("root").agg(F.min("least").alias("least")), "least")
    return own.select("fp", "root").join(whole, "root").select("fp", "least")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, fp (signed long) and component_id, the smallest id that links reach.

    Texts are read whole; null and empty texts have fingerprint 0 and are linked like any other; rows with a
    null id get a component but never name one, unless the whole component has none; repeated rows are kept.
    Copies count once in the search, so a large group of copies costs no more than one document. Links are
    never collected.
    """
    marked = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    labels = rooted(marked, F.col(id_col), radius).withColumnRenamed("least", "component_id")
    return marked.join(labels, "fp").select(id_col, "fp", "component_id")


def digest_query(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return near_duplicates(docs).select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The rows of docs, all columns unchanged, that stay: one for each component, with the smallest id.

    With a similarity, links are those of similar.py: texts whose five-word shingles are at least so similar. Without
    one, texts whose fingerprints of `shingle` words are within the radius. A row with a null id stays only for a
    component without ids; of rows with equal ids the one with the smallest digest of its text stays, and of rows with
    equal ids and texts one. An empty table gives an empty one; columns may have any names.
    """
    if similarity is not None:
        from .similar import representatives as similar_representatives

        return similar_representatives(docs, similarity, id_col, text_col)
    key = fresh(docs, "row_key")
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    keyed = docs.withColumn(key, digest)
    pair = keyed.select(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), F.col(key).alias("key")).alias("row"), F.col(text_col))
    marked = written(fingerprints(pair, shingle, "row", text_col), "fingerprints")
    stays = rooted(marked, F.col("row"), radius).select(F.col("least.key").alias(key)).distinct()
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).select([F.col(f"`{c}`") for c in docs.columns])
