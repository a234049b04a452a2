"""Mixing sources to target weights, with DataFrame functions only.

Each source's share of all tokens is raised to an exponent between 0 and 1 and the powers are normalised; the
exponent is bisected until the mixture has the wanted entropy, or until no source is repeated too often. The
weights then become schedules: a source's documents fall into blocks of about equal tokens, every pass over the
source takes its blocks in a new permutation, and the last pass ends where the source's budget ends.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import written

#: Bisection steps that one aggregation answers, and rounds of it: 48 binary digits of the exponent.
STEPS, ROUNDS = 6, 8
#: Digits that the exponent is rounded to, so that the order of a sum does not show.
DIGITS = 9
#: Sources that are broadcast at most (a name and a few numbers each); more are joined by shuffle.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Mix:
    """What the mixture is to meet. Exactly one of entropy_share (of the largest possible entropy) and max_repeats."""

    entropy_share: float | None = None
    max_repeats: float | None = None
    #: Tokens of the mixture; None: just so many that every source is taken whole at least once.
    budget: int | None = None
    block_tokens: int = 10_000
    seed: int = 17


def place(*parts: Column | str) -> Column:
    """A pseudo-random whole number below 2**32, from MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, mix: Mix) -> float:
    """The exponent, bisected in distributed aggregations over (source, tokens) that each return a few dozen numbers.

    1 keeps the shares, 0 makes all sources equal. Entropy falls and repeats fall as the exponent grows, so the
    largest exponent of at least the entropy, or the smallest within max_repeats, is found; an aim that is out
    of reach gives 0 or 1. Sources without tokens are left out.
    """
    if (mix.entropy_share is None) == (mix.max_repeats is None):
        raise ValueError("give one of entropy_share and max_repeats")
    live = sources.filter("tokens > 0")
    whole = live.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"), F.max("tokens").alias("most"), F.min("tokens").alias("least")).first()
    if not whole.n:
        return 1.0
    share = F.col("tokens") / F.lit(float(whole.t))
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / 2**STEPS for k in range(1, 2**STEPS)]
        grown = live.select("tokens", F.posexplode(F.array(*map(F.lit, points))).alias("k", "a"))
        power = F.pow(share, F.col("a"))
        sums = grown.groupBy("k").agg(F.sum(power).alias("z"), F.sum(power * F.log(share)).alias("zl")).orderBy("k").collect()
        z, zl = [r.z for r in sums], [r.zl for r in sums]
        for k, a in enumerate(points):
            if mix.max_repeats is not None:
                reached = repeats_at(a, z[k], whole, mix) <= mix.max_repeats
                low, high = (low, min(high, a)) if reached else (max(low, a), high)
            else:
                entropy = math.log(z[k]) - a * zl[k] / z[k]
                reached = entropy >= mix.entropy_share * math.log(whole.n)
                low, high = (max(low, a), high) if reached else (low, min(high, a))
    found = high if mix.max_repeats is not None else low
    return round(found, DIGITS)


def repeats_at(a: float, z: float, whole, mix: Mix) -> float:
    """How often the smallest source is passed at exponent a."""
    weight = (whole.least / whole.t) ** a / z
    return weight * budget_at(a, z, whole, mix) / whole.least


def budget_at(a: float, z: float, whole, mix: Mix) -> float:
    """The tokens of the mixture: as given, or so many that the largest source is taken once."""
    return float(mix.budget) if mix.budget is not None else whole.most * z / (whole.most / whole.t) ** a


def weighted(sources: DataFrame, mix: Mix) -> DataFrame:
    """(source, docs, tokens, weight, quota, passes, left, blocks): the whole passes over each source and the tokens left for a last one."""
    a = exponent(sources, mix)
    live = sources.filter("tokens > 0")
    whole = live.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most"), F.min("tokens").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if not whole.n:
        return live.select("source", "docs", "tokens", *[F.lit(None).cast(k).alias(c) for c, k in (("weight", "double"), ("quota", "long"), ("passes", "long"), ("left", "long"), ("blocks", "long"))])
    z = live.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(whole.t)), F.lit(a)))).first()[0]
    budget = budget_at(a, z, whole, mix)
    out = live.withColumn("weight", F.pow(F.col("tokens") / F.lit(float(whole.t)), F.lit(a)) / F.lit(z))
    out = out.withColumn("quota", F.floor(F.col("weight") * F.lit(budget) + F.lit(0.5)).cast("long"))
    out = out.withColumn("passes", F.floor(F.col("quota") / F.col("tokens")).cast("long"))
    out = out.withColumn("left", F.col("quota") - F.col("passes") * F.col("tokens"))
    return out.withColumn("blocks", F.ceil(F.col("tokens") / F.lit(mix.block_tokens)).cast("long"))


def schedule(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(counted, sources): (id, source, tokens, block) per row of docs, and weighted() with `cut`, the place after the last block of the last pass.

    A null source is a source of its own name, an empty string; a null id counts as the text "null".
    """
    source = F.coalesce(F.col(source_col), F.lit("")).alias("source")
    counted = docs.select(F.col(id_col).alias("id"), source, word_count(F.col(text_col)).alias("tokens"))
    counted = written(counted, "tokens")
    totals = written(counted.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")), "totals")
    sources = written(weighted(totals, mix), "sources")
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    hinted = F.broadcast(sources) if few else sources
    blocks = counted.join(hinted.select("source", "blocks", "passes", "left").filter("left > 0"), "source")
    blocks = blocks.withColumn("block", block_of(mix.seed)).groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), F.first("passes").alias("passes"), F.first("left").alias("left"))
    blocks = blocks.withColumn("place", block_place(F.col("passes"), mix.seed)).withColumn("bin", F.shiftright("place", 32 - bin_bits(sources)))
    blocks = written(blocks, "blocks")
    bins = blocks.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bin"))
    edge = bins.withColumn("upto", upto).filter("upto > left").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before"))).alias("edge"))
    edge = edge.select("source", F.col("edge.bin").alias("bin"), F.col("edge.before").alias("before"))
    inner = blocks.join(F.broadcast(edge) if few else edge, ["source", "bin"])
    within = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("place", "block"))
    cut = inner.withColumn("within", within).filter("within > left").groupBy("source").agg(F.min(F.struct("place", "block")).alias("cut"))
    return counted, sources.join(cut, "source", "left")


def bin_bits(sources: DataFrame) -> int:
    """Leading bits of a block's place that bins have when a pass is cut: as many bins as blocks in a bin for the largest source."""
    most = sources.agg(F.max("blocks")).first()[0] or 1
    return min(31, max(4, math.ceil(math.log2(most) / 2)))


def block_of(seed: int) -> Column:
    """The block of a document in its source."""
    return place(F.lit(f"{seed}"), F.coalesce(F.col("id").cast("string"), F.lit("null"))) % F.col("blocks")


def block_place(turn: Column, seed: int) -> Column:
    """The place of a block in the permutation of one pass."""
    return place(F.lit(f"{seed}"), F.col("source"), F.col("block").cast("string"), turn.cast("string"))


def turns(rows: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """rows (id, source, ...) once for each time that the mixture takes them, with block, turn and position.

    position orders the mixture: sorted by it, every stretch has the sources in about their weights.
    """
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = rows.join(F.broadcast(sources) if few else sources, "source").withColumn("block", block_of(mix.seed))
    last = F.struct(block_place(F.col("passes"), mix.seed).alias("place"), F.col("block"))
    times = F.col("passes") + F.when((F.col("left") > 0) & (F.col("cut").isNull() | (last < F.col("cut"))), 1).otherwise(0)
    out = out.withColumn("turn", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), times), lambda t: t < times)))
    spread = (F.col("turn") + block_place(F.col("turn"), mix.seed) / F.lit(float(1 << 32))) * F.col("tokens_in_source") / F.col("quota")
    return out.withColumn("position", F.round(spread, 12))


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row for each time that the mixture takes a document: id, source, n_tokens, weight, block, turn and position.

    Whole passes take every document; the last pass takes blocks in its permutation while they fit the quota.
    Documents without tokens go with their blocks; a source without any tokens is not taken. Repeated rows are
    taken alike. Texts are read once, to count tokens, and not shuffled.
    """
    counted, sources = schedule(docs, mix, id_col, source_col, text_col)
    sources = sources.withColumnRenamed("tokens", "tokens_in_source")
    out = turns(counted, sources, mix)
    return out.select(F.col("id").alias(id_col), "source", F.col("tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), "block", "turn", "position")


def mixed_rows(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, as often as the mixture takes them."""
    _, sources = schedule(docs, mix, id_col, source_col, text_col)
    sources = sources.withColumnRenamed("tokens", "tokens_in_source")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    return turns(rows, sources, mix).select("row.*")


def mixture_query(docs: DataFrame) -> DataFrame:
    """The rows of the query: every source whole at least once, at 95 % of the largest entropy."""
    return mixed_documents(docs, Mix(entropy_share=0.95))


ORACLE = r"""
WITH RECURSIVE counted AS (SELECT doc_id, coalesce(source, '') AS source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))::BIGINT AS tokens FROM documents),
src AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM counted GROUP BY source HAVING sum(tokens) > 0),
tot AS (SELECT sum(tokens)::DOUBLE AS t, max(tokens)::DOUBLE AS most, count(*) AS n FROM src),
half(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END FROM (
    SELECT i, lo, hi, ln(sum(pow(tokens / t, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(tokens / t, (lo + hi) / 2) * ln(tokens / t)) / sum(pow(tokens / t, (lo + hi) / 2)) >= 0.95 * ln(max(n)) AS ok
    FROM half, src, tot WHERE i < 48 GROUP BY i, lo, hi) s),
ex AS (SELECT round(lo, 9) AS a FROM half WHERE i = 48),
zs AS (SELECT a, sum(pow(tokens / t, a)) AS z, max(t) AS t, max(most) AS most FROM src, tot, ex GROUP BY a),
wt AS (SELECT source, tokens AS whole, pow(tokens / t, a) / z AS weight, floor(pow(tokens / t, a) / z * (most * z / pow(most / t, a)) + 0.5)::BIGINT AS quota, ceil(tokens / 10000.0)::BIGINT AS blocks FROM src, zs),
pas AS (SELECT *, quota // whole AS passes, quota % whole AS rest FROM wt),
doc AS (SELECT doc_id, c.source, tokens, p.whole, weight, quota, passes, rest, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT % blocks AS block FROM counted c JOIN pas p ON c.source = p.source),
blk AS (SELECT source, block, passes, rest, sum(tokens) AS tokens, ('0x' || substr(md5('17|' || source || '|' || block || '|' || passes), 1, 8))::BIGINT AS place FROM doc WHERE rest > 0 GROUP BY ALL),
upto AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY place, block) AS upto FROM blk),
took AS (SELECT d.*, passes + coalesce((SELECT (u.upto <= u.rest)::INT FROM upto u WHERE u.source = d.source AND u.block = d.block), 0) AS times FROM doc d),
turned AS (SELECT *, unnest(range(times)) AS turn FROM took)
SELECT doc_id, source, tokens AS n_tokens, round(weight, 9) AS weight, block, turn,
  round((turn + ('0x' || substr(md5('17|' || source || '|' || block || '|' || turn), 1, 8))::BIGINT / 4294967296.0) * whole / quota, 12) AS position FROM turned
"""
