"""Ranks and quantiles over a whole table or key without one task that sorts it all."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that a ranking is dealt over: so many at least and at most, of about so many rows.
RANGES, RANGES_MOST, RANGE_ROWS = 64, 4_096, 1_000_000
#: Cut points up to which a range is found by a tree of comparisons, not by halving an array: larger trees are too much code to compile.
TREE = 8
#: Parts of a ranking by an even share; steps that values are counted by, and rows of a step that the driver sorts at most.
EVEN_PARTS, STEPS, STEP_ROWS = 1_024, 16_384, 50_000


@dataclass(frozen=True)
class Cuts:
    """Approximate quantiles that deal a column's values over parts; a value that fills a range is a part of its own.

    Part 2 k has the values above cut k - 1 and up to cut k, or below it if that is heavy; part 2 k + 1 has a heavy cut k only.
    """

    points: tuple[float, ...]
    heavy: tuple[float, ...]

    def part(self, value: Column) -> Column:
        own = range_of(value, list(self.points)) * 2
        return own + value.isin(*self.heavy).cast("int") if self.heavy else own


def placed(df: DataFrame, keys: list[str], part: Column, order: list) -> DataFrame:
    """df with `place`, the rank from 1 within keys, and `size`, the rows of the keys.

    part is a whole number that grows with the order: rows are ranked within their part, and parts, few for each
    key, are added up. Null keys are a key of their own.
    """
    rows = df.withColumn("__part", part)
    counts = rows.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("__n").over(Window.partitionBy(*keys))
    on = [*keys, "__part"]
    sums = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], F.coalesce(before, F.lit(0)).alias("__before"), whole.alias("size"))
    within = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(on)])
    out = rows.withColumn("__within", within).join(sums, same).withColumn("place", (F.col("__before") + F.col("__within")).cast("long"))
    return out.select(*df.columns, "place", F.col("size").cast("long").alias("size"))


def cut_points(df: DataFrame, columns: list[str], ranges: int = RANGES) -> dict[str, Cuts]:
    """Cuts of each column, from approximate quantiles; all that the driver sees of the values.

    One pass; a second one, for more ranges, if there are too many rows for so few.
    """
    share = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    found = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col(c).cast("double"), share, F.lit(4 * ranges)).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    if (more := min(RANGES_MOST, found.n // RANGE_ROWS)) > 2 * ranges:
        return cut_points(df, columns, more)
    out = {}
    for k, c in enumerate(columns):
        own = found[f"c{k}"] or []
        out[c] = Cuts(tuple(sorted(set(own))), tuple(sorted({a for a, b in zip(own, own[1:]) if a == b})))
    return out


def range_of(value: Column, cuts: list[float]) -> Column:
    """The number of cut points below a value."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value > F.lit(cuts[mid]), between(mid + 1, high)).otherwise(between(low, mid))

    if len(cuts) <= TREE:
        return between(0, len(cuts))
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    points = F.array(*map(F.lit, cuts))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.get(points, at + step - 1) < value, step).otherwise(0))


def ranked(df: DataFrame, value: str, tie: str) -> DataFrame:
    """df with `place`, the rank from 1 by (value, tie), and `size`; value is a non-null number.

    Ranges follow the number of rows. A value that fills ranges of its own is dealt over ranges of the tie, if that
    is a number, so that no task sorts all rows of a column of few values.
    """
    number = dict(df.dtypes)[tie] in ("bigint", "int", "smallint", "tinyint", "double", "float")
    cuts = cut_points(df, [value, *([tie] if number and tie != value else [])])
    part = cuts[value].part(F.col(value)).cast("long") * (2 * RANGES_MOST + 2)
    if tie in cuts and tie != value and cuts[value].heavy:
        part = part + F.when(F.col(value).isin(*cuts[value].heavy), cuts[tie].part(F.col(tie))).otherwise(0)
    return placed(df.withColumn("__all", F.lit(1)), ["__all"], part, [value, tie]).drop("__all")


def ranked_evenly(df: DataFrame, share: Column, order: list[str]) -> DataFrame:
    """df with `place`, the rank from 1 by order, and `size`; share is about even from 0 to 1 and grows with the order.

    The parts of the ranking follow from the share itself; the driver sees the number of rows of each.
    """
    rows = df.withColumn("__part", F.floor(share * F.lit(EVEN_PARTS)).cast("int"))
    before, sums = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("__part").count().collect())):
        sums.append((part, before))
        before += n
    known = df.sparkSession.createDataFrame(sums, "__part int, __before long")
    within = rows.withColumn("__within", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    out = within.join(F.broadcast(known), "__part").withColumn("place", (F.col("__before") + F.col("__within")).cast("long"))
    return out.select(*df.columns, "place", F.lit(before).cast("long").alias("size"))


def bounds(df: DataFrame, value: str, tie: str, places: list[int]) -> dict[int, tuple[float, int]]:
    """{place: (value, tie)} of the rows at these places, counted from 1, by (value, tie): a finite double and a whole number.

    Rows are counted by steps of the range of values; steps with many rows are divided again, those of one value by
    the tie. The driver sees counts of steps and the rows of the steps asked for, at most STEP_ROWS of each.
    """
    if not places:
        return {}
    told = df.agg(F.min(value), F.max(value), F.min(tie), F.max(tie)).first()
    low, high, column = told[0], told[1], value
    if low == high:
        low, high, column = told[2], told[3], tie
        if low == high:
            return {p: (told[0], low) for p in places}
    wide = (float(high) - float(low)) / STEPS or 1.0
    step = F.floor((F.col(column).cast("double") - F.lit(float(low))) / F.lit(wide)).cast("long")
    stepped = df.withColumn("__step", step)
    before, at, out = 0, {}, {}
    for k, n in sorted(map(tuple, stepped.groupBy("__step").count().collect())):
        if own := [p for p in places if before < p <= before + n]:
            at[k] = (before, n, own)
        before += n
    small = [k for k, (_, n, _) in at.items() if n <= STEP_ROWS]
    rows: dict[int, list[tuple]] = {}
    for r in stepped.filter(F.col("__step").isin(*small)).select("__step", value, tie).collect() if small else []:
        rows.setdefault(r[0], []).append((r[1], r[2]))
    for k, (first, _, own) in at.items():
        if k in rows:
            held = sorted(rows[k])
            out |= {p: held[p - first - 1] for p in own}
        else:
            deeper = bounds(stepped.filter(F.col("__step") == k).drop("__step"), value, tie, [p - first for p in own])
            out |= {p + first: x for p, x in deeper.items()}
    return out


def up_to(value: Column, tie: Column, bound: tuple[float, int]) -> Column:
    """Whether a row comes no later than the bound by (value, tie)."""
    return (value < F.lit(bound[0])) | ((value == F.lit(bound[0])) & (tie <= F.lit(bound[1])))


def order_statistics(long: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """{(variable, place): value} of the places, counted from 0, among the non-null values of (variable, value).

    Rows are counted by parts; a part that is not a single value and has too many rows is cut again, so that no
    task holds more than a part's values. The driver sees counts of parts and the values asked for.
    """
    out: dict[tuple[str, int], float] = {}
    todo = {v: [(k, k) for k in sorted(set(ks))] for v, ks in wanted.items() if ks}
    rows = long
    while todo:
        wide = rows.select(*[F.when(F.col("variable") == v, F.col("value")).alias(f"v{i}") for i, v in enumerate(todo)])
        cuts = dict(zip(todo, cut_points(wide, wide.columns).values()))
        part = F.lit(None).cast("int")
        for v, own in cuts.items():
            part = F.when(F.col("variable") == v, own.part(F.col("value"))).otherwise(part)
        parted = rows.filter(F.col("variable").isin(*todo)).withColumn("part", part)
        sizes: dict[str, list[tuple]] = {}
        for r in parted.groupBy("variable", "part").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).collect():
            sizes.setdefault(r.variable, []).append((r.part, r.n, r.low, r.high))
        later: dict[str, list[tuple[int, int]]] = {}
        small: dict[tuple[str, int], list[tuple[int, int]]] = {}
        large: list[tuple[str, int]] = []
        for v, places in todo.items():
            for place, asked in places:
                before = 0
                for p, n, low, high in sorted(sizes.get(v, [])):
                    if place < before + n:
                        break
                    before += n
                if low == high:
                    out[v, asked] = low
                elif n <= RANGE_ROWS:
                    small.setdefault((v, p), []).append((place - before, asked))
                else:  # one part of a variable at a time
                    if v not in later:
                        large.append((v, p))
                    if (v, p) in large:
                        later.setdefault(v, []).append((place - before, asked))
                    else:
                        out.update({(v, a): x for (_, a), x in order_statistics(parted.filter((F.col("variable") == v) & (F.col("part") == p)).select("variable", "value"), {v: [place - before]}).items() for a in [asked]})
        if small:
            chosen = reduce(lambda a, b: a | b, [(F.col("variable") == v) & (F.col("part") == p) for v, p in small])
            found = parted.filter(chosen).groupBy("variable", "part").agg(F.array_sort(F.collect_list("value")).alias("own"))
            picked = F.lit(None).cast("array<double>")
            for (v, p), places in small.items():
                picked = F.when((F.col("variable") == v) & (F.col("part") == p), F.array(*[F.get("own", F.lit(k)) for k, _ in places])).otherwise(picked)
            for r in found.select("variable", "part", picked.alias("own")).collect():
                for (_, asked), x in zip(small[r.variable, r.part], r.own):
                    out[r.variable, asked] = x
        if later:
            rows = parted.filter(reduce(lambda a, b: a | b, [(F.col("variable") == v) & (F.col("part") == p) for v, p in large])).select("variable", "value")
        todo = later
    return out


def quantiles(long: DataFrame, counts: dict[str, int], shares: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of each variable of (variable, value), linear between neighbours; counts are those of non-null values."""
    places = {v: [(n - 1) * s for s in shares] for v, n in counts.items() if n}
    wanted = {v: sorted({k for x in own for k in (floor(x), min(floor(x) + 1, counts[v] - 1))}) for v, own in places.items()}
    found = order_statistics(long.filter("value IS NOT NULL"), wanted)
    out: dict[str, list[float | None]] = {v: [None] * len(shares) for v in counts}
    for v, own in places.items():
        low = [found[v, floor(x)] for x in own]
        high = [found[v, min(floor(x) + 1, counts[v] - 1)] for x in own]
        out[v] = [a + (b - a) * (x - floor(x)) for a, b, x in zip(low, high, own)]
    return out
