"""Time-aware flags and scores of index episodes."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from ..sources import schemas
from .mapping import as_labels


def first_occurrence(events: DataFrame, subject: str, condition: str, date: str) -> DataFrame:
    """(subject, condition, first_date): the earliest dated event; events without subject, condition or date are left out.

    The aggregation before any join keeps what is joined small.
    """
    dated = events.filter(F.col(subject).isNotNull() & F.col(condition).isNotNull() & F.col(date).isNotNull())
    return dated.groupBy(subject, condition).agg(F.min(date).alias("first_date"))


def conditions_before(episodes: DataFrame, first: DataFrame, subject: str, index_date: str, strict: bool = False) -> DataFrame:
    """Episodes joined to conditions first seen no later than the index date (before it if strict)."""
    early = F.col("first_date") < F.col(index_date) if strict else F.col("first_date") <= F.col(index_date)
    return episodes.join(first, subject).filter(early)


def flags(found: DataFrame, keys: list[str], condition: str, conditions: list[str] | tuple[str, ...]) -> DataFrame:
    """A 0/1 column for each of a fixed list of conditions, in one pass."""
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col(condition) == c, 1).otherwise(0)).alias(c) for c in conditions])


def zero_filled(episodes: DataFrame, flagged: DataFrame, keys: list[str], conditions: list[str] | tuple[str, ...]) -> DataFrame:
    """Every episode, with 0 where it has no flag."""
    return episodes.select(*keys).join(flagged, keys, "left").fillna(0, subset=list(conditions))


def episode_flags(
    evidence: DataFrame,
    episodes: DataFrame,
    conditions: list[str] | tuple[str, ...] = schemas.CONDITIONS,
    subject: str = "subject",
    episode: str = "infection_id",
    index_date: str = "admission_date",
    condition: str = "cci_condition",
    date: str = "comorbidity_date",
    check: bool = True,
) -> DataFrame:
    """One row for each episode, with a 0/1 flag for each condition of its subject on or before its index date.

    evidence has a condition, or an array of them, for each event. Null or repeated episode keys and null index
    dates are errors, unless check is off. Everything is grouped by subject first, so that one shuffle of each
    side by subject serves the aggregation, the join and the flags.
    """
    if check:
        checks.ensure(checks.null_keys(episodes, [subject, episode, index_date]), "Null values in")
        checks.ensure(checks.duplicate_keys(episodes, [subject, episode]), "Episodes have duplicate keys")
    single = evidence.select(subject, F.explode(as_labels(evidence, condition)).alias(condition), date)
    single = single.filter(F.col(condition).isin(*conditions))
    first = first_occurrence(single, subject, condition, date)
    found = conditions_before(episodes.select(subject, episode, index_date), first, subject, index_date)
    return zero_filled(episodes, flags(found, [subject, episode], condition, conditions), [subject, episode], conditions)


def scored(flagged: DataFrame, weights: dict[str, int] = schemas.WEIGHTS, suppressed: dict[str, str] = schemas.SUPPRESSED_BY, name: str = "cci_score") -> DataFrame:
    """Flags with their weighted sum, in which a graver condition stands in for a milder one; flags stay as they are."""

    def counted(c: str) -> Column:
        graver = suppressed.get(c)
        return F.when(F.col(graver) == 1, 0).otherwise(F.col(c)) if graver in weights else F.col(c)

    return flagged.withColumn(name, reduce(add, [counted(c) * F.lit(w) for c, w in weights.items()]).cast("int"))


def assembled(episodes: DataFrame, features: DataFrame, people: DataFrame, keys: list[str], subject: str) -> DataFrame:
    """Episodes with features by episode and data by person; episodes without them stay."""
    return episodes.join(features, keys, "left").join(people, subject, "left")


def lookback_exposure(episodes: DataFrame, events: DataFrame, subject: str, episode: str, index_date: str, date: str, days: int) -> DataFrame:
    """Extension: 1 for episodes whose subject has an event in so many days before the index date.

    Events are reduced to different days of a subject before the join.
    """
    other = events.filter(F.col(date).isNotNull()).select(F.col(subject).alias("__subject"), F.to_date(date).alias("__day")).distinct()
    window = (F.col("__day") < F.to_date(index_date)) & (F.col("__day") >= F.date_sub(F.to_date(index_date), days))
    hit = episodes.join(other, (F.col(subject) == F.col("__subject")) & window, "left_semi").select(episode).distinct().withColumn("__hit", F.lit(1))
    return episodes.join(hit, episode, "left").withColumn("exposed", F.coalesce("__hit", F.lit(0))).drop("__hit")
