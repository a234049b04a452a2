"""Column expressions for times, numbers and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

#: Fixed: day-first and month-name patterns that mixed timestamps are tried with after ISO.
MIXED_FORMATS = ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy", "dd-MMM-yyyy HH:mm:ss", "dd-MMM-yyyy", "yyyyMMdd")


def lenient_timestamp(c: Column) -> Column:
    """An ISO date or time, each row by itself; null if it is none. No time zone."""
    return stripped(c.cast("string")).try_cast("timestamp_ntz")


def mixed_timestamp(c: Column, formats: tuple[str, ...] = MIXED_FORMATS) -> Column:
    """ISO first, then the given patterns."""
    own = stripped(c.cast("string"))
    tried = [F.try_to_timestamp(own, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(own.try_cast("timestamp_ntz"), *tried)


def lenient_number(c: Column) -> Column:
    """A double, null if the text is none."""
    return stripped(c.cast("string")).try_cast("double")


def flag(condition: Column) -> Column:
    """1 or 0; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def was_imputed(before: Column, after: Column) -> Column:
    return flag(before.isNull() & after.isNotNull())


def died_in_hospital(death: Column, discharge: Column) -> Column:
    """1 if there is a death no later than the discharge."""
    return flag(death <= discharge)


def rounded(c: Column, dtype: str) -> Column:
    """A whole number for integer types, else 4 digits; halves go to the even neighbour."""
    return F.bround(c, 0).cast("long") if dtype.startswith("int") else F.bround(c, 4)


def random_date(start: str, end: str, draw: Column) -> Column:
    """A date from start to end, both included, from a draw in [0, 1)."""
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    if start > end:
        raise ValueError("The end date must not be before the start date.")
    return F.date_add(first, F.floor(draw * (F.datediff(last, first) + 1)).cast("int"))


def hash_rank(*parts: Column, seed: int = 0) -> Column:
    """A pseudo-random whole number below 2**32 from MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 8), 16, 10).cast("long")


def hash_draw(*parts: Column, seed: int = 0) -> Column:
    """A pseudo-random number strictly between 0 and 1."""
    return (hash_rank(*parts, seed=seed) + F.lit(0.5)) / F.lit(float(1 << 32))
