"""Check digits of SNOMED CT identifiers, by higher-order functions on literal tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

SHAPE = "^[1-9][0-9]{5,17}$"
#: Fixed: partitions of concept identifiers.
PARTITIONS = ("00", "10")
#: Fixed: one permutation of the Verhoeff scheme; the others are its powers.
STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def dihedral(a: int, b: int) -> int:
    """The product of two elements of the dihedral group of ten elements: rotations 0-4, reflections 5-9."""
    turn = (a + b if a < 5 else a - b) % 5
    return turn + 5 * ((a < 5) != (b < 5))


def tables() -> tuple[list[list[int]], list[list[int]], list[int]]:
    """(product, permutation of each of eight positions, inverse)."""
    product = [[dihedral(a, b) for b in range(10)] for a in range(10)]
    places = [list(range(10))]
    for _ in range(7):
        places.append([STEP[d] for d in places[-1]])
    return product, places, [row.index(0) for row in product]


PRODUCT, PLACES, INVERSE = tables()


def table(rows: list[int]) -> Column:
    return F.array(*map(F.lit, rows))


def checksum(digits: Column, offset: int = 0) -> Column:
    """The Verhoeff checksum of a text of digits, from the right, counting positions from offset."""
    product, places = table(sum(PRODUCT, [])), table(sum(PLACES, []))
    own = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    indexed = F.transform(own, lambda d, i: F.get(places, ((i + offset) % 8) * 10 + d))
    return F.aggregate(indexed, F.lit(0), lambda acc, p: F.get(product, acc * 10 + p))


def check_digit(body: Column) -> Column:
    """The digit that makes the body an identifier; null unless the body has digits only."""
    return F.when(body.rlike("^[0-9]+$"), F.get(table(INVERSE), checksum(body, 1)).cast("string"))


def is_valid(code: Column) -> Column:
    """Whether a text has an identifier's shape and check digit."""
    return F.coalesce(F.when(code.rlike(SHAPE), checksum(code) == 0), F.lit(False))


def cleaned(code: Column, concept_id: Column, repaired: Column, repair_concept: Column) -> Column:
    """A struct (code, error): the valid identifier, or the audited repair, or what is wrong.

    repaired and repair_concept come from a join with the audited repairs on the stripped code, null where there
    is none; a repair needs the concept that it was audited with.
    """
    own = stripped(code)
    concept = stripped(concept_id.cast("string"))
    error = (
        F.when(own.isNull(), F.lit("identifier is missing"))
        .when(~own.rlike(SHAPE), F.concat(F.lit("not an identifier of 6 to 18 digits as text: "), own))
        .when(~F.substring(own, -3, 2).isin(*PARTITIONS), F.concat(F.lit("not in a concept partition: "), own))
        .when(is_valid(own), F.lit(None).cast("string"))
        .when(repaired.isNull(), F.concat(F.lit("invalid check digit: "), own))
        .when(~concept.eqNullSafe(repair_concept), F.concat(F.lit("audited repair requires concept "), repair_concept, F.lit(": "), own))
    )
    value = F.when(error.isNull(), F.when(is_valid(own), own).otherwise(repaired))
    return F.struct(value.alias("code"), error.alias("error"))
