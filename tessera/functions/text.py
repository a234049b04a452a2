"""Column expressions that clean codes and free text; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: texts that count as missing, in lower case, by kind of source.
MISSING_OPTIONAL = ("", "none", "null", "nan")
MISSING_PRESCRIPTION = ("", "none", "null", "nan", "n/a", "na")
#: Fixed: texts that a CSV scan reads as missing.
MISSING_CSV = ("", "NA", "N/A", "n/a", "null", "NULL", "nan", "NaN", "None", "<NA>", "#N/A", "-nan", "-NaN", "#NA", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A")
#: Fixed: encodings of yes and no, in lower case.
YES, NO = ("y", "yes", "true", "1"), ("n", "no", "false", "0")
MISSING_LABEL = "__MISSING__"
ICD_PREFIX = "^[A-Z][0-9][A-Z0-9]{0,5}$"


def stripped(c: Column) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalised_headers(df: DataFrame, strip: bool = True) -> DataFrame:
    """Column names in lower case, stripped; two that become equal are an error, as Spark would not tell them apart."""
    names = [(c.strip() if strip else c).lower() for c in df.columns]
    if doubled := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError(f"Duplicate columns after normalising names: {doubled}")
    return df.toDF(*names)


def clean_icd(c: Column) -> Column:
    """Upper case, stripped, without dots; NONE and empty are null."""
    return null_if(F.replace(stripped(F.upper(c)), F.lit("."), F.lit("")), "NONE", "")


def clean_code(c: Column) -> Column:
    """Stripped; none, NONE and empty are null."""
    return null_if(stripped(c), "none", "NONE", "")


def null_if(c: Column, *missing: str) -> Column:
    return F.when(~c.isin(*missing), c)


def optional_text(c: Column) -> Column:
    """Stripped, case kept; missing words are null."""
    own = stripped(c.cast("string"))
    return F.when(~F.lower(own).isin(*MISSING_OPTIONAL), own)


def collapsed_text(c: Column, lower: bool = False) -> Column:
    """Stripped, with single spaces, in lower case if asked; missing words are null."""
    own = F.regexp_replace(stripped(c.cast("string")), r"(?U)\s+", " ")
    own = F.lower(own) if lower else own
    return F.when(~F.lower(own).isin(*MISSING_PRESCRIPTION), own)


def yes_no(c: Column) -> Column:
    """True, false, or null for missing; see unreadable_yes_no() for the rest."""
    own = F.lower(stripped(c.cast("string")))
    return F.when(own.isin(*YES), True).when(own.isin(*NO), False)


def unreadable_yes_no(c: Column) -> Column:
    """The stripped text where it is neither yes, no nor missing, else null."""
    own = stripped(c.cast("string"))
    return F.when(~F.lower(own).isin(*YES, *NO, *MISSING_PRESCRIPTION), own)


def icd_prefixes(c: Column) -> Column:
    """A list of prefixes divided by |, each without white space and dots and in upper case, once each in order."""
    own = F.transform(F.split(c, r"\|", -1), lambda p: F.replace(F.upper(F.regexp_replace(p, r"(?U)\s+", "")), F.lit("."), F.lit("")))
    return F.array_distinct(own)


def icd_prefix_error(c: Column) -> Column:
    """What is wrong with a list of prefixes, else null."""
    own = icd_prefixes(c)
    bad = F.filter(own, lambda p: (p != "") & ~p.rlike(ICD_PREFIX))
    return (
        F.when(c.isNull(), F.lit("no list"))
        .when(F.array_contains(own, ""), F.concat(F.lit("nothing between two bars of "), c))
        .when(F.size(bad) > 0, F.concat(F.lit("no letter and digit at the start of "), F.array_join(bad, ", ")))
    )


def mapped(c: Column, names: dict[str, str]) -> Column:
    """The name of a stripped label; null if it has none."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[stripped(c)]


def with_missing_label(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING_LABEL))


def without_missing_label(c: Column) -> Column:
    return F.when(c != MISSING_LABEL, c)


def numbered_id(prefix: str, number: Column, digits: int) -> Column:
    """A made-up identifier such as SYN-P000001; of a longer number only the first digits stay, as lpad in SQL has it."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), digits, "0"))


def whole_id(prefix: str, number: Column, digits: int) -> Column:
    """A made-up identifier of at least so many digits; longer numbers stay whole, so that different ones stay different."""
    own = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(own, F.greatest(F.lit(digits), F.length(own)), "0"))


def indicator(term: str, fields: list[str]) -> tuple[str, str] | None:
    """What a term field__category names: the cut between both is the last one that leaves a known field before it."""
    known, cut = set(fields), len(term)
    while (cut := term.rfind("__", 0, cut + 1 if cut < len(term) else cut)) > 0:
        if term[:cut] in known:
            return term[:cut], term[cut + 2 :]
    return None
