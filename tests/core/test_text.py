import pytest
from pyspark.sql import functions as F

from tessera.functions import checks, text, values


def column(spark, rows, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], f"c {kind}").select(expression(F.col("c"))).collect()]


def test_codes(spark):
    assert column(spark, [" i25.2 ", "none", "", None, "C.0.", " None. "], text.clean_icd) == ["I252", None, None, None, "C0", None]
    assert column(spark, [" 44 ", "none", "NONE", "None", " "], text.clean_code) == ["44", None, None, "None", None]


def test_optional_text(spark):
    assert column(spark, [" A ", "NaN", "NULL", "none ", "n/a"], text.optional_text) == ["A", None, None, None, "n/a"]
    given = ["  Insulin   Soluble  ", "N/A", "na", "", "nan", "None", "null", "a \tb", None]
    assert column(spark, given, lambda c: text.collapsed_text(c, True)) == ["insulin soluble", None, None, None, None, None, None, "a b", None]


def test_yes_no(spark):
    given = ["Y", " yes", "TRUE", "1", "n", "No ", "false", "0", "", "na", None, "perhaps"]
    assert column(spark, given, text.yes_no) == [True] * 4 + [False] * 4 + [None] * 4
    assert column(spark, given, text.unreadable_yes_no) == [None] * 11 + ["perhaps"]
    assert column(spark, [True, False, None], text.yes_no, "boolean") == [True, False, None]
    assert column(spark, [1, 0], text.yes_no, "int") == [True, False]


def test_prefix_lists(spark):
    assert column(spark, [" i25.2 | C0 | i25.2 | e11.9 "], text.icd_prefixes) == [["I252", "C0", "E119"]]
    errors = column(spark, [None, "I21||I22", "I21|not-a-code", "I21", "I21|"], text.icd_prefix_error)
    assert [e is None for e in errors] == [False, False, False, True, False]


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], "` Subject ` int, CODE int")
    assert text.normalised_headers(df).columns == ["subject", "code"]
    with pytest.raises(ValueError, match="code"):
        text.normalised_headers(spark.createDataFrame([(1, 2)], ["code", " Code "]))


def test_times_and_numbers(spark):
    given = ["2020-01-02", "2020-01-02 03:04:05", "02/03/2020", "not a date", None]
    assert [str(x) for x in column(spark, given, values.lenient_timestamp)] == ["2020-01-02 00:00:00", "2020-01-02 03:04:05", "None", "None", "None"]
    assert [str(x) for x in column(spark, given, values.mixed_timestamp)] == ["2020-01-02 00:00:00", "2020-01-02 03:04:05", "2020-03-02 00:00:00", "None", "None"]
    assert column(spark, [" 1.5 ", "x", None], values.lenient_number) == [1.5, None, None]
    assert column(spark, [2.5, 3.5, 1.23456], lambda c: values.rounded(c, "int64"), "double") == [2, 4, 1]
    with pytest.raises(ValueError):
        values.random_date("2020-01-02", "2020-01-01", F.lit(0.5))
    days = [str(r[0]) for r in spark.range(200).select(values.random_date("2020-01-01", "2020-01-03", values.hash_draw(F.col("id").cast("string")))).distinct().collect()]
    assert sorted(days) == ["2020-01-01", "2020-01-02", "2020-01-03"]


def test_indicators():
    assert text.indicator("site__a__b", ["site", "site__a"]) == ("site__a", "b")
    assert text.indicator("site__a__b", ["site"]) == ("site", "a__b")
    assert text.indicator("a___b", ["a"]) == ("a", "_b") and text.indicator("a___b", ["a_", "a"]) == ("a_", "b")
    assert text.indicator("other", ["site"]) is None and text.indicator("__x", [""]) is None


def test_checks(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 1), (None, "y", 1)], "k string, v string, n int")
    with pytest.raises(ValueError, match="missing"):
        checks.require_columns(df, ["missing", "k"])
    with pytest.raises(ValueError, match="k"):
        checks.ensure(checks.null_keys(df, ["k", "v"]), "Null values in")
    with pytest.raises(ValueError, match="a"):
        checks.ensure(checks.duplicate_keys(df, ["k", "v"]), "duplicate keys")
    assert [tuple(r) for r in checks.varying_in_group(df, ["k"], "n").collect()] == [("a",)]
    with pytest.raises(ValueError):
        checks.require_binary(df, ["n"])
    checks.require_binary(df.filter("n = 1"), ["n"])
    with pytest.raises(TypeError):
        checks.require_arrays(df, ["k"])
    pairs = spark.createDataFrame([("a", "x")], "k string, v string")
    assert checks.without_pairs(df, pairs).count() == 2
    assert checks.unreviewed_overlaps(df.filter("k = 'a'"), "v", "n", {}).count() == 1
    with pytest.raises(ValueError):
        checks.require_enough_groups(df.filter("k IS NOT NULL"), "n", "k", 5)
    assert checks.counts_sum_to(df, ["v"], "n", 3).count() == 1
