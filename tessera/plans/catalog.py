"""The operators as named queries over the driver tables, each with DuckDB SQL for the same rows where SQL can express it.

Subjects are users or customers, episodes are purchases or orders, evidence is other events or shipments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, sctid, text, values
from ..operators import cleaning, episodes, evidence, mapping, metrics, models, preprocess, profile, ranks, split, synth
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a scale factor's folder, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


def shown(c: Column | str) -> Column:
    """A time as text, the same in every engine."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


SHOWN = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def joined(labels: Column | str) -> Column:
    return F.array_join(F.array_sort(labels), "|")


# Cleaning


@query("""
SELECT p_partkey, nullif(nullif(replace(trim(upper(CASE WHEN p_size % 10 = 0 THEN ' none ' ELSE ' ' || p_brand || '. ' END)), '.', ''), 'NONE'), '') AS code FROM part
""")
def q01_clean_code(t: Tables) -> DataFrame:
    given = F.when(F.col("p_size") % 10 == 0, " none ").otherwise(F.concat(F.lit(" "), "p_brand", F.lit(". ")))
    return t.part.select("p_partkey", text.clean_icd(given).alias("code"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '4-%' THEN '__MISSING__' ELSE o_orderpriority END AS priority FROM orders
""")
def q02_clean_optional_text(t: Tables) -> DataFrame:
    given = F.when(F.col("o_orderpriority").startswith("4-"), " NaN ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("\t")))
    return t.orders.select("o_orderkey", text.with_missing_label(text.optional_text(given)).alias("priority"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL ELSE lower(regexp_replace(trim('   ' || replace(p_name, ' ', '    ') || ' '), '\\s+', ' ', 'g')) END AS name FROM part
""")
def q03_collapse_space(t: Tables) -> DataFrame:
    given = F.when(F.col("p_size") % 9 == 0, " N/A ").otherwise(F.concat(F.lit(" \t "), F.replace("p_name", F.lit(" "), F.lit("   \n")), F.lit(" ")))
    return t.part.select("p_partkey", text.collapsed_text(given, lower=True).alias("name"))


@query("""
SELECT doc_id, quality = 1 AS good, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE toxic = 1 END AS toxic FROM labels
""")
def q04_yes_no(t: Tables) -> DataFrame:
    toxic = F.when(F.col("doc_id") % 5 == 0, "na").when(F.col("toxic") == 1, " Yes ").otherwise("N")
    checks.ensure(checks.bad_values(t.labels, text.unreadable_yes_no(toxic)), "Unexpected values in toxic")
    return t.labels.select("doc_id", text.yes_no(F.col("quality")).alias("good"), text.yes_no(toxic).alias("toxic"))


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {SHOWN.format("o_orderdate")} END AS day,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {SHOWN.format("o_orderdate")} END AS mixed FROM orders
""")
def q05_lenient_timestamp(t: Tables) -> DataFrame:
    bad = F.col("o_orderkey") % 7 == 0
    iso = F.when(bad, "not-a-date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    other = F.when(bad, "").when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(iso)
    return t.orders.select("o_orderkey", shown(values.lenient_timestamp(iso)).alias("day"), shown(values.mixed_timestamp(other)).alias("mixed"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size + 0.5::DOUBLE END AS size FROM part
""")
def q06_lenient_numeric(t: Tables) -> DataFrame:
    given = F.when(F.col("p_size") % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 ")))
    return t.part.select("p_partkey", values.lenient_number(given).alias("size"))


@query("""
SELECT event_id, nullif(event_type, 'click') AS kind, CASE WHEN value < 20 THEN NULL ELSE value END AS value FROM events WHERE NOT (event_type = 'click' AND value < 20)
""")
def q07_drop_all_null(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", text.null_if(F.col("event_type"), "click").alias("kind"), F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    return rows.dropna("all", subset=["kind", "value"])


@query("""
SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) - 1 AS repeats FROM orders GROUP BY ALL
""")
def q08_distinct_rows(t: Tables) -> DataFrame:
    keys = ["o_custkey", "o_orderstatus", "o_orderpriority"]
    rows = t.orders.select(*keys)
    return rows.distinct().join(rows.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("repeats")), keys)


# Mapping

PREFIXES = """
codes AS (SELECT p_partkey, replace(upper(p_brand), '#', '') AS code FROM part),
map AS (SELECT DISTINCT code AS prefix, 'full_' || code AS label FROM codes UNION SELECT DISTINCT substr(code, 1, 6), 'short_' || substr(code, 1, 6) FROM codes)
"""


def brand_codes(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.replace(F.upper("p_brand"), F.lit("#"), F.lit("")).alias("code"))


def brand_map(codes: DataFrame) -> DataFrame:
    short = F.substring("code", 1, 6)
    return codes.select(F.col("code").alias("prefix"), F.concat(F.lit("full_"), "code").alias("label")).union(codes.select(short, F.concat(F.lit("short_"), short))).distinct()


@query("""
SELECT DISTINCT n_nationkey, unnest(['A0' || n_nationkey % 10, 'B1' || n_nationkey % 7]) AS prefix FROM nation
""")
def q09_prefix_expand(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    given = F.concat(F.lit(" a0."), (n % 10).cast("string"), F.lit(" |B 1"), (n % 7).cast("string"), F.lit("|a0"), (n % 10).cast("string"))
    checks.ensure(checks.bad_values(t.nation, text.icd_prefix_error(given)), "Bad prefix lists")
    return t.nation.select("n_nationkey", F.explode(text.icd_prefixes(given)).alias("prefix"))


@query(f"WITH {PREFIXES} SELECT p_partkey, string_agg(label, '|' ORDER BY label) AS labels FROM codes JOIN map ON starts_with(code, prefix) GROUP BY p_partkey")
def q10_prefix_join(t: Tables) -> DataFrame:
    codes = brand_codes(t)
    found = mapping.prefix_labels(codes, "code", brand_map(codes), "prefix", "label")
    return mapping.with_labels(codes, "code", found, "labels").select("p_partkey", joined("labels").alias("labels"))


@query("""
WITH map AS (SELECT DISTINCT lower(p_type) AS k, 'kind_' || lower(substr(p_type, 1, 3)) AS label FROM part WHERE p_type <> 'PROMO' UNION SELECT DISTINCT lower(p_type), 'size_' || length(p_type) FROM part WHERE p_type <> 'PROMO')
SELECT p_partkey, coalesce((SELECT string_agg(label, '|' ORDER BY label) FROM map WHERE k = lower(p_type)), '') AS labels FROM part
""")
def q11_exact_multilabel(t: Tables) -> DataFrame:
    kinds = t.part.filter("p_type <> 'PROMO'").select("p_type").distinct()
    own = kinds.select(F.concat(F.lit(" "), "p_type").alias("key"), F.concat(F.lit("kind_"), F.lower(F.substring("p_type", 1, 3))).alias("label"))
    own = own.union(kinds.select(F.lower("p_type"), F.concat(F.lit("size_"), F.length("p_type").cast("string"))))
    found = mapping.exact_labels(t.part, "p_type", own, "key", "label", lambda c: F.lower(F.trim(c)))
    return mapping.with_labels(t.part, "p_type", found, "labels").select("p_partkey", joined("labels").alias("labels"))


EVIDENCE = """
own AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['a'] WHEN 2 THEN ['a', 'b'] ELSE ['c'] END AS i,
  CASE p_partkey % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['b'] WHEN 2 THEN ['c', 'd'] WHEN 3 THEN ['a', 'c'] ELSE []::VARCHAR[] END AS s,
  CASE p_partkey % 2 WHEN 0 THEN ['m'] ELSE []::VARCHAR[] END AS m FROM part),
told AS (SELECT p_partkey, (len(i) > 0 AND len(s) > 0 AND len(list_intersect(i, s)) = 0)::INT AS coding_conflict,
  array_to_string(list_sort(list_distinct(CASE WHEN len(i) > 0 AND len(s) > 0 AND len(list_intersect(i, s)) = 0 THEN []::VARCHAR[] WHEN len(i) > 0 AND len(s) > 0 THEN list_concat(i, s) WHEN len(i) > 0 THEN i WHEN len(s) > 0 THEN s ELSE m END)), '|') AS conditions FROM own)
"""


def reconciled_parts(t: Tables) -> DataFrame:
    def labels(key: Column, cases: dict[int, list[str]]) -> Column:
        out = F.array().cast("array<string>")
        for k, own in cases.items():
            out = F.when(key == k, F.array(*map(F.lit, own))).otherwise(out)
        return out

    rows = t.part.select(
        "p_partkey",
        labels(F.col("p_size") % 4, {1: ["a"], 2: ["a", "b"], 3: ["c"]}).alias("icd_comorbidity"),
        labels(F.col("p_partkey") % 5, {1: ["b"], 2: ["c", "d"], 3: ["a", "c"]}).alias("snomed_comorbidity"),
        labels(F.col("p_partkey") % 2, {0: ["m"]}).alias("medication_comorbidity"),
    )
    return mapping.reconcile(rows)


@query(f"WITH {EVIDENCE} SELECT * FROM told")
def q12_reconcile(t: Tables) -> DataFrame:
    return reconciled_parts(t).select("p_partkey", "coding_conflict", joined("cci_condition").alias("conditions"))


@query(f"WITH {EVIDENCE} SELECT coding_conflict, conditions, count(*) AS n FROM told GROUP BY ALL")
def q13_conflict_summary(t: Tables) -> DataFrame:
    return reconciled_parts(t).groupBy("coding_conflict", joined("cci_condition").alias("conditions")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT DISTINCT user_id::VARCHAR AS subject, 'events' AS source, strftime(ts, '%Y-%m-%d') AS day, event_type AS icd_code, NULL::VARCHAR AS snomed_code FROM events
UNION SELECT o_custkey::VARCHAR, 'orders', strftime(o_orderdate, '%Y-%m-%d'), NULL, o_orderstatus FROM orders
UNION SELECT l_suppkey::VARCHAR, 'lineitem', strftime(l_shipdate, '%Y-%m-%d'), NULL, l_returnflag FROM lineitem
""")
def q14_standardise_union(t: Tables) -> DataFrame:
    names = {"events": {"user_id": "subject", "ts": "comorbidity_date", "event_type": "icd_code"}, "orders": {"o_custkey": "subject", "o_orderdate": "comorbidity_date", "o_orderstatus": "snomed_code"}, "lineitem": {"l_suppkey": "subject", "l_shipdate": "comorbidity_date", "l_returnflag": "snomed_code"}}
    parts = [evidence.standardised(getattr(t, name), name, own).select("subject", "source", F.date_format("comorbidity_date", "yyyy-MM-dd").alias("day"), "icd_code", "snomed_code") for name, own in names.items()]
    return evidence.combined(parts)


@query(f"""
SELECT l_orderkey, l_linenumber, {SHOWN.format("coalesce(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_shipdate END, o_orderdate)")} AS day,
  (l_linenumber % 3 = 0 AND o_orderdate IS NOT NULL)::INT AS imputed FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
""")
def q15_impute_dates(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_shipdate")).alias("day"))
    dates = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    out = evidence.with_imputed_dates(lines, dates, ["l_orderkey"], "day", "o_orderdate", "imputed")
    return out.select("l_orderkey", "l_linenumber", shown("day").alias("day"), "imputed")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')) AND lower(o_orderstatus) IN ('f', 'o')
""")
def q16_cohort_semi(t: Tables) -> DataFrame:
    cohort = t.customer.filter(F.lower("c_mktsegment").isin("building", "machinery")).select(F.col("c_custkey").alias("o_custkey"))
    return tables.cohort_extract(t.orders, cohort, "o_custkey", ("o_orderstatus", ("f", "o"))).select("o_orderkey", "o_custkey", "o_orderstatus")


# Episodes

KINDS = ("click", "error", "signup", "view")
FLAG_WEIGHTS = {"click": 1, "error": 2, "signup": 3, "view": 1}
FLAGS = """
first AS (SELECT user_id, event_type, min(ts) AS first_date FROM events WHERE event_type <> 'purchase' GROUP BY ALL),
eps AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
flags AS (SELECT e.event_id, e.user_id, coalesce(max((event_type = 'click')::INT), 0) AS click, coalesce(max((event_type = 'error')::INT), 0) AS error,
  coalesce(max((event_type = 'signup')::INT), 0) AS signup, coalesce(max((event_type = 'view')::INT), 0) AS view
  FROM eps e LEFT JOIN first f ON e.user_id = f.user_id AND first_date <= ts GROUP BY ALL)
"""


def purchases(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")


def other_events(t: Tables) -> DataFrame:
    return t.events.filter("event_type <> 'purchase'").select("user_id", "event_type", "ts")


def purchase_flags(t: Tables) -> DataFrame:
    evidence_rows = other_events(t).withColumnRenamed("ts", "seen")
    return episodes.episode_flags(evidence_rows, purchases(t), KINDS, "user_id", "event_id", "ts", "event_type", "seen")


@query(f"SELECT user_id, event_type, {SHOWN.format('min(ts)')} AS first_date FROM events GROUP BY user_id, event_type")
def q17_first_occurrence(t: Tables) -> DataFrame:
    return episodes.first_occurrence(t.events, "user_id", "event_type", "ts").withColumn("first_date", shown("first_date"))


@query(f"WITH {FLAGS} SELECT e.event_id, f.event_type, {SHOWN.format('first_date')} AS first_date FROM eps e JOIN first f ON e.user_id = f.user_id AND first_date <= ts")
def q18_episode_conditions(t: Tables) -> DataFrame:
    first = episodes.first_occurrence(other_events(t), "user_id", "event_type", "ts")
    return episodes.conditions_before(purchases(t), first, "user_id", "ts").select("event_id", "event_type", shown("first_date").alias("first_date"))


@query(f"WITH {FLAGS} SELECT * FROM flags")
def q19_episode_flags(t: Tables) -> DataFrame:
    return purchase_flags(t)


@query(f"WITH {FLAGS} SELECT *, (CASE WHEN error = 1 THEN 0 ELSE click END + 2 * error + 3 * signup + CASE WHEN signup = 1 THEN 0 ELSE view END)::INT AS score FROM flags")
def q20_weighted_score(t: Tables) -> DataFrame:
    return episodes.scored(purchase_flags(t), FLAG_WEIGHTS, {"click": "error", "view": "signup"}, "score")


@query("""
SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_shipdate END <= o_orderdate + INTERVAL 900 DAY, false)::INT AS died FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def q21_mortality_flag(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    death = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_shipdate"))
    return rows.select("l_orderkey", "l_linenumber", values.died_in_hospital(death, F.col("o_orderdate") + F.expr("INTERVAL 900 DAY")).alias("died"))


# Profile


@query("""
WITH d AS (SELECT o_custkey, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS outcome FROM orders),
s AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT o_custkey)::DOUBLE AS p, count(outcome)::DOUBLE AS o, sum(outcome)::DOUBLE AS pos, (SELECT count(*) FROM (SELECT DISTINCT * FROM d))::DOUBLE AS u FROM d)
SELECT unnest(['n_rows', 'n_columns', 'n_unique_patients', 'n_duplicate_rows', 'n_outcome_observed', 'n_outcome_positive', 'outcome_prevalence']) AS metric, round(unnest([n, 3.0::DOUBLE, p, n - u, o, pos, pos / o]), 9) AS value FROM s
""")
def q22_dataset_summary(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("outcome"))
    return profile.dataset_summary(rows, "o_custkey", "outcome").withColumn("value", F.round("value", 9))


@query("""
WITH l AS (SELECT 'l_quantity' AS variable, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
SELECT variable, count(v)::DOUBLE AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS q3, round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS max, count(*) - count(v) AS missing_count, round((count(*) - count(v)) / count(*), 9) AS missing_rate, round(skewness(v), 6) AS skewness FROM l GROUP BY variable
""")
def q23_describe(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("l_quantity", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")))
    out = profile.described(rows, ["l_quantity", "l_extendedprice", "l_discount"])
    exact = ("mean", "std", "p05", "q1", "median", "q3", "p95", "skewness")
    return out.withColumns({**{c: F.round(c, 6) for c in exact}, "missing_rate": F.round("missing_rate", 9)})


@query("""
WITH l AS (SELECT 'o_orderstatus' AS variable, o_orderstatus AS category FROM orders UNION ALL SELECT 'priority', coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), '__MISSING__') FROM orders)
SELECT variable, category, count(*) AS count, round(count(*) / (SELECT count(*) FROM orders), 9) AS proportion FROM l GROUP BY ALL
""")
def q24_frequency(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderstatus", text.null_if(F.col("o_orderpriority"), "4-NOT SPECIFIED").alias("priority"))
    return profile.frequencies(rows, ["o_orderstatus", "priority"]).withColumn("proportion", F.round("proportion", 9))


@query("""
WITH l AS (SELECT 'o_orderstatus' AS variable_1, 'priority' AS variable_2, o_orderstatus AS category_1, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), '__MISSING__') AS category_2 FROM orders
  UNION ALL SELECT 'o_orderstatus', 'year', o_orderstatus, year(o_orderdate)::VARCHAR FROM orders)
SELECT *, count(*) AS count, round(count(*) / (SELECT count(*) FROM orders), 9) AS proportion FROM l GROUP BY ALL
""")
def q25_pair_frequency(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderstatus", text.null_if(F.col("o_orderpriority"), "4-NOT SPECIFIED").alias("priority"), F.year("o_orderdate").alias("year"))
    return profile.pair_frequencies(rows, [("o_orderstatus", "priority"), ("o_orderstatus", "year")]).withColumn("proportion", F.round("proportion", 9))


@query("""
SELECT unnest(['event_id', 'kind', 'value']) AS variable, unnest(['bigint', 'string', 'double']) AS dtype, unnest([0, sum((event_type = 'click')::INT), sum((value < 20)::INT)])::BIGINT AS missing_count,
  round(unnest([0, sum((event_type = 'click')::INT), sum((value < 20)::INT)]) / max(n), 9) AS missing_rate FROM events, (SELECT count(*) AS n FROM events)
""")
def q26_missingness(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", text.null_if(F.col("event_type"), "click").alias("kind"), F.when(F.col("value") >= 20, F.col("value")).alias("value"))
    return profile.missingness(rows).withColumn("missing_rate", F.round("missing_rate", 9))


@query("""
WITH r AS (SELECT CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS q, l_extendedprice AS p, l_discount AS d, (l_linenumber % 5 = 0)::INT::DOUBLE AS m FROM lineitem),
pair AS (SELECT 'l_quantity' AS variable_1, 'l_extendedprice' AS variable_2, q AS x, p AS y FROM r UNION ALL SELECT 'l_quantity', 'l_discount', q, d FROM r UNION ALL SELECT 'l_quantity', '__missing__l_quantity', q, m FROM r
  UNION ALL SELECT 'l_extendedprice', 'l_discount', p, d FROM r UNION ALL SELECT 'l_extendedprice', '__missing__l_quantity', p, m FROM r UNION ALL SELECT 'l_discount', '__missing__l_quantity', d, m FROM r),
k AS (SELECT variable_1, variable_2, rank() OVER (PARTITION BY variable_1, variable_2 ORDER BY x) + (count(*) OVER (PARTITION BY variable_1, variable_2, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY variable_1, variable_2 ORDER BY y) + (count(*) OVER (PARTITION BY variable_1, variable_2, y) - 1) / 2 AS ry FROM pair WHERE x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT variable_1, variable_2, CASE WHEN min(rx) = max(rx) OR min(ry) = max(ry) THEN 0.0 ELSE corr(rx, ry) END AS rho FROM k GROUP BY ALL),
a AS (SELECT * FROM c UNION ALL SELECT variable_2, variable_1, rho FROM c UNION ALL SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', '__missing__l_quantity']), unnest(['l_quantity', 'l_extendedprice', 'l_discount', '__missing__l_quantity']), 1.0)
SELECT variable_1, variable_2, round(rho, 6) + 0.0 AS rho FROM a
""")
def q27_spearman(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("l_quantity", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")))
    flagged, names = profile.with_missing_flags(rows, ["l_quantity", "l_extendedprice", "l_discount"])
    return profile.spearman(flagged, names).withColumn("rho", F.round("rho", 6) + 0.0)


# Joins and checks


@query("""
SELECT o_orderkey, o_custkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey
""")
def q28_left_assembly(t: Tables) -> DataFrame:
    people = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    return episodes.assembled(t.orders, people, t.nation, ["o_custkey"], "n_nationkey").select("o_orderkey", "o_custkey", "c_mktsegment", "n_name")


@query("""
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE (o_orderstatus, o_orderpriority) NOT IN (VALUES ('F', '5-LOW'), ('O', '2-HIGH'))
""")
def q29_anti_bad_pairs(t: Tables) -> DataFrame:
    bad = tables.inline_table(t.spark, [("F", "5-LOW"), ("O", "2-HIGH")], ["o_orderstatus", "o_orderpriority"])
    return checks.without_pairs(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), bad)


@query("""
SELECT 'duplicate' AS rule, l_orderkey::VARCHAR AS key FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'varying', p_brand FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) + max((p_size IS NULL)::INT) > 1
UNION ALL SELECT 'overlap', c_nationkey::VARCHAR FROM customer WHERE c_nationkey <> 3 GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1
""")
def q30_key_checks(t: Tables) -> DataFrame:
    doubled = checks.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"]).select(F.lit("duplicate").alias("rule"), F.col("l_orderkey").cast("string").alias("key"))
    varying = checks.varying_in_group(t.part, ["p_brand"], "p_size").select(F.lit("varying"), "p_brand")
    reviewed = {"3": {r[0] for r in t.customer.filter("c_nationkey = 3").select("c_mktsegment").distinct().collect()}}
    overlap = checks.unreviewed_overlaps(t.customer.withColumn("key", F.col("c_nationkey").cast("string")), "key", "c_mktsegment", reviewed).select(F.lit("overlap"), "key")
    return doubled.union(varying).union(overlap)


# Splits

HASH = "('0x' || substr(md5({}), 1, 8))::BIGINT"
SIDES = f"""
g AS (SELECT o_custkey, arg_min(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END, (o_orderdate, o_orderkey)) AS label FROM orders GROUP BY o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH.format("o_custkey || '|29'")}, o_custkey) AS place, count(*) OVER (PARTITION BY label) AS size FROM g),
sides AS (SELECT o_custkey, label, CASE WHEN place <= floor(size * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS side FROM r)
"""


def labelled_orders(t: Tables) -> DataFrame:
    return t.orders.withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))


def order_sides(t: Tables) -> DataFrame:
    return split.random_sides(labelled_orders(t).withColumnRenamed("label", "target"), "o_custkey", "target", ["o_orderdate", "o_orderkey"])


@query(f"WITH {SIDES} SELECT * FROM sides")
def q31_split_random_hash(t: Tables) -> DataFrame:
    return order_sides(t)


TEMPORAL = """
f AS (SELECT o_custkey, min(o_orderdate) AS first FROM orders GROUP BY o_custkey),
c AS (SELECT make_timestamp(floor(quantile_cont(epoch_us(first)::DOUBLE, 0.8))::BIGINT) AS cut FROM f),
sides AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS label, CASE WHEN first <= cut AND o_orderdate <= cut THEN 'train' WHEN first <= cut THEN 'dropped' ELSE 'test' END AS side FROM orders JOIN f USING (o_custkey), c)
"""


@query(f"WITH {TEMPORAL} SELECT o_orderkey, side FROM sides")
def q32_split_temporal(t: Tables) -> DataFrame:
    return split.temporal_sides(t.orders, "o_custkey", "o_orderdate").select("o_orderkey", "side")


@query(f"WITH {TEMPORAL} SELECT side, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups, sum(label)::BIGINT AS n_positive, round(avg(label), 9) AS prevalence FROM sides GROUP BY side")
def q33_split_stats(t: Tables) -> DataFrame:
    sides = split.temporal_sides(labelled_orders(t), "o_custkey", "o_orderdate")
    return split.split_statistics(sides, "o_custkey", "label").withColumn("prevalence", F.round("prevalence", 9))


@query(f"""
WITH g AS (SELECT o_custkey, sum((o_orderstatus = 'F')::INT)::BIGINT AS positives, count(*) AS n FROM orders GROUP BY o_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY positives, n ORDER BY {HASH.format("o_custkey || '|42'")}, o_custkey) AS place FROM g)
SELECT o_custkey, positives, ((place + (positives * 3 + n) % 5) % 5 + 1)::INT AS fold FROM r
""")
def q34_group_folds(t: Tables) -> DataFrame:
    return split.group_folds(labelled_orders(t), "o_custkey", "label")


@query(f"WITH {SIDES} SELECT side, count(DISTINCT o_custkey) AS n_groups, 0::BIGINT AS shared FROM sides GROUP BY side")
def q35_split_disjoint(t: Tables) -> DataFrame:
    sides = split.with_side(labelled_orders(t), order_sides(t).select("o_custkey", "side"), "o_custkey")
    shared = checks.shared_groups(sides.filter("side = 'train'"), sides.filter("side = 'test'"), "o_custkey").count()
    return sides.groupBy("side").agg(F.count_distinct("o_custkey").alias("n_groups"), F.lit(shared).cast("long").alias("shared"))


# Preparation


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m) / s, 6) + 0.0 AS z FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)
""")
def q36_scale_population(t: Tables) -> DataFrame:
    mean, deviation = preprocess.population_scale(t.lineitem, ["l_quantity"])["l_quantity"]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.round(preprocess.scaled("l_quantity", mean, deviation), 6) + 0.0).alias("z"))


@query("""
WITH k AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), e AS (SELECT quantile_disc(n, 0.5) AS least FROM k)
SELECT p_partkey, string_agg(CASE WHEN n >= least THEN k.p_brand ELSE 'infrequent' END, '') AS hot FROM part JOIN k USING (p_brand), e GROUP BY p_partkey
""")
def q37_onehot_infrequent(t: Tables) -> DataFrame:
    counts = t.part.groupBy("p_brand").count()
    least = counts.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY count)")).first()[0]
    hot = preprocess.one_hot("p_brand", *preprocess.frequent_categories(t.part, ["p_brand"], int(least))["p_brand"])
    names = F.concat(*[F.when(e == 1, c.removeprefix("p_brand_")).otherwise("") for c, e in hot.items()])
    return t.part.select("p_partkey", names.alias("hot"))


@query("""
WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS v FROM part),
m AS (SELECT v FROM v WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)
SELECT p_partkey, coalesce(v.v, m.v)::DOUBLE AS size, (v.v IS NULL)::INT AS missing FROM v, m
""")
def q38_mode_impute(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("v"))
    mode = preprocess.modes(rows, ["v"])["v"]
    return rows.select("p_partkey", F.coalesce(F.col("v").cast("double"), F.lit(mode)).alias("size"), F.col("v").isNull().cast("int").alias("missing"))


# Metrics

SCORED = "s AS (SELECT quality AS y, n_chars::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def scored_labels(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id").select(F.col("quality").alias("y"), "score")


@query(f"""
WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS k FROM s)
SELECT round((sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 9) AS auroc FROM r
""")
def q39_auroc(t: Tables) -> DataFrame:
    return metrics.ranking(scored_labels(t), "y", "score").select(F.round("auroc", 9).alias("auroc"))


@query(f"""
WITH {SCORED}, g AS (SELECT score, sum(y) AS p, count(*) AS n FROM s GROUP BY score), c AS (SELECT p, sum(p) OVER w AS tp, sum(n) OVER w AS n FROM g WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(p * tp / n) / sum(p), 9) AS average_precision FROM c
""")
def q40_average_precision(t: Tables) -> DataFrame:
    return metrics.ranking(scored_labels(t), "y", "score").select(F.round("average_precision", 9).alias("average_precision"))


@query(f"WITH {SCORED}, m AS (SELECT min(score) AS a, max(score) AS b FROM s) SELECT round(avg(pow((score - a) / (b - a) - y, 2)), 9) AS brier FROM s, m")
def q41_brier(t: Tables) -> DataFrame:
    rows = scored_labels(t)
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    return rows.agg(F.round(metrics.brier(F.col("y"), (F.col("score") - low) / (high - low)), 9).alias("brier"))


@query("""
SELECT l_returnflag AS model, round(avg(l_quantity), 6) AS l_quantity_mean, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, round(stddev_samp(l_tax), 6) AS l_tax_std FROM lineitem GROUP BY ALL
""")
def q42_metric_summary(t: Tables) -> DataFrame:
    out = metrics.metric_summary(t.lineitem.select(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("fold"), "l_quantity", "l_tax"))
    return out.select("model", *[F.round(c, 6).alias(c) for c in out.columns if c != "model"])


# Synthesis


@query(f"""
WITH s AS (SELECT o_orderkey AS row_id, 0.5 + 0.00001 * o_totalprice + CASE WHEN o_orderpriority = '5-LOW' THEN -1.0 ELSE 0.0 END + ln((({HASH.format("o_orderkey || '|outcome|3'")} + 0.5) / 4294967296.0) / (1 - ({HASH.format("o_orderkey || '|outcome|3'")} + 0.5) / 4294967296.0)) AS score FROM orders)
SELECT row_id, (row_number() OVER (ORDER BY score DESC, row_id DESC) <= 1000)::INT AS outcome FROM s
""")
def q43_topk_outcome(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderpriority")
    score = synth.linear_predictor(0.5, {"o_totalprice": 0.00001, "o_orderpriority__5-LOW": -1.0}, ["o_totalprice", "o_orderpriority"], {}, "outcome")
    return synth.with_outcome(rows, score, 1000, "outcome", 3, rows.count()).select("row_id", "outcome")


QUANTILE_POINTS = {"min": 0.0, "p05": 2.0, "q1": 5.0, "median": 9.0, "q3": 20.0, "p95": 50.0, "max": 400.0}


@query("""
WITH g AS (SELECT i, i / 1000.0::DOUBLE AS p FROM range(0, 1001) r(i))
SELECT i, round(CASE WHEN p <= 0.05 THEN 0 + pow(p / 0.05, 0.125) * 2 WHEN p <= 0.25 THEN 2 + (p - 0.05) / 0.2 * 3 WHEN p <= 0.5 THEN 5 + (p - 0.25) / 0.25 * 4 WHEN p <= 0.75 THEN 9 + (p - 0.5) / 0.25 * 11
  WHEN p <= 0.95 THEN 20 + (p - 0.75) / 0.2 * 30 ELSE 50 + pow((p - 0.95) / 0.05, 8) * 350 END, 4) AS value FROM g
""")
def q44_quantile_inverse(t: Tables) -> DataFrame:
    grid = t.spark.range(1001).withColumnRenamed("id", "i")
    return grid.select("i", F.round(synth.quantile_inverse(F.col("i") / 1000.0, QUANTILE_POINTS), 4).alias("value"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(*) AS different FROM orders GROUP BY ALL")
def q45_exact_sample(t: Tables) -> DataFrame:
    keys = ["o_orderstatus", "o_orderpriority"]
    made = synth.expanded_counts(t.orders.groupBy(*keys).count(), keys, 7)
    return made.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("different"))


@query(f"""
WITH v AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders),
d AS (SELECT o_orderkey, row_number() OVER (ORDER BY {HASH.format("o_orderkey || '|11'")}, o_orderkey) AS place FROM orders)
SELECT d.o_orderkey, place, o_totalprice FROM d JOIN v USING (place)
""")
def q46_rank_reorder(t: Tables) -> DataFrame:
    drawn = ranks.ranked(t.orders.select("o_orderkey", values.hash_rank(F.col("o_orderkey").cast("string"), seed=11).alias("h")), "h", "o_orderkey").select("o_orderkey", "place")
    own = ranks.ranked(t.orders.select(F.col("o_orderkey").alias("k"), "o_totalprice"), "o_totalprice", "k").select("place", "o_totalprice")
    return drawn.join(own, "place")


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_distance(a.v, b.v), 9) AS distance FROM e a, e b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS place FROM d)
SELECT query, neighbour, place::INT AS place, round(distance, 6) AS distance FROM r WHERE place <= 5
""")
def q47_knn(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", "embedding")
    return models.nearest(rows, rows, "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query()
def q48_sctid_check(t: Tables) -> DataFrame:
    body = F.concat(F.lit("1"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit("00"))
    code = F.concat(body, sctid.check_digit(body))
    wrong = F.concat(body, ((sctid.check_digit(body).cast("int") + 1) % 10).cast("string"))
    return t.orders.select("o_orderkey", code.alias("code"), sctid.is_valid(code).alias("valid"), sctid.is_valid(wrong).alias("wrong_valid"))


@query()
def q49_logistic_cv(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "lang", "source"), "doc_id").withColumn("grp", F.col("doc_id") % 97)
    folds = split.group_folds(rows, "grp", "quality")
    ready = lambda: preprocess.Preprocessor(["n_chars"], ["lang", "source"], [])
    chosen = {k: models.MODELS[k] for k in ("Dummy", "Logistic L2")}
    return models.cross_validated(rows.drop("toxic", "doc_id"), folds, "grp", "quality", ready, chosen)


@query()
def q50_synth_dataset(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", F.when(F.col("l_partkey") % 9 != 0, F.col("l_extendedprice")).alias("l_extendedprice"))
    n = rows.count()
    numbers = ["l_quantity", "l_extendedprice"]

    def texts(df: DataFrame) -> list[dict[str, str]]:
        return [{k: str(v) for k, v in r.asDict().items()} for r in df.collect()]

    fields = [("subject", "object"), ("infection_id", "object"), ("admission_date", "object"), ("outcome", "int64"), ("l_returnflag", "object"), ("l_linestatus", "object"), ("l_quantity", "float64"), ("l_extendedprice", "float64")]
    described = texts(profile.described(rows, numbers))
    missing = {r["variable"]: r["missing_count"] for r in described}
    flagged, names = profile.with_missing_flags(rows, numbers)
    summaries = {
        "dataset": [{"metric": k, "value": str(v)} for k, v in (("n_rows", n), ("n_unique_patients", max(1, n // 2)), ("n_columns", len(fields)), ("n_outcome_positive", n // 3))],
        "missingness": [{"variable": f, "dtype": d, "missing_count": missing.get(f, "0")} for f, d in fields],
        "continuous": described,
        "categorical": texts(profile.frequencies(rows, ["l_returnflag", "l_linestatus"])),
        "dependencies": [{**r, "correlation": r["rho"]} for r in texts(profile.spearman(flagged, names))],
        "coefficients": [{"variable": k, "coefficient": str(v)} for k, v in (("const", -1.0), ("l_quantity", 0.02), ("l_returnflag__R", 0.7))],
    }
    return synth.synthetic_table(t.spark, summaries, outcome="outcome")
