"""More operators as named queries with DuckDB SQL: sources and sinks, cleaners, rules, maps, preparation, models and synthesis."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, sctid, text, values
from ..operators import cleaning, mapping, metrics, models, preprocess, profile, split, synth
from ..sources import schemas, tables
from . import dataset
from .catalog import HASH, ORACLE_SQL, SHOWN, SIDES, TEMPORAL, Tables, joined, labelled_orders, order_sides, query, shown


def raised(run) -> bool:
    """Whether a rule stops the run."""
    try:
        run()
    except (ValueError, TypeError, KeyError, FileNotFoundError):
        return True
    return False


def literal(own: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in own) + "]"


def folder(t: Tables) -> str:
    """A new folder in the place that driver and executors share."""
    return f"{tables.shared_folder(t.spark)}/tessera-files-{uuid.uuid4().hex}"


# Sources and sinks

CUSTOMERS = "SELECT lpad(c_custkey::VARCHAR, 18, '0') AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal AS balance FROM customer"


def customer_file(t: Tables, path: str) -> str:
    segment = F.when(F.col("c_custkey") % 5 == 0, "NA").otherwise(F.col("c_mktsegment"))
    tables.write_table(t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 18, "0").alias("id"), segment.alias("segment"), F.concat(F.lit(" "), F.col("c_acctbal").cast("string")).alias("balance"), F.lit('a "b", c').alias("note")), path, "csv")
    return path


@query(f"SELECT *, 'a \"b\", c' AS note FROM ({CUSTOMERS})")
def q51_csv_text(t: Tables) -> DataFrame:
    rows = tables.csv_text(t.spark, customer_file(t, folder(t)), ["note", "segment", "id", "balance"])
    return rows.select("id", "segment", values.lenient_number(F.col("balance")).alias("balance"), "note")


@query(f"SELECT id, segment, balance FROM ({CUSTOMERS})")
def q52_csv_typed(t: Tables) -> DataFrame:
    return tables.csv_typed(t.spark, customer_file(t, folder(t)), "id string, segment string, balance double")


@query("SELECT r_regionkey::INT AS r_regionkey, r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def q53_csv_inferred(t: Tables) -> DataFrame:
    path = folder(t)
    tables.write_table(t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name"), path, "csv")
    return tables.csv_inferred(t.spark, path).groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT unnest(['empty', 'absent', 'rows']) AS metric, unnest(['error', 'error', count(*)::VARCHAR]) AS value FROM orders
""")
def q54_summary_rows(t: Tables) -> DataFrame:
    path, empty = folder(t), folder(t)
    tables.write_table(t.orders.agg(F.lit("rows").alias("metric"), F.count(F.lit(1)).alias("value")), path, "csv")
    tables.write_table(t.spark.createDataFrame([], "metric string, value string").coalesce(1), empty, "csv")
    found = [(r["metric"], r["value"]) for r in tables.summary_rows(t.spark, path)]
    found += [(k, "error" if raised(lambda p=p: tables.summary_rows(t.spark, p)) else "read") for k, p in (("empty", empty), ("absent", f"{path}-none"))]
    return t.spark.createDataFrame(found, "metric string, value string")


@query("SELECT n_name, n_regionkey::VARCHAR AS n_regionkey, (row_number() OVER (ORDER BY n_nationkey) + 1)::INT AS source_row FROM nation")
def q55_workbook(t: Tables) -> DataFrame:
    path = f"{folder(t)}.csv"
    tables.write_table(t.nation.coalesce(1).sortWithinPartitions("n_nationkey").select("n_name", "n_regionkey"), path, "csv")
    return tables.workbook(t.spark, path)


@query("""
SELECT 'icd_map' AS name, count(*) AS n FROM part UNION ALL SELECT 'medication_map', count(*) FROM supplier UNION ALL SELECT 'missing source', 1 UNION ALL SELECT 'written after a failed check', 0
""")
def q56_bundle(t: Tables) -> DataFrame:
    """Files written after their checks, found by a bundle of paths; an absent one, or a failed check, stops all."""
    path = folder(t)
    icd = t.part.select(F.col("p_type").alias("comorbidity"), F.col("p_brand").alias("icd_code"), F.lit(1).alias("weight"))
    drugs = t.supplier.select(F.lit("a").alias("comorbidity"), F.col("s_name").alias("medication_name"))
    paths = {"icd_map": f"{path}/icd", "medication_map": f"{path}/drugs"}
    tables.write_all({"icd": (icd, paths["icd_map"]), "drugs": (drugs, paths["medication_map"])}, [lambda: checks.require_columns(icd, ["weight"])], "csv")
    raised(lambda: tables.write_all({"icd": (icd, f"{path}/never")}, [lambda: checks.require_columns(icd, ["other"])], "csv"))
    found = [(name, df.count()) for name, df in tables.bundle(t.spark, paths, list(paths)).items()]
    found.append(("missing source", int(raised(lambda: tables.bundle(t.spark, paths | {"snomed_map": f"{path}/none"}, ["icd_map", "snomed_map"])))))
    found.append(("written after a failed check", int(tables.path_exists(t.spark, f"{path}/never"))))
    return t.spark.createDataFrame(found, "name string, n long")


@query(f"WITH {SIDES} SELECT side, count(*) AS n, count(DISTINCT o_custkey) AS groups, sum((o_orderstatus = 'F')::INT)::BIGINT AS positives FROM orders JOIN sides USING (o_custkey) GROUP BY side")
def q57_train_test_pair(t: Tables) -> DataFrame:
    path = folder(t)
    sides = split.with_side(labelled_orders(t).select("o_custkey", "label"), order_sides(t).select("o_custkey", "side"), "o_custkey")
    split.validate_split(sides, "o_custkey", n_rows=t.orders.count())
    for side in ("train", "test"):
        tables.write_table(sides.filter(F.col("side") == side).drop("side"), f"{path}/{side}_random")
    train, test = tables.train_test_pair(t.spark, path, target="label")
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("groups"), F.sum("label").alias("positives"))


# Cleaning


@query("SELECT n_nationkey, n_name FROM nation")
def q58_headers(t: Tables) -> DataFrame:
    return text.normalised_headers(t.nation.select(F.col("n_nationkey").alias(" N_NationKey"), F.col("n_name").alias("N_NAME ")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_type END AS code FROM part")
def q59_clean_code(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    given = F.when(k == 0, " none ").when(k == 1, "\t").otherwise(F.concat(F.lit(" "), "p_type", F.lit("\n")))
    return t.part.select("p_partkey", text.clean_code(given).alias("code"))


#: The check digits as SQL: products of the group and permutations by place as flat lists.
VERHOEFF = f"""
g AS (SELECT {sum(sctid.PRODUCT, [])} AS product, {sum(sctid.PLACES, [])} AS places, {sctid.INVERSE} AS inverse),
own AS (SELECT o_orderkey, '1' || lpad(o_orderkey::VARCHAR, 8, '0') || CASE WHEN o_orderkey % 6 = 0 THEN '11' ELSE '00' END AS body FROM orders),
sums AS (SELECT o_orderkey, body, inverse[1 + list_reduce(list_prepend(0, list_transform(range(1, len(body) + 1), lambda i: places[1 + (i % 8) * 10 + substr(reverse(body), i::INT, 1)::INT])), lambda a, p: product[1 + a * 10 + p])] AS digit FROM own, g)
"""


@query(f"WITH {VERHOEFF} SELECT o_orderkey, body || digit AS code, true AS valid, false AS wrong_valid FROM sums")
def q60_check_digits(t: Tables) -> DataFrame:
    code = concept_code()
    wrong = F.concat(F.left(code, F.length(code) - 1), ((F.right(code, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    return t.orders.select("o_orderkey", code.alias("code"), sctid.is_valid(code).alias("valid"), sctid.is_valid(wrong).alias("wrong_valid"))


def concept_code() -> Column:
    body = F.concat(F.lit("1"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.when(F.col("o_orderkey") % 6 == 0, "11").otherwise("00"))
    return F.concat(body, sctid.check_digit(body))


ORACLE_SQL["q48_sctid_check"] = f"WITH {VERHOEFF} SELECT o_orderkey, body || digit AS code, true AS valid, false AS wrong_valid FROM sums".replace("CASE WHEN o_orderkey % 6 = 0 THEN '11' ELSE '00' END", "'00'")


@query(f"""
WITH {VERHOEFF} SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (1, 2) THEN NULL WHEN o_orderkey % 5 = 3 THEN '12237231000119107' WHEN o_orderkey % 6 = 0 THEN NULL ELSE body || digit END AS code,
  CASE WHEN o_orderkey % 5 = 1 THEN 'shape' WHEN o_orderkey % 5 = 2 THEN 'concept' WHEN o_orderkey % 5 = 3 THEN NULL WHEN o_orderkey % 6 = 0 THEN 'partition' END AS error FROM sums
""")
def q61_concept_cleaning(t: Tables) -> DataFrame:
    """Valid codes, codes of a wrong shape or partition, and the audited repair with its concept and without."""
    k = F.col("o_orderkey") % 5
    given = F.when(k == 1, "22298.0").when(k.isin(2, 3), "12237231000119100").otherwise(concept_code())
    audited = tables.inline_table(t.spark, schemas.SNOMED_REPAIRS, ["given", "repair_concept", "repaired"])
    rows = t.orders.select("o_orderkey", given.alias("given"), F.when(k == 3, "36712807").alias("concept")).join(mapping.small(audited), "given", "left")
    found = rows.withColumn("found", sctid.cleaned(F.col("given"), F.col("concept"), F.col("repaired"), F.col("repair_concept")))
    error = F.when(F.col("found.error").contains("digits as text"), "shape").when(F.col("found.error").contains("requires concept"), "concept").when(F.col("found.error").contains("partition"), "partition").otherwise(F.col("found.error"))
    return found.select("o_orderkey", "found.code", error.alias("error"))


NAMES = list(schemas.LABELS)
SQL_LABELS = f"{literal(NAMES)}[1 + s_suppkey % {len(NAMES)}]"


@query(f"""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE {literal(list(schemas.LABELS.values()))}[1 + s_suppkey % {len(NAMES)}] END AS label,
  CASE s_nationkey % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' WHEN 2 THEN 'other' END AS area FROM supplier
""")
def q62_labels(t: Tables) -> DataFrame:
    given = F.when(F.col("s_suppkey") % 3 == 0, "no such label").otherwise(F.concat(F.lit(" "), name_of(F.col("s_suppkey")), F.lit(" ")))
    area = F.when(F.col("s_nationkey") % 4 < 3, F.concat(F.lit("a"), (F.col("s_nationkey") % 4).cast("string")))
    return t.supplier.select("s_suppkey", text.mapped(given, schemas.LABELS).alias("label"), dataset.grouped_label(area, {"a0": "north", "a1": "south"}).alias("area"))


def name_of(number: Column) -> Column:
    return F.get(F.array(*map(F.lit, NAMES)), (number % len(NAMES)).cast("int"))


def sql_hash(*parts: str, seed: int) -> str:
    return HASH.format(" || '|' || ".join([*parts, f"'{seed}'"]))


@query(f"""
SELECT o_orderkey, 'SYN-I' || lpad(o_orderkey::VARCHAR, 7, '0') AS id, strftime(DATE '2015-01-01' + floor(({sql_hash("o_orderkey", seed=5)} + 0.5) / 4294967296.0 * (date_diff('day', DATE '2015-01-01', DATE '2025-09-01') + 1))::INT, '%Y-%m-%d') AS day,
  round_even(o_totalprice / 8, 0)::BIGINT AS whole, round_even(floor(o_totalprice) / 8, 2) AS share FROM orders
""")
def q63_made_values(t: Tables) -> DataFrame:
    """Identifiers, random dates, and numbers rounded by their type."""
    key = F.col("o_orderkey").cast("string")
    whole = values.rounded(F.col("o_totalprice") / 8, "int64")
    share = F.bround(values.rounded(F.floor("o_totalprice") / 8, "float64"), 2)
    day = values.random_date("2015-01-01", "2025-09-01", values.hash_draw(key, seed=5))
    return t.orders.select("o_orderkey", text.numbered_id("SYN-I", F.col("o_orderkey"), 7).alias("id"), F.date_format(day, "yyyy-MM-dd").alias("day"), whole.alias("whole"), share.alias("share"))


@query("SELECT DISTINCT user_id::VARCHAR AS subject, event_type AS problem_code, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events WHERE event_type <> 'view'")
def q64_clean_problems(t: Tables) -> DataFrame:
    code = F.when(F.col("event_type") == "view", " none ").otherwise(F.concat(F.lit(" "), "event_type"))
    day = F.when(F.col("event_id") % 7 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rows = t.events.select(F.col("user_id").cast("string").alias(" SUBJECT"), code.alias("Problem_Code"), F.lit("NaN").alias("problem_desc"), day.alias("problem_dt_tm"))
    return cleaning.clean_problems(rows).select("subject", "problem_code", F.date_format("problem_dt_tm", "yyyy-MM-dd").alias("day"))


@query("""
SELECT DISTINCT l_suppkey::VARCHAR AS spell, 'A' || l_linestatus AS icd, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS snomed, CASE WHEN l_linenumber = 3 THEN NULL ELSE strftime(l_shipdate, '%Y') END AS year FROM lineitem
""")
def q65_clean_diagnoses(t: Tables) -> DataFrame:
    day = F.when(F.col("l_linenumber") == 3, "").otherwise(F.date_format("l_shipdate", "yyyy-01-01"))
    rows = t.lineitem.select(
        F.col("l_suppkey").cast("string").alias("SPELL"), day.alias("DIAGNOSIS_DATE"), F.concat(F.lit(" .a."), F.lower("l_linestatus")).alias("DIAGNOSIS_CODE_ICD"),
        F.when(F.col("l_linenumber") == 2, "none").otherwise(F.col("l_returnflag")).alias("DIAGNOSIS_CODE_SNOMED"), F.lit("").alias("DIAGNOSIS_DESC_ICD"), F.lit("NONE").alias("DIAGNOSIS_DESC_SNOMED"))
    out = cleaning.clean_diagnoses(rows).filter("diagnosis_desc_icd IS NULL AND diagnosis_desc_snomed IS NULL")
    return out.select("spell", F.col("diagnosis_code_icd").alias("icd"), F.col("diagnosis_code_snomed").alias("snomed"), F.date_format("diagnosis_date", "yyyy").alias("year"))


@query("""
WITH c AS (SELECT DISTINCT l_suppkey::VARCHAR AS subject, 'drug ' || lower(l_returnflag) AS drug, l_linestatus = 'O' AS given, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_shipdate END AS day FROM lineitem WHERE l_returnflag <> 'A')
SELECT subject, drug, given, strftime(day, '%Y-%m-%d') AS day FROM c
""")
def q66_clean_prescriptions(t: Tables) -> DataFrame:
    drug = F.when(F.col("l_returnflag") == "A", "N/A").otherwise(F.concat(F.lit(" Drug  "), "l_returnflag"))
    day = F.when(F.col("l_linenumber") == 1, "not-a-date").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy"))
    rows = t.lineitem.select(F.col("l_suppkey").cast("string").alias("SUBJECT"), drug.alias("MEDICATION_NAME_SHORT"), F.lit("na").alias("THERAPEUTICAL_CLASS"), day.alias("ORDER_DT_TM"), F.when(F.col("l_linestatus") == "O", "Yes").otherwise("n").alias("ADMISSION_MEDICINE_Y_N"), F.lit("").alias("GP_TO_CONTINUE"))
    out = cleaning.clean_prescriptions(rows)
    return out.select("subject", F.col("medication_name_short").alias("drug"), F.col("admission_medicine_y_n").alias("given"), F.date_format("order_dt_tm", "yyyy-MM-dd").alias("day"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P') WHERE n = 1")
def q67_first_rows(t: Tables) -> DataFrame:
    rows = dataset.after_surgery(t.orders.withColumn("kept", (F.col("o_orderstatus") != "P").cast("int")), "kept")
    return cleaning.first_by(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


# Rules


@query("""
WITH c AS (SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY c_mktsegment)
SELECT unnest(['column', 'array', 'value', 'null', 'binary', 'null value', 'counts', 'few groups', 'enough groups', 'order', 'no order', 'shared group', 'no shared group', 'lost rows', 'two weights', 'bad pair']) AS rule,
  unnest([true, true, (SELECT count(*) > 0 FROM orders WHERE o_orderstatus = 'P'), (SELECT count(*) > 0 FROM part WHERE p_size % 9 = 0), (SELECT max(p_size) > 1 FROM part), (SELECT count(*) > 0 FROM part WHERE p_size % 9 = 0),
  (SELECT count(*) > 0 FROM c WHERE n <> 25), true, false, false, true, true, false, true, (SELECT count(DISTINCT p_size) > 1 FROM part), (SELECT count(*) > 0 FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW')]) AS broken
""")
def q68_rules(t: Tables) -> DataFrame:
    """Which rules stop a run over tables that break or keep them."""
    part = t.part.withColumn("size", F.when(F.col("p_size") % 9 != 0, F.col("p_size")))
    orders = labelled_orders(t).select("o_custkey", "o_orderkey", "label", "o_orderdate", "o_orderstatus", "o_orderpriority")
    segments = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.lit(1).alias("one"))
    middle = orders.agg(F.percentile_approx(F.unix_date(F.to_date("o_orderdate")), 0.5)).first()[0]
    early = F.unix_date(F.to_date("o_orderdate")) <= middle
    before, after = orders.filter(early), orders.filter(~early)
    even, odd = orders.filter("o_custkey % 2 = 0"), orders.filter("o_custkey % 2 = 1")
    sided = orders.withColumn("side", F.when(early, "train").otherwise("test"))
    bad = tables.inline_table(t.spark, [("F", "5-LOW")], ["o_orderstatus", "o_orderpriority"])
    rules = {
        "column": lambda: checks.require_columns(part, ["p_size", "absent"]),
        "array": lambda: checks.require_arrays(part, ["p_size"]),
        "value": lambda: checks.ensure(checks.bad_values(orders, F.when(F.col("o_orderstatus") == "P", F.col("o_orderstatus"))), "Pending"),
        "null": lambda: checks.ensure(checks.null_keys(part, ["p_partkey", "size"]), "Null values in"),
        "binary": lambda: checks.require_binary(part, ["p_size"]),
        "null value": lambda: checks.require_enough_groups(part.withColumn("y", F.lit(1)), "y", "size", 2),
        "counts": lambda: checks.ensure(checks.counts_sum_to(segments, ["c_mktsegment"], "one", 25), "Counts"),
        "few groups": lambda: checks.require_enough_groups(orders, "label", "o_custkey", 10**9),
        "enough groups": lambda: checks.require_enough_groups(orders, "label", "o_custkey", 2),
        "order": lambda: split.validate_split(sided.withColumn("g", F.col("o_orderkey")), "g", "o_orderdate"),
        "no order": lambda: split.validate_split(sided.withColumn("g", F.col("o_orderkey")).withColumn("side", F.when(F.col("side") == "train", "test").otherwise("train")), "g", "o_orderdate"),
        "shared group": lambda: checks.ensure(checks.shared_groups(before.withColumn("g", F.lit(1)), after.withColumn("g", F.lit(1)), "g"), "Shared"),
        "no shared group": lambda: checks.ensure(checks.shared_groups(even, odd, "o_custkey"), "Shared"),
        "lost rows": lambda: split.validate_split(sided.withColumn("g", F.col("o_orderkey")), "g", n_rows=-1),
        "two weights": lambda: checks.ensure(checks.varying_in_group(t.part.withColumn("k", F.lit(1)), ["k"], "p_size"), "Weights"),
        "bad pair": lambda: checks.ensure(checks.dropped_pairs(orders, bad), "Left out"),
    }
    return t.spark.createDataFrame([(rule, raised(run)) for rule, run in rules.items()], "rule string, broken boolean")


QUOTED = "'[' || string_agg('''' || {0} || '''', ', ' ORDER BY {0}) || ']'"


@query(f"""
WITH a AS (SELECT DISTINCT c_mktsegment AS x FROM customer WHERE c_nationkey < 20), e AS (SELECT unnest(['BUILDING', 'MACHINERY', 'GARDEN']) AS x)
SELECT 'A missing ' || {QUOTED.format('x')} AS problem FROM e WHERE x NOT IN (SELECT x FROM a)
UNION ALL SELECT 'A has unexpected ' || {QUOTED.format('x')} FROM a WHERE x NOT IN (SELECT x FROM e)
UNION ALL SELECT 'B missing ' || {QUOTED.format('x')} FROM e WHERE x <> 'BUILDING'
UNION ALL SELECT 'only in A ' || {QUOTED.format('x')} FROM a WHERE x <> 'BUILDING'
UNION ALL SELECT 'B contains missing codes'
""")
def q69_name_sets(t: Tables) -> DataFrame:
    a = t.customer.filter("c_nationkey < 20").select(F.col("c_mktsegment").alias("name")).distinct()
    b = tables.inline_table(t.spark, [("BUILDING", "")], ["name", "code"])
    found = checks.name_problems({"A": a, "B": b}, "name", {"B": "code"}, {"BUILDING", "MACHINERY", "GARDEN"})
    return t.spark.createDataFrame([(p,) for p in found], "problem string")


@query(f"""
WITH {TEMPORAL}, j AS (SELECT side, label, o_custkey, o_orderdate FROM sides JOIN orders USING (o_orderkey, o_custkey))
SELECT side, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last, count(DISTINCT CASE WHEN label = 1 THEN o_custkey END) AS positive_groups FROM j GROUP BY side
""")
def q70_sides_in_time(t: Tables) -> DataFrame:
    sides = split.temporal_sides(labelled_orders(t), "o_custkey", "o_orderdate")
    split.validate_split(sides.filter("side <> 'dropped'"), "o_custkey", "o_orderdate")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return sides.groupBy("side").agg(day(F.min("o_orderdate")).alias("first"), day(F.max("o_orderdate")).alias("last"), F.count_distinct(F.when(F.col("label") == 1, F.col("o_custkey"))).alias("positive_groups"))


# Maps


@query(f"""
WITH r AS (SELECT s_suppkey, {literal(list(schemas.LABELS.values()))}[1 + s_suppkey % {len(NAMES)}] AS comorbidity FROM supplier),
c AS (SELECT comorbidity, unnest(['K' || s_suppkey % 10, 'L' || s_suppkey % 10 || s_suppkey // 10 % 10]) AS icd_code FROM r)
SELECT DISTINCT comorbidity, icd_code, {"CASE comorbidity " + " ".join(f"WHEN '{c}' THEN {w}" for c, w in schemas.WEIGHTS.items()) + " END"} AS weight FROM c
""")
def q71_icd_map(t: Tables) -> DataFrame:
    n = F.col("s_suppkey")
    label = text.mapped(name_of(n), schemas.LABELS)
    codes = F.concat(F.lit(" k."), (n % 10).cast("string"), F.lit("| L "), (n % 10).cast("string"), (F.floor(n / 10) % 10).cast("string"), F.lit("|K"), (n % 10).cast("string"))
    weight = F.create_map(*[F.lit(x) for pair in schemas.WEIGHTS.items() for x in pair])[label]
    raw = t.supplier.select(name_of(n).alias("category"), codes.alias("icd10_codes"), weight.cast("string").alias("weights"))
    age = raw.limit(1).withColumn("category", F.lit("Age"))
    return cleaning.icd_map(raw.unionByName(age))


@query(" UNION ALL ".join(f"SELECT '{c}' AS comorbidity, lower('{d}') AS medication_name" for c, own in schemas.DRUGS.items() for d in own))
def q72_medication_map(t: Tables) -> DataFrame:
    return cleaning.medication_map(t.spark)


@query(f"""
WITH {VERHOEFF}, r AS (SELECT body || digit AS snomed_code, {literal(list(schemas.LABELS.values()))}[1 + o_orderkey % {len(NAMES)}] AS comorbidity FROM sums WHERE o_orderkey % 6 <> 0)
SELECT 'map' AS kind, comorbidity, snomed_code FROM r UNION ALL SELECT 'map', 'dementia', '12237231000119107' UNION ALL SELECT 'repair', '36712807', '12237231000119107'
""")
def q73_concept_map(t: Tables) -> DataFrame:
    """Codes of the sheet audited and repaired, repeated rows once, reviewed exclusions left out."""
    own = t.orders.filter("o_orderkey % 6 <> 0").select(name_of(F.col("o_orderkey")).alias("Comorbid Condition"), concept_code().alias("Concept Code"), F.lit("1").alias("Concept ID"), F.lit("a").alias("Concept Name"))
    more = t.spark.createDataFrame([("Dementia", "12237231000119100", "36712807", "b"), ("Dementia", "713571008", "2", "left out")], own.schema)
    found, repairs = cleaning.snomed_map(own.union(own).union(more))
    return found.select(F.lit("map").alias("kind"), "comorbidity", "snomed_code").union(repairs.select(F.lit("repair"), "concept_id", "cleaned_code"))


@query("""
WITH e AS (SELECT o_orderkey, 'K' || o_orderkey % 12 AS icd, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 7)::VARCHAR END AS snomed, CASE o_orderkey % 4 WHEN 0 THEN 'drug a' WHEN 1 THEN 'drug z' END AS drug FROM orders),
i AS (SELECT * FROM (VALUES ('K1', 'one', 1), ('K11', 'eleven', 2), ('K', 'any', 3)) v(prefix, label, n)),
s AS (SELECT * FROM (VALUES ('1', 'zeta', 1), ('1', 'alpha', 2), ('2', 'beta', 3), ('1', 'zeta', 4)) v(code, label, n)),
m AS (SELECT o_orderkey, (SELECT string_agg(label, '|' ORDER BY n) FROM i WHERE starts_with(icd, prefix)) AS i, (SELECT string_agg(label, '|' ORDER BY n) FROM (SELECT code, label, min(n) AS n FROM s GROUP BY ALL) WHERE code = snomed) AS s, CASE WHEN drug = 'drug a' THEN 'asthma' END AS d FROM e)
SELECT o_orderkey, coalesce(i, '') AS icd, coalesce(s, '') AS snomed, coalesce(d, '') AS drug FROM m
""")
def q74_map_evidence(t: Tables) -> DataFrame:
    """Prefix, exact and drug maps over one table of evidence; labels in the order of the maps."""
    k = F.col("o_orderkey")
    rows = t.orders.select(k, F.concat(F.lit("K"), (k % 12).cast("string")).alias("icd_code"), F.when(k % 3 != 0, F.concat(F.lit(" "), (k % 7).cast("string"))).alias("snomed_code"), F.when(k % 4 == 0, " Drug A ").when(k % 4 == 1, "drug z").alias("medication_name"))
    icd = t.spark.createDataFrame([("one", "K1", 1), ("eleven", "K11", 2), ("any", "K", 3)], "comorbidity string, icd_code string, source_row int")
    snomed = t.spark.createDataFrame([("zeta", "1", 1), ("alpha", " 1", 2), ("beta", "2", 3), ("zeta", "1", 4)], "comorbidity string, snomed_code string, source_row int")
    drugs = tables.inline_table(t.spark, [("asthma", "drug a")], ["comorbidity", "medication_name"])
    out = mapping.map_evidence(rows, icd, snomed, drugs)
    checks.require_arrays(out, ["icd_comorbidity", "snomed_comorbidity", "medication_comorbidity"])
    return out.select("o_orderkey", *[F.array_join(f"{c}_comorbidity", "|").alias(n) for c, n in (("icd", "icd"), ("snomed", "snomed"), ("medication", "drug"))])


# Preparation and models


@query(f"""
WITH {SIDES}, o AS (SELECT o_orderkey, side, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN '__MISSING__' ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS open FROM orders JOIN sides USING (o_custkey)),
f AS (SELECT avg(price) AS m FROM o WHERE side = 'train'), d AS (SELECT m, stddev_pop(coalesce(price, m)) AS s FROM o, f WHERE side = 'train' GROUP BY m),
fs AS (SELECT avg((price IS NULL)::INT) AS fm, stddev_pop((price IS NULL)::INT) AS fd FROM o WHERE side = 'train'),
b AS (SELECT open AS mode FROM o WHERE side = 'train' AND open IS NOT NULL GROUP BY open ORDER BY count(*) DESC, open LIMIT 1)
SELECT o_orderkey, round((coalesce(price, m) - m) / s, 6) + 0.0 AS price, round(((price IS NULL)::INT - fm) / fd, 6) + 0.0 AS price_missing, priority, coalesce(open, mode)::DOUBLE AS open, (open IS NULL)::INT::DOUBLE AS open_missing FROM o, d, b, fs WHERE side = 'test'
""")
def q75_prepared(t: Tables) -> DataFrame:
    """Fitted on the training side, saved, loaded and applied to the test side."""
    k = F.col("o_orderkey")
    rows = split.with_side(labelled_orders(t), order_sides(t).select("o_custkey", "side"), "o_custkey")
    rows = rows.select(k, "side", F.when(k % 9 != 0, F.col("o_totalprice")).alias("price"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("priority"), F.when(k % 4 != 0, (F.col("o_orderstatus") == "O").cast("int")).alias("open"), "label")
    features, _ = preprocess.features_and_target(rows, "label", ("o_orderkey", "side"))
    numeric, categorical, binary = preprocess.feature_types(features, ("open",))
    path = folder(t)
    preprocess.Preprocessor(numeric, categorical, binary).fit(rows.filter("side = 'train'")).save(t.spark, path)
    out = preprocess.Preprocessor.load(t.spark, path).transform(rows.filter("side = 'test'"), ["o_orderkey"])
    hot = [c for c in out.columns if c.startswith("cat__priority_")]
    priority = F.concat(*[F.when(F.col(f"`{c}`") == 1, c.removeprefix("cat__priority_")).otherwise("") for c in hot])
    return out.select("o_orderkey", (F.round("num__price", 6) + 0.0).alias("price"), (F.round("num__missingindicator_price", 6) + 0.0).alias("price_missing"), priority.alias("priority"), F.col("bin__open").alias("open"), F.col("bin__missingindicator_open").alias("open_missing"))


FOLDS = f"""
l AS (SELECT doc_id % 97 AS grp, quality FROM labels),
c AS (SELECT grp, sum(quality)::BIGINT AS positives, count(*) AS n FROM l GROUP BY grp),
r AS (SELECT *, row_number() OVER (PARTITION BY positives, n ORDER BY {HASH.format("grp || '|42'")}, grp) AS place FROM c),
folds AS (SELECT grp, ((place + (positives * 3 + n) % 5) % 5 + 1)::INT AS fold FROM r),
rows AS (SELECT l.*, fold FROM l JOIN folds USING (grp)), f AS (SELECT unnest(range(1, 6))::INT AS fold)
"""


@query(f"""
WITH {FOLDS}, s AS (SELECT f.fold, avg(quality) FILTER (WHERE rows.fold <> f.fold) AS share, avg(quality) FILTER (WHERE rows.fold = f.fold) AS held FROM f, rows GROUP BY f.fold)
SELECT 'Dummy' AS model, s.fold, 0.5::DOUBLE AS train_roc_auc, 0.5::DOUBLE AS roc_auc, round(share, 9) AS train_average_precision, round(held, 9) AS average_precision,
  round((SELECT avg(pow(share - quality, 2)) FROM rows WHERE rows.fold <> s.fold), 9) AS train_neg_brier_score, round((SELECT avg(pow(share - quality, 2)) FROM rows WHERE rows.fold = s.fold), 9) AS brier_score FROM s
""")
def q76_prior_cv(t: Tables) -> DataFrame:
    """Grouped cross-validation of the model that scores with the training share: every metric is known from counts."""
    rows = t.labels.select((F.col("doc_id") % 97).alias("grp"), "quality", (F.col("doc_id") % 7).cast("double").alias("x"))
    folds = split.group_folds(rows, "grp", "quality")
    out = models.cross_validated(rows, folds, "grp", "quality", lambda: preprocess.Preprocessor(["x"], [], []), {"Dummy": models.MODELS["Dummy"]})
    return out.select("model", "fold", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


@query("""
WITH d AS (SELECT doc_id, quality, pow(1.37, doc_id % 23) AS x FROM labels), p AS (SELECT x, count(*) AS n, avg(quality) AS share FROM d WHERE doc_id % 2 = 0 GROUP BY x),
q AS (SELECT DISTINCT x FROM d), o AS (SELECT q.x AS q, p.n, share, coalesce(sum(n) OVER (PARTITION BY q.x ORDER BY abs(q.x - p.x) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q, p),
s AS (SELECT q, sum(greatest(0, least(n, 5 - before)) * share) / sum(greatest(0, least(n, 5 - before))) AS score FROM o GROUP BY q)
SELECT doc_id, round(score, 9) AS score FROM d JOIN s ON d.x = s.q WHERE doc_id % 2 = 1
""")
def q77_knn_score(t: Tables) -> DataFrame:
    """Scores of the neighbour classifier over training rows that repeat each other: each of them votes."""
    rows = t.labels.select("doc_id", "quality", F.pow(F.lit(1.37), F.col("doc_id") % 23).alias("x"))
    score = models.MODELS["k-NN"](rows.filter("doc_id % 2 = 0"), "quality", ["x"])
    return score(rows.filter("doc_id % 2 = 1")).select("doc_id", F.round("score", 9).alias("score"))


@query()
def q87_models(t: Tables) -> DataFrame:
    """Every model fitted on the rows of four folds and scored on the fifth's; no SQL fits them."""
    rows = t.labels.join(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "source"), "doc_id").withColumn("grp", F.col("doc_id") % 97)
    dealt = rows.join(split.group_folds(rows, "grp", "quality").select("grp", "fold"), "grp")
    ready = preprocess.Preprocessor(["n_chars"], ["source"], []).fit(dealt.filter("fold <> 1"))
    train, held = (tables.stored(ready.transform(dealt.filter(side), ["quality"]), "prepared") for side in ("fold <> 1", "fold = 1"))
    features = [c for c in train.columns if c != "quality"]
    out = []
    for name, fit in models.MODELS.items():
        told = models.quality(fit(train, "quality", features)(held), "quality")
        out.append((name, told["roc_auc"], told["average_precision"], told["brier_score"]))
    return t.spark.createDataFrame(out, "model string, roc_auc double, average_precision double, brier_score double")


# Synthesis


@query("SELECT o_orderstatus AS a, CASE WHEN o_orderpriority LIKE '4-%' THEN NULL ELSE o_orderpriority END AS b, count(*) AS n FROM orders GROUP BY ALL")
def q78_joint_sample(t: Tables) -> DataFrame:
    """A pair of variables sampled with exactly its published joint counts."""
    rows = t.orders.select("o_orderstatus", text.null_if(F.col("o_orderpriority"), "4-NOT SPECIFIED").alias("priority"))
    counts = [{k: str(v) for k, v in r.asDict().items()} for r in profile.pair_frequencies(rows, [("o_orderstatus", "priority")]).collect()]
    made = synth.exact_sample(t.spark, counts, ["category_1", "category_2"], ["a", "b"], rows.count(), 9)
    return made.groupBy("a", "b").agg(F.count_distinct("row_id").alias("n"))


POINTS = {"min": 0.0, "p05": 2.0, "q1": 5.0, "median": 9.0, "q3": 20.0, "p95": 50.0, "max": 400.0}


@query(f"""
WITH r AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY {sql_hash("o_orderkey", "'x'", seed=4)}, o_orderkey) AS place, count(*) OVER () - 100 AS observed FROM orders),
u AS (SELECT *, (place - 1 + ({sql_hash("place", "'x'", seed=5)} + 0.5) / 4294967296.0) / observed AS p FROM r)
SELECT row_id, CASE WHEN place > observed THEN NULL ELSE round_even(CASE WHEN p <= 0.05 THEN pow(p / 0.05, 0.125) * 2 WHEN p <= 0.25 THEN 2 + (p - 0.05) / 0.2 * 3 WHEN p <= 0.5 THEN 5 + (p - 0.25) / 0.25 * 4 WHEN p <= 0.75 THEN 9 + (p - 0.5) / 0.25 * 11
  WHEN p <= 0.95 THEN 20 + (p - 0.75) / 0.2 * 30 ELSE 50 + pow((p - 0.95) / 0.05, 8) * 350 END, 0)::BIGINT END AS x FROM u
""")
def q79_continuous_sample(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"))
    return synth.continuous_sample(rows, "x", POINTS, "int64", 100, rows.count(), 4)


@query(f"""
WITH r AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY {sql_hash("o_orderkey", "'subject'", seed=6)}, o_orderkey) AS place FROM orders)
SELECT row_id, 'SYN-P' || lpad((CASE WHEN place <= 500 THEN place ELSE floor(({sql_hash("row_id", "'again'", seed=6)} + 0.5) / 4294967296.0 * 500)::BIGINT + 1 END)::VARCHAR, 6, '0') AS subject FROM r
""")
def q80_subjects(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"))
    return synth.subjects(rows, 500, rows.count(), 6)


@query("""
SELECT unnest([0, 0, 0, 1, 1, 1, 2, 2, 2])::INT AS i, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2])::INT AS j, unnest([1, 0.5, 0.2, 0.5, 1, -0.3, 0.2, -0.3, 1])::DOUBLE AS valid, unnest([1, 1, 0, 1, 1, 0, 0, 0, 1])::DOUBLE AS repaired
""")
def q81_correlations(t: Tables) -> DataFrame:
    """A valid matrix stays; one that claims more than a full correlation is brought back to it."""
    import numpy as np

    valid = synth.correlation_factor(np.array([[1, 0.5, 0.2], [0.5, 1, -0.3], [0.2, -0.3, 1]]))
    repaired = synth.correlation_factor(np.array([[1, 1.4, 0.0], [1.4, 1, 0.0], [0.0, 0.0, 1]]))
    rows = [(i, j, float(valid[i] @ valid[j]), float(repaired[i] @ repaired[j])) for i in range(3) for j in range(3)]
    out = t.spark.createDataFrame(rows, "i int, j int, valid double, repaired double")
    return out.select("i", "j", (F.round("valid", 6) + 0.0).alias("valid"), (F.round("repaired", 6) + 0.0).alias("repaired"))


@query("""
WITH v AS (SELECT 'price' AS variable, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE floor(o_totalprice / 1000) END AS value FROM orders UNION ALL SELECT 'year', year(o_orderdate) FROM orders)
SELECT variable, value::DOUBLE AS value, count(*) AS n FROM v GROUP BY ALL
""")
def q82_dealt_ranks(t: Tables) -> DataFrame:
    """Values dealt anew by ranks: each column keeps its values, counts and numbers of nulls."""
    import numpy as np

    k = F.col("o_orderkey")
    rows = t.orders.select(k.alias("row_id"), F.when(k % 9 != 0, F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("price"), F.year("o_orderdate").cast("double").alias("year"))
    made = synth.with_dependencies(rows, ["price", "year", "__missing__price"], np.array([[1, 0.6, 0.0], [0.6, 1, 0.3], [0.0, 0.3, 1]]), 3)
    long = made.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in ("price", "year")])).alias("x")).select("x.*")
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'rows' AS term, NULL AS field, NULL AS category, count(*)::DOUBLE AS weight FROM orders UNION ALL SELECT 'const', NULL, NULL, -1.5
UNION ALL SELECT 'o_totalprice', NULL, NULL, 0.25 UNION ALL SELECT 'o_order__1-URGENT', 'o_order', '1-URGENT', 2 UNION ALL SELECT 'o_order__status__F', 'o_order__status', 'F', 3
""")
def q83_model_terms(t: Tables) -> DataFrame:
    """A published model's terms, with the field and category that each names by the longest field that fits."""
    given = [("Intercept", "-1.5"), ("o_totalprice", "0.25"), ("", "7"), ("o_order__1-URGENT", "2"), ("o_order__status__F", "3")]
    intercept, terms = synth.model_terms([{"variable": k, "coefficient": v} for k, v in given])
    totals = synth.Totals([{"metric": "n_rows", "value": str(float(t.orders.count()))}])
    rows = [("rows", None, None, float(totals["n_rows"])), ("const", None, None, intercept)]
    rows += [(k, *(text.indicator(k, ["o_order", "o_order__status", "o_totalprice"]) or (None, None)), v) for k, v in terms.items()]
    return t.spark.createDataFrame(rows, "term string, field string, category string, weight double")


@query("""
SELECT 'l_returnflag' AS variable, l_returnflag AS category, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL
UNION ALL SELECT 'missing price', (l_partkey % 9 = 0)::VARCHAR, count(*) FROM lineitem GROUP BY ALL
UNION ALL SELECT 'outcome', unnest(['0', '1']), unnest([count(*) - count(*) // 3, count(*) // 3]) FROM lineitem UNION ALL SELECT 'subjects', 'different', greatest(1, count(*) // 2) FROM lineitem
""")
def q84_synthetic_margins(t: Tables) -> DataFrame:
    """A whole synthetic table has the published counts of categories, nulls, positives and subjects."""
    from .catalog import QUERIES

    made = tables.stored(QUERIES["q50_synth_dataset"](t.spark, t.sf_dir), "synthetic")
    parts = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category")) for c in ("l_returnflag", "l_linestatus", "outcome")]
    parts.append(F.struct(F.lit("missing price").alias("variable"), F.col("l_extendedprice").isNull().cast("string").alias("category")))
    counts = made.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.variable", "x.category").agg(F.count(F.lit(1)).alias("n"))
    return counts.union(made.agg(F.lit("subjects"), F.lit("different"), F.count_distinct("subject")))


@query("""
SELECT 0.5::DOUBLE AS threshold, sum((quality = 1 AND n_chars >= 1000)::INT)::BIGINT AS tp, sum((quality = 0 AND n_chars >= 1000)::INT)::BIGINT AS fp, sum((quality = 1 AND n_chars < 1000)::INT)::BIGINT AS fn, sum((quality = 0 AND n_chars < 1000)::INT)::BIGINT AS tn FROM labels JOIN documents USING (doc_id)
""")
def q85_confusion(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", (F.col("n_chars") / 2000.0).alias("score")), "doc_id")
    return metrics.confusion(rows, "quality", "score", [0.5]).select("threshold", "tp", "fp", "fn", "tn")


@query(f"""
WITH d AS (SELECT user_id, event_type, min(ts) AS first_date FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, '|' ORDER BY event_type) AS kinds, {SHOWN.format("min(first_date)")} AS first FROM d GROUP BY user_id
""")
def q86_list_aggregates(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(joined(F.collect_set("event_type")).alias("kinds"), shown(F.min("ts")).alias("first"))
