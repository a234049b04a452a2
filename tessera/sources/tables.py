"""Reading and writing tables, path configuration, and extracts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import require_columns
from ..functions.text import MISSING_CSV, null_if
from ..functions.values import lenient_timestamp


def csv_text(spark: SparkSession, path: str, columns: Iterable[str] | None = None, multiline: bool = False) -> DataFrame:
    """A CSV file with a header, every column as text, so that long identifiers keep their digits.

    Columns keep the file's order; with `columns` only these are read. Texts that stand for missing values are
    null. Quotes inside quotes are doubled. Values may hold line breaks only if multiline is set: such a file is one
    task, others are split.
    """
    df = spark.read.options(header=True, escape='"', multiLine=multiline, inferSchema=False).csv(path)
    if columns is not None:
        require_columns(df, columns)
        df = df.select(*columns)
    return df.select(*[null_if(F.col(f"`{c}`"), *MISSING_CSV).alias(c) for c in df.columns])


def csv_typed(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False) -> DataFrame:
    """A CSV file whose columns have the declared types; what does not fit is null."""
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = csv_text(spark, path, declared.fieldNames(), multiline)
    return text.select(*[lenient_timestamp(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.trim(F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in declared])


def csv_inferred(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """A CSV file whose types Spark infers; for exploration, as it reads the file twice."""
    return spark.read.options(header=True, escape='"', multiLine=multiline, inferSchema=True, nullValue="").csv(path)


def summary_rows(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """A summary file, of metadata size, as rows; an absent or empty file is an error."""
    require_path(spark, path, "summary")
    rows = [r.asDict() for r in spark.read.options(header=True, escape='"').csv(path).collect()]
    if not rows:
        raise ValueError(f"No rows in the summary {path}")
    return [{k: v or "" for k, v in r.items()} for r in rows]


def workbook(spark: SparkSession, path: str, text_columns: Iterable[str] = ()) -> DataFrame:
    """A workbook through pandas on the driver, where its reader is installed, or its CSV or Parquet export; small by its nature.

    source_row counts the rows as a spreadsheet shows them: 2 is the first after the header.
    """
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        sheet = csv_text(spark, path, multiline=True)
        return sheet.withColumn("source_row", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + 1)
    import pandas as pd

    sheet = pd.read_excel(path, dtype={c: "string" for c in text_columns})
    sheet["source_row"] = range(2, len(sheet) + 2)
    return spark.createDataFrame(sheet.astype(object).where(sheet.notna(), None))


def path_exists(spark: SparkSession, path: str) -> bool:
    """In any store that Spark reads."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def require_path(spark: SparkSession, path: str, name: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"There is no {name} file at {path}")


def config_paths(config_path: str) -> dict[str, str]:
    """The mapping `paths` of a YAML file; relative paths start at the file's folder."""
    import yaml

    with open(config_path, encoding="utf-8") as f:
        config = yaml.safe_load(f)
    paths = config.get("paths") if isinstance(config, dict) else None
    if not isinstance(paths, dict):
        raise ValueError("The configuration must have a mapping called paths")
    base = Path(config_path).resolve().parent
    return {k: v if "://" in str(v) else str((base / v).resolve()) for k, v in paths.items()}


#: How each source of the bundle is read.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "diagnoses": csv_text,
    "problems": csv_text,
    "prescriptions": csv_text,
    "infection_eps": lambda spark, path: csv_typed(spark, path, "subject string, infection_id string, spell_id string, admission_date timestamp_ntz, first_culture_dt timestamp_ntz"),
    "icd_map": lambda spark, path: csv_typed(spark, path, "comorbidity string, icd_code string, weight int"),
    "snomed_map": lambda spark, path: csv_text(spark, path, ("comorbidity", "snomed_code")),
    "medication_map": lambda spark, path: csv_text(spark, path, ("comorbidity", "medication_name")),
}


def bundle(spark: SparkSession, paths: dict[str, str], names: Iterable[str]) -> dict[str, DataFrame]:
    """The named sources; all of them must exist before any is read."""
    names = list(names)
    if missing := [n for n in names if n not in paths]:
        raise KeyError(f"No path for {missing}")
    for name in names:
        require_path(spark, paths[name], name)
    return {n: READERS[n](spark, paths[n]) for n in names}


def train_test_pair(spark: SparkSession, folder: str, split: str = "random", target: str = "esbl_status") -> tuple[DataFrame, DataFrame]:
    """(train, test) of a split, Parquet tables or CSV files; both have the target and the same set of columns."""
    if split not in ("random", "temporal"):
        raise ValueError("split is random or temporal")

    def side(name: str) -> DataFrame:
        path = f"{folder}/{name}_{split}"
        return csv_inferred(spark, f"{path}.csv") if path_exists(spark, f"{path}.csv") else spark.read.parquet(path)

    train, test = side("train"), side("test")
    for df in (train, test):
        require_columns(df, [target])
    if set(train.columns) != set(test.columns):
        raise ValueError("Train and test have different columns")
    return train, test.select(train.columns)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, or a temporary one where none is set, which only a local session may use."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, True)
    return base.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a table in shared_folder(); cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replaces a table, as Parquet or as CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.parquet(path) if kind == "parquet" else writer.options(header=True, escape='"').csv(path)


def write_all(tables: dict[str, tuple[DataFrame, str]], checks: Iterable[Callable[[], None]], kind: str = "parquet") -> None:
    """Runs every check before the first table is written, so that all are written or none."""
    for check in checks:
        check()
    for df, path in tables.values():
        write_table(df, path, kind)


def cohort_extract(source: DataFrame, cohort: DataFrame, subject: str = "subject", classes: tuple[str, Iterable[str]] | None = None) -> DataFrame:
    """Rows of subjects in the cohort, optionally with a lower-cased column in a list of classes."""
    out = source.join(cohort.select(subject).distinct(), subject, "left_semi")
    return out if classes is None else out.filter(F.lower(classes[0]).isin(*classes[1]))


def inline_table(spark: SparkSession, rows: list[tuple], columns: Iterable[str]) -> DataFrame:
    """A literal table of text columns."""
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
