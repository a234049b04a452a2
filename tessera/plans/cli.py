"""The plans from the command line: python -m tessera.plans.cli PLAN --help."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..sources.tables import config_paths, csv_inferred, write_table
from . import comorbidity, modelling, summaries


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    plans = out.add_subparsers(dest="plan", required=True)
    own = plans.add_parser("maps", help="build the code maps")
    own.add_argument("icd"), own.add_argument("snomed"), own.add_argument("output")
    own = plans.add_parser("comorbidity", help="flags and score for each episode")
    own.add_argument("config", help="YAML file with a mapping called paths"), own.add_argument("output")
    own = plans.add_parser("split", help="train and test sides")
    own.add_argument("table"), own.add_argument("output"), own.add_argument("--kind", choices=("random", "temporal"), default="random")
    for name in ("preprocess", "models"):
        own = plans.add_parser(name)
        own.add_argument("folder"), own.add_argument("output"), own.add_argument("--kind", choices=("random", "temporal"), default="random")
    own = plans.add_parser("generate", help="a synthetic table from summaries")
    own.add_argument("--summaries", required=True), own.add_argument("--coefficients", required=True), own.add_argument("--output", required=True)
    own.add_argument("--pairs"), own.add_argument("--dependencies")
    own.add_argument("--seed", type=int, default=2026), own.add_argument("--start", default="2015-01-01"), own.add_argument("--end", default="2025-09-01")
    return out


def main(words: Sequence[str] | None = None) -> None:
    told = parser().parse_args(words)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if told.plan == "maps":
        comorbidity.build_maps(spark, told.icd, told.snomed, told.output)
    elif told.plan == "comorbidity":
        comorbidity.run(spark, config_paths(told.config), told.output)
    elif told.plan == "split":
        modelling.run_split(csv_inferred(spark, told.table), told.output, told.kind)
    elif told.plan == "preprocess":
        modelling.run_preprocess(spark, told.folder, told.output, told.kind)
    elif told.plan == "models":
        modelling.run_models(spark, told.folder, told.output, told.kind).show(truncate=False)
    else:
        made = summaries.generate(spark, told.summaries, told.coefficients, told.pairs, told.dependencies, seed=told.seed, start=told.start, end=told.end)
        write_table(made.drop("row_id"), told.output, "csv")


if __name__ == "__main__":
    main()
