"""Loading the four tables and checking what was loaded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens import schemas
from hazardlens.sources.tables import contract_breaches, replace_table, table_counts, with_defaults

COLUMNS = {
    "raw_osv_vulnerabilities": fixed.FLAT_COLUMNS,
    "raw_librariesio_projects": fixed.PROJECT_COLUMNS,
    "package_vulnerability_summary": fixed.SUMMARY_COLUMNS,
    "extracted_package_risk_summary": fixed.RISK_COLUMNS,
}


def load(tables: dict[str, DataFrame], root: str) -> None:
    """Replace each table below ``root`` by the given rows; values a file left out get their defaults."""
    for name, rows in tables.items():
        replace_table(with_defaults(rows, schemas.LOAD_DEFAULTS[name]), f"{root}/{name}", COLUMNS[name])


def stored(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}") for name in COLUMNS}


def counts(spark: SparkSession, root: str) -> DataFrame:
    return table_counts(stored(spark, root))


def breaches(spark: SparkSession, root: str) -> DataFrame:
    """Breaches of every table's contract, one line per rule."""
    found = [contract_breaches(rows, *schemas.CONTRACTS[name]).select(F.lit(name).alias("table_name"), "*")
             for name, rows in stored(spark, root).items()]
    return reduce(DataFrame.unionByName, found)
