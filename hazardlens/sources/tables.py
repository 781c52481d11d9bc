"""Tables as Parquet folders: replace, append what is new, defaults, counts and contracts."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazardlens.operators.keys import exclude_stored, null_counts
from hazardlens.session import new_folder, path_exists


def replace_table(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Write the named columns in place of what the folder held."""
    rows.select(*columns).write.mode("overwrite").parquet(path)


def written(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a table of their own in the shared folder, for results that several jobs read."""
    spark = rows.sparkSession
    folder = new_folder(spark, label)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table, or no rows of its schema when the folder is not there."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    for path in paths:
        if path_exists(spark, path):
            return spark.read.parquet(path)
    raise FileNotFoundError(f"none of {paths}")


#: Buckets of a table that ``append_new`` begins.
BUCKETS = 64


def append_new(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Append rows whose key the table does not hold yet.

    A table begun here is dealt into buckets of its key, noted in ``<path>-buckets``. Later rows are dealt the same
    way and meet it bucket by bucket, so it is read but never shuffled. A folder that others have begun is
    not bucketed and stays as it is; there the keys at hand are looked up first.
    """
    spark = rows.sparkSession
    layout = f"{path.rstrip('/')}-buckets"
    if path_exists(spark, path) and not path_exists(spark, layout):
        stored = read_or_empty(spark, path, rows.schema)
        exclude_stored(rows, stored, keys).write.mode("append").parquet(path)
        return
    if not path_exists(spark, layout):
        spark.createDataFrame([(buckets, keys)], "buckets int, keys array<string>").write.parquet(layout)
    noted = spark.read.schema("buckets int, keys array<string>").parquet(layout).first()
    if noted["keys"] != keys:
        raise ValueError(f"the table is bucketed by {noted['keys']}, not by {keys}")
    name = bucketed_table(spark, path, rows.schema, keys, noted["buckets"])
    try:
        missing_rows(rows, spark.table(name), keys, noted["buckets"]).write.insertInto(name)
    finally:
        spark.sql(f"DROP TABLE `{name}`")  # external: the folder stays


def bucketed_table(spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int) -> str:
    """Name under which the session's catalog now knows the folder, as dealt into buckets of its keys."""
    name = f"bucketed_{hashlib.sha1(path.encode()).hexdigest()[:16]}"
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
    columns = ", ".join(f"`{key}`" for key in keys)
    spark.sql(f"CREATE TABLE `{name}` ({fields}) USING parquet CLUSTERED BY ({columns}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def missing_rows(rows: DataFrame, stored: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Rows whose key the bucketed table lacks, dealt into its buckets."""
    return rows.repartition(buckets, *keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns)


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill NULLs of the named columns."""
    return rows.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counts = [rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
              for name, rows in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def contract_breaches(rows: DataFrame, filled: list[str], key: list[str] | None) -> DataFrame:
    """Number of breaches per rule: NULLs in columns that must be filled, keys held by several rows."""
    rules = null_counts(rows, filled).select(
        F.concat(F.lit("not null: "), "column_name").alias("rule"), F.col("null_count").alias("breaches"))
    if not key:
        return rules
    repeated = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).agg(
        F.count_if(F.col("copies") > 1).alias("breaches"))
    return rules.unionByName(repeated.select(F.lit("unique: " + ", ".join(key)).alias("rule"), "breaches"))
