"""CSV with header, quoted cells, doubled quotes and line breaks inside quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType, TimestampNTZType

from hazardlens.functions.dates import read_iso, write_iso
from hazardlens.functions.text import null_if_blank

_QUOTING = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false"}


def read_cells(spark: SparkSession, path: str, columns: list[str], line_breaks: bool = True) -> DataFrame:
    """All cells as text, empty cells as NULL.

    Files with line breaks inside cells cannot be split, so pass ``line_breaks=False`` for big files
    that are known to have none.
    """
    schema = StructType([])
    for column in columns:
        schema = schema.add(column, StringType())
    return (spark.read.options(**_QUOTING).option("multiLine", line_breaks).option("nullValue", "")
            .option("enforceSchema", "false").schema(schema).csv(path))


def place() -> Column:
    """Where a row of a file stands: by file name, split and row. Wants a scan that nothing was selected from yet."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("row"))


def read_by_header(spark: SparkSession, path: str, line_breaks: bool = True, with_seq: bool = False) -> DataFrame:
    """All cells as text, columns named by the trimmed, lower-cased header of the file.

    The files of a folder must have one header; ``with_seq`` adds ``seq``, the order of their lines.
    """
    cells = (spark.read.options(**_QUOTING).option("multiLine", line_breaks).option("nullValue", "")
             .option("inferSchema", "false").option("enforceSchema", "false").csv(path))
    names = [column.strip().lower() for column in cells.columns]
    if with_seq:
        return cells.select("*", place().alias("seq")).toDF(*names, "seq")
    return cells.toDF(*names)


def typed(cells: DataFrame, schema: str, kept: list[str] | None = None) -> DataFrame:
    """Text cells to the declared types; what cannot be read becomes NULL."""
    def convert(name: str, kind) -> Column:
        text = null_if_blank(F.col(name))
        if isinstance(kind, TimestampNTZType):
            return read_iso(text)
        return text if isinstance(kind, StringType) else text.try_cast(kind)
    return cells.select(*[convert(field.name, field.dataType).alias(field.name) for field in StructType.fromDDL(schema).fields], *(kept or []))


def read_typed(spark: SparkSession, path: str, schema: str, line_breaks: bool = True, with_seq: bool = False) -> DataFrame:
    """Columns of the schema by the names of the header, in any order and letter case.

    Columns that the file lacks are NULL, and others are left out. ``with_seq`` adds the order of the lines.
    """
    cells = read_by_header(spark, path, line_breaks, with_seq)
    there = set(cells.columns)
    wanted = [F.col(name) if name in there else F.lit(None).cast("string").alias(name)
              for name in StructType.fromDDL(schema).names]
    more = ["seq"] if with_seq else []
    return typed(cells.select(*wanted, *more), schema, more)


def as_cells(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in the given order as text: ISO times, true/false, NULL left NULL."""
    kinds = {field.name: field.dataType for field in rows.schema.fields}

    def cell(name: str) -> Column:
        if isinstance(kinds[name], TimestampNTZType):
            return write_iso(F.col(name))
        if isinstance(kinds[name], (BooleanType, StringType)):
            return F.col(name).cast("string")
        return F.col(name)
    return rows.select(*[cell(name).alias(name) for name in columns])


def write_cells(rows: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    (as_cells(rows, columns).write.mode(mode).options(**_QUOTING).option("nullValue", "").option("emptyValue", "")
     .csv(path))


def csv_to_json(spark: SparkSession, csv_path: str, json_path: str, line_breaks: bool = True) -> None:
    """One JSON object per line instead of one array, so that the result can be read in parallel.

    Without ``line_breaks`` inside cells a large file is read in splits, each of which writes a file.
    """
    read_by_header(spark, csv_path, line_breaks).write.option("ignoreNullFields", "false").json(json_path)
