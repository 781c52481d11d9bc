"""JSON documents: folders of files, and text columns that hold one document each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BAD = "_corrupt_record"


def _with_bad(schema: str) -> str:
    return f"{schema}, {_BAD} string"


def read_folder(spark: SparkSession, path: str, schema: str, one_per_file: bool = True,
                pattern: str = "*.json") -> DataFrame:
    """Documents of a folder with an extra ``_corrupt_record`` column for the unreadable ones.

    ``one_per_file=False`` reads one document per line, which splits large files.
    """
    return (spark.read.schema(_with_bad(schema)).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _BAD).option("multiLine", one_per_file)
            .option("pathGlobFilter", pattern).json(path))


def read_named(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file, with the package name that the file is named after (``/`` written as %2F)."""
    found = read_folder(spark, path, schema)
    # The file name comes as part of a URL; a plus sign stands for itself there.
    file_name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    name = F.replace(F.regexp_replace(file_name, r"\.json$", ""), F.lit("%2F"), F.lit("/"))
    return found.select(name.alias("package_name"), "*")


def parsed(text: Column, schema: str) -> Column:
    """The document as a struct, with the text kept in ``_corrupt_record`` when it is not JSON."""
    return F.from_json(text, _with_bad(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})


def parse_column(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """Replace a text column by the fields of its document and ``_corrupt_record``."""
    others = [name for name in rows.columns if name != text]
    return rows.withColumn("_document", parsed(F.col(text), schema)).select(*others, "_document.*")


def is_json() -> Column:
    """Documents with a field of another type are marked too, but they are JSON and stay in use."""
    return F.col(_BAD).isNull() | F.try_parse_json(F.col(_BAD)).isNotNull()


def parse_readable(rows: DataFrame, text: str, schema: str) -> DataFrame:
    """Replace a text column by the fields of its document, leaving out rows whose text is not JSON.

    The test is made on the text: a filter on a parsed field would be pushed below the parsing and parse
    the document once more per condition.
    """
    valid = rows.where(F.try_parse_json(text).isNotNull())
    others = [name for name in rows.columns if name != text]
    return valid.withColumn("_document", F.from_json(F.col(text), schema)).select(*others, "_document.*")


def readable(documents: DataFrame) -> DataFrame:
    return documents.where(is_json()).drop(_BAD)


def unreadable(documents: DataFrame) -> DataFrame:
    return documents.where(~is_json())
