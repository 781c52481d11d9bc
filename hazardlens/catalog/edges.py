"""Sources and sinks: each writes a derived table, reads it back and is compared with the table."""

from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens import schemas
from hazardlens.catalog.registry import query
from hazardlens.functions.dates import write_iso
from hazardlens.plans import names
from hazardlens.plans.risk import risk_scores
from hazardlens.plans.vulnerabilities import flatten
from hazardlens.session import new_folder
from hazardlens.sources import csv_files, documents, tables


def _texts(table, columns, times=()):
    """SELECT list of columns as the text a cell holds."""
    def cell(name):
        if name in times:
            return f"strftime({name}, '%Y-%m-%dT%H:%M:%S.%gZ') AS {name}"
        return f"CAST({name} AS VARCHAR) AS {name}"
    return f"SELECT {', '.join(cell(name) for name in columns)} FROM {table}"


_DESCRIBED = "concat(description, CASE WHEN seq % 4 = 0 THEN chr(10) ELSE '' END, ' \"\"') AS description"


def _awkward_projects(t):
    """Descriptions with commas, quotes and line breaks."""
    line_break = F.when(F.col("seq") % 4 == 0, F.lit("\n")).otherwise(F.lit(""))
    return t.projects.withColumn("description", F.concat(F.col("description"), line_break, F.lit(' ""')))


def _csv_scan(t):
    folder = new_folder(t.spark, "csv")
    csv_files.write_cells(_awkward_projects(t), folder, fixed.PROJECT_COLUMNS)
    return csv_files.read_cells(t.spark, folder, fixed.PROJECT_COLUMNS)


query("src_1_csv_scan", _texts("p", fixed.PROJECT_COLUMNS, ("latest_release_published_at",)).replace(
    "CAST(description AS VARCHAR) AS description", _DESCRIBED))(_csv_scan)


def _by_header(t):
    folder = new_folder(t.spark, "header")
    odd = t.projects.select(F.col("stars").alias(" Stars "), F.col("package_name").alias("PACKAGE_NAME"))
    odd.write.option("header", "true").csv(folder)
    return csv_files.read_by_header(t.spark, folder).select("package_name", "stars")


query("src_2_columns_by_header", _texts("p", ["package_name", "stars"]))(_by_header)


def _document_folder(t):
    folder = new_folder(t.spark, "documents")
    t.vulnerability_documents().select("document").write.text(folder)
    return documents.read_folder(t.spark, folder, schemas.VULNERABILITY_DOCUMENT, one_per_file=False, pattern="*.txt")


query("src_3_document_folder", "SELECT * FROM f")(
    lambda t: flatten(documents.readable(_document_folder(t))).withColumns(
        {name: write_iso(F.col(name)) for name in ("published", "modified")}))

query("src_3_unreadable_documents", "SELECT COUNT(*) AS unreadable, 0 AS with_id FROM va WHERE seq % 97 = 0")(
    lambda t: documents.unreadable(_document_folder(t)).agg(
        F.count("_corrupt_record").alias("unreadable"), F.count("id").alias("with_id")))


def _text_lines(t):
    folder = new_folder(t.spark, "lines")
    t.raw_lines().write.text(folder)
    return t.spark.read.text(folder).withColumnRenamed("value", "line")


query("src_4_text_lines", "SELECT line FROM raw_lines")(_text_lines)


def _typed_csv(t):
    """A file with its columns turned round, in capitals, one of them extra and one missing."""
    folder = new_folder(t.spark, "typed")
    shuffled = [name for name in reversed(fixed.RISK_COLUMNS) if name != "forks"]
    odd = csv_files.as_cells(t.risk, shuffled).withColumn("remark", F.lit("extra"))
    odd.toDF(*[f" {name.upper()}" for name in odd.columns]).write.option("header", "true").option("escape", '"').csv(folder)
    return csv_files.read_typed(t.spark, folder, schemas.RISK_SUMMARY, line_breaks=False).withColumn(
        "latest_release_published_at", write_iso(F.col("latest_release_published_at")))


_RISK_SQL = """
SELECT r.* REPLACE (strftime(latest_release_published_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS latest_release_published_at) FROM r"""
query("src_5_typed_csv", _RISK_SQL.replace("REPLACE (", "REPLACE (CAST(NULL AS BIGINT) AS forks, "))(_typed_csv)


def _optional_list(t):
    """The list of top names is not there; the merged list is then the summary's."""
    top = tables.read_or_empty(t.spark, new_folder(t.spark, "absent"), schemas.PACKAGE_NAMES)
    return names.merge_lists(top, t.summary)


query("src_6_optional_table", "SELECT DISTINCT package_name FROM s")(_optional_list)


def _fallback(t):
    """The scored table is not there; the risk table is read instead."""
    folder = new_folder(t.spark, "risk")
    tables.replace_table(t.risk, folder, fixed.RISK_COLUMNS)
    return tables.read_first_existing(t.spark, [new_folder(t.spark, "scored"), folder]).select(
        "package_name", "vulnerability_count")


query("src_6_first_existing_table", "SELECT package_name, vulnerability_count FROM r")(_fallback)


def _event_properties(t):
    damaged = F.when(F.col("event_id") % 10 == 0, F.lit("{k: ")).otherwise(F.col("props"))
    value = F.try_variant_get(F.try_parse_json(damaged), "$.k", "bigint")
    return t.given("events").select("event_id", value.alias("k"))


query("src_7_json_column", """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")(
    _event_properties)


def _csv_sink(t):
    folder = new_folder(t.spark, "summary")
    csv_files.write_cells(t.summary, folder, fixed.SUMMARY_COLUMNS)
    return csv_files.read_cells(t.spark, folder, fixed.SUMMARY_COLUMNS)


query("snk_1_csv_sink", _texts("s", fixed.SUMMARY_COLUMNS, ("latest_vulnerability_published_at",)))(_csv_sink)


def _replaced(t):
    """A second load takes the place of the first."""
    folder = new_folder(t.spark, "flat")
    tables.replace_table(t.flat.where("seq % 2 = 0"), folder, fixed.FLAT_COLUMNS)
    tables.replace_table(t.flat, folder, fixed.FLAT_COLUMNS)
    stored = t.spark.read.schema(schemas.VULNERABILITIES).parquet(folder)
    return stored.withColumns({name: write_iso(F.col(name)) for name in ("published", "modified")})


query("snk_2_replaced_table", """
SELECT osv_id, package_name, ecosystem, strftime(published, '%Y-%m-%dT%H:%M:%S.%gZ') AS published,
 strftime(modified, '%Y-%m-%dT%H:%M:%S.%gZ') AS modified, severity_type, severity_score,
 COALESCE(severity_score >= 7.0, FALSE) AS is_high_severity, severity_type = 'MALWARE' AS is_malware FROM v""")(_replaced)


def _csv_to_json(t):
    cells, lines = new_folder(t.spark, "cells"), new_folder(t.spark, "json")
    csv_files.write_cells(t.risk, cells, ["package_name", "stars", "repository_status"])
    csv_files.csv_to_json(t.spark, cells, lines)
    return t.spark.read.schema("package_name string, stars string, repository_status string").json(lines)


query("snk_3_csv_to_json", _texts("r", ["package_name", "stars", "repository_status"]))(_csv_to_json)


def _sorted_by_score(t):
    folder = new_folder(t.spark, "scored")
    columns = ["package_name", "risk_score"]
    csv_files.write_cells(risk_scores(t.risk).orderBy(F.col("risk_score").desc(), "package_name"), folder, columns)
    return csv_files.read_cells(t.spark, folder, columns).withColumn("risk_score", F.col("risk_score").cast("double"))


query("snk_4_sorted_by_score", "SELECT package_name, risk_score FROM sc")(_sorted_by_score)


def _appended(t):
    """Three loads; only names that are not stored yet are added."""
    folder = new_folder(t.spark, "append")
    rows = t.projects.select("package_name", "stars", "seq")
    for part in (rows.where("seq % 3 = 0"), rows.where("seq % 2 = 0").withColumn("stars", F.lit(-1).cast("long")), rows):
        tables.append_new(part, folder, ["package_name"])
    return t.spark.read.parquet(folder).select("package_name", "stars")


query("snk_5_append_new_rows", """
SELECT package_name, CASE WHEN seq % 3 <> 0 AND seq % 2 = 0 THEN -1 ELSE stars END AS stars FROM p""")(_appended)

query("snk_6_table_counts", """
SELECT 'raw_osv_vulnerabilities' AS table_name, COUNT(*) AS row_count FROM v UNION ALL
SELECT 'raw_librariesio_projects', COUNT(*) FROM p UNION ALL SELECT 'package_vulnerability_summary', COUNT(*) FROM s UNION ALL
SELECT 'extracted_package_risk_summary', COUNT(*) FROM r""")(
    lambda t: tables.table_counts({
        "raw_osv_vulnerabilities": t.flat, "raw_librariesio_projects": t.projects,
        "package_vulnerability_summary": t.summary, "extracted_package_risk_summary": t.risk}))

query("snk_7_contract_breaches", """
SELECT 'not null: package_name' AS rule, COUNT(*) FILTER (WHERE trim(package_name) = '') AS breaches FROM c UNION ALL
SELECT 'not null: ecosystem', COUNT(*) FILTER (WHERE ecosystem IS NULL) FROM c UNION ALL
SELECT 'unique: package_name, ecosystem', COUNT(*) FROM (SELECT 1 FROM c GROUP BY NULLIF(trim(package_name), ''), ecosystem HAVING COUNT(*) > 1)""")(
    lambda t: tables.contract_breaches(
        t.candidates().withColumn("package_name", F.nullif(F.trim("package_name"), F.lit(""))),
        *schemas.CONTRACTS["package_vulnerability_summary"]))

query("snk_8_load_defaults", """
SELECT package_name, COALESCE(stars, 0) AS stars, COALESCE(forks, 0) AS forks, COALESCE(versions_count, 0) AS versions_count,
 COALESCE(dependents_count, 0) AS dependents_count FROM p""")(
    lambda t: tables.with_defaults(t.projects, schemas.LOAD_DEFAULTS["raw_librariesio_projects"]).select(
        "package_name", "stars", "forks", "versions_count", "dependents_count"))
