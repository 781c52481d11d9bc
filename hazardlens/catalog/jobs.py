"""Multi-step jobs and the summary checks."""

from pyspark.sql import functions as F

from hazardlens import schemas
from hazardlens.catalog.combining import _SUMMARY, _dated, _outcomes
from hazardlens.catalog.registry import query
from hazardlens.functions.dates import write_iso
from hazardlens.plans import names, projects, quality, vulnerabilities
from hazardlens.plans.risk import findings, risk_summary
from hazardlens.sources.documents import parse_column, parse_readable
from hazardlens.sources.tables import append_new
from hazardlens.session import new_folder


def _dated_columns(rows, *columns):
    return rows.withColumns({name: write_iso(F.col(name)) for name in columns})


def flat_documents(t):
    """Vulnerability documents parsed from their text; the unreadable ones have no fields."""
    return parse_column(t.vulnerability_documents(), "document", schemas.VULNERABILITY_DOCUMENT)


query("job_1_clean_raw_list", """
SELECT DISTINCT lower(trim(split_part(line, ' - ', 1))) AS package_name FROM raw_lines
WHERE trim(split_part(line, ' - ', 1)) <> ''""")(lambda t: names.clean_raw_list(t.raw_lines()))

query("job_2_merge_lists", """
SELECT concat(lower(c_name), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '-top' END) AS package_name FROM customer UNION SELECT package_name FROM s""")(
    lambda t: names.merge_lists(t.top_names(), t.summary))

query("job_3_list_from_summary", "SELECT DISTINCT package_name FROM s")(lambda t: names.name_list(t.summary))


def _batches(t):
    listed = t.candidates().withColumn("seq", F.substring("package_name", 10, 9).try_cast("bigint"))
    stored = t.projects.where("seq % 5 = 0").select(F.lower("package_name").alias("package_name"))
    todo = names.exclude_known(
        listed.select(F.lower("package_name").alias("package_name"), "seq"), stored, ["package_name"])
    return names.request_batches(todo).withColumn("packages", F.array_join("packages", ","))


query("job_4_request_batches", """
WITH todo AS (SELECT DISTINCT lower(package_name) AS name FROM c WHERE trim(package_name) <> ''
 AND lower(package_name) NOT IN (SELECT lower(package_name) FROM p WHERE seq % 5 = 0)),
placed AS (SELECT name, row_number() OVER (ORDER BY name) AS rn FROM todo)
SELECT (rn - 1) // 100 + 1 AS batch_index, COUNT(*) AS package_count, string_agg(name, ',' ORDER BY rn) AS packages,
 concat('{"queries":[', string_agg(concat('{"package":{"name":"', name, '","ecosystem":"npm"}}'), ',' ORDER BY rn), ']}') AS request
FROM placed GROUP BY 1""")(_batches)

query("job_5_pending_and_outcomes", """
SELECT CASE c_custkey % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'success' WHEN 2 THEN 'not_found' ELSE 'failed' END AS outcome,
 COUNT(*) AS items FROM customer GROUP BY 1""")(_outcomes)


def _pending(t):
    """Candidate names that no earlier run has stored."""
    wanted = t.candidates().select(F.lower("package_name").alias("package_name")).where("trim(package_name) <> ''")
    stored = t.projects.where("seq % 4 = 0").select(F.lower("package_name").alias("package_name"))
    return names.pending(wanted, stored, ["package_name"])


query("job_5_pending", """
SELECT DISTINCT lower(package_name) AS package_name FROM c WHERE trim(package_name) <> ''
 AND lower(package_name) NOT IN (SELECT lower(package_name) FROM p WHERE seq % 4 = 0)""")(_pending)


def _stored_projects(t):
    """Two loads of overlapping documents into one table; the second adds only what is new."""
    documents = parse_readable(t.project_documents(), "document", schemas.PROJECT_DOCUMENT)
    folder = new_folder(t.spark, "projects")
    for part in (documents.where("seq % 2 = 0"), documents):
        append_new(projects.project_rows(part), folder, ["package_name"])
    return _dated_columns(t.spark.read.parquet(folder), "latest_release_published_at")


query("job_6_project_table", """
SELECT lower(package_name) AS package_name, platform, description, language, stars, forks, contributions_count,
 dependent_repos_count, dependents_count, rank, repository_status, repository_url, licenses, normalized_licenses, latest_release_number,
 strftime(latest_release_published_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS latest_release_published_at,
 CASE WHEN seq % 6 <> 0 THEN versions_count END AS versions_count FROM p""")(_stored_projects)

query("job_7_dependency_table", """
SELECT lower(package_name) AS package_name, platform,
 CASE WHEN seq % 10 = 0 THEN 0 ELSE (seq % 12 + 1) - (seq % 12 + 1) // 4 END AS runtime_dependencies_count,
 dependents_count, dependent_repos_count, CAST(NULL AS DOUBLE) AS score, latest_release_number,
 strftime(latest_release_published_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS latest_release_published_at, versions_count
FROM p WHERE seq % 3 <> 0 AND latest_release_number IS NOT NULL""")(
    lambda t: _dated_columns(projects.dependency_rows(t.projects, parse_readable(
        t.dependency_documents(), "document", schemas.DEPENDENCY_DOCUMENT)), "latest_release_published_at"))

query("job_8_flatten_documents", "SELECT * FROM f")(
    lambda t: _dated_columns(vulnerabilities.flatten(flat_documents(t)), "published", "modified"))

query("job_9_package_summary", _SUMMARY)(lambda t: _dated(t.summary))

query("job_9_summary_of_documents", """
SELECT package_name, COUNT(DISTINCT osv_id) AS vulnerability_count,
 COUNT(DISTINCT osv_id) FILTER (WHERE is_high_severity) AS high_severity_count, MAX(severity_score) AS max_severity_score,
 BOOL_OR(is_high_severity) AS has_high_severity_vulnerability FROM f GROUP BY package_name""")(
    lambda t: vulnerabilities.package_counts(vulnerabilities.flatten(flat_documents(t)).withColumn("seq", F.lit(0)))
    .drop("seq", "ecosystem", "latest_vulnerability_published_at"))


def _with_repeats(t):
    """Projects with an older row for every name, which must lose."""
    older = F.col("older")
    return t.projects.withColumn("older", F.explode(F.array(F.lit(True), F.lit(False)))).withColumns({
        "seq": F.when(older, F.col("seq") - 10_000_000_000).otherwise(F.col("seq")),
        "stars": F.when(older, F.lit(-1).cast("long")).otherwise(F.col("stars")),
        "package_name": F.when(older, F.upper("package_name")).otherwise(F.col("package_name"))}).drop("older")


query("job_10_risk_summary", """
SELECT r.* REPLACE (strftime(latest_release_published_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS latest_release_published_at) FROM r""")(
    lambda t: _dated_columns(risk_summary(vulnerabilities.package_counts(t.flat), _with_repeats(t), t.as_of), "latest_release_published_at"))

query("job_11_negative_sample", """
SELECT DISTINCT lower(package_name) AS package_name, COALESCE(NULLIF(lower(trim(ecosystem)), ''), 'npm') AS ecosystem FROM c
WHERE trim(package_name) <> '' AND (lower(package_name), COALESCE(NULLIF(lower(trim(ecosystem)), ''), 'npm')) NOT IN
 (SELECT (package_name, ecosystem) FROM s)""")(lambda t: names.negative_sample(t.candidates(), t.summary))

query("job_11_negative_sample_counts", """
WITH k AS (SELECT lower(package_name) AS name, COALESCE(NULLIF(lower(trim(ecosystem)), ''), 'npm') AS eco FROM c WHERE trim(package_name) <> ''),
m AS (SELECT k.*, s.package_name IS NOT NULL AS known FROM k LEFT JOIN s ON s.package_name = k.name AND s.ecosystem = k.eco)
SELECT COUNT(*) AS total_candidates, COUNT(*) FILTER (WHERE known) AS removed_vulnerable,
 COUNT(*) FILTER (WHERE NOT known) - COUNT(DISTINCT (name, eco)) FILTER (WHERE NOT known) AS removed_duplicates,
 COUNT(DISTINCT (name, eco)) FILTER (WHERE NOT known) AS kept FROM m""")(
    lambda t: names.negative_sample_counts(t.candidates(), t.summary))

query("job_12_risk_scores", """
SELECT package_name, vulnerability_count, max_severity_score, stars, risk_score FROM sc""")(
    lambda t: t.scored.select("package_name", "vulnerability_count", "max_severity_score", "stars", "risk_score")
    .orderBy(F.col("risk_score").desc()))

query("job_13_findings", """
SELECT COUNT(*) AS total_packages, COUNT(*) FILTER (WHERE vulnerability_count > 0) AS vulnerable_packages,
 round(100.0::DOUBLE * COUNT(*) FILTER (WHERE vulnerability_count > 0) / COUNT(*), 1) AS vulnerable_rate,
 COUNT(*) FILTER (WHERE has_high_severity_vulnerability) AS high_severity_packages,
 round(100.0::DOUBLE * COUNT(*) FILTER (WHERE has_high_severity_vulnerability) / COUNT(*), 1) AS high_severity_rate,
 round(AVG(stars) FILTER (WHERE has_high_severity_vulnerability), 1) AS avg_stars_high,
 round(AVG(stars) FILTER (WHERE NOT has_high_severity_vulnerability), 1) AS avg_stars_other,
 round(AVG(days_since_last_release) FILTER (WHERE has_high_severity_vulnerability), 1) AS avg_days_high,
 round(AVG(days_since_last_release) FILTER (WHERE NOT has_high_severity_vulnerability), 1) AS avg_days_other,
 (SELECT package_name FROM sc ORDER BY risk_score DESC, package_name LIMIT 1) AS top_risk_package,
 MAX(risk_score) AS top_risk_score FROM sc""")(lambda t: findings(t.scored))


def _damaged(summary):
    """Every tenth package's count is blank, every ninth one's is wrong."""
    place = F.substring("package_name", 10, 9).cast("bigint")
    return summary.withColumn("high_severity_count", F.when(place % 10 == 0, "").when(
        place % 9 == 0, F.lit("0")).otherwise(F.col("high_severity_count").cast("string")))


_DAMAGED = """
WITH b AS (SELECT package_name, max_severity_score, CASE WHEN CAST(substr(package_name, 10) AS BIGINT) % 10 = 0 THEN ''
 WHEN CAST(substr(package_name, 10) AS BIGINT) % 9 = 0 THEN '0' ELSE CAST(high_severity_count AS VARCHAR) END AS text FROM s),
g AS (SELECT *, COALESCE(TRY_CAST(text AS BIGINT), 0) AS n FROM b) """

query("dq_1_blank_counts", _DAMAGED + """
SELECT COUNT(*) FILTER (WHERE text = '') AS blanks, CASE WHEN COUNT(*) FILTER (WHERE text = '') = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM g""")(
    lambda t: quality.blank_counts(_damaged(t.summary)))

query("dq_2_inconsistent_rows", _DAMAGED + """
SELECT package_name, n AS high_severity_count, max_severity_score FROM g WHERE (n > 0) <> COALESCE(max_severity_score >= 7.0, FALSE)""")(
    lambda t: quality.inconsistencies(_damaged(t.summary)))

query("dq_2_first_inconsistent_rows", _DAMAGED + """
SELECT package_name, n AS high_severity_count, max_severity_score, COUNT(*) OVER () AS errors FROM g
WHERE (n > 0) <> COALESCE(max_severity_score >= 7.0, FALSE) ORDER BY package_name LIMIT 5""")(
    lambda t: quality.inconsistency_report(_damaged(t.summary)))

query("dq_3_distribution", """
SELECT COUNT(*) FILTER (WHERE high_severity_count > 0) AS high_packages,
 round(100.0::DOUBLE * COUNT(*) FILTER (WHERE high_severity_count > 0) / COUNT(*), 1) AS high_share,
 COUNT(*) FILTER (WHERE high_severity_count = 0) AS other_packages,
 round(100.0::DOUBLE * COUNT(*) FILTER (WHERE high_severity_count = 0) / COUNT(*), 1) AS other_share,
 CASE WHEN COUNT(*) FILTER (WHERE high_severity_count > 0) > 0 AND
  COUNT(*) FILTER (WHERE high_severity_count > 0) < COUNT(*) * 0.95 THEN 'PASS' ELSE 'CAUTION' END AS verdict FROM s""")(
    lambda t: quality.distribution(t.summary))
