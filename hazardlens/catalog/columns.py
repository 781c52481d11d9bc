"""Column functions and row filters, each over a whole table."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.catalog.registry import query
from hazardlens.functions import labels, numbers, severity, text
from hazardlens.functions.dates import days_since, read_iso
from hazardlens.plans import projects as project_plans
from hazardlens.plans.names import request_batches
from hazardlens.sources.documents import parse_readable
from hazardlens import schemas


def _normalized():
    return text.normalize_name(F.col("cell"))


query("p_1_normalize_name", """
SELECT id, regexp_replace(lower(COALESCE(cell, '')), '^\\s+|\\s+$', '', 'g') AS name FROM names""")(
    lambda t: t.messy_names().select("id", _normalized().alias("name")))

query("p_2_package_key", """
SELECT DISTINCT lower(package_name) AS package_name, COALESCE(NULLIF(lower(trim(ecosystem)), ''), 'npm') AS ecosystem FROM c""")(
    lambda t: t.candidates().select(
        F.lower("package_name").alias("package_name"),
        text.or_default(text.normalize_name(F.col("ecosystem")), fixed.ECOSYSTEM).alias("ecosystem")).distinct())

query("p_3_part_before_dash", """
SELECT lower(trim(split_part(line, ' - ', 1))) AS name, COUNT(*) AS lines FROM raw_lines GROUP BY 1""")(
    lambda t: t.raw_lines().groupBy(text.before_dash(F.col("value")).alias("name")).agg(
        F.count(F.lit(1)).alias("lines")))

query("p_4_lenient_integer", """
SELECT id, TRY_CAST(regexp_extract(cell, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) AS number FROM numbers""")(
    lambda t: t.messy_numbers().select("id", numbers.lenient_integer(F.col("cell")).alias("number")))

query("p_5_lenient_decimal", """
SELECT id, TRY_CAST(regexp_extract(cell, '^\\s*([+-]?[0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS number FROM numbers""")(
    lambda t: t.messy_numbers().select("id", numbers.lenient_decimal(F.col("cell")).alias("number")))

query("p_6_number_or_zero", """
SELECT id, COALESCE(TRY_CAST(trim(cell) AS DOUBLE), 0) AS number FROM numbers""")(
    lambda t: t.messy_numbers().select("id", numbers.number_or_zero(F.col("cell")).alias("number")))

query("p_7_truth", "SELECT id, COALESCE(lower(cell) = 'true', FALSE) AS truth FROM flags")(
    lambda t: t.messy_flags().select("id", numbers.truth(F.col("cell")).alias("truth")))

query("p_8_unknown_category", """
SELECT package_name, COALESCE(NULLIF(repository_status, ''), 'Unknown') AS repository_status FROM r""")(
    lambda t: t.risk.select("package_name", text.or_default(F.col("repository_status"), fixed.UNKNOWN)
                            .alias("repository_status")))


def _project_documents(t):
    return parse_readable(t.project_documents(), "document", schemas.PROJECT_DOCUMENT)


query("p_9_project_row", """
SELECT lower(package_name) AS package_name, 'npm' AS platform, description, language, stars, forks, rank, repository_status,
 repository_url, licenses, latest_release_number FROM p""")(
    lambda t: project_plans.project_rows(_project_documents(t)).select(
        "package_name", "platform", "description", "language", "stars", "forks", "rank", "repository_status",
        "repository_url", "licenses", "latest_release_number"))

query("p_10_array_length", """
SELECT lower(package_name) AS package_name, CASE WHEN seq % 6 <> 0 THEN versions_count END AS versions_count
FROM p""")(
    lambda t: _project_documents(t).select(
        text.normalize_name(F.col("package_name")).alias("package_name"),
        project_plans.length_or_null(F.col("versions")).alias("versions_count")))

query("p_11_joined_list", "SELECT lower(package_name) AS package_name, normalized_licenses FROM p")(
    lambda t: _project_documents(t).select(
        text.normalize_name(F.col("package_name")).alias("package_name"),
        project_plans.list_or_text(F.col("normalized_licenses")).alias("normalized_licenses")))


def _dependency_documents(t):
    return parse_readable(t.dependency_documents(), "document", schemas.DEPENDENCY_DOCUMENT)


_RUNTIME_COUNT = """CASE WHEN seq % 10 = 0 THEN 0 ELSE (seq % 12 + 1) - (seq % 12 + 1) // 4 END"""

query("p_12_runtime_dependency_count", f"""
SELECT lower(package_name) AS package_name, {_RUNTIME_COUNT} AS runtime_dependencies_count FROM p""")(
    lambda t: _dependency_documents(t).select(
        "package_name", project_plans.runtime_dependency_count(F.col("dependencies"))
        .alias("runtime_dependencies_count")))

query("p_13_dependency_row", f"""
SELECT lower(package_name) AS package_name, 'npm' AS platform, {_RUNTIME_COUNT} AS runtime_dependencies_count,
 dependents_count, dependent_repos_count, latest_release_number, versions_count
FROM p WHERE seq % 3 <> 0 AND latest_release_number IS NOT NULL""")(
    lambda t: project_plans.dependency_rows(t.projects, _dependency_documents(t)).select(
        "package_name", "platform", "runtime_dependencies_count", "dependents_count", "dependent_repos_count",
        "latest_release_number", "versions_count"))


def _release_text(t):
    cell = (F.when(F.col("seq") % 5 == 0, "").when(F.col("seq") % 5 == 1, "not a date")
            .when(F.col("seq") % 5 == 2, "2002-06-01T00:00:00Z")
            .otherwise(F.date_format("latest_release_published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return t.projects.select("package_name", cell.alias("cell"))


query("p_14_days_since", """
SELECT package_name, CASE WHEN seq % 5 >= 3 AND latest_release_published_at <= TIMESTAMP '2001-12-31 12:00:00'
 THEN CAST(FLOOR((epoch(TIMESTAMP '2001-12-31 12:00:00') - epoch(latest_release_published_at)) / 86400) AS BIGINT) END AS days FROM p""")(
    lambda t: _release_text(t).select("package_name", days_since(read_iso(F.col("cell")), t.as_of).alias("days")))

query("p_15_has_repository", "SELECT package_name, repository_url IS NOT NULL AS has_repository FROM p")(
    lambda t: t.projects.select("package_name", text.has_text(
        F.when(F.col("seq") % 5 == 0, F.lit(" \t")).otherwise(F.col("repository_url"))).alias("has_repository")))

query("p_16_is_unmaintained", """
SELECT package_name, COALESCE(repository_status = 'Unmaintained', FALSE) AS is_unmaintained FROM p""")(
    lambda t: t.projects.select("package_name", text.equals_word(
        F.concat(F.lit(" "), F.upper("repository_status"), F.lit("\t")), "unmaintained").alias("is_unmaintained")))

query("p_17_display_name", """
SELECT s.package_name AS key, COALESCE(p.package_name, s.package_name) AS package_name
FROM s LEFT JOIN p ON lower(p.package_name) = s.package_name""")(
    lambda t: t.summary.select(F.col("package_name").alias("key")).join(
        t.projects.select(F.lower("package_name").alias("key"), "package_name"), "key", "left").select(
        "key", F.coalesce(text.null_if_blank(F.col("package_name")), F.col("key")).alias("package_name")))


def _judged_documents(t):
    documents = parse_readable(t.vulnerability_documents(), "document", schemas.VULNERABILITY_DOCUMENT)
    verdict = severity.severity_of(F.col("id"), F.col("severity"), F.col("database_specific"))
    return documents.select(F.col("id").alias("osv_id"), verdict.alias("verdict"))


query("p_18_severity_ladder", """
SELECT id AS osv_id, score AS severity_score, severity_type FROM docs""")(
    lambda t: _judged_documents(t).select("osv_id", F.col("verdict.score").alias("severity_score"),
                                          F.col("verdict.type").alias("severity_type")))

query("p_19_label_score", """
SELECT o_orderkey, CAST(CASE upper(split_part(o_orderpriority, '-', 2)) WHEN 'CRITICAL' THEN 9.5 WHEN 'HIGH' THEN 8.0
 WHEN 'MEDIUM' THEN 5.5 WHEN 'LOW' THEN 2.5 END AS DOUBLE) AS score FROM orders""")(
    lambda t: t.given("orders").select("o_orderkey", severity.label_score(
        F.initcap(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))).alias("score")))

query("p_20_is_high_severity", """
SELECT id AS osv_id, COALESCE(score >= 7.0, FALSE) AS is_high_severity FROM docs""")(
    lambda t: _judged_documents(t).select("osv_id", severity.is_high(F.col("verdict.score")).alias("is_high_severity")))

query("p_21_is_malware", "SELECT id AS osv_id, severity_type = 'MALWARE' AS is_malware FROM docs")(
    lambda t: _judged_documents(t).select("osv_id", (F.col("verdict.type") == "MALWARE").alias("is_malware")))

query("p_22_one_decimal_score", "SELECT id AS osv_id, round(score, 1) AS severity_score FROM docs")(
    lambda t: _judged_documents(t).select("osv_id", F.round("verdict.score", 1).alias("severity_score")))

query("p_23_risk_score", "SELECT package_name, risk_score FROM sc")(
    lambda t: t.scored.select("package_name", "risk_score"))


def _high() -> Column:
    return F.col("has_high_severity_vulnerability")


def _count() -> Column:
    return F.col("vulnerability_count")


query("p_24_status_label", """
SELECT package_name, CASE WHEN has_high_severity_vulnerability THEN 'High-Severity Vulnerable'
 ELSE 'No High-Severity Vulnerabilities' END AS status FROM r""")(
    lambda t: t.risk.select("package_name", labels.vulnerability_status(_high()).alias("status")))

query("p_25_risk_category", """
SELECT package_name, CASE WHEN has_high_severity_vulnerability THEN 'HIGH RISK' WHEN vulnerability_count > 0
 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS category FROM r""")(
    lambda t: t.risk.select("package_name", labels.risk_category(_high(), _count()).alias("category")))

query("p_26_vulnerability_category", """
SELECT package_name, CASE WHEN has_high_severity_vulnerability THEN 'High-Severity Vulnerable' WHEN vulnerability_count > 0
 THEN 'Other Vulnerabilities' ELSE 'No Known Vulnerabilities' END AS category FROM r""")(
    lambda t: t.risk.select("package_name", numbers.label_at(
        labels.vulnerability_category_ordinal(_high(), _count()), fixed.VULNERABILITY_CATEGORIES).alias("category")))

query("p_27_severity_category", """
SELECT package_name, CASE WHEN max_severity_score >= 9 THEN 'CRITICAL' WHEN max_severity_score >= 7 THEN 'HIGH'
 WHEN max_severity_score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS category FROM s""")(
    lambda t: t.summary.select("package_name", labels.severity_category(F.col("max_severity_score")).alias("category")))

query("p_28_risk_assessment", """
SELECT package_name, CASE WHEN has_high_severity_vulnerability AND dependents_count > 100 THEN 'CRITICAL'
 WHEN has_high_severity_vulnerability THEN 'HIGH' WHEN vulnerability_count > 0 AND dependents_count > 100 THEN 'MEDIUM'
 WHEN vulnerability_count > 0 THEN 'LOW' ELSE 'MINIMAL' END AS assessment FROM r""")(
    lambda t: t.risk.select("package_name", numbers.label_at(
        labels.risk_assessment_ordinal(_high(), _count(), F.col("dependents_count")), fixed.RISK_ASSESSMENTS)
        .alias("assessment")))

query("p_29_stars_bucket", """
SELECT package_name, CASE WHEN stars IS NULL OR stars = 0 THEN '0 stars' WHEN stars <= 100 THEN '1-100 stars'
 WHEN stars <= 500 THEN '101-500 stars' WHEN stars <= 1000 THEN '501-1K stars' WHEN stars <= 5000 THEN '1K-5K stars'
 WHEN stars <= 10000 THEN '5K-10K stars' ELSE '10K+ stars' END AS bucket FROM r""")(
    lambda t: t.risk.select("package_name", numbers.label_at(
        numbers.range_ordinal(F.col("stars"), fixed.STAR_BUCKETS), numbers.labels_of(fixed.STAR_BUCKETS))
        .alias("bucket")))

query("p_30_dependencies_bucket", """
SELECT package_name, CASE WHEN runtime_dependencies_count IS NULL OR runtime_dependencies_count = 0 THEN '0 dependencies'
 WHEN runtime_dependencies_count <= 5 THEN '1-5 dependencies' WHEN runtime_dependencies_count <= 10 THEN '6-10 dependencies'
 WHEN runtime_dependencies_count <= 20 THEN '11-20 dependencies' WHEN runtime_dependencies_count <= 50 THEN '21-50 dependencies'
 ELSE '50+ dependencies' END AS bucket FROM rd""")(
    lambda t: t.risk_with_dependencies.select("package_name", numbers.label_at(
        numbers.range_ordinal(F.col("runtime_dependencies_count"), fixed.DEPENDENCY_BUCKETS),
        numbers.labels_of(fixed.DEPENDENCY_BUCKETS)).alias("bucket")))

query("p_31_stars_bin", """
SELECT package_name, CASE WHEN stars <= 99 THEN '<100' WHEN stars <= 999 THEN '100-999' WHEN stars <= 9999 THEN '1K-9.9K'
 WHEN stars <= 99999 THEN '10K-99.9K' WHEN stars > 99999 THEN '100K+' END AS bin FROM p""")(
    lambda t: t.projects.select("package_name", numbers.label_at(
        numbers.bin_ordinal(F.col("stars"), fixed.STAR_BINS), numbers.labels_of(fixed.STAR_BINS)).alias("bin")))

query("p_32_percent", """
SELECT package_name, round(100.0::DOUBLE * high_severity_count / NULLIF(vulnerability_count, 0), 2) AS high_percent FROM r""")(
    lambda t: t.risk.select("package_name", numbers.percent(
        F.col("high_severity_count"), F.col("vulnerability_count")).alias("high_percent")))

query("p_33_positive_mean", """
SELECT rank, round(AVG(stars) FILTER (WHERE stars > 0), 4) AS avg_stars, MIN(stars) FILTER (WHERE stars > 0) AS min_stars
FROM p GROUP BY rank""")(
    lambda t: t.projects.groupBy("rank").agg(
        F.round(F.avg(numbers.positive(F.col("stars"))), 4).alias("avg_stars"),
        F.min(numbers.positive(F.col("stars"))).alias("min_stars")))

query("p_34_share_bar", """
SELECT package_name, repeat('█', CAST(FLOOR(100.0::DOUBLE * high_severity_count / vulnerability_count / 2) AS INT)) AS bar FROM s""")(
    lambda t: t.summary.select("package_name", text.share_bar(numbers.percent(
        F.col("high_severity_count"), F.col("vulnerability_count"), None)).alias("bar")))

query("p_35_output_columns", """
SELECT package_name, ecosystem, stars, forks, contributions_count, dependent_repos_count, dependents_count, rank,
 repository_status, strftime(latest_release_published_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS latest_release_published_at,
 versions_count, days_since_last_release, has_repository, is_unmaintained, vulnerability_count, high_severity_count,
 max_severity_score, has_high_severity_vulnerability FROM r""")(
    lambda t: t.risk.select(*fixed.RISK_COLUMNS).withColumn(
        "latest_release_published_at", F.date_format("latest_release_published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")))

query("p_36_request_text", """
SELECT (rn - 1) // 100 + 1 AS batch_index, COUNT(*) AS package_count,
 concat('{"queries":[', string_agg(concat('{"package":{"name":"', name, '","ecosystem":"npm"}}'), ',' ORDER BY rn), ']}') AS request
FROM (SELECT lower(c_name) AS name, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) GROUP BY 1""")(
    lambda t: request_batches(t.given("customer").select(
        F.col("c_name").alias("package_name"), F.col("c_custkey").alias("seq"))).select(
        "batch_index", "package_count", "request"))

query("f_1_blank_names_dropped", """
SELECT id, regexp_replace(lower(cell), '^\\s+|\\s+$', '', 'g') AS name FROM names
WHERE regexp_replace(COALESCE(cell, ''), '\\s', '', 'g') <> ''""")(
    lambda t: t.messy_names().select("id", _normalized().alias("name")).where("name <> ''"))

query("f_2_ecosystem_entries", """
SELECT id AS osv_id, COUNT(*) AS entries FROM docs, range(2) AS copies(n)
WHERE (n = 0 OR seq % 3 = 0) GROUP BY id""")(
    lambda t: parse_readable(t.vulnerability_documents(), "document", schemas.VULNERABILITY_DOCUMENT)
    .select("id", F.explode("affected").alias("entry")).where(F.col("entry.package").isNotNull())
    .where(F.lower("entry.package.ecosystem") == fixed.ECOSYSTEM)
    .groupBy(F.col("id").alias("osv_id")).agg(F.count(F.lit(1)).alias("entries")))

query("f_3_versioned_projects", """
SELECT lower(package_name) AS package_name, latest_release_number FROM p WHERE latest_release_number IS NOT NULL""")(
    lambda t: project_plans.with_version(t.projects).select("package_name", "latest_release_number"))

query("f_4_above_zero", "SELECT package_name, stars FROM p WHERE stars > 0")(
    lambda t: t.projects.select("package_name", "stars").where("stars > 0"))

query("f_5_known_values", """
SELECT package_name, days_since_last_release FROM r WHERE days_since_last_release IS NOT NULL""")(
    lambda t: t.risk.select("package_name", "days_since_last_release").dropna(subset=["days_since_last_release"]))

query("f_6_unmaintained_and_vulnerable", """
SELECT package_name, vulnerability_count FROM r WHERE is_unmaintained AND vulnerability_count > 0""")(
    lambda t: t.risk.where("is_unmaintained AND vulnerability_count > 0").select("package_name", "vulnerability_count"))
