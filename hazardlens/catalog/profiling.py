"""Profiles of the risk table and the data behind each chart."""

from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.catalog.registry import query
from hazardlens.plans import profile

_NUMERIC = ["stars", "forks", "contributions_count", "dependent_repos_count", "dependents_count", "rank", "versions_count",
            "days_since_last_release", "vulnerability_count", "high_severity_count", "max_severity_score"]


def _each(columns, template, source="r"):
    return " UNION ALL ".join(template.format(c=column, source=source) for column in columns)


query("e_1_describe", _each(_NUMERIC, """
SELECT '{c}' AS column_name, COUNT({c}) AS value_count, round(AVG({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std,
 MIN({c})::DOUBLE AS min, quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median,
 quantile_cont({c}::DOUBLE, 0.75) AS q3, MAX({c})::DOUBLE AS max FROM {source}"""))(
    lambda t: profile.describe(t.risk, _NUMERIC).withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6)}))

query("e_2_missing", "SELECT * FROM (" + _each(fixed.RISK_COLUMNS, """
SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing_count,
 round(100.0::DOUBLE * (COUNT(*) - COUNT({c})) / COUNT(*), 2) AS missing_percent FROM {source}""") + ") WHERE missing_count > 0")(
    lambda t: profile.missing(t.risk))

query("e_2_missing_totals", "SELECT SUM(n)::BIGINT AS missing_cells, SUM(cells)::BIGINT AS total_cells FROM (" + _each(
    fixed.RISK_COLUMNS, "SELECT COUNT(*) - COUNT({c}) AS n, COUNT(*) AS cells FROM {source}") + ")")(
    lambda t: profile.missing_totals(t.risk))

query("e_3_text_value_counts", """
WITH x AS (SELECT 'package_name' AS column_name, package_name AS value FROM r UNION ALL SELECT 'ecosystem', ecosystem FROM r
 UNION ALL SELECT 'repository_status', repository_status FROM r
 UNION ALL SELECT 'latest_release_published_at', strftime(latest_release_published_at, '%Y-%m-%dT%H:%M:%S.%gZ') FROM r)
SELECT column_name, value, COUNT(*) AS value_count, round(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM r), 1) AS percentage,
 repeat('█', CAST(FLOOR(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM r) / 2) AS INT)) AS bar
FROM x WHERE value IS NOT NULL GROUP BY column_name, value""")(lambda t: profile.text_value_counts(t.risk))

query("e_4_class_distribution", """
SELECT has_high_severity_vulnerability AS high, COUNT(*) AS packages, round(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM r), 1) AS percentage
FROM r GROUP BY 1""")(lambda t: profile.class_distribution(t.risk))

query("e_5_days_histogram", """
WITH x AS (SELECT days_since_last_release::DOUBLE AS x FROM r WHERE days_since_last_release IS NOT NULL),
e AS (SELECT MIN(x) AS lo, MAX(x) AS hi, AVG(x) AS mean, quantile_cont(x, 0.5) AS median FROM x),
h AS (SELECT CAST(least(floor((x - lo) * 50 / (hi - lo)), 49) AS BIGINT) AS bin, COUNT(*) AS n FROM x, e GROUP BY 1)
SELECT g.i AS bin, round(lo + (hi - lo) * g.i / 50, 6) AS bin_from, round(lo + (hi - lo) * (g.i + 1) / 50, 6) AS bin_to,
 COALESCE(h.n, 0) AS bin_count, round(mean, 6) AS mean, median FROM range(50) AS g(i) CROSS JOIN e LEFT JOIN h ON h.bin = g.i""")(
    lambda t: profile.days_histogram(t.risk).withColumns(
        {name: F.round(name, 6) for name in ("bin_from", "bin_to", "mean")}))

_BOX = """
WITH x AS (SELECT {group} AS label, {value}::DOUBLE AS x FROM {source} WHERE {value} IS NOT NULL),
q AS (SELECT label, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY label)
SELECT x.label, COUNT(*) AS n, round(AVG(x), 6) AS mean, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
 MIN(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
 MAX(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 COUNT(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
FROM x JOIN q ON q.label = x.label GROUP BY x.label"""
_HIGH_LABEL = "CASE WHEN has_high_severity_vulnerability THEN 'High-Severity Vulnerable' ELSE 'Non-Vulnerable' END"
_MAINTAINED = "CASE WHEN is_unmaintained THEN 'Unmaintained' ELSE 'Maintained' END"


def _rounded(rows):
    return rows.withColumn("mean", F.round("mean", 6))


query("e_6_stars_box", _BOX.format(group=_HIGH_LABEL, value="stars", source="r"))(
    lambda t: _rounded(profile.stars_box(t.risk)))

query("e_6_count_by_maintenance_box", _BOX.format(group=_MAINTAINED, value="vulnerability_count", source="r"))(
    lambda t: _rounded(profile.count_by_maintenance_box(t.risk)))

query("e_7_dependencies_box", _BOX.format(group=_HIGH_LABEL, value="runtime_dependencies_count", source="rd"))(
    lambda t: _rounded(profile.dependencies_box(t.risk_with_dependencies)))

query("e_8_status_counts", """
SELECT repository_status, COUNT(*) AS packages, round(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM r), 1) AS percentage
FROM r WHERE repository_status IS NOT NULL GROUP BY 1""")(lambda t: profile.status_counts(t.risk))

query("e_9_scatter_rows", """
SELECT stars, runtime_dependencies_count, has_high_severity_vulnerability FROM rd
WHERE stars IS NOT NULL AND runtime_dependencies_count IS NOT NULL""")(
    lambda t: profile.stars_and_dependencies(t.risk_with_dependencies))

query("e_9_correlation", """
SELECT round(corr(stars::DOUBLE, runtime_dependencies_count::DOUBLE), 3) AS correlation, COUNT(*) AS points FROM rd
WHERE stars IS NOT NULL AND runtime_dependencies_count IS NOT NULL""")(
    lambda t: profile.stars_dependencies_correlation(t.risk_with_dependencies))

query("e_10_severity_box", _BOX.format(group="'vulnerable'", value="max_severity_score", source="(SELECT * FROM r WHERE vulnerability_count > 0)"))(
    lambda t: _rounded(profile.severity_box(t.risk)))

query("e_11_high_rate_by_stars", """
SELECT CASE WHEN COALESCE(stars, 0) <= 99 THEN '<100' WHEN stars <= 999 THEN '100-999' WHEN stars <= 9999 THEN '1K-9.9K'
 WHEN stars <= 99999 THEN '10K-99.9K' ELSE '100K+' END AS stars_bucket,
 round(100.0::DOUBLE * COUNT(*) FILTER (WHERE has_high_severity_vulnerability) / COUNT(*), 6) AS high_rate FROM r GROUP BY 1""")(
    lambda t: profile.high_rate_by_stars(t.risk).withColumn("high_rate", F.round("high_rate", 6)))

query("e_12_top_by_count", """
SELECT package_name, vulnerability_count FROM r ORDER BY vulnerability_count DESC, package_name LIMIT 15""")(
    lambda t: profile.top_by_count(t.risk))

query("e_13_top_by_risk", "SELECT package_name, risk_score FROM sc ORDER BY risk_score DESC, package_name LIMIT 10")(
    lambda t: profile.top_by_risk(t.scored))

query("e_14_stars_and_versions", """
SELECT stars, COALESCE(versions_count, 0) AS versions_count, has_high_severity_vulnerability FROM r WHERE stars > 0""")(
    lambda t: profile.stars_and_versions(t.risk))
