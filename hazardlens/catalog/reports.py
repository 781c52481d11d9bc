"""The ten analytical questions."""

from hazardlens.catalog.registry import query
from hazardlens.plans import questions
from hazardlens.sources.tables import written

_LABEL = """CASE WHEN has_high_severity_vulnerability THEN 'High-Severity Vulnerable'
 ELSE 'No High-Severity Vulnerabilities' END"""

query("q_1_dataset_totals", """
SELECT COUNT(*) AS total_packages, COUNT(*) FILTER (WHERE vulnerability_count > 0) AS vulnerable_packages,
 COUNT(*) FILTER (WHERE vulnerability_count = 0) AS non_vulnerable_packages,
 round(100.0::DOUBLE * COUNT(*) FILTER (WHERE vulnerability_count > 0) / COUNT(*), 2) AS vulnerability_percentage,
 COUNT(*) FILTER (WHERE has_high_severity_vulnerability) AS packages_with_high_severity,
 round(100.0::DOUBLE * COUNT(*) FILTER (WHERE has_high_severity_vulnerability) / COUNT(*), 2) AS high_severity_percentage
FROM r""")(lambda t: questions.dataset_totals(t.risk))

query("q_2_stars_by_status", f"""
SELECT {_LABEL} AS vulnerability_status, COUNT(*) AS package_count, round(AVG(stars), 2) AS avg_stars,
 MIN(stars) AS min_stars, MAX(stars) AS max_stars, round(stddev_samp(stars), 2) AS stddev_stars
FROM r WHERE stars > 0 GROUP BY has_high_severity_vulnerability""")(lambda t: questions.stars_by_status(t.risk))

query("q_3_dependencies_by_status", f"""
SELECT {_LABEL} AS vulnerability_status, COUNT(*) AS package_count,
 round(AVG(runtime_dependencies_count), 2) AS avg_runtime_dependencies, MIN(runtime_dependencies_count) AS min_dependencies,
 MAX(runtime_dependencies_count) AS max_dependencies, round(stddev_samp(runtime_dependencies_count), 2) AS stddev_dependencies
FROM rd WHERE runtime_dependencies_count > 0 GROUP BY has_high_severity_vulnerability""")(
    lambda t: questions.dependencies_by_status(t.risk_with_dependencies))

query("q_4_top_by_vulnerability_count", """
SELECT package_name, ecosystem, vulnerability_count, high_severity_count, max_severity_score, stars, forks, dependents_count,
 is_unmaintained, days_since_last_release,
 CASE WHEN has_high_severity_vulnerability THEN 'HIGH RISK' WHEN vulnerability_count > 0 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS risk_category
FROM r WHERE vulnerability_count > 0
ORDER BY vulnerability_count DESC NULLS FIRST, high_severity_count DESC NULLS FIRST, max_severity_score DESC NULLS FIRST, package_name
LIMIT 20""")(lambda t: questions.top_by_vulnerability_count(t.risk))

query("q_5_repository_status", """
SELECT repository_status, COUNT(*) AS package_count,
 round(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM r), 2) AS percentage_of_total,
 COUNT(*) FILTER (WHERE vulnerability_count > 0) AS vulnerable_packages,
 round(100.0::DOUBLE * COUNT(*) FILTER (WHERE vulnerability_count > 0) / COUNT(*), 2) AS vulnerability_rate,
 round(AVG(stars) FILTER (WHERE stars > 0), 2) AS avg_stars, round(AVG(days_since_last_release), 1) AS avg_days_since_release
FROM r GROUP BY repository_status""")(lambda t: questions.repository_status_distribution(t.risk))

query("q_6_release_recency", """
SELECT CASE WHEN has_high_severity_vulnerability THEN 'High-Severity Vulnerable' WHEN vulnerability_count > 0
 THEN 'Other Vulnerabilities' ELSE 'No Known Vulnerabilities' END AS vulnerability_category, COUNT(*) AS package_count,
 round(AVG(days_since_last_release), 1) AS avg_days_since_release, MIN(days_since_last_release) AS min_days,
 MAX(days_since_last_release) AS max_days, round(stddev_samp(days_since_last_release), 1) AS stddev_days
FROM r WHERE days_since_last_release IS NOT NULL GROUP BY 1""")(lambda t: questions.release_recency(t.risk))

query("q_7_top_by_severity", """
SELECT package_name, ecosystem, max_severity_score, vulnerability_count, high_severity_count, stars, dependents_count,
 is_unmaintained, repository_status, days_since_last_release,
 CASE WHEN max_severity_score >= 9 THEN 'CRITICAL' WHEN max_severity_score >= 7 THEN 'HIGH'
      WHEN max_severity_score >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity_category
FROM r WHERE max_severity_score > 0
ORDER BY max_severity_score DESC NULLS FIRST, vulnerability_count DESC NULLS FIRST, package_name LIMIT 25""")(
    lambda t: questions.top_by_severity(t.risk))

query("q_8_statistics_by_stars", """
SELECT CASE WHEN stars IS NULL OR stars = 0 THEN '0 stars' WHEN stars <= 100 THEN '1-100 stars'
 WHEN stars <= 500 THEN '101-500 stars' WHEN stars <= 1000 THEN '501-1K stars' WHEN stars <= 5000 THEN '1K-5K stars'
 WHEN stars <= 10000 THEN '5K-10K stars' ELSE '10K+ stars' END AS stars_bucket, COUNT(*) AS package_count,
 round(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM r), 2) AS percentage,
 round(AVG(vulnerability_count) FILTER (WHERE vulnerability_count > 0), 2) AS avg_vulnerabilities,
 COUNT(*) FILTER (WHERE vulnerability_count > 0) AS vulnerable_packages,
 round(100.0::DOUBLE * COUNT(*) FILTER (WHERE vulnerability_count > 0) / COUNT(*), 2) AS vulnerability_rate,
 round(AVG(high_severity_count) FILTER (WHERE high_severity_count > 0), 2) AS avg_high_severity,
 round(AVG(max_severity_score) FILTER (WHERE max_severity_score > 0), 2) AS avg_max_severity_score
FROM r GROUP BY 1""")(lambda t: questions.statistics_by_stars(t.risk))

query("q_9_statistics_by_dependencies", """
SELECT CASE WHEN runtime_dependencies_count IS NULL OR runtime_dependencies_count = 0 THEN '0 dependencies'
 WHEN runtime_dependencies_count <= 5 THEN '1-5 dependencies' WHEN runtime_dependencies_count <= 10 THEN '6-10 dependencies'
 WHEN runtime_dependencies_count <= 20 THEN '11-20 dependencies' WHEN runtime_dependencies_count <= 50 THEN '21-50 dependencies'
 ELSE '50+ dependencies' END AS dependencies_bucket, COUNT(*) AS package_count,
 round(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM rd), 2) AS percentage,
 round(AVG(vulnerability_count) FILTER (WHERE vulnerability_count > 0), 2) AS avg_vulnerabilities,
 COUNT(*) FILTER (WHERE vulnerability_count > 0) AS vulnerable_packages,
 round(100.0::DOUBLE * COUNT(*) FILTER (WHERE vulnerability_count > 0) / COUNT(*), 2) AS vulnerability_rate,
 round(AVG(high_severity_count) FILTER (WHERE high_severity_count > 0), 2) AS avg_high_severity,
 round(AVG(dependents_count) FILTER (WHERE dependents_count > 0), 1) AS avg_dependents
FROM rd GROUP BY 1""")(lambda t: questions.statistics_by_dependencies(t.risk_with_dependencies))

query("q_10_top_unmaintained", """
SELECT package_name, ecosystem, vulnerability_count, high_severity_count, max_severity_score, stars, dependents_count,
 dependent_repos_count, days_since_last_release, repository_status, rank,
 CASE WHEN has_high_severity_vulnerability AND dependents_count > 100 THEN 'CRITICAL'
      WHEN has_high_severity_vulnerability THEN 'HIGH' WHEN dependents_count > 100 THEN 'MEDIUM' ELSE 'LOW' END AS risk_assessment,
 round(100.0::DOUBLE * dependents_count / NULLIF(SUM(dependents_count) OVER (), 0), 2) AS percentage_of_total_dependents
FROM r WHERE is_unmaintained AND vulnerability_count > 0
ORDER BY CASE WHEN has_high_severity_vulnerability AND dependents_count > 100 THEN 1 WHEN has_high_severity_vulnerability THEN 2
 WHEN dependents_count > 100 THEN 3 ELSE 4 END, dependents_count DESC NULLS FIRST, high_severity_count DESC NULLS FIRST,
 max_severity_score DESC NULLS FIRST, package_name LIMIT 30""")(lambda t: questions.top_unmaintained(written(t.risk, "risk")))
