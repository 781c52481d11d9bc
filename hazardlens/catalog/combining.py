"""Joins, aggregates, windows, top lists and set operations."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens.catalog.registry import query
from hazardlens.functions import labels, numbers
from hazardlens.functions.dates import write_iso
from hazardlens.functions.text import normalize_name
from hazardlens.learning.metrics import precision_recall_points, roc_points, threshold_point
from hazardlens.operators.keys import distinct_union, exclude_known, first_per_key, last_per_key
from hazardlens.operators.ranks import exact_quantiles
from hazardlens.operators.running import numbered
from hazardlens.operators.shapes import QUARTILES, row_total, value_counts
from hazardlens.plans import names
from hazardlens.plans.risk import top_risks
from hazardlens.plans.vulnerabilities import one_row_per_id, package_ids, package_summary
from hazardlens.sources.tables import table_counts


def _rows() -> Column:
    return F.count(F.lit(1))


def _high() -> Column:
    return F.col("has_high_severity_vulnerability")


def _count() -> Column:
    return F.col("vulnerability_count")


query("j_1_full_outer_join", """
SELECT COALESCE(p.package_name, s.package_name) AS package_name, COALESCE(s.vulnerability_count, 0) AS vulnerability_count,
 p.stars FROM s FULL OUTER JOIN p ON s.package_name = lower(p.package_name)""")(
    lambda t: t.risk.select("package_name", "vulnerability_count", "stars"))

query("j_2_not_vulnerable", """
SELECT DISTINCT lower(package_name) AS package_name, COALESCE(NULLIF(lower(trim(ecosystem)), ''), 'npm') AS ecosystem FROM c
WHERE trim(package_name) <> '' AND NOT EXISTS (SELECT 1 FROM s WHERE s.package_name = lower(c.package_name)
 AND s.ecosystem = COALESCE(NULLIF(lower(trim(c.ecosystem)), ''), 'npm'))""")(
    lambda t: names.negative_sample(t.candidates(), t.summary))

query("j_3_pending_names", """
SELECT DISTINCT lower(c_name) AS package_name FROM customer WHERE lower(c_name) NOT IN (SELECT lower(package_name) FROM p)""")(
    lambda t: names.pending(
        t.given("customer").select(F.lower("c_name").alias("package_name")),
        t.projects.select(F.lower("package_name").alias("package_name")), ["package_name"]))


def _versions(t):
    return t.dependency_documents().select("package_name", F.col("version").alias("latest_release_number"))


query("j_4_name_and_version_join", """
SELECT lower(package_name) AS package_name, latest_release_number, dependents_count FROM p
WHERE seq % 3 <> 0 AND latest_release_number IS NOT NULL""")(
    lambda t: t.projects.select(F.lower("package_name").alias("package_name"), "latest_release_number",
                                "dependents_count").join(_versions(t), ["package_name", "latest_release_number"]))

query("j_5_total_beside_groups", """
SELECT rank, COUNT(*) AS packages, (SELECT COUNT(*) FROM p) AS total FROM p GROUP BY rank""")(
    lambda t: t.projects.groupBy("rank").agg(_rows().alias("packages")).withColumn("total", row_total(t.projects)))

query("j_6_dependency_counts", "SELECT package_name, runtime_dependencies_count FROM rd")(
    lambda t: t.risk_with_dependencies.select("package_name", "runtime_dependencies_count"))

_SUMMARY = """
SELECT package_name, ecosystem, vulnerability_count, high_severity_count, max_severity_score,
 strftime(latest_vulnerability_published_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS latest_vulnerability_published_at,
 has_high_severity_vulnerability, osv_ids FROM s"""


def _dated(summary):
    return summary.withColumn("latest_vulnerability_published_at",
                              write_iso(F.col("latest_vulnerability_published_at")))


def _repeated_flat(t):
    """Every row twice; the later copy says something else and must not count."""
    later = t.flat.withColumns({
        "package_name": F.concat(F.lit(" "), F.upper("package_name")), "severity_score": F.lit(1.0),
        "is_high_severity": ~F.col("is_high_severity"), "seq": F.col("seq") + 10_000_000_000})
    return t.flat.unionByName(later)


query("a_1_package_summary", _SUMMARY)(lambda t: _dated(package_summary(_repeated_flat(t))))

query("a_1_package_ids", "SELECT DISTINCT package_name, ecosystem, osv_id FROM v")(lambda t: package_ids(t.flat))

query("a_2_blank_ids_kept", """
SELECT package_name, COUNT(DISTINCT osv_id) FILTER (WHERE seq % 2 = 0) AS vulnerability_count FROM v GROUP BY package_name""")(
    lambda t: package_summary(t.flat.withColumn("osv_id", F.when(F.col("seq") % 2 == 0, F.col("osv_id")).otherwise("  ")))
    .select("package_name", "vulnerability_count"))

query("a_3_conditional_counts", """
SELECT COUNT(*) AS packages, COUNT(*) FILTER (WHERE vulnerability_count > 0) AS vulnerable,
 COUNT(*) FILTER (WHERE is_unmaintained) AS unmaintained, COUNT(*) FILTER (WHERE has_high_severity_vulnerability) AS high FROM r""")(
    lambda t: t.risk.agg(_rows().alias("packages"), numbers.count_if(_count() > 0).alias("vulnerable"),
                         numbers.count_if(F.col("is_unmaintained")).alias("unmaintained"),
                         numbers.count_if(_high()).alias("high")))


def _spread(value):
    return [F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"),
            F.round(F.stddev_samp(value), 4).alias("deviation")]


query("a_4_spread", """
SELECT rank, round(AVG(stars), 4) AS mean, MIN(stars) AS low, MAX(stars) AS high, round(stddev_samp(stars), 4) AS deviation
FROM (SELECT rank, CASE WHEN stars > 0 THEN stars END AS stars FROM r) GROUP BY rank""")(
    lambda t: t.risk.groupBy("rank").agg(*_spread(numbers.positive(F.col("stars")))))


def _flag_with_nulls():
    return F.when(F.col("stars").isNotNull(), _high())


query("a_5_raw_flag_groups", """
SELECT CASE WHEN flag THEN 'High-Severity Vulnerable' ELSE 'No High-Severity Vulnerabilities' END AS status, packages
FROM (SELECT CASE WHEN stars IS NOT NULL THEN has_high_severity_vulnerability END AS flag, COUNT(*) AS packages FROM r GROUP BY 1)""")(
    lambda t: t.risk.groupBy(_flag_with_nulls().alias("_flag")).agg(_rows().alias("packages"))
    .select(labels.vulnerability_status(F.col("_flag")).alias("status"), "packages"))

query("a_6_label_groups", """
SELECT CASE WHEN has_high_severity_vulnerability THEN 'HIGH RISK' WHEN vulnerability_count > 0 THEN 'MEDIUM RISK'
 ELSE 'LOW RISK' END AS category, COUNT(*) AS packages, SUM(vulnerability_count)::BIGINT AS vulnerabilities FROM r GROUP BY 1""")(
    lambda t: t.risk.groupBy(labels.risk_category(_high(), _count()).alias("category")).agg(
        _rows().alias("packages"), F.sum(_count()).alias("vulnerabilities")))

query("a_7_rate", """
SELECT repository_status, round(100.0::DOUBLE * COUNT(*) FILTER (WHERE vulnerability_count > 0) / COUNT(*), 2) AS rate
FROM r GROUP BY repository_status""")(
    lambda t: t.risk.groupBy("repository_status").agg(
        F.round(F.avg(numbers.flag(_count() > 0)) * 100, 2).alias("rate")))

query("a_8_value_counts", """
SELECT repository_status AS value, COUNT(*) AS value_count, round(100.0::DOUBLE * COUNT(*) / (SELECT COUNT(*) FROM r), 1) AS percentage
FROM r WHERE repository_status IS NOT NULL GROUP BY 1""")(
    lambda t: value_counts(t.risk, ["repository_status"]).select("value", "value_count", "percentage"))

query("a_9_quartiles", """
SELECT has_repository, quantile_cont(stars::DOUBLE, 0.25) AS q1, quantile_cont(stars::DOUBLE, 0.5) AS median,
 quantile_cont(stars::DOUBLE, 0.75) AS q3 FROM r GROUP BY has_repository""")(
    lambda t: exact_quantiles(t.risk, ["has_repository"], "stars", QUARTILES))

query("a_10_group_means", """
SELECT has_high_severity_vulnerability AS high, round(AVG(COALESCE(stars, 0)), 4) AS avg_stars,
 round(AVG(days_since_last_release), 4) AS avg_days FROM r GROUP BY 1""")(
    lambda t: t.risk.groupBy(_high().alias("high")).agg(
        F.round(F.avg(numbers.number_or_zero(F.col("stars"))), 4).alias("avg_stars"),
        F.round(F.avg("days_since_last_release"), 4).alias("avg_days")))

query("a_11_correlation", """
SELECT round(corr(stars::DOUBLE, runtime_dependencies_count::DOUBLE), 6) AS correlation FROM rd""")(
    lambda t: t.risk_with_dependencies.agg(
        F.round(F.corr("stars", "runtime_dependencies_count"), 6).alias("correlation")))


def _outcomes(t):
    wanted = t.given("customer").select(F.lower("c_name").alias("package_name"), "c_custkey")
    stored = wanted.where("c_custkey % 4 = 0").select("package_name")
    fetched = wanted.where("c_custkey % 4 IN (1, 2)").select(
        "package_name", (F.col("c_custkey") % 4 == 1).alias("found"))
    return names.outcomes(wanted, stored, fetched, "package_name")


query("a_12_outcome_counts", """
SELECT CASE c_custkey % 4 WHEN 0 THEN 'skipped' WHEN 1 THEN 'success' WHEN 2 THEN 'not_found' ELSE 'failed' END AS outcome,
 COUNT(*) AS items FROM customer GROUP BY 1""")(_outcomes)

query("w_1_share_of_total", """
SELECT package_name, round(100.0::DOUBLE * dependents_count / NULLIF(SUM(dependents_count) OVER (), 0), 6) AS share
FROM r WHERE is_unmaintained AND vulnerability_count > 0""")(
    lambda t: (lambda chosen: chosen.select("package_name", numbers.percent(
        F.col("dependents_count"), chosen.agg(F.sum("dependents_count")).scalar(), 6).alias("share")))(
        t.risk.where("is_unmaintained AND vulnerability_count > 0")))

query("w_2_last_row_per_key", """
SELECT package_name, osv_id FROM v QUALIFY row_number() OVER (PARTITION BY package_name ORDER BY seq DESC) = 1""")(
    lambda t: last_per_key(t.flat, ["package_name"], "seq").select("package_name", "osv_id"))

query("w_3_first_row_per_key", "SELECT package_name, osv_id, severity_score FROM v")(
    lambda t: first_per_key(_repeated_flat(t).withColumn("package_name", normalize_name(F.col("package_name"))),
                            ["package_name", "osv_id"], "seq").select("package_name", "osv_id", "severity_score"))

query("w_3_first_values_per_id", """
SELECT package_name, ecosystem, osv_id, severity_score, COALESCE(severity_score >= 7, FALSE) AS is_high_severity FROM v""")(
    lambda t: one_row_per_id(_repeated_flat(t)).drop("published", "seq"))

query("w_4_numbered_batches", """
SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 + 1 AS batch_index, o_orderkey FROM orders""")(
    lambda t: numbered(t.given("orders").select("o_orderkey"), "o_orderkey").select(
        (F.floor((F.col("position") - 1) / fixed.BATCH_SIZE) + 1).alias("batch_index"), "o_orderkey"))

query("w_5_roc_points", """
SELECT score AS threshold, SUM(pos) OVER w / SUM(pos) OVER () AS tpr, SUM(neg) OVER w / SUM(neg) OVER () AS fpr
FROM (SELECT score, SUM(label)::DOUBLE AS pos, SUM(1 - label)::DOUBLE AS neg FROM judged GROUP BY score)
WINDOW w AS (ORDER BY score DESC)""")(lambda t: roc_points(judged(t)))

query("w_6_precision_recall_points", """
SELECT score AS threshold, SUM(pos) OVER w / (SUM(pos) OVER w + SUM(neg) OVER w) AS precision, SUM(pos) OVER w / SUM(pos) OVER () AS recall
FROM (SELECT score, SUM(label)::DOUBLE AS pos, SUM(1 - label)::DOUBLE AS neg FROM judged GROUP BY score)
WINDOW w AS (ORDER BY score DESC)""")(lambda t: precision_recall_points(judged(t)))

query("w_6_point_nearest_threshold", """
SELECT threshold, precision, recall FROM (SELECT score AS threshold, SUM(pos) OVER w / (SUM(pos) OVER w + SUM(neg) OVER w) AS precision,
 SUM(pos) OVER w / SUM(pos) OVER () AS recall FROM (SELECT score, SUM(label)::DOUBLE AS pos, SUM(1 - label)::DOUBLE AS neg
 FROM judged GROUP BY score) WINDOW w AS (ORDER BY score DESC)) ORDER BY abs(threshold - 0.05), threshold LIMIT 1""")(
    lambda t: threshold_point(judged(t), fixed.SAFETY_THRESHOLD))


def judged(t):
    """A score per package that any engine can compute, standing in for a model's probability."""
    stars = numbers.number_or_zero(F.col("stars"))
    return t.risk.select("package_name", _high().cast("int").alias("label"), (stars / (stars + 5000)).alias("score"))


query("t_1_top_by_three_keys", """
SELECT package_name, vulnerability_count, high_severity_count, max_severity_score FROM r
ORDER BY vulnerability_count DESC NULLS FIRST, high_severity_count DESC NULLS FIRST, max_severity_score DESC NULLS FIRST, package_name LIMIT 30""")(
    lambda t: t.risk.orderBy(_count().desc_nulls_first(), F.col("high_severity_count").desc_nulls_first(),
                             F.col("max_severity_score").desc_nulls_first(), "package_name").limit(30)
    .select("package_name", "vulnerability_count", "high_severity_count", "max_severity_score"))

query("t_2_custom_order", """
SELECT CASE WHEN has_high_severity_vulnerability THEN 'High-Severity Vulnerable' WHEN vulnerability_count > 0
 THEN 'Other Vulnerabilities' ELSE 'No Known Vulnerabilities' END AS category, COUNT(*) AS packages FROM r GROUP BY 1""")(
    lambda t: t.risk.groupBy(labels.vulnerability_category_ordinal(_high(), _count()).alias("_place"))
    .agg(_rows().alias("packages")).orderBy("_place")
    .select(numbers.label_at(F.col("_place"), fixed.VULNERABILITY_CATEGORIES).alias("category"), "packages"))

query("t_3_sorted_groups", "SELECT rank, COUNT(*) AS packages FROM r GROUP BY rank")(
    lambda t: t.risk.groupBy("rank").agg(_rows().alias("packages")).orderBy(F.col("packages").desc(), "rank"))

query("t_4_top_by_score", """
SELECT package_name, vulnerability_count, max_severity_score, stars, risk_score FROM sc
ORDER BY risk_score DESC, package_name LIMIT 10""")(lambda t: top_risks(t.scored))

query("t_5_seeded_sample", """
SELECT package_name, stars FROM r ORDER BY md5(concat(package_name, '|42')), package_name LIMIT 5""")(
    lambda t: t.risk.orderBy(F.md5(F.concat("package_name", F.lit(f"|{fixed.SEED}"))), "package_name").limit(5)
    .select("package_name", "stars"))

query("u_1_distinct_names", "SELECT DISTINCT lower(package_name) AS package_name FROM c WHERE trim(package_name) <> ''")(
    lambda t: names.name_list(t.candidates()))

query("u_2_distinct_union", """
SELECT concat(lower(c_name), CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '-top' END) AS package_name FROM customer UNION SELECT package_name FROM s""")(
    lambda t: distinct_union(names.name_list(t.top_names()), names.name_list(t.summary)))

query("u_3_union_all", """
SELECT 'v' AS table_name, COUNT(*) AS row_count FROM v UNION ALL SELECT 'p', COUNT(*) FROM p""")(
    lambda t: table_counts({"v": t.flat, "p": t.projects}))

query("j_3_pending_ids", """
SELECT osv_id FROM v WHERE seq % 3 <> 0""")(
    lambda t: exclude_known(t.flat.select("osv_id"), t.flat.where("seq % 3 = 0").select("osv_id"), ["osv_id"]))
