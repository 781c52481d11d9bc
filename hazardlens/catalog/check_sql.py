"""SQL of the derived tables, for the checks that run on another engine."""

from __future__ import annotations

import re

_TABLES = {
    "va": """
SELECT concat('OSV-', CAST(o.o_orderkey AS VARCHAR)) AS osv_id, lower(c.c_name) AS package_name, 'npm' AS ecosystem,
 o.o_orderdate AS published, o.o_orderdate + to_days(CAST(o.o_orderkey % 30 AS INT)) AS modified,
 CASE WHEN o.o_orderpriority='1-URGENT' THEN 'CRITICAL' WHEN o.o_orderpriority='2-HIGH' THEN 'HIGH'
      WHEN o.o_orderpriority='3-MEDIUM' THEN 'MEDIUM' WHEN o.o_orderpriority='5-LOW' THEN 'LOW'
      WHEN o.o_orderkey % 10 = 0 THEN 'MALWARE' ELSE 'UNKNOWN' END AS severity_type,
 CASE WHEN o.o_orderpriority='1-URGENT' THEN CAST(9.5 AS DOUBLE) WHEN o.o_orderpriority='2-HIGH' THEN CAST(8.0 AS DOUBLE)
      WHEN o.o_orderpriority='3-MEDIUM' THEN CAST(5.5 AS DOUBLE) WHEN o.o_orderpriority='5-LOW' THEN CAST(2.5 AS DOUBLE)
      WHEN o.o_orderkey % 10 = 0 THEN CAST(10.0 AS DOUBLE) END AS severity_score,
 o.o_orderkey AS seq, o.o_orderpriority AS priority, c.c_name AS c_name
FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey""",
    "v": "SELECT * FROM va",
    "p": """
SELECT CASE WHEN c.c_custkey % 7 = 3 THEN concat(c.c_name, '-Fork') ELSE c.c_name END AS package_name, 'npm' AS platform,
 concat('package "', c.c_name, '", ', lower(c.c_mktsegment)) AS description,
 CASE c.c_custkey % 3 WHEN 0 THEN 'JavaScript' WHEN 1 THEN 'TypeScript' END AS language,
 CASE WHEN c.c_acctbal < 0 THEN NULL WHEN c.c_acctbal < 300 THEN 0
      ELSE CAST(FLOOR(c.c_acctbal*c.c_acctbal/2000) AS BIGINT) END AS stars,
 CAST(FLOOR(CASE WHEN c.c_acctbal < 0 THEN NULL WHEN c.c_acctbal < 300 THEN 0
      ELSE FLOOR(c.c_acctbal*c.c_acctbal/2000) END / 4) AS BIGINT) AS forks,
 a.n_orders * 3 AS contributions_count, a.n_lines AS dependent_repos_count, a.qty AS dependents_count,
 CAST(c.c_nationkey AS BIGINT) AS rank,
 CASE c.c_mktsegment WHEN 'FURNITURE' THEN 'Unmaintained' WHEN 'BUILDING' THEN 'Active'
      WHEN 'AUTOMOBILE' THEN 'Help Wanted' WHEN 'HOUSEHOLD' THEN 'Deprecated' END AS repository_status,
 CASE WHEN c.c_custkey % 5 <> 0 THEN concat('https://example.org/', lower(c.c_name)) END AS repository_url,
 CASE WHEN c.c_custkey % 2 = 0 THEN 'MIT' ELSE 'Apache-2.0' END AS licenses,
 CASE WHEN c.c_custkey % 2 = 0 THEN 'MIT;ISC' ELSE 'Apache-2.0' END AS normalized_licenses,
 CASE WHEN c.c_custkey % 11 <> 0 THEN concat(c.c_custkey % 9, '.', c.c_custkey % 13, '.0') END AS latest_release_number,
 a.last_rel AS latest_release_published_at, a.n_orders AS versions_count, c.c_custkey AS seq
FROM customer c LEFT JOIN (
  SELECT o.o_custkey, COUNT(DISTINCT o.o_orderkey) AS n_orders, COUNT(l.l_orderkey) AS n_lines,
         CAST(SUM(l.l_quantity) AS BIGINT) AS qty, MAX(o.o_orderdate) AS last_rel
  FROM orders o LEFT JOIN lineitem l ON l.l_orderkey=o.o_orderkey GROUP BY o.o_custkey) a ON a.o_custkey=c.c_custkey""",
    "d": """
SELECT CASE WHEN seq % 4 = 0 THEN concat(package_name, '-Old') ELSE package_name END AS package_name,
 CASE WHEN dependent_repos_count > 0 THEN dependent_repos_count * 7 % 61 ELSE 0 END AS runtime_dependencies_count FROM p""",
    "s": """
SELECT package_name, ecosystem, COUNT(DISTINCT osv_id) AS vulnerability_count,
 COUNT(*) FILTER (WHERE severity_score >= 7.0) AS high_severity_count, MAX(severity_score) AS max_severity_score,
 MAX(published) AS latest_vulnerability_published_at,
 COALESCE(BOOL_OR(severity_score >= 7.0), FALSE) AS has_high_severity_vulnerability,
 array_to_string(list_sort(list(DISTINCT osv_id)), '|') AS osv_ids
FROM v GROUP BY package_name, ecosystem""",
    "r": """
SELECT COALESCE(p.package_name, s.package_name) AS package_name, 'npm' AS ecosystem, p.stars, p.forks,
 p.contributions_count, p.dependent_repos_count, p.dependents_count, p.rank, p.repository_status,
 p.latest_release_published_at, p.versions_count,
 CASE WHEN p.latest_release_published_at <= TIMESTAMP '2001-12-31 12:00:00'
      THEN CAST(FLOOR((epoch(TIMESTAMP '2001-12-31 12:00:00') - epoch(p.latest_release_published_at)) / 86400) AS BIGINT)
      END AS days_since_last_release,
 COALESCE(length(trim(p.repository_url)) > 0, FALSE) AS has_repository,
 COALESCE(lower(p.repository_status) = 'unmaintained', FALSE) AS is_unmaintained,
 COALESCE(s.vulnerability_count, 0) AS vulnerability_count, COALESCE(s.high_severity_count, 0) AS high_severity_count,
 s.max_severity_score, COALESCE(s.high_severity_count, 0) > 0 AS has_high_severity_vulnerability
FROM s FULL OUTER JOIN p ON s.package_name = lower(p.package_name)""",
    "rd": """
SELECT r.*, d.runtime_dependencies_count FROM r LEFT JOIN d ON lower(d.package_name) = lower(r.package_name)""",
    "sc": """
SELECT r.* REPLACE (COALESCE(r.stars, 0) AS stars, COALESCE(r.max_severity_score, 0) AS max_severity_score),
 round(r.vulnerability_count * COALESCE(r.max_severity_score, 0) * ln(COALESCE(r.stars, 0) + 1), 2) AS risk_score FROM r""",
    "docs": """
SELECT seq, published, c_name, priority,
 concat(CASE WHEN seq % 10 = 0 AND priority = '4-NOT SPECIFIED' THEN 'MAL-' ELSE 'OSV-' END, CAST(seq AS VARCHAR)) AS id,
 CASE WHEN seq % 7 = 0 THEN 'CVSS_V3' WHEN seq % 7 = 1 THEN 'CVSS_V3'
      WHEN seq % 6 = 1 THEN 'CVSS_V2' WHEN seq % 6 = 2 THEN 'CVSS'
      WHEN priority = '1-URGENT' THEN 'CRITICAL' WHEN priority = '2-HIGH' THEN 'HIGH'
      WHEN priority = '3-MEDIUM' THEN 'MODERATE' WHEN priority = '5-LOW' THEN 'LOW'
      WHEN seq % 10 = 0 OR seq % 11 = 0 THEN 'MALWARE' ELSE 'UNKNOWN' END AS severity_type,
 CAST(CASE WHEN seq % 7 = 0 THEN 9.8 WHEN seq % 7 = 1 THEN 6.96
      WHEN seq % 6 = 1 THEN 7.0 WHEN seq % 6 = 2 THEN 4.0
      WHEN priority = '1-URGENT' THEN 9.5 WHEN priority = '2-HIGH' THEN 8.0
      WHEN priority = '3-MEDIUM' THEN 5.5 WHEN priority = '5-LOW' THEN 2.5
      WHEN seq % 10 = 0 OR seq % 11 = 0 THEN 10.0 END AS DOUBLE) AS score
FROM va""",
    "f": """
SELECT id AS osv_id, lower(c_name) AS package_name, 'npm' AS ecosystem, strftime(published, '%Y-%m-%dT%H:%M:%S.%gZ') AS published,
 CASE WHEN seq % 2 = 0 THEN strftime(published, '%Y-%m-%dT%H:%M:%S.%gZ') END AS modified,
 severity_type, round(score, 1) AS severity_score, COALESCE(score >= 7.0, FALSE) AS is_high_severity,
 severity_type = 'MALWARE' AS is_malware
FROM docs, range(2) AS copies(n) WHERE n = 0 OR seq % 3 = 0""",
    "c": """
SELECT CASE WHEN c_custkey % 40 = 0 THEN ' ' ELSE upper(c_name) END AS package_name,
 CASE c_custkey % 9 WHEN 0 THEN 'PyPI' WHEN 1 THEN ' NPM ' WHEN 2 THEN '' WHEN 3 THEN '  ' END AS ecosystem
FROM customer, range(1, 4) AS copies(n) WHERE n <= c_custkey % 3 + 1""",
    "names": """
SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN concat(chr(9), ' ', upper(c_name), ' ', chr(10))
 WHEN 1 THEN concat('  ', c_name) WHEN 2 THEN concat(' ', chr(9)) WHEN 3 THEN NULL WHEN 4 THEN '' ELSE c_name END AS cell
FROM customer""",
    "numbers": """
SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN concat(p_partkey, '.75')
 WHEN 2 THEN concat('-', p_partkey) WHEN 3 THEN concat(p_partkey, ' stars') WHEN 4 THEN 'n/a' WHEN 5 THEN ''
 WHEN 6 THEN concat('  ', p_partkey) END AS cell FROM part""",
    "flags": """
SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'True' WHEN 2 THEN 'false' WHEN 3 THEN ''
 WHEN 4 THEN 'yes' END AS cell FROM supplier""",
    "raw_lines": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN ' - nothing' ELSE concat(' ', upper(p_name), '-', p_partkey % 97,
 ' - ', p_type, ' - tail') END AS line FROM part""",
    "features": """
SELECT package_name, CAST(stars AS DOUBLE) AS stars, CAST(forks AS DOUBLE) AS forks,
 CAST(contributions_count AS DOUBLE) AS contributions_count, CAST(dependent_repos_count AS DOUBLE) AS dependent_repos_count,
 CAST(dependents_count AS DOUBLE) AS dependents_count, CAST(rank AS DOUBLE) AS rank, CAST(versions_count AS DOUBLE) AS versions_count,
 CAST(days_since_last_release AS DOUBLE) AS days_since_last_release, COALESCE(NULLIF(repository_status, ''), 'Unknown') AS repository_status,
 CAST(has_repository AS INT) AS has_repository, CAST(is_unmaintained AS INT) AS is_unmaintained,
 CAST(has_high_severity_vulnerability AS INT) AS label FROM r""",
    "judged": """
SELECT package_name, CAST(has_high_severity_vulnerability AS INT) AS label,
 CAST(COALESCE(stars, 0) AS DOUBLE) / (COALESCE(stars, 0) + 5000) AS score FROM r""",
}


def _needed(sql: str) -> set[str]:
    words = set(re.findall(r"(?:FROM|JOIN|,)\s+([a-z_]+)\b", sql, flags=re.IGNORECASE)) & set(_TABLES)
    for word in list(words):
        words |= _needed(_TABLES[word])
    return words


def with_tables(sql: str) -> str:
    """The statement with the derived tables it names put in front."""
    needed = _needed(sql)
    tables = ", ".join(f"{name} AS MATERIALIZED ({_TABLES[name].strip()})" for name in _TABLES if name in needed)
    if not tables:
        return sql.strip()
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {tables}, {body[5:]}"
    return f"WITH {tables} {body}"
