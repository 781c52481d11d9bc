"""Declared schemas of every dataset as DDL text; nothing is inferred."""

from __future__ import annotations

VULNERABILITIES = (
    "osv_id string, package_name string, ecosystem string, published timestamp_ntz, modified timestamp_ntz, "
    "severity_type string, severity_score double, is_high_severity boolean, is_malware boolean")

PROJECTS = (
    "package_name string, platform string, description string, language string, stars bigint, forks bigint, "
    "contributions_count bigint, dependent_repos_count bigint, dependents_count bigint, rank bigint, "
    "repository_status string, repository_url string, licenses string, normalized_licenses string, "
    "latest_release_number string, latest_release_published_at timestamp_ntz, versions_count bigint")

DEPENDENCIES = (
    "package_name string, platform string, runtime_dependencies_count bigint, dependents_count bigint, "
    "dependent_repos_count bigint, score double, latest_release_number string, "
    "latest_release_published_at timestamp_ntz, versions_count bigint")

PACKAGE_SUMMARY = (
    "package_name string, ecosystem string, vulnerability_count bigint, high_severity_count bigint, "
    "max_severity_score double, latest_vulnerability_published_at timestamp_ntz, "
    "has_high_severity_vulnerability boolean, osv_ids string")

RISK_SUMMARY = (
    "package_name string, ecosystem string, stars bigint, forks bigint, contributions_count bigint, "
    "dependent_repos_count bigint, dependents_count bigint, rank bigint, repository_status string, "
    "latest_release_published_at timestamp_ntz, versions_count bigint, days_since_last_release bigint, "
    "has_repository boolean, is_unmaintained boolean, vulnerability_count bigint, high_severity_count bigint, "
    "max_severity_score double, has_high_severity_vulnerability boolean")

PACKAGE_NAMES = "package_name string"
CANDIDATES = "package_name string, ecosystem string"

# The given tables.
GIVEN = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Documents. Fields that may be text or number stay VARIANT.
VULNERABILITY_DOCUMENT = (
    "id string, published string, modified string, "
    "affected array<struct<package:struct<name:string,ecosystem:string>>>, "
    "severity array<struct<type:string,score:variant>>, "
    "database_specific struct<severity:string,cvss:struct<score:variant>,malicious_packages_origins:variant>")

PROJECT_DOCUMENT = (
    "platform string, description string, language string, stars bigint, forks bigint, contributions_count bigint, "
    "dependent_repos_count bigint, dependents_count bigint, rank bigint, repository_status string, "
    "repository_url string, licenses string, normalized_licenses variant, latest_release_number string, "
    "latest_release_published_at string, versions array<variant>")

DEPENDENCY_DOCUMENT = "dependencies array<struct<kind:string>>"

# Table contracts: columns that must be filled, and the key that must be unique.
CONTRACTS = {
    "raw_osv_vulnerabilities": (["osv_id", "package_name", "ecosystem"], None),
    "raw_librariesio_projects": (["package_name"], None),
    "package_vulnerability_summary": (["package_name", "ecosystem"], ["package_name", "ecosystem"]),
    "extracted_package_risk_summary": (["package_name", "ecosystem"], ["package_name", "ecosystem"]),
}

# Values a load puts where the file has none.
LOAD_DEFAULTS = {
    "raw_osv_vulnerabilities": {"is_high_severity": False, "is_malware": False},
    "raw_librariesio_projects": {
        "stars": 0, "forks": 0, "contributions_count": 0, "dependent_repos_count": 0, "dependents_count": 0,
        "rank": 0, "versions_count": 0},
    "package_vulnerability_summary": {
        "vulnerability_count": 0, "high_severity_count": 0, "has_high_severity_vulnerability": False},
    "extracted_package_risk_summary": {
        "has_repository": False, "is_unmaintained": False, "vulnerability_count": 0, "high_severity_count": 0,
        "has_high_severity_vulnerability": False},
}
