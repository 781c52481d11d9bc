"""Labels, scores, limits and column orders that results must carry exactly."""

ECOSYSTEM = "npm"
UNKNOWN = "Unknown"

# Severity label -> score.
SEVERITY_SCORES = {
    "CRITICAL": 9.5,
    "HIGH": 8.0,
    "MODERATE": 5.5,
    "MEDIUM": 5.5,
    "LOW": 2.5,
    "MALWARE": 10.0,
}
HIGH_SEVERITY_FROM = 7.0
MALWARE_ID_PREFIX = "MAL-"

# Two-way and three-way status labels.
HIGH_STATUS = "High-Severity Vulnerable"
NOT_HIGH_STATUS = "No High-Severity Vulnerabilities"
VULNERABILITY_CATEGORIES = ["High-Severity Vulnerable", "Other Vulnerabilities", "No Known Vulnerabilities"]
RISK_CATEGORIES = ["HIGH RISK", "MEDIUM RISK", "LOW RISK"]
RISK_ASSESSMENTS = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "MINIMAL"]
MANY_DEPENDENTS_OVER = 100

# Severity category: lowest score -> label.
SEVERITY_CATEGORIES = [(9.0, "CRITICAL"), (7.0, "HIGH"), (4.0, "MEDIUM")]
LOWEST_SEVERITY_CATEGORY = "LOW"

# Buckets: label, highest value inside. The first bucket also takes NULL; the last one is open.
STAR_BUCKETS = [
    ("0 stars", 0),
    ("1-100 stars", 100),
    ("101-500 stars", 500),
    ("501-1K stars", 1000),
    ("1K-5K stars", 5000),
    ("5K-10K stars", 10000),
    ("10K+ stars", None),
]
DEPENDENCY_BUCKETS = [
    ("0 dependencies", 0),
    ("1-5 dependencies", 5),
    ("6-10 dependencies", 10),
    ("11-20 dependencies", 20),
    ("21-50 dependencies", 50),
    ("50+ dependencies", None),
]
# Chart bins over stars: label, highest value inside.
STAR_BINS = [
    ("<100", 99),
    ("100-999", 999),
    ("1K-9.9K", 9999),
    ("10K-99.9K", 99999),
    ("100K+", None),
]

# Sizes of the top lists and of a request batch.
TOP_BY_COUNT = 20
TOP_BY_SEVERITY = 25
TOP_UNMAINTAINED = 30
TOP_CHART_BY_COUNT = 15
TOP_BY_RISK = 10
BATCH_SIZE = 100
HISTOGRAM_BINS = 50

# Column orders.
FLAT_COLUMNS = [
    "osv_id", "package_name", "ecosystem", "published", "modified",
    "severity_type", "severity_score", "is_high_severity", "is_malware",
]
PROJECT_COLUMNS = [
    "package_name", "platform", "description", "language", "stars", "forks", "contributions_count",
    "dependent_repos_count", "dependents_count", "rank", "repository_status", "repository_url", "licenses",
    "normalized_licenses", "latest_release_number", "latest_release_published_at", "versions_count",
]
DEPENDENCY_COLUMNS = [
    "package_name", "platform", "runtime_dependencies_count", "dependents_count", "dependent_repos_count",
    "score", "latest_release_number", "latest_release_published_at", "versions_count",
]
SUMMARY_COLUMNS = [
    "package_name", "ecosystem", "vulnerability_count", "high_severity_count", "max_severity_score",
    "latest_vulnerability_published_at", "has_high_severity_vulnerability", "osv_ids",
]
RISK_COLUMNS = [
    "package_name", "ecosystem", "stars", "forks", "contributions_count", "dependent_repos_count",
    "dependents_count", "rank", "repository_status", "latest_release_published_at", "versions_count",
    "days_since_last_release", "has_repository", "is_unmaintained", "vulnerability_count",
    "high_severity_count", "max_severity_score", "has_high_severity_vulnerability",
]

# Model inputs.
NUMERIC_FEATURES = [
    "stars", "forks", "contributions_count", "dependent_repos_count", "dependents_count", "rank",
    "versions_count", "days_since_last_release",
]
CATEGORY_FEATURE = "repository_status"
BOOLEAN_FEATURES = ["has_repository", "is_unmaintained"]
TARGET = "has_high_severity_vulnerability"
TEST_SHARE = 0.2
SEED = 42
FOLDS = 5
THRESHOLD_STEPS = 100
SAFETY_THRESHOLD = 0.05
POSITIVE_LABEL = "High-Severity Vulnerability"
NEGATIVE_LABEL = "No Vulnerability"
