import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hazardlens import schemas
from hazardlens.plans.vulnerabilities import flatten, package_counts, package_ids, package_summary
from hazardlens.sources.documents import parse_column, readable, unreadable
from tests.conftest import rows


def document(osv_id="OSV-1", affected=None, **fields):
    entry = {"package": {"name": "Lib", "ecosystem": "npm"}}
    return {"id": osv_id, "published": "2020-01-01T00:00:00Z", "affected": [entry] if affected is None else affected,
            **fields}


def flat_of(spark, *documents):
    texts = [(text if isinstance(text, str) else json.dumps(text),) for text in documents]
    return flatten(readable(parse_column(spark.createDataFrame(texts, "document string"), "document",
                                         schemas.VULNERABILITY_DOCUMENT)))


VECTOR = "CVSS:3.1/AV:N/AC:L"


@pytest.mark.parametrize("fields, score, kind", [
    ({"database_specific": {"cvss": {"score": 9.84}}}, 9.8, "CVSS_V3"),
    ({"database_specific": {"cvss": {"score": "7.5"}, "severity": "LOW"}}, 7.5, "CVSS_V3"),
    ({"database_specific": {"cvss": {"score": 0}, "severity": "HIGH"}}, 0.0, "CVSS_V3"),
    ({"database_specific": {"cvss": {"score": "bad"}, "severity": "high"}}, 8.0, "HIGH"),
    ({"database_specific": {"cvss": {"score": None}, "severity": "moderate"}}, 5.5, "MODERATE"),
    ({"severity": [{"type": "CVSS_V3", "score": VECTOR}, {"type": "X", "score": 4}]}, 4.0, "X"),
    ({"severity": [{"score": 6.5}]}, 6.5, "CVSS"),
    ({"severity": [{"type": "CVSS_V3", "score": "6.5"}]}, None, "UNKNOWN"),
    ({"severity": [{"type": "CVSS_V3", "score": VECTOR}], "database_specific": {"severity": "Critical"}}, 9.5, "CRITICAL"),
    ({"severity": {"type": "not a list"}, "database_specific": {"severity": "low"}}, 2.5, "LOW"),
    ({"osv_id": "MAL-2020-1"}, 10.0, "MALWARE"),
    ({"osv_id": "MAL-2020-1", "database_specific": {"severity": "LOW"}}, 2.5, "LOW"),
    ({"database_specific": {"malicious_packages_origins": [{"source": "x"}]}}, 10.0, "MALWARE"),
    ({"database_specific": {"malicious_packages_origins": []}}, 10.0, "MALWARE"),
    ({"database_specific": {"malicious_packages_origins": None}}, None, "UNKNOWN"),
    ({"database_specific": None}, None, "UNKNOWN"),
    ({}, None, "UNKNOWN"),
])
def test_severity_ladder(spark, fields, score, kind):
    row = flat_of(spark, document(**fields)).first()
    assert (row["severity_score"], row["severity_type"]) == (score, kind)
    assert row["is_malware"] is (kind == "MALWARE")


def test_high_is_decided_before_rounding(spark):
    row = flat_of(spark, document(database_specific={"cvss": {"score": 6.96}})).first()
    assert (row["severity_score"], row["is_high_severity"]) == (7.0, False)
    assert flat_of(spark, document(database_specific={"cvss": {"score": 7.0}})).first()["is_high_severity"] is True


def test_entries(spark):
    affected = [{"package": {"name": " Lib\t", "ecosystem": "NPM"}}, {"package": {"name": "lib", "ecosystem": "npm"}},
                {"package": {"name": "other", "ecosystem": "PyPI"}}, {"ranges": []}, {"package": {"ecosystem": "npm"}}]
    flat = flat_of(spark, document(affected=affected), document("OSV-2", affected=[]), {"id": "OSV-3"}, "{broken")
    cut = json.dumps(document("OSV-4"))[:-3]
    parsed = parse_column(spark.createDataFrame([(cut,)], "document string"), "document", schemas.VULNERABILITY_DOCUMENT)
    assert flatten(parsed).count() == 0
    assert rows(flat, "osv_id", "package_name") == [("OSV-1", ""), ("OSV-1", "lib"), ("OSV-1", "lib")]
    assert flat.first()["published"] == dt.datetime(2020, 1, 1)
    assert flat.first()["modified"] is None


def test_unreadable_documents_are_kept_aside(spark):
    texts = spark.createDataFrame([("{broken",), ('{"id":"a","severity":5}',)], "document string")
    parsed = parse_column(texts, "document", schemas.VULNERABILITY_DOCUMENT)
    assert [row["_corrupt_record"] for row in unreadable(parsed).collect()] == ["{broken"]
    assert [row["id"] for row in readable(parsed).collect()] == ["a"]


FLAT = ("osv_id string, package_name string, ecosystem string, published timestamp_ntz, severity_score double, "
        "is_high_severity boolean, seq long")


def flat_rows(spark):
    day = dt.datetime
    return spark.createDataFrame([
        ("A", "lib", "npm", day(2020, 1, 1), 5.0, False, 1),
        ("A", " LIB ", "", day(2024, 1, 1), 9.0, True, 2),
        ("B", "lib", "NPM", day(2021, 1, 1), 8.0, True, 3),
        (" ", "lib", "npm", day(2025, 1, 1), 9.9, True, 4),
        (None, "blank", "npm", day(2020, 1, 1), 9.9, True, 5),
        ("C", "  ", "npm", day(2020, 1, 1), 9.9, True, 6),
        ("A", "lib", "pypi", None, None, False, 7),
    ], FLAT)


def test_package_summary(spark):
    assert rows(package_summary(flat_rows(spark))) == [
        ("blank", "npm", 0, 0, None, None, False, ""),
        ("lib", "npm", 2, 1, 8.0, dt.datetime(2021, 1, 1), True, "A|B"),
        ("lib", "pypi", 1, 0, None, None, False, "A"),
    ]


def test_counts_agree_with_summary(spark):
    flat = flat_rows(spark)
    assert rows(package_counts(flat).drop("seq")) == rows(package_summary(flat).drop("osv_ids"))


def test_hot_package_keeps_its_whole_list(spark):
    flat = spark.range(30_000).select(
        F.concat(F.lit("ID-"), "id").alias("osv_id"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("package_name"),
        F.lit("npm").alias("ecosystem"), F.lit(None).cast("timestamp_ntz").alias("published"),
        F.lit(8.0).alias("severity_score"), F.lit(True).alias("is_high_severity"), F.col("id").alias("seq"))
    summary = {row["package_name"]: row for row in package_summary(flat).collect()}
    hot = [f"ID-{n}" for n in range(30_000) if n % 10 < 9]
    assert summary["hot"]["vulnerability_count"] == 27_000 and summary["hot"]["osv_ids"].split("|") == sorted(hot)
    assert len(summary["cold"]["osv_ids"].split("|")) == 3000
    assert sorted(row["osv_id"] for row in package_ids(flat).where("package_name = 'hot'").collect()) == sorted(hot)
