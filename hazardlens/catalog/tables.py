"""Domain tables derived from the given tables: orders stand for vulnerabilities, customers for packages."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens import fixed_values as fixed
from hazardlens import schemas
from hazardlens.functions.dates import utc, write_iso
from hazardlens.functions.severity import is_high
from hazardlens.plans.risk import risk_scores, risk_summary, with_dependencies
from hazardlens.plans.vulnerabilities import package_counts, package_summary
from hazardlens.sources.tables import written

AS_OF = "2001-12-31 12:00:00"


def _with_damaged(documents: DataFrame, every: int, damaged: Column) -> DataFrame:
    """All documents, and beside one in ``every`` a damaged copy."""
    texts = F.when(F.col("seq") % every == 0, F.array(F.col("document"), damaged)).otherwise(F.array("document"))
    return documents.withColumn("document", F.explode(texts))


class Tables:
    """The given tables of one folder and the domain tables built on them; all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.GIVEN[name]).parquet(f"{self.folder}/{name}.parquet")

    @property
    def as_of(self) -> Column:
        return utc(AS_OF)

    @cached_property
    def reports(self) -> DataFrame:
        """Every order as a vulnerability report with the customer's name."""
        customers = self.given("customer").select("c_custkey", "c_name")
        return self.given("orders").join(customers, F.expr("o_custkey = c_custkey")).select(
            "o_orderkey", "o_orderdate", "o_orderpriority", "c_name")

    @cached_property
    def flat(self) -> DataFrame:
        """Flat vulnerability rows, one per order."""
        rated = self.reports.selectExpr(
            "o_orderkey AS seq", "o_orderdate AS published", "lower(c_name) AS package_name",
            """CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM'
               WHEN '5-LOW' THEN 'LOW' ELSE if(o_orderkey % 10 = 0, 'MALWARE', 'UNKNOWN') END AS severity_type""",
            """CASE o_orderpriority WHEN '1-URGENT' THEN 9.5D WHEN '2-HIGH' THEN 8.0D WHEN '3-MEDIUM' THEN 5.5D
               WHEN '5-LOW' THEN 2.5D ELSE if(o_orderkey % 10 = 0, 10.0D, NULL) END AS severity_score""")
        return rated.select(
            F.expr("concat('OSV-', seq) AS osv_id"), "package_name", F.lit(fixed.ECOSYSTEM).alias("ecosystem"),
            "published", F.expr("published + make_dt_interval(seq % 30) AS modified"), "severity_type", "severity_score",
            is_high(F.col("severity_score")).alias("is_high_severity"),
            F.expr("severity_type = 'MALWARE' AS is_malware"), "seq")

    @cached_property
    def activity(self) -> DataFrame:
        """Orders and lines per customer. Lines are summed per order first, then per customer."""
        lines = self.given("lineitem").groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))
        orders = self.given("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return (orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left")
                .groupBy("o_custkey").agg(
                    F.count(F.lit(1)).alias("n_orders"),
                    F.coalesce(F.sum("lines"), F.lit(0)).alias("n_lines"),
                    F.sum("quantity").alias("quantity"),
                    F.max("o_orderdate").alias("last_order")))

    @cached_property
    def projects(self) -> DataFrame:
        """Project metadata, one row per customer. Every seventh name is one that no report knows."""
        customers = self.given("customer").selectExpr(
            "*", "CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 300 THEN 0L "
                 "ELSE floor(c_acctbal * c_acctbal / 2000) END AS stars")
        return customers.join(self.activity, F.expr("c_custkey = o_custkey"), "left").selectExpr(
            "if(c_custkey % 7 = 3, concat(c_name, '-Fork'), c_name) AS package_name", f"'{fixed.ECOSYSTEM}' AS platform",
            """concat('package "', c_name, '", ', lower(c_mktsegment)) AS description""",
            "CASE c_custkey % 3 WHEN 0 THEN 'JavaScript' WHEN 1 THEN 'TypeScript' END AS language",
            "stars", "floor(stars / 4) AS forks", "n_orders * 3 AS contributions_count",
            "n_lines AS dependent_repos_count", "quantity AS dependents_count", "CAST(c_nationkey AS BIGINT) AS rank",
            """CASE c_mktsegment WHEN 'FURNITURE' THEN 'Unmaintained' WHEN 'BUILDING' THEN 'Active'
               WHEN 'AUTOMOBILE' THEN 'Help Wanted' WHEN 'HOUSEHOLD' THEN 'Deprecated' END AS repository_status""",
            "if(c_custkey % 5 <> 0, concat('https://example.org/', lower(c_name)), NULL) AS repository_url",
            "if(c_custkey % 2 = 0, 'MIT', 'Apache-2.0') AS licenses",
            "if(c_custkey % 2 = 0, 'MIT;ISC', 'Apache-2.0') AS normalized_licenses",
            "if(c_custkey % 11 <> 0, concat(c_custkey % 9, '.', c_custkey % 13, '.0'), NULL) AS latest_release_number",
            "last_order AS latest_release_published_at", "n_orders AS versions_count", "c_custkey AS seq")

    @cached_property
    def dependencies(self) -> DataFrame:
        """Runtime dependency counts; every fourth name belongs to no project."""
        count = F.when(F.col("dependent_repos_count") > 0, F.col("dependent_repos_count") * 7 % 61).otherwise(0)
        return self.projects.select(
            F.expr("if(seq % 4 = 0, concat(package_name, '-Old'), package_name) AS package_name"),
            count.cast("long").alias("runtime_dependencies_count"))

    @cached_property
    def summary(self) -> DataFrame:
        return package_summary(self.flat)

    @cached_property
    def risk(self) -> DataFrame:
        return risk_summary(package_counts(self.flat), self.projects, self.as_of)

    @cached_property
    def risk_with_dependencies(self) -> DataFrame:
        """Projects and dependencies both come from the activity, so it is stored for them."""
        self.__dict__["activity"] = written(self.activity, "activity")
        return with_dependencies(self.risk, self.dependencies)

    @cached_property
    def scored(self) -> DataFrame:
        return risk_scores(self.risk)

    def messy_names(self) -> DataFrame:
        """Name cells with mixed case, white space of several kinds, blanks and NULLs."""
        key, name = F.col("c_custkey"), F.col("c_name")
        cell = (F.when(key % 6 == 0, F.concat(F.lit("\t "), F.upper(name), F.lit(" \n")))
                .when(key % 6 == 1, F.concat(F.lit("  "), name))
                .when(key % 6 == 2, F.lit(" \t"))
                .when(key % 6 == 3, F.lit(None))
                .when(key % 6 == 4, F.lit(""))
                .otherwise(name))
        return self.given("customer").select(key.alias("id"), cell.alias("cell"))

    def messy_numbers(self) -> DataFrame:
        """Number cells: whole, decimal, signed, with a tail, unreadable, blank, missing."""
        key = F.col("p_partkey")
        text = key.cast("string")
        cell = (F.when(key % 8 == 0, text)
                .when(key % 8 == 1, F.concat(text, F.lit(".75")))
                .when(key % 8 == 2, F.concat(F.lit("-"), text))
                .when(key % 8 == 3, F.concat(text, F.lit(" stars")))
                .when(key % 8 == 4, F.lit("n/a"))
                .when(key % 8 == 5, F.lit(""))
                .when(key % 8 == 6, F.concat(F.lit("  "), text))
                .otherwise(F.lit(None)))
        return self.given("part").select(key.alias("id"), cell.alias("cell"))

    def messy_flags(self) -> DataFrame:
        key = F.col("s_suppkey")
        cell = (F.when(key % 6 == 0, "true").when(key % 6 == 1, "True").when(key % 6 == 2, "false")
                .when(key % 6 == 3, "").when(key % 6 == 4, "yes"))
        return self.given("supplier").select(key.alias("id"), cell.alias("cell"))

    def raw_lines(self) -> DataFrame:
        """Lines of a raw package list: ``name - anything``, some blank."""
        line = F.when(F.col("p_partkey") % 50 == 0, F.lit(" - nothing")).otherwise(
            F.concat(F.lit(" "), F.upper("p_name"), F.lit("-"), (F.col("p_partkey") % 97).cast("string"),
                     F.lit(" - "), F.col("p_type"), F.lit(" - tail")))
        return self.given("part").select(line.alias("value"))

    def candidates(self) -> DataFrame:
        """Candidate packages for the negative sample: with repeats, other ecosystems, blank names."""
        customers = self.given("customer").select("c_custkey", "c_name")
        key = F.col("c_custkey")
        name = F.when(key % 40 == 0, F.lit(" ")).otherwise(F.upper("c_name"))
        copies = F.sequence(F.lit(1), (key % 3 + 1).cast("int"))
        return customers.select(
            name.alias("package_name"),
            F.when(key % 9 == 0, "PyPI").when(key % 9 == 1, " NPM ").when(key % 9 == 2, "")
            .when(key % 9 == 3, "  ").alias("ecosystem"),
            F.explode(copies).alias("copy"))

    def top_names(self) -> DataFrame:
        """A second list of names that overlaps the summary."""
        return self.given("customer").select(
            F.expr("concat(' ', upper(c_name), if(c_custkey % 3 = 0, '', '-TOP')) AS package_name"))

    def vulnerability_documents(self) -> DataFrame:
        """JSON texts of nested vulnerability documents that use every way of stating a severity."""
        key = F.col("o_orderkey")
        vector = F.parse_json(F.lit('"CVSS:3.1/AV:N/AC:L"'))

        def entry(kind: str | None, score: Column) -> Column:
            return F.struct(F.lit(kind).cast("string").alias("type"), score.alias("score"))

        severity = (F.when(key % 6 == 0, F.array(entry("CVSS_V3", vector)))
                    .when(key % 6 == 1, F.array(entry("CVSS_V3", vector), entry("CVSS_V2", F.parse_json(F.lit("7.0")))))
                    .when(key % 6 == 2, F.array(entry(None, F.parse_json(F.lit("4"))))))
        own_score = (F.when(key % 7 == 0, F.parse_json(F.lit("9.8"))).when(key % 7 == 1, F.parse_json(F.lit('"6.96"')))
                     .when(key % 7 == 2, F.parse_json(F.lit('"n/a"'))))
        label = (F.when(F.col("o_orderpriority") == "1-URGENT", "Critical")
                 .when(F.col("o_orderpriority") == "2-HIGH", "high")
                 .when(F.col("o_orderpriority") == "3-MEDIUM", "MODERATE")
                 .when(F.col("o_orderpriority") == "5-LOW", "Low"))
        own = F.struct(
            label.alias("severity"),
            F.when(own_score.isNotNull(), F.struct(own_score.alias("score"))).alias("cvss"),
            F.when(key % 11 == 0, F.parse_json(F.lit('[{"source":"scan"}]'))).alias("malicious_packages_origins"))

        def affected(name: Column, ecosystem: Column | str) -> Column:
            ecosystem = F.lit(ecosystem) if isinstance(ecosystem, str) else ecosystem
            return F.struct(F.struct(name.alias("name"), ecosystem.alias("ecosystem")).alias("package"))

        name = F.col("c_name")
        no_package = F.lit(None).cast("struct<package:struct<name:string,ecosystem:string>>")
        entries = F.concat(
            F.array(affected(F.concat(F.upper(name), F.lit(" ")), "npm")),
            F.when(key % 3 == 0, F.array(affected(name, "NPM"))).otherwise(F.array()),
            F.when(key % 4 == 0, F.array(affected(name, "PyPI"))).when(key % 4 == 1, F.array(affected(name, "Maven")))
            .otherwise(F.array()),
            F.when(key % 5 == 0, F.array(F.struct(no_package["package"].alias("package")))).otherwise(F.array()))
        document = F.to_json(F.struct(
            F.concat(F.when((key % 10 == 0) & (F.col("o_orderpriority") == "4-NOT SPECIFIED"), "MAL-")
                     .otherwise("OSV-"), key).alias("id"),
            write_iso(F.col("o_orderdate")).alias("published"),
            F.when(key % 2 == 0, write_iso(F.col("o_orderdate"))).alias("modified"),
            entries.alias("affected"), severity.alias("severity"), own.alias("database_specific")))
        return _with_damaged(self.reports.select(key.alias("seq"), document.alias("document")), 97,
                             F.substring("document", 1, 25))

    def project_documents(self) -> DataFrame:
        """JSON texts of project documents: name plus the document of that name."""
        p = self.projects
        versions = F.when(F.col("seq") % 6 != 0, F.transform(
            F.sequence(F.lit(1), F.col("versions_count").cast("int")),
            lambda n: F.struct(n.cast("string").alias("number"))))
        licenses = F.when(F.col("seq") % 2 == 0, F.parse_json(F.lit('["MIT","ISC"]'))).otherwise(
            F.parse_json(F.lit('"Apache-2.0"')))
        scalars = [name for name in fixed.PROJECT_COLUMNS
                   if name not in ("package_name", "platform", "normalized_licenses", "versions_count",
                                   "latest_release_published_at")]
        document = F.to_json(F.struct(
            F.when(F.col("seq") % 10 != 0, F.col("platform")).alias("platform"), *scalars,
            write_iso(F.col("latest_release_published_at")).alias("latest_release_published_at"),
            versions.alias("versions"), licenses.alias("normalized_licenses")))
        named = p.select("seq", F.concat(F.lit(" "), F.upper("package_name")).alias("package_name"),
                         document.alias("document"))
        return _with_damaged(named, 89, F.lit("{broken"))

    def dependency_documents(self) -> DataFrame:
        """JSON texts of dependency documents keyed by name and version; every third is about an old version."""
        kinds = F.transform(
            F.sequence(F.lit(1), (F.col("seq") % 12 + 1).cast("int")),
            lambda n: F.struct(F.when(n % 4 == 0, "development").when(n % 4 == 1, "runtime")
                               .when(n % 4 == 2, "").alias("kind")))
        with_list = F.to_json(F.struct(kinds.alias("dependencies")))
        text = F.when(F.col("seq") % 10 == 0, F.lit('{"dependencies":"none"}')).otherwise(with_list)
        return self.projects.select(
            F.lower("package_name").alias("package_name"),
            F.expr("concat(coalesce(latest_release_number, '0'), if(seq % 3 = 0, '-old', '')) AS version"),
            text.alias("document"))
