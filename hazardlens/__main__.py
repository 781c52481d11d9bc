"""The jobs as commands: ``spark-submit … -m hazardlens`` or ``python -m hazardlens COMMAND INPUT… [--out PATH]``."""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hazardlens import fixed_values as fixed
from hazardlens import schemas
from hazardlens.functions.dates import utc
from hazardlens.functions.numbers import truth
from hazardlens.functions.text import normalize_name
from hazardlens.learning import features, metrics, scoring, training
from hazardlens.plans import names, profile, projects, quality, questions, vulnerabilities, warehouse
from hazardlens.plans.risk import findings, risk_scores, risk_summary, top_risks, with_dependencies
from hazardlens.session import build_session, scratch_scope
from hazardlens.sources import csv_files, documents
from hazardlens.sources.tables import append_new, written

SCORED = f"{schemas.RISK_SUMMARY}, risk_score double"
QUESTIONS = [
    questions.dataset_totals, questions.stars_by_status, questions.dependencies_by_status,
    questions.top_by_vulnerability_count, questions.repository_status_distribution, questions.release_recency,
    questions.top_by_severity, questions.statistics_by_stars, questions.statistics_by_dependencies,
    questions.top_unmaintained,
]
PROFILES = [
    profile.missing, profile.missing_totals, profile.text_value_counts, profile.class_distribution, profile.status_counts,
    profile.days_histogram, profile.stars_box, profile.dependencies_box, profile.count_by_maintenance_box,
    profile.severity_box, profile.stars_and_dependencies, profile.stars_dependencies_correlation,
    profile.high_rate_by_stars, profile.top_by_count, profile.stars_and_versions,
]


class Run:
    """One command with its inputs; ``seq`` columns follow the order of files and of the lines in them.

    With ``--tables parquet`` tables between commands are Parquet; with ``--no-line-breaks`` CSV files, known to
    have no line break inside a cell, are read in splits.
    """

    def __init__(self, spark: SparkSession, options: argparse.Namespace):
        self.spark, self.inputs, self.options = spark, options.inputs, options

    def table(self, place: int, schema: str) -> DataFrame:
        if self.options.tables == "parquet":
            found = self.spark.read.parquet(self.inputs[place])
            kinds = StructType.fromDDL(schema)
            wanted = [F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name)
                      for f in kinds.fields]
            return found.select(*wanted, csv_files.place().alias("seq"))
        return csv_files.read_typed(self.spark, self.inputs[place], schema, self.options.line_breaks, with_seq=True)

    def by_header(self, place: int, with_seq: bool = False) -> DataFrame:
        if self.options.tables == "parquet":
            found = self.spark.read.parquet(self.inputs[place])
            columns = found.columns
            if with_seq:
                found, columns = found.select("*", csv_files.place().alias("seq")), [*columns, "seq"]
            return csv_files.as_cells(found, columns)
        return csv_files.read_by_header(self.spark, self.inputs[place], self.options.line_breaks, with_seq)

    def write(self, rows: DataFrame, columns: list[str], folder: str | None = None) -> None:
        out = folder or self.options.out
        if self.options.tables == "parquet":
            rows.select(*columns).write.mode("overwrite").parquet(out)
        else:
            csv_files.write_cells(rows, out, columns, "overwrite")

    def results(self, named: dict[str, DataFrame]) -> None:
        """Each table whole below the output folder, if there is one, and its first rows on the screen."""
        for name, rows in named.items():
            if self.options.out:
                self.write(rows, rows.columns, f"{self.options.out}/{name}")
            rows.show(truncate=False)

    def clean_list(self) -> None:
        self.write(names.clean_raw_list(self.spark.read.text(self.inputs[0])), ["package_name"])

    def merge_lists(self) -> None:
        self.write(names.merge_lists(self.by_header(0), self.by_header(1)), ["package_name"])

    def list_from_summary(self) -> None:
        self.write(names.name_list(self.by_header(0)), ["package_name"])

    def request_batches(self) -> None:
        """Batches follow the order of the files' names and of the lines in them, however Spark packs the files."""
        names.request_batches(self.by_header(0, with_seq=True)).write.mode("overwrite").json(self.options.out)

    def project_table(self) -> None:
        """With --append the table is Parquet and only packages that it lacks are added."""
        found = documents.read_named(self.spark, self.inputs[0], schemas.PROJECT_DOCUMENT)
        rows = projects.project_rows(documents.readable(found))
        if self.options.append:
            append_new(written(rows.select(*fixed.PROJECT_COLUMNS), "projects"), self.options.out, ["package_name"])
        else:
            self.write(rows, fixed.PROJECT_COLUMNS)

    def dependency_table(self) -> None:
        """Inputs: projects CSV, folder of documents named ``package@version.json`` with ``/`` as %2F.

        Spark passes over files whose name starts with an underscore, so scoped names keep their @.
        """
        found = documents.read_named(self.spark, self.inputs[1], schemas.DEPENDENCY_DOCUMENT)
        package, version = (F.regexp_extract("package_name", "^(.+)@([^@]+)$", place) for place in (1, 2))
        named = documents.readable(found).select(
            package.alias("package_name"), version.alias("version"), "dependencies")
        self.write(projects.dependency_rows(self.table(0, schemas.PROJECTS), named), fixed.DEPENDENCY_COLUMNS)

    def flatten(self) -> None:
        found = documents.read_folder(self.spark, self.inputs[0], schemas.VULNERABILITY_DOCUMENT)
        self.write(vulnerabilities.flatten(documents.readable(found)), fixed.FLAT_COLUMNS)

    def package_summary(self) -> None:
        self.write(vulnerabilities.package_summary(self.table(0, schemas.VULNERABILITIES)), fixed.SUMMARY_COLUMNS)

    def risk_summary(self) -> None:
        as_of = utc(self.options.as_of or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
        risk = risk_summary(self.table(0, schemas.PACKAGE_SUMMARY), self.table(1, schemas.PROJECTS), as_of)
        self.write(risk, fixed.RISK_COLUMNS)

    def negative_sample(self) -> None:
        candidates = self.table(0, schemas.CANDIDATES)
        summary = self.table(1, schemas.PACKAGE_SUMMARY)
        self.write(names.negative_sample(candidates, summary), ["package_name", "ecosystem"])
        names.negative_sample_counts(candidates, summary).show(truncate=False)

    def risk_scores(self) -> None:
        scored = risk_scores(self.table(0, schemas.RISK_SUMMARY))
        self.write(scored.orderBy(F.col("risk_score").desc(), "package_name"), [*fixed.RISK_COLUMNS, "risk_score"])
        top_risks(scored).show(truncate=False)

    def findings(self) -> None:
        findings(self.table(0, SCORED)).show(vertical=True, truncate=False)

    def check_summary(self) -> None:
        summary = self.by_header(0)
        for check in (quality.blank_counts, quality.inconsistency_report, quality.distribution):
            check(summary).show(truncate=False)

    def load(self) -> None:
        kinds = [schemas.VULNERABILITIES, schemas.PROJECTS, schemas.PACKAGE_SUMMARY, schemas.RISK_SUMMARY]
        loaded = {name: self.table(place, kinds[place]) for place, name in enumerate(warehouse.COLUMNS)}
        warehouse.load(loaded, self.options.out)
        warehouse.counts(self.spark, self.options.out).show(truncate=False)
        warehouse.breaches(self.spark, self.options.out).where("breaches > 0").show(100, truncate=False)

    def questions(self) -> None:
        """Inputs: the risk table and, for the two questions about them, the dependencies CSV."""
        risk = self.spark.read.parquet(self.inputs[0])
        dependencies = (self.table(1, schemas.DEPENDENCIES) if len(self.inputs) > 1
                        else self.spark.createDataFrame([], schemas.DEPENDENCIES))
        risk = with_dependencies(risk, dependencies)
        self.results({question.__name__: question(risk) for question in QUESTIONS})

    def csv_to_json(self) -> None:
        csv_files.csv_to_json(self.spark, self.inputs[0], self.options.out, self.options.line_breaks)

    def train(self) -> None:
        """Input: risk or scored table. The model goes to the output folder, its report below it."""
        table = training.training_table(self.table(0, schemas.RISK_SUMMARY))
        best, _ = training.tune_best(table, self.options.models)
        scoring.save_model(best.model, self.options.out)
        features.split_report(table).show()
        report = scoring.model_report(best, table)
        self.write(report, report.columns, f"{self.options.out}/report")
        report.show(truncate=False)

    def predict(self) -> None:
        """Inputs: model folder, risk CSV."""
        model = scoring.load_model(self.spark, self.inputs[0])
        found = scoring.predict(model, self.table(1, schemas.RISK_SUMMARY), self.options.threshold)
        self.write(found, found.columns)
        scoring.prediction_summary(found).show(truncate=False)

    def what_if(self) -> None:
        """Inputs: model folder, risk table. Every package once per vulnerability count of the grid."""
        model = scoring.load_model(self.spark, self.inputs[0])
        found = scoring.what_if(model, self.table(1, schemas.RISK_SUMMARY), self.options.threshold)
        self.write(found, found.columns)
        found.show(truncate=False)

    def diagnostics(self) -> None:
        """Inputs: model folder, risk table. Curves, and figures at the model's and at the safety threshold."""
        model = scoring.load_model(self.spark, self.inputs[0])
        table = training.training_table(self.table(1, schemas.RISK_SUMMARY))
        scored = written(training.score(model, table.where("part = 'test'")).select("label", "score"), "test-scores")
        safe = metrics.with_prediction(scored, fixed.SAFETY_THRESHOLD)
        self.results({
            "roc_curve": metrics.roc_curve(scored), "precision_recall_curve": metrics.precision_recall_curve(scored),
            "auc": metrics.roc_auc(scored), "quality": metrics.quality(metrics.with_prediction(scored, model.threshold)),
            "quality_at_safety_threshold": metrics.quality(safe), "classes_at_safety_threshold": metrics.class_report(safe)})

    def profiles(self) -> None:
        """Inputs: risk table and, for the dependency counts, the dependencies table."""
        risk = self.table(0, schemas.RISK_SUMMARY).drop("seq")
        dependencies = (self.table(1, schemas.DEPENDENCIES) if len(self.inputs) > 1
                        else self.spark.createDataFrame([], schemas.DEPENDENCIES))
        risk = written(with_dependencies(risk, dependencies), "risk")
        self.results({job.__name__: job(risk) for job in PROFILES} | {
            "top_by_risk": profile.top_by_risk(risk_scores(risk))})

    def pending_work(self) -> None:
        """Inputs: wanted names, table of what is stored. The names that are still to be fetched."""
        wanted, stored = (self.by_header(place).select(normalize_name(F.col("package_name")).alias("package_name"))
                          for place in (0, 1))
        self.write(names.pending(wanted, stored, ["package_name"]), ["package_name"])

    def outcomes(self) -> None:
        """Inputs: wanted names, table of what was stored, answers (package_name, found). Items per outcome."""
        wanted, stored, fetched = (self.by_header(place) for place in range(3))
        fetched = fetched.select("package_name", truth(F.col("found")).alias("found"))
        self.results({"outcomes": names.outcomes(wanted, stored, fetched, "package_name")})


COMMANDS = [name for name, member in vars(Run).items()
            if callable(member) and name not in ("__init__", "table", "by_header", "write", "results")]


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="hazardlens", description=__doc__)
    parser.add_argument("command", choices=[name.replace("_", "-") for name in COMMANDS])
    parser.add_argument("inputs", nargs="+", help="input files or folders, in the order of the job's arguments")
    parser.add_argument("--out", help="output folder")
    parser.add_argument("--as-of", help="time that ages are counted to, UTC; default now")
    parser.add_argument("--threshold", type=float, help="score that counts as vulnerable; default the model's own")
    parser.add_argument("--tables", choices=["csv", "parquet"], default="csv", help="format of tables between commands")
    parser.add_argument("--no-line-breaks", dest="line_breaks", action="store_false",
                        help="no CSV cell holds a line break, so files can be read in splits")
    parser.add_argument("--append", action="store_true", help="add new packages to the project table")
    parser.add_argument("--models", nargs="*", choices=list(training.CANDIDATES), help="kinds of model to try")
    options = parser.parse_args(arguments)
    session = spark or build_session()
    with scratch_scope(session):
        getattr(Run(session, options), options.command.replace("-", "_"))()


if __name__ == "__main__":
    main()
