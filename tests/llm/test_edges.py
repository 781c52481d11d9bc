"""Column names that clash, column arguments, storage of files, sizes of batches and of reading tasks."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardlens.llm import decision_list, files, fuzzy_lines, jaccard, katz, mixing, scratch, secret_scan, warc, winnowing
from hazardlens.operators import keys

CLASHING = ["gone_id", "gone_key", "gone_lines", "Mix_Source", "mix_source_key", "mix_rate", "text_class", "hit_id", "id", "n"]


@pytest.fixture(scope="module")
def clashing(documents):
    """Columns named as those that operators join on; all hold 7."""
    return documents.drop("n_words", "key", "node").withColumns({c: F.lit(7) for c in CLASHING})


def extras(rows) -> set:
    return {r[c] for r in rows for c in CLASHING}


def plain(frame, columns) -> list:
    return sorted(map(str, frame.select(*columns).collect()))


def test_clashing_names_in_line_dedup(documents, clashing):
    done = fuzzy_lines.without_repeated_lines(clashing.withColumn("lines_removed", F.lit(-1)))
    assert set(done.columns) == {*clashing.columns, "lines_removed"} and extras(done.collect()) == {7}
    columns = ["doc_id", "text", "lines_removed"]
    assert plain(done, columns) == plain(fuzzy_lines.without_repeated_lines(documents), columns)


def test_clashing_names_in_mixes(documents, clashing):
    columns = ["doc_id", *mixing.ADDED]
    done = mixing.with_copies(clashing.withColumn("mix_size", F.lit(-1)))
    assert extras(done.collect()) == {7} and plain(done, columns) == plain(mixing.with_copies(documents), columns)
    copies = mixing.mixed(clashing.withColumn("copy", F.lit(-1)))
    assert copies.columns == [*clashing.columns, "copy"] and extras(copies.collect()) == {7}
    assert plain(copies, ["doc_id", "copy"]) == plain(mixing.mixed(documents), ["doc_id", "copy"])
    with pytest.raises(ValueError):
        mixing.with_copies(documents.withColumnRenamed("source", "mix_size"), source_column="mix_size")


def test_clashing_names_and_arguments_in_filters(spark, documents, clashing):
    items = spark.createDataFrame([("x", " ".join(documents.where("doc_id = 3").first()["text"].split()[:12]))],
                                  "item_id string, text string")
    want = plain(winnowing.clean_documents(documents, items), ["doc_id"])
    assert len(want) < documents.count()
    done = winnowing.clean_documents(clashing, items)
    assert plain(done, ["doc_id"]) == want and extras(done.collect()) == {7} and done.columns == clashing.columns
    other = clashing.withColumnsRenamed({"text": "body", "doc_id": "k"})
    assert plain(winnowing.clean_documents(other, items, text_column="body").withColumnRenamed("k", "doc_id"), ["doc_id"]) == want
    one = jaccard.one_of_each_group(other, id_column="k", text_column="body")
    assert extras(one.collect()) == {7} and plain(one.withColumnRenamed("k", "doc_id"), ["doc_id"]) == plain(
        jaccard.one_of_each_group(documents), ["doc_id"])


def test_files_have_full_paths(spark, tmp_path):
    assert files.full_path(spark, str(tmp_path)).startswith("file:/")
    store, name = files.open_store(files.full_path(spark, f"{tmp_path}/a b"))
    store.create_dir(name)
    assert (tmp_path / "a b").is_dir()
    assert files.task_uri("s3a://bucket/a b/c") == "s3://bucket/a%20b/c" and files.task_uri("hdfs://h:8020/a") == "hdfs://h:8020/a"


def test_archives_are_read_by_bytes_and_records(spark, tmp_path, monkeypatch):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    index = warc.write_archives(pages, str(tmp_path / "archives"))
    assert all(r["file"].startswith("file:/") for r in index.collect())
    monkeypatch.setattr(warc, "TASK_RECORDS", 100)
    rows = warc.read_records(index)
    parts = rows.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(parts) >= 5 and max(p["count"] for p in parts) <= 200 and rows.count() == 600
    monkeypatch.setattr(warc, "TASK_RECORDS", 10 ** 6)
    monkeypatch.setattr(warc, "TASK_BYTES", 20_000)
    assert warc.read_records(index).withColumn("part", F.spark_partition_id()).select("part").distinct().count() > 3


def test_archives_of_text_ids(spark):
    ids = ["None", None, "", "a>b\r\nc: d", "é"]
    pages = spark.createDataFrame([(i, "u", f"page {k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    pages = pages.unionByName(pages.withColumn("html", F.lit("same")))
    rows = warc.read_records(warc.write_archives(pages)).collect()
    assert {(r["page_id"], r["payload"]) for r in rows if r["record_type"] == "response"} == {
        *((i, f"page {k}") for k, i in enumerate(ids)), ("é", "same")}
    assert {(r["page_id"], r["refers_to"]) for r in rows if r["record_type"] == "revisit"} == {(i, "é") for i in ids[:4]}


def test_katz_in_a_folder_without_scheme(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(katz, "new_folder", lambda session, label: f"{tmp_path}/{label} x")
    assert katz.katz_scores(documents, F.lit(False)).count() == documents.count()
    assert any((tmp_path / "katz x").iterdir())


def test_batches_are_bounded_by_bytes(spark):
    rows = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    rows = rows.unionByName(spark.range(1).select(F.repeat(F.lit("y"), 12 << 20).alias("text")))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    found = scratch.stored(rows.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    assert sum(r["n"] for r in found) == 4001
    assert all(r["bytes"] < (9 << 20) or r["n"] == 1 for r in found)


@pytest.mark.parametrize("limit", [100_000, 1])
def test_values_that_many_rows_hold(spark, monkeypatch, limit):
    """A copied example on most rows, with owners looked up whole and in two parts."""
    monkeypatch.setattr(keys, "BROADCAST_ROWS", limit)
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"),
        F.when(F.col("id") < 500, F.lit("token=abcdefgh")).otherwise(F.concat(F.lit("token=own"), F.col("id"))).alias("text"))
    rows = secret_scan.secret_scan(docs).collect()
    assert len(rows) == 600
    assert all((r["n_examples"], r["n_live"]) == ((1, 0) if r["id"] < 500 else (0, 1)) for r in rows)


def test_rules_of_the_given_labels_reject(spark):
    """The list learned from the given labels is not empty and rejects most bad held-out rows that the base rules keep."""
    folder = "/root/testdata/sf0.1"
    documents, labels = (scratch.table(spark, folder, name) for name in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rules = decision_list.fit_rules(documents, labels.where(~held))
    assert rules
    judged = decision_list.judged(documents, ["doc_id"], rules).join(
        labels.where(held), F.col("c0") == F.col("doc_id")).where("not base_failed")
    bad = judged.where("quality = 0").agg(F.count("*"), F.count_if(~F.col("kept"))).first()
    assert bad[0] == 0 or bad[1] > 0.5 * bad[0], bad
