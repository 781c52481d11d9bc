"""Incremental take-in."""

from pyspark.sql import functions as F

from hazardlens.catalog.registry import query
from hazardlens.functions.dates import write_iso
from hazardlens.session import new_folder
from hazardlens.streaming.arrivals import stored_rows, take_in, unreadable_texts


def _taken_in(t):
    """Two arrivals, the second with documents that were there before, and a third call with nothing new."""
    inbox, table, checkpoint = (new_folder(t.spark, label) for label in ("inbox", "arrived", "progress"))
    texts = t.vulnerability_documents()
    for part in (texts.where("seq % 2 = 0"), texts, None):
        if part is not None:
            part.select("document").write.mode("append").text(inbox)
        take_in(t.spark, inbox, table, checkpoint)
    return table


query("st_1_arrivals", "SELECT * FROM f")(lambda t: stored_rows(t.spark, _taken_in(t)).drop("batch").withColumns(
    {name: write_iso(F.col(name)) for name in ("published", "modified")}))

query("st_1_unreadable_arrivals", """
SELECT 1 AS arrival, COUNT(*) AS texts FROM va WHERE seq % 97 = 0 AND seq % 2 = 0 UNION ALL
SELECT 2, COUNT(*) FROM va WHERE seq % 97 = 0""")(
    lambda t: unreadable_texts(t.spark, _taken_in(t)).groupBy((F.col("batch") + 1).cast("int").alias("arrival")).agg(
        F.count(F.lit(1)).alias("texts")))
