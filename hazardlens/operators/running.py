"""Running totals over a global order without a one-partition window.

Rows are sorted by range over all tasks, once. Each task adds up inside its own range while the sorted rows pass through
it, and what it stores says which range a row is in. The totals of the ranges, a few numbers per task, give
each range its starting value. So one shuffle serves any number of totals, and no task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hazardlens.sources.tables import written


def _summing(within: tuple[str, ...], sources: list[str], names: list[str]):
    """Adds the number of the task's range and running totals inside it, per run of equal ``within``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, np.zeros(len(sources), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = [batch.column(c) for c in within]
            new = np.zeros(batch.num_rows, bool)
            for label in labels:
                new[1:] |= np.asarray(pc.not_equal(label[1:], label[:-1]))
            first = tuple(label[0].as_py() for label in labels)
            new[0] = first != last
            start = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), 0))
            columns = []
            for place, source in enumerate(sources):
                sums = np.cumsum(np.asarray(pc.fill_null(batch.column(source).cast(pa.int64()), 0)))
                total = sums - np.concatenate(([0], sums))[start]
                if not new[0]:
                    total[start == 0] += carried[place]
                columns.append(total)
            last, carried = tuple(label[-1].as_py() for label in labels), np.array([c[-1] for c in columns], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int64)), *map(pa.array, columns)],
                names=[*batch.schema.names, "_range", *names])

    return run


def running_totals(rows: DataFrame, order_by: str | list[str], totals: dict[str, str], within: tuple[str, ...] = (),
                   descending: bool = False, wholes: dict[str, str] | None = None) -> DataFrame:
    """Add, for each ``new name: column``, the sum of the whole-number column up to and including the row.

    ``order_by`` must be unique inside ``within``; the ``within`` columns must be few-valued labels and must not be
    NULL. ``wholes`` adds, under a new name, the sum over all rows of a column of ``totals``. The sorted
    rows are stored when this is called.
    """
    wholes = wholes or {}
    order = [order_by] if isinstance(order_by, str) else order_by
    keys = [*[F.col(c).asc() for c in within], *[F.col(c).desc() if descending else F.col(c).asc() for c in order]]
    inside = [f"_{name}" for name in totals]
    schema = StructType([*rows.schema, *[StructField(c, LongType()) for c in ("_range", *inside)]])
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(
        _summing(tuple(within), list(totals.values()), inside), schema), "running-totals")
    # One line per label and range, so no more than labels and tasks together.
    lines = placed.groupBy(*within, "_range").agg(
        *[F.sum(source).alias(c) for c, source in zip(inside, totals.values(), strict=True)])
    starts, before = [], {}
    for line in sorted(lines.collect(), key=lambda line: line["_range"]):
        label = tuple(line[c] for c in within)
        so_far = before.setdefault(label, [0] * len(inside))
        starts.append((label, line["_range"], list(so_far)))
        before[label] = [a + (line[c] or 0) for a, c in zip(so_far, inside, strict=True)]
    place_of = {source: place for place, source in enumerate(totals.values())}
    table = [(*label, part, *so_far, *[before[label][place_of[source]] for source in wholes.values()])
             for label, part, so_far in starts]
    start_schema = StructType([*[rows.schema[c] for c in within], StructField("_range", LongType()),
                               *[StructField(f"_start{c}", LongType()) for c in inside],
                               *[StructField(c, LongType()) for c in wholes]])
    joined = placed.join(F.broadcast(rows.sparkSession.createDataFrame(table, start_schema)), [*within, "_range"])
    return joined.select(*rows.columns, *[(F.col(f"_start{c}") + F.col(c)).alias(name) for name, c in zip(totals, inside, strict=True)],
                         *wholes)


def alphabetical(values: DataFrame, column: str, name: str) -> DataFrame:
    """Zero-based place of each distinct value of a text column, as a stored table."""
    distinct = values.select(column).distinct().withColumn("_one", F.lit(1).cast("long"))
    return written(running_totals(distinct, column, {name: "_one"}).select(
        column, (F.col(name) - 1).alias(name)), "numbers")


def numbered(rows: DataFrame, order_by: str | list[str], name: str = "position") -> DataFrame:
    """1-based position of each row by a unique column or unique columns."""
    return running_totals(rows.withColumn("_one", F.lit(1).cast("long")), order_by, {name: "_one"}).drop("_one")
