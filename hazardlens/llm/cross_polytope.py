"""Nearest neighbours by cosine through cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a Hadamard transform; a unit vector is hashed to the signed
axis that it is nearest to after ``depth`` of them, one after another, which name a cell. Every distinct vector is
in one cell of each of ``TABLES`` tables. A query looks into the cells whose axes are nearest to it; how many of
them per table is fitted once, on a bounded sample, to a recall. All vectors of those cells are ranked exactly.

Work is dealt by cell, and a cell of many vectors in parts of bounded size, each of which meets the queries of
the cell. Equal vectors are one entry with their smallest ids, so copies cost nothing and no cell has a cap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FloatType

from hazardlens.llm.scratch import stored
from hazardlens.llm.vectors import matrix, of_usual_width, usable
from hazardlens.llm.words import mix, salt, signed

TABLES = 4
#: Vectors that one part of a cell holds on average, at most.
PART_ROWS = 4096
#: A further hash is added once cells would hold more vectors than this on average.
CELL_ROWS = 65_536
#: Numbers in the sample that the probes are fitted on, and its queries.
SAMPLE_VALUES, SAMPLE_ROWS, SAMPLE_QUERIES = 1 << 21, 16_384, 256
RECALL = 0.97
#: Most cells of a table; beyond that no further hash is added.
MOST_CELLS = 1 << 16
#: Queries that a task ranks at a time, and numbers in the arrays it makes for that.
QUERY_ROWS, WORK_VALUES = 1024, 1 << 21


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that squares neither overflow nor vanish."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, the same wherever the pair is met."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1)) / np.sqrt((b * b).sum(axis=1))


def _hadamard(x: np.ndarray) -> np.ndarray:
    rows, n = x.shape
    step = 1
    while step < n:
        pairs = x.reshape(rows, n // (2 * step), 2, step)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, n)
        step *= 2
    return x / np.sqrt(n)


@dataclass(frozen=True)
class Hashing:
    """Shape of the index: vector width, tables, hashes per table and probes of a query per table."""

    width: int
    depth: int = 1
    probes: int = 1
    tables: int = TABLES

    @property
    def padded(self) -> int:
        return 1 << max(self.width - 1, 0).bit_length()

    @property
    def cells(self) -> int:
        """Cells of one table."""
        return (2 * self.padded) ** self.depth

    def axes(self, units: np.ndarray, number: int) -> np.ndarray:
        """Coordinates along all signed axes after one pseudo-rotation."""
        x = np.zeros((len(units), self.padded))
        x[:, :self.width] = units
        for turn in range(3):
            bits = mix(np.arange(self.padded, dtype=np.uint64) + salt(3 * number + turn)) >> np.uint64(63)
            x = _hadamard(x * np.where(bits == 1, 1.0, -1.0))
        return np.concatenate((x, -x), axis=1)

    def home(self, units: np.ndarray) -> np.ndarray:
        """The cell of each row in each table."""
        out = np.zeros((len(units), self.tables), np.int64)
        for t in range(self.tables):
            for d in range(self.depth):
                out[:, t] = out[:, t] * 2 * self.padded + self.axes(units, t * self.depth + d).argmax(axis=1)
        return out + np.arange(self.tables) * self.cells

    def nearness(self, units: np.ndarray, table: int) -> np.ndarray:
        """How near each row is to every cell of a table: the sum of its coordinates along the cell's axes."""
        total = np.zeros((len(units), 1))
        for d in range(self.depth):
            axes = self.axes(units, table * self.depth + d)
            total = (total[:, :, None] + axes[:, None, :]).reshape(len(units), -1)
        return total

    def probed(self, units: np.ndarray) -> np.ndarray:
        """The cells that each row looks into as a query."""
        found = []
        for t in range(self.tables):
            near = self.nearness(units, t)
            best = np.argpartition(-near, min(self.probes, self.cells) - 1, axis=1)[:, :self.probes]
            found.append(best + t * self.cells)
        return np.concatenate(found, axis=1)


def fitted_hashing(sample: np.ndarray, rows: int, neighbours: int, recall: float = RECALL) -> Hashing:
    """Fewest probes at which the sample's first rows find ``recall`` of their nearest among the sample.

    In a sample the nearest are farther away than in the whole, and so harder to find. All cells always do.
    """
    shape = Hashing(sample.shape[1])
    while rows > CELL_ROWS * shape.cells and 2 * shape.padded * shape.cells <= MOST_CELLS:
        shape = Hashing(shape.width, shape.depth + 1)
    units = unit_rows(sample)
    asked = units[:SAMPLE_QUERIES]
    near = asked @ units.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    take = min(neighbours, len(units) - 1)
    if take < 1:
        return shape
    true = np.argpartition(-near, take - 1, axis=1)[:, :take]
    home = shape.home(units) - np.arange(shape.tables) * shape.cells
    # The place of a neighbour's cell in the query's own order of cells; its best table counts.
    place = np.full(true.shape, shape.cells)
    for t in range(shape.tables):
        score = shape.nearness(asked, t)
        of_cell = np.take_along_axis(score, home[true, t], axis=1)
        ordered = np.sort(score, axis=1)
        for i in range(len(asked)):
            place[i] = np.minimum(place[i], shape.cells - np.searchsorted(ordered[i], of_cell[i], "left"))
    needed = np.sort(place.ravel())
    probes = int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1])
    return Hashing(shape.width, shape.depth, probes)


def _digests(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for the values of each row; -0.0 counts as 0.0."""
    bits = mix(np.ascontiguousarray(x + 0.0).view(np.uint64))
    at = np.arange(x.shape[1], dtype=np.uint64)
    return tuple(mix(mix(bits + mix(at + salt(k))).sum(axis=1, dtype=np.uint64)) for k in (101, 102))


def _numbers(element: DataType) -> type:
    """Floats are kept in four bytes, other numbers as doubles."""
    return np.float32 if isinstance(element, FloatType) else np.float64


def _vectors(column: pa.Array, kind: type) -> np.ndarray:
    rows = column.to_pylist()
    data = np.frombuffer(b"".join(rows), kind).astype(np.float64)
    return data.reshape(len(rows), -1) if rows else data.reshape(0, 0)


def _entries(embeddings: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, hi, lo, vector) of the rows that take part; hi and lo are the digest of the vector."""
    used = embeddings.where(usable(vector_column) & F.col(id_column).isNotNull()
                            & F.exists(vector_column, lambda c: c != 0))
    rows = of_usual_width(used.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")), "v")
    kind = rows.schema["id"].dataType.simpleString()
    stored_as = _numbers(rows.schema["v"].dataType.elementType)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), np.float64) + 0.0
            hi, lo = _digests(x) if len(x) else (np.empty(0, np.uint64),) * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(signed(hi)), pa.array(signed(lo)), pa.array([r.tobytes() for r in x.astype(stored_as)], pa.binary())],
                names=["id", "hi", "lo", "vector"])

    return stored(rows.mapInArrow(describe, f"id {kind}, hi bigint, lo bigint, vector binary"), "vectors")


def _hashed(classes: DataFrame, shape: Hashing, numbers: type) -> DataFrame:
    """Adds home, the cell in each table, and for queries probes."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in classes.schema]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, WORK_VALUES // max(shape.cells, shape.padded))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            units = unit_rows(_vectors(batch.column("vector"), numbers))
            asked = np.asarray(batch.column("asked"))
            probes = shape.probed(units[asked]) if asked.any() else np.empty((0, shape.tables * shape.probes), np.int64)
            ends = np.cumsum(asked * probes.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns,
                 pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * shape.tables, pa.int32()),
                                          pa.array(shape.home(units).ravel())),
                 pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(probes.ravel()))],
                names=[*batch.schema.names, "home", "probes"])

    return classes.mapInArrow(work, ", ".join([*fields, "home array<bigint>", "probes array<bigint>"]))


class _Ranker:
    """Ranks the queries of one part of a cell against its vectors, and keeps the best of each query."""

    def __init__(self, numbers: type, most: int):
        self.numbers, self.most = numbers, most
        self.found: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def rank(self, index: list[pa.RecordBatch], queries: pa.RecordBatch) -> None:
        held = pa.Table.from_batches(index).combine_chunks()
        vectors, low = (_vectors(held.column("vector"), self.numbers), np.asarray(held.column("low")))
        keys = [np.asarray(held.column(k)) for k in ("hi", "lo")]
        units = unit_rows(vectors)
        asked = _vectors(queries.column("vector"), self.numbers)
        near = unit_rows(asked) @ units.T
        take = min(self.most, len(units))
        # Everything that rounding could place among the best is ranked by the exact figures.
        edge = -np.partition(-near, take - 1, axis=1)[:, take - 1]
        row, col = np.nonzero(near >= edge[:, None] - 1e-9)
        hi, lo = (np.asarray(queries.column(k)) for k in ("hi", "lo"))
        step = max(1, WORK_VALUES // vectors.shape[1])
        for i in range(0, len(row), step):
            r, c = row[i:i + step], col[i:i + step]
            self._keep(hi[r], lo[r], keys[0][c], keys[1][c], low[c], cosines(asked[r], vectors[c]))

    def _keep(self, *columns: np.ndarray) -> None:
        self.found.append(self._best(columns))
        self.size += len(self.found[-1][0])
        if self.size > 1 << 18:
            self.found = [self._best(tuple(np.concatenate(c) for c in zip(*self.found, strict=True)))]
            self.size = len(self.found[0][0])

    def _best(self, columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        hi, lo, other_hi, other_lo, low, score = columns
        order = np.lexsort((other_lo, other_hi, low, -score, lo, hi))
        hi, lo, other_hi, other_lo, low, score = columns = tuple(c[order] for c in columns)
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        again = np.zeros(len(hi), bool)
        again[1:] = ~new[1:] & (other_hi[1:] == other_hi[:-1]) & (other_lo[1:] == other_lo[:-1])
        columns, new = tuple(c[~again] for c in columns), new[~again]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        keep = np.arange(len(new)) - first < self.most
        return tuple(c[keep] for c in columns)

    def results(self) -> tuple[np.ndarray, ...] | None:
        return self._best(tuple(np.concatenate(c) for c in zip(*self.found, strict=True))) if self.found else None


def nearest(embeddings: DataFrame, queries: Column, neighbours: int = 5, id_column: str = "vec_id",
            vector_column: str = "embedding", hashing: Hashing | None = None) -> DataFrame:
    """(query_id, rank, id, score): the nearest found for each row for which ``queries`` (of the id column) holds.

    Nearest first, equal cosines by smaller id; fewer rows where there are fewer candidates. Vectors that are null,
    empty, zero or hold null or non-finite entries take no part, nor do rows without an id and, where vectors
    differ in length, those of another length than the most frequent one. Rows that repeat an id and a vector
    count once; an id with several vectors is a query for each, and none of them is its own candidate. An empty
    table gives an empty result. The probes are fitted on a sample of at most ``SAMPLE_ROWS`` rows unless
    ``hashing`` is given; the index holds every row.
    """
    entries = _entries(embeddings, id_column, vector_column)
    numbers = _numbers(embeddings.schema[vector_column].dataType.elementType)
    id_kind = entries.schema["id"].dataType.simpleString()
    key = ["hi", "lo"]
    members = stored(entries.select("id", *key).distinct(), "members")
    asked = stored(members.withColumnRenamed("id", id_column).where(queries).withColumnRenamed(id_column, "id"), "asked")
    first = members.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy("id"))).where(
        F.col("place") <= neighbours + 1)
    ids = first.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    vectors = entries.groupBy(*key).agg(F.first("vector").alias("vector"))
    flagged = asked.select(*key).distinct().withColumn("asked", F.lit(True))
    classes = stored(vectors.join(ids, key).join(flagged, key, "left").withColumn("asked", F.coalesce("asked", F.lit(False))),
                     "distinct-vectors")

    if hashing is None:
        head = classes.select(F.octet_length("vector").alias("bytes")).first()
        width = head["bytes"] // np.dtype(numbers).itemsize if head else 1
        rows = min(SAMPLE_ROWS, max(SAMPLE_VALUES // width, SAMPLE_QUERIES))
        sample = classes.orderBy(*key).limit(rows).select("vector").collect()
        hashing = fitted_hashing(_vectors(pa.array([r[0] for r in sample], pa.binary()), numbers).reshape(len(sample), width), classes.count(), neighbours)
    shape, most = hashing, neighbours + 1

    hashed = stored(_hashed(classes.select(*key, F.col("ids")[0].alias("low"), "vector", "asked"), shape, numbers), "hashed")
    large = (hashed.select(F.explode("home").alias("cell")).groupBy("cell").count().where(F.col("count") > PART_ROWS)
             .select("cell", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts")))
    index = hashed.select(F.explode("home").alias("cell"), F.lit(0).alias("side"), *key, "low", "vector").join(
        large, "cell", "left").withColumn("part", F.pmod("lo", F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    searches = (hashed.where("asked").select(F.explode("probes").alias("cell"), F.lit(1).alias("side"), *key, "low", "vector")
                .join(large, "cell", "left")
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts"))
    dealt = index.unionByName(searches).repartition("cell", "part").sortWithinPartitions("cell", "part", "side")

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker, held, at = _Ranker(numbers, most), [], None
        for batch in batches:
            cell, part, side = (np.asarray(batch.column(c)) for c in ("cell", "part", "side"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(side) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if at != (cell[a], part[a]):
                    at, held = (cell[a], part[a]), []
                if side[a] == 0:
                    held.append(batch.slice(a, b - a))
                elif held:
                    for i in range(a, b, QUERY_ROWS):
                        ranker.rank(held, batch.slice(i, min(QUERY_ROWS, b - i)))
        found = ranker.results()
        if found:
            for i in range(0, len(found[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + (1 << 16)]) for c in found], names=names)

    names = ["hi", "lo", "other_hi", "other_lo", "low", "score"]
    found = dealt.mapInArrow(
        rank, f"hi bigint, lo bigint, other_hi bigint, other_lo bigint, low {id_kind}, score double")
    # A pair met in several tables has one place.
    place = F.dense_rank().over(W.partitionBy(*key).orderBy(F.desc("score"), "low", "other_hi", "other_lo"))
    best = found.withColumn("place", place).where(F.col("place") <= most).select(*key, "other_hi", "other_lo", "score").distinct()
    named = best.join(classes.select(F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo"), "ids"), ["other_hi", "other_lo"])
    lists = named.groupBy(*key).agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "ids")).alias("found"))
    pairs = F.flatten(F.transform("found", lambda c: F.transform(c["ids"], lambda i: F.struct(
        c["far"].alias("far"), i.alias("other")))))
    ranked = asked.join(lists, key).withColumn("pairs", F.slice(F.sort_array(
        F.filter(pairs, lambda p: p["other"] != F.col("id"))), 1, neighbours))
    return ranked.select(F.col("id").alias("query_id"), F.posexplode("pairs")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("col")["other"].cast(id_kind).alias(id_column),
        (-F.col("col")["far"]).alias("score"))
