"""A random forest whose trees are grown in parts and kept as a table, as trees of full depth grow with the rows.

The nodes with more than ``PART_ROWS`` rows, few per tree, are split level by level: blocks of rows count, and the best
split of a node comes from the added counts. Every node that is left after that is a part: its rows go to one group,
which grows the subtree below it. A row that is scored goes to the part that it reaches in each tree.

As in Spark's forest, a split asks whether a feature is at most one of up to ``max_bins`` - 1 thresholds, a node is shown
the rounded-up root of the number of features, rows count as often as a Poisson draw of mean 1 says, and the probability
is the mean over trees of the weighted share of a leaf. All draws are hashes, and weights are whole multiples of a small
unit, so that sums, and with them the trees, are the same in any order of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasProbabilityCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.sources.tables import written

#: Rows of a part, and rows that a task holds while it deals them out.
PART_ROWS = 1 << 16
BLOCK_ROWS = 1 << 17
#: Rows that thresholds are taken from: those with the smallest hashes.
THRESHOLD_ROWS = 10_000
#: Weights are multiples of this; gains below it are rounding.
UNIT, LEAST_GAIN = 2.0 ** -20, 1e-12
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 18)]))


def hashed(*values: np.ndarray | int) -> np.ndarray:
    """64 well-mixed bits of each row of whole numbers."""
    out = np.uint64(0x9E3779B97F4A7C15)
    for value in values:
        out = (out ^ np.asarray(value).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out = out ^ (out >> np.uint64(32))
    return out


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row counts in a tree."""
    return np.searchsorted(_POISSON, (hashed(keys, tree, seed) >> np.uint64(11)) * 2.0 ** -53, side="right")


def shown(tree: np.ndarray | int, path: np.ndarray, features: int, seed: int) -> np.ndarray:
    """The features that each node is shown, by node."""
    order = hashed(np.asarray(tree)[..., None], path[:, None], np.arange(features)[None, :], seed + 1)
    return np.argsort(order, axis=1)[:, :int(np.ceil(np.sqrt(features)))]


def gini(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
    """Impurity times weight."""
    return 2 * no * yes / np.maximum(no + yes, UNIT)


def _codes(x: np.ndarray, thresholds: list[list[float]]) -> np.ndarray:
    return np.stack([np.searchsorted(t, x[:, i]) for i, t in enumerate(thresholds)], axis=1).astype(np.uint8)


@dataclass
class Top:
    """The nodes above the parts, those of all trees together; the first ones are the roots. ``feature`` is -1 where a
    part begins and -2 at a leaf, whose share of the positive class is in ``share``; a right child follows the left."""

    tree: list
    path: list
    feature: list
    bin: list
    left: list
    share: list

    @classmethod
    def roots(cls, trees: int) -> Top:
        return cls(list(range(trees)), [1] * trees, [-1] * trees, [0] * trees, [0] * trees, [0.0] * trees)

    def split(self, node: int, feature: int, at: int) -> int:
        """The left one of two new children."""
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.tree)
        for side in (0, 1):
            for column, value in zip((self.tree, self.path, self.feature, self.bin, self.left, self.share),
                                     (self.tree[node], 2 * self.path[node] + side, -1, 0, 0, 0.0), strict=True):
                column.append(value)
        return self.left[node]


def descend(codes: np.ndarray, node: np.ndarray, feature: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Where rows end that start at the given nodes."""
    moving = np.flatnonzero(feature[node] >= 0)
    while len(moving):
        here = node[moving]
        node[moving] = left[here] + (codes[moving, feature[here]] > at[here])
        moving = moving[feature[node[moving]] >= 0]
    return node


def grow(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, tree: int, path: int, depth: int, seed: int) -> dict:
    """The subtree below a node: feature (-1 at leaves), bin, left child and share of each of its nodes, and gains."""
    features, bins = codes.shape[1], int(codes.max(initial=0)) + 1
    paths, node, at = np.array([path], np.int64), np.zeros(len(label), np.int64), 0
    found, gains = {"feature": [], "bin": [], "left": [], "share": []}, np.zeros(features)
    while len(paths):
        k = len(paths)
        no, yes = (np.bincount(node, weight * (label == c), k) for c in (0, 1))
        best, split_feature, split_bin = np.full(k, LEAST_GAIN), np.full(k, -1), np.zeros(k, np.int64)
        deep = int(paths[0]).bit_length() > depth
        # Only rows of nodes that both classes are in are looked at further.
        mixed = np.flatnonzero((no > 0)[node] & (yes > 0)[node] & (not deep))
        codes, label, weight, node = codes[mixed], label[mixed], weight[mixed], node[mixed]
        picked = shown(tree, paths, features, seed)
        for j in range(picked.shape[1] if len(node) else 0):
            key = node * bins + codes[np.arange(len(node)), picked[node, j]]
            order = np.sort(key << 32 | np.arange(len(key))) & 0xFFFFFFFF
            key = key[order]
            ends = np.flatnonzero(np.diff(key, append=-1))
            of = key[ends] // bins
            new = np.flatnonzero(np.diff(of, prepend=-1))
            sums = [np.cumsum((weight * (label == c))[order])[ends] for c in (0, 1)]
            # Sums from the beginning of each node on.
            begun = np.repeat(new, np.diff(np.append(new, len(of))))
            low = [s - np.where(begun > 0, s[begun - 1], 0) for s in sums]
            gain = (gini(no, yes)[of] - gini(*low) - gini(no[of] - low[0], yes[of] - low[1])) / (no + yes)[of]
            highest = np.maximum.reduceat(gain, new)
            first = np.flatnonzero(gain == np.repeat(highest, np.diff(np.append(new, len(of)))))
            first = first[np.diff(of[first], prepend=-1) != 0]
            better = first[gain[first] > best[of[first]]]
            where = of[better]
            best[where], split_feature[where], split_bin[where] = gain[better], picked[where, j], key[ends[better]] % bins
        cut = split_feature >= 0
        at += k
        rank = np.cumsum(cut) - 1
        for name, column in zip(found, (split_feature, split_bin, np.where(cut, at + 2 * rank, 0), yes / np.maximum(no + yes, UNIT)),
                                strict=True):
            found[name].append(column)
        gains += np.bincount(split_feature[cut], (best * (no + yes))[cut], features)
        stay = np.flatnonzero(cut[node])
        codes, label, weight, node = codes[stay], label[stay], weight[stay], node[stay]
        right = codes[np.arange(len(node)), split_feature[node]] > split_bin[node]
        node = 2 * rank[node] + right
        paths = (2 * paths[cut][:, None] + np.arange(2)).ravel()
    kinds = {"feature": np.int8, "bin": np.uint8, "left": np.int32, "share": np.float64}
    return {name: np.concatenate(found[name]).astype(kind) for name, kind in kinds.items()} | {"gains": gains}


def _packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting, rows = [], 0
    for batch in batches:
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(waiting)
            waiting, rows = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


PARTS = "node int, feature binary, bin binary, left binary, share binary, gains array<double>"


class _Tasks:
    """What tasks do with blocks of rows (key, x, label, weight) and the nodes above the parts."""

    def __init__(self, top: Top, thresholds: list[list[float]], seed: int, depth: int):
        self.tree, self.path = np.array(top.tree), np.array(top.path, np.int64)
        self.feature, self.bin, self.left = np.array(top.feature), np.array(top.bin), np.array(top.left)
        self.share, self.thresholds, self.seed, self.depth = np.array(top.share), thresholds, seed, depth
        self.trees = int(self.tree.max()) + 1

    def reached(self, codes: np.ndarray, tree: int) -> np.ndarray:
        return descend(codes, np.full(len(codes), tree), self.feature, self.bin, self.left)

    def drawn(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        """(codes, label, weight, node) of the rows of a block that a tree counts."""
        for block in _blocks(batches):
            codes = _codes(_matrix(block.column("x")), self.thresholds)
            key, label, weight = (block.column(c).to_numpy() for c in ("key", "label", "weight"))
            # Rows alike in all that a tree sees of them are drawn alike.
            key = hashed(key, *codes.T)
            for tree in range(self.trees):
                times = draws(key, tree, self.seed)
                at = np.flatnonzero(times)
                yield codes[at], label[at], times[at] * weight[at], self.reached(codes[at], tree)

    def counts(self, still: list[int], bins: int):
        """Per open node: rows and weights by shown feature, bin and class."""
        places = np.full(len(self.tree), -1)
        places[still] = np.arange(len(still))
        picked = shown(self.tree[still], self.path[still], len(self.thresholds), self.seed)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for codes, label, weight, node in self.drawn(batches):
                inside = np.flatnonzero(places[node] >= 0)
                names, place = np.unique(node[inside], return_inverse=True)
                if not len(names):
                    continue
                cells = np.empty((len(names), picked.shape[1], bins, 2, 2))
                for j in range(picked.shape[1]):
                    code = codes[inside, picked[places[node[inside]], j]].astype(np.int64)
                    key = (place * bins + code) * 2 + label[inside]
                    for k, each in enumerate((np.ones(len(inside)), weight[inside])):
                        cells[:, j, :, :, k] = np.bincount(key, each, len(names) * bins * 2).reshape(-1, bins, 2)
                yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.int32()), "cells": [_packed(c) for c in cells]})

        return work

    def best(self, bins: int):
        """The best split of a node from its blocks' counts; feature -2 if there is none."""
        def work(rows: pa.Table) -> pa.Table:
            node = rows.column("node")[0].as_py()
            cells = sum(np.frombuffer(c) for c in rows.column("cells").to_pylist()).reshape(-1, bins, 2, 2)
            picked = shown(self.tree[[node]], self.path[[node]], len(self.thresholds), self.seed)[0]
            low, whole = cells.cumsum(axis=1), cells[0].sum(axis=0)
            no, yes = whole[:, 1]
            gain = (gini(no, yes) - gini(low[..., 0, 1], low[..., 1, 1])
                    - gini(no - low[..., 0, 1], yes - low[..., 1, 1])) / (no + yes)
            j, at = np.unravel_index(gain.argmax(), gain.shape)
            cut = gain[j, at] > LEAST_GAIN
            return pa.table({
                "node": pa.array([node], pa.int32()), "feature": pa.array([picked[j] if cut else -2], pa.int32()),
                "bin": pa.array([at], pa.int32()), "gain": [float(gain[j, at] * (no + yes))], "share": [float(yes / (no + yes))],
                "below": [int(low[j, at, :, 0].sum())], "rows": [int(whole[:, 0].sum())]})

        return work

    def send(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The drawn rows by part."""
        for codes, label, weight, node in self.drawn(batches):
            order = np.argsort(node, kind="stable")
            order = order[self.feature[node[order]] == -1]
            names, first = np.unique(node[order], return_index=True)
            for name, at in zip(names, np.split(order, first[1:]), strict=True):
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array([name], pa.int32()), "codes": [_packed(codes[at])],
                    "label": [_packed(label[at])], "weight": [_packed(weight[at])]})

    def grown(self, rows: pa.Table) -> pa.Table:
        node = rows.column("node")[0].as_py()
        codes, label, weight = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (
            ("codes", np.uint8), ("label", np.int32), ("weight", np.float64)))
        found = grow(codes.reshape(len(label), -1), label, weight, int(self.tree[node]), int(self.path[node]), self.depth, self.seed)
        return pa.table({"node": pa.array([node], pa.int32()), "gains": [found.pop("gains").tolist()],
                         **{k: [_packed(v)] for k, v in found.items()}}).select(["node", *found, "gains"])

    def ask(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (id, x) by the part that they reach, of every tree; shares where that is a leaf above the parts."""
        for block in _blocks(batches):
            ids, codes = block.column("id").to_numpy(), _codes(_matrix(block.column("x")), self.thresholds)
            for tree in range(self.trees):
                node = self.reached(codes, tree)
                order = np.argsort(node, kind="stable")
                names, first = np.unique(node[order], return_index=True)
                for name, at in zip(names, np.split(order, first[1:]), strict=True):
                    known = np.full(len(at), self.share[name]) if self.feature[name] == -2 else np.empty(0)
                    yield pa.RecordBatch.from_pydict({
                        "node": pa.array([name], pa.int32()), "block": pa.array([ids[0]], pa.int64()),
                        "ids": [_packed(ids[at])], "codes": [_packed(codes[at])], "known": [_packed(known)]})

    def answer(self, asked: pa.Table, parts: pa.Table) -> pa.Table:
        out, part = [], next(iter(parts.to_pylist()), None)
        for row in asked.to_pylist():
            share = row["known"]
            if not share and part:
                feature, at, left, shares = (np.frombuffer(part[c], kind) for c, kind in (
                    ("feature", np.int8), ("bin", np.uint8), ("left", np.int32), ("share", np.float64)))
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(self.thresholds))
                share = _packed(shares[descend(codes, np.zeros(len(codes), np.int64), feature, at, left)])
            out.append((row["block"], row["node"], row["ids"], share or _packed(np.full(len(row["ids"]) // 8, 0.5))))
        kinds = (("block", pa.int64()), ("node", pa.int32()), ("ids", pa.binary()), ("share", pa.binary()))
        return pa.table({name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate(kinds)})

    def averaged(self, rows: pa.Table) -> pa.Table:
        """(id, mean share over the trees) of a block."""
        rows = rows.sort_by("node")
        ids, share = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("ids", np.int64), ("share", np.float64)))
        names, place = np.unique(ids, return_inverse=True)
        return pa.table({"id": names, "p": np.bincount(place, share) / self.trees})


class _Columns(HasFeaturesCol, HasLabelCol, HasWeightCol, HasSeed, HasProbabilityCol):
    """Columns of the estimator and its model."""


class RandomForest(Estimator, _Columns):
    """Binary classification; ``idCol`` tells rows apart in the draws, and rows alike in it and in their bins are drawn alike."""

    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "column that names a row", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, numTrees: int = 100, maxDepth: int = 30, maxBins: int = 32, seed: int = 42, idCol: str = "package_name"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(numTrees=100, maxDepth=30, maxBins=32, seed=42, idCol="package_name")

    def setNumTrees(self, value: int) -> RandomForest:
        return self._set(numTrees=value)

    def setMaxDepth(self, value: int) -> RandomForest:
        return self._set(maxDepth=value)

    def setFeaturesCol(self, value: str) -> RandomForest:
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str) -> RandomForest:
        return self._set(labelCol=value)

    def setWeightCol(self, value: str) -> RandomForest:
        return self._set(weightCol=value)

    def _thresholds(self, rows: DataFrame) -> list[list[float]]:
        """Middles between the values of a feature with few, else quantiles; of ``THRESHOLD_ROWS`` rows, as in Spark's forest."""
        bins = self.getOrDefault("maxBins")
        x = np.array([row["x"] for row in rows.orderBy("key", "x").limit(THRESHOLD_ROWS).select("x").collect()])
        if not len(x):
            raise ValueError("no rows to learn from")
        out = []
        for column in x.T:
            values = np.unique(column)
            if len(values) > bins:
                values = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))
            else:
                values = (values[:-1] + values[1:]) / 2
            out.append(values.tolist())
        return out

    def _fit(self, dataset: DataFrame) -> RandomForestModel:
        x = vector_to_array(F.col(self.getFeaturesCol()))
        weight = F.col(self.getWeightCol()) if self.isDefined("weightCol") else F.lit(1.0)
        rows = written(dataset.select(
            F.xxhash64(self.getOrDefault("idCol")).alias("key"), x.alias("x"), F.col(self.getLabelCol()).cast("int").alias("label"),
            (F.round(weight / UNIT) * UNIT).cast("double").alias("weight")), "forest-rows")
        thresholds, seed, depth = self._thresholds(rows), self.getOrDefault("seed"), self.getOrDefault("maxDepth")
        trees, bins = self.getOrDefault("numTrees"), max(2, *(len(t) + 1 for t in thresholds))
        top, gains = Top.roots(trees), np.zeros((trees, len(thresholds)))
        still = list(range(trees)) if rows.count() > PART_ROWS and depth else []
        while still:
            tasks = _Tasks(top, thresholds, seed, depth)
            splits = (rows.mapInArrow(tasks.counts(still, bins), "node int, cells binary").groupBy("node").applyInArrow(
                tasks.best(bins), "node int, feature int, bin int, gain double, share double, below bigint, rows bigint"))
            still = []
            for row in splits.collect():  # nodes of over PART_ROWS rows
                node = row["node"]
                if row["rows"] <= PART_ROWS:
                    continue
                if row["feature"] < 0:
                    top.feature[node], top.share[node] = -2, row["share"]
                    continue
                gains[top.tree[node], row["feature"]] += row["gain"]
                left = top.split(node, row["feature"], row["bin"])
                sizes = (row["below"], row["rows"] - row["below"])
                still += [left + side for side in (0, 1) if sizes[side] > PART_ROWS and top.path[left].bit_length() <= depth]
        tasks, begun = _Tasks(top, thresholds, seed, depth), top.feature.count(-1)
        sent = rows.mapInArrow(tasks.send, "node int, codes binary, label binary, weight binary")
        parts = written(sent.repartition(min(begun, 1000) or 1, "node").groupBy("node").applyInArrow(lambda group: tasks.grown(group), PARTS), "forest")
        names = dataset.sparkSession.createDataFrame(list(enumerate(top.tree)), "node int, tree int")
        for row in parts.join(names, "node").groupBy("tree").agg(F.array(*[F.sum(F.col("gains")[i]) for i in range(len(thresholds))]).alias("g")).collect():
            gains[row["tree"]] += row["g"]
        return self._copyValues(RandomForestModel(parts, top, thresholds, _importances(gains)))


def _importances(gains: np.ndarray) -> list[float]:
    """Gains by feature: each tree's as shares, their mean as shares again."""
    sums = gains.sum(axis=1, keepdims=True)
    mean = np.divide(gains, sums, out=np.zeros_like(gains), where=sums > 0).sum(axis=0)
    return (mean / (mean.sum() or 1.0)).tolist()


class RandomForestModel(Model, _Columns, MLReadable, MLWritable):
    """The parts of the trees as a table, the nodes above them, thresholds by feature, and importances."""

    def __init__(self, parts: DataFrame, top: Top, thresholds: list[list[float]], importances: list[float]):
        super().__init__()
        self.parts, self.top, self.thresholds, self.importances = parts, top, thresholds, importances

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = written(dataset.withColumn("_forest_id", F.monotonically_increasing_id()), "forest-scored")
        tasks = _Tasks(self.top, self.thresholds, 0, 0)
        asked = rows.select(F.col("_forest_id").alias("id"), vector_to_array(F.col(self.getFeaturesCol())).alias("x")).mapInArrow(
            tasks.ask, "node int, block bigint, ids binary, codes binary, known binary")
        replies = asked.groupBy("node").cogroup(self.parts.groupBy("node")).applyInArrow(
            lambda asking, part: tasks.answer(asking, part), "block bigint, node int, ids binary, share binary")
        shares = written(replies.groupBy("block").applyInArrow(lambda group: tasks.averaged(group), "id bigint, p double"), "forest-shares")
        shares = shares.select(F.col("id").alias("_forest_id"), array_to_vector(F.array(1 - F.col("p"), F.col("p"))).alias(
            self.getProbabilityCol()))
        return rows.join(shares, "_forest_id").drop("_forest_id")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: RandomForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, model = self.model.parts.sparkSession, self.model
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata={"forest": {
            "top": vars(model.top), "thresholds": model.thresholds, "importances": model.importances}})
        model.parts.write.parquet(f"{path}/parts")


class _Reader(MLReader):
    def load(self, path: str) -> RandomForestModel:
        spark = SparkSession.active()
        found = DefaultParamsReader.loadMetadata(path, spark)
        # A copy: the model may be saved to the folder that it came from.
        parts = written(spark.read.schema(PARTS).parquet(f"{path}/parts"), "forest")
        model = RandomForestModel(parts, Top(**found["forest"]["top"]), found["forest"]["thresholds"], found["forest"]["importances"])
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        return model
