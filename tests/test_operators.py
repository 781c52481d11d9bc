import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlens.operators import keys
from hazardlens.operators.keys import exclude_known, first_per_key, last_per_key, null_counts, repeated_keys
from hazardlens.operators.ranks import exact_quantiles, smallest_share_cut
from hazardlens.operators.running import alphabetical, numbered, running_totals
from hazardlens.operators.shapes import QUARTILES, box_statistics, describe, histogram, value_counts
from tests.conftest import rows


def numbers(seed, kind):
    draw = random.Random(seed)
    if kind == "skewed":
        return [0.0] * 400 + [float(int(draw.paretovariate(0.5))) for _ in range(601)]
    if kind == "signed":
        return [draw.uniform(-1000, 1000) for _ in range(500)]
    return [7.0] * 11


@pytest.mark.parametrize("kind", ["skewed", "signed", "constant"])
def test_quantiles_agree_with_numpy(spark, kind):
    values = numbers(1, kind)
    frame = spark.createDataFrame([(value,) for value in values] + [(None,)], "x double")
    shares = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    found = exact_quantiles(frame, [], "x", shares).first()
    assert [found[name] for name in shares] == pytest.approx([np.quantile(values, share) for share in shares.values()])


def test_quantiles_of_crowded_values(spark):
    draw = random.Random(8)
    values = [1 + draw.random() * 1e-6 for _ in range(2000)] + [1e9]
    frame = spark.createDataFrame([(value,) for value in values], "x double")
    found = exact_quantiles(frame, [], "x", QUARTILES).first()
    assert [found[name] for name in QUARTILES] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-15)


def test_quantiles_per_group(spark):
    data = {"g1": numbers(2, "skewed"), "g2": numbers(3, "signed"), "g3": [4.0]}
    frame = spark.createDataFrame([(group, value) for group, values in data.items() for value in values], "g string, x double")
    found = {row["g"]: row for row in exact_quantiles(frame, ["g"], "x", QUARTILES).collect()}
    for group, values in data.items():
        assert [found[group][name] for name in QUARTILES] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    draw = random.Random(5)
    scores = sorted({draw.random() for _ in range(300)} | {0.0, 1.0}, reverse=descending)
    data = [(score, draw.randint(0, 9)) for score in scores]
    frame = spark.createDataFrame(draw.sample(data, len(data)), "score double, n long")
    found = {row["score"]: row["total"] for row in running_totals(
        frame, "score", {"total": "n"}, descending=descending).collect()}
    total = 0
    for score, n in data:
        total += n
        assert found[score] == total


def test_numbered(spark):
    keys = random.Random(6).sample(range(-10**9, 10**9), 500)
    frame = spark.createDataFrame([(key,) for key in keys], "seq long")
    found = {row["seq"]: row["position"] for row in numbered(frame, "seq").collect()}
    assert [found[key] for key in sorted(keys)] == list(range(1, 501))


def test_numbered_by_several_columns(spark):
    keys = [(file, split, row) for file in "ba" for split in (0, 128) for row in (3, 1, 2)]
    frame = spark.createDataFrame([((file, split), row) for file, split, row in keys], "f struct<file string, split long>, row long")
    found = numbered(frame, ["f", "row"]).orderBy("position").collect()
    assert [(r["f"]["file"], r["f"]["split"], r["row"], r["position"]) for r in found] == [
        (*key, place) for place, key in enumerate(sorted(keys), start=1)]


def exchanges(frame):
    """Shuffles of the plan that will run."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + \
        frame._jdf.queryExecution().executedPlan().toString().count("Exchange rangepartitioning")


def test_order_statistics_in_few_shuffles(spark):
    frame = spark.range(5000).select((F.col("id") % 7).alias("g").cast("string"), F.rand(3).alias("x"), (F.col("id") % 3).alias("n"))
    assert exchanges(exact_quantiles(frame, ["g"], "x", QUARTILES)) <= 1
    assert exchanges(running_totals(frame, "x", {"a": "n"}, within=("g",), wholes={"all": "n"})) == 0


def test_running_totals_per_label_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        draw = random.Random(4)
        data = [(draw.choice("abc"), key, draw.choice([None, 1, 2]), key % 3) for key in draw.sample(range(10**6), 2000)]
        frame = spark.createDataFrame(data, "g string, key long, n long, m int")
        found = running_totals(frame, "key", {"n_upto": "n", "m_upto": "m"}, within=("g",), wholes={"all_m": "m"})
        got = {(r["g"], r["key"]): (r["n_upto"], r["m_upto"], r["all_m"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sums = {}
    want = {}
    for g, key, n, m in sorted(data, key=lambda d: d[1]):
        a, b = sums.get(g, (0, 0))
        sums[g] = (a + (n or 0), b + m)
        want[g, key] = sums[g]
    assert got == {(g, key): (*upto, sums[g][1]) for (g, key), upto in want.items()}
    empty = running_totals(frame.limit(0), "key", {"t": "m"}, wholes={"all": "m"})
    assert empty.collect() == [] and empty.columns == ["g", "key", "n", "m", "t", "all"]


def test_alphabetical(spark):
    frame = spark.createDataFrame([(w,) for w in ["b", "a", "c", "a"]], "w string")
    assert rows(alphabetical(frame, "w", "code")) == [("a", 0), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_of_crowded_keys(spark, descending):
    keys = list(range(1000)) + [10**15]
    frame = spark.createDataFrame([(key,) for key in keys], "seq long").withColumn("n", F.lit(1).cast("long"))
    found = running_totals(frame, "seq", {"total": "n"}, descending=descending, wholes={"all": "n"})
    ordered = [tuple(row) for row in found.select("seq", "total", "all").orderBy("total").collect()]
    assert ordered == [(key, place, 1001) for place, key in enumerate(sorted(keys, reverse=descending), start=1)]


def test_smallest_share_cut(spark):
    draw = random.Random(7)
    names = [(f"{draw.getrandbits(64):016x}", "a" if n % 10 else "b") for n in range(1000)]
    frame = spark.createDataFrame(names, "name string, label string")
    for row in smallest_share_cut(frame, "label", "name", F.substring("name", 1, 2), 0.2).collect():
        ordered = sorted(name for name, label in names if label == row["label"])
        taken = round(len(ordered) * 0.2)
        assert (row["cut"], row["taken"]) == (ordered[taken - 1], taken)


def test_rows_per_key(spark):
    frame = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, seq long, v string")
    assert rows(last_per_key(frame, ["k"], "seq"), "k", "v") == [("a", "y"), ("b", None)]
    assert rows(first_per_key(frame, ["k"], "seq"), "k", "v") == [("a", "x"), ("b", None)]
    assert rows(repeated_keys(frame, ["k"])) == [("a", 3)]
    assert rows(null_counts(frame, ["k", "v"])) == [("k", 0), ("v", 1)]
    assert rows(exclude_known(frame, frame.where("k = 'a'"), ["k"]), "k") == [("b",)]


def test_histogram_lists_empty_bins_and_closes_the_last(spark):
    frame = spark.createDataFrame([(0,), (1,), (10,), (10,), (None,)], "x long")
    found = [row["bin_count"] for row in histogram(frame, "x", 5).orderBy("bin").collect()]
    assert found == [2, 0, 0, 0, 2]
    flat = spark.createDataFrame([(3,), (3,)], "x long")
    assert [row["bin_count"] for row in histogram(flat, "x", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_box_statistics(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    frame = spark.createDataFrame([("g", value) for value in values] + [("g", None)], "g string, x long")
    box = box_statistics(frame, "g", "x").first()
    assert (box["n"], box["q1"], box["median"], box["q3"]) == (9, 3.0, 5.0, 7.0)
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 8.0, 1)


def test_describe_and_value_counts(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "a"), (None, None), (3, "b")], "x long, t string")
    line = describe(frame, ["x"]).first()
    assert (line["value_count"], line["mean"], line["std"], line["median"]) == (3, 2.0, 1.0, 2.0)
    assert rows(value_counts(frame, ["t"]), "value", "value_count", "percentage") == [("a", 2, 50.0), ("b", 1, 25.0)]


def test_lookup_splits_heavy_keys(spark, monkeypatch):
    """Half of the rows hold one key, some none; the table is over the limit, and still all tasks get alike."""
    monkeypatch.setattr(keys, "BROADCAST_ROWS", 100)
    table = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") * 2).alias("code"), F.lit("x").alias("more"))
    key = F.when(F.col("id") % 2 == 0, "k7").when(F.col("id") % 20 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50_000))
    data = spark.range(200_000).select("id", key.alias("key"))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = keys.with_lookup(data, table, "key")
        sizes = sorted(row["count"] for row in found.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8] and sum(sizes) == 200_000
    plain = data.join(table, "key", "left")
    assert found.columns == plain.columns[1:2] + plain.columns[:1] + plain.columns[2:]
    assert found.exceptAll(plain.select(*found.columns)).isEmpty() and found.count() == plain.count()
