"""Benchmark decontamination by winnowing.

Of every ``window - gram + 1`` adjacent grams the one of least hash is a fingerprint, so any ``window`` words
that a document and a benchmark item share have a fingerprint in common, at the same place of the window.
Fingerprints of both sides are joined; each hit carries the words around it, as hashes, and is extended left
and right. A run of ``window`` or more equal words is a hit. Items that are shorter than a window take part
whole: their grams have their own length.

Documents send only fingerprints whose bit is set in a filter of the benchmark's; the filter has a fixed size
(2 MB) and only ever lets too much through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.llm.scratch import free_names, stored
from hazardlens.llm.words import ALPHANUMERIC, Words, gram_hash, mix, on_slices, salt, signed, split_words

WINDOW = 10
GRAM = 5
#: Words of the filter, 64 bits each.
FILTER_WORDS = 1 << 18


def selected(hashes: np.ndarray, at: np.ndarray, owner: np.ndarray, span: int) -> np.ndarray:
    """Indexes of the grams that have the least hash (the last of equals) in some ``span`` adjacent grams of a text."""
    total = len(at) - span + 1
    if total <= 0:
        return np.empty(0, np.int64)
    whole = np.flatnonzero(owner[at[:total]] == owner[at[span - 1:]])
    best = whole.copy()
    for k in range(1, span):
        other = whole + k
        best = np.where(hashes[other] <= hashes[best], other, best)
    return np.unique(best)


def fingerprints(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(word position, hash) of the fingerprints of all texts with ``window`` words or more."""
    at, hashes = words.grams(gram)
    chosen = selected(hashes, at, words.owner, window - gram + 1)
    return at[chosen], mix(hashes[chosen] + salt(window))


def contexts(words: Words, at: np.ndarray, window: int, gram: int) -> tuple[pa.Array, np.ndarray]:
    """Hashes of the words that a window with this gram may cover, and how many of them come before the gram."""
    reach = window - gram
    owner = words.owner[at] if len(at) else np.empty(0, np.int64)
    first = np.maximum(at - reach, words.bounds[owner])
    last = np.minimum(at + gram + reach, words.bounds[owner + 1])
    sizes = last - first
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    index = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first, sizes)
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(words.hashes[index]))), at - first


def _item_rows(window: int, gram: int):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(batch.column("text"), ALPHANUMERIC, lower=True)
        parts = []
        for size in [*range(1, window), window]:
            if size == window:
                at, hashes = fingerprints(words, window, gram)
                k = gram
            else:
                at = words.bounds[:-1][words.counts == size]
                hashes, k = mix(gram_hash(words.hashes, at, size) + salt(size)), size
            around, lead = contexts(words, at, size, k)
            parts.append(pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(words.owner[at] if len(at) else at)), pa.array(signed(hashes)),
                 pa.array(np.full(len(at), size, np.int32)), around, pa.array(lead.astype(np.int32))],
                names=["item_id", "hash", "size", "item_words", "item_lead"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else parts[0]

    return rows


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
            id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
            item_text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, hits): a row (id, text_key, n_words) per document row, and the runs (id, text_key, item_id, first,
    last) of word positions that documents share with items, ``last`` included.

    ``text_key`` tells apart rows that repeat an id; equal rows have equal results. Null texts have no words.
    """
    items = benchmark.select(F.col(item_column).alias("item_id"), F.col(item_text_column).alias("text"))
    item_kind = items.schema["item_id"].dataType.simpleString()
    prints = stored(items.mapInArrow(
        on_slices(_item_rows(window, gram)),
        f"item_id {item_kind}, hash bigint, size int, item_words array<bigint>, item_lead int"), "item-fingerprints")
    spot = F.pmod(F.col("hash"), F.lit(FILTER_WORDS * 64))
    bits = np.zeros(FILTER_WORDS, np.uint64)
    for row in prints.groupBy(F.shiftright(spot, 6).alias("at")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {FILTER_WORDS * 64}) & 63 as int))")).alias("bits")).collect():
        bits[row["at"]] = np.uint64(row["bits"] % (1 << 64))
    sizes = sorted(r["size"] for r in prints.select("size").distinct().collect())  # at most ``window`` of them
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(bits)

    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(batch.column("text"), ALPHANUMERIC, lower=True)
        keys = mix(words.counts.astype(np.uint64))
        if len(words.hashes):
            spread = mix(words.hashes + mix((np.arange(len(words.hashes)) - words.bounds[words.owner]).astype(np.uint64)))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
            keys = mix(keys + sums[words.bounds[1:]] - sums[words.bounds[:-1]])
        owner, found = words.owner, []
        for size in sizes:
            k = gram if size == window else size
            at, hashes = words.grams(k)
            chosen = selected(hashes, at, owner, size - k + 1)
            at, hashes = at[chosen], mix(hashes[chosen] + salt(size))
            place = hashes % np.uint64(FILTER_WORDS * 64)
            keep = (shared.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            at, hashes = at[keep], hashes[keep]
            around, lead = contexts(words, at, size, k)
            found.append(pa.table([pa.array(owner[at]), pa.array(at - words.bounds[owner[at]] if len(at) else at),
                                   pa.array(signed(hashes)), pa.array(np.full(len(at), size, np.int32)), around,
                                   pa.array(lead.astype(np.int32))],
                                  names=["text", "at", "hash", "size", "words", "lead"]))
        fields = ["at", "hash", "size", "words", "lead"]
        if found:
            hits = pa.concat_tables(found).combine_chunks()
            order = np.argsort(hits.column("text").to_numpy(), kind="stable")
            hits = hits.take(pa.array(order))
            owners = hits.column("text").to_numpy()
        else:
            hits = pa.table({"at": pa.array([], pa.int64()), "hash": pa.array([], pa.int64()),
                             "size": pa.array([], pa.int32()), "words": pa.array([], pa.list_(pa.int64())),
                             "lead": pa.array([], pa.int32())})
            owners = np.empty(0, np.int64)
        cells = pa.StructArray.from_arrays([hits.column(f).combine_chunks() if isinstance(hits.column(f), pa.ChunkedArray)
                                            else hits.column(f) for f in fields], fields)
        bounds = np.searchsorted(owners, np.arange(batch.num_rows + 1))
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(signed(keys)), pa.array(words.counts.astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), cells)],
            names=["id", "text_key", "n_words", "prints"])

    texts = stored(rows.mapInArrow(
        on_slices(scan), f"id {kind}, text_key bigint, n_words bigint, "
        "prints array<struct<at:bigint,hash:bigint,size:int,words:array<bigint>,lead:int>>"), "document-fingerprints")
    suspects = (texts.where(F.size("prints") > 0).select("id", "text_key", F.explode("prints").alias("p"))
                .select("id", "text_key", "p.*").distinct())
    both = suspects.join(prints, ["hash", "size"])
    # Equal words to the left of the gram, up to the reach of a window, and from the gram on to the right.
    left = F.expr("aggregate(sequence(1, least(lead, item_lead) + 1), 0, (n, k) -> if(n = k - 1 and k <= least(lead, item_lead)"
                  " and words[greatest(lead - k, 0)] = item_words[greatest(item_lead - k, 0)], k, n))")
    right = F.expr("aggregate(sequence(0, least(size(words) - lead, size(item_words) - item_lead) - 1), 0,"
                   " (n, k) -> if(n = k and words[lead + k] = item_words[item_lead + k], k + 1, n))")
    hits = (both.withColumn("left", left).withColumn("right", right).where("left + right >= size")
            .select("id", "text_key", "item_id", (F.col("at") - F.col("left")).alias("first"),
                    (F.col("at") + F.col("right") - 1).alias("last")))
    return texts.select("id", "text_key", "n_words"), hits


def contamination(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``documents``.

    Items are sorted as text; the digest of no item is that of an empty text. Null item ids count as no item.
    """
    texts, hits = matches(documents, benchmark, **options)
    hits = stored(hits.distinct(), "hits")
    # Words of overlapping runs count once: each run adds what lies beyond the furthest word so far.
    order = Window.partitionBy("id", "text_key").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    runs = hits.select("id", "text_key", "first", "last").distinct().withColumn(
        "reached", F.coalesce(F.max("last").over(order), F.lit(-1)))
    covered = runs.groupBy("id", "text_key").agg(F.sum(F.greatest(
        F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.col("reached")))).alias("n_hit"))
    items = (hits.where("item_id is not null").select("id", "text_key", F.col("item_id").cast("string").alias("item"))
             .distinct().groupBy("id", "text_key").agg(F.sort_array(F.collect_list("item")).alias("items")))
    found = covered.join(items, [covered["id"].eqNullSafe(items["id"]), covered["text_key"] == items["text_key"]],
                         "left").select(covered["id"].alias("hit_id"), covered["text_key"].alias("hit_key"), "n_hit", "items")
    return texts.join(found, texts["id"].eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left").select(
        "id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` without a hit, with all their columns.

    Every row is judged by its own text, whatever its id. A null or empty text has no hit and stays. With an empty benchmark
    all rows stay; an empty table stays empty.
    """
    (key,) = free_names(documents, "text_class")
    keyed = documents.withColumn(key, F.xxhash64(text_column))
    bad = contamination(keyed, benchmark, id_column=key, text_column=text_column, **options).where("contaminated").select(
        F.col("id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*documents.columns)
