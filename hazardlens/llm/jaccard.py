"""N-gram Jaccard join: documents whose sets of word n-grams overlap by a threshold or more.

The document by n-gram incidence is multiplied in two blocks of columns. Every row is put into one order of the n-grams,
rare ones first. A row's first block has so many of its n-grams that two rows which link must share one there; its
product is a join on the n-gram, and the place of the shared n-gram in both rows with their sizes bounds what
the rest of the overlap can be, which discards most pairs. Sketches of whole rows, some bits per n-gram, discard
nearly all of the rest that do not link, and for the pairs left the overlap is summed over the whole rows. Equal sets
are one row of the matrix.

Rare means rare in counters of a fixed number that n-grams fall into by hash. They decide only the order, so links are
exact whatever they hold; what many documents share comes last and is hardly ever multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.linking import by_portions, linked_groups
from hazardlens.llm.scratch import bucketed, stored, stored_alone, stored_at
from hazardlens.llm.words import NOT_SPACE, Words, gram_hash, lists, mix, on_slices, salt, signed, slices, split_words

#: Pairs that are looked at together: so many, or that part of the number of sets. First by sketches, then by whole rows.
SKETCH_PAIRS, SKETCH_SHARE = 1 << 16, 2
WHOLE_PAIRS, WHOLE_SHARE = 1 << 12, 32
#: Counters of n-grams, a power of two; a task reports those that stand out from its mean by so many deviations.
SLOTS, STAND_OUT = 1 << 20, 4.0


def first_block(size: int, threshold: int) -> int:
    """How many of its n-grams, rare ones first, a set must show to meet every set that it may link with.

    Sets that link share at least ``threshold`` percent of each of them, so not all that they share can be left.
    """
    return size - -(-size * threshold // 100) + 1


def gram_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a shorter text is one n-gram, a text without words none."""
    at, hashes = words.grams(size)
    cuts = np.searchsorted(at, words.bounds)
    out = []
    for j, n in enumerate(words.counts):
        if n >= size:
            out.append(np.unique(hashes[cuts[j]:cuts[j + 1]]))
        elif n:
            out.append(gram_hash(words.hashes, words.bounds[j:j + 1], int(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_digest(grams: np.ndarray) -> np.uint64:
    """One number for a set; equal sets have equal numbers."""
    return mix(np.array([mix(grams).sum(dtype=np.uint64)]) * np.uint64(3) + salt(len(grams)))[0]


#: A first block's n-grams as bits.
MASK_WORDS = 4
MASK = [f"mask{k}" for k in range(MASK_WORDS)]


def first_block_mask(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(64 * MASK_WORDS, np.uint8)
    bits[(grams >> np.uint64(40)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).view(np.uint64)


def sketch(grams: np.ndarray) -> bytes:
    """Whether an odd number of a set's n-grams falls on a bit; the bits are a power of two, as many as n-grams or more."""
    bits = max(64, 1 << max(len(grams) - 1, 0).bit_length())
    return np.packbits(np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """How many n-grams only one of two sets has, by their sketches: never too many, as each n-gram moves one bit."""
    short, long = sorted((np.frombuffer(x, np.uint8) for x in (a, b)), key=len)
    folded = np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)
    return int(np.bitwise_count(short ^ folded).sum())


def rare_first(grams: np.ndarray, counts: np.ndarray, threshold: int) -> np.ndarray:
    """The first block of a set, in order."""
    if not len(grams):
        return grams
    wanted = first_block(len(grams), threshold)
    order = np.lexsort((grams, counts[(grams & np.uint64(SLOTS - 1)).astype(np.int64)]))
    return grams[order[:wanted]]


def common_grams(rows: DataFrame, size: int) -> np.ndarray:
    """Counters of the n-grams of ``text``, zero where no task saw more than others; as large as ``SLOTS``."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in slices(batches, "text"):
            grams = np.concatenate(gram_sets(split_words(batch.column("text"), NOT_SPACE, lower=True), size))
            held += np.bincount((grams & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        found = np.flatnonzero(held > held.mean() + STAND_OUT * max(held.std(), 1.0))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(held[found])], names=["slot", "n"])

    counts = np.zeros(SLOTS, np.int64)
    for slot, n in (rows.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n"))).collect():
        counts[slot] = n
    return counts


def jaccard_groups(documents: DataFrame, size: int = 3, threshold: int = 90, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """(id, n_shingles, node, component_id) for every row of ``documents``.

    ``component_id`` is the smallest id that links reach; ``node`` is the row's set of n-grams. Words are runs
    of non-space characters, A-Z in lower case. Two rows link when 100 * overlap >= threshold * union. A null
    or blank text has no n-gram and links with nothing. Rows that repeat an id are rows of their own; a null
    id counts only where a group has no other. An empty table gives an empty result.
    """
    return stored_alone(documents.sparkSession, "jaccard-groups",
                        lambda: _jaccard_groups(documents, size, threshold, id_column, text_column))


def _jaccard_groups(documents: DataFrame, size: int, threshold: int, id_column: str, text_column: str) -> DataFrame:
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(common_grams(rows, size))  # SLOTS numbers

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = gram_sets(split_words(batch.column("text"), NOT_SPACE, lower=True), size)
        sizes = np.array([len(s) for s in sets], np.int64)
        keys = [rare_first(s, shared.value, threshold) for s in sets]
        masks = np.array([first_block_mask(k) for k in keys], np.uint64).reshape(-1, MASK_WORDS)
        nodes = np.array([set_digest(s) for s in sets], np.uint64)
        bounds = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes), pa.array(signed(nodes)),
             lists(signed(np.concatenate([*keys, np.empty(0, np.uint64)])), bounds),
             pa.array([sketch(s) for s in sets], pa.binary()), *[pa.array(signed(word)) for word in masks.T]],
            names=["id", "n_shingles", "node", "keys", "sketch", *MASK])

    kind = rows.schema["id"].dataType.simpleString()
    mask_fields = ", ".join(f"{word} bigint" for word in MASK)
    described, drop_described = stored_at(rows.mapInArrow(
        on_slices(describe), f"id {kind}, n_shingles bigint, node bigint, keys array<bigint>, sketch binary, {mask_fields}"), "described")
    sets = stored(described.select("id", "n_shingles", "node"), "sets")
    nodes = stored(described.where("n_shingles > 0").groupBy("node").agg(
        F.count("*").alias("weight"), F.min("id").alias("id"), F.max("n_shingles").alias("n"),
        F.max(F.size("keys")).alias("shown"), *[F.first(word).alias(word) for word in MASK]), "nodes")
    keyed, drop_keyed = stored_at(described.where(F.size("keys") > 0).groupBy("node", "n_shingles").agg(
        F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "keyed")  # equal sets have equal ones
    drop_described()
    postings = keyed.select(F.posexplode("keys").alias("place", "key"), "node")

    def near(p: str, q: str) -> Column:
        """Whether the overlap that sets of these sizes need can still be had.

        It is at most what follows the shared n-gram in either row. It is also at most the overlap of the first blocks and
        what follows these; every bit in which their masks differ stands for an n-gram that only one of them has.
        """
        p_size, q_size, p_shown, q_shown = (F.col(f"{side}{name}") for name in ("n", "shown") for side in (p, q))
        needed = F.floor(((p_size + q_size) * threshold + 99 + threshold) / (100 + threshold))
        apart = sum((F.bit_count(F.col(f"{p}{word}").bitwiseXOR(F.col(f"{q}{word}"))) for word in MASK), F.lit(0))
        shown = F.floor((p_shown + q_shown - apart) / 2) + F.greatest(p_size - p_shown, q_size - q_shown)
        rest = F.least(p_size - F.col(f"{p}place"), q_size - F.col(f"{q}place"))
        return (rest >= needed) & (shown >= needed)

    def full_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = gram_sets(split_words(batch.column("text"), NOT_SPACE, lower=True), size)
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(np.array([set_digest(s) for s in sets], np.uint64))),
             lists(signed(np.concatenate([*sets, np.empty(0, np.uint64)])), bounds)], names=["node", "grams"])

    def both_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns]), side)
        return pairs

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose sketches leave room for the overlap that they need."""
        for batch in batches:
            sizes = sum(batch.column(f"{side}_n_shingles").to_numpy() for side in "ab")
            needed = -(-sizes * threshold // (100 + threshold))
            differ = [apart(*both) for both in zip(*(batch.column(f"{side}_sketch").to_pylist() for side in "ab"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(sizes - np.array(differ, np.int64) >= 2 * needed))

    def prepare(active: DataFrame) -> Callable[[DataFrame], DataFrame]:
        sketches = bucketed(keyed.join(active, "node", "left_semi").select("node", "n_shingles", "sketch"), "sketches", "node")
        drop_keyed()
        several = nodes.count()

        def near_sketches(pairs: DataFrame) -> DataFrame:
            return both_sides(pairs, sketches, "n_shingles", "sketch").mapInArrow(alike, "a bigint, b bigint")

        def verified(pairs: DataFrame) -> DataFrame:
            likely = by_portions(pairs, max(SKETCH_PAIRS, several // SKETCH_SHARE), near_sketches, "likely-pairs")
            named = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            picked = nodes.join(named, "node").select("id").distinct()
            grams = (rows.join(picked, rows["id"].eqNullSafe(picked["id"]), "left_semi").select("text")
                     .mapInArrow(on_slices(full_rows), "node bigint, grams array<bigint>"))
            incidence = bucketed(grams.join(named, "node", "left_semi").dropDuplicates(["node"]), "incidence", "node")

            def linked(pairs: DataFrame) -> DataFrame:
                both = both_sides(pairs, incidence, "grams").withColumn(
                    "overlap", F.size(F.array_intersect("a_grams", "b_grams"))).withColumn(
                    "union", F.size("a_grams") + F.size("b_grams") - F.col("overlap"))
                return both.where(F.col("overlap") * 100 >= F.col("union") * threshold).select("a", "b")

            return by_portions(likely, max(WHOLE_PAIRS, several // WHOLE_SHARE), linked, "linked-pairs")

        return verified

    groups = linked_groups(postings, nodes, ["n", "shown", *MASK], near, prepare, own=("place",))
    least = (nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
             .select("node", "component", "id"))
    lowest = least.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stored(least.join(lowest, "component").select("node", "component_id"), "named")
    linked = named.withColumnRenamed("node", "named_node")
    return (sets.join(linked, (F.col("node") == F.col("named_node")) & (F.col("n_shingles") > 0), "left")
            .select("id", "n_shingles", "node",
                    F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))


def one_of_each_group(documents: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that stay when of each linked group only the document with the smallest id does.

    Rows that repeat an id share its fate. Documents without words and rows without an id stay.
    """
    ids = jaccard_groups(documents, **options).groupBy("id").agg(F.min("component_id").alias("component_id"))
    gone = ids.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(options.get("id_column", "doc_id")))
    return documents.join(gone, gone.columns, "left_anti")
