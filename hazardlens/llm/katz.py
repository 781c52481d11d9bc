"""Katz backoff: an n-gram language model with Good-Turing discounts and exactly normalised backoff weights.

Work goes by blocks of documents and parts of the key space, both of bounded size. A block (some 1.5 million tokens)
is tokenised once into the shared folder. Order by order it sends its distinct n-grams, packed, to the parts that the
hash of their context names, each with its count and its probability under the order below. A part merges the counts
of all blocks, keeps its piece of the model table if that is asked for, and answers each block with the counts of the n-grams that the block
has and the sums of their contexts. From the answers a block has the probability of its n-grams: the discounted share
where one was seen, else the context's backoff weight times the probability that the order below gave to its end. The
n-grams of one context lie in one part, so that its weight is exact; contexts with a thousandth of all tokens (a thousand
at most) are spread by the whole n-gram and their sums are added up.

P(w | h) = d(c) c(h, w) / c(h) if seen, else a(h) P(w | h without its first word), where a(h) = (1 - seen shares) /
(1 - their probabilities in the order below); 1 for a context never seen. A context without a count low enough to be
discounted is divided by c(h) + 1. Single words are the order of the empty context; below it, one unknown word has all
probability, so that words and the unknown one sum to 1 after every context.

``fit`` keeps the tables of a model, ``Model.write`` and ``read_model`` take them to and from a folder, and ``score``
evaluates any documents with them; ``fit_and_score`` does both in one exchange an order.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.llm.files import full_path, open_store
from hazardlens.llm.scratch import stored, stored_at
from hazardlens.llm.words import mix, salt, slices, split_words
from hazardlens.session import new_folder

#: Tokens of a block and n-grams of a part; memory of a task follows these, not the corpus.
BLOCK_TOKENS = 1_500_000
PART_GRAMS = 1_000_000
#: The n-grams of an order are exchanged in turns, each over its share of the parts: twice as many for each order
#: above the first, so that less lies on disk at once.
MORE_TURNS = 2
#: Words of the longest n-grams.
ORDER = 3
#: Counts up to this are discounted.
K = 5
#: Contexts with at least one in so many tokens are spread over all parts.
HOT_SHARE = 1000
END, START, ROOT = salt(101), salt(102), salt(103)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def packed(values: np.ndarray) -> bytes:
    """Arrays as compressed bytes, with their length."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), kind) if size else np.empty(0, kind)


def with_size(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + data


def split_at_size(data: bytes) -> tuple[bytes, bytes]:
    """What ``with_size`` took, and what follows it."""
    size = int.from_bytes(data[:8], "little")
    return data[8:8 + size], data[8 + size:]


def coded(values: np.ndarray) -> bytes:
    """Doubles, packed as places among their distinct values where these are few."""
    distinct, codes = np.unique(values, return_inverse=True)
    if 4 * len(distinct) > len(values):
        distinct, codes = values, codes[:0]
    return with_size(packed(distinct)) + packed(codes.astype(np.int32))


def decoded(data: bytes) -> np.ndarray:
    distinct, codes = split_at_size(data)
    values, places = unpacked(distinct, np.float64), unpacked(codes, np.int32)
    return values[places] if len(places) else values


def save(folder: str, row: dict) -> str:
    """One row of columns as an Arrow file of a name of its own; a task that runs again leaves another file."""
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.arrow"
    batch = pa.RecordBatch.from_pylist([row])
    with store.open_output_stream(f"{root}/{name}") as sink, pa.ipc.new_file(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return f"{folder}/{name}"


def load(path: str) -> dict:
    store, name = open_store(path)
    with store.open_input_file(name) as source:
        return pa.ipc.open_file(source).read_all().to_pylist()[0]


@dataclass
class Grams:
    """The distinct n-grams of one order in a block, by context and last word.

    ``context`` is a place in ``context_keys``, ``place`` the n-gram that ends at each token, ``seen`` the count in training
    documents, and ``end`` the n-gram of the order below that is left without the first word.
    """

    context: np.ndarray
    context_keys: np.ndarray
    keys: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    end: np.ndarray


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct whole numbers from 0, the first place of each, and which one each value is."""
    bits = len(values).bit_length()
    if int(values.max(initial=0)).bit_length() + bits < 64:
        # Value and place in one number: much faster to sort than an order of places.
        values = np.sort(values << bits | np.arange(len(values)))
        order = values & ((1 << bits) - 1)
        values >>= bits
    else:
        order = np.argsort(values, kind="stable")
        values = values[order]
    new = np.diff(values, prepend=-1) != 0
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return values[new], order[new], which


def extended(context: np.ndarray | np.uint64, word: np.ndarray | np.uint64) -> np.ndarray:
    return mix(np.atleast_1d(context) * _STEP + np.atleast_1d(word))


def start_context(order: int) -> np.uint64:
    """The key of the context before a document's first token."""
    key = ROOT
    for _ in range(order - 1):
        key = extended(key, START)[0]
    return key


@dataclass
class Block:
    """Documents of a block: ids, held-out flags, where each one's tokens begin, and tokens as places in ``words``."""

    ids: list
    held: np.ndarray
    bounds: np.ndarray
    words: np.ndarray
    codes: np.ndarray

    @classmethod
    def read(cls, path: str) -> Block:
        row = load(path)
        return cls(row["ids"], np.array(row["held"], bool), unpacked(row["bounds"], np.int64),
                   unpacked(row["words"], np.uint64), unpacked(row["codes"], np.int32))

    def grams(self, order: int) -> Grams:
        trained = np.repeat(~self.held, np.diff(self.bounds))
        width = len(self.words)
        found = Grams(np.zeros(width, np.int64), np.array([ROOT]), extended(ROOT, self.words), self.codes,
                      np.bincount(self.codes[trained], minlength=width), np.zeros(width, np.int64))
        for level in range(2, order + 1):
            context = np.empty(len(self.codes), np.int64)
            context[1:] = found.place[:-1]
            context[self.bounds[:-1]] = len(found.keys)
            pair, first, place = distinct(context * width + self.codes)
            context_keys = np.append(found.keys, start_context(level))
            found = Grams(pair // width, context_keys, extended(context_keys[pair // width], self.words[pair % width]), place,
                          np.bincount(place[trained], minlength=len(pair)), found.place[first])
        return found


def write_blocks(documents: DataFrame, held_out: Column, id_column: str, text_column: str, folder: str) -> DataFrame:
    """The stored list (block, n_tokens) of the blocks of all rows. A null text has its end token only."""
    rows = documents.select(F.col(id_column).cast("string").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"),
                            F.col(text_column).alias("text"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, hashes, sizes, waiting = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            words, codes = np.unique(np.concatenate(hashes), return_inverse=True)
            path = save(folder, {"ids": ids, "held": held, "bounds": packed(np.concatenate(([0], np.cumsum(np.concatenate(sizes))))),
                                 "words": packed(words), "codes": packed(codes.astype(np.int32))})
            return pa.RecordBatch.from_pydict({"block": [path], "n_tokens": pa.array([len(codes)], pa.int64())})

        for batch in slices(batches, "text"):
            words = split_words(batch.column("text"), lower=True)
            ids += batch.column("id").to_pylist()
            held += batch.column("held").to_pylist()
            hashes.append(np.insert(words.hashes, words.bounds[1:], END))
            sizes.append(words.counts + 1)
            waiting += len(hashes[-1])
            if waiting >= BLOCK_TOKENS:
                yield flush()
                ids, held, hashes, sizes, waiting = [], [], [], [], 0
        if ids:
            yield flush()

    return stored(rows.mapInArrow(write, "block string, n_tokens bigint"), "blocks")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)


def _cut(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by part, and where each part begins in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def low_counts(counts: np.ndarray) -> list[int]:
    """How many n-grams have count 1, 2, ... K + 1."""
    return np.bincount(counts[(counts > 0) & (counts <= K + 1)], minlength=K + 2)[1:].tolist()


def discounts(low: list[int]) -> np.ndarray:
    """Factors d[0..K]: Good-Turing for counts up to K, scaled so that counts above K keep theirs.

    Where the counts of counts do not give factors in (0, 1), as with many copies of documents, they are first
    smoothed by a line through their logarithms; where there is no line, half a count is taken off.
    """
    common = (K + 1) * low[K] / low[0] if low[0] else 1.0
    if min(low) > 0 and common < 1:
        raw = np.array([((c + 1) * low[c] / (c * low[c - 1]) - common) / (1 - common) for c in range(1, K + 1)])
        if ((raw > 0) & (raw < 1)).all():
            return np.concatenate(([1.0], raw))
    there = np.array([c for c in range(1, K + 2) if low[c - 1]])
    count = np.arange(1, K + 1)
    if len(there) > 1:
        slope = np.polyfit(np.log(there), np.log([low[c - 1] for c in there]), 1)[0]
        if slope < -1:
            return np.concatenate(([1.0], (1 + 1 / count) ** (slope + 1)))
    return np.concatenate(([1.0], (count - 0.5) / count))


@dataclass
class Table:
    """A part of one order: contexts with how many n-grams have count 1 ... K, all tokens and the sum of the
    probabilities that the order below gives to the seen; n-grams with their counts. Both by key."""

    contexts: np.ndarray
    spectrum: np.ndarray
    tokens: np.ndarray
    sums: np.ndarray
    keys: np.ndarray
    counts: np.ndarray

    KINDS = (np.uint64, np.int64, np.int64, np.float64, np.uint64, np.int64)

    @classmethod
    def merged(cls, contexts: np.ndarray, keys: np.ndarray, below: np.ndarray, counts: np.ndarray) -> Table:
        keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)
        contexts, of = np.unique(contexts[first], return_inverse=True)
        spectrum = np.stack([np.bincount(of[counts == c], minlength=len(contexts)) for c in range(1, K + 1)])
        tokens = np.bincount(of, weights=counts, minlength=len(contexts)).astype(np.int64)
        return cls(contexts, spectrum, tokens, np.bincount(of, weights=below[first], minlength=len(contexts)), keys, counts)

    def row(self) -> dict[str, bytes]:
        return {f"d{i}": packed(x) for i, x in enumerate(
            (self.contexts, self.spectrum, self.tokens, self.sums, self.keys, self.counts))}

    @classmethod
    def from_row(cls, row: dict | None) -> Table:
        data = [unpacked(row[f"d{i}"], kind) if row else np.empty(0, kind) for i, kind in enumerate(cls.KINDS)]
        data[1] = data[1].reshape(K, len(data[0]))
        return cls(*data)

    def answer(self, contexts: np.ndarray, keys: np.ndarray) -> dict[str, bytes]:
        """Counts of n-grams, and what stands of their contexts; zeros for what was never seen."""

        def found(among: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
            if not len(among):
                return [np.zeros((*v.shape[:-1], len(wanted)), v.dtype) for v in values]
            at = np.minimum(np.searchsorted(among, wanted), len(among) - 1)
            return [np.where(among[at] == wanted, v[..., at], 0) for v in values]

        there = found(self.keys, keys, self.counts) + found(self.contexts, contexts, self.spectrum, self.tokens, self.sums)
        return {f"d{i}": packed(x) for i, x in enumerate(there)}


SENT = "part int, block string, d0 binary, d1 binary, d2 binary, d3 binary"
MERGED = "kind string, part int, block string, stats array<bigint>, share double, " + ", ".join(f"d{i} binary" for i in range(6))
STATE = "block string, p binary, counts binary"


def _merged_rows(rows: list[dict]) -> pa.Table:
    kinds = [("kind", pa.string()), ("part", pa.int32()), ("block", pa.string()), ("stats", pa.list_(pa.int64())),
             ("share", pa.float64()), *((f"d{i}", pa.binary()) for i in range(6))]
    return pa.table({k: pa.array([r.get(k) for r in rows], t) for k, t in kinds})


def gram_parts(grams: Grams, hot: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of n-grams by part, where each part begins, whether the context is spread over parts)."""
    spread = np.isin(grams.context_keys, hot)[grams.context]
    order, cut = _cut(part_of(np.where(spread, grams.keys, grams.context_keys[grams.context]), parts), parts)
    return order, cut, spread


def sent(states: DataFrame, order: int, hot: np.ndarray, parts: int, turn: int, turns: int) -> DataFrame:
    """What blocks ask the parts of this turn: contexts, how many n-grams follow for each, n-grams, and, packed as one,
    training counts with the probability in the order below of those that are not zero."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            block = Block.read(row["block"])
            grams = block.grams(order)
            # The order below the first gives nothing to known words.
            below = unpacked(row["p"], np.float64)[grams.end] if order > 1 else np.zeros(len(grams.keys))
            by, cut, _ = gram_parts(grams, hot, parts)
            for part in range(turn, parts, turns):
                at = by[cut[part]:cut[part + 1]]
                if len(at):
                    first = np.flatnonzero(np.diff(grams.context[at], prepend=-1))
                    seen = grams.seen[at]
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([part], pa.int32()), "block": [row["block"]],
                        "d0": [packed(grams.context_keys[grams.context[at][first]])],
                        "d1": [packed(np.diff(np.append(first, len(at))))], "d2": [packed(grams.keys[at])],
                        "d3": [with_size(packed(seen)) + coded(below[at][seen > 0])]})

    return states.repartition("block").mapInArrow(send, SENT)


def merge(hot: np.ndarray, keep: bool) -> Callable[[pa.Table], pa.Table]:
    """A part's table (if kept), its answers to blocks, its counts of counts, its sums of spread contexts, and its frequent n-grams."""

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        part, contexts, keys, below, counts = rows[0]["part"], [], [], [], []
        for row in rows:
            seen, shares = split_at_size(row["d3"])
            seen = unpacked(seen, np.int64)
            row["names"], row["keys"] = unpacked(row["d0"], np.uint64), unpacked(row["d2"], np.uint64)
            contexts.append(np.repeat(row["names"], unpacked(row["d1"], np.int64))[seen > 0])
            keys.append(row["keys"][seen > 0])
            below.append(decoded(shares))
            counts.append(seen[seen > 0])
        table = Table.merged(*map(np.concatenate, (contexts, keys, below, counts)))
        out = [{"kind": "answer", "part": part, "block": row["block"], **table.answer(row["names"], row["keys"])} for row in rows]
        if keep:
            out.append({"kind": "table", "part": part, **table.row()})
        tokens = int(table.counts.sum())
        out.append({"kind": "stats", "part": part, "stats": [tokens, len(table.keys), *low_counts(table.counts)]})
        out += [{"kind": "spread", "part": part, "share": float(table.sums[i]),
                 "stats": [int(table.contexts[i].astype(np.int64)), *table.spectrum[:, i].tolist(), int(table.tokens[i])]}
                for i in np.flatnonzero(np.isin(table.contexts, hot))]
        out += [{"kind": "frequent", "part": part, "stats": [int(table.keys[i].astype(np.int64)), int(table.counts[i])]}
                for i in np.flatnonzero(table.counts * HOT_SHARE >= max(tokens, 1))]
        return _merged_rows(out)

    return work


def reply(asked: pa.Table, tables: pa.Table) -> pa.Table:
    """Answers from the stored table of a part."""
    table = Table.from_row(next(iter(tables.to_pylist()), None))
    return _merged_rows([{"kind": "answer", "part": row["part"], "block": row["block"], **table.answer(
        unpacked(row["d0"], np.uint64), unpacked(row["d2"], np.uint64))} for row in asked.to_pylist()])


@dataclass
class Level:
    """What every task needs of an order besides its table: the discounts, and the sums of contexts that are spread."""

    factors: np.ndarray
    hot: np.ndarray
    spectrum: np.ndarray
    tokens: np.ndarray
    sums: np.ndarray

    def contexts(self, spectrum: np.ndarray, tokens: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(divisor, backoff weight) of contexts, from how many n-grams have count 1 ... K."""
        divisor = tokens + (spectrum.sum(axis=0) == 0)
        taken = sum(c * (1 - self.factors[c]) * spectrum[c - 1] for c in range(1, K + 1))
        weight = (divisor - tokens + taken) / divisor / (1 - sums)
        return divisor, np.where(tokens > 0, weight, 1.0)

    def probabilities(self, grams: Grams, below: np.ndarray, answers: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability, count) of each n-gram of a block; ``below`` is what the order below gives to its end."""
        by, cut, spread = gram_parts(grams, self.hot, parts)
        seen = np.zeros(len(grams.keys), np.int64)
        divisor, weight = np.ones(len(seen)), np.ones(len(seen))
        for row in answers:
            at = by[cut[row["part"]]:cut[row["part"] + 1]]
            seen[at] = unpacked(row["d0"], np.int64)
            tokens = unpacked(row["d2"], np.int64)
            of = np.cumsum(np.diff(grams.context[at], prepend=-1) != 0) - 1
            parted = self.contexts(unpacked(row["d1"], np.int64).reshape(K, len(tokens)), tokens, unpacked(row["d3"], np.float64))
            divisor[at], weight[at] = parted[0][of], parted[1][of]
        whole = self.contexts(self.spectrum, self.tokens, self.sums)
        at = np.searchsorted(self.hot, grams.context_keys[grams.context[spread]])
        divisor[spread], weight[spread] = whole[0][at], whole[1][at]
        direct = self.factors[np.where(seen <= K, seen, 0)] * seen / divisor
        return np.where(seen > 0, direct, weight * below), seen


@dataclass
class Model:
    """The tables of all orders from 1, by part, and a few numbers of each."""

    parts: int
    tokens: int
    distinct: int
    levels: list[Level]
    tables: list[DataFrame]

    def write(self, path: str) -> None:
        spark = self.tables[0].sparkSession
        for order, table in enumerate(self.tables, 1):
            table.write.parquet(f"{path}/order={order}")
        numbers = {"parts": self.parts, "tokens": self.tokens, "distinct": self.distinct,
                   "levels": [{k: v.tolist() for k, v in asdict(level).items()} for level in self.levels]}
        spark.createDataFrame([(json.dumps(numbers),)], "numbers string").coalesce(1).write.parquet(f"{path}/numbers")


def read_model(spark: SparkSession, path: str) -> Model:
    """A model that ``Model.write`` left in ``path``."""
    found = json.loads(spark.read.parquet(f"{path}/numbers").first()["numbers"])
    levels = []
    for row in found["levels"]:
        hot = np.array(row["hot"], np.uint64)
        levels.append(Level(np.array(row["factors"]), hot, np.array(row["spectrum"], np.int64).reshape(K, len(hot)),
                            np.array(row["tokens"], np.int64), np.array(row["sums"], np.float64)))
    tables = [spark.read.parquet(f"{path}/order={order}") for order in range(1, len(levels) + 1)]
    return Model(found["parts"], found["tokens"], found["distinct"], levels, tables)


def new_level(merged: DataFrame, hot: np.ndarray) -> tuple[Level, int, int, np.ndarray]:
    """(level, tokens, distinct n-grams, keys of those with a ``HOT_SHARE``-th of the tokens) of an order."""
    stats = merged.where("kind = 'stats'").agg(*(F.sum(F.col("stats")[i]) for i in range(K + 3))).first()
    tokens, distinct, *low = [int(x or 0) for x in stats]
    spread = {row["key"] % (1 << 64): row for row in merged.where("kind = 'spread'").groupBy(F.col("stats")[0].alias("key")).agg(
        *(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(1, K + 2)),
        F.sum(F.col("share").cast("decimal(38,20)")).alias("share")).collect()}
    cells = [spread.get(int(key)) for key in hot]
    column = lambda name: [row[name] if row else 0 for row in cells]
    level = Level(discounts(low), hot, np.array([column(f"s{i}") for i in range(1, K + 1)], np.int64).reshape(K, len(hot)),
                  np.array(column(f"s{K + 1}"), np.int64), np.array([float(x) for x in column("share")]))
    frequent = merged.where("kind = 'frequent'").where(F.col("stats")[1] * HOT_SHARE >= tokens).select(
        F.col("stats")[0].alias("key")).collect()  # a thousand at most
    return level, tokens, distinct, np.array([row["key"] % (1 << 64) for row in frequent], np.uint64)


def _evaluate(blocks: DataFrame, size: int, order: int, model: Model | None, kind: str, keep: bool = True) -> tuple[Model, DataFrame]:
    """Order by order, with the tables of ``model`` or with those that the blocks' training documents give; these are
    empty in the model that is returned unless ``keep`` is true."""
    parts = model.parts if model else -(-size // PART_GRAMS) or 1
    fitted = Model(parts, 0, 0, [], [])
    states = blocks.select("block", F.lit(None).cast("binary").alias("p"), F.lit(None).cast("binary").alias("counts"))
    frequent, drop_states = np.empty(0, np.uint64), lambda: None
    for level in range(1, order + 1):
        hot = model.levels[level - 1].hot if model else np.unique(np.append(frequent, start_context(level)))
        turns = min(MORE_TURNS ** (level - 1), parts)
        answers, drops = [], []
        for turn in range(turns):
            asked = sent(states, level, hot, parts, turn, turns)
            if model:
                found = asked.groupBy("part").cogroup(model.tables[level - 1].groupBy("part")).applyInArrow(reply, MERGED)
            else:
                found = asked.groupBy("part").applyInArrow(merge(hot, keep), MERGED)
            frame, drop = stored_at(found, f"order-{level}", ["kind"])
            answers.append(frame)
            drops.append(drop)
        merged = reduce(DataFrame.unionByName, answers)
        if model:
            numbers = model.levels[level - 1]
        else:
            numbers, tokens, distinct, frequent = new_level(merged, hot)
            fitted.levels.append(numbers)
            fitted.tables.append(merged.where("kind = 'table'").select("part", *[f"d{i}" for i in range(6)]))
            if level == 1:
                fitted.tokens, fitted.distinct = tokens, distinct
        totals = model or fitted
        answered = merged.where("kind = 'answer'").select("part", "block", *[f"d{i}" for i in range(4)]).groupBy("block").cogroup(
            states.groupBy("block"))
        if level == order:
            return totals, answered.applyInArrow(_scores(level, numbers, totals.tokens, totals.distinct, parts), SCORES).withColumn(
                "id", F.col("id").cast(kind))
        settled, drop_settled = stored_at(answered.applyInArrow(_settle(level, numbers, parts), STATE), "probabilities")
        drop_states()
        for drop in drops:
            drop("kind=answer")
        states, drop_states = settled, drop_settled
    raise ValueError("the order must be 1 or more")


def _settled(level: int, numbers: Level, parts: int, answers: pa.Table, state: dict) -> tuple[Block, Grams, np.ndarray, np.ndarray]:
    """(block, its n-grams, their probabilities, counts of its words)."""
    block = Block.read(state["block"])
    grams = block.grams(level)
    # Below the first order one unknown word has all probability.
    below = unpacked(state["p"], np.float64)[grams.end] if level > 1 else np.ones(len(grams.keys))
    p, seen = numbers.probabilities(grams, below, answers.to_pylist(), parts)
    return block, grams, p, seen if level == 1 else unpacked(state["counts"], np.int64)


def _settle(level: int, numbers: Level, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(answers: pa.Table, states: pa.Table) -> pa.Table:
        state = states.to_pylist()[0]
        _, _, p, counts = _settled(level, numbers, parts, answers, state)
        return pa.table({"block": [state["block"]], "p": pa.array([packed(p)], pa.binary()),
                         "counts": pa.array([packed(counts)], pa.binary())})

    return work


SCORES = ("id string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
          "score double")


def _scores(level: int, numbers: Level, tokens: int, distinct: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def work(answers: pa.Table, states: pa.Table) -> pa.Table:
        block, grams, p, counts = _settled(level, numbers, parts, answers, states.to_pylist()[0])
        base = np.log10((counts + 1) / (tokens + distinct + 1))
        add = lambda x: np.add.reduceat(x, block.bounds[:-1])
        return pa.table({"id": pa.array(block.ids, pa.string()), "held_out": block.held, "n_tokens": np.diff(block.bounds),
                         "n_known": add((counts > 0).astype(np.int64)[block.codes]),
                         "train_tokens": np.full(len(block.ids), tokens), "base_score": add(base[block.codes]),
                         "score": add(np.log10(p)[grams.place])})

    return work


def _blocks(documents: DataFrame, held_out: Column, id_column: str, text_column: str) -> tuple[DataFrame, int, str]:
    folder = full_path(documents.sparkSession, new_folder(documents.sparkSession, "katz"))
    blocks = write_blocks(documents, held_out, id_column, text_column, folder)
    return blocks, blocks.agg(F.sum("n_tokens")).first()[0] or 0, documents.schema[id_column].dataType.simpleString()


def fit_and_score(documents: DataFrame, held_out: Column, order: int = ORDER, id_column: str = "doc_id",
                  text_column: str = "text") -> tuple[Model, DataFrame]:
    """The model of the rows where ``held_out`` is false or null, and (id, held_out, n_tokens, n_known, train_tokens,
    base_score, score) of every row.

    A-Z are taken in lower case; tokens are runs of non-space characters and one end. Rows that repeat an id count as rows
    of their own. A null or empty text is its end token. With nothing to learn from, the unknown word has all probability.
    """
    blocks, size, kind = _blocks(documents, held_out, id_column, text_column)
    return _evaluate(blocks, size, order, None, kind)


def fit(documents: DataFrame, order: int = ORDER, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """The model of all rows."""
    return fit_and_score(documents, F.lit(False), order, id_column, text_column)[0]


def score(model: Model, documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Scores of every row, as those of ``fit_and_score``, under a model that is there already; ``held_out`` is true."""
    blocks, size, kind = _blocks(documents, F.lit(True), id_column, text_column)
    return _evaluate(blocks, size, len(model.levels), model, kind)[1]


def katz_scores(documents: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text",
                order: int = ORDER) -> DataFrame:
    """The scores of ``fit_and_score``; the tables of the model are not stored for them."""
    blocks, size, kind = _blocks(documents, held_out, id_column, text_column)
    return _evaluate(blocks, size, order, None, kind, keep=False)[1]
