"""Quality rules: a decision list learned from labelled statistics and applied as one Spark expression.

Sequential covering: a rule is a conjunction of thresholds. It is grown on two thirds of the labelled rows,
condition by condition, by information gain, pruned on the remaining third, and kept while nine tenths of the rows
it covers are bad, of all and of those it has not seen (``precision``); these rows are then set aside and the next
rule is grown. The list rejects; a row that no rule covers stays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.llm.words import gram_hash, mix, on_slices, per_text, split_words

#: At most so many labelled rows are fitted, chosen by a seeded hash of their id.
MAX_LABELLED = 20_000
#: Shortest repeated window, in words.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BLANK = " \t\n\v\f\r"
#: Statistics that rules may test.
FEATURES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate"]


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, the words inside windows that occur twice or more in that text."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    total = len(hashes) - window + 1
    if total <= 0:
        return np.zeros(len(bounds) - 1, np.int64)
    at = np.flatnonzero(owner[:total] == owner[window - 1:])
    keys = mix(gram_hash(hashes, at, window) ^ mix(owner[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(marks, at[twice[:-1]], 1)
    np.add.at(marks, at[twice[:-1]] + window, -1)
    return per_text(np.cumsum(marks)[:-1] > 0, bounds)


def repeated_lines(text: str | None) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
    return len(lines), len(lines) - len(set(lines))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def statistics(documents: DataFrame, carried: list[str], text_column: str = "text") -> DataFrame:
    """The ``carried`` columns as c0, c1, ... and the ``MEASURES`` of every row, over whole texts.

    A null text is empty: all are zero. Rows that repeat an id stay rows.
    """
    rows = documents.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)), F.col(text_column).alias("text"))
    kinds = "".join(f"c{i} {rows.schema[i].dataType.simpleString()}, " for i in range(len(carried)))
    symbol = np.isin(np.arange(256), list(SYMBOLS))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(batch.column("text"))
        lengths = np.zeros(len(words.data) + 1, np.int32)
        lengths[words.starts] += 1
        lengths[words.ends] -= 1
        first_bytes = (words.data & 0xC0) != 0x80
        lines = np.array([repeated_lines(x) for x in batch.column("text").to_pylist()], np.int64).reshape(-1, 2)
        columns = [words.counts, per_text(first_bytes & (np.cumsum(lengths)[:-1] > 0), words.offsets),
                   per_text(symbol[words.data], words.offsets), lines[:, 0], lines[:, 1],
                   repeated_words(words.hashes, words.bounds)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:len(carried)], *(pa.array(c.astype(np.int64)) for c in columns)],
            names=[*(f"c{i}" for i in range(len(carried))), *MEASURES])

    return rows.mapInArrow(on_slices(measure), kinds + ", ".join(f"{m} bigint" for m in MEASURES))


def features(measured: DataFrame) -> DataFrame:
    """Adds the rates that rules test; a rate of nothing is zero."""
    def rate(top: str, bottom: str) -> Column:
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))

    return measured.withColumns({
        "mean_word": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words")})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def covers(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] > self.bound if self.above else rows[self.feature] <= self.bound

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.bound) if self.above else F.col(self.feature) <= F.lit(self.bound)


Rule = tuple[Condition, ...]


def covered(rule: Rule, rows: dict[str, np.ndarray], count: int) -> np.ndarray:
    hit = np.ones(count, bool)
    for condition in rule:
        hit &= condition.covers(rows)
    return hit


def _best_condition(rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold of most information gain: bad rows kept times the gain in bits of their share."""
    p, n = bad.sum(), len(bad)
    best: tuple[float, Condition | None] = (0.0, None)
    start = np.log2(p / n)
    for name in FEATURES:
        order = np.argsort(rows[name], kind="stable")
        values, flags = rows[name][order], bad[order]
        cut = np.flatnonzero(np.diff(values) > 0)
        if not len(cut):
            continue
        below = np.cumsum(flags)[cut]
        size = cut + 1
        for above, got, total in ((False, below, size), (True, p - below, n - size)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(got > 0, got * (np.log2(got / total) - start), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                middle = float((values[cut[k]] + values[cut[k] + 1]) / 2)
                best = (float(gain[k]), Condition(name, above, middle))
    return best


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, longest: int) -> Rule:
    rule: list[Condition] = []
    live = np.ones(len(bad), bool)
    while len(rule) < longest and 0 < bad[live].sum() < live.sum():
        gain, condition = _best_condition({k: v[live] for k, v in rows.items()}, bad[live])
        if condition is None:
            break
        rule.append(condition)
        live &= condition.covers(rows)
    return tuple(rule)


def _prune(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The leading part of the rule with the best (bad - good) / covered on rows it was not grown on."""
    def worth(part: Rule) -> float:
        hit = covered(part, rows, len(bad))
        return (2 * bad[hit].sum() - hit.sum()) / max(hit.sum(), 1)

    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learn_rules(rows: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least_rows: int = 5,
                longest: int = 4, most_rules: int = 32, seed: int = 7) -> list[Rule]:
    """Ordered rules for ``bad`` rows. A rule must cover ``least_rows`` rows, ``precision`` of them bad."""
    order = np.random.default_rng(seed).permutation(len(bad))
    rows, bad = {k: np.asarray(rows[k], float)[order] for k in FEATURES}, np.asarray(bad, bool)[order]
    rules: list[Rule] = []
    while len(rules) < most_rules and bad.any() and not bad.all():
        held = np.arange(len(bad)) % 3 == 2
        part = lambda keep: {k: v[keep] for k, v in rows.items()}
        if not bad[~held].any():
            break
        rule = _prune(_grow(part(~held), bad[~held], longest), part(held), bad[held])
        hit = covered(rule, rows, len(bad))
        unseen = hit & held
        if not rule or hit.sum() < least_rows or bad[hit].mean() < precision or (
                unseen.any() and bad[unseen].mean() < precision):
            break
        rules.append(rule)
        rows, bad = part(~hit), bad[~hit]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule rejects: an ordered conditional expression on the feature columns."""
    decision = F.lit(True)
    for rule in reversed(rules):
        test = rule[0].column()
        for condition in rule[1:]:
            test = test & condition.column()
        decision = F.when(test, F.lit(False)).otherwise(decision)
    return decision


def fit_rules(documents: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id",
              text_column: str = "text", most_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Rules for label 0, from at most ``most_labelled`` labelled documents, chosen by a hash of the id.

    Null labels and ids are left out; where an id has several labels, or several rows, half or more must be 1
    for the document to count as good. Without bad or without good rows there is no rule.
    """
    known = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
             .groupBy(F.col(id_column).alias("id")).agg((F.avg(label_column) < 0.5).alias("bad"))
             .orderBy(F.xxhash64("id", F.lit(17)), "id").limit(most_labelled))
    picked = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(
        F.broadcast(known.select("id")), "id", "left_semi")  # bounded by most_labelled
    sample = (features(statistics(picked, ["id"])).dropDuplicates().withColumnRenamed("c0", "id").join(known, "id")
              .orderBy("id", *FEATURES).limit(most_labelled).select("bad", *FEATURES).toPandas())
    if sample.empty:
        return []
    return learn_rules({k: sample[k].to_numpy(float) for k in FEATURES}, sample["bad"].to_numpy(bool), **options)


def judged(documents: DataFrame, carried: list[str], rules: list[Rule], text_column: str = "text",
           least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """Carried columns (c0, c1, ...), statistics, ``base_failed`` and ``kept`` of every row.

    A row fails the base rules with under ``least_words`` words or more than ``most_repeated`` percent of
    words in repeated windows; the learned list judges the others. A null text fails.
    """
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return (features(statistics(documents, carried, text_column)).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & verdict(rules)))


def good_documents(documents: DataFrame, rules: list[Rule], text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns. One pass, no shuffle."""
    columns = documents.columns
    return judged(documents, columns, rules, text_column).where("kept").select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
