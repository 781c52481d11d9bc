"""Fuzzy line dedup: one occurrence stays of every connected group of equal or near-equal lines.

A line is normalised to its alphanumeric words, A-Z in lower case, between single spaces. Equal normalised
lines, however short, are one node. Nodes of ``LEAST_WORDS`` words or more get a SimHash in blocks: its projections
are sparse, each word votes in the 64 bits of one block only, so that a changed word moves the bits of two blocks at
most, where a vote in all bits would move some in every block. From some ``PAIRED_WORDS`` words on a word votes together
with the next one, as a block of frequent words alone is shared by unrelated lines; a changed word then moves three
blocks at most. By pigeonhole the other blocks agree, and the choices of so many blocks are the join keys
(``block_keys``). Pairs that share one and have like lengths are verified by their edit similarity on whole lines;
there is no bound on bits beside it.

Words are the features, so lines whose edits are spread over most of their words (a typo in every second word) may
share no key; the tests measure how many pairs that are near by edit similarity alone are found.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hazardlens.llm.linking import by_portions, linked_groups
from hazardlens.llm.scratch import free_names, stored, stored_alone, stored_at
from hazardlens.llm.words import ALPHANUMERIC, Words, lists, mix, on_slices, salt, signed, split_words

#: Lines of fewer words are never near copies, only equal ones: too little to tell boilerplate from everyday phrases.
LEAST_WORDS = 4
#: Percent of the longer line that must stay as it is.
SIMILARITY = 90
#: Ratio of the ends of a length class, in words.
LENGTH_RATIO = 1.6
#: In lines of fewer words each word is a block, and one block may differ.
SHORT_WORDS = 10
#: In length classes from so many words on, a word votes together with the next one.
PAIRED_WORDS = 32
#: Words that a key needs; fewer are shared by unrelated lines.
BLOCK_WORDS = 3
#: Words whose votes are counted at a time, and blocks that are filled at a time.
SUM_WORDS, SUM_BLOCKS = 1 << 15, 1 << 13
#: Characters of the runs that bound an edit distance, and the width that is tried before the whole one.
GRAM, NARROW = 3, 16
#: Words of both lines together that are skipped at most to find where two lines meet again.
AHEAD = 12
#: Pairs of lines that are verified together: so many, or that part of the number of lines.
LINE_PAIRS, LINE_SHARE = 1 << 20, 2
#: Words that either line skips there, few and like numbers first.
SKIPS = [(k, both - k) for both in range(1, AHEAD) for k in sorted(range(both + 1), key=lambda k: abs(both - 2 * k))]


def line_spans(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number in the text, first word, end word) of the lines with words."""
    breaks = np.flatnonzero(words.data == 0x0A)
    owner = words.owner
    # Breaks before a word number its line over all texts; those before its text are taken off.
    line = np.searchsorted(breaks, words.starts)
    before = np.searchsorted(breaks, words.offsets[:-1])
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(line))
    return owner[first], line[first] - before[owner[first]], first, end


def line_keys(words: Words, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each line's word sequence."""
    if not len(first):
        return np.empty(0, np.uint64)
    sizes = end - first
    index = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = np.repeat(first, sizes) + index
    return mix(np.add.reduceat(mix(words.hashes[flat] + mix(index.astype(np.uint64))), np.cumsum(sizes) - sizes)
               + salt(3) + sizes.astype(np.uint64))


def features(words: Words, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each word of the lines: of the word and of how often it stood in its line before.

    A word that is repeated so has a vote for each time, in a block of its own, and cannot outvote others.
    """
    sizes = end - first
    line = np.repeat(np.arange(len(sizes)), sizes)
    hashes = words.hashes[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    high = max(len(sizes) - 1, 1).bit_length()
    joined = hashes >> np.uint64(high) | line.astype(np.uint64) << np.uint64(64 - high)
    order = np.argsort(joined)
    new = np.diff(joined[order], prepend=~joined[order[:1]]) != 0
    begin = np.flatnonzero(new)
    earlier = np.empty(len(order), np.uint64)
    earlier[order] = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return mix(hashes + mix(earlier))


def votes(hashes: np.ndarray, place: np.ndarray, places: int) -> np.ndarray:
    """For each place and bit, the words there that have the bit set in their hash less those that have not."""
    sums = np.zeros((places, 64), np.int32)
    for at in range(0, len(hashes), SUM_WORDS):
        of = place[at:at + SUM_WORDS]
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        counts = np.diff(np.append(cut, len(of)))
        several = counts.max() > 255  # eight bits are counted at a time, in the bytes of a long
        if several:
            cut = np.union1d(cut, np.arange(0, len(of), 255))
            counts = np.diff(np.append(cut, len(of)))
        bits = hashes[at:at + SUM_WORDS, None] >> np.arange(8, dtype=np.uint64) & np.uint64(0x0101010101010101)
        ones = np.add.reduceat(bits, cut, axis=0).view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
        more = 2 * ones.astype(np.int32) - counts[:, None].astype(np.int32)
        if several:
            np.add.at(sums, of[cut], more)
        else:
            sums[of[cut]] += more
    return sums


def sign_bits(sums: np.ndarray) -> np.ndarray:
    """The SimHash of each row of votes."""
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1, 8).view(np.uint64).ravel()


def length_classes(largest: int) -> list[tuple[int, int, int]]:
    """(least words, blocks, blocks in a key) of the lines that are not short, up to the class of ``largest`` words."""
    classes, first = [(SHORT_WORDS, 5, 3)], 2 * SHORT_WORDS
    while classes[-1][0] <= largest:
        classes.append((first, (3 if first >= PAIRED_WORDS else 2) * (first // 10) + 1, 1))
        first = int(np.ceil(first * LENGTH_RATIO))
    return classes


def block_keys(words: Words, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, where those of each line begin): SimHash bits of the choices of blocks that near lines agree in.

    Two lines of under ``SHORT_WORDS`` words share a key if one word is replaced or added. Longer ones agree in enough
    blocks if that holds, from 20 words on if up to a tenth of the class's least words is replaced; choices of
    too few words are left out. Lines of under ``LEAST_WORDS`` words have no key.
    """
    sizes = end - first
    begins, hashed = np.cumsum(sizes) - sizes, features(words, first, end)
    plain = words.hashes[np.repeat(first - begins, sizes) + np.arange(sizes.sum())]
    owners, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]

    def flat(chosen: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The line, counted within the chosen ones, and the hash of each of their words."""
        n = sizes[chosen]
        at = np.repeat(begins[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(chosen)), n), hashes[at]

    every = np.flatnonzero((sizes >= LEAST_WORDS) & (sizes <= SHORT_WORDS))
    for chosen in np.array_split(every, len(every) // (SUM_BLOCKS // SHORT_WORDS) + 1):
        line, hashes = flat(chosen, hashed)
        hashes = mix(hashes ^ salt(11))
        sums = votes(hashes, line, len(chosen))
        without = sums[line] - votes(hashes, np.arange(len(hashes)), len(hashes))
        owners += [chosen, chosen[line]]
        found += [mix(sign_bits(sums) + salt(12) + sizes[chosen].astype(np.uint64)),
                  mix(sign_bits(without) + salt(12) + (sizes[chosen] - 1)[line].astype(np.uint64))]
    classes = length_classes(int(sizes.max(initial=0)))
    for level, (least, blocks, together) in enumerate(classes):
        upto = classes[level + 1][0] if level + 1 < len(classes) else least
        # Lines that may gain words enough for this class take part in it too.
        into = least - (2 * (classes[level - 1][0] // 10) if level else 0)
        chosen = np.flatnonzero((sizes >= into) & (sizes < upto))
        paired = least >= PAIRED_WORDS
        line, hashes = flat(chosen, plain if paired else hashed)
        place = line * blocks + (mix(hashes + salt(20 + level)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place = place[order]
        if paired and len(line):
            following = np.append(mix(hashes[1:]), np.uint64(0))
            following[np.append(np.diff(line) != 0, True)] = 0
            # A vote names its place among those of the block too, so that repeated words cannot outvote others; what
            # that moves lies in blocks that have changed anyhow.
            begin = np.flatnonzero(np.diff(place, prepend=-1))
            within = np.arange(len(place)) - np.repeat(begin, np.diff(np.append(begin, len(place))))
            hashes = mix(mix(mix(hashes + following)[order] ^ salt(13)) + mix(within.astype(np.uint64)))
        else:
            hashes = mix(hashes ^ salt(13))[order]
        # Whole lines at a time where a key joins blocks, else any blocks: a line may have millions.
        step = SUM_BLOCKS // blocks * blocks if together > 1 else SUM_BLOCKS
        for low in range(0, len(chosen) * blocks, step):
            high = min(low + step, len(chosen) * blocks)
            begin, stop = np.searchsorted(place, [low, high])
            inside = place[begin:stop] - low
            sums, counts = votes(hashes[begin:stop], inside, high - low), np.bincount(inside, minlength=high - low)
            at = np.arange(low, high)
            choices = [(at // blocks, at % blocks, sums, counts)]
            if together > 1:
                of, sums, counts = np.arange(low // blocks, high // blocks), sums.reshape(-1, blocks, 64), counts.reshape(-1, blocks)
                choices = [(of, np.full(len(of), name), sums[:, part].sum(axis=1), counts[:, part].sum(axis=1))
                           for name, part in enumerate(combinations(range(blocks), together))]
            for of, name, total, filling in choices:
                # Two votes of a word and the next one are three words or more.
                full = np.flatnonzero(filling >= BLOCK_WORDS - paired)
                owners.append(chosen[of[full]])
                found.append(mix(mix(sign_bits(total[full]) + salt(1000 + level)) + name[full].astype(np.uint64)))
    owner, keys = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.searchsorted(owner[order], np.arange(len(first) + 1))


def normalised(words: Words, first: int, end: int) -> str:
    return " ".join(words.data[words.starts[i]:words.ends[i]].tobytes().decode("utf-8", "replace")
                    for i in range(first, end))


def differing_part(a: str, b: str, room: int) -> tuple[str, str] | None:
    """Both lines without the beginning and end that they share, or nothing if over ``room`` edits are between them.

    The shared ends do not change the edit distance. An edit changes ``GRAM`` runs of as many characters at most, so lines
    that lack more of each other's runs are further apart; runs are counted by hash, which can only hide a lack.
    """
    x, y = (np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) for line in (a, b))
    size = min(len(x), len(y))
    other = np.flatnonzero(x[:size] != y[:size])
    head = int(other[0]) if len(other) else size
    size -= head
    other = np.flatnonzero(x[len(x) - size:][::-1] != y[len(y) - size:][::-1])
    tail = int(other[0]) if len(other) else size
    x, y = x[head:len(x) - tail], y[head:len(y) - tail]
    longer = max(len(x), len(y))
    if longer - min(len(x), len(y)) > room:
        return None
    if longer > room:
        counts = []
        for part in (x, y):
            runs = part[:max(len(part) - GRAM + 1, 0)].copy()
            for k in range(1, GRAM):
                runs = runs * np.uint32(0x9E3779B1) + part[k:len(runs) + k]
            counts.append(np.bincount(runs >> np.uint32(20), minlength=1 << 12))
        if np.minimum(*counts).sum() < longer - GRAM + 1 - GRAM * room:
            return None
    return a[head:len(a) - tail], b[head:len(b) - tail]


def edits_by_words(a: str, b: str, room: int) -> int:
    """Some number of edits that turn one line into the other, or over ``room``: never fewer than the fewest.

    Both lines are walked along at once. Where they part, the nearest two words that follow in both are looked for, within
    ``AHEAD`` words; what lies before these is written anew.
    """
    x, y = a.split(" "), b.split(" ")
    i = j = edits = 0
    while edits <= room and (i < len(x) or j < len(y)):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        k, m = next(((k, m) for k, m in SKIPS if x[i + k:i + k + 2] == y[j + m:j + m + 2] and i + k <= len(x) and j + m <= len(y)),
                    (len(x) - i, len(y) - j))
        # Words that have no counterpart take their spaces with them.
        edits += max(sum(map(len, x[i:i + k])) + k, sum(map(len, y[j:j + m])) + m) - (1 if k and m else 0)
        i, j = i + k, j + m
    return edits


def differing_parts(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """(a, b, a_part, b_part, room) of the pairs of lines that may be within ``percent`` of the longer one, the room.

    The parts are empty where the edits are known to be within the room, so that their distance need not be taken.
    """
    picked, parts, rooms = [], [], []
    for i, lines in enumerate(zip(batch.column("a_line").to_pylist(), batch.column("b_line").to_pylist(), strict=True)):
        room = max(map(len, lines)) * percent // 100
        found = ("", "") if edits_by_words(*lines, room) <= room else differing_part(*lines, room)
        if found is not None:
            picked.append(i)
            parts.append(found)
            rooms.append(room)
    at = pa.array(picked, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column("a").take(at), batch.column("b").take(at), *(pa.array([p[k] for p in parts], pa.string()) for k in (0, 1)),
         pa.array(rooms, pa.int32())], names=["a", "b", "a_part", "b_part", "room"])


def repeated_line_numbers(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                          similarity: int = SIMILARITY) -> DataFrame:
    """(id, text_key, line, node): the lines, counted from 0, that go because an equal or near one stays elsewhere.

    Of each group the occurrence of the smallest (id, line) stays, a null id last. Rows that repeat id and text
    are one document. Null and empty texts have no lines, lines without a word stay, and an empty table gives none.
    """
    return stored_alone(documents.sparkSession, "repeated-lines",
                        lambda: _repeated_line_numbers(documents, id_column, text_column, similarity))


def _repeated_line_numbers(documents: DataFrame, id_column: str, text_column: str, similarity: int) -> DataFrame:
    rows = documents.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"),
                            F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(batch.column("text"), ALPHANUMERIC, lower=True)
        text, line, first, end = line_spans(words)
        at = pa.array(text)
        points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
        inside = np.concatenate(([0], np.cumsum(points[words.ends] - points[words.starts])))
        chars = inside[end] - inside[first] + (end - first - 1)
        keys, bounds = block_keys(words, first, end)
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(at), batch.column("text_key").take(at), pa.array(line.astype(np.int32)),
             pa.array(signed(line_keys(words, first, end))), pa.array(chars.astype(np.int32)),
             lists(signed(keys), bounds.astype(np.int64))],
            names=["id", "text_key", "line", "node", "chars", "keys"])

    # The keys of a line are read once or twice and then emptied; what is read to the end goes without them.
    described, drop_lines = stored_at(rows.mapInArrow(
        on_slices(describe), f"id {kind}, text_key bigint, line int, node bigint, chars int, keys array<bigint>"), "lines")
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", "line", "text_key")
    keyed, drop_keys = stored_at(described.groupBy("node").agg(
        F.count("*").alias("weight"), F.min(place).alias("place"), F.max("chars").alias("chars"),
        F.first("keys").alias("keys")), "line-keys")  # equal lines have equal keys
    lines = stored(described.drop("chars", "keys"), "lines")
    drop_lines()
    nodes = stored(keyed.drop("keys"), "nodes")
    postings = keyed.select(F.explode(F.array_distinct("keys")).alias("key"), "node")

    def near(p: str, q: str) -> Column:
        a, b = F.col(f"{p}chars"), F.col(f"{q}chars")
        return F.least(a, b) * 100 >= F.greatest(a, b) * similarity

    def write_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = split_words(batch.column("text"), ALPHANUMERIC, lower=True)
        wanted = [set(x) for x in batch.column("wanted").to_pylist()]
        text, _, first, end = line_spans(words)
        keys = signed(line_keys(words, first, end))
        picked = [i for i in range(len(text)) if int(keys[i]) in wanted[text[i]]]
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[picked] if picked else np.empty(0, np.int64)),
             pa.array([normalised(words, first[i], end[i]) for i in picked], pa.string())], names=["node", "line"])

    def prepare(active: DataFrame) -> Callable[[DataFrame], DataFrame]:
        places = (nodes.join(active, "node")
                  .groupBy(F.col("place.id").alias("id"), F.col("place.text_key").alias("text_key"))
                  .agg(F.collect_list("node").alias("wanted")))  # the lines of one document
        texts = (rows.join(places, rows["id"].eqNullSafe(places["id"]) & (rows["text_key"] == places["text_key"]))
                 .select("text", "wanted").mapInArrow(on_slices(write_out), "node bigint, line string"))
        texts = stored(texts.dropDuplicates(["node"]), "line-texts")

        def near_lines(pairs: DataFrame) -> DataFrame:
            left, right = (texts.select(F.col("node").alias(k), F.col("line").alias(f"{k}_line")) for k in "ab")
            apart = pairs.join(left, "a").join(right, "b").select("a", "b", "a_line", "b_line").mapInArrow(
                lambda batches: map(differing_parts, batches, repeat(100 - similarity)),
                "a bigint, b bigint, a_part string, b_part string, room int")
            # Most near lines differ in little, and a narrow band shows that.
            return apart.where(f"levenshtein(a_part, b_part, least(room, {NARROW})) >= 0 "
                               f"or (room > {NARROW} and levenshtein(a_part, b_part, room) >= 0)").select("a", "b")

        most = max(LINE_PAIRS, nodes.count() // LINE_SHARE)
        return lambda pairs: by_portions(pairs, most, near_lines, "near-lines")

    groups = linked_groups(postings, nodes, ["chars"], near, prepare, release=drop_keys)
    named = nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = stored(named.groupBy("component").agg(F.min("place").alias("kept"), F.sum("weight").alias("n"))
                     .where("n > 1").join(named, "component").select("node", "kept"), "repeated-nodes")
    found = lines.join(several, "node").where(~(
        F.col("id").eqNullSafe(F.col("kept.id")) & (F.col("line") == F.col("kept.line"))
        & (F.col("text_key") == F.col("kept.text_key"))))
    return found.select("id", "text_key", "line", "node").distinct()


@F.pandas_udf(StringType())
def _without_lines(texts: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for text, numbers in zip(texts, gone, strict=True):
        if numbers is None or text is None:
            out.append(text)
        else:
            drop = set(numbers)
            out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
    return pd.Series(out, dtype=object)


def without_repeated_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                           **options) -> DataFrame:
    """``documents`` with whole texts rebuilt from the lines that stay, and ``lines_removed``.

    All rows stay, also those left without a line; a null text stays null. Extra columns are kept, whatever their
    names; only one named ``lines_removed`` is replaced.
    """
    gone = repeated_line_numbers(documents, id_column, text_column, **options)
    gone_id, gone_key, gone_lines = free_names(documents, "gone_id", "gone_key", "gone_lines")
    per_text = gone.groupBy("id", "text_key").agg(F.collect_list("line").alias(gone_lines)).select(
        F.col("id").alias(gone_id), F.col("text_key").alias(gone_key), gone_lines)
    joined = documents.join(per_text, F.col(id_column).eqNullSafe(F.col(gone_id))
                            & (F.xxhash64(text_column) == F.col(gone_key)), "left")
    kept = [F.col(c) for c in documents.columns if c not in (text_column, "lines_removed")]
    return joined.select(*kept, _without_lines(F.col(text_column), F.col(gone_lines)).alias(text_column),
                         F.coalesce(F.size(gone_lines), F.lit(0)).alias("lines_removed"))
