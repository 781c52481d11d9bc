"""Repair of conversation structure: the cheapest edits that give every conversation the roles `(s?(ua)+)?`.

A conversation's turns are layers of nodes (turn, state of the role pattern). A backward cost DP leaves the arcs
that lie on cheapest paths; each arc is one letter of the audit (Delete, Insert, Keep, Rerole). Nodes are then ranked
by their least audits of 1, 2, 4, ... letters: a rank is a pair of ranks of half the length, and pointers double
with it. The ranks decide between arcs, and the doubled pointers spell the least path.

Turns are sorted by range over all tasks and cut into blocks of bounded size, so no conversation has to fit
into one task. Most are one block and are solved where they lie. For the others each block gives a table of costs
between states at its two ends; these are combined over doubling distances, and so are, afterwards, the states in
which the least paths leave each block. Only an audit and a repaired text, which are one cell, come together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from hazardlens.llm.scratch import stored

#: A block ends at so many turns or characters.
BLOCK_ROWS, BLOCK_CHARS = 1024, 1 << 20
#: Characters that count as nothing.
SPACE = "\t\n\x0b\x0c\r "
ENDS = ".!?"
KEEP_CUT, REROLE, DELETE, INSERT = 1, 2, 3, 2
#: Audit letters in their order; an arc's number is its place here.
LETTERS = "DIKR"

# States: nothing yet, after the system turn, after a user turn, after an assistant turn.
NEXT = np.array([2, 2, 3, 2])
LEGAL = {"su", "ua", "au"}
#: Cost and letters from each state after the last turn to a legal end.
TAIL_COST = [0, 2 * INSERT, INSERT, 0]
TAIL_INSERTS = [0, 2, 1, 0]
NEVER = 1 << 40
_KEPT = np.full((4, 4), -1)  # state and initial (other, s, u, a) to state
_KEPT[0, 1] = 1
_KEPT[[0, 1, 3], 2] = 2
_KEPT[2, 3] = 3


class _Turns:
    """The turns of some blocks, one after another, with their faults."""

    def __init__(self, batch: pa.RecordBatch):
        roles, texts, repeats, turns = (batch.column(c).to_pylist() for c in ("roles", "texts", "repeats", "turns"))
        seen = batch.column("seen").to_pylist() if "seen" in batch.schema.names else [None] * batch.num_rows
        self.roles = [r for block in roles for r in block]
        self.texts = [t for block in texts for t in block]
        self.sizes = np.array([len(block) for block in roles], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        initial, forced, cut, self.facts = [], [], [], []
        for block, block_roles in enumerate(roles):
            known, before = set(), set(seen[block] or ())
            blank = duplicate = truncated = illegal = 0
            last = None
            for role, text, repeat in zip(block_roles, texts[block], repeats[block], strict=True):
                kept = text.rstrip(SPACE)
                again = repeat == 2 or (role, text) in known or (before and digest(role, text) in before)
                if repeat == 1 or not repeat and not kept:
                    blank += 1
                    gone, short = True, False
                elif again:
                    duplicate += 1
                    gone, short = True, False
                else:
                    known.add((role, text))
                    gone, short = False, kept[-1] not in ENDS
                    truncated += short
                illegal += last is not None and last + role[:1] not in LEGAL
                last = role[:1]
                initial.append("?sua".find(last) if last else 0)
                forced.append(gone)
                cut.append(short)
            filled = [t for t in turns[block] if t is not None]
            self.facts.append((blank, duplicate, truncated, illegal, min(filled, default=None), max(filled, default=None),
                               len(set(filled)), block_roles[0][:1] if block_roles else None, last))
        self.initial = np.maximum(np.array(initial, np.int64), 0)
        self.forced, self.cut = np.array(forced, bool), np.array(cut, np.int64)

    def of_like_size(self) -> Iterator[np.ndarray]:
        """Blocks of up to 0, 1, 3, 7, ... turns, so that they can be solved side by side."""
        bits = np.array([int(n).bit_length() for n in self.sizes])
        for size in np.unique(bits):
            yield np.flatnonzero(bits == size)

    def costs(self, blocks: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cheapest way on from (block, turn, state) to the block's end, which costs ``ends`` (block, state) itself."""
        most = int(self.sizes[blocks].max(initial=0))
        costs = np.full((len(blocks), most + 1, 4), NEVER, np.int64)
        costs[np.arange(len(blocks)), self.sizes[blocks]] = ends
        for layer in range(most - 1, -1, -1):
            here = np.flatnonzero(self.sizes[blocks] > layer)
            at = self.starts[blocks[here]] + layer
            best = np.min(self._steps(at, costs[here, layer + 1]), axis=0)
            user, assistant = best[:, 2].copy(), best[:, 3].copy()
            best[:, 2] = np.minimum(user, INSERT + assistant)
            best[:, 3] = np.minimum(assistant, INSERT + user)
            best[:, 0] = np.minimum(best[:, 0], INSERT + best[:, 2])
            best[:, 1] = np.minimum(best[:, 1], INSERT + best[:, 2])
            costs[here, layer] = np.minimum(best, NEVER)
        return costs

    def _steps(self, at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Cost of going on by Delete, Keep and Rerole of the turns ``at``, from each state; (arc, turn, state)."""
        target = _KEPT[:, self.initial[at]].T
        kept = np.where(target >= 0, np.take_along_axis(after, np.maximum(target, 0), 1), NEVER)
        out = np.stack((DELETE + after, kept + KEEP_CUT * self.cut[at, None], REROLE + after[:, NEXT] + KEEP_CUT * self.cut[at, None]))
        out[1:, self.forced[at]] = NEVER
        return out

    def paths(self, blocks: np.ndarray, ends: np.ndarray) -> _Paths:
        """The least of the cheapest paths from every node of the blocks."""
        costs = self.costs(blocks, ends)
        count, layers, _ = costs.shape
        node = np.arange(costs.size).reshape(costs.shape)
        targets = np.full((4, *costs.shape), -1)
        for layer in range(layers - 1):
            here = np.flatnonzero(self.sizes[blocks] > layer)
            at = self.starts[blocks[here]] + layer
            now, after = costs[here, layer], node[here, layer + 1]
            steps = self._steps(at, costs[here, layer + 1])
            kept = np.take_along_axis(after, np.maximum(_KEPT[:, self.initial[at]].T, 0), 1)
            for letter, cost, target in ((0, steps[0], after), (1, INSERT + now[:, NEXT], node[here, layer][:, NEXT]),
                                         (2, steps[1], kept), (3, steps[2], after[:, NEXT])):
                targets[letter][here, layer] = np.where((cost == now) & (now < NEVER), target, -1)
        return _Paths(targets.reshape(4, -1), node)


class _Paths:
    """Least paths over arcs that go from node to node; ``targets`` has an arc of each letter, or -1."""

    def __init__(self, targets: np.ndarray, node: np.ndarray):
        self.node, self.layers = node, node.shape[1]
        nodes = np.arange(targets.shape[1])
        letter = np.where(targets >= 0, np.arange(4)[:, None], 4).min(axis=0)
        last = letter == 4
        pointer = np.where(last, nodes, targets[np.minimum(letter, 3), nodes])
        rank = np.where(last, 0, letter + 1)
        # Rank k orders nodes by audits of 2^k letters, pointer k leads so many letters on.
        self.pointers = [pointer]
        while (pointer != pointer[pointer]).any():
            pair = rank * (int(rank.max()) + 1) + rank[pointer]
            rank = np.unique(pair, return_inverse=True)[1]
            pointer = pointer[pointer]
            self.pointers.append(pointer)
        choice = np.where(targets >= 0, np.arange(4)[:, None] * (int(rank.max(initial=0)) + 1) + rank[np.maximum(targets, 0)],
                          np.iinfo(np.int64).max).argmin(axis=0)
        self.letter = np.where(last, -1, choice)
        self.last = self.pointers[-1]

    def exits(self, states: np.ndarray) -> np.ndarray:
        """State in which the path from each block's (block, state) reaches the block's end."""
        return self.last[self.node[np.arange(len(self.node))[:, None], 0, states]] % 4

    def spelled(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters (-1 beyond the end) and states of the nodes along the path from each block's start state."""
        along = self.node[np.arange(len(self.node)), 0, states][:, None]
        for pointer in reversed(self.pointers):
            along = np.stack((along, pointer[along]), axis=2).reshape(len(along), -1)
        return self.letter[along], along % 4


def digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def _blocks(kinds: list[pa.DataType], block_rows: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted turns (conv, turn, role, text, copies) to blocks; a repeat of the row before it is 1 if blank, else 2.

    A block is ``alone`` if it surely is its whole conversation. Turns with no copy only say that there is a
    conversation.
    """
    names = ["conv", "part", "seq", "alone", "turns", "roles", "texts", "repeats"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        weight = seq = 0
        rows: list[tuple] = []
        chars, conv, first, cut, started = 0, None, True, False, False

        def close(ended: bool) -> None:
            nonlocal rows, chars, seq, weight
            out.append((conv, part, seq, ended and not first and not cut, *map(list, zip(*rows, strict=True)))
                       if rows else (conv, part, seq, ended and not first and not cut, [], [], [], []))
            weight += chars + 100 * len(rows)
            rows, chars, seq = [], 0, seq + 1

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for key, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if started and key != conv:
                    if rows or not cut:
                        close(True)
                    first = cut = False
                conv, started = key, True
                again = 1 if not text.rstrip(SPACE) else 2
                for copy in range(copies):
                    rows.append((turn, role, "" if copy else text, again if copy else 0))
                    chars += 0 if copy else len(text)
                    if len(rows) >= block_rows or chars >= BLOCK_CHARS:
                        cut = True
                        close(False)
                    if weight > 4 * BLOCK_CHARS or len(out) >= 4096:
                        yield flushed()
                        weight = 0
        if started and (rows or not cut):
            close(False)
        if out:
            yield flushed()

    return run


FACTS = ("blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_turn bigint, last_turn bigint, "
         "turns_seen bigint, first_role string, last_role string")
PIECE = f"cost bigint, audit string, repaired string, {FACTS}"
_FACT_KINDS = [*[pa.int64()] * 7, pa.string(), pa.string()]


def _pieces(batch: pa.RecordBatch) -> list[pa.Array]:
    """Cost, audit, repaired text and facts of each block. ``ends`` are the costs at its end, ``entry`` the state it
    begins in and ``closing`` whether a conversation ends with it; without these columns it is a conversation."""
    turns = _Turns(batch)
    named = set(batch.schema.names)
    count = batch.num_rows
    ends = np.array(batch.column("ends").to_pylist() if "ends" in named else [TAIL_COST] * count, np.int64).reshape(-1, 4)
    entry = np.array(batch.column("entry")) if "entry" in named else np.zeros(count, np.int64)
    closing = np.array(batch.column("closing")) if "closing" in named else np.ones(count, bool)
    costs, audits, texts = np.zeros(count, np.int64), [""] * count, [""] * count
    for blocks in turns.of_like_size():
        paths = turns.paths(blocks, ends[blocks])
        costs[blocks] = turns.costs(blocks, ends[blocks])[np.arange(len(blocks)), 0, entry[blocks]]
        letters, states = paths.spelled(entry[blocks])
        for block, steps, along in zip(blocks.tolist(), letters.tolist(), states.tolist(), strict=True):
            at, lines, audit, state = int(turns.starts[block]), [], [], int(entry[block])
            for letter, state in zip(steps, along, strict=True):
                if letter < 0:
                    break
                audit.append(LETTERS[letter])
                if letter == 1:
                    lines.append("assistant:" if state == 2 else "user:")
                    continue
                if letter >= 2:
                    role = turns.roles[at] if letter == 2 else "assistant" if state == 2 else "user"
                    lines.append(f"{role}:{turns.texts[at]}")
                at += 1
            if closing[block]:
                for _ in range(TAIL_INSERTS[state]):
                    audit.append("I")
                    lines.append("assistant:" if state == 2 else "user:")
                    state = int(NEXT[state])
            audits[block], texts[block] = "".join(audit), "\n".join(lines)
    facts = list(zip(*turns.facts, strict=True)) if turns.facts else [[]] * len(_FACT_KINDS)
    return [pa.array(costs), pa.array(audits, pa.string()), pa.array(texts, pa.string()),
            *[pa.array(f, k) for f, k in zip(facts, _FACT_KINDS, strict=True)]]


def _mapped(frame: DataFrame, keys: list[str], fields: str, work: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """The key columns of every row and what ``work`` makes of it."""
    schema = StructType([frame.schema[k] for k in keys] + list(StructType.fromDDL(fields)))
    names = schema.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([sum(map(len, t)) for t in batch.column("texts").to_pylist()], np.int64) + 100
            piece = np.cumsum(sizes) // (2 * BLOCK_CHARS)
            cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *work(part)], names=names)

    return frame.mapInArrow(run, schema)


def _matched(left: DataFrame, right: DataFrame, how: str = "left", on: tuple[str, ...] = ("conv", "idx")) -> DataFrame:
    """A join in which a missing conversation id is an id like any other."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in on], *[c for c in right.columns if c not in on])
    condition = F.lit(True)
    for k in on:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, condition, how).drop(*[f"_{k}" for k in on])


def _doubled(table: DataFrame, column: str, longest: int, forward: bool, combine: Callable[[Column, Column], Column]) -> DataFrame:
    """Combine each block's value with all that follow (``forward``) or come before it, over doubling distances."""
    step = 1
    while step < longest:
        other = table.select("conv", (F.col("idx") + (-step if forward else step)).alias("idx"), F.col(column).alias("other"))
        table = stored(_matched(table, other).select("conv", "idx", F.when(F.col("other").isNull(), F.col(column)).otherwise(
            combine(F.col(column), F.col("other"))).alias(column)), "doubled")
        step *= 2
    return table


def _cheapest(left: Column, right: Column) -> Column:
    """Product of two tables of costs, state to state."""
    return F.array(*[F.least(*[left[4 * a + k] + right[4 * k + b] for k in range(4)], F.lit(NEVER)) for a in range(4) for b in range(4)])


def _at_end(table: Column) -> Column:
    return F.array(*[F.least(*[table[4 * a + b] + F.lit(TAIL_COST[b]) for b in range(4)]) for a in range(4)])


def _long_conversations(blocks: DataFrame) -> DataFrame:
    """Pieces of conversations that may have several blocks: (conv, idx, cost, audit, repaired, facts)."""
    per_part = blocks.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each task at most
    offsets = per_part.select("conv", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
                              F.sum("n").over(W.partitionBy("conv")).alias("total"))
    chain = stored(_matched(blocks, offsets, "inner", ("conv", "part")).select(
        "conv", (F.col("before") + F.col("seq") - F.col("first")).alias("idx"),
        "total", "turns", "roles", "texts", "repeats"), "chain")
    longest = chain.agg(F.max("total")).first()[0] or 0

    def said(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [list({digest(r, t) for r, t, again in zip(rs, ts, rep, strict=True) if not again and t.rstrip(SPACE)})
                 for rs, ts, rep in zip(*(batch.column(c).to_pylist() for c in ("roles", "texts", "repeats")), strict=True)]
        return [pa.array(found, pa.list_(pa.binary()))]

    several = chain.where("total > 1")
    said_in = stored(_mapped(several, ["conv", "idx"], "said array<binary>", said).select("conv", "idx", F.explode("said").alias("said")),
                     "said")
    first = said_in.groupBy("conv", "said").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).where(
        "first_idx < last_idx")
    seen = _matched(said_in, first, "inner", ("conv", "said")).where("idx > first_idx").groupBy("conv", "idx").agg(
        F.collect_list("said").alias("seen"))  # as many as the block has turns
    chain = stored(_matched(chain, seen), "chain-seen")

    def transfers(batch: pa.RecordBatch) -> list[pa.Array]:
        turns = _Turns(batch)
        table = np.zeros((batch.num_rows, 4, 4), np.int64)
        for same in turns.of_like_size():
            for end in range(4):
                ends = np.full((len(same), 4), NEVER)
                ends[:, end] = 0
                table[same, :, end] = turns.costs(same, ends)[:, 0]
        return [pa.array(table.reshape(-1, 16).tolist(), pa.list_(pa.int64()))]

    several = chain.where("total > 1")
    costs = stored(_mapped(several, ["conv", "idx"], "costs array<bigint>", transfers), "transfers")
    onwards = _doubled(costs, "costs", longest, True, _cheapest).select(
        "conv", (F.col("idx") - 1).alias("idx"), _at_end(F.col("costs")).alias("ends"))
    chain = stored(_matched(chain, onwards).withColumn("ends", F.coalesce("ends", F.array(*[F.lit(c).cast("long") for c in TAIL_COST]))),
                   "chain-ends")

    def exits(batch: pa.RecordBatch) -> list[pa.Array]:
        turns = _Turns(batch)
        ends = np.array(batch.column("ends").to_pylist(), np.int64).reshape(-1, 4)
        table = np.zeros((batch.num_rows, 4), np.int64)
        for same in turns.of_like_size():
            table[same] = turns.paths(same, ends[same]).exits(np.tile(np.arange(4), (len(same), 1)))
        return [pa.array(table.tolist(), pa.list_(pa.int64()))]

    left_in = stored(_mapped(chain.where("total > 1"), ["conv", "idx"], "states array<bigint>", exits), "exits")
    states = _doubled(left_in, "states", longest, False, lambda own, earlier: F.transform(
        earlier, lambda s: F.element_at(own, (s + 1).cast("int")))).select("conv", (F.col("idx") + 1).alias("idx"), F.col("states")[0].alias("entry"))
    solved = _matched(chain, states).withColumns({
        "entry": F.coalesce("entry", F.lit(0).cast("long")), "closing": F.col("idx") == F.col("total") - 1})
    return _mapped(solved, ["conv", "idx"], PIECE, _pieces)


def repair_turns(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
                 text_column: str = "text", copies_column: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation: (id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    Turns are taken by number (none first), then by role and text; a missing role or text is one space, a missing
    id an id of its own, and other columns are ignored. Each turn's first fault counts: blank, duplicate (role
    and text seen earlier), truncated. ``illegal`` counts neighbours whose role initials may not follow each other,
    ``gaps`` numbers that are missing between the first and the last. ``audit`` has the letters of the cheapest edits,
    of several the least, ``repaired`` the lines ``role:text``. ``copies_column`` says how often a row is there; a
    conversation without any has zeros and empty texts. An empty table gives an empty result.
    """
    copies = F.col(copies_column) if copies_column else F.lit(1)
    there = copies > 0
    rows = turns.select(
        F.col(id_column).alias("conv"), F.when(there, F.col(turn_column).cast("long")).alias("turn"),
        F.when(there, F.coalesce(F.col(role_column), F.lit(" "))).otherwise("").alias("role"),
        F.when(there, F.coalesce(F.col(text_column), F.lit(" "))).otherwise("").alias("text"), copies.cast("long").alias("copies"))
    # Equal rows are one with a count, so that copies of a turn are not dealt into one task.
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    conv = rows.schema["conv"]
    fields = StructType([StructField("conv", conv.dataType)] + list(StructType.fromDDL(
        "part int, seq bigint, alone boolean, turns array<bigint>, roles array<string>, texts array<string>, repeats array<int>")))
    kinds = [to_arrow_type(f.dataType) for f in fields]
    blocks = stored(dealt.mapInArrow(_blocks(kinds, block_rows), fields), "blocks", ["alone"])
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns_seen"), F.lit(0).cast("long")).alias("gaps")
    whole = _mapped(blocks.where("alone"), ["conv"], PIECE, _pieces)
    columns = ["conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]

    others = blocks.where("not alone")
    pieces = stored(_long_conversations(others.where(F.size("roles") > 0)), "pieces")
    following = pieces.select("conv", (F.col("idx") - 1).alias("idx"), F.col("first_turn").alias("next_turn"), F.col("first_role").alias("next_role"))
    met = F.col("next_role").isNotNull() & ~F.concat("last_role", "next_role").isin(*sorted(LEGAL))
    joined = _matched(pieces, following).withColumns({
        "illegal": F.col("illegal") + met.cast("long"),
        "turns_seen": F.col("turns_seen") - F.coalesce((F.col("last_turn") == F.col("next_turn")).cast("long"), F.lit(0))})

    def in_order(column: str, between: str) -> Column:
        cells = F.array_sort(F.collect_list(F.when(F.col(column) != "", F.struct("idx", column))))
        return F.array_join(F.transform(cells, lambda c: c[column]), between).alias(column)

    together = joined.groupBy("conv").agg(
        F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"), F.sum("turns_seen").alias("turns_seen"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.max(F.when(F.col("idx") == 0, F.col("cost"))).alias("cost"), in_order("audit", ""), in_order("repaired", "\n"))
    empty = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("blank", "duplicate", "truncated", "illegal", "cost")}
    empty |= {c: F.coalesce(c, F.lit("")) for c in ("audit", "repaired")}
    rest = _matched(others.select("conv").distinct(), together, "left", ("conv",)).withColumns(empty)
    return whole.select(*columns).unionByName(rest.select(*columns)).withColumnRenamed("conv", id_column)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): each row as the hash of its place says, dropped ones with no copy.

    0 drops the row, 1 empties its text, 2 takes `.!?` out of it, 3 repeats it, 4 makes the user its speaker.
    """
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
