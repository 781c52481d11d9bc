"""Repair of conversations against a plain search over edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from hazardlens.llm import queries, turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, idx int, part int, audit string"
SPACE = "\t\n\x0b\x0c\r "


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_repair(turns):
    """Forward search: cheapest (cost, audit, lines) per state of the role pattern."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x, t) for t, r, x in turns))
    counts, seen, steps = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
    for *_, role, text, _ in rows:
        kept = text.rstrip(SPACE)
        fault = ("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        steps.append((role, text, fault))
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def better(table, state, way):
        if state not in table or way[:2] < table[state][:2]:
            table[state] = way

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                to = follows[state]
                better(table, to, (cost + 2, audit + "I", [*lines, full[to] + ":"]))
        return table

    table = inserted({"": (0, "", [])})
    for role, text, fault in steps:
        after = {}
        for state, (cost, audit, lines) in table.items():
            better(after, state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra, to = cost + (fault == "truncated"), follows[state]
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    better(after, role[:1], (extra, audit + "K", [*lines, f"{role}:{text}"]))
                better(after, to, (extra + 2, audit + "R", [*lines, f"{full[to]}:{text}"]))
        table = inserted(after)
    cost, audit, lines = min((table[s] for s in ("", "a") if s in table), key=lambda w: w[:2])
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, "\n".join(lines))


def by_conversation(rows, ids):
    return {i: brute_repair([r[1:] for r in rows if r[0] == i]) for i in ids}


def found(result):
    rows = [tuple(r) for r in result.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def invented(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Hello.", "Hello", "Yes!", "", " \n", "What?  ", "one two", None, "Ünï 😀.", "a\x85", "b. \x1f"]
    roles = ["user", "assistant", "system", "tool", None, "", "assistant", "user"]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize(("block", "longest"), [(1024, 8), (3, 14), (1, 5)])
def test_repair_is_the_cheapest_and_least(spark, block, longest):
    rows = invented(block, 60, longest)
    got = found(turn_repair.repair_turns(frame(spark, rows), block_rows=block))
    assert got == by_conversation(rows, {r[0] for r in rows})


def test_a_conversation_of_many_blocks(spark):
    rng = random.Random(1)
    rows = [(7, t // 2, rng.choice(["user", "assistant"]), rng.choice(["a.", f"{t}!", f"{t}", ""])) for t in range(700)]
    rows += [(7, 3, "user", "same.")] * 50 + [(8, 1, "user", "x" * 3000 + "."), (8, 2, "assistant", "y" * 3_000_000)]
    got = found(turn_repair.repair_turns(frame(spark, rows), block_rows=16))
    assert got == by_conversation(rows, {7, 8})


def test_damage_then_repair(spark):
    rows = invented(9, 150, 6)
    out = turn_repair.repair_turns(turn_repair.damaged(frame(spark, rows)), copies_column="copies")
    damaged = brute_damage(rows)
    want = by_conversation(damaged, {r[0] for r in rows})
    assert found(out) == want
    none = [i for i in want if not any(r[0] == i for r in damaged)]
    assert none and all(want[i] == (0, 0, 0, 0, 0, 0, "", "") for i in none)


def test_nothing(spark):
    assert turn_repair.repair_turns(frame(spark, [])).collect() == []


def test_query(spark, small):
    table = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = by_conversation(brute_damage(table), {r[0] for r in table})
    got = found(queries.op12_turn_repair(spark, small))
    assert got == {i: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest()) for i, w in want.items()}
