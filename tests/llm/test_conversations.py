"""Conversation repair against brute force over all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversations

GOOD = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    """Rows in order with their first fault."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANK)
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "."
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def by_trying(rows):
    """(cost, audit, lines): every choice of edits of each row and of inserts between them."""
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    best = None
    options = []
    for role, text, fault in rows:
        own = [("D", None, 4)]
        if fault in ".t":
            more = 3 * (fault == "t")
            own += [("K", role, more), ("R", "user", 3 + more), ("R", "assistant", 3 + more)]
        options.append(own)
    for chosen in itertools.product(*options):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            audit, lines, cost = "I" * len(between[0]), [f"{r}:" for r in between[0]], 3 * sum(map(len, between))
            for (letter, role, c), (_, text, _), more in zip(chosen, rows, between[1:]):
                audit, cost = audit + letter, cost + c
                if letter != "D":
                    lines.append(f"{role}:{text}")
                audit += "I" * len(more)
                lines += [f"{r}:" for r in more]
            if GOOD.fullmatch("".join(x[0] for x in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def by_table(rows):
    """(cost, audit) by dynamic programming over the four states of the roles' automaton; no graph of stacks."""
    move = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    now = {0: (0, "")}

    def with_inserts(now):
        while True:
            new = dict(now)
            for s, (c, a) in now.items():
                for x in "ua":
                    if (s, x) in move:
                        t = move[s, x]
                        new[t] = min(new.get(t, (1 << 60, "")), (c + 3, a + "I"))
            if new == now:
                return now
            now = new

    for role, _, fault in rows:
        new = {}
        for s, (c, a) in with_inserts(now).items():
            more = 3 * (fault == "t")
            cases = [(s, c + 4, a + "D")]
            if fault in ".t":
                cases += [(move.get((s, role[:1])), c + more, a + "K")] + [(move.get((s, x)), c + more + 3, a + "R") for x in "ua"]
            for t, cost, audit in cases:
                if t is not None:
                    new[t] = min(new.get(t, (1 << 60, "")), (cost, audit))
        now = new
    return min(v for s, v in with_inserts(now).items() if s in (0, 3))


ROLES = ["system", "user", "assistant", "tool", "", "unknown"]


def test_parser_against_all_edits():
    rng = random.Random(1)
    seen = set()
    for _ in range(150):
        rows = [(rng.choice(ROLES[:4]), str(i), rng.choice("..tbd")) for i in range(rng.randrange(4))]
        initials = "".join(r[0][0] if r[0][0] in "sua" else "x" for r in rows)
        marks = "".join(r[2] for r in rows)
        if (initials, marks) in seen:
            continue
        seen.add((initials, marks))
        cost, audit, lines = by_trying(rows)
        assert conversations.repaired(initials, marks) == (cost, audit) == by_table(rows)
        made, at = conversations.edits(audit, initials, list(range(len(rows))) or [0], conversations.Roles(), 0, True)
        assert at == len(audit)
        text = [f"{given or rows[place][0]}:{'' if letter == 'I' else rows[place][1]}" for place, _, letter, given in made if letter != "D"]
        assert "\n".join(text) == lines


@pytest.mark.parametrize("size", [1, 2, 5])
def test_blocks_joined_are_the_whole(size):
    rng = random.Random(size)
    for _ in range(200):
        n = rng.randrange(1, 14)
        initials, marks = "".join(rng.choice("suax") for _ in range(n)), "".join(rng.choice("...tbd") for _ in range(n))
        graph = {conversations.START: (0, "")}
        for i in range(0, n, size):
            ends = []
            for k, s in enumerate(conversations.STACKS):
                after = conversations.parsed(initials[i : i + size], marks[i : i + size], {s: (0, "")})
                ends += [{"entry": k, "exit": conversations.STACKS.index(e), "cost": c, "audit": a} for e, (c, a) in after.items()]
            graph = conversations.joined(graph, ends)
        assert conversations.cheapest(graph) == conversations.repaired(initials, marks)


def expected(rows):
    after = damage(rows)
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in after if r[0] == conv]
        turns = [r[1] for r in own if r[1] is not None]
        marked = faults(own)
        cost, audit = by_table(marked)
        lines, last, i = [], "", 0
        for letter in audit:
            if letter == "D":
                i += 1
                continue
            role = marked[i][0] if letter == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{'' if letter == 'I' else marked[i][1]}")
            last = role[:1]
            i += letter != "I"
        initials = [r[0][:1] for r in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [sum(m[2] == x for m in marked) for x in "bdt"]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, "\n".join(lines)))
    return sorted(out, key=repr)


def table(seed, convs=60):
    rng = random.Random(seed)
    texts = ["Fine.", "Yes!", "no end", " \t\n", "", None, "é?", "What.\r\n", "a ", "long " * 50 + "."]
    rows = []
    for conv in [*range(convs), None]:
        turn = 0
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 30])):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn - 1]), rng.choice([*ROLES, "user", "assistant", "user", "assistant", None]), rng.choice(texts)))
            turn += rng.choice([1, 1, 1, 2, 0])
    return rows + rows[:5]


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = conversations.conversations(conversations.damaged(df), df).collect()
    return sorted(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired) for r in got), key=repr)


def test_table_against_brute_force(spark):
    rows = table(1)
    assert run(spark, rows) == expected(rows)


def test_long_conversation_and_dealt_repeats(spark, monkeypatch):
    """A conversation over many blocks and tasks, with one row that makes up most of it."""
    from ledgerloom.llm import common

    monkeypatch.setattr(common, "LEAST_PART", 2)
    monkeypatch.setattr(conversations, "BLOCK", 16)
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"t{i}.", f"t{i}", "same.", "same."])) for i in range(1500)] + table(2, 10)
    assert run(spark, rows) == expected(rows)


def test_all_dropped_no_rows_and_other_columns(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", "")]
    df = spark.createDataFrame([("c", 1, "user", "Hi.", "x", 3), ("c", 2, "assistant", "Yes.", "y", 4)], "key string, n int, who string, said string, place string, row int")
    totals, lines = conversations.repair(df, "key", "n", "who", "said")
    assert [(r.conv_id, r.cost, r.audit) for r in totals.collect()] == [("c", 0, "KK")]
    assert [(r.role, r.text, r.turn) for r in lines.orderBy("place", "step").collect()] == [("user", "Hi.", 1), ("assistant", "Yes.", 2)]
    totals, lines = conversations.repair(df.limit(0), "key", "n", "who", "said")
    assert totals.count() == lines.count() == 0


def test_damage(spark):
    rows = table(3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in conversations.damaged(df).collect()]
    assert sorted(got, key=repr) == sorted(damage(rows), key=repr)
    assert conversations.damaged(df.filter(F.lit(False))).count() == 0
