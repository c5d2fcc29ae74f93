"""Repair of conversation structure by weighted generalised LR parsing.

A conversation is the sequence of its roles' initials and must be (s?(ua)+)?, by the grammar

    C -> (nothing) | T | s T        T -> u a | T u a

Rows may be kept (K, 0), given the role user or assistant (R, 3), deleted (D, 4), and rows without text may be inserted (I, 3);
blank and repeated rows have to be deleted, and a truncated row that stays costs 3 more. The parser follows all edits at
once: its stacks share one graph, in which a stack is named by its top state and the state below (the grammar fixes what
lies under these two), and stacks with equal names merge by the least (cost, audit). Audits are the edits' initials in order;
of equal costs the ASCII-least one stays. Two audits with equal cost, rows and stack are never one the beginning of the
other (what follows would be inserts, which cost), so merging early loses nothing.

Rows get their place in a conversation by a range sort, so a long conversation spreads over tasks. It is parsed in blocks of BLOCK
places: a conversation in one block is parsed at once; each block of a longer one is parsed from every possible stack, and
the blocks are put together in order, one task holding no more than the audits (one letter a row).

Faults: blank (no character but \\x20, \\x09-\\x0D), else duplicate (role and text stood earlier in the conversation), else truncated
(the last character that is not blank is none of . ! ?).

Defined results: null roles and texts are one space; rows are in the order of turn (nulls first), then role, then the SHA-256 of
the text; equal rows are repeats of each other; a null conv_id is a conversation of its own; a role whose initial is none of s, u, a
can't be kept; very long texts only travel to their place in the result; an empty table gives no rows; only the four named columns
are read, so others may have any name. In conversations() an audit and a repaired conversation are one cell each,
so there a conversation has less than 2 GB; repair() gives rows and has no such bound but for the audit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ledgerloom.llm.common import join_dealt, read, shared_if_small, small_batches, stored

#: Fixed values of the contract: costs of the edits and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 512
_BLANKS = " \t\n\x0b\x0c\r"

#: The LR(0) automaton: shifts, reductions (symbol, popped states) on sight of the state, gotos, accepting states.
SHIFT = {(0, "s"): 1, (0, "u"): 4, (1, "u"): 4, (2, "u"): 5, (3, "u"): 5, (4, "a"): 6, (5, "a"): 7}
REDUCE = {6: ("T", 2), 7: ("T", 3)}
GOTO = {(0, "T"): 2, (1, "T"): 3}
ACCEPT = {0, 2, 3}
#: States below a state that can lie under the top.
BELOW = {None: (), 0: (), 1: (0,), 2: (0,), 3: (1, 0)}
START = (0, None)
STACKS = [START, (1, 0), (2, 0), (3, 1), (4, 0), (4, 1), (5, 2), (5, 3)]

Graph = dict[tuple[int, int | None], tuple[int, str]]


def _merge(graph: Graph, stack: tuple, value: tuple[int, str]) -> None:
    if stack not in graph or value < graph[stack]:
        graph[stack] = value


def _read(graph: Graph, symbol: str, cost: int, letter: str, out: Graph) -> None:
    """Shift the symbol on every stack that takes it, reduce where a rule is complete, and merge into out."""
    for (top, under), (c, audit) in graph.items():
        to = SHIFT.get((top, symbol))
        if to is None:
            continue
        stack = (to, top)
        if to in REDUCE:
            left, popped = REDUCE[to]
            base = (to, top, under, *BELOW[under])[popped]
            stack = (GOTO[base, left], base)
        _merge(out, stack, (c + cost, audit + letter))


def _inserted(graph: Graph) -> Graph:
    """The graph after any inserts: they cost, so only stacks that got cheaper are taken up again."""
    out, fresh = dict(graph), graph
    while fresh:
        more: Graph = {}
        for symbol in "ua":
            _read(fresh, symbol, INSERT, "I", more)
        fresh = {s: v for s, v in more.items() if s not in out or v < out[s]}
        out |= fresh
    return out


def parsed(initials: str, faults: str, graph: Graph) -> Graph:
    """The graph after these rows. faults: '.' none, b blank, d duplicate, t truncated."""
    for initial, fault in zip(initials, faults):
        graph = _inserted(graph)
        after: Graph = {s: (c + DELETE, a + "D") for s, (c, a) in graph.items()}
        if fault in ".t":
            more = TRUNCATED if fault == "t" else 0
            _read(graph, initial, KEEP + more, "K", after)
            for symbol in "ua":
                _read(graph, symbol, REROLE + more, "R", after)
        graph = after
    return graph


def cheapest(graph: Graph) -> tuple[int, str]:
    return min(v for (top, _), v in _inserted(graph).items() if top in ACCEPT)


@lru_cache(1 << 16)
def repaired(initials: str, faults: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return cheapest(parsed(initials, faults, {START: (0, "")}))


def joined(graph: Graph, block: list[dict]) -> Graph:
    """The graph after a block that was parsed from every stack."""
    out: Graph = {}
    for b in block:
        if (entry := STACKS[b["entry"]]) in graph:
            c, a = graph[entry]
            _merge(out, STACKS[b["exit"]], (c + b["cost"], a + b["audit"]))
    return out


def _illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


class Roles:
    """Roles of rows that are inserted or get a new one: user first, then in turns."""

    def __init__(self):
        self.last = ""

    def next(self, letter: str, initial: str) -> str:
        role = "" if letter == "K" else "assistant" if self.last == "u" else "user"
        self.last = role[:1] or initial
        return role


def edits(audit: str, initials: str, places: list[int], roles: Roles, at: int, last: bool) -> tuple[list[tuple], int]:
    """((place, step, edit, new role) of the rows of a block, where the audit goes on): inserts have the place of the row after
    them, or of the last row of all; steps order what has one place."""
    out, row, step = [], 0, 0
    while at < len(audit) and (row < len(places) or last):
        letter = audit[at]
        place = places[min(row, len(places) - 1)]
        out.append((place, step, letter, roles.next(letter, initials[row] if letter != "I" else "") if letter != "D" else ""))
        step += 1
        if letter != "I":
            row, step = row + 1, 0 if row + 1 < len(places) else step
        at += 1
    return out, at


_EDIT = "struct<place:bigint,step:int,edit:string,role:string>"
_FROM_ALL = [StructField("entry", IntegerType()), StructField("exit", IntegerType()), StructField("cost", LongType()), StructField("audit", StringType())]


def _from_all_stacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of long conversations with (entry, exit, cost, audit) for every pair of stacks."""
    kind = to_arrow_type(ArrayType(StructType(_FROM_ALL)))
    for batch in batches:
        out = []
        for initials, faults, alone in zip(*(batch.column(c).to_pylist() for c in ("initials", "faults", "alone"))):
            ends = [] if alone else [(i, parsed(initials, faults, {s: (0, "")})) for i, s in enumerate(STACKS)]
            out.append([{"entry": i, "exit": STACKS.index(s), "cost": c, "audit": a} for i, graph in ends for s, (c, a) in graph.items()])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], names=[*batch.schema.names, "ends"])


def _put_together(kind: pa.DataType):
    """Blocks sorted by conversation and block: one row for each block with its edits, the last one with the totals."""
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("place", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("role", pa.string())])))
    names = ["conv", "cost", "audit", "blank", "duplicate", "truncated", "illegal", "edits"]

    def whole(blocks: list[tuple], graph: Graph):
        if len(blocks) == 1:
            cost, audit = repaired(blocks[0][1], blocks[0][2])
        else:
            cost, audit = cheapest(graph)
        roles, at = Roles(), 0
        counts = [sum(b[2].count(x) for b in blocks) for x in "bdt"]
        illegal = sum(_illegal(b[1]) for b in blocks) + sum(_illegal(a[1][-1] + b[1][0]) for a, b in zip(blocks, blocks[1:]))
        for i, (conv, initials, faults, places) in enumerate(blocks):
            last = i == len(blocks) - 1
            made, at = edits(audit, initials, places, roles, at, last)
            made = [dict(zip(("place", "step", "edit", "role"), e)) for e in made]
            yield (conv, cost, audit, *counts, illegal, made) if last else (conv, None, None, None, None, None, None, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        graph: Graph = {START: (0, "")}
        rows: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)

        for batch in batches:
            for conv, initials, faults, places, first, ends in zip(*(batch.column(c).to_pylist() for c in ("conv", "initials", "faults", "places", "first", "ends"))):
                if first and held:
                    rows += whole(held, graph)
                    held, graph = [], {START: (0, "")}
                held.append((conv, initials, faults, places))
                graph = joined(graph, ends)
            if rows:
                yield out()
                rows = []
        if held:
            rows += whole(held, graph)
            yield out()

    return run


def _code(role: Column) -> Column:
    initial = F.substring(role, 1, 1)
    return F.when(initial.isin("s", "u", "a"), initial).otherwise("x")


def _parse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, ordered rows): rows has conv, turn, role, text and row, a number that tells rows apart."""
    spark = rows.sparkSession
    text = F.col("text")
    body = F.rtrim(text, F.lit(_BLANKS))
    narrow = rows.select(
        "conv", "turn", "role", "row", F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut")
    )
    order = ["conv", "turn", "role", "sha", "row"]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ordered = stored(ordered, "conversation-order")
    again = ordered.groupBy("conv", "role", "sha").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = stored(again, "conversation-repeats")
    repeats = join_dealt(ordered.select("conv", "role", "sha", "place"), again, ["conv", "role", "sha"], ["place"]).filter("place > first").select("place")
    repeats = stored(repeats, "conversation-duplicates")
    repeats = shared_if_small(repeats, repeats.count(), 8).withColumn("repeat", F.lit(True))
    fault = F.when(F.col("blank"), "b").when(F.col("repeat"), "d").when(F.col("cut"), "t").otherwise(".")
    marked = ordered.join(repeats, "place", "left").select("conv", "place", F.concat(_code(F.col("role")), fault).alias("code"))
    ends = marked.groupBy("conv").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).withColumnRenamed("conv", "conv2")
    block = F.floor(F.col("place") / BLOCK)
    blocks = marked.groupBy("conv", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))
    blocks = blocks.join(ends, F.col("conv").eqNullSafe(F.col("conv2")))
    text_of = lambda i: F.array_join(F.transform("rows", lambda r: F.substring(r["code"], i, 1)), "")
    blocks = blocks.select(
        "conv", "block", text_of(1).alias("initials"), text_of(2).alias("faults"), F.col("rows.place").alias("places"), (F.col("block") == F.floor(F.col("lo") / BLOCK)).alias("first"),
        (F.floor(F.col("lo") / BLOCK) == F.floor(F.col("hi") / BLOCK)).alias("alone"),
    )
    small_batches(spark)
    blocks = blocks.mapInArrow(_from_all_stacks, StructType([*blocks.schema.fields, StructField("ends", ArrayType(StructType(_FROM_ALL)))]))
    kind = rows.schema["conv"].dataType
    out = StructType([
        StructField("conv", kind), StructField("cost", LongType()), StructField("audit", StringType()), StructField("blank", LongType()), StructField("duplicate", LongType()),
        StructField("truncated", LongType()), StructField("illegal", LongType()), StructField("edits", ArrayType(StructType([
            StructField("place", LongType()), StructField("step", IntegerType()), StructField("edit", StringType()), StructField("role", StringType())])))])
    done = blocks.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_put_together(to_arrow_type(kind)), out)
    return stored(done, "conversation-edits"), ordered


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(totals, repaired rows): (conv_id, cost, audit, blank, duplicate, truncated, illegal) of each conversation with rows, and
    (conv_id, place, step, edit, turn, role, text) of every row that stays or is inserted; place and step give the order."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select(F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "conversation-rows")
    done, ordered = _parse(rows)
    totals = done.filter("audit IS NOT NULL").select(F.col("conv").alias("conv_id"), "cost", "audit", "blank", "duplicate", "truncated", "illegal")
    steps = done.select("conv", F.inline("edits")).filter("edit <> 'D'").withColumnRenamed("role", "given")
    new = steps.filter("edit = 'I'").select(F.col("conv").alias("conv_id"), "place", "step", "edit", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.col("given").alias("role"), F.lit("").alias("text"))
    kept = steps.filter("edit <> 'I'").select("place", "step", "edit", "given").join(ordered.select("place", "row"), "place")
    kept = shared_if_small(kept, rows.count(), 64)
    here = rows.join(kept, "row")
    role_now = F.when(F.col("given") == "", F.col("role")).otherwise(F.col("given"))
    old = here.select(F.col("conv").alias("conv_id"), "place", "step", "edit", "turn", role_now.alias("role"), "text")
    return totals, old.unionByName(new)


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by crc32 of conversation and turn, modulo 20: 0 drops a row, 1 empties its text,
    2 takes its ends of sentences, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_id), F.lit(":"), space(turn)).cast("binary")) % 20
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), kind.alias("kind")).filter("kind <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), "kind")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def conversations(rows: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each conv_id of `every`: gaps in the turns of rows, the totals of repair(), and the repaired conversation as text."""
    totals, lines = repair(rows)
    gaps = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long").alias("gaps"))
    line = F.struct("place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    text = lines.groupBy("conv_id").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = text.select("conv_id", F.array_join("lines.line", "\n").alias("repaired"))
    out = every.select("conv_id").distinct()
    for i, part in enumerate((gaps, totals, text)):
        part = part.withColumnRenamed("conv_id", f"id{i}")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col(f"id{i}")), "left").drop(f"id{i}")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired", F.lit("")).alias("repaired"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = conversations(damaged(rows), rows)
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))


OP13_SQL = r"""
WITH RECURSIVE
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS k FROM conversations),
c AS (SELECT * EXCLUDE (k), xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(k, lambda x: ascii(x)::BIGINT)), lambda s, b:
  list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS f FROM o),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(0, CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
q AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
  left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, count(*) OVER (PARTITION BY conv_id) AS n FROM r),
ins(a, b, c, l) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
tr(a, x, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
op AS (SELECT 'D' AS l, a, NULL AS x, a AS b, 4 AS c FROM (VALUES (0), (1), (2), (3)) AS v(a) UNION ALL SELECT 'K', a, x, b, 0 FROM tr UNION ALL SELECT 'R', a, NULL, b, 3 FROM tr WHERE x <> 's'),
e AS (SELECT coalesce(conv_id::VARCHAR, 'none') AS g, i, n, fault, ini FROM q),
s AS (SELECT DISTINCT g, 0::BIGINT AS i, 0 AS st, lpad('0', 9, '0') AS v FROM e UNION ALL
  SELECT s.g, s.i + 1, op.b, min(lpad((s.v[1:9]::INT + ins.c + op.c + CASE WHEN e.fault = 't' AND op.l <> 'D' THEN 3 ELSE 0 END)::VARCHAR, 9, '0') || s.v[10:] || ins.l || op.l)
  FROM s JOIN e ON s.g = e.g AND e.i = s.i + 1 JOIN ins ON ins.a = s.st JOIN op ON op.a = ins.b AND (op.l = 'D' OR (e.fault IN ('.', 't') AND (op.l = 'R' OR op.x = e.ini)))
  GROUP BY s.g, s.i + 1, op.b),
best AS (SELECT s.g, min(lpad((s.v[1:9]::INT + ins.c)::VARCHAR, 9, '0') || s.v[10:] || ins.l) AS v FROM s JOIN (SELECT g, max(n) AS n FROM e GROUP BY g) AS m ON m.g = s.g AND m.n = s.i JOIN ins ON ins.a = s.st WHERE ins.b IN (0, 3) GROUP BY s.g),
l AS (SELECT g, v[10:] AS audit, unnest(range(1, length(v) - 8)) AS p FROM best),
m AS (SELECT g, p, audit[p] AS l, length(replace(audit[1:p], 'I', '')) AS i FROM l),
w AS (SELECT m.g, m.p, m.l, q.role, q.text, row_number() OVER (PARTITION BY m.g ORDER BY p) AS pos, first_value(CASE WHEN m.l = 'K' AND q.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.g ORDER BY p) AS off
  FROM m LEFT JOIN q ON coalesce(q.conv_id::VARCHAR, 'none') = m.g AND q.i = m.i AND m.l <> 'I' WHERE m.l <> 'D'),
t AS (SELECT g, string_agg(CASE WHEN l = 'K' THEN role WHEN (pos - off) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired FROM w GROUP BY g),
k AS (SELECT coalesce(conv_id::VARCHAR, 'none') AS g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
coalesce(best.v[1:9]::BIGINT, 0) AS cost, coalesce(best.v[10:], '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'none') AS g FROM conversations) AS a LEFT JOIN k ON a.g = k.g LEFT JOIN best ON a.g = best.g LEFT JOIN t ON a.g = t.g
"""
