"""Fill-in-the-middle transformation with cuts found by a Fenwick tree.

A text is its units, matched left to right: code points, or the matches of a pattern (what lies between two matches
belongs to the unit before it, what lies before the first one to the first unit). Its UTF-8 bytes are cut into fixed
blocks of BLOCK bytes; two Fenwick trees over the blocks hold how many units and how many code points start in each.
A cut after u units is found by binary lifting: the descent takes, from the largest power of two down, every
step whose sum stays below u + 1, which ends at the block in which unit u starts; only that block is then searched for the
unit's place, and the code points before the block come from the second tree at the same path. Adding to a block is one
climb, so texts that change can keep their trees.

Rows are independent: one pass without a shuffle, whatever the size of the table; a text is cut in one task.

Cuts and form depend only on the row's id: h1 to h4 are the first four groups of eight digits of sha256("1:" + id).

Defined results: a null text counts as empty, and empty texts stay plain; a null id is hashed as an empty string; texts that
hold a marker stay plain, as they could not be rebuilt; repeated rows give repeated results; very long texts cost one
pass over their bytes; an empty table gives no rows; other columns are ignored, so they may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ledgerloom.llm.common import read, small_batches

#: Fixed values of the contract: markers before prefix, suffix and middle, seed, plain and spm shares in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20
BLOCK = 1 << 10


class Fenwick:
    """Sums over blocks: add to one block, sum of the first ones, block of the n-th counted thing."""

    def __init__(self, counts: np.ndarray):
        self.n = len(counts)
        sums = np.concatenate(([0], np.cumsum(counts)))
        node = np.arange(1, self.n + 1)
        self.tree = np.concatenate(([0], sums[node] - sums[node - (node & -node)])).tolist()
        self.top = 1 << self.n.bit_length() >> 1

    def add(self, block: int, more: int) -> None:
        i = block + 1
        while i <= self.n:
            self.tree[i] += more
            i += i & -i

    def before(self, block: int) -> int:
        """Sum of the blocks before this one."""
        total = 0
        while block:
            total += self.tree[block]
            block &= block - 1
        return total

    def descend(self, nth: int) -> tuple[int, int]:
        """(block that holds the nth thing, from 0; how many come before the block). Past the last thing: (number of blocks, all)."""
        at, passed, step = 0, 0, self.top
        while step:
            if at + step <= self.n and passed + self.tree[at + step] <= nth:
                at += step
                passed += self.tree[at]
            step >>= 1
        return at, passed


class Units:
    """Trees over the blocks of one text."""

    def __init__(self, text: str, pattern: re.Pattern | None = None, block: int = BLOCK):
        self.data = text.encode("utf-8", "surrogatepass")
        self.block = block
        raw = np.frombuffer(self.data, np.uint8)
        points = (raw & 0xC0) != 0x80  # bytes that start a code point
        blocks = np.arange(0, len(raw), block)
        self.points = Fenwick(np.add.reduceat(points, blocks, dtype=np.int64) if len(raw) else np.zeros(0, np.int64))
        if pattern is None:
            self.starts, self.units = points, self.points
        else:
            begins = np.array([m.start() for m in pattern.finditer(text) if m.end() > m.start()], np.int64)
            self.starts = np.zeros(len(raw), bool)
            self.starts[np.flatnonzero(points)[begins]] = True
            if len(begins):  # what lies before the first match belongs to it
                self.starts[np.flatnonzero(points)[begins[0]]], self.starts[0] = False, True
            self.units = Fenwick(np.add.reduceat(self.starts, blocks, dtype=np.int64) if len(raw) else np.zeros(0, np.int64))
        self.n = self.units.before(self.units.n)

    def place(self, unit: int) -> tuple[int, int]:
        """(byte, code point) at which this unit starts; the end of the text for unit n."""
        if unit >= self.n:
            return len(self.data), self.points.before(self.points.n)
        block, passed = self.units.descend(unit)
        lo = block * self.block
        inside = int(np.flatnonzero(self.starts[lo : lo + self.block])[unit - passed])
        raw = np.frombuffer(self.data, np.uint8, inside, lo)
        return lo + inside, self.points.before(block) + int(np.count_nonzero((raw & 0xC0) != 0x80))


def assembled(form: str, prefix: str, middle: str, suffix: str) -> str:
    """The order of the parts in each form."""
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def _transformed(pattern: str | None):
    unit = re.compile(pattern) if pattern else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out: list[tuple] = []
                for t, a, b, plain, spm in zip(*(part.column(c).to_pylist() for c in ("text", "h1", "h2", "plain", "spm"))):
                    units = Units(t, unit)
                    if plain or not units.n:
                        out.append((units.n, "plain", None, None, t))
                        continue
                    lo, hi = sorted((a % (units.n + 1), b % (units.n + 1)))
                    (b1, p1), (b2, p2) = units.place(lo), units.place(hi)
                    parts = (x.decode("utf-8", "surrogatepass") for x in (units.data[:b1], units.data[b1:b2], units.data[b2:]))
                    form = "spm" if spm else "psm"
                    out.append((units.n, form, p1, p2 - p1, assembled(form, *parts)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                made = [pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", pattern: str | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row. pattern: what a unit is; none: a code point."""
    small_batches(docs.sparkSession, 512)
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    group = lambda i: F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), digest.alias("digest"))
    rows = rows.select(
        "doc_id", "text", group(0).alias("h1"), group(1).alias("h2"),
        ((F.length("text") == 0) | marked | (group(2) % 100 >= PLAIN_FROM)).alias("plain"), (group(3) % 100 < SPM_BELOW).alias("spm"),
    )
    out = [StructField("doc_id", rows.schema["doc_id"].dataType), StructField("n", LongType()), StructField("form", StringType())]
    out += [StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())]
    return rows.mapInArrow(_transformed(pattern), StructType(out))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: markers never overlap each other or a part's end, so the first of each ends the part before it."""
    rest = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    between = lambda text, after, until: F.substring_index(F.substring(text, F.locate(after, text) + len(after), F.length(text)), until, 1)
    tail = F.substring(rest, F.locate(MIDDLE, rest) + len(MIDDLE), F.length(rest))
    psm = F.concat(F.substring_index(rest, SUFFIX, 1), tail, between(rest, SUFFIX, MIDDLE))
    spm = F.concat(between(rest, PREFIX, MIDDLE), tail, F.substring_index(rest, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP12_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS b, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, ('0x' || d[1:8])::UBIGINT AS h1, ('0x' || d[9:16])::UBIGINT AS h2, ('0x' || d[17:24])::UBIGINT AS h3, ('0x' || d[25:32])::UBIGINT AS h4 FROM t),
f AS (SELECT *, CASE WHEN b = '' OR contains(b, '<P>') OR contains(b, '<S>') OR contains(b, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi FROM h),
p AS (SELECT *, substring(b, 1, lo) AS pre, substring(b, lo + 1, hi - lo) AS mid, substring(b, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN b WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
sha256(b) AS restored_sha256 FROM p
"""
