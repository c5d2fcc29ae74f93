"""Fill-in-the-middle against brute force, and the Fenwick tree against plain sums."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fill_middle
from ledgerloom.llm.fill_middle import Fenwick, Units


def brute(doc_id, text):
    text = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_rows_against_brute_force(spark):
    rng = random.Random(3)
    alphabet = "ab <>PSM\n\té日😀\x00"
    texts = [None, "", "x", "<P>", "a<S>b", "<M", "é" * 5000, "日😀" * 3000, "<" * 50, "<S" * 40, "P>" * 40, "\n", "a" * 1024, "é" * 512]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(3000))) for _ in range(60)]
    texts += ["".join(rng.choice("ab é日😀<") for _ in range(rng.randrange(3000))) for _ in range(120)]
    rows = [(rng.choice([i, None, -i]), t) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fill_middle.transform(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made), key=repr)
    want = sorted((brute(i, t) for i, t in rows), key=repr)
    assert got == want
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert sorted(r.back for r in made) == sorted(t or "" for _, t in rows)


def test_no_rows_and_other_columns(spark):
    df = spark.createDataFrame([("k", "some text", 1, "x", 2)], "key string, body string, n int, form string, h1 int")
    assert fill_middle.transform(df, "key", "body").first().n == 9
    assert fill_middle.transform(df.limit(0), "key", "body").count() == 0


@pytest.mark.parametrize("size", [0, 1, 2, 3, 7, 8, 9, 100])
def test_fenwick(size):
    rng = np.random.default_rng(size)
    counts = rng.integers(0, 4, size)
    tree = Fenwick(counts)
    for _ in range(20):
        if size:
            b, more = int(rng.integers(size)), int(rng.integers(3))
            tree.add(b, more)
            counts[b] += more
        sums = np.concatenate(([0], np.cumsum(counts)))
        assert [tree.before(i) for i in range(size + 1)] == sums.tolist()
        owner = np.repeat(np.arange(size), counts)
        for nth, block in enumerate(owner.tolist()):
            assert tree.descend(nth) == (block, sums[block])
        assert tree.descend(int(sums[-1])) == (size, sums[-1])


@pytest.mark.parametrize("block", [1, 2, 3, 5, 1024])
def test_places_of_units(block):
    rng = random.Random(block)
    for _ in range(40):
        text = "".join(rng.choice("ab  é日😀\n") for _ in range(rng.randrange(60)))
        points = Units(text, None, block)
        assert points.n == len(text)
        assert [points.place(i) for i in range(len(text) + 1)] == [(len(text[:i].encode()), i) for i in range(len(text) + 1)]
        words = Units(text, re.compile(r"\S+"), block)
        at = [m.start() for m in re.finditer(r"\S+", text)]
        assert words.n == len(at)
        at = [0, *at[1:], len(text)] if at else [len(text)]
        assert [words.place(i) for i in range(words.n + 1)] == [(len(text[:p].encode()), p) for p in at]


def test_words_as_units(spark):
    """Cuts fall at words, and the text is rebuilt."""
    texts = [(i, " ".join(f"w{j}" for j in range(i))) for i in range(40)]
    made = fill_middle.transform(spark.createDataFrame(texts, "doc_id long, text string"), pattern=r"\S+")
    for r in made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect():
        assert r.back == texts[r.doc_id][1] and r.n == r.doc_id
        if r.form != "plain":
            text = texts[r.doc_id][1]
            assert all(p == len(text) or p == 0 or text[p - 1] == " " for p in (r.prefix_chars, r.prefix_chars + r.middle_chars))


def test_very_long_text(spark):
    text = "é日a " * 500_000
    made = fill_middle.transform(spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made) == sorted(brute(i, text) for i in range(6))
