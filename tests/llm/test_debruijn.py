"""De Bruijn removal of shared passages against brute force."""

import random

import pytest

from ledgerloom.llm import debruijn

BLANK = " \t\n\r\x0b\x0c"


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANK:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute(rows, k=50):
    first = {}
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if i is not None and first[tuple(w[p : p + k])] < i:
                gone[p : p + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = debruijn.remove_repeats(df).collect()
    for r in got:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in got), key=repr)


def mixed(seed):
    rng = random.Random(seed)
    say = lambda n, v=2000: [f"w{rng.randrange(v)}" for _ in range(n)]
    passages = [say(n) for n in (50, 51, 63, 140, 400)]
    rows = []
    for i in range(90):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice([say(rng.randrange(80)), rng.choice(passages), rng.choice(passages)[rng.randrange(40) :], ["0"] * rng.randrange(200), say(60, 2)])
        blank = lambda: "".join(rng.choice(BLANK) for _ in range(rng.randint(1, 2)))
        rows.append((rng.choice([i, i, i, i // 2, None]), "".join(w + blank() for w in words)))
    rows += rows[:10] + [(500 + i, rows[20 + i][1]) for i in range(30)]
    rows += [(1, None), (2, ""), (3, " \n"), (None, None), (-5, rows[30][1]), (7, "é ü " * 60), (8, "é ü " * 55)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = mixed(seed)
    assert run(spark, rows) == brute(rows)


def test_dealt_keys(spark, monkeypatch):
    """Hot keys in pieces change nothing."""
    from ledgerloom.llm import common

    monkeypatch.setattr(common, "LEAST_PART", 2)
    monkeypatch.setattr(common, "HOT_PARTS", 40)
    rows = mixed(3)
    assert run(spark, rows) == brute(rows)


def test_equal_windows_have_equal_minimizers(monkeypatch):
    """Bundles cover each window once, whatever the ends of blocks, slices and bundles."""
    texts = [t for _, t in mixed(5)]
    whole = [debruijn.word_hashes(t) for t in texts]
    monkeypatch.setattr(debruijn, "AT_ONCE", 37)
    monkeypatch.setattr(debruijn, "MOST", 5)
    monkeypatch.setattr(debruijn, "_SLICE", 100)
    minimizer = {}
    for t, h in zip(texts, whole):
        assert (debruijn.word_hashes(t) == h).all()
        w, seen = split(t), []
        for mini, _, first, count in zip(*debruijn.bundles(h)):
            assert 0 < count <= 5
            for p in range(first, first + count):
                seen.append(p)
                assert minimizer.setdefault(tuple(w[p : p + 50]), mini) == mini
        assert seen == list(range(max(0, len(w) - 49)))


def test_one_passage_in_all(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, f"a{i} b{i} {passage} c{i}") for i in range(3000)]
    assert run(spark, rows) == sorted(((i, 73, 70 if i else 0, f"a{i} b{i} c{i}" if i else rows[0][1]) for i in range(3000)), key=repr)


def test_strings_as_ids_other_columns_and_no_rows(spark):
    text = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([("b", text, 1, "x"), ("a", text, 2, "y")], "key string, body string, h int, mini string")
    got = {r.doc_id: r.kept for r in debruijn.remove_repeats(df, "key", "body").collect()}
    assert got == {"a": text, "b": ""}
    assert debruijn.remove_repeats(df.limit(0), "key", "body").count() == 0


def test_false_match_stops_the_job(spark):
    """A span whose words are not those of its source (equal hashes of different words)."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, " ".join(["ab"] * 90)), (1, " ".join(["ab"] * 60 + ["cd"] * 60))], "id long, text string")
    rows = df.select("id", F.xxhash64("text").alias("h"), "text")
    packed = rows.mapInArrow(debruijn._packed, "id long, h long, z binary")
    h = {r.id: r.h for r in rows.collect()}
    spans = lambda words: spark.createDataFrame([(1, h[1], 5, words, 0, h[0], 10)], "id long, h long, start int, words int, sid long, sh long, at int")
    proof = lambda words: debruijn.proof(debruijn._by_text(packed, debruijn.lists_of(spans(words)), "left")).collect()
    assert proof(55) == []
    with pytest.raises(Exception, match="not the words of its source"):
        proof(56)
