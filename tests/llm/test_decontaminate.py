import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate as dc


def slow_fit(item, doc):
    """Least edit distance of item to any stretch of doc, cell by cell."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(doc, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(words, share, rng, vocab):
    out = list(words)
    for _ in range(int(share * len(words))):
        k = rng.randrange(len(out))
        what = rng.random()
        if what < 0.5:
            out[k] = rng.choice(vocab)
        elif what < 0.75:
            del out[k]
        else:
            out.insert(k, rng.choice(vocab))
    return out


def made(seed=1):
    rng = random.Random(seed)
    common = ["the", "of", "and", "a", "in"]
    vocab = [f"w{i}" for i in range(400)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rng.choice(vocab)
    items = [[word() for _ in range(rng.randint(15, 57))] for _ in range(40)] + [["alpha", "beta", "gamma"], ["solo"]]
    docs, held = [], []
    for d in range(300):
        body = [word() for _ in range(rng.randint(0, 200))]
        if d % 3 == 0:
            k = rng.randrange(40)
            at = rng.randint(0, len(body))
            share = (0, 0.1, 0.2)[d // 3 % 3]
            body[at:at] = edited(items[k], share, rng, vocab)
            held.append((d, k, share))
        docs.append(body)
    docs[1] = ["x", "alpha", "beta", "gamma"]
    docs[2] = ["SOLO"]
    return items, docs, held


def test_fitting_distance_equals_cell_by_cell():
    rng = random.Random(8)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        d, s, e = dc.fitting_distance(np.array(a), np.array(b, np.int64))
        assert d == slow_fit(a, b)
        assert slow_fit(b[s:e], a) <= d and 0 <= s <= e <= len(b)
        many = dc.fitting_distances(np.array([a, a]), np.array([[*b, -1], [*b, -1]]))
        assert [x.tolist() for x in many] == [[d, d], [s, s], [e, e]]


def test_finds_planted_items_and_nothing_else(spark):
    items, docs, held = made()
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "  ")], "item_id long, text string")
    rows = [(d, ", ".join(w).title(), "x") for d, w in enumerate(docs)] + [(None, None, "y"), (None, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, items string")
    out = dc.with_items(df.select("doc_id", "text"), b).select("doc_id", F.inline("items")).collect()
    got = {(r.doc_id, r.item_id): r for r in out}
    truth = {(d, i) for d, w in enumerate(docs) for i, it in enumerate(items) if w and slow_fit(it, [x.lower() for x in w]) <= int(0.2 * len(it) + 1e-9)}
    assert set(got) <= truth
    exact = [(d, k) for d, k, share in held if share == 0]
    assert all(x in got for x in exact) and (1, 40) in got and (2, 41) in got
    assert len(got) >= 0.95 * len(truth), (len(got), len(truth))
    kept = {r.doc_id for r in dc.drop_contaminated(df, b).collect()}
    assert kept == set(range(300)) - {d for d, _ in got} | {None} and dc.drop_contaminated(df, b).columns == df.columns


def test_empty_tables_and_long_texts(spark):
    b = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30)))], "item_id long, text string")
    long = " ".join(["filler"] * 200_000) + " " + " ".join(f"Q{i}" for i in range(30))
    df = spark.createDataFrame([(7, long)], "doc_id long, text string")
    r = dc.with_items(df, b).select(F.inline("items")).collect()
    assert [(x.item_id, x.distance, x.start, x.end) for x in r] == [(1, 0, 7 * 200_000, len(long))]
    assert dc.with_items(df.limit(0), b).count() == 0
    assert dc.drop_contaminated(df, b.limit(0)).count() == 1


def test_groups_of_texts_are_whole_and_none_is_empty(monkeypatch):
    monkeypatch.setattr(dc, "AT_ONCE", 5)
    texts = ["a" * 30, None, "b c", "d" * 60]
    groups = list(dc._groups(texts))
    assert [t for g in groups for t in g] == texts and all(groups)
    index = dc.Index(["one two three", None], 0.8)
    assert index.search([]) == [] and index.search([None, "x"]) == [[], []] and dc.Index([], 0.8).search(["x"]) == [[]]


def test_edited_copies_of_every_length_are_found():
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(300)]
    items = [[rng.choice(vocab) for _ in range(n)] for n in range(1, 61)]
    index = dc.Index([" ".join(w) for w in items], 0.8)
    texts, want = [], []
    for k, item in enumerate(items):
        copies = [[*item[:at], *new, *item[at + 1 :]] for at in range(len(item)) for new in ([], ["other"])]  # each word alone deleted or replaced
        copies += [edited(item, 0.2, rng, ["other", *vocab]) for _ in range(20)]
        for copy in copies:
            body = [rng.choice(["x", "y"]) for _ in range(rng.randint(0, 9))]
            at = rng.randint(0, len(body))
            body[at:at] = copy
            texts.append(" ".join(body))
            want.append((k, body and slow_fit(item, body) <= int(0.2 * len(item) + 1e-9)))
    got = index.search(texts)
    assert all(any(f["item"] == k for f in found) for found, (k, held) in zip(got, want) if held)
    assert sum(bool(held) for _, held in want) > 4000


def test_recall_of_edited_copies_by_length():
    """A fifth of the words edited: recall of the embedding for each length, edited copies only; keys see the whole walk."""
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    for lo in range(5, 65, 10):
        items = [[rng.choice(vocab) for _ in range(n)] for n in range(lo, lo + 10)]
        index = dc.Index([" ".join(w) for w in items], 0.8)
        texts, want = [], []
        for k, item in enumerate(items):
            for _ in range(12):
                copy = edited(item, 0.2, rng, ["other", *vocab])
                if copy != item and slow_fit(item, copy) <= int(0.2 * len(item) + 1e-9):
                    texts.append(" ".join([*(rng.choice(vocab) for _ in range(rng.randint(0, 9))), *copy, *(rng.choice(vocab) for _ in range(rng.randint(0, 9)))]))
                    want.append(k)
        found = sum(any(f["item"] == k for f in got) for got, k in zip(index.search(texts), want))
        assert len(want) > 60 and found >= 0.95 * len(want), (lo, found, len(want))
    starts = {t.start for c in index.classes for t, _, _ in c[-1]}
    steps = [s / (2 * t.size) for c in index.classes for t, _, _ in c[-1] for s in t.steps]
    assert len(starts) > 20 and min(steps) < 0.05 and max(steps) > 0.95  # own starts; samples over the whole walk


def test_many_items_with_one_opening_cost_no_memory(monkeypatch):
    """Keys that many items and places share: pairs come in blocks."""
    monkeypatch.setattr(dc, "AT_ONCE", 1000)
    same = [f"s{i}" for i in range(12)]
    items = [" ".join([*same, f"a{i}", f"b{i}", f"c{i}"]) for i in range(300)]
    index = dc.Index(items, 0.8)
    text = " ".join(" ".join([*same, "x", "y", "z", "x"]) for _ in range(40)) + " " + items[17]
    ids = np.array([index.vocabulary.get(w, 0) for w in text.split()], np.int64)
    assert all(len(b) <= 1000 for b, _ in index.candidates(ids))
    found = index.search([text])[0]
    assert {f["item"] for f in found if f["distance"] == 0} == {17}
