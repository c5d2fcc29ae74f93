import random
from collections import Counter

import pytest

from ledgerloom.llm import suffix_dedup as sd

W = sd.WINDOW


def slow(texts):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[p : p + W] for d in datas for p in range(len(d) - W + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for p in range(len(d) - W + 1):
            if seen[d[p : p + W]] > 1:
                gone[p : p + W] = b"\1" * W
        spans, at = [], 0
        while (s := gone.find(1, at)) >= 0:
            e = gone.find(0, s)
            e = len(d) if e < 0 else e
            spans.append((s, e))
            at = e
        out.append((len(d), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "béta", "c", "delta-delta", "é", "ff", "0"])
    fresh = lambda n: " ".join(word() + str(rng.randrange(1000)) for _ in range(n))
    shared = [fresh(n) for n in (16, 20, 24, 30, 60, 200)]
    out = [None, "", "x" * 199, "x" * 200, "y" * 450, "ab" * 300, "z" * 201]
    for _ in range(50):
        parts = [fresh(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(max(1, len(s) // 3))
            parts += [s[a : len(s) - rng.randrange(max(1, len(s) // 3))], fresh(rng.randint(0, 20))]
        out.append(" ".join(parts))
    out += [out[20], out[21], out[21], shared[5] + shared[5], fresh(3000)]
    hot = shared[4]
    out += [fresh(10) + hot + fresh(5) for _ in range(60)]
    return out


def test_short_runs_are_merged_in_the_task(monkeypatch):
    import pyarrow as pa
    import zstandard

    monkeypatch.setattr(sd, "RUN", 64)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    datas = [(t or "").encode() for t in texts()]
    found = [sd.pack(*sd.anchors(d)[:3]) for d in datas]
    rows = [(i, d, a) for i, (d, a) in enumerate(zip(datas, found)) if len(a)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int64()), pa.array([zstandard.compress(r[1]) for r in rows]), pa.array([r[2].tolist() for r in rows], pa.list_(pa.int64()))],
        names=["id", "h", "z", "anchors"],
    )
    out = [r for b in sd._run_rows([batch]) for r in b.to_pylist()]
    places = {r["number"]: (r["id"], r["place"]) for r in out if r["blob"] is None}
    run = list(sd.decoded(out[-1]["blob"]))
    assert len(out) - 1 == sum(map(len, found)) > 300 and [x[1] for x in run] == sorted(x[1] for x in run)
    for _, key, d, _, number in run:
        i, p = places[number]
        assert datas[i][p : p + W - d] == key[: W - d]
    assert {x[4] for x in run} == set(places)


@pytest.mark.parametrize("range_size", [sd.RANGE, 60])
def test_removed_bytes_equal_brute_force(spark, range_size):
    all_ = texts()
    rows = [(i // 2 if i % 9 else None, t, i) for i, t in enumerate(all_)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int").repartition(5)
    got = sd.remove_repeats(df, range_size=range_size).collect()
    want = sorted((-1 if r[0] is None else r[0], n, s, k) for r, (n, s, k) in zip(rows, slow(all_)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got) == want
    assert sum(len(w[2]) for w in want) > 80


def test_loser_tree_gives_the_sorted_order_and_its_common_prefixes():
    rng = random.Random(1)
    for n in (1, 2, 3, 7):
        runs, all_ = [], []
        for r in range(n):
            keys = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))})
            runs.append((r, sd.front_code([(i, (k, 0, 0)) for i, k in enumerate(keys)])))
            all_ += [(k, r, i) for i, k in enumerate(keys)]
        got = list(sd.merged(runs))
        assert [(k, r, i) for _, k, _, _, r, i in got] == sorted(all_)
        before = b""
        for common, key, *_ in got:
            assert common == next((i for i, (x, y) in enumerate(zip(before, key)) if x != y), min(len(before), len(key)))
            before = key


def test_group_windows_by_pairs_and_by_counting_agree():
    rng = random.Random(2)
    for _ in range(40):
        right = bytes(rng.choice(b"ab") for _ in range(W))
        group = []
        for i in range(40):
            d = rng.randint(0, 3)
            r = bytearray(right[: W - d])
            if rng.random() < 0.7:
                at = rng.randrange(sd.REACH, len(r))
                r[at] = 120
            left = bytes(rng.choice(b"ab") for _ in range(rng.randint(d, 12)))
            group.append((0, bytes(r) + left, d, 0, 0, i))
        group.sort(key=lambda x: x[1:3])
        cover = lambda rows: {(n, d) for _, n, lo, hi in rows for d in range(lo, hi + 1)}
        want = set()
        for a in group:
            for b in group:
                for d in range(max(a[2], b[2]), 13):
                    (ra, la), (rb, lb) = sd._split(a[1], a[2]), sd._split(b[1], b[2])
                    if a[5] != b[5] and d <= min(len(la), len(lb)) and ra[: W - d] == rb[: W - d] and la[:d] == lb[:d]:
                        want.add((a[5], d))
        assert cover(sd.group_windows(group)) == want
        small = group[:20]
        some = cover(sd.group_windows(small))
        assert some <= want


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
