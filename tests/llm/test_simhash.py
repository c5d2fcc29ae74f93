import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.components import connected_components


def slow_fingerprint(text, words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, radius=4):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(ids[i]), find(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "ſ", "x y"]
    texts = ["", None, "   ", "One", "one", "a b c", "A\tB\nC"]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(5, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(words)
            texts.append("  ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    texts.append(" ".join(rng.choice(words) for _ in range(60_000)))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    fps = {i: slow_fingerprint(t, 4) for i, t in rows}
    assert {i: r.fp for i, r in got.items()} == {i: signed(f) for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_components(list(fps), list(fps.values()))


def test_links_join_all_that_brute_force_joins_in_hot_bands_and_tiles(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = set()
    for spread in (2, 6, 12):
        for _ in range(250):
            x = centre
            for _ in range(rng.randint(0, spread)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(100)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = slow_components(fps, fps)
    groups = sorted(sorted(signed(f) for f in fps if want[f] == c) for c in set(want.values()) if sum(want[f] == c for f in fps) > 1)
    for tile in (1 << 15, 50):
        comp = connected_components(simhash.links(frame, tile)).collect()
        got = {}
        for r in comp:
            got.setdefault(r.component, []).append(r.node)
        assert sorted(sorted(g) for g in got.values()) == groups


def test_near_lanes_equal_popcount_for_every_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    fps = np.concatenate([base, near, near ^ np.uint64(0xF0)])
    i = np.arange(len(fps))
    for fps in (fps[:, None], np.stack([fps, np.roll(base, 1).repeat(3)], axis=1)):
        planes, used = simhash.bit_planes(fps, i // 64, i % 64, len(fps) // 64 + 1)
        distance = lambda a, b: sum(int(x ^ y).bit_count() for x, y in zip(fps[a], fps[b]))  # noqa: B023, E731
        for radius in (0, 1, 3, 4, 6, 30, 62):
            for q in (0, 250, 599):
                at, words = simhash.near_lanes(np.repeat(fps[q : q + 1], len(used), axis=0), np.arange(len(used)), planes, used, radius)
                row, lane = simhash._lanes_of(words)
                assert sorted((at[row] * 64 + lane).tolist()) == [k for k in range(len(fps)) if distance(k, q) <= radius]


def jaccard(a, b):
    a, b = (set(zip(*[t.lower().split()[i:] for i in range(5)])) for t in (a, b))
    return len(a & b) / len(a | b)


def test_similar_texts_are_found_and_others_stay(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, truth = [], []
    for i in range(150):
        base = [word() for _ in range(rng.randint(60, 400))]
        rows.append((1000 + i, " ".join(base)))
        other = list(base)
        for _ in range(max(1, len(base) // rng.choice([45, 60, 100, 200]))):
            other[rng.randrange(len(other))] = word()
        rows.append((i, " ".join(other)))
        truth.append(jaccard(rows[-1][1], rows[-2][1]))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(150)) <= kept
    near = [i for i in range(150) if truth[i] >= 0.8]
    assert len(near) > 50 and sum(1000 + i not in kept for i in near) >= 0.95 * len(near)
    assert all(1000 + i in kept for i in range(150) if truth[i] < 0.6)


def test_filler_does_not_fold_texts_and_repeated_passages_do_not_part_them(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(i, "0 " * 200 + say(60)) for i in range(6)]  # one shingle is more than half of the text, the rest differs
    passage, rest = say(60), say(40)
    rows += [(10, f"{passage} {rest} {passage}"), (11, " ".join([passage, rest, *[passage] * 10]))]
    # besides the seam of two passages both have the same shingles
    assert jaccard(rows[0][1], rows[1][1]) < 0.1 and jaccard(rows[6][1], rows[7][1]) > 0.95
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 1, 2, 3, 4, 5, 10}


def test_links_follow_exact_similarity_around_the_threshold(spark):
    rng = random.Random(13)
    rows, truth = [], []
    for i in range(200):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(80, 200))]
        cut = int(len(base) * rng.uniform(0.68, 0.9))  # the first words: similarities on both sides of 0.8
        rows += [(i, " ".join(base[:cut])), (1000 + i, " ".join(base))]
        truth.append(jaccard(rows[-1][1], rows[-2][1]))
    for i in range(200, 260):  # 5 against 4 shingles
        base = [f"s{i}x{k}" for k in range(9)]
        rows += [(i, " ".join(base[:8])), (1000 + i, " ".join(base))]
        truth.append(0.8)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(1000 + i in kept for i, t in enumerate(truth) if t < 0.8)
    near = [i for i, t in enumerate(truth) if t >= 0.8]
    assert sum(0.65 < t < 0.8 for t in truth) > 60 and sum(1000 + i not in kept for i in near) >= 0.98 * len(near)


def test_large_groups_link_all_exact_pairs_and_no_others(spark, monkeypatch):
    rng = random.Random(17)
    base = [f"w{i}" for i in range(240)]
    texts = []
    for _ in range(70):  # one template, tails of different lengths: pairs on both sides of 0.8
        n = rng.choice([10, 25, 45, 60, 75])
        texts.append(" ".join(base + [f"x{rng.randrange(10**6)}" for _ in range(n)]))
    sets = [{t for t in zip(*[x.split()[k:] for k in range(5)])} for x in texts]
    near = [[len(a & b) / len(a | b) >= 0.8 for b in sets] for a in sets]
    want = list(range(70))
    for i in range(70):
        for j in range(i):
            if near[i][j] and want[i] != want[j]:
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    assert 5 < len(set(want)) < 60
    order = F.struct(F.lit(False).alias("no_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("row"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(order.alias("place"), "text")
    for size in (1 << 11, 20):
        monkeypatch.setattr(simhash, "EXACT_TILE", size)
        got = {r.place.id: r.first.id for r in simhash.similar_groups(df, "place", "text").collect()}
        assert [got[i] for i in range(70)] == want


def test_hot_groups_of_similar_texts_keep_one_row(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(200):
        other = list(base)
        other[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(other)))
    order = F.struct(F.lit(False).alias("no_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("row"))
    df = spark.createDataFrame(rows, "doc_id long, text string").select(order.alias("place"), "text")
    for tile in (1 << 15, 30):
        assert {r.first.id for r in simhash.similar_groups(df, "place", "text", tile=tile).collect()} == {0}


def test_keep_one_keeps_one_row_of_each_group_and_all_columns(spark):
    rows = [(1, "a b c d e f", 7), (2, "a b c d e f", 8), (2, "a b c d e f", 8), (None, "a b c d e f", 9), (None, "z y x w v u t", 1), (5, None, 2), (6, "", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int").withColumn("row", F.lit(1))
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1, r.place) for r in out.collect()) == [(-1, 1), (1, 7), (5, 2)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000, 2000), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(300)}}


def _joined(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("n,centers,flip", [(300, 1, 0.15), (300, 300, 0.2), (200, 5, 0.14), (130, 40, 0.13), (65, 1, 0.0), (1, 1, 0.0)])
def test_wide_groups_join_what_all_pairs_join(n, centers, flip):
    rng = np.random.default_rng(n + centers)
    bits = rng.integers(0, 2, (centers, 512))[rng.integers(0, centers, n)] ^ (rng.random((n, 512)) < flip)
    fps = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    apart = (bits[:, None, :] != bits[None]).sum(2)
    for radius in (131, 100, 16):
        got = [(int(a), int(b)) for u, v in simhash._wide_group(fps, radius) for a, b in zip(u, v)]
        assert all(a != b and apart[a, b] <= radius for a, b in got)
        assert _joined(n, got) == _joined(n, zip(*(x.tolist() for x in np.nonzero(apart <= radius))))
        assert len(got) <= 2 * n + 64 * 64


def test_exact_search_joins_what_exact_pairs_join():
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 40, (4, 60))
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.06, 0.2]), rng.integers(1, 1 << 40, 60), base[i % 4])) for i in range(150)]
    same = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in sets] for a in sets]
    zero = [0] * simhash.WORDS  # the fingerprint proposes every pair, the sets decide
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 150), pa.array([7] * 150), pa.array([0] * 150), pa.array(range(150)), pa.array([zero] * 150), pa.array(range(150)), pa.array([s.tolist() for s in sets])],
        names=["band", "key", "pair", "node", "words", "component", "set"],
    )
    got = [(u, v) for out in simhash._exact_links(131, 0.8)(iter([batch])) for u, v in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
    assert all(same[u][v] for u, v in got)
    want = _joined(150, [(i, j) for i in range(150) for j in range(i) if same[i][j]])
    assert _joined(150, got) == want and len(got) == 150 - len(set(want)) and 1 < len(set(want)) < 150
