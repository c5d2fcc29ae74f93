"""Operators on small fixtures, against brute force where there is no SQL."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import clock, text
from ledgerloom.operators import clusters, correlate, features, ingest, outliers, quality, spread, validate
from ledgerloom.operators.graph import Graph, shortest_path
from ledgerloom.sources import correlation_files as cf
from ledgerloom.sources import ledger_files as lf


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn("v").alias("x")).first().x


def test_scalar_rules(spark):
    assert one(spark, "100234.0", text.norm_txid) == "100234"
    assert one(spark, "1", clock.to_epoch) == 10800.0
    assert one(spark, "bad", clock.to_epoch) is None
    assert one(spark, "[10.5, 20.0]", text.split_amounts) == [10.5, 20.0]
    assert one(spark, "invalid", text.split_amounts) == []
    assert one(spark, "a;b | c", text.split_list) == ["a", "b | c"]


def test_quantiles_agree_on_both_paths(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([1.0, 2.0, rng.random() * 50])) for k in "ab" for _ in range(150)]
    df = spark.createDataFrame(rows, "k string, v double")
    for limit in (5, 10_000):
        got = {r.k: (r.m, r.p) for r in spread.quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.9}, limit).collect()}
        for k in "ab":
            want = np.quantile([v for kk, v in rows if kk == k], [0.5, 0.9])
            assert np.allclose(got[k], want)


def test_neighbours_and_gaps(spark):
    rng = random.Random(5)
    times = sorted({rng.randrange(300_000_000_000) for _ in range(60)} | {rng.randrange(2_000_000) for _ in range(20)})
    marks = {t for t in times if rng.random() < 0.3}
    df = spark.createDataFrame([("k", t, t in marks) for t in times], "k string, t long, o boolean")
    got = spread.around(df.withColumn("m", F.when(F.col("o"), F.struct("t"))), ["k"], "t", "m").collect()
    assert len(got) == len(times)
    for r in got:
        before = max((m for m in marks if m <= r.t), default=None)
        after = min((m for m in marks if m >= r.t), default=None)
        assert (r.mark_before.t if r.mark_before else None) == before
        assert (r.mark_after.t if r.mark_after else None) == after
    g = spread.gap_range(df.withColumn("n", F.lit(1)), ["k"], "t", "n").first()
    assert np.allclose([g.min_gap_s, g.max_gap_s], [np.diff(times).min() / 1e6, np.diff(times).max() / 1e6])


def test_window_match_and_ties(spark):
    obs = spark.createDataFrame(
        [(1, "t", 30_000_000, "a", 1, "d", 1, None), (2, "t", 90_000_000, "b", 1, "d", 1, None), (3, "t", 30_000_000, "c", 1, "d", 1, None)],
        "obs_id long, network_timestamp string, obs_us long, src_ip string, src_port int, dst_ip string, dst_port int, network_txid string",
    )
    tx = spark.createDataFrame([("x", 0), ("tie", 60_000_000), ("edge", 210_000_000), ("far", 210_000_001)], "txid string, ts_us long")
    got = {r.txid: r for r in correlate.join_network(tx, obs).collect()}
    assert (got["x"].network_confidence, got["x"].src_ip) == (0.75, "a")
    assert got["tie"].src_ip == "a"
    assert (got["edge"].correlation_method, got["edge"].network_confidence) == ("timestamp_window", 0.0)
    assert got["far"].correlation_method == "none"


def test_wallet_union(spark):
    tx = spark.createDataFrame([("TX999", ["W_IN_1"], ["W_OUT_3"])], "txid string, input_addresses array<string>, output_addresses array<string>")
    edges = spark.createDataFrame([("TX999", "IN", "W_IN_1"), ("TX999", "IN", "W_IN_2"), ("TX999", "OUT", "W_OUT_1"), ("TX999", "OUT", "W_OUT_2")], "txid string, side string, address string")
    labels = cf.labels(spark.createDataFrame([("TX999", "1", 0)], "k string, c string, p int"), "k", "c", "p")
    out, links = correlate.join_wallets(tx, edges, labels, labels)
    r = out.first()
    assert (r.wallet_count, r.tx_class) == (5, "illicit")
    assert out.first().wallet_count == links.select("address").distinct().count() and links.count() == 5


def test_ledger_files_and_quality(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text(
        "txid,timestamp,input_addresses,output_addresses,input_amounts,output_amounts\n"
        "TX_A,2024-01-01T00:00:00Z,w_1,w_2;w_3,5.0,2.5;2.499\nTX_B,2024-01-01T01:00:00Z,w_2,w_4,1,1\n"
        "TX_A,2024-01-01T02:00:00Z,w_1,w_2,5,5\nTX_C,2024-01-01T03:00:00Z,w_3,w_1,2,2\n"
    )
    led = ingest.ingest(lf.read_ledger_csv(spark, str(p)))
    q = quality.quality_report(led).first()
    assert (q.total_records, q.valid_records, q.duplicate_records, q.unique_wallets) == (4, 3, 1, 4)
    peers = {r.address: r.unique_counterparties for r in features.counterparties(led.legs).collect()}
    assert peers["w_1"] == 2
    rec = '{"txid":"TX_J","input_addresses":["a1x"],"outputs":"b1x;b2x"}'
    for name, body, n in (("a", f"[{rec},\n{rec}]", 2), ("w", f'{{"data": [{rec}]}}', 1), ("n", f"{rec}\nnot json\n{rec}\n", 2)):
        f = tmp_path / f"{name}.json"
        f.write_text(body)
        rows = lf.read_ledger_json(spark, str(f)).collect()
        assert len(rows) == n and rows[0].output_addresses == ["b1x", "b2x"], name
    x = tmp_path / "t.xml"
    x.write_text("<transactions><transaction><txid>TX_X</txid><inputs><address>w1</address></inputs><outputs>w2;w3</outputs></transaction></transactions>")
    r = lf.read_ledger_xml(spark, str(x)).first()
    assert (r.input_addresses, r.output_addresses) == (["w1"], ["w2", "w3"])
    x.write_text("<transactions><unclosed_tag>")
    with pytest.raises(lf.FileFormatError):
        lf.read_ledger_xml(spark, str(x))


def test_top_legs_in_record(spark):
    n = 60
    raw = spark.createDataFrame(
        [("TRANSACTION", "TX_BIG", "2024-01-01", "0", "P2PKH", ["w_in"], [f"w{i:03d}" for i in range(n)], ["99"], [str(i) for i in range(n)], None, None, None, None, None, None, None, None, "f", 1)],
        "record_type string, txid string, timestamp string, fee string, script_type string, input_addresses array<string>, output_addresses array<string>, input_amounts array<string>, output_amounts array<string>, "
        "src_ip string, dst_ip string, src_port string, dst_port string, geo_country string, asn string, address string, class string, src_file string, src_pos long",
    )
    assert ingest.ingest(raw).legs.filter("direction = 'OUT'").count() == n  # no cut unless asked for
    led = ingest.ingest(raw, keep_legs=50)
    outs = led.legs.filter("direction = 'OUT'")
    assert outs.count() == 50 and outs.agg(F.min("amount")).first()[0] == 10.0
    assert led.transactions.first().output_total == sum(range(n))


def test_dbscan_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = np.vstack([rng.normal(0, 0.2, (60, 2)), rng.normal(3, 0.2, (60, 2)), rng.uniform(-2, 5, (30, 2))])
    df = spark.createDataFrame([(f"p{i:03d}", float(a), float(b)) for i, (a, b) in enumerate(pts)], "address string, a double, b double")
    got = {r.address: r.cluster_label for r in clusters.dbscan(df, ["a", "b"], "address", 0.3, 3).collect()}
    near = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2)) <= 0.3
    core = near.sum(1) >= 3
    label, nxt = np.full(len(pts), -1), 0
    for i in range(len(pts)):
        if core[i] and label[i] < 0:
            todo, label[i] = [i], nxt
            while todo:
                j = todo.pop()
                for m in np.flatnonzero(near[j] & core & (label < 0)):
                    label[m] = nxt
                    todo.append(m)
            nxt += 1
    for i in np.flatnonzero(~core):
        c = label[near[i] & core]
        label[i] = c.min() if len(c) else -1
    assert [got[f"p{i:03d}"] for i in range(len(pts))] == label.tolist()


def test_forest_and_lof_rank_planted_outliers(spark):
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(0, 1, (200, 3)), [[9, 9, 9], [-9, 9, -9], [12, 0, 12]]])
    df = spark.createDataFrame([(f"p{i:03d}", *map(float, p)) for i, p in enumerate(pts)], "address string, a double, b double, c double")
    scored = outliers.detect(df, ["a", "b", "c"], "address").collect()
    top = {r.address for r in sorted(scored, key=lambda r: -r.anomaly_score)[:3]}
    assert top == {"p200", "p201", "p202"} and 0 <= min(r.anomaly_score for r in scored) <= max(r.anomaly_score for r in scored) == 1
    dens = {r.address: r.raw_score for r in outliers.lof(df, ["a", "b", "c"], "address", 20).collect()}
    assert set(sorted(dens, key=dens.get)[-3:]) == top


def _verdict(spark, current, base):
    cur = spark.createDataFrame([("e", 0.9, *current)], "address string, anomaly_score double, " + ", ".join(f"{c} double" for c in validate.CURRENT))
    b = spark.createDataFrame([("e", *base)], "address string, has_sufficient_history boolean, observation_count long, profile_reliability string, median_output_amount double, avg_output_amount double, std_amount double, max_amount double, avg_velocity_per_hour double, min_velocity_per_hour double, max_velocity_per_hour double, avg_time_between_txs_sec double, counterparties_count long")
    return validate.validate(cur, b).first()


def test_validation_scenarios(spark):
    base = (True, 20, "HIGH", 1.0, 1.0, 0.2, 1.5, 1.0, 0.5, 1.5, 3600.0, 3)
    strong = _verdict(spark, (25.0, 12.0, 18.0, 60.0, 5.0, 3.0, 3.0), base)
    assert strong.validation_score >= 0.75 and strong.confidence >= 0.80 and not strong.counter_evidence
    calm = _verdict(spark, (1.0, 1.0, 3.0, 3600.0, 1.0, 1.0, 1.0), base)
    assert calm.validation_score <= 0.35 and calm.confidence <= 0.45
    new = _verdict(spark, (5.0, 1.0, 3.0, 3600.0, 1.0, 1.0, 1.0), (False, 1, "INSUFFICIENT_HISTORY", *([None] * 8), 0))
    assert new.confidence == 0.35 and len(new.counter_evidence) == 1


def test_shortest_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "e"), ("e", "c")], "src string, dst string").withColumn("type", F.lit("x"))
    v = spark.createDataFrame([(x, "WALLET") for x in "abcdez"], "id string, type string")
    path = {r.id: r.path_pos for r in shortest_path(Graph(v, e), "a", "c").vertices.collect()}
    assert {k: p for k, p in path.items() if p is not None} == {"a": 0, "b": 1, "c": 2}
    assert shortest_path(Graph(v, e), "a", "z").vertices.count() == 0


def test_path_of_twenty_hops_and_a_bound(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)], "src string, dst string").withColumn("type", F.lit("x"))
    v = spark.createDataFrame([(f"n{i:02d}", "WALLET") for i in range(21)], "id string, type string")
    path = {r.id: r.path_pos for r in shortest_path(Graph(v, e), "n00", "n20").vertices.collect()}
    assert path == {f"n{i:02d}": i for i in range(21)}
    with pytest.raises(RuntimeError, match="within 3 rounds"):
        shortest_path(Graph(v, e), "n00", "n20", max_rounds=3)


def _points(seed, n, dims):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 0.3, (n // 2, dims)), rng.normal(3, 0.2, (n // 4, dims)), rng.uniform(-6, 6, (n // 4, dims))]).round(1)
    return np.concatenate([x, x[:20], x[:20]])


def test_outlier_factor_equals_brute_force_with_repeated_points(spark):
    x = _points(1, 160, 2)
    names = [f"k{i:03d}" for i in range(len(x))]
    df = spark.createDataFrame([(n, *map(float, p)) for n, p in zip(names, x)], "address string, a double, b double")
    got = {r.address: r.raw_score for r in outliers.lof(df, ["a", "b"], "address", 7).collect()}
    distinct, first, weight = np.unique(x, axis=0, return_index=True, return_counts=True)
    pid = [names[i] for i in first]
    d = np.sqrt(((distinct[:, None] - distinct[None]) ** 2).sum(axis=2)).round(9)
    near = []
    for i in range(len(distinct)):
        row, left = [], 7
        for j in sorted(range(len(distinct)), key=lambda j: (d[i, j], pid[j])):
            take = min(left, int(weight[j]) - (i == j))
            if take > 0:
                row.append((j, take))
                left -= take
        near.append(row)
    kd = [max(d[i, j] for j, _ in row) for i, row in enumerate(near)]
    dens = [1 / (sum(max(d[i, j], kd[j]) * t for j, t in row) / sum(t for _, t in row) + 1e-10) for i, row in enumerate(near)]
    want = [sum(dens[j] * t for j, t in row) / sum(t for _, t in row) / dens[i] for i, row in enumerate(near)]
    by_point = {tuple(p): w for p, w in zip(distinct, want)}
    assert len(got) == len(x)
    for n, p in zip(names, x):
        assert abs(got[n] - by_point[tuple(p)]) <= 1e-6 * max(1, abs(by_point[tuple(p)]))


def test_dbscan_equals_brute_force(spark, monkeypatch):
    for name, rows in (("PIVOTS", 4), ("LEAF", 20), ("GROUP", 15)):
        monkeypatch.setattr(f"ledgerloom.operators.metric_cells.{name}", rows)
    x = _points(2, 240, 2)
    names = [f"k{i:03d}" for i in range(len(x))]
    df = spark.createDataFrame([(n, *map(float, p)) for n, p in zip(names, x)], "address string, a double, b double")
    got = {r.address: r.cluster_label for r in clusters.dbscan(df, ["a", "b"], "address", 0.3, 4).collect()}
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).round(9) <= 0.3
    core = near.sum(axis=1) >= 4
    comp = np.where(core, np.arange(len(x)), len(x))
    for _ in range(len(x)):
        comp = np.where(core, np.where(near & core[None], comp[None], len(x)).min(axis=1), len(x))
    roots = {c: i for i, c in enumerate(sorted(set(comp[core]), key=lambda c: names[c]))}
    want = {}
    for i, n in enumerate(names):
        labels = [roots[comp[j]] for j in np.flatnonzero(near[i] & core)]
        want[n] = roots[comp[i]] if core[i] else min(labels, default=-1)
    assert got == want and len(roots) >= 2 and -1 in want.values()


def test_third_of_all_points_in_one_ball(spark, monkeypatch):
    """Dense balls are dealt on both sides, and a ball within the reach is not compared pair by pair."""
    from ledgerloom.operators import metric_cells as mc

    for name, rows in (("PIVOTS", 6), ("LEAF", 40), ("GROUP", 32)):
        monkeypatch.setattr(mc, name, rows)
    sizes = []
    real = mc.met

    def watched(askers, members, keys, name, fn, schema):
        out = real(askers, members, keys, name, fn, schema)
        for side, part in ((askers, "pid"), (members, name)):
            counts = side.groupBy(*keys).count()
            counts = side.join(counts, keys).withColumn("p", F.pmod(F.xxhash64(part), F.ceil(F.col("count") / mc.GROUP)))
            sizes.append((counts.groupBy(*keys, "p").count().agg(F.max("count")).first()[0] or 0, side.count()))
        return out

    monkeypatch.setattr(mc, "met", watched)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.02, (300, 3)), rng.uniform(-4, 4, (400, 3)), rng.normal(2, 0.1, (200, 3))])
    names = [f"k{i:03d}" for i in range(len(x))]
    df = spark.createDataFrame([(n, *map(float, p)) for n, p in zip(names, x)], "address string, a double, b double, c double")
    got = {r.address: r.cluster_label for r in clusters.dbscan(df, ["a", "b", "c"], "address", 0.3, 4).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).round(9)
    core = (d <= 0.3).sum(axis=1) >= 4
    comp = np.where(core, np.arange(len(x)), len(x))
    for _ in range(60):
        comp = np.where(core, np.where((d <= 0.3) & core[None], comp[None], len(x)).min(axis=1), len(x))
    roots = {c: i for i, c in enumerate(sorted(set(comp[core]), key=lambda c: names[c]))}
    for i, n in enumerate(names):
        labels = [roots[comp[j]] for j in np.flatnonzero((d[i] <= 0.3) & core)]
        assert got[n] == (roots[comp[i]] if core[i] else min(labels, default=-1))
    k = 9
    points = mc.folded(df, ["a", "b", "c"], "address")
    near = {}
    for r in mc.nearest_points(points, k).collect():
        near.setdefault(r.pid, []).append((r.distance, r.other))
    for i, n in enumerate(names):
        want = sorted((d[i, j], names[j]) for j in range(len(x)) if j != i)[:k]
        assert sorted(near[n]) == want
    assert sizes and max(n for n, _ in sizes) <= 3 * mc.GROUP  # a hash deals unevenly, never without a bound
    assert max(total for _, total in sizes) > 600


def test_clusters_are_numbered_without_a_global_window(spark):
    from ledgerloom.operators.metric_cells import numbered

    keys = [f"k{i * 7919 % 1000:04d}" for i in range(1000)]
    got = {r.k: r.n for r in numbered(spark.createDataFrame([(k,) for k in keys], "k string").repartition(9), "k", "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    assert numbered(spark.createDataFrame([], "k string"), "k", "n").count() == 0


def _brute_peers(legs):
    sides = {}
    for t, d, a in legs:
        sides.setdefault((t, d), set()).add(a)
    out = {}
    for t, d, a in legs:
        out.setdefault(a, set()).update(sides.get((t, "OUT" if d == "IN" else "IN"), ()))
    return {a: len(p - {a}) for a, p in out.items() if p - {a}}


def test_counterparties_equal_pairs(spark, monkeypatch):
    from ledgerloom.operators import features, peers

    monkeypatch.setattr(peers, "PART", 3)
    rng = np.random.default_rng(6)
    legs = [(f"t{rng.integers(40)}", str(rng.choice(["IN", "OUT"])), f"a{rng.integers(25)}") for _ in range(400)]
    legs += [(t, d, a) for t in ("u1", "u2", "u3") for d, ids in (("IN", range(30)), ("OUT", range(20, 60))) for a in (f"b{i}" for i in ids)] + legs[:20]
    df = spark.createDataFrame(legs, "txid string, direction string, address string")
    got = {r.address: r.unique_counterparties for r in features.counterparties(df).collect()}
    assert got == _brute_peers(legs)
    assert features.counterparties(df.limit(0)).count() == 0


def test_counterparties_of_a_wide_transaction_cost_no_pairs(spark):
    """5,000 x 5,000 legs in three transactions: 25 million pairs, of which none are made."""
    from ledgerloom.operators import features, peers

    legs = spark.range(10_000).selectExpr("id", "IF(id < 5000, 'IN', 'OUT') AS direction", "concat('w', id) AS address")
    legs = legs.crossJoin(spark.createDataFrame([("x",), ("y",)], "txid string")).unionByName(
        legs.filter("id < 4000 OR id >= 6000").withColumn("txid", F.lit("z"))
    )
    counts = features.counterparties(legs)
    assert [tuple(r) for r in counts.groupBy("unique_counterparties").count().collect()] == [(5000, 10_000)]
    other = F.when(F.col("direction") == "IN", "OUT").otherwise("IN")
    mine = legs.select("address", "txid", "direction").distinct()
    sets = legs.select("txid", other.alias("direction"), F.col("address").alias("peer")).distinct()
    faced, named = peers._sets(mine, sets, ["txid", "direction"])
    family = peers.families(faced)
    assert family.select("family").distinct().count() == 4 and faced.count() == 18_000
    assert peers.unfolded(family, faced, named, sets, ["txid", "direction"]).count() == 10_000  # two families of two sets


def test_counterparties_of_small_and_large_sets_together(spark, monkeypatch):
    from ledgerloom.operators import features, peers

    monkeypatch.setattr(peers, "SMALL", 4)
    monkeypatch.setattr(peers, "PART", 3)
    rng = np.random.default_rng(8)
    legs = [(f"t{rng.integers(120)}", str(rng.choice(["IN", "OUT"])), f"a{rng.integers(40)}") for _ in range(500)]
    legs += [(t, d, f"a{i}") for t in ("u1", "u2") for d, ids in (("IN", range(12)), ("OUT", range(8, 30))) for i in ids] + legs[:20]
    legs += [("v", "IN", "one"), *[("v", "OUT", f"p{i}") for i in range(9)], ("w", "IN", "one"), ("w", "OUT", "p3"), ("w", "OUT", "one"), ("w", "OUT", "q")]
    df = spark.createDataFrame(legs, "txid string, direction string, address string")
    got = {r.address: r.unique_counterparties for r in features.counterparties(df).collect()}
    assert got == _brute_peers(legs) and got["one"] == 10


def test_counterparties_of_small_transactions_write_no_copies(spark, monkeypatch):
    """Legs of ordinary transactions were written out several times, with sets and families, before they were counted."""
    from ledgerloom.operators import features, peers

    written, cut = [], peers.cut
    monkeypatch.setattr(peers, "cut", lambda df: written.append(df.count()) or cut(df))
    legs = [(f"t{i}", d, f"{d}{(i * 7 + j) % 50}") for i in range(200) for d, n in (("IN", 1), ("OUT", 4)) for j in range(n)]
    df = spark.createDataFrame(legs, "txid string, direction string, address string")
    got = {r.address: r.unique_counterparties for r in features.counterparties(df).collect()}
    assert got == _brute_peers(legs) and sum(written) == 0


def test_counterparties_of_missing_ids_and_both_sides(spark):
    """A missing address is a peer and none of its own; a pair counts once, whichever side each wallet is on."""
    from ledgerloom.operators import features

    legs = [("t1", "IN", "a"), ("t1", "OUT", "b"), ("t1", "OUT", "a"), ("t1", "OUT", None), ("t2", "IN", "b"), ("t2", "OUT", "a"), ("t2", "IN", None), (None, "IN", "a"), (None, "OUT", "z")]
    df = spark.createDataFrame(legs + legs[:3], "txid string, direction string, address string")
    got = {r.address: r.unique_counterparties for r in features.counterparties(df).collect()}
    assert got == {"a": 2, "b": 1}


def test_wallet_features_shuffle_each_leg_few_times(spark, capsys):
    """Pairs went both ways, legs were dealt anew for each join, and each network cell was tripled for three distinct counts."""
    from ledgerloom.operators import features

    legs = spark.createDataFrame([("t", "IN", "a", 1.0), ("t", "OUT", "b", 1.0)], "txid string, direction string, address string, amount double")
    tx = spark.createDataFrame([("t", "2024-01-01")], "txid string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    obs = spark.createDataFrame([("t", "1.1.1.1", "FR", "AS1")], "txid string, src_ip string, country string, asn string")
    f = features.wallet_features(tx, legs, obs)
    f.explain()
    shown = capsys.readouterr().out
    assert "Expand" not in shown and shown.count("Exchange") <= 16
    assert [(r.address, r.unique_counterparties, r.graph_degree, r.unique_observed_ips, r.unique_countries, r.foreign_geo_entropy) for r in f.orderBy("address").collect()] == [("a", 1, 2, 1, 1, 0), ("b", 1, 2, 1, 1, 0)]


def test_wallet_features_fold_legs_per_transaction_once(spark, monkeypatch):
    """They were folded once to count a wallet's transactions and again to meet the observations; repeats and missing ids count as before."""
    from ledgerloom.operators import features

    legs = [("t1", "IN", "a", 1.0), ("t1", "IN", "a", 1.0), ("t1", "OUT", "b", 2.0), ("t2", "OUT", "a", 3.0), ("t3", "IN", "c", 1.0), (None, "IN", "a", 1.0), (None, "OUT", "d", 1.0), ("t2", "IN", None, 1.0)]
    seen = [("t1", "1.1.1.1", "FR", "AS1"), ("t1", "1.1.1.1", "FR", "AS1"), ("t1", "2.2.2.2", "DE", "UNKNOWN"), ("t1", None, "", None), ("t2", None, None, None), (None, "9.9.9.9", "US", "AS9")]
    legs = spark.createDataFrame(legs, "txid string, direction string, address string, amount double")
    tx = spark.createDataFrame([("t1", "2024-01-01"), ("t2", "2024-01-02")], "txid string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    obs = spark.createDataFrame(seen, "txid string, src_ip string, country string, asn string")
    folds, fold = [], features.wallet_transactions
    monkeypatch.setattr(features, "wallet_transactions", lambda df: folds.append(1) or fold(df))
    got = features.wallet_features(tx, legs, obs)
    assert len(folds) == 1
    cols = ["address", "tx_count_total", "unique_counterparties", "graph_degree", "unique_observed_ips", "unique_asns", "unique_countries", "foreign_geo_entropy"]
    bits = -(2 / 3) * np.log2(2 / 3) - (1 / 3) * np.log2(1 / 3)
    want = [("a", 4, 2, 5, 2, 1, 2, bits), ("b", 1, 1, 2, 2, 1, 2, bits), ("c", 1, 0, 1, 0, 0, 0, 0), ("d", 1, 0, 1, 0, 0, 0, 0)]
    rows = [tuple(r) for r in got.select(*cols).orderBy("address").collect()]
    assert [r[:-1] for r in rows] == [w[:-1] for w in want] and np.allclose([r[-1] for r in rows], [w[-1] for w in want])


def test_large_groups_are_found_by_their_keys(spark, monkeypatch):
    """Groups are counted by a short hash first; groups that share one are no large group."""
    df = spark.createDataFrame([(f"k{i % 10}", None if i % 2 else "x") for i in range(100)], "a string, b string")
    assert spread.has_large(df, ["a", "b"], 9) and not spread.has_large(df, ["a", "b"], 10)
    monkeypatch.setattr(spread.F, "hash", lambda *c: F.lit(1))
    assert spread.has_large(df, ["a", "b"], 9) and not spread.has_large(df, ["a", "b"], 10)


def test_tempo_of_small_and_large_groups_agree(spark):
    """Rows of ordinary wallets were shuffled for seconds, days and wallets in turn."""
    rng = np.random.default_rng(3)
    rows = [(f"a{rng.integers(6)}", int(rng.integers(3 * 86_400)) * 500_000) for _ in range(300)] + [("one", 5), ("two", 7), ("two", 7), (None, 1), ("none", None)]
    df = spark.createDataFrame(rows, "address string, t long")
    found = [sorted(map(tuple, spread.tempo(df, ["address"], "t", limit).select("address", "n", "lo", "hi", "min_gap_s", "max_gap_s").collect())) for limit in (500_000, 10)]
    assert found[0] == found[1] and ("two", 2, 7, 7, 0.0, 0.0) in found[0] and ("one", 1, 5, 5, None, None) in found[0] and len(found[0]) == 8


def test_others_met_count_as_all_ordered_pairs_do(spark, monkeypatch):
    """Each pair of members of a transaction was two rows."""
    from ledgerloom.operators import peers

    rng = np.random.default_rng(4)
    legs = [(f"t{rng.integers(60)}", f"a{rng.integers(30)}") for _ in range(300)] + [("t1", None), ("t2", None), (None, "a1"), ("not", "a1"), ("not", "a2")]
    legs = spark.createDataFrame(legs, "txid string, address string")
    tx = legs.select("txid").filter("txid <> 'not'").distinct()
    last = legs.join(tx, "txid").groupBy("address").agg(F.max("txid").alias("txid"), F.count("*").alias("n")).filter("n > 3").drop("n")
    rows = legs.join(tx, "txid").distinct().join(last, ["address", "txid"], "left_anti")
    want = peers.distinct_peers(rows, legs.withColumnRenamed("address", "peer"), ["txid"], "n").collect()
    monkeypatch.setattr(peers, "distinct_peers", None)
    assert sorted(map(tuple, peers.others_met(rows, legs, tx, last, "n").collect())) == sorted(map(tuple, want))


def test_points_that_ask_all_cells_go_on_in_small_frames():
    """A batch of 10,000 points that reach 1,024 cells was one frame of ten million rows, and of matrices of that size."""
    import pandas as pd

    from ledgerloom.operators import metric_cells as mc

    x, pivots = np.random.default_rng(2).normal(size=(700, 3)), np.random.default_rng(3).normal(size=(200, 3))
    batch = pd.DataFrame({"pid": [f"p{i}" for i in range(700)], "x": list(x), "reach": np.where(np.arange(700) % 2, np.inf, 0.5)})
    radius = np.full(200, 0.25)
    frames = list(mc.cells_in_reach(iter([batch, batch.iloc[:0]]), pivots, radius))
    assert max(map(len, frames)) <= mc.ROWS < sum(map(len, frames))
    far = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(axis=2)).round(mc.DIGITS) - radius
    want = {(f"p{r}", c) for r, c in zip(*np.nonzero(far <= batch["reach"].to_numpy()[:, None] + mc.SLACK))}
    every = pd.concat(frames)
    assert len(every) == len(want) and set(zip(every["pid"], every["cell"])) == want
    assert all((x[int(p[1:])] == v).all() for p, v in zip(every["pid"], every["x"]))


def test_nearest_moment_needs_no_frame_to_the_end_of_the_group(spark, capsys):
    """Such frames are run through again for each row: a day of distinct seconds cost its square."""
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(9)], "t long, o boolean")
    spread.around(df.withColumn("m", F.when(F.col("o"), F.struct("t"))), [], "t", "m").explain()
    shown = capsys.readouterr().out
    assert "Window" in shown and "unboundedfollowing" not in shown.lower()
