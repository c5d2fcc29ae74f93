"""What is written once, and what does not stay on disk."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import graph, investigate, profiles
from ledgerloom.plans import catalog
from ledgerloom.session import cut, kept


def _files(spark) -> int:
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles()
    return sum(1 for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_"))


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    before = _files(spark)
    rows = cut(spark.range(5000).groupBy((F.col("id") % 999).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if _files(spark) <= before:
            break
        time.sleep(0.2)
    assert _files(spark) <= before and rows.count() == 999


def test_kept_rows_are_the_same(spark):
    df = spark.createDataFrame(
        [("a", "1995-03-01 10:00:00.123456", 1.5, ["x", None]), (None, None, None, None), ("b", "1850-01-01 00:00:01", float("nan"), []), ("b", "0900-02-28 00:00:01", -0.0, ["y"])],
        "k string, t string, v double, l array<string>",
    ).withColumn("t", F.col("t").cast("timestamp"))
    back = kept(df, "t")
    shown = lambda d: sorted(map(str, d.select("k", F.unix_micros("t"), F.col("v").cast("string"), "l").collect()))
    assert back.dtypes == df.dtypes and shown(back) == shown(df)


@pytest.fixture(scope="module")
def star_tables(spark, tmp_path_factory):
    top, rng = str(tmp_path_factory.mktemp("star")), random.Random(5)
    day = lambda n: F.expr(f"timestamp'1996-01-01 00:00:00' + make_interval(0, 0, 0, {n})")
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).withColumns({c: day(c) for c in ("o_orderdate", "ts") if f" {c} int" in schema}).write.parquet(f"{top}/{name}.parquet")
    save([(i, rng.randint(1, 6), "O", float(rng.randint(1000, 900000)), rng.randint(0, 900), "5-LOW") for i in range(1, 61)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate int, o_orderpriority string", "orders")
    save([(i, 1, rng.randint(1, 4), n, 1.0, float(rng.randint(1000, 90000)), 0.0, 0.01) for i in range(1, 61) for n in range(1, rng.randint(2, 4))], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double", "lineitem")
    save([(i, rng.randint(0, 900), rng.randint(1, 30), "click", 1.0, "{}") for i in range(1, 50)], "event_id long, ts int, user_id long, event_type string, value double, props string", "events")
    save([(i, f"c{i}", 1, float(i), "M") for i in range(1, 7)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    return top


@pytest.mark.parametrize("name", ["qs2_wallet_dossiers", "qs7_replay", "qs9_briefs"])
def test_a_query_computes_the_wallet_features_once(spark, star_tables, monkeypatch, name):
    calls, real = [], catalog.features.wallet_features
    monkeypatch.setattr(catalog.features, "wallet_features", lambda *a: calls.append(1) or real(*a))
    assert getattr(catalog, name)(spark, star_tables).count() > 0
    assert len(calls) == 1


def _brute(edges, seed, k, most):
    steps, degree = {}, {}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            degree[x] = degree.get(x, 0) + 1
            if x != y:
                steps.setdefault(x, set()).add(y)
    reached, frontier = {seed: 0}, [seed]
    for hop in range(1, k + 1):
        near = {b for a in frontier for b in steps.get(a, ())} - set(reached)
        frontier = sorted(near, key=lambda x: (-degree[x], x))[: max(0, most - len(reached))]
        reached.update((x, hop) for x in frontier)
    return reached


@pytest.mark.parametrize("few", [0, 200_000])
def test_neighbourhoods_do_not_write_the_steps_of_the_whole_graph(spark, monkeypatch, few):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 60):02d}", f"n{min(rng.randint(0, 60), rng.randint(0, 60)):02d}") for _ in range(220)]
    df = spark.createDataFrame([(a, b, "INPUT_OF", 1.0, i) for i, (a, b) in enumerate(edges)] + [("n01", None, "INPUT_OF", 1.0, 0)], "src string, dst string, type string, amount double, leg_no int")
    seeds = ["n01", "n07", "n33"]
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "neighbours", None)
    got = {s: {} for s in seeds}
    for r in graph.ego_nodes(df, spark.createDataFrame([(s,) for s in seeds], "seed string"), 2, 12).collect():
        got[r.seed][r.id] = r.distance
    assert got == {s: _brute(edges, s, 2, 12) for s in seeds}
    alerts = spark.createDataFrame([(s,) for s in seeds], "entity_id string")
    for r in investigate.replay_graph(alerts, df, 2, 12).collect():
        inside = [(a, b) for a, b in edges if a in got[r.entity_id] and b in got[r.entity_id]]
        assert (r.node_count, r.edge_count, len(r.flows)) == (len(got[r.entity_id]), len(inside), min(10, len(inside)))


def test_observations_meet_their_wallets_as_one_row(spark, capsys):
    ev = spark.createDataFrame([("a", "t1"), ("a", "t1"), ("a", "t2"), ("b", "t2"), (None, "t2"), ("c", None)], "address string, txid string")
    obs = spark.createDataFrame(
        [("t1", "1.1.1.1", 80, "AS1", "FR"), ("t1", "1.1.1.1", 80, "AS1", "FR"), ("t2", "", 0, "UNKNOWN", "DE"), (None, "9.9.9.9", 1, "AS9", "US")],
        "txid string, src_ip string, src_port int, asn string, country string",
    )
    cells = profiles.network_cells(ev, obs)
    want = {("a", "ip", "1.1.1.1"), ("a", "port", "80"), ("a", "asn", "AS1"), ("a", "country", "FR"), ("a", "country", "DE"), ("b", "country", "DE"), (None, "country", "DE")}
    assert set(map(tuple, cells.collect())) == want and cells.count() == len(want)
    cells.explain()
    plan = capsys.readouterr().out
    assert plan.index("Generate") < plan.index("Join")  # printed from the last step to the first: the join comes before the kinds
