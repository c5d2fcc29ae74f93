"""CSV cells with line breaks, read by many tasks, against Python's csv module."""

import csv
import random

import pytest

from ledgerloom.sources import ledger_files as lf

FIELDS = ["txid", "timestamp", "fee", "script_type", "src_ip", "geo_country"]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(FIELDS)
        w.writerows(rows)


def read(path):
    with open(path, newline="") as f:
        return [tuple(r[k] or None for k in FIELDS) for r in csv.DictReader(f)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_breaks_across_split_borders(spark, small_splits, tmp_path, end):
    rng = random.Random(4)
    odd = ['a\nb', 'say "x"', '\n\n\n', 'one, two', '"', 'long\n' * 200, 'q""q\n"r"', "plain", 'é\n"ü'] 
    rows = [[f"t{i}", "2024-01-01", "0.1", rng.choice(odd) if rng.random() < 0.4 else "P2PKH", "1.2.3.4", rng.choice(odd + ["DE"] * 9)] for i in range(300)]
    path = str(tmp_path / "x.csv")
    write(path, rows, end)
    got = lf.read_ledger_csv(spark, path).orderBy("src_pos").select(*FIELDS)
    assert spark.read.text(path, lineSep="\n").rdd.getNumPartitions() > 20
    want = read(path)
    filled = [(*t[:3], t[3] if t[3].strip() else "P2PKH", t[4], t[5] if t[5] and t[5].strip() else None) for t in want]
    assert [tuple(r) for r in got.collect()] == filled


def test_folders_unpaired_quotes_and_empty_files(spark, small_splits, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    write(folder / "a.csv", [["a1", "t", "1", "x\ny", "", "DE"], ["a2", "t", "1", "P", "", "FR"]])
    write(folder / "b.csv", [["b1", "t", "1", "P", "", "US"]])
    (folder / "c.csv").write_text(",".join(FIELDS) + '\nc1,t,1,5" pipe,,GB\nc2,t,1,P,,IT\n')
    got = lf.read_ledger_csv(spark, str(folder))
    assert sorted((r.txid, r.script_type, r.geo_country) for r in got.collect()) == [
        ("a1", "x\ny", "DE"), ("a2", "P", "FR"), ("b1", "P", "US"), ("c1", '5" pipe', "GB"), ("c2", "P", "IT"),
    ]
    one = str(tmp_path / "one.csv")
    write(one, [])
    assert lf.read_ledger_csv(spark, one).count() == 0
    assert lf.read_ledger_csv(spark, one, quoted_breaks=True).count() == 0
