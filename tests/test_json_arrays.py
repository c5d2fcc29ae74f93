"""Large JSON arrays, cut into records by many tasks, against the whole document."""

import json
import random

import pytest

from ledgerloom.sources import ledger_files as lf


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_are_cut_as_a_whole_document_is_read(spark, small_splits, tmp_path, indent):
    rng = random.Random(9)
    odd = ["}", "{", '"}', '\\', '\\"}{', "],[", "é}\n", "plain", "", "}" * 300, None]
    rows = [{"txid": f"t{i}", "script_type": rng.choice(odd), "inputs": ["a", rng.choice(odd[:8])], "more": {"x": {"y": [rng.choice(odd)]}}, "asn": rng.choice(odd)} for i in range(150)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(rows, indent=indent))
    assert spark.read.text(str(path), lineSep="}").rdd.getNumPartitions() > 20
    cut = lf.read_ledger_json(spark, str(path), whole_up_to=0).orderBy("src_pos").drop("src_file", "src_pos").collect()
    whole = lf.read_ledger_json(spark, str(path)).orderBy("src_pos").drop("src_file", "src_pos").collect()
    assert cut == whole and [r.txid for r in cut] == [r["txid"] for r in rows]


def test_empty_and_broken_arrays(spark, tmp_path):
    path = tmp_path / "e.json"
    path.write_text(" [ ]\n")
    assert lf.read_ledger_json(spark, str(path), whole_up_to=0).count() == 0
    for body in ('[{"txid": "a"}, {"txid": "b"', '[{"txid": "a"}', '[{"txid": "a"}, {"txid": ]}]'):
        path.write_text(body)
        with pytest.raises(Exception):
            lf.read_ledger_json(spark, str(path), whole_up_to=0).collect()
