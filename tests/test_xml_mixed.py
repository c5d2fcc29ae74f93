"""XML files with several record tags, read by many tasks."""

import random
import xml.etree.ElementTree as ET

from ledgerloom.sources import ledger_files as lf


def test_mixed_tags_in_the_order_of_the_file(spark, tmp_path):
    rng = random.Random(2)
    root = ET.Element("ledger")
    for i in range(200):
        rec = ET.SubElement(root, rng.choice(["transaction", "record", "tx", "Tx"]))
        if rng.random() < 0.3:
            rec.set("version", "1")
        ET.SubElement(rec, rng.choice(["txid", "tx_hash"])).text = f"t{i}"
        ET.SubElement(rec, "timestamp").text = "2024-01-01 00:00:00"
        ET.SubElement(rec, "script_type").text = "a < b & c" if i % 3 else "x\ny"
        ins = ET.SubElement(rec, "input_addresses")
        if i % 2:
            for j in range(i % 5):
                ET.SubElement(ins, "address").text = f"A{i}-{j}"
        else:
            ins.text = f"A{i};B{i}"
    path = str(tmp_path / "m.xml")
    ET.indent(root)
    ET.ElementTree(root).write(path)
    want = []
    for rec in root:
        ins = rec.find("input_addresses")
        listed = [c.text for c in ins] if len(ins) else (ins.text or "").strip().split(";")
        want.append((rec.findtext("txid") or rec.findtext("tx_hash"), rec.findtext("script_type"), [x for x in listed if x]))
    keys = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        assert spark.read.text(path, lineSep="</").rdd.getNumPartitions() > 20
        rows = lf.read_ledger_xml(spark, path).orderBy("src_pos").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r.txid, r.script_type, list(r.input_addresses or [])) for r in rows] == want


def test_one_tag_on_a_line_of_its_own(spark, tmp_path):
    path = tmp_path / "o.xml"
    path.write_text("<l>\n<record>\n<txid>a</txid>\n</record>\n<tx\n v='1'><txid>b</txid></tx>\n<record/>\n</l>")
    assert [r.txid for r in lf.read_ledger_xml(spark, str(path)).orderBy("src_pos").collect()][:2] == ["a", "b"]


def test_whole_records_stay_where_they_are_read(spark, tmp_path, monkeypatch):
    """Each piece between two end tags was written out and shuffled."""
    written, cut = [], lf.cut
    monkeypatch.setattr(lf, "cut", lambda df: written.append(df.count()) or cut(df))
    path = tmp_path / "w.xml"
    path.write_text("<l>" + "".join(f"<{t}><txid>{t}{i}</txid><fee>1</fee></{t}>" for i in range(300) for t in ("record", "tx")) + "</l>")
    rows = lf.read_ledger_xml(spark, str(path)).orderBy("src_pos").collect()
    assert [r.txid for r in rows] == [f"{t}{i}" for i in range(300) for t in ("record", "tx")]
    assert sum(written) <= 2 * spark.read.text(str(path), lineSep="</").rdd.getNumPartitions()
