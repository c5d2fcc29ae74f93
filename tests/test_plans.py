"""The correlation run over a folder of files."""

from ledgerloom.plans.correlation import run_correlation


def test_correlation_run(spark, tmp_path):
    n = 12
    rows = "".join(f"{i},{1700000000 + 1000 * i},0.02,A{i};B{i};C{i};D{i},X{i};Y{i};Z{i};Q{i},60\n" for i in range(n))
    (tmp_path / "txs_features.csv").write_text("txid,timestamp,fee,input_addresses,output_addresses,input_amounts\n" + rows)
    (tmp_path / "AddrTx_edgelist.csv").write_text("input_address,txId\nE0,0\nE0,0.0\n")
    (tmp_path / "TxAddr_edgelist.csv").write_text("txId,output_address\n0,F0\n")
    (tmp_path / "txs_classes.csv").write_text("txId,class\n0,1\n1,2\n")
    (tmp_path / "wallets_classes.csv").write_text("address,class\nA0,1\n")
    (tmp_path / "network_data.csv").write_text(
        "timestamp,src_ip,src_port,dst_ip,dst_port,txid\n1700000000,8.8.8.8,1,9.9.9.9,2,0.0\n1700001030,1.1.1.1,1,9.9.9.9,2,\n"
    )
    out = str(tmp_path / "out")
    got = run_correlation(spark, str(tmp_path), out)
    leads = {r.txid: r for r in spark.read.option("header", True).csv(f"{out}/investigation_leads").collect()}
    assert len(leads) == n
    assert (leads["0"].priority, leads["0"].tx_class, leads["0"].wallet_count) == ("HIGH", "illicit", "10")
    assert leads["1"].network_confidence == "0.75"
    m = got.metrics.first()
    assert (m.transactions_processed, m.correlated_transactions, m.wallets_connected) == (n, 2, 8 * n + 2)
