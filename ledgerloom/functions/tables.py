"""Fixed lookup tables."""

from __future__ import annotations

# Offline subnets in lookup order (cidr, country, asn, organisation).
SUBNETS = [
    ("1.1.1.0/24", "AU", "AS13335", "Cloudflare Inc"),
    ("8.8.8.0/24", "US", "AS15169", "Google LLC"),
    ("45.33.0.0/16", "US", "AS63949", "Linode LLC"),
    ("104.16.0.0/12", "US", "AS13335", "Cloudflare Inc"),
    ("185.220.101.0/24", "DE", "AS200052", "Zwiebelfreunde e.V."),
    ("185.195.0.0/16", "NL", "AS49981", "WorldStream B.V."),
    ("194.26.29.0/24", "RU", "AS48282", "Hostkey B.V."),
    ("103.21.244.0/22", "IN", "AS13335", "Cloudflare India"),
    ("116.202.0.0/16", "DE", "AS24940", "Hetzner Online GmbH"),
    ("198.51.100.0/24", "CH", "AS12345", "Swiss Privacy Relays"),
    ("203.0.113.0/24", "SG", "AS55555", "SingTel Relays"),
    ("192.0.2.0/24", "PA", "AS99999", "Offshore Routing Corp"),
    ("172.67.0.0/16", "US", "AS13335", "Cloudflare Inc"),
    ("149.154.160.0/20", "NL", "AS62041", "Telegram Messenger Inc"),
    ("91.108.4.0/22", "NL", "AS62041", "Telegram Messenger Inc"),
]

# Country, asn and organisation for IPv4 outside the subnets, by bucket 0..9.
FALLBACK_GEO = [
    ("US", "AS16509", "Amazon Web Services"),
    ("DE", "AS24940", "Hetzner Online"),
    ("NL", "AS49981", "WorldStream B.V."),
    ("CH", "AS12345", "Swiss Privacy Relays"),
    ("SG", "AS55555", "SingTel Relays"),
    ("IN", "AS13335", "Cloudflare India"),
    ("RU", "AS48282", "Hostkey B.V."),
    ("PA", "AS99999", "Offshore Privacy Services"),
    ("GB", "AS2856", "BT Public Internet"),
    ("SC", "AS88888", "Seychelles Hosting Ltd"),
]

# Results for loopback and for anything that is not IPv4.
LOOPBACK = ("127.0.0.1", "localhost", "::1")
LOOPBACK_GEO = ("US", "AS0", "Internal Loopback")
UNKNOWN_GEO = ("UNKNOWN", "AS_UNKNOWN", "Unknown Organization")

# Script types kept; anything else becomes the first.
SCRIPT_TYPES = ("P2PKH", "P2SH", "P2WPKH", "P2WSH", "TAPROOT")

# Class codes of label files.
CLASS_NAMES = {"1": "illicit", "2": "licit", "3": "unknown"}

# Seed score and anomaly per wallet class code; the last pair is for other codes.
CLASS_SEEDS = {"1": (90, 0.85), "2": (10, 0.05)}
CLASS_SEED_OTHER = (40, 0.35)

# The 21 wallet features in order.
WALLET_FEATURES = [
    "tx_count_total",
    "tx_incoming_count",
    "tx_outgoing_count",
    "total_incoming_btc",
    "total_outgoing_btc",
    "avg_tx_amount",
    "max_tx_amount",
    "std_tx_amount",
    "net_flow_btc",
    "tx_velocity_per_hour",
    "avg_time_between_txs_sec",
    "unique_counterparties",
    "fan_in_ratio",
    "fan_out_ratio",
    "graph_degree",
    "graph_in_degree",
    "graph_out_degree",
    "unique_observed_ips",
    "unique_asns",
    "unique_countries",
    "foreign_geo_entropy",
]

# The 9 transaction model features in order.
MODEL_FEATURES = [
    "fan_in",
    "fan_out",
    "transaction_amount",
    "fee",
    "wallet_count",
    "network_confidence",
    "time_difference_seconds",
    "degree",
    "unique_counterparties",
]

# Column names accepted for each ledger-file field, first match wins
# (compared in lower case without "_", "-" and spaces).
LEDGER_ALIASES = {
    "txid": ["txid", "txhash", "transactionid", "txid1"],
    "timestamp": ["timestamp", "time", "blocktime", "date", "datetime", "ts", "networktimestamp"],
    "fee": ["fee", "fees", "txfee"],
    "script_type": ["scripttype", "type", "script"],
    "input_addresses": ["inputaddresses", "inputs", "inputwallets", "srcaddresses", "sender"],
    "output_addresses": ["outputaddresses", "outputs", "outputwallets", "dstaddresses", "receiver"],
    "input_amounts": ["inputamounts", "inamounts", "inputval"],
    "output_amounts": ["outputamounts", "outamounts", "amounts", "outputval"],
    "src_ip": ["srcip", "sourceip", "ip", "peerip", "relayip"],
    "dst_ip": ["dstip", "destinationip"],
    "src_port": ["srcport"],
    "dst_port": ["dstport"],
    "geo_country": ["geocountry", "country", "location"],
    "asn": ["asn", "asnumber", "autonomoussystem"],
    "wallet_classes": ["walletclasses"],
    "tx_class": ["txclass", "class", "label"],
    "ml_anomaly_score": ["mlanomalyscore", "anomalyscore"],
    "address": ["address", "walletaddress", "wallet"],
    "class": ["class", "label", "category"],
}

# Keys read from JSON records and XML elements, first filled wins.
RECORD_KEYS = {
    "txid": ["txid", "tx_hash"],
    "timestamp": ["timestamp", "time"],
    "fee": ["fee"],
    "script_type": ["script_type"],
    "input_addresses": ["input_addresses", "inputs"],
    "output_addresses": ["output_addresses", "outputs"],
    "input_amounts": ["input_amounts"],
    "output_amounts": ["output_amounts", "amounts"],
    "src_ip": ["src_ip", "ip"],
    "dst_ip": ["dst_ip"],
    "src_port": ["src_port"],
    "dst_port": ["dst_port"],
    "geo_country": ["geo_country", "country"],
    "asn": ["asn"],
}
JSON_WRAPPERS = ("transactions", "data", "records", "items")
XML_ROW_TAGS = ("transaction", "record", "tx")

# Column names accepted in correlation files, in order; matched exactly, then as substrings.
CORRELATION_ALIASES = {
    "txid": ["txid", "tx_id", "transaction_id", "txid", "tx_hash", "hash", "txid1"],
    "timestamp": ["timestamp", "time", "datetime", "block_time", "time_step", "time step", "timestep", "date"],
    "fee": ["fee", "fees", "transaction_fee", "tx_fee", "fee_btc", "miner_fee"],
    "script_type": ["script_type", "script", "type", "output_script_type", "address_type"],
    "input_addresses": ["input_addresses", "input_address", "inputs", "in_addresses", "sender_addresses", "from_address"],
    "output_addresses": ["output_addresses", "output_address", "outputs", "out_addresses", "recipient_addresses", "to_address"],
    "input_amounts": ["input_amounts", "input_amount", "input_value", "in_btc_total", "total_btc", "amount", "value"],
    "output_amounts": ["output_amounts", "output_amount", "output_value", "out_btc_total"],
    "tx_class": ["class", "label", "tx_class", "category", "illicit_flag"],
    "wallet_address": ["address", "wallet", "wallet_address", "input_address", "output_address", "addr"],
    "wallet_class": ["class", "wallet_class", "label", "category", "entity_type"],
    "src_ip": ["src_ip", "source_ip", "ip", "client_ip", "relay_ip", "src"],
    "src_port": ["src_port", "source_port", "sport", "port", "client_port"],
    "dst_ip": ["dst_ip", "destination_ip", "target_ip", "dst", "server_ip"],
    "dst_port": ["dst_port", "destination_port", "dport", "server_port"],
}
# Tables of the correlation input and their fields.
CORRELATION_TABLES = {
    "transaction": ["txid", "timestamp", "fee", "script_type", "input_addresses", "output_addresses", "input_amounts"],
    "network": ["timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "txid"],
    "wallet": ["wallet_address", "wallet_class"],
    "tx_class": ["txid", "tx_class"],
}
# Files of a correlation folder, the required one first.
EXPECTED_FILES = [
    "txs_features.csv",
    "txs_classes.csv",
    "txs_edgelist.csv",
    "wallets_features.csv",
    "wallets_classes.csv",
    "wallets_features_classes_combined.csv",
    "AddrTx_edgelist.csv",
    "TxAddr_edgelist.csv",
    "network_data.csv",
]
