"""Ledger forensics as Spark jobs: ingest, correlate, profile, score, rank and explain."""
