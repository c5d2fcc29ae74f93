import hashlib
import re

from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup as ed


def folded(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    low, size = {}, {}
    for i, t in rows:
        k = folded(t)
        size[k] = size.get(k, 0) + 1
        low[k] = min(low.get(k, i), i, key=lambda x: (x is None, x or 0))
    return sorted((-1 if i is None else i, folded(t), low[folded(t)], size[folded(t)]) for i, t in rows)


def rows_of(spark, path, **kw):
    got = ed.decide(spark, path, **kw).select("doc_id", "text", F.col("__keep.id").alias("keep"), "__n", (F.col("__keep") == F.col("__place")).alias("kept"), "__digest").collect()
    return got


TEXTS = ["a  b", "a\tb", "a b", "A b", None, "", " ", "x" * 200_000, "é\n", "é ", "é\x0b\x0c", "é ", "x" * 200_000]


def test_equals_brute_force_over_several_micro_batches(spark, tmp_path):
    rows = [((i * 7) % 40 if i % 11 else None, TEXTS[i % len(TEXTS)]) for i in range(39)]
    rows = [r for r in rows if r[0] is not None] + [(None, "a b"), (None, "alone")]
    path = str(tmp_path / "t")
    for part in range(4):
        spark.createDataFrame(rows[part::4], "doc_id long, text string").withColumn("row", F.lit(1)).coalesce(1).write.mode("append").parquet(path)
    got = rows_of(spark, path, files_per_batch=1)
    assert sorted((-1 if r.doc_id is None else r.doc_id, folded(r.text), r.keep, r["__n"]) for r in got) == expected(rows)
    assert sum(r.kept for r in got) == len({folded(t) for _, t in rows})
    assert all(r["__digest"] == hashlib.sha256(folded(r.text).encode()).hexdigest() for r in got)


def test_state_goes_on_where_it_stopped(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "state")
    spark.createDataFrame([(5, "one"), (6, "two")], "doc_id long, text string").write.parquet(path)
    assert sum(r.kept for r in rows_of(spark, path, state=state)) == 2
    spark.createDataFrame([(1, "one"), (7, "two"), (8, "three")], "doc_id long, text string").write.mode("append").parquet(path)
    got = rows_of(spark, path, state=state)
    assert sorted((r.doc_id, r.keep, r["__n"]) for r in got) == [(1, 1, 2), (5, 1, 2), (6, 6, 2), (7, 6, 2), (8, 8, 1)]
    assert ed.state_table(spark, state).count() == 3


def test_digest_hits_with_other_bytes_stay_apart(spark, tmp_path):
    rows = [(i, f"text {i % 5}") for i in range(20)] + [(30, "only one")]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    got = rows_of(spark, path, digest=lambda c: F.substring(F.lit("same"), 1, 4))
    assert sorted((r.doc_id, folded(r.text), r.keep, r["__n"]) for r in got) == expected(rows)


def test_drop_copies_keeps_all_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x", "p", 1), (2, "x ", "q", 2), (2, " x", "r", 3), (None, None, "s", 4)], "doc_id long, text string, digest string, doc int")
    out = ed.drop_copies(df)
    assert out.columns == df.columns and sorted(r.doc for r in out.collect()) == [1, 2, 3, 4]
    again = spark.createDataFrame([(1, "x y", "p", 1), (2, "x\ty", "q", 2), (2, "x  y", "r", 3), (None, "x y", "s", 4)], df.schema)
    assert [r.doc for r in ed.drop_copies(again).collect()] == [1]
    assert ed.drop_copies(df.limit(0)).count() == 0
