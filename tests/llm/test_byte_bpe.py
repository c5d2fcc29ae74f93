import hashlib
import random

from ledgerloom.llm import byte_bpe


def texts():
    rng = random.Random(2)
    bits = ["the", " re", "'ll", "'s", "  ", "\n\n", "\t", "12", " 345", "é", "ß", "字", "😀", "###", " --", "\r\n", "x" * 50, " ", " ", "\x1c", "'", "''ve", "<|endoftext|>"]
    out = [None, "", " ", "a", "'s's's" * 30, " " * 400, "a" * 400, "\n" * 333 + "b" + " " * 200 + "c", "é" * 150 + " " + "7" * 200]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 400))) for _ in range(60)]


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, i int, row string")
    out = byte_bpe.decode(byte_bpe.encode(df, decoded="same", **kw))
    assert out.filter("same <> decoded OR same IS NULL").count() == 0
    out = out.drop("same")
    assert out.columns == ["doc_id", "text", "i", "row", "ids", "decoded"]
    enc = byte_bpe.encoding(byte_bpe.rank_file())
    got = sorted(out.collect(), key=lambda r: r.i)
    assert len(got) == len(rows)
    for r, (_, t, _, _) in zip(got, rows):
        assert list(r.ids) == enc.encode_ordinary(t or ""), t
        assert bytes(r.decoded) == (t or "").encode()


def test_chunks_stitch_to_what_the_whole_text_gives(spark):
    rows = [(n // 2 if n % 7 else None, t, n, None) for n, t in enumerate(texts())]
    for chunk, overlap in ((40, 20), (64, 8), (1000, 200)):
        check(spark, rows, chunk=chunk, overlap=overlap)


def test_production_chunks_over_a_very_long_text(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "béta", "gamma,", "12.5", "\n"]) for _ in range(60_000))
    check(spark, [(1, long, 0, "a"), (2, "x" * 80_000, 1, None), (2, "short", 2, None)])


def test_columns_with_the_names_of_results_are_replaced(spark):
    df = spark.createDataFrame([(1, "abc", "x", "y")], "doc_id long, text string, ids string, decoded string")
    out = byte_bpe.decode(byte_bpe.encode(df)).first()
    assert list(out.ids) == byte_bpe.encoding(byte_bpe.rank_file()).encode_ordinary("abc") and bytes(out.decoded) == b"abc"


def test_digests_and_empty_table(spark):
    df = spark.createDataFrame([(3, "héllo wörld"), (4, None)], "doc_id long, text string")
    enc = byte_bpe.encoding(byte_bpe.rank_file())
    got = {r.doc_id: r for r in byte_bpe.digests(df).collect()}
    ids = enc.encode_ordinary("héllo wörld")
    assert (got[3].n_tokens, got[3].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert got[3].decoded_sha256 == hashlib.sha256("héllo wörld".encode()).hexdigest() and got[4].n_tokens == 0
    assert byte_bpe.digests(df.limit(0)).count() == 0


def test_very_long_runs_of_blanks(spark):
    """Runs that the library's matcher can't take: same ids as the pattern and the ranks give, whatever stands around them."""
    enc = byte_bpe.encoding(byte_bpe.rank_file())
    for text in (" " * 70_000 + "x", "a" + "\n" * 66_000 + " b", "\t " * 40_000, " " * byte_bpe.LONG_RUN):
        assert byte_bpe.tokens(enc, text) == enc.encode_ordinary(text)
    long = "some words" + " " * 5_000_000 + "end"
    df = spark.createDataFrame([(1, long), (2, "\n" * 1_000_000)], "doc_id long, text string")
    for r in byte_bpe.decode(byte_bpe.encode(df)).collect():
        assert bytes(r.decoded).decode() == r.text and len(r.ids) > 1000
