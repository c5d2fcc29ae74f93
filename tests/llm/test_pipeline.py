"""The pipeline on small tables against brute force."""

import hashlib
import random
import re

import corpus_pipeline
from test_simhash import jaccard

from ledgerloom.llm import byte_bpe


def tables(spark, folder):
    rng = random.Random(9)
    calm = [f"{a}{b}" for a in ("lun", "mar", "tol", "sel", "gri", "pon") for b in ("do", "ne", "ra", "si", "ve", "mo", "ka")]
    say = lambda n: [rng.choice(calm) + str(rng.randrange(50)) for _ in range(n)]
    items = [" ".join(say(30)) for _ in range(3)]
    docs, labels, want = [], [], {}
    for i in range(120):
        words = say(rng.randint(40, 120))
        kind = "toxic" if i % 6 == 0 else "leak" if i % 10 == 1 else "clean"
        if kind == "toxic":
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["moron", "zarkal", "zarkoo"]))
        text = " ".join(words)
        if kind == "leak":
            text += " " + items[i % 3].upper()
        docs.append((i, text))
        labels.append((i, int(kind == "toxic")))
        want[i] = kind
    for i in range(10):
        copy = docs[2 + 6 * i][1]
        docs.append((200 + i, copy.replace(" ", "\n  ")))
        near = copy.split(" ")
        docs.append((300 + i, " ".join([*near, "extra"])))
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, want


def test_rows_equal_brute_force(spark, tmp_path):
    docs, want = tables(spark, str(tmp_path))
    left = [(i, t) for i, t in sorted(docs) if want.get(i) != "toxic"]
    first = {}
    for i, t in left:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    left = sorted(first.values())
    # no pair of these texts lies between 0.5 and 0.95, and copies come in pairs
    near = {(i, j): jaccard(a, b) for i, a in left for j, b in left if i < j}
    assert all(x < 0.5 or x > 0.95 for x in near.values())
    gone = {j for (i, j), x in near.items() if x > 0.95}
    assert len(gone) == 10
    left = [(i, t) for i, t in left if i not in gone and want.get(i) != "leak"]
    enc = byte_bpe.encoding(byte_bpe.rank_file())
    expect = [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in left for ids in [enc.encode_ordinary(t)]]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == expect
    assert len(expect) > 60 and not any(200 <= i < 300 for i, *_ in expect)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(20)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
