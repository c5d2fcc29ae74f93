import random

import numpy as np

from ledgerloom.llm import language_id as li


def test_grams_and_vectors():
    made = li.Letters(256, 3, 1)
    pack = lambda s: (ord(s[0]) << 42) | (ord(s[1]) << 21) | ord(s[2])
    assert made.grams("Ab--c1").tolist() == [pack(x) for x in (" ab", "ab ", "b c", " c ")]
    assert not len(made.grams("12 !?")) and not len(made.grams(None)) and made.grams("é").tolist() == [pack(" é ")]
    v = made.vectors(made.grams("abc"))
    want = np.roll(made.letter(ord("a")), 2) * np.roll(made.letter(ord("b")), 1) * made.letter(ord("c"))
    assert (v[1] == want).all()
    assert abs(v[0].astype(int) @ v[1].astype(int)) < 80


def made(n=240, seed=2):
    rng = random.Random(seed)
    parts = {"aa": ["the", "ing", "er", "on"], "bb": ["ou", "eau", "ment", "é"], "cc": ["sch", "ung", "ei", "ö"]}
    rows = []
    for i in range(n):
        lang = sorted(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 80))), lang))
    return rows


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(made(), "doc_id long, text string, lang string")
    profiles = li.learn(df.filter(~li.is_held_out()))
    got = li.predict(df, profiles).select("lang", "language", li.is_held_out().alias("h")).collect()
    assert 30 < sum(r.h for r in got) < 90
    assert all(r.language.lang == r.lang and 0.34 < r.language.score <= 1 for r in got)


def test_dots_equal_explicit_bundles_and_cosines(spark):
    df = spark.createDataFrame(made(60), "doc_id long, text string, lang string")
    profiles = li.learn(df, dim=512)
    letters = li.Letters(512, 3, li.SEED)
    bundle = lambda texts: letters.vectors(np.concatenate([letters.grams(t) for t in texts])).astype(float).sum(axis=0)
    rows = df.collect()
    for lang, v in profiles.items():
        assert (v == bundle([r.text for r in rows if r.lang == lang])).all()
    got = {r.doc_id: r.language for r in li.predict(df, profiles, dim=512).collect()}
    for r in rows:
        b = bundle([r.text])
        cos = {k: b @ v / np.linalg.norm(b) / np.linalg.norm(v) for k, v in profiles.items()}
        assert got[r.doc_id].lang == max(sorted(cos), key=cos.get)
        assert abs(got[r.doc_id].score - max(cos.values()) / sum(max(x, 0) for x in cos.values())) < 1e-4


def test_odd_rows_and_no_training_rows(spark):
    rows = [(1, None, "aa"), (2, "", None), (3, "123", "aa"), (None, "abc", None), (3, "abc " * 100_000, "zz"), (3, "字字字", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    got = li.predict(df, li.learn(df)).collect()
    assert [r.language.lang for r in got][:3] == ["und"] * 3 and [r.language.score for r in got][:3] == [0.0] * 3
    assert got[3].language.lang == got[4].language.lang == "zz" and got[5].language.lang == "aa"
    none = li.predict(df, li.learn(df.filter("lang IS NULL"))).collect()
    assert {r.language.lang for r in none} == {"und"}
    assert li.predict(df.limit(0), {}).count() == 0 and li.learn(df.limit(0)) == {}
