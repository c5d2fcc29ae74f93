import random

import numpy as np

from ledgerloom.llm import toxicity as tx


def test_label_model_finds_accuracies_and_shares_the_weight_of_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    good, fair = vote(0.95), vote(0.8)
    votes = np.stack([good, fair, vote(0.5), fair, fair, np.zeros(4000, int)], axis=1)
    post, p, corr = tx.label_model(votes, 0.3, 0)
    assert ((post > 0.5) == y).mean() > 0.93
    assert abs(p[1, 0, 2] - 0.95) < 0.05 and abs(p[1, 2, 2] - 0.5) < 0.1
    assert corr[1, 3] > 0.9 and abs(corr[0, 2]) < 0.2


def test_logistic_separates():
    rows = [[0], [0, 1], [1], [], [2], [2, 1]] * 20
    target = np.array([1, 1, 0, 0, 0.9, 1] * 20)
    w, b = tx.logistic(rows, target, 3)
    assert w[0] + b > 1 and w[1] + b < 0 and b < 0 and w[2] + b > 1


def planted(spark, n=600):
    rng = random.Random(1)
    calm = [f"{a}{b}" for a in ("lun", "mar", "tol", "sel", "gri") for b in ("do", "ne", "ra", "si", "ve", "mo")]
    rude = ["zarkal", "zarkend", "zarkoo", "moron"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(calm) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_clean_rows_stay(spark):
    docs, labels = planted(spark)
    model = tx.fit(docs, tx.training_labels(labels))
    got = {r.doc_id: r.p for r in tx.with_score(docs, model, name="p").collect()}
    right = [(got[i] >= 0.5) == (i % 4 == 0) for i in got]
    assert sum(right) / len(right) > 0.97
    assert model.accuracies["label"] > 0.9
    kept = tx.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i in got if i % 4}
    assert clean <= ids and len(ids - clean) <= 5


def test_odd_rows_and_missing_labels(spark):
    rows = [(None, "you are a moron", 1), (1, None, 2), (1, "", 3), (2, "word " * 50_000 + "moron", 4), (3, "plain words", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    for labels in (none, none.limit(0), spark.createDataFrame([(3, 0)], "doc_id long, toxic int")):
        model = tx.fit(docs, labels)
        got = {r.k: r.score for r in tx.with_score(docs, model).collect()}
        assert got[1] >= 0.5 and got[4] >= 0.5 and max(got[2], got[3], got[5]) < 0.5
        assert {r.k for r in tx.drop_toxic(docs, labels).collect()} == {2, 3, 5}
    assert tx.with_score(docs.limit(0), tx.seeded()).count() == 0


def test_fit_rows_are_a_hard_bound(spark):
    """One id with most labels, and one with most documents."""
    docs, labels = planted(spark, 200)
    hot = labels.unionByName(spark.range(4000).selectExpr("7L AS doc_id", "1 AS toxic"))
    rows = docs.unionByName(spark.range(3000).selectExpr("8L AS doc_id", "concat('tolne ', id) AS text", "'x' AS score"))
    assert tx._chosen(docs, hot, "doc_id", "text", "toxic", 1000).count() == 200
    assert 0 < tx._chosen(rows, hot, "doc_id", "text", "toxic", 500).count() <= 500
    assert 0 < tx._chosen(rows, labels, "doc_id", "text", "toxic", 50).count() <= 50


def test_label_model_against_plain_em():
    """Two voters and the label, independent: posteriors equal those of EM written out vote by vote."""
    rng = np.random.default_rng(3)
    y = rng.random(400) < 0.4
    votes = np.stack([np.where(rng.random(400) < r, np.where(y, 1, -1), np.where(y, -1, 1)) for r in (0.9, 0.85, 0.9)], axis=1)
    votes[::7, 1] = 0
    post, _, _ = tx.label_model(votes, 0.4, 2, rounds=5)
    q = [0.9 if c > 0 else 0.1 for _, _, c in votes]
    for _ in range(5):
        p = [[[(sum(w for w, v in zip(ws, votes[:, j]) if v == x) + 0.5) / (sum(ws) + 1.5) for x in (-1, 0, 1)] for j in range(3)] for ws in ([1 - x for x in q], q)]
        mean = [[(1 - w) * (p[0][j][2] - p[0][j][0]) + w * (p[1][j][2] - p[1][j][0]) for j in range(3)] for w in q]
        rest = np.array(votes) - np.array(mean)
        corr = (rest.T @ rest) / np.sqrt(np.outer((rest**2).sum(0), (rest**2).sum(0)))
        share = [1 / max(1, sum(abs(c) for c in row if abs(c) > 0.1)) for row in corr[:2]] + [1]
        rate = min(max(sum(q) / len(q), 0.001), 0.999)
        z = [np.log(rate / (1 - rate)) + sum(share[j] * (np.log(p[1][j][v[j] + 1]) - np.log(p[0][j][v[j] + 1])) for j in range(3)) for v in votes]
        q = [1 / (1 + np.exp(-max(-30, min(30, x)))) for x in z]
    assert np.abs(np.array(q) - post).max() < 1e-3
