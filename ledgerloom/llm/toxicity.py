"""Toxicity by weak supervision.

1. Lexicons are induced from the labelled training rows: words and word beginnings that lean to one class, by smoothed
   log odds over document counts that Spark sums.
2. Voters over each training text: lexicons (the induced entries dealt into LEXICONS lists, a seed list of insults, one
   that wants several different entries), patterns (shouting, stretched letters, masked words, insults addressed to a
   reader), voters for the clean class, and the given label as one more noisy voter.
3. A generative model of the votes given the hidden class is fitted by EM: every voter's accuracy and abstention, and the
   correlations of voters within a class, by which the weight of voters that repeat each other is shared.
4. A logistic regression over the induced entries and patterns learns the posterior of the label model. It alone scores
   texts, in one pass without a shuffle.

The fit reads at most FIT_ROWS labelled rows, drawn by hash and counted; that bound is a parameter, and what is collected
(votes and features of those rows) is bounded by it. Scores cover every whole text.

Defined results: null and empty texts score the base rate of a text without features; without labelled rows of both
classes only the seed list and the patterns score; a null label is no label; rows that repeat an id count each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerloom.llm.common import held_out, read, release, small_batches, stored

FIT_ROWS = 20_000
#: Entries that lean to toxic and to clean, and the labelled rows that an entry must occur in.
TOXIC_ENTRIES, CLEAN_ENTRIES, SUPPORT = 600, 200, 4
LEXICONS = 12
SEED = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting imbecile cretin clown fool freak vermin filth".split())
PATTERNS = [
    re.compile(r"!{2,}"),
    re.compile(r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){2,}"),
    re.compile(r"([a-z])\1{3,}", re.I),
    re.compile(r"\b[a-z]{1,3}[*#@$]{2,}[a-z]{1,3}\b", re.I),
    re.compile(r"\byou(?:'re| are)?\s+(?:\w+\s+){0,2}(?:" + "|".join(sorted(SEED)) + r")\b", re.I),
]
_LETTERS = re.compile(r"[^\W\d_]+")


def entries(text: str | None) -> set[str]:
    """Words and their beginnings of three to six letters (marked by a star)."""
    words = set(_LETTERS.findall(text.lower())) if text else set()
    return words | {w[:k] + "*" for w in words for k in (3, 4, 5, 6) if len(w) > k}


def pattern_hits(text: str | None) -> list[bool]:
    return [bool(text) and p.search(text) is not None for p in PATTERNS]


@dataclass
class Model:
    """Linear scorer: entries of the vocabulary, then the patterns, then the seed list."""

    vocabulary: dict[str, int]
    toxic: int
    weights: np.ndarray
    bias: float
    accuracies: dict[str, float] = field(default_factory=dict)
    correlations: np.ndarray | None = None

    def __post_init__(self):
        self._words = {w: i for w, i in self.vocabulary.items() if not w.endswith("*")}
        self._starts = [(k, {w[:-1]: i for w, i in self.vocabulary.items() if w.endswith("*") and len(w) == k + 1}) for k in (3, 4, 5, 6)]

    @property
    def size(self) -> int:
        return len(self.vocabulary) + len(PATTERNS) + 1

    def features(self, text: str | None) -> list[int]:
        found: set[int] = set()
        n = len(self.vocabulary)
        if text:
            words = set(_LETTERS.findall(text.lower()))
            found.update(self._words[w] for w in words & self._words.keys())
            for k, starts in self._starts:
                if starts:
                    found.update(starts[s] for s in {w[:k] for w in words if len(w) > k} & starts.keys())
            found.update(n + i for i, hit in enumerate(pattern_hits(text)) if hit)
            if words & SEED:
                found.add(n + len(PATTERNS))
        return sorted(found)

    def votes(self, features: list[int], label: int | None) -> list[int]:
        """1 toxic, -1 clean, 0 abstains; in the order of voters()."""
        here, n = set(features), len(self.vocabulary)
        toxic = [i for i in features if i < self.toxic]
        clean = [i for i in features if self.toxic <= i < n]
        lists = [0] * LEXICONS
        for i in toxic:
            lists[i % LEXICONS] = 1
        out = lists + [int(n + len(PATTERNS) in here), int(len(toxic) >= 3)]
        out += [int(n + i in here) for i in range(len(PATTERNS))]
        out += [-int(not toxic), -int(len(clean) >= 2), 0 if label is None else 2 * label - 1]
        return out

    @staticmethod
    def voters() -> list[str]:
        return [f"lexicon{i}" for i in range(LEXICONS)] + ["seed", "several"] + [f"pattern{i}" for i in range(len(PATTERNS))] + ["no_entry", "clean_entries", "label"]

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights[self.features(text)].sum())
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def label_model(votes: np.ndarray, prior: float, anchor: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic, p[class, voter, vote + 1], correlations within a class). anchor: the voter that EM starts from."""
    n, v = votes.shape
    post = np.where(votes[:, anchor] > 0, 0.9, np.where(votes[:, anchor] < 0, 0.1, prior))
    onehot = np.stack([votes == x for x in (-1, 0, 1)], axis=2).astype(np.float32)
    corr = np.eye(v)
    for _ in range(rounds):
        p = np.stack([(np.tensordot(w, onehot, (0, 0)) + 0.5) / (w.sum() + 1.5) for w in (1 - post, post)])
        expected = (1 - post)[:, None] * (p[0, :, 2] - p[0, :, 0]) + post[:, None] * (p[1, :, 2] - p[1, :, 0])
        rest = votes - expected
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
        corr = (rest.T @ rest) / n / np.outer(spread, spread)
        share = 1 / np.maximum(1, np.abs(np.where(np.abs(corr) > 0.1, corr, 0)).sum(axis=1))
        share[anchor] = 1.0
        rate = np.clip(post.mean(), 0.001, 0.999)
        gain = np.log(p[1]) - np.log(p[0])
        z = np.log(rate / (1 - rate)) + (np.einsum("nvk,vk->nv", onehot, gain) * share).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            post = new
            break
        post = new
    return post, p, corr


def logistic(rows: list[list[int]], target: np.ndarray, size: int, ridge: float = 0.02, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent over sparse 0/1 rows."""
    lengths = np.array([len(r) for r in rows])
    col = np.array([i for r in rows for i in r], np.int64)
    row = np.repeat(np.arange(len(rows)), lengths)
    w, b, pw, pb = np.zeros(size), 0.0, np.zeros(size), 0.0
    step = 4.0 / (1 + lengths.mean() + lengths.std())
    for t in range(rounds):
        m = t / (t + 3)
        yw, yb = w + m * (w - pw), b + m * (b - pb)
        z = np.bincount(row, yw[col], len(rows)) + yb
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        pw, pb = w, b
        w = yw - step * (np.bincount(col, error[row], size) / len(rows) + ridge / len(rows) * yw)
        b = yb - step * error.mean()
    return w, float(b)


def _drawn(rows: DataFrame, hash_: str, most: int) -> DataFrame:
    """At most `most` rows, those below a threshold of a hash that tells rows apart; never more, as every threshold is counted."""
    n, top = rows.count(), 1 << 62
    while n > most:
        top = int(top * most / n * 0.98)
        rows = rows.filter(F.shiftrightunsigned(hash_, 2) < top)
        n = rows.count()
    return rows


def _chosen(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, fit_rows: int) -> DataFrame:
    """(text, y) of at most fit_rows labelled rows. Of an id's several labels the greatest counts; at most fit_rows labelled ids go to every
    task, and the rows they meet are drawn again, so a repeated id or label can't break the bound."""
    labels = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL")
    labels = labels.groupBy("id").agg(F.max("y").alias("y")).withColumn("hash", F.xxhash64("id"))
    labels = stored(_drawn(labels, "hash", fit_rows), "toxic-labels")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("hash", F.xxhash64("id", "text", F.monotonically_increasing_id()))
    return stored(_drawn(rows.join(F.broadcast(labels.drop("hash")), "id"), "hash", fit_rows).select("text", "y"), "toxic-rows")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """labels holds only rows that may be learned from."""
    small_batches(docs.sparkSession)
    rows = _chosen(docs, labels, doc_id, text, label, fit_rows)

    def count(batches):
        for pdf in batches:
            both = Counter(), Counter()
            for t, y in zip(pdf["text"], pdf["y"]):
                both[int(y)].update(entries(t))
            both[0][""], both[1][""] = int((pdf["y"] == 0).sum()), int((pdf["y"] == 1).sum())
            keys = list(both[0].keys() | both[1].keys())
            yield pd.DataFrame({"entry": keys, "clean": [both[0][k] for k in keys], "toxic": [both[1][k] for k in keys]})
        both = keys = None
        release()

    sums = rows.mapInPandas(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sums = sums.filter(F.expr(f"clean + toxic >= {SUPPORT} OR entry = ''")).persist()
    try:
        base = sums.filter("entry = ''").first()
        if base is None or not base.clean or not base.toxic:
            return seeded()
        a, b, p, n = F.col("toxic") + 0.5, F.col("clean") + 0.5, base.toxic + 1.0, base.clean + 1.0
        lean = (F.log(a / (F.lit(p) - a)) - F.log(b / (F.lit(n) - b))) / F.sqrt(1 / a + 1 / b)
        scored = sums.filter("entry <> ''").withColumn("lean", lean)
        top = [r.entry for r in scored.filter("lean > 2").orderBy(F.desc("lean"), "entry").limit(TOXIC_ENTRIES).collect()]
        low = [r.entry for r in scored.filter("lean < -2").orderBy("lean", "entry").limit(CLEAN_ENTRIES).collect()]
    finally:
        sums.unpersist()
    model = Model({w: i for i, w in enumerate(top + low)}, len(top), np.zeros(0), 0.0)
    given = {"vocabulary": model.vocabulary, "toxic": model.toxic}

    @pandas_udf("array<int>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(given["vocabulary"], given["toxic"], np.zeros(0), 0.0)
        for texts in batches:
            yield texts.map(m.features)
        release()

    got = rows.select(features("text").alias("f"), "y").toPandas()  # at most fit_rows rows
    feats, y = [list(map(int, f)) for f in got["f"]], got["y"].to_numpy()
    votes = np.array([model.votes(f, int(t)) for f, t in zip(feats, y)], np.int8)
    names = Model.voters()
    post, p, corr = label_model(votes, float(y.mean()), names.index("label"))
    weights, bias = logistic(feats, post, model.size)
    right = (1 - post.mean()) * p[0, :, 0] + post.mean() * p[1, :, 2]
    says = right + (1 - post.mean()) * p[0, :, 2] + post.mean() * p[1, :, 0]
    return Model(model.vocabulary, model.toxic, weights, bias, dict(zip(names, (right / np.maximum(says, 1e-9)).tolist())), corr)


def seeded() -> Model:
    """What is left without labels: the seed list scores high, all else low."""
    weights = np.zeros(len(PATTERNS) + 1)
    weights[-1], weights[len(PATTERNS) - 1] = 5.0, 1.0
    return Model({}, 0, weights, -3.0)


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.vocabulary, model.toxic, model.weights, model.bias))

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = Model(*held.value)
        for texts in batches:
            yield texts.map(made.score).astype("float64")
        release()

    return docs.withColumn(name, score(F.col(text)))


def training_labels(labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return labels.filter(~held_out(doc_id, 5, 0))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", cut: float = 0.5) -> DataFrame:
    """Rows of docs that score below the cut, columns unchanged. The model is fitted on the rows of docs themselves."""
    model = fit(docs, training_labels(labels, doc_id), doc_id, text)
    packed = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    return with_score(packed, model).filter(F.col("score") < cut).select("doc.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, training_labels(read(spark, sf_dir, "labels")))
    scored = with_score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
