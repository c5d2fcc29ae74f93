"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIM values +1 and -1, drawn from a seed and its code point. An n-gram of letters is
bound by multiplying the vectors of its letters, each rotated by its place in the n-gram. A profile bundles (adds) the
vectors of all n-grams of its texts. A text is compared with each language's profile by cosine; the closest language wins.

Learning: each task bundles its rows into one vector for each language, Spark adds the vectors; what reaches the driver
is languages x DIM numbers. Scoring: the dot product of a text's bundle with a profile is the sum of those of its
n-grams, so a worker keeps one row of dot products for each n-gram it has met and never builds vectors for n-grams again.
One pass, no shuffle, whole texts.

The score is the share of the best language's cosine in the sum of all positive cosines, from 0 to 1 (the length of the
text's own bundle cancels out of it).

Defined results: null texts and texts without a letter are `und` with score 0; without training rows all are `und`; ties go
to the first language in order; letters are lower-cased, all else separates words as a blank.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerloom.llm.common import held_out, read, small_batches

DIM, GRAM, SEED = 2048, 3, 11
#: Characters that are turned into n-grams at once, and n-grams whose dot products a worker keeps.
AT_ONCE, KEPT = 1 << 20, 1 << 18
_BLANK = 32


class Letters:
    """Vectors of letters and n-grams, the same in every worker."""

    def __init__(self, dim: int, gram: int, seed: int):
        self.dim, self.gram, self.seed = dim, gram, seed
        self.known: dict[int, np.ndarray] = {}
        self.is_letter = np.zeros(0x110000, bool)
        self.is_letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True

    def letter(self, code: int) -> np.ndarray:
        if code not in self.known:
            self.known[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8) * np.int8(2) - np.int8(1)
        return self.known[code]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """One row for each packed n-gram: the product of its letters' vectors, the first one rotated the most."""
        out = np.ones((len(grams), self.dim), np.int8)
        for place in range(self.gram):
            codes = (grams >> np.uint64(21 * (self.gram - 1 - place))) & np.uint64(0x1FFFFF)
            each, where = np.unique(codes, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(c)), self.gram - 1 - place) for c in each])[where]
        return out

    def grams(self, text: str | None) -> np.ndarray:
        """Packed n-grams of the text with a blank before and after; n-grams of blanks only are left out."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = self.is_letter[codes]
        if not letter.any():
            return np.zeros(0, np.uint64)
        codes = np.concatenate(([_BLANK], np.where(letter, codes, _BLANK), [_BLANK])).astype(np.uint64)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)  # a run of blanks is one
        codes = codes[keep]
        n = len(codes) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for place in range(self.gram):
            out = (out << np.uint64(21)) | codes[place : place + n]
        return out


@cache
def letters(dim: int, gram: int, seed: int) -> Letters:
    """One per worker process."""
    return Letters(dim, gram, seed)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Profiles by language. docs holds only rows that may be learned from; rows without a language are left out."""

    def bundle(batches):
        made = letters(dim, gram, seed)
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for name, texts in pdf.groupby("lang")["text"]:
                for t in _chunks(texts):
                    grams = [made.grams(x) for x in t]
                    each, n = np.unique(np.concatenate(grams), return_counts=True)
                    total = sums.setdefault(name, np.zeros(dim))
                    for i in range(0, len(each), 2048):
                        total += n[i : i + 2048].astype(np.float32) @ made.vectors(each[i : i + 2048]).astype(np.float32)
        names = sorted(sums)
        for name in names:
            yield pd.DataFrame({"lang": pd.Series([name] * dim, dtype=object), "at": np.arange(dim), "value": sums[name]})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInPandas(bundle, "lang string, at int, value double")
    # whole numbers below 2^53: the sum doesn't depend on the order of tasks
    got = parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).toPandas().sort_values(["lang", "at"])
    found = {name: g["value"].to_numpy() for name, g in got.groupby("lang")}
    return {name: v for name, v in found.items() if v.any()}


def _chunks(texts) -> list[list]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "")
        if size >= AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


class Scorer:
    def __init__(self, profiles: dict[str, np.ndarray], dim: int, gram: int, seed: int):
        self.names = sorted(profiles)
        unit = np.stack([profiles[n] / np.linalg.norm(profiles[n]) for n in self.names]) if self.names else np.zeros((0, dim))
        self.unit = unit.astype(np.float32)
        self.letters = letters(dim, gram, seed)
        self.grams, self.dots = np.zeros(0, np.uint64), np.zeros((0, len(self.names)), np.float32)

    def _rows(self, each: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.grams, each)
        new = (np.take(self.grams, at, mode="clip") != each) if len(self.grams) else np.ones(len(each), bool)
        if new.any():
            if len(self.grams) > KEPT:
                self.grams, self.dots, new = self.grams[:0], self.dots[:0], np.ones(len(each), bool)
            fresh = each[new]
            dots = [self.letters.vectors(fresh[i : i + 2048]).astype(np.float32) @ self.unit.T for i in range(0, len(fresh), 2048)]
            grams = np.concatenate([self.grams, fresh])
            order = np.argsort(grams, kind="stable")
            self.grams, self.dots = grams[order], np.concatenate([self.dots, *dots])[order]
            at = np.searchsorted(self.grams, each)
        return self.dots[at]

    def score(self, texts: list) -> tuple[list[str], list[float]]:
        grams = [self.letters.grams(t) for t in texts]
        lengths = np.array([len(g) for g in grams], np.int64)
        if not self.names or not lengths.sum():
            return ["und"] * len(texts), [0.0] * len(texts)
        each, where = np.unique(np.concatenate(grams), return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), lengths)
        rows = self._rows(each)
        # cosines up to the length of the text's own bundle
        cos = np.stack([np.bincount(doc, rows[where, i], len(texts)) for i in range(len(self.names))], axis=1)
        best = cos.argmax(axis=1)
        positive = np.maximum(cos, 0).sum(axis=1)
        share = np.where(positive > 0, np.maximum(cos.max(axis=1), 0) / np.where(positive > 0, positive, 1), 0.0)
        return [self.names[b] if n else "und" for b, n in zip(best, lengths)], [float(s) if n else 0.0 for s, n in zip(share, lengths)]


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", name: str = "language", dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """docs and `name`, a struct (lang, score)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(profiles)
    made = {}

    @pandas_udf("struct<lang:string,score:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made["scorer"] = Scorer(held.value, dim, gram, seed)
        out = [made["scorer"].score(group) for group in _chunks(texts)]
        return pd.DataFrame({"lang": pd.Series([x for a, _ in out for x in a], dtype=object), "score": [x for _, b in out for x in b]})

    return docs.withColumn(name, of(F.col(text)))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return held_out(doc_id, 4, 2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.filter(~is_held_out()))
    found = predict(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", is_held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
