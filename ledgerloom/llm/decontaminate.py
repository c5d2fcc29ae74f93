"""Benchmark decontamination: which documents hold a benchmark item, whole or edited.

A text is its sequence of words. The CGK embedding walks over a window with a pointer: step j writes the word under the
pointer, then moves on by a random bit that depends on j and that word, and stays at the window's last word once it is there.
Windows at small edit distance fall back into step after an edit, so edit distance becomes Hamming distance. Windows have
the size of the items: items go by length to classes whose lengths differ by a quarter at most, and a class's windows
have its least length. Each of TABLES repetitions has its own random bits and its own start in the first half of the item, and
samples SAMPLES steps spread over its whole walk (two steps for a word) as its key. A window that shares a key with an item
is a candidate, and the edit distance in words decides: an item is found where it aligns with some stretch of the document
within (1 - similarity) of its own words.

Windows start at every word of every document, but for places where too few of the class's words, or of its pairs of
neighbouring words, stand for any of its items to be within the distance. An edit takes one word and two pairs at most, so
that filter is exact. Candidates of a key are taken in blocks of AT_ONCE pairs, which first must
hold enough words of the item's own, so a key that many items and places share costs time, never memory.

Recall: an unedited item shares all of its keys. For items with a fifth of their words edited the test measures it by length
(target 0.95, found 1.0 over 1,200 copies of items of 1 to 60 words); TABLES and SAMPLES are set for that.

The benchmark is a query set: its items go to the tasks in blocks of at most BLOCK_CHARS characters, one pass over the
documents for each block. Documents are never shuffled.

Defined results: null, empty and wordless texts hold nothing; items without words are held nowhere; repeated items are
all reported; of several places of one item the one with the least (distance, start, end) is given; letter case, punctuation and
spacing don't count; very long texts are searched whole; without documents or items there are no rows. A column of docs with
the name of the new one is replaced; all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerloom.llm.common import read, small_batches, stored

#: Repetitions of the walk, and sampled steps of each.
TABLES, SAMPLES = 32, 3
#: Wordless places between two documents in a row of ids.
GAP = 12
BLOCK_CHARS = 8 << 20
#: Words of documents that are walked over at once, and candidate pairs that are looked at at once.
AT_ONCE = 1 << 19
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def fitting_distances(items: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, start, end) of each row: the least edit distance of the row of items to a stretch doc[start:end] of the row of
    docs, the first of the nearest ends. -1 in docs equals nothing."""
    steps = np.arange(docs.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(docs), len(steps)), np.int32)
    begin = np.repeat(steps[None], len(docs), axis=0)
    edge = np.zeros((len(docs), 1), np.int32)
    for i in range(items.shape[1]):
        change = np.concatenate((edge + i + 1, row[:, :-1] + (docs != items[:, i : i + 1])), axis=1)
        drop = row + 1
        best = np.minimum(change, drop)
        source = np.where(change <= drop, np.concatenate((edge, begin[:, :-1]), axis=1), begin)
        # words of the document left out: the nearest cell to the left, one more for each word
        reach = best - steps
        low = np.minimum.accumulate(reach, axis=1)
        at = np.maximum.accumulate(np.where(reach == low, steps, 0), axis=1)
        row, begin = low + steps, np.take_along_axis(source, at, axis=1)
    end = row.argmin(axis=1)
    every = np.arange(len(docs))
    return row[every, end], begin[every, end], end


def fitting_distance(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """The same for one item and one document."""
    distance, start, end = fitting_distances(np.asarray(item)[None], np.asarray(doc)[None])
    return int(distance[0]), int(start[0]), int(end[0])


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Table:
    """One repetition for windows of `size` words."""

    def __init__(self, size: int, t: int, rng: np.random.Generator):
        self.start = size * t // (2 * TABLES)
        self.size = size - self.start
        walk = 2 * self.size
        self.steps = sorted(rng.choice(walk, min(SAMPLES, walk), replace=False).tolist())
        self.odds, self.salts = (rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (walk, len(self.steps)))

    def keys(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Key of the window of each item-sized stretch that begins there."""
        place = begins + self.start
        last = place + self.size - 1
        key, seen = np.zeros(len(begins), np.uint64), 0
        for j in range(self.steps[-1] + 1):
            here = symbols[place]
            if j == self.steps[seen]:
                key = _spread(key + here * self.salts[seen])
                seen += 1
            place = np.minimum(place + ((here * self.odds[j]) >> np.uint64(63)).astype(np.int64), last)
        return key


class Index:
    """The keys of a block of items."""

    def __init__(self, items: list[str | None], similarity: float):
        self.texts, self.similarity = items, similarity

    @cached_property
    def vocabulary(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(dict.fromkeys(w for t in self.texts for w in words_of(t)), 1)}

    @cached_property
    def items(self) -> list[np.ndarray]:
        return [np.array([self.vocabulary[w] for w in words_of(t)], np.int64) for t in self.texts]

    def allowed(self, n):
        """Edits within which an item of n words is held."""
        return ((1 - self.similarity) * n + 1e-9).astype(np.int64)

    @cached_property
    def symbols(self) -> np.ndarray:
        """A random number for each word; 0 stands for all words of no item."""
        return _spread(np.arange(1, len(self.vocabulary) + 2, dtype=np.uint64) * np.uint64(0x94D049BB133111EB))

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        return ids[:-1] * (len(self.vocabulary) + 1) + ids[1:]

    @cached_property
    def pairs(self) -> np.ndarray:
        """Sorted codes of the pairs of neighbouring words of all items."""
        return np.unique(np.concatenate([np.zeros(0, np.int64), *map(self._codes, self.items)]))

    def _pairs_at(self, ids: np.ndarray) -> np.ndarray:
        """For each place, the number of its pair of words from 1, or 0 for a pair of no item."""
        out = np.zeros(max(0, len(ids) - 1), np.int64)
        both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        if len(both) and len(self.pairs):
            code = self._codes(ids)[both]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            out[both] = np.where(self.pairs[at] == code, at + 1, 0)
        return out

    @cached_property
    def classes(self) -> list[tuple]:
        """(least and greatest length, words and pairs of the items, how many of each one leaves, tables with sorted keys and the items of each)."""
        out, todo = [], np.unique(self.lengths[self.lengths > 0])
        while len(todo):
            lo, own = int(todo[0]), todo[todo * 4 <= todo[0] * 5]
            todo = todo[len(own) :]
            members = np.flatnonzero((self.lengths >= lo) & (self.lengths <= own[-1]))
            known = np.zeros(len(self.vocabulary) + 1, bool)
            known[np.concatenate([self.items[k] for k in members])] = True
            paired = np.zeros(len(self.pairs) + 1, bool)
            for k in members:
                paired[np.searchsorted(self.pairs, self._codes(self.items[k])) + 1] = True
            row = self.symbols[np.concatenate([self.items[k] for k in members])]
            begins = np.concatenate(([0], np.cumsum(self.lengths[members])))[:-1]
            rng, tables = np.random.default_rng(lo), []
            for t in range(TABLES):
                table = Table(lo, t, rng)
                keys = table.keys(row, begins)
                order = np.argsort(keys, kind="stable")
                tables.append((table, keys[order], members[order]))
            edits = self.allowed(own)
            need = int((own - edits).min()), max(0, int((own - 1 - 2 * edits).min()))
            out.append((lo, int(own[-1]), known, paired, need, tables))
        return out

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (where the item would begin in ids, item) of windows that share a key with an item."""
        n = len(ids)
        symbols, pair_at = None, self._pairs_at(ids)
        for lo, hi, known, paired, (words, pairs), tables in self.classes:
            if n < lo:
                continue
            slack = int(self.allowed(np.array(hi)))
            places = n - lo + 1
            seen = np.cumsum(paired[pair_at], dtype=np.int32)
            seen = np.concatenate((np.zeros(slack + 1, np.int32), seen, np.full(hi + slack + 1, seen[-1] if len(seen) else 0)))
            begin = np.flatnonzero(seen[hi + 2 * slack :][:places] - seen[:places] >= pairs)
            if len(begin):
                seen = np.concatenate(([0], np.cumsum(known[ids])))
                begin = begin[seen[np.minimum(begin + hi + slack, n)] - seen[np.maximum(begin - slack, 0)] >= words]
            if not len(begin):
                continue
            symbols = self.symbols[ids] if symbols is None else symbols
            for table, keys, owners in tables:
                own = table.keys(symbols, begin)
                first, end = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                hit = np.flatnonzero(end > first)
                many = (end - first)[hit]
                done = np.concatenate(([0], np.cumsum(many)))
                for p in range(0, int(done[-1]), AT_ONCE):  # a block of the pairs, whatever the number of each place
                    pair = np.arange(p, min(p + AT_ONCE, int(done[-1])))
                    at = np.searchsorted(done, pair, "right") - 1
                    yield begin[hit[at]], owners[first[hit[at]] + pair - done[at]]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.items], np.int64)

    @cached_property
    def members(self) -> np.ndarray:
        """Sorted codes of (item, word)."""
        size = len(self.vocabulary) + 1
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(k * size + x for k, x in enumerate(self.items))]))

    def _within(self, c: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(candidate, distance, start, end) of those of the candidates c whose item is within its distance of ids[lo:hi]; items of one length are
        compared at once."""
        for n in np.unique(self.lengths[item[c]]):
            same = c[self.lengths[item[c]] == n]
            place = lo[same][:, None] + np.arange(int((hi - lo)[same].max()))
            stretch = np.where(place < hi[same][:, None], ids[np.minimum(place, len(ids) - 1)], -1)
            distance, start, end = fitting_distances(np.stack([self.items[k] for k in item[same]]), stretch)
            near = distance <= allowed[same]
            yield from zip(same[near].tolist(), distance[near].tolist(), start[near].tolist(), end[near].tolist())

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text, the items it holds with their nearest place."""
        lookup = self.vocabulary.get
        split = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        pad = GAP + int(self.allowed(self.lengths.max(initial=0)))  # an item may begin before the first word or end after the last one
        begins = pad + np.concatenate(([0], np.cumsum(lengths + GAP)))
        ids = np.zeros(int(begins[-1]) + pad, np.int64)
        for b, words in zip(begins.tolist(), split):
            ids[b : b + len(words)] = np.fromiter(map(lookup, words, repeat(0)), np.int64, len(words))
        # an item within the distance leaves so many of its words in the stretch: first any item's words, then its own
        seen = np.concatenate(([0], np.cumsum(ids > 0)))
        size = len(self.vocabulary) + 1
        best: dict[tuple[int, int], tuple] = {}
        tried: set[tuple[int, int]] = set()  # the tables find the same pairs
        for begin, item in self.candidates(ids):
            doc = np.clip(np.searchsorted(begins, begin + self.lengths[item] // 2, "right") - 1, 0, len(texts) - 1)
            allowed = self.allowed(self.lengths)[item]
            lo = np.maximum(begins[doc], begin - allowed)
            hi = np.minimum(begins[doc] + lengths[doc], begin + self.lengths[item] + allowed)
            need = self.lengths[item] - allowed
            stay = np.flatnonzero((hi > lo) & (seen[np.maximum(hi, lo)] - seen[lo] >= need))
            for i in range(0, len(stay), 4096):
                c = stay[i : i + 4096]
                width = hi[c] - lo[c]
                row = np.repeat(np.arange(len(c)), width)
                at = lo[c][row] + np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)
                code = item[c][row] * size + ids[at]
                own = self.members[np.minimum(np.searchsorted(self.members, code), len(self.members) - 1)] == code
                c = c[np.bincount(row[own], minlength=len(c)) >= need[c]]
                c = c[[not (p in tried or tried.add(p)) for p in zip(begin[c].tolist(), item[c].tolist())]]
                for k, distance, start, end in self._within(c, item, lo, hi, ids, allowed):
                    key = (int(doc[k]), int(item[k]))
                    base = int(lo[k]) - int(begins[key[0]])
                    found = (distance, base + start, base + end)
                    best[key] = min(best.get(key, found), found)
        out: list[list[dict]] = [[] for _ in texts]
        spans: dict[int, list] = {}
        for (doc, k), (distance, s, e) in sorted(best.items()):
            if doc not in spans:  # places in the lower-cased text are those of the text but for a few letters that grow
                spans[doc] = [m.span() for m in _WORD.finditer(texts[doc].lower())]
            first, last = spans[doc][s][0], spans[doc][e - 1][1]
            out[doc].append({"item": k, "distance": distance, "words": len(self.items[k]), "start": first, "end": last})
        return out


def _groups(texts: pd.Series) -> Iterator[list]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t or "") // 6
        if size >= AT_ONCE:
            yield group
            group, size = [], 0
    if group:
        yield group


def with_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8, name: str = "items") -> DataFrame:
    """docs and `name`: structs (item_id, distance, words, start, end) of the items that each row holds, start and end in characters of the lower-cased text."""
    chosen = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    small_batches(docs.sparkSession)
    total = chosen.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = 1 + total // BLOCK_CHARS
    numbered = chosen if blocks == 1 else stored(chosen.select("*", F.xxhash64("id", "text", F.monotonically_increasing_id()).alias("row")), "benchmark-items")
    numbered = numbered.withColumn("row", F.lit(0)) if blocks == 1 else numbered
    parts = []
    for b in range(blocks):
        rows = numbered.filter(F.pmod("row", F.lit(blocks)) == b).collect()  # a block, by the count above; repeated items spread too
        if not rows:
            continue
        held = docs.sparkSession.sparkContext.broadcast(([r.text for r in rows], [r.id for r in rows]))
        parts.append(_found(F.col(text), held, similarity, benchmark.schema[item_id].dataType.simpleString()))
    kind = benchmark.schema[item_id].dataType.simpleString()
    none = F.array().cast(f"array<struct<item_id:{kind},distance:int,words:int,start:int,end:int>>")
    return docs.withColumn(name, F.concat(none, *parts))


def _found(text, held, similarity: float, kind: str):
    made = {}

    @pandas_udf(f"array<struct<item_id:{kind},distance:int,words:int,start:int,end:int>>")
    def search(texts: pd.Series) -> pd.Series:
        items, ids = held.value
        if not made:
            made["index"] = Index(items, similarity)
        out = []
        for group in _groups(texts):
            for found in made["index"].search(group):
                out.append([{"item_id": ids[f["item"]], "distance": f["distance"], "words": f["words"], "start": f["start"], "end": f["end"]} for f in found])
        return pd.Series(out, dtype=object)

    return search(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of docs that hold no item, columns unchanged."""
    packed = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    return with_items(packed, benchmark).filter(F.size("items") == 0).select("doc.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_items(docs, read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("items"))
