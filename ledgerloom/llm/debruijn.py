"""Removal of long passages that a document shares with an earlier one, by a compacted de Bruijn graph.

The graph's edges are the windows of K consecutive words, its nodes their K - 1 shared words. A document is a walk.

1. Edges travel in bundles: consecutive windows of a document with one minimizer (the least hash of their M-word parts),
   at most MOST of them. Equal windows have equal minimizers, so a minimizer that only one document id has is done with.
2. Equal bundles fold to one variant with its least source (id, text hash, first word). A minimizer with one variant
   is a path without a branch already. Where variants differ, the source texts are read again at the variants'
   coordinates, and their edges are joined with each edge's count and least source; an edge goes on along its
   path if both carry over from the edge before, else the node between them branches. Paths are stored with their variant.
3. Documents join the paths of their bundles; those whose source has a smaller id are kept, and neighbours that go on in
   the same source become one long span.
4. Spans are verified at their source coordinates: the words of a span and of its source are cut at multiples of CELL
   words of the source, and each piece's SHA-256 in both texts must be the same. A piece that differs (a hash collision)
   stops the job.
Keys are dealt in pieces where they are hot; only aggregates with map-side sums meet on them.

Defined results: words are what stands between blanks; null, empty and shorter texts lose nothing; a null id is neither
smaller nor larger than another, so its row loses nothing and takes nothing; rows with one id don't remove from each
other, whether equal or not; of several sources the least id counts; an empty table gives no rows; only the two named
columns are read, so others may have any name. A text of any length is walked over in blocks of AT_ONCE words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ledgerloom.llm.common import join_dealt, read, small_batches, stored

#: Words of a window and of a minimizer, windows in a bundle, words of a verified piece.
K, M, MOST, CELL = 50, 12, 64, 64
AT_ONCE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """One 64-bit hash for each word."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    digest, out, at = xxhash.xxh3_64_intdigest, [], 0
    while at < len(data):
        end = min(len(data), at + _SLICE)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = data[at:end].split()
        out.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Walk:
    """Polynomial hashes of any stretch of a text's words."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        back = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(powers)[:-1])))
        self.back = np.cumprod(back)

    def of(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def bundles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, hash of the words, first window, windows) of each bundle of a text."""
    parts: list[tuple] = []
    for lo in range(0, max(0, len(hashes) - K + 1), AT_ONCE):
        own = hashes[lo : lo + AT_ONCE + K - 1]
        walk, n = Walk(own), len(own) - K + 1
        at = np.arange(len(own) - M + 1)
        low, size = walk.of(at, at + M), 1
        while 2 * size <= K - M + 1:  # least of 2, 4, ... neighbours, then of all by two overlapping stretches
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[K - M + 1 - size :][:n])
        new = np.concatenate(([True], low[1:] != low[:-1]))
        since = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        first = np.flatnonzero(since % MOST == 0)
        count = np.diff(np.append(first, n))
        parts.append((low[first], walk.of(first, first + count + K - 1), first + lo, count))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    mini, content, first, count = (np.concatenate(p) for p in zip(*parts))
    return mini.view(np.int64), content.view(np.int64), first, count


def _bundle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hs, texts = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
        for i in range(0, batch.num_rows, 256):
            part = [bundles(word_hashes(texts[k].as_py())) for k in range(i, min(i + 256, batch.num_rows))]
            at = np.repeat(np.arange(i, i + len(part)), [len(p[0]) for p in part])
            if len(at):
                mini, content, first, count = (np.concatenate([p[c] for p in part]) for c in range(4))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(hs[at]), pa.array(mini), pa.array(content), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                    names=["id", "h", "mini", "content", "start", "windows"],
                )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            z = [squeeze(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(z, pa.binary())], names=["id", "h", "z"])


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each wanted variant: the hashes of its edges."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        ids, hs, texts, wanted = batch.column("id"), batch.column("h").to_numpy(), batch.column("z"), batch.column("wanted")
        for k in range(batch.num_rows):
            walk = Walk(word_hashes(unpack(texts[k].as_py())))
            asked = wanted[k].as_py()
            edges = [walk.of(at := np.arange(w["start"], w["start"] + w["windows"]), at + K).view(np.int64) for w in asked]
            ends = np.cumsum([0, *map(len, edges)], dtype=np.int32)
            take = pa.array(np.full(len(asked), k))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(take), pa.array(np.full(len(asked), hs[k])), pa.array([w["mini"] for w in asked], pa.int64()), pa.array([w["content"] for w in asked], pa.int64()),
                    pa.array([w["start"] for w in asked], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(edges))),
                ],
                names=["id", "h", "mini", "content", "start", "edges"],
            )


def _by_text(packed: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """packed (id, h, z) joined with lists (id, h, ...)."""
    lists = lists.withColumnsRenamed({"id": "id2", "h": "h2"})
    return packed.join(lists, packed["id"].eqNullSafe(F.col("id2")) & (packed["h"] == F.col("h2")), how).drop("id2", "h2")


def paths(rows: DataFrame, packed: DataFrame) -> DataFrame:
    """(id, h, start, windows, sid, sh, at): every stretch of windows in a document with the least source of its path, by word positions.

    rows: (id, h, text) with ids that are not null; packed: (id, h, z), the texts once more.
    """
    kind = rows.schema["id"].dataType
    long, small = LongType(), IntegerType()
    schema = StructType([StructField("id", kind), StructField("h", long), StructField("mini", long), StructField("content", long), StructField("start", small), StructField("windows", small)])
    all_ = stored(rows.mapInArrow(_bundle_rows, schema), "debruijn-bundles")
    stats = all_.groupBy("mini").agg(
        F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("content").alias("c1"), F.max("content").alias("c2"), F.count(F.lit(1)).alias("n")
    )
    stats = stored(stats.filter("lo < hi").select("mini", (F.col("c1") == F.col("c2")).alias("single"), "n"), "debruijn-minimizers")
    shared = stored(join_dealt(all_, stats, ["mini"], ["id", "h", "start"]).drop("n"), "debruijn-shared")
    variants = shared.groupBy("mini", "content", "windows", "single").agg(F.min(F.struct("id", "h", "start")).alias("source"), F.count(F.lit(1)).alias("n"))
    variants = stored(variants, "debruijn-variants")
    # variants of minimizers with several: their edges, read at the source
    branching = variants.filter("NOT single")
    wanted = branching.select("source.*", "windows", "mini", "content").groupBy("id", "h").agg(F.collect_list(F.struct("start", "windows", "mini", "content")).alias("wanted"))
    edge_schema = StructType([*schema.fields[:5], StructField("edges", ArrayType(long))])
    edges = _by_text(packed, wanted, "inner").mapInArrow(_edge_rows, edge_schema)
    edges = stored(edges.dropDuplicates(["mini", "content"]), "debruijn-edges")  # repeated rows give theirs each
    single = edges.select("id", "h", "mini", "content", "start", F.posexplode("edges").alias("i", "edge")).withColumn("at", F.col("start") + F.col("i"))
    ends = stored(single.groupBy("mini", "edge").agg(F.min(F.struct("id", "h", "at")).alias("source"), F.count(F.lit(1)).alias("n")), "debruijn-edge-stats")
    walk = join_dealt(single, ends.withColumn("count", F.col("n")), ["mini", "edge"], ["id", "h", "at"])
    along = Window.partitionBy("mini", "content").orderBy("i")
    before, count = F.lag("source").over(along), F.lag("count").over(along)
    goes_on = (before["id"] == F.col("source.id")) & (before["h"] == F.col("source.h")) & (before["at"] + 1 == F.col("source.at")) & (count == F.col("count"))
    heads = walk.withColumn("head", ~F.coalesce(goes_on, F.lit(False))).filter("head")
    pieces = heads.groupBy("mini", "content").agg(F.sort_array(F.collect_list(F.struct("i", F.col("source.id").alias("sid"), F.col("source.h").alias("sh"), F.col("source.at").alias("at")))).alias("heads"))
    one = F.array(F.struct(F.lit(0).alias("i"), F.col("source.id").alias("sid"), F.col("source.h").alias("sh"), F.col("source.start").alias("at")))
    known = variants.filter("single").select("mini", "content", "n", one.alias("heads"))
    known = known.unionByName(branching.select("mini", "content", "n").join(pieces, ["mini", "content"]))
    known = stored(known, "debruijn-paths")
    found = join_dealt(shared.drop("single"), known, ["mini", "content"], ["id", "h", "start"])
    each = found.select("id", "h", "start", "windows", "heads", F.posexplode("heads").alias("p", "head"))
    until = F.coalesce(F.get("heads", F.col("p") + 1)["i"], F.col("windows"))
    return each.select("id", "h", (F.col("start") + F.col("head.i")).alias("start"), (until - F.col("head.i")).alias("windows"), "head.sid", "head.sh", "head.at")


def long_spans(found: DataFrame) -> DataFrame:
    """Stretches that go on in the same source become one: (id, h, start, words, sid, sh, at)."""
    by_doc = Window.partitionBy("id", "h").orderBy("start")
    shift = F.col("at") - F.col("start")
    last = lambda c: F.lag(c).over(by_doc)
    goes_on = (last("sid") == F.col("sid")) & (last("sh") == F.col("sh")) & (last(shift) == shift) & (last(F.col("start") + F.col("windows")) == F.col("start"))
    rows = found.withColumn("span", F.sum(F.when(goes_on, 0).otherwise(1)).over(by_doc))
    return rows.groupBy("id", "h", "span").agg(
        F.min("start").alias("start"), (F.sum("windows") + K - 1).cast("int").alias("words"), F.first("sid").alias("sid"), F.first("sh").alias("sh"), F.min("at").alias("at")
    ).drop("span")


class Words:
    """Places of the words in the UTF-8 bytes of a text."""

    _BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))

    def __init__(self, data: bytes):
        self.data = data
        blank = self._BLANK[np.frombuffer(self.data, np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]

    def __len__(self) -> int:
        return len(self.starts)

    def part(self, lo: int, hi: int) -> bytes:
        """Words lo to hi, joined by one space."""
        return b" ".join(self.data[int(self.starts[lo]) : int(self.ends[hi - 1])].split()) if hi > lo else b""


def cells(at: int, words: int) -> list[tuple[int, int]]:
    """(first word, words) of the pieces of a source stretch, cut at multiples of CELL: a source of n words has O(n) different ones."""
    edges = [at, *range((at // CELL + 1) * CELL, at + words, CELL), at + words]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def _claims(kind: pa.DataType):
    """Digests of the pieces of a text's own spans and of those that others ask of it, by the place of the piece in its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (kind, pa.int64(), pa.int32(), pa.int32(), pa.binary())
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, said = batch.slice(i, 256), []
                for z, mine, asked in zip(part.column("z"), part.column("mine").to_pylist(), part.column("asked").to_pylist()):
                    if not mine and not asked:
                        continue
                    words = Words(unpack(z.as_py()))
                    own = [(s["sid"], s["sh"], at, n, s["start"] + at - s["at"]) for s in mine for at, n in cells(s["at"], s["words"])]
                    others = [(s["sid"], s["sh"], s["at"], s["n"], s["at"]) for s in asked]
                    said += [(*x[:4], hashlib.sha256(words.part(x[4], x[4] + x[3])).digest()) for x in own + others]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in said], t) for c, t in enumerate(types)], names=["sid", "sh", "at", "n", "digest"])

    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            sizes, spans, kept = [], [], []
            for z, mine in zip(part.column("z"), part.column("mine").to_pylist()):
                words = Words(unpack(z.as_py()))
                own: list[list[int]] = []
                for lo, n in sorted((s["start"], s["words"]) for s in mine or ()):
                    if own and lo <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], lo + n)
                    else:
                        own.append([lo, lo + n])
                edges = [0, *(x for s in own for x in s), len(words)]
                left = [words.part(a, b) for a, b in zip(edges[::2], edges[1::2]) if b > a]
                sizes.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())], names=["doc_id", "n_words", "spans", "kept"])


def lists_of(spans: DataFrame) -> DataFrame:
    """(id, h, mine, asked): the spans of each text and the pieces of it that spans elsewhere name as their source."""
    cell = F.explode(F.sequence(F.floor(F.col("at") / CELL), F.floor((F.col("at") + F.col("words") - 1) / CELL))).alias("cell")
    lo, hi = F.greatest("at", F.col("cell") * CELL), F.least(F.col("at") + F.col("words"), (F.col("cell") + 1) * CELL)
    pieces = spans.select("sid", "sh", "at", "words", cell).select("sid", "sh", lo.cast("int").alias("at"), (hi - lo).cast("int").alias("n")).distinct()
    mine = spans.select("id", "h", F.struct("start", "words", "sid", "sh", "at").alias("mine"))
    asked = pieces.select(F.col("sid").alias("id"), F.col("sh").alias("h"), F.struct("sid", "sh", "at", "n").alias("asked"))
    lists = mine.unionByName(asked, allowMissingColumns=True).groupBy("id", "h").agg(F.collect_list("mine").alias("mine"), F.collect_list("asked").alias("asked"))
    return stored(lists, "debruijn-lists")


def proof(both: DataFrame) -> DataFrame:
    """(doc_id), never a row: fails where a span has not the words of its source. both: (id, h, z, mine, asked)."""
    kind = both.schema["id"].dataType
    claim = StructType([StructField("sid", kind), StructField("sh", LongType()), StructField("at", IntegerType()), StructField("n", IntegerType()), StructField("digest", BinaryType())])
    claims = both.mapInArrow(_claims(to_arrow_type(kind)), claim)
    wrong = claims.groupBy("sid", "sh", "at", "n").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b")
    text = F.concat_ws(" ", F.lit("a span has not the words of its source, document"), F.col("sid").cast("string"), F.lit("at word"), F.col("at").cast("string"))
    return wrong.select(F.raise_error(text).cast(kind).alias("doc_id"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, kept) of every row: spans are the maximal runs of removed words, kept the words left, joined by one space."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))
    kind = rows.schema["id"].dataType
    packed = rows.mapInArrow(_packed, StructType([StructField("id", kind), StructField("h", LongType()), StructField("z", BinaryType())]))
    found = paths(rows.filter("id IS NOT NULL"), packed).filter("sid < id").dropDuplicates(["id", "h", "start"])
    lists = lists_of(stored(long_spans(found), "debruijn-spans"))
    both = _by_text(packed, lists, "left")  # its shuffle serves the result and the proof
    out = StructType([StructField("doc_id", kind), StructField("n_words", LongType()), StructField("spans", _SPANS), StructField("kept", StringType())])
    return both.mapInArrow(_cut_out, out).unionByName(proof(both), allowMissingColumns=True)


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def op11_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, w FROM t),
g AS (SELECT r, doc_id, i, w[i] AS word, CASE WHEN i + 49 <= n THEN sha256(array_to_string(w[i:i + 49], ' ')) END AS s FROM p),
f AS (SELECT s, min(doc_id) AS lowest FROM g WHERE s IS NOT NULL GROUP BY s),
m AS (SELECT g.r, i, word, coalesce(lowest < g.doc_id, false) AS again FROM g LEFT JOIN f ON g.s = f.s),
c AS (SELECT r, i, word, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m)
SELECT t.doc_id, len(t.w) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM t LEFT JOIN c ON t.r = c.r GROUP BY t.r, t.doc_id, t.w
"""
