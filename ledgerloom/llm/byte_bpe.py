"""Byte-level BPE over texts of any length.

Long texts are cut into overlapping chunks (rows of their own), each chunk is pre-tokenised where it lies, and
neighbours are stitched at the first boundary that both saw in their overlap. A match of the pattern only depends on
what follows its start, so from a common boundary on both agree; boundaries after white space are not taken, because
the pattern looks ahead there. The pieces between seams are encoded independently and their ids put together in order.
A text with an overlap without a common boundary (one run of letters longer than the overlap) is encoded as one piece.
Decoding concatenates the raw bytes of the ids.

The rank file is read once per Python worker; it is a parameter and never part of this library.

Defined results: null counts as empty and gives no ids; special-token strings are ordinary text; rows are told apart by
where they are stored, so ids may repeat or be null; other columns stay, but for those whose names the results take.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ledgerloom.llm.common import read, small_batches, stored

#: Characters of a chunk beyond its overlap with the next one, and of the overlap.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: A run of blanks from this length on is not left to the library's matcher.
LONG_RUN = 1 << 16
_RUN = regex.compile(rf"\s{{{LONG_RUN}}}")
#: Rows whose ids a Python worker holds at once.
ROWS = 256


def rank_file() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def boundaries(chunk: str, lo: int, hi: int) -> list[int]:
    """Starts of pre-tokens in [lo, hi) that don't follow white space. The last match is not trusted: the chunk may have cut it."""
    starts = [m.start() for m in _pattern().finditer(chunk)]
    return [p for p in starts[1:] if lo <= p < hi and not chunk[p - 1].isspace()]


def tokens(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text. Its longest run of blanks may be too much for the library's own matcher, which backtracks over all of it; such a
    text is matched here, and each match encoded by its ranks."""
    if len(text) < LONG_RUN or not _RUN.search(text):
        return enc.encode_ordinary(text)
    return [i for m in _pattern().finditer(text) for i in enc._core_bpe.encode_single_piece(m.group().encode("utf-8"))]


def _encoded(docs: DataFrame, text: str, ids: str, path: str, decoded: str | None = None) -> DataFrame:
    """docs, the ids of each text as one piece, and, if asked for, the bytes that these ids decode to."""

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                coded = [np.array(tokens(enc, t or ""), np.int32) for t in part.column(text).to_pylist()]
                ends = np.cumsum([0, *map(len, coded)], dtype=np.int32)
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(coded)))]
                if decoded:
                    columns.append(pa.array([enc.decode_bytes(x.tolist()) for x in coded], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, ids, *[decoded] * bool(decoded)])

    more = [StructField(ids, ArrayType(IntegerType()))] + ([StructField(decoded, BinaryType())] if decoded else [])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))


def encode(
    docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, decoded: str | None = None
) -> DataFrame:
    """docs and `ids`, the token ids of each whole text. decoded: name of a further column, as decode() would add it, made in the same pass."""
    path = path or rank_file()
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in (ids, decoded) if c])

    @pandas_udf("struct<head:array<int>,tail:array<int>>")
    def seams(parts: pd.Series) -> pd.DataFrame:
        found = [boundaries(t, 0, len(t)) for t in parts]
        return pd.DataFrame({"head": [[p for p in f if p < overlap] for f in found], "tail": [[p - chunk for p in f if p >= chunk] for f in found]})

    names = docs.columns
    short = F.length(F.coalesce(F.col(text), F.lit(""))) <= chunk + overlap
    quick = _encoded(docs.filter(short), text, ids, path, decoded)
    long = docs.filter(~short).select(F.struct(*names).alias("doc"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    long = stored(long, "bpe-long")
    # chunk i covers [i * chunk, (i + 1) * chunk + overlap)
    n = F.ceil((F.length("text") - overlap) / chunk).cast("int")
    chunks = long.select("row", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * chunk + 1, F.lit(chunk + overlap)))).alias("i", "part"))
    by_row = Window.partitionBy("row").orderBy("i")
    chunks = stored(chunks.repartition("row", "i").withColumn("s", seams("part")), "bpe-chunks")
    # positions relative to the chunk's start; `end` is the seam with the next chunk, `begin` that with the one before
    stitched = (
        chunks.select("row", "i", F.col("s.tail").alias("tail"), F.lead("s.head").over(by_row).alias("next_head"))
        .withColumn("end", F.array_min(F.array_intersect("tail", "next_head")))
        .withColumn("begin", F.coalesce(F.lag("end").over(by_row), F.lit(0)))
        .withColumn("whole", F.max(F.col("next_head").isNotNull() & F.col("end").isNull()).over(Window.partitionBy("row")))
        .select("row", "i", "begin", "end", "whole", F.col("next_head").isNull().alias("last"))
    )
    piece = F.expr(f"CASE WHEN last THEN substring(part, begin + 1) ELSE substring(part, begin + 1, {chunk} + end - begin) END")
    pieces = chunks.join(stitched.filter("NOT whole"), ["row", "i"]).select("row", "i", piece.alias("piece"))
    whole = long.join(stitched.filter("whole").select("row").distinct(), "row").select("row", F.lit(0).alias("i"), F.col("text").alias("piece"))
    coded = _encoded(pieces.union(whole), "piece", "ids", path)
    # all pieces of one text meet again: as many as the text's own cell has
    joined = coded.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("__ids"))
    slow = long.join(joined, "row").select("doc.*", F.col("__ids").alias(ids))
    return quick.unionByName(decode(slow, ids, decoded, path) if decoded else slow)


def decode(coded: DataFrame, ids: str = "ids", name: str = "decoded", path: str | None = None) -> DataFrame:
    """coded and `name`, the concatenated raw bytes of its ids; null ids count as none."""
    path = path or rank_file()
    coded = coded.drop(name)

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                made = [enc.decode_bytes(x or []) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, name])

    return coded.mapInArrow(run, StructType([*coded.schema.fields, StructField(name, BinaryType())]))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    coded = encode(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), decoded="decoded").drop("text")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
