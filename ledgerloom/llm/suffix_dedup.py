"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of WINDOW bytes that covers it also starts anywhere else. Sorting every suffix of a corpus would
move WINDOW bytes for each byte of text, so suffixes are sorted at anchors, which loses nothing:

1. Every window start p has an anchor: the place in [p, p + SPAN) with the least hash of the next eight bytes, the
   leftmost of equals. Equal windows have the anchor at the same offset d. About 2 in SPAN + 1 places are anchors.
2. Every window with its anchor at a holds the REACH bytes from a on. Anchors whose REACH bytes occur once can't matter;
   Spark counts hashes of them, and only anchors with a repeated hash go on (a false hash match does no harm).
3. Each task sorts the suffixes at its anchors (with the reversed bytes before the anchor as the tail of the key),
   folds equal ones, and front-codes its sorted run: shared prefix length and the rest.
4. Runs are cut at sampled splitters and exchanged; each range merges its runs with a loser tree that holds, for every
   run's head, its common prefix with the last key that left. Heads are ordered by those lengths; only equal lengths are
   compared, from there on, so a known prefix is never read again.
5. Neighbours in the merged order that share REACH bytes form a group. Two suffixes with right common prefix r and left
   common prefix l share the windows with WINDOW - r <= d <= l.
6. A group that straddles a splitter (one passage in very many documents) is not gathered: its windows are counted by
   128-bit digests in a Spark aggregation.

Defined results: null counts as empty; texts below WINDOW bytes lose nothing; rows that repeat id and text are
documents of their own, so each repeats the other; documents are told apart by id and text hash, so null and repeated
ids work; strings never cross documents; what is kept is bytes, as a cut may fall inside a character.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from ledgerloom.llm.common import read, small_batches, stored

WINDOW, SPAN, GRAM = 200, 128, 8
REACH = WINDOW - SPAN + 1
#: Window starts that are hashed at once, suffixes in a run, suffixes in a range, samples for each range.
AT_ONCE, RUN, RANGE, SAMPLES = 1 << 20, 1 << 15, 150_000, 20
_POS = np.uint64((1 << 22) - 1)
_TAIL = struct.Struct("<HHBBI")  # shared prefix, rest, least d, repeated, number in the run


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window start, last window start, hash of REACH bytes) of each anchor."""
    starts = len(data) - WINDOW + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    picked = []
    for b in range(0, starts, AT_ONCE):
        n = min(AT_ONCE, starts - b)
        low = (_mix(words[b : b + n + SPAN - 1].astype(np.uint64)) & ~_POS) | np.arange(n + SPAN - 1, dtype=np.uint64)
        size = 1
        while 2 * size <= SPAN:  # least of 2, 4, ... SPAN neighbours
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        picked.append((low[:n] & _POS).astype(np.int64) + b)
    pick = np.concatenate(picked)
    first = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))
    last = np.concatenate((first[1:], [starts])) - 1
    place = pick[first]
    h = np.full(len(place), 0, np.uint64)
    for off in [*range(0, REACH - 8, 8), REACH - 8]:
        h = _mix(h ^ words[place + off].astype(np.uint64))
    return place, first, last, h.view(np.int64)


def pack(place, first, last):
    """Place and the offsets of its window starts in one number; offsets are below 256."""
    return (place << 16) | ((place - first) << 8) | (place - last)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hs, texts = batch.column("id"), batch.column("h").to_numpy(), batch.column("text")
        for i in range(0, batch.num_rows, 512):
            where, out = [], []
            for k in range(i, min(i + 512, batch.num_rows)):
                place, first, last, h = anchors((texts[k].as_py() or "").encode("utf-8", "surrogatepass"))
                if len(place):
                    where.append(np.full(len(place), k))
                    out.append((pack(place, first, last), h))
            if out:
                at = np.concatenate(where)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(hs[at]), pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out]))],
                    names=["id", "h", "anchor", "key"],
                )


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            z = [squeeze((t or "").encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(z, pa.binary())], names=["id", "h", "z"])


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are common for sure and not read."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        end = min(known + step, n)
        if a[known:end] != b[known:end]:
            while step > 1:
                step //= 2
                if a[known : known + step] == b[known : known + step] and known + step < n:
                    known += step
            while known < n and a[known] == b[known]:
                known += 1
            return known
        known, step = end, min(step * 2, 256)
    return n


def front_code(entries) -> bytes:
    """Sorted (number, (key, least d, repeated)) as a run: each with its shared prefix with the one before, rest and number."""
    out, before = [], b""
    for number, (key, d, many) in entries:
        k = shared_prefix(before, key, 0)
        out.append(_TAIL.pack(k, len(key) - k, d, many, number) + key[k:])
        before = key
    return b"".join(out)


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(shared prefix with the one before, key, least d, repeated, number) of a run."""
    at, key, size = 0, b"", _TAIL.size
    while at < len(blob):
        k, rest, d, many, number = _TAIL.unpack_from(blob, at)
        at += size
        key = key[:k] + blob[at : at + rest]
        at += rest
        yield k, key, d, many, number


def merged(runs: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes, int, int, int, int]]:
    """(common prefix with the last one, key, least d, repeated, run, number) in order, by a loser tree.

    heads[s] is the head of run s, and known[s] its common prefix with the key that left last. The longer of two known
    prefixes belongs to the smaller key; equal ones are read from there on, and the loser remembers how far both agreed,
    which is its common prefix with the winner.
    """
    streams = [decoded(blob) for _, blob in runs]
    names = [name for name, _ in runs]
    n = len(streams)
    heads = [next(s, None) for s in streams]
    known = [0] * n
    tree = [-1] * n  # losers; tree[0] is not used

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        p, q = x[1], y[1]
        k = shared_prefix(p, q, ka)
        if k == len(q) and (k < len(p) or b < a) or k < len(p) and k < len(q) and q[k] < p[k]:
            a, b = b, a
        known[b] = k
        return a, b

    def build(node: int) -> int:
        if node >= n:
            return node - n
        win, tree[node] = play(build(2 * node), build(2 * node + 1))
        return win

    winner = build(1) if n > 1 else 0
    while n and heads[winner] is not None:
        _, key, d, many, number = heads[winner]
        yield known[winner], key, d, many, names[winner], number
        heads[winner] = after = next(streams[winner], None)
        known[winner] = after[0] if after else 0
        node = (winner + n) // 2
        while node >= 1 and n > 1:
            winner, tree[node] = play(winner, tree[node])
            node //= 2


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run of the suffixes at candidate anchors, and where each suffix lies. Rows: (run, blob) or (run, number, id, h, place).

    Short runs of RUN suffixes are sorted in memory and merged at the end of the task; only front-coded bytes wait.
    A number is that of the short run and the place in it.
    """
    from pyspark import TaskContext

    unpack = zstandard.ZstdDecompressor().decompress
    name = TaskContext.get().partitionId()
    names = ["run", "number", "id", "h", "place", "blob"]
    held: list[tuple[bytes, int]] = []
    owners: list[tuple[pa.Array, np.ndarray]] = []
    where: list[np.ndarray] = []
    blobs: list[tuple[int, bytes]] = []
    id_type = None

    def flush():
        base = len(blobs) * RUN
        number_of, entries = np.zeros(len(held), np.int64), []
        for i in sorted(range(len(held)), key=held.__getitem__):
            key, d = held[i]
            if entries and entries[-1][1][0] == key and entries[-1][1][1] == d:
                entries[-1][1][2] = 1
            else:
                entries.append((base + len(entries), [key, d, 0]))
            number_of[i] = entries[-1][0]
        blobs.append((len(blobs), front_code(entries)))
        n = len(held)
        ids, hs = pa.concat_arrays([x[0] for x in owners]), np.concatenate([x[1] for x in owners])
        rows = pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(number_of), ids, pa.array(hs), pa.array(np.concatenate(where)), pa.nulls(n, pa.binary())], names=names)
        held.clear(), owners.clear(), where.clear()
        return rows

    for batch in batches:
        id_type = batch.column("id").type
        for i in range(batch.num_rows):
            data = unpack(batch.column("z")[i].as_py())
            found = np.sort(batch.column("anchors")[i].values.to_numpy())
            for s in range(0, len(found), RUN // 2):
                packed = found[s : s + RUN // 2]
                if len(held) + len(packed) > RUN:
                    yield flush()
                place, before, least = packed >> 16, (packed >> 8) & 255, packed & 255
                for p, most, d in zip(place.tolist(), before.tolist(), least.tolist()):
                    held.append((data[p : p + WINDOW - d] + data[p - most : p][::-1], d))
                owners.append((batch.column("id").take(pa.array(np.full(len(packed), i))), np.full(len(packed), batch.column("h")[i].as_py())))
                where.append(place)
    if held:
        yield flush()
    if blobs:
        blob = blobs[0][1] if len(blobs) == 1 else front_code((number, (key, d, many)) for _, key, d, many, _, number in merged(blobs))
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([name]), none, pa.nulls(1, id_type), none, none, pa.array([blob], pa.binary())], names=names)


def _samples(share: float):
    """Keys of a regular share of each run."""

    def rows(batches):
        for batch in batches:
            keys = []
            for blob in batch.column("blob").to_pylist():
                seen = 0.0
                for _, key, d, _, _ in decoded(blob):
                    seen += share
                    if seen >= 1:
                        seen -= 1
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    return rows


def _cut_runs(splitters: list[bytes]):
    """Pieces of runs by range; each piece is front-coded anew from its first key."""

    def rows(batches):
        for batch in batches:
            for run, blob in zip(batch.column("run").to_pylist(), batch.column("blob").to_pylist()):
                pieces: dict[int, list] = {}
                at = 0
                for _, key, d, many, number in decoded(blob):
                    while at < len(splitters) and key >= splitters[at]:
                        at += 1
                    pieces.setdefault(at, []).append((number, (key, d, many)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(pieces), pa.int32()), pa.array([run] * len(pieces), pa.int64()), pa.array([front_code(x) for x in pieces.values()], pa.binary())],
                    names=["range", "run", "blob"],
                )

    return rows


def _split(key: bytes, d: int) -> tuple[bytes, bytes]:
    return key[: WINDOW - d], key[WINDOW - d :]


def group_windows(group: list[tuple[int, bytes, int, int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(run, number, d from, d to) of windows that occur again, in a group of neighbours that share REACH bytes."""
    distinct: list[list] = []  # [right, left, least d, repeated, members, common prefix with the one before]
    for k, key, d, many, run, number in group:
        if distinct and distinct[-1][6] == key and distinct[-1][2] == d:
            distinct[-1][3] = 1
            distinct[-1][4].append((run, number))
        else:
            right, left = _split(key, d)
            distinct.append([right, left, d, many, [(run, number)], k, key])
    single = [i for i, x in enumerate(distinct) if not x[3]]
    for x in distinct:
        if x[3]:
            for run, number in x[4]:
                yield run, number, x[2], len(x[1])
    if not single or len(distinct) == 1:
        return
    if len(distinct) <= 24:
        for i in single:
            right, left, least, _, members, _, _ = distinct[i]
            for j, y in enumerate(distinct):
                if i == j:
                    continue
                r = shared_prefix(right, y[0], REACH)
                lo = max(WINDOW - r, least, y[2])
                if lo > min(len(left), len(y[1])):
                    continue
                hi = shared_prefix(left, y[1], 0)
                if lo <= hi:
                    yield *members[0], lo, hi
        return
    seen: dict[tuple[int, bytes], int] = {}
    for right, left, least, _, _, _, _ in distinct:
        for d in range(least, len(left) + 1):
            w = (d, right[: WINDOW - d] + left[:d])
            seen[w] = seen.get(w, 0) + 1
    for i in single:
        right, left, least, _, members, _, _ = distinct[i]
        start = None
        for d in range(least, len(left) + 2):
            again = d <= len(left) and seen[d, right[: WINDOW - d] + left[:d]] > 1
            if again and start is None:
                start = d
            elif not again and start is not None:
                yield *members[0], start, d - 1
                start = None


def _merge_ranges(open_groups: frozenset[bytes]):
    """Repeated windows of each range. Windows of groups that other ranges hold too leave as digests."""

    def rows(batches):
        pieces: dict[int, list] = {}
        for batch in batches:
            for r, run, blob in zip(*(batch.column(c).to_pylist() for c in ("range", "run", "blob"))):
                pieces.setdefault(r, []).append((run, blob))
        out: list[tuple] = []

        def emit():
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["run", "number", "lo", "hi", "digest", "times"])

        def close(group):
            if not group:
                return
            if group[0][1][:REACH] in open_groups:
                for _, key, d0, many, run, number in group:
                    right, left = _split(key, d0)
                    for d in range(d0, len(left) + 1):
                        out.append((run, number, d, d, hashlib.blake2b(bytes([d]) + right[: WINDOW - d] + left[:d], digest_size=16).digest(), 1 + many))
            elif len(group) > 1 or group[0][3]:
                out.extend((*x, None, None) for x in group_windows(group))

        for r in sorted(pieces):
            group: list = []
            for entry in merged(sorted(pieces.pop(r))):
                if group and entry[0] < REACH:
                    close(group)
                    group = []
                    if len(out) > 50_000:
                        yield emit()
                        out.clear()
                group.append(entry)
            close(group)
        if out:
            yield emit()

    return rows


def repeated_windows(docs: DataFrame, range_size: int = RANGE) -> DataFrame:
    """(id, h, starts): starts holds structs (lo, hi), the window starts whose WINDOW bytes occur again. docs: id, h, text."""
    spark = docs.sparkSession
    id_type = docs.schema["id"].dataType
    base = [StructField("id", id_type), StructField("h", LongType())]
    found = stored(docs.mapInArrow(_anchor_rows, StructType([*base, StructField("anchor", LongType()), StructField("key", LongType())])), "anchors")
    often = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    picked = found.join(often, "key").groupBy("id", "h").agg(F.collect_set("anchor").alias("anchors"))
    texts = docs.mapInArrow(_packed_texts, StructType([*base, StructField("z", BinaryType())])).withColumnsRenamed({"id": "id2", "h": "h2"})
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
    run_type = StructType([StructField("run", LongType()), StructField("number", LongType()), *base, StructField("place", LongType()), StructField("blob", BinaryType())])
    runs = stored(texts.join(picked, same).select("id", "h", "z", "anchors").mapInArrow(_run_rows, run_type), "suffix-runs")
    places, blobs = runs.filter("blob IS NULL").drop("blob"), runs.filter("blob IS NOT NULL").select("run", "blob")
    ranges = max(1, -(-places.count() // range_size))
    splitters: list[bytes] = []
    if ranges > 1:
        # as a range partitioner does: a sample in proportion to the number of ranges
        keys = sorted(bytes(r.key) for r in blobs.mapInArrow(_samples(SAMPLES * ranges / max(1, places.count())), "key binary").collect())
        splitters = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    open_groups = frozenset(s[:REACH] for s in splitters)
    pieces = blobs.mapInArrow(_cut_runs(splitters), "range int, run long, blob binary").repartition(len(splitters) + 1, "range")
    out_type = StructType([StructField("run", LongType()), StructField("number", LongType()), StructField("lo", IntegerType()), StructField("hi", IntegerType()), StructField("digest", BinaryType()), StructField("times", IntegerType())])
    windows = pieces.mapInArrow(_merge_ranges(open_groups), out_type)
    if open_groups:
        windows = stored(windows, "windows")
        counted = windows.filter("digest IS NOT NULL")
        twice = counted.groupBy("digest").agg(F.sum("times").alias("n")).filter("n > 1").select("digest")
        windows = windows.filter("digest IS NULL").drop("digest").unionByName(counted.join(twice, "digest").drop("digest"))
    at = windows.select("run", "number", "lo", "hi").join(places, ["run", "number"])
    # an offset d stands for the window start d bytes before the anchor
    return at.groupBy("id", "h").agg(F.collect_set(F.struct((F.col("place") - F.col("hi")).alias("lo"), (F.col("place") - F.col("lo")).alias("hi"))).alias("starts"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            sizes, spans, kept = [], [], []
            for z, starts in zip(part.column("z").to_pylist(), part.column("starts").to_pylist()):
                data = unpack(z)
                own: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in starts or ()):
                    if own and lo <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], hi + WINDOW)
                    else:
                        own.append([lo, hi + WINDOW])
                at, left = 0, []
                for s, e in own:
                    left.append(data[at:s])
                    at = e
                sizes.append(len(data))
                spans.append([{"start": s, "end": e} for s, e in own])
                kept.append(b"".join([*left, data[at:]]))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_size: int = RANGE) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: spans are the maximal runs of removed bytes, kept the bytes left."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("h"), body.alias("text"))
    starts = repeated_windows(rows, range_size)
    id_type = rows.schema["id"].dataType
    packed = rows.mapInArrow(_packed_texts, StructType([StructField("id", id_type), StructField("h", LongType()), StructField("z", BinaryType())]))
    starts = starts.withColumnsRenamed({"id": "id2", "h": "h2"})
    both = packed.join(starts, packed["id"].eqNullSafe(F.col("id2")) & (packed["h"] == F.col("h2")), "left").select("id", "z", "starts")
    spans = "array<struct<start:bigint,end:bigint>>"
    return both.mapInArrow(_removed, f"doc_id {id_type.simpleString()}, n_bytes long, spans {spans}, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
