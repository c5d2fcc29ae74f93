"""SimHash near-duplicates with bit-sliced comparison.

1. A fingerprint per text: majority vote over the bits of its word-shingle hashes (numpy over Arrow batches).
2. Equal fingerprints collapse to one row before anything is compared.
3. Candidates without loss: 64 bits are cut into 6 blocks; fingerprints within 4 bits agree on at least 2 blocks, so each
   goes to the 15 bands of two blocks. Only bands that hold two or more are compared.
4. Bands are compared in blocks of 64 lanes: bit planes are stored vertically, one 64-bit word per bit position, and one
   query updates 64 distances at once with carry-save counters. A block is abandoned as soon as all of its lanes exceed
   the radius. A row that is already linked into a component of its band is not searched for again, so a dense band
   costs about its size, and at most size - 1 links leave it.
   Bands of at most 64 emit all of their links.
   Wide fingerprints (512 bits) ask many queries in one call, and a tree of carry-save adders takes 16 planes at once.
5. Bands above TILE rows are dealt to pairs of tiles, so that no task holds a whole hot band; all pairs are still compared.
6. Connected components over the links.

Defined results: null and blank texts have fingerprint zero and are linked like any other; fewer words than a shingle
count as one shingle; repeated rows share a fingerprint;
in near_duplicates a component without any id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ledgerloom.llm.common import read, release, shared_if_small, small_batches, stored
from ledgerloom.llm.components import connected_components
from ledgerloom.session import cut

BLOCKS, RADIUS, TILE = 6, 4, 1 << 15
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PIECE = 1 << 15  # shingles whose bits are unpacked at once
_ALL = ~np.uint64(0)
_STEP = 16  # planes that the wide comparison adds at once
_AT_ONCE = 1 << 14  # pairs of a query and a block that one call compares


def fingerprint(text: str | None, words: int) -> int:
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split() cuts at \x20 and \x09-\x0D only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1]))
    k = min(words, len(parts))
    n = len(parts) - k + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[k - 1 :] - 1).tolist())), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, _PIECE):
        votes += np.unpackbits(hashes[i : i + _PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = 5, name: str = "fingerprint") -> DataFrame:
    """docs and a long column with the 64 bits (signed)."""

    small_batches(docs.sparkSession)

    @pandas_udf("long")
    def of(texts):
        return texts.map(lambda t: fingerprint(t, words)).astype("int64")

    return docs.withColumn(name, of(F.col(text)))


def _cuts() -> list[tuple[int, int]]:
    edges = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return list(zip(edges[:-1], edges[1:]))


def _bands() -> list[int]:
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in _cuts()]
    return [x - (1 << 64) if (x := sum(m)) >> 63 else x for m in combinations(masks, BLOCKS - RADIUS)]


def bit_planes(fps: np.ndarray, blocks: np.ndarray, lanes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """planes[bit, block]: one word with that bit of 64 fingerprints (rows of words); used[block]: which lanes hold one."""
    planes, used = np.zeros((64 * fps.shape[1], n_blocks), np.uint64), np.zeros(n_blocks, np.uint64)
    lane = np.uint64(1) << lanes.astype(np.uint64)
    np.bitwise_or.at(used, blocks, lane)
    for bit in range(len(planes)):
        on = (fps[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        np.bitwise_or.at(planes[bit], blocks[on], lane[on])
    return planes, used


def near_lanes(queries: np.ndarray, block: np.ndarray, planes: np.ndarray, used: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For query i against block[i]: (indices with a near lane, words of their near lanes).

    The counters hold one bit of each lane's distance so far, in carry-save form; a lane whose distance passes the
    radius leaves `alive`, and queries without a lane alive leave the work.
    """
    if radius >= _STEP:
        return _near_wide(queries, block, planes, used, radius)
    at = np.arange(len(queries))
    alive = used[block].copy()
    counters = [np.zeros(len(queries), np.uint64) for _ in range((radius + 1).bit_length())]
    for bit in range(len(planes)):
        want = np.where((queries[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1, _ALL, np.uint64(0))
        carry = planes[bit][block] ^ want
        for i, count in enumerate(counters):
            counters[i], carry = count ^ carry, count & carry
        if bit < radius:
            continue
        # the first distance above the radius has a pattern of its own, and a lane that shows it is dead from then on
        dead = _ALL
        for i, count in enumerate(counters):
            dead = dead & (count if (radius + 1) >> i & 1 else ~count)
        alive &= ~dead
        if bit % 4 == 3:
            stay = alive != 0
            if not stay.all():
                at, alive, queries, block = (x[stay] for x in (at, alive, queries, block))
                counters = [c[stay] for c in counters]
            if not len(at):
                break
    return at, alive


def _near_wide(queries: np.ndarray, block: np.ndarray, planes: np.ndarray, used: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """near_lanes for a large radius: a tree of carry-save adders takes _STEP planes at once, then distances are compared with the radius."""
    at = np.arange(len(queries))
    alive = used[block].copy()
    # bits of the distance from low to high; the first four belong to the tree
    count = [np.zeros(len(queries), np.uint64) for _ in range(len(planes).bit_length())]
    for bit in range(0, len(planes), _STEP):
        column = queries[:, bit // 64] >> np.uint64(bit % 64)
        words = [planes[bit + i][block] ^ np.negative((column >> np.uint64(i)) & np.uint64(1)) for i in range(_STEP)]
        for i in range(4):
            carries = []
            for a, b in zip(words[::2], words[1::2]):
                odd = a ^ b
                carries.append((a & b) | (odd & count[i]))
                count[i] = odd ^ count[i]
            words = carries
        carry = words[0]
        for i in range(4, len(count)):
            count[i], carry = count[i] ^ carry, count[i] & carry
        if bit + _STEP <= radius:
            continue
        over, same = np.zeros(len(at), np.uint64), np.full(len(at), _ALL)
        for i in reversed(range(len(count))):
            if radius >> i & 1:
                same &= count[i]
            else:
                over |= same & count[i]
                same &= ~count[i]
        alive &= ~over
        stay = alive != 0
        if not stay.all():
            at, alive, queries, block = (x[stay] for x in (at, alive, queries, block))
            count = [c[stay] for c in count]
        if not len(at):
            break
    return at, alive


def _lanes_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lane) of every set bit."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def _small_groups(fps: np.ndarray, group: np.ndarray, rank: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links within groups of at most 64 rows: one block each, every row a query."""
    planes, used = bit_planes(fps, group, rank, int(group.max()) + 1)
    first = np.zeros(int(group.max()) + 1, np.int64)
    first[group[::-1]] = np.arange(len(group))[::-1]
    for i in range(0, len(fps), 1 << 18):
        at, words = near_lanes(fps[i : i + (1 << 18)], group[i : i + (1 << 18)], planes, used, radius)
        row, lane = _lanes_of(words)
        a, b = at[row] + i, first[group[at[row] + i]] + lane
        yield a[a < b], b[a < b]


def _large_group(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join the same rows as all links of one group would: each row is a query once, against the rows not reached yet."""
    index = np.arange(len(fps))
    planes, used = bit_planes(fps, index // 64, index % 64, (len(fps) + 63) // 64)
    waiting: list[int] = []
    while True:
        open_ = np.flatnonzero(used)
        if not len(open_):
            return
        if not waiting:
            block = int(open_[0])
            lane = (int(used[block]) & -int(used[block])).bit_length() - 1
            used[block] &= ~(np.uint64(1) << np.uint64(lane))
            waiting = [block * 64 + lane]
            open_ = np.flatnonzero(used)
        q = waiting.pop()
        at, words = near_lanes(np.repeat(fps[q : q + 1], len(open_), axis=0), open_, planes, used, radius)
        if len(at):
            row, lane = _lanes_of(words)
            hit = open_[at[row]] * 64 + lane
            used[open_[at]] &= ~words
            waiting += hit.tolist()
            yield np.full(len(hit), q), hit


def _against(rows: np.ndarray, fps: np.ndarray, blocks: np.ndarray, planes: np.ndarray, used: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, hit): the rows as queries against the used lanes of the blocks."""
    queries, block = np.repeat(rows, len(blocks)), np.tile(blocks, len(rows))
    at, words = near_lanes(fps[queries], block, planes, used, radius)
    row, lane = _lanes_of(words)
    return queries[at[row]], block[at[row]] * 64 + lane


def _wide_group(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As _large_group, with many queries in a call, for fingerprints whose single query is many steps.

    Seeds are asked together, more of them as long as they find nothing. What they hit is then followed seed by seed, so rows
    closed in one turn are joined already; a row still open is compared when its turn comes. At most about two links a row leave.
    """
    index = np.arange(len(fps))
    planes, used = bit_planes(fps, index // 64, index % 64, (len(fps) + 63) // 64)
    is_open = np.ones(len(fps), bool)

    def close(rows):
        is_open[rows] = False
        np.bitwise_and.at(used, rows // 64, ~(np.uint64(1) << (rows % 64).astype(np.uint64)))

    first, together = 0, 1
    while True:
        left = np.flatnonzero(is_open[first:]) + first
        if not len(left):
            return
        first = int(left[0])
        blocks = np.flatnonzero(used)
        seeds = left[: max(1, min(together, _AT_ONCE // len(blocks)))]
        a, b = _against(seeds, fps, blocks, planes, used, radius)
        a, b = a[a != b], b[a != b]
        close(seeds)
        together = 1 if len(a) > len(fps) else min(64, 2 * together)
        if not len(a):
            continue
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        new = np.concatenate(([True], b[1:] != b[:-1]))
        owner = a[np.flatnonzero(new)][np.cumsum(new) - 1]
        once = np.unique(a * len(fps) + owner, return_index=True)[1]
        kept = np.union1d(np.flatnonzero(new), once)
        yield a[kept], b[kept]
        for seed in seeds:
            waiting = b[a == seed]
            waiting = waiting[is_open[waiting]]
            close(waiting)
            while len(waiting):
                blocks = np.flatnonzero(used)
                if not len(blocks):
                    break
                some = max(1, _AT_ONCE // len(blocks))
                u, v = _against(waiting[:some], fps, blocks, planes, used, radius)
                v, at = np.unique(v, return_index=True)
                close(v)
                waiting = np.concatenate((waiting[some:], v))
                if len(v):
                    yield u[at], v


def _links_of_partition(radius: int, full: int = 64):
    """Groups of at most `full` rows give all of their links, larger ones a spanning forest. Rows (band, key, pair, node, words) come sorted by band, key and tile pair. Whole groups are compared as soon as the next group begins."""

    def compare(g, nodes, fps):
        new = np.concatenate(([True], (g[1:] != g[:-1]).any(axis=1)))
        group = np.cumsum(new) - 1
        sizes, starts = np.bincount(group), np.flatnonzero(new)
        rank = np.arange(len(g)) - starts[group]
        part = np.flatnonzero((sizes[group] <= full) & (sizes[group] > 1))
        if len(part):
            dense = np.unique(group[part], return_inverse=True)[1]
            for a, b in _small_groups(fps[part], dense, rank[part], radius):
                yield nodes[part[a]], nodes[part[b]]
        for s, m in zip(starts[sizes > full].tolist(), sizes[sizes > full].tolist()):
            for a, b in (_large_group if radius < _STEP else _wide_group)(fps[s : s + m], radius):
                yield nodes[a + s], nodes[b + s]

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def out(pairs):
            for u, v in pairs:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        def joined():
            return (np.concatenate([h[i] for h in held]) for i in range(3))

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(4)
            width = len(words.flatten()) // batch.num_rows
            fps = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, width)
            held.append((np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1), batch.column(3).to_numpy(zero_copy_only=False), fps))
            rows += batch.num_rows
            if rows * width < 1 << 16:
                continue
            g, nodes, fps = joined()
            last = np.flatnonzero((g != g[-1]).any(axis=1))
            end = int(last[-1]) + 1 if len(last) else 0
            if end:
                yield from out(compare(g[:end], nodes[:end], fps[:end]))
            held, rows = [(g[end:], nodes[end:], fps[end:])], len(g) - end
        if rows:
            yield from out(compare(*joined()))
        held.clear()
        release()

    return links


def _compared(rows: DataFrame, radius: int, tile: int, full: int = 64) -> DataFrame:
    """(u, v): links among rows (band, key, node, words) that share a band's key, enough to join all that are within the radius there."""
    sizes = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _tiled(rows.join(sizes, ["band", "key"]), tile).mapInArrow(_links_of_partition(radius, full), "u long, v long")


def _tiled(rows: DataFrame, tile: int, *more: str) -> DataFrame:
    """Rows (band, key, n, node, words, more columns) dealt to pairs of tiles of their band's key, sorted; n is the weight of the group, tile that of a tile."""
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pair = F.least("own", "other") * F.lit(1 << 15) + F.greatest("own", "other")
    return (
        rows.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(F.col("band").cast("long"), "key", pair.cast("long").alias("pair"), "node", "words", *more)
        .repartition("band", "key", "pair").sortWithinPartitions("band", "key", "pair", "node")
    )


def links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """(u, v): links among distinct fingerprints (column fp) within RADIUS bits."""
    masks = F.array(*[F.lit(m) for m in _bands()])
    rows = fps.select("fp", F.posexplode(masks).alias("band", "mask"))
    return _compared(rows.select("band", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), F.col("fp").alias("node"), F.array("fp").alias("words")), RADIUS, tile)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id reachable over links."""
    rows = stored(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words, name="fp").select("doc_id", "fp"), "simhash")
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("lowest")))
    member = connected_components(links(nodes.select("fp")))
    named = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    low = named.groupBy("component").agg(F.min("lowest").alias("component_id"))
    by_fp = named.join(low, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: Wide fingerprints: words of 64 bits, bands of minimal hashes and hashes in a band.
WORDS, MINIMA, ROWS = 8, 14, 5
_SALTS = np.random.default_rng(64).integers(0, 1 << 63, WORDS + MINIMA * ROWS, dtype=np.uint64)[:, None] | np.uint64(1)


#: Band groups up to FULL rows give all their candidates; larger ones a spanning forest first. Rows and bytes of sets in a tile of the exact search.
FULL, EXACT_TILE, EXACT_BYTES = 8, 1 << 11, 16 << 20


def wide_radius(similarity: float) -> int:
    """Differing bits that pairs of this Jaccard similarity stay within but for about 1 in 30,000 (four deviations).

    Ties of the vote part small sets more: 5 against 4 shingles (0.8) differ in 3 of 16 bits, the most for any sizes at 0.8.
    """
    p = max(np.arccos(2 * similarity / (1 + similarity)) / np.pi, 3 / 16)
    n = 64 * WORDS
    return int(n * p + 4 * np.sqrt(n * p * (1 - p)))


def _same_share(both, one, other, similarity: float):
    return both >= similarity * (one + other - both) - 1e-9


def _exact_links(radius: int, similarity: float):
    """Rows (band, key, pair, node, words, component, set) come sorted by group: links of each group that join its components further, all verified."""

    def joined(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        label = np.unique([r[2] for r in rows], return_inverse=True)[1]
        left = int(label.max()) + 1 if len(rows) else 0
        if left < 2:
            return
        fps = np.stack([r[1] for r in rows]).view(np.uint64)
        index = np.arange(len(rows))
        planes, used = bit_planes(fps, index // 64, index % 64, (len(rows) + 63) // 64)
        sizes = np.array([len(r[3]) for r in rows])
        ends = np.cumsum(sizes)
        # postings: for each shingle the rows that hold it, so one count gives a row's share with all others
        shingle = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)[1]
        holders = np.repeat(index, sizes)[np.argsort(shingle, kind="stable")]
        held_by = np.bincount(shingle)
        begin = np.cumsum(held_by) - held_by
        blocks = np.arange(len(used))
        some = max(1, _AT_ONCE // len(blocks))
        for q0 in range(0, len(rows), some):
            asked, hits = _against(index[q0 : q0 + some], fps, blocks, planes, used, radius)
            asked, hits = (x[(hits > asked) & (label[asked] != label[hits])] for x in (asked, hits))
            for q in np.unique(asked).tolist():
                near = hits[asked == q]
                near = near[label[near] != label[q]]
                if not len(near):
                    continue
                mine = shingle[ends[q] - sizes[q] : ends[q]]
                n = held_by[mine]
                both = np.bincount(holders[np.repeat(begin[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(rows))[near]
                near = near[_same_share(both, sizes[q], sizes[near], similarity)]
                while len(near):
                    h = int(near[0])
                    yield rows[q][0], rows[h][0]
                    label[label == label[h]] = label[q]
                    left -= 1
                    near = near[label[near] != label[q]]
            if left == 1:
                return

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def out(rows):
            found = list(joined(rows))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            nodes, components = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            for i, key in enumerate(keys):
                if key != group:
                    yield from out(held)
                    held, group = [], key
                fp, members = (np.array(batch.column(c)[i].values.to_numpy()) for c in (4, 6))
                held.append((nodes[i], fp, components[i], members))
        yield from out(held)
        held = []
        release()

    return links


def _verified(banded: DataFrame, sets_of, similarity: float, tile: int) -> DataFrame:
    """(u, v): pairs that share a band's key with an exact Jaccard similarity of at least `similarity`, enough to join all such pairs.

    sets_of(nodes) gives (node, set) of a table of nodes. The bit-sliced comparison only proposes. A large group first
    proposes a spanning forest; where its verified links leave several components, these are searched again with
    the sets at hand, and a pair is skipped only if its texts are joined already.
    """
    radius = wide_radius(similarity)
    pairs = _compared(banded, radius, tile, FULL).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = cut(pairs)
    sets = sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    one, other = (sets.select(F.col("node").alias(n), F.col("set").alias(f"{n}_set")) for n in ("u", "v"))
    both = F.size(F.array_intersect("u_set", "v_set"))
    links = cut(pairs.join(one, "u").join(other, "v").filter(_same_share(both, F.size("u_set"), F.size("v_set"), similarity)).select("u", "v"))
    sizes = cut(banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > FULL))
    if sizes.isEmpty():
        return links
    member = connected_components(links)
    rows = banded.join(sizes, ["band", "key"]).join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = cut(rows)
    open_ = rows.groupBy("band", "key").agg((F.min("component") < F.max("component")).alias("open")).filter("open").select("band", "key")
    rows = cut(rows.join(open_, ["band", "key"]))
    if rows.isEmpty():
        return links
    sets = sets_of(rows.select("node").distinct())
    # tiles by rows and by bytes, so that a task holds two tiles of bounded size whatever the length of the texts
    weight = F.greatest(F.lit(EXACT_BYTES // EXACT_TILE), 8 * F.size("set"))
    held = sets.select("node", weight.cast("long").alias("weight"))
    groups = rows.select("band", "key", "node").join(held, "node").groupBy("band", "key").agg(F.sum("weight").alias("n"))
    dealt = rows.drop("n").join(cut(groups), ["band", "key"]).join(sets, "node")
    more = _tiled(dealt, EXACT_BYTES, "component", "set").mapInArrow(_exact_links(radius, similarity), "u long, v long")
    return links.union(more)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles. Blank texts have one shingle of their own."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(parts[i : i + k]), 42) for i in range(len(parts) - k + 1)] if parts else [0], np.uint64))


def signature(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(fingerprint of WORDS words, keys of the MINIMA bands, digest of the shingle set). Each distinct shingle votes once."""
    hashes = shingles(text, words)
    votes, low = np.zeros(64 * WORDS, np.int64), np.full(MINIMA * ROWS, _ALL)
    for i in range(0, len(hashes), 2048):
        mixed = (hashes[i : i + 2048] ^ _SALTS) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        bits = np.unpackbits(np.ascontiguousarray(mixed[:WORDS].T).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
        low = np.minimum(low, mixed[WORDS:].min(axis=1))
    bands = low.reshape(MINIMA, ROWS)
    keys = bands[:, 0].copy()
    for r in range(1, ROWS):
        keys = (keys * np.uint64(0x100000001B3)) ^ bands[:, r]
    return np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8"), keys.view(np.int64), xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def similar_groups(rows: DataFrame, place: str, text: str, words: int = 5, similarity: float = 0.8, tile: int = TILE) -> DataFrame:
    """(place, first): groups of texts linked by a Jaccard similarity of their word shingles of at least `similarity`; first is the smallest place of the group.

    Four bits of 64 only hold pairs of about 0.95. Here the fingerprint has 512 bits. Candidates share one of 14 bands of
    five minimal shingle hashes (0.996 of pairs at 0.8) and are compared bit-sliced, as above, within wide_radius();
    the shingle sets decide. Only texts with the same set of shingles fold before.
    """

    small_batches(rows.sparkSession)

    @pandas_udf("struct<words:array<long>,keys:array<long>,same:binary>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([{"words": w, "keys": k, "same": d} for w, k, d in (signature(t, words) for t in texts)], columns=["words", "keys", "same"])
        release()

    marked = rows.select(F.col(place).alias("place"), of(F.col(text)).alias("s")).select("place", "s.*")
    marked = stored(marked, "wide-simhash")
    # equal digests have equal words and keys
    nodes = cut(marked.groupBy("same").agg(F.min("place").alias("lowest"), F.first("words").alias("words"), F.first("keys").alias("keys"), F.min("place.row").alias("node")))
    banded = nodes.select("node", "words", F.posexplode("keys").alias("band", "key"))

    @pandas_udf("array<long>")
    def set_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: shingles(t, words).view(np.int64))
        release()

    def sets_of(wanted):
        held = rows.select(F.col(f"{place}.row").alias("node"), F.col(text).alias("text")).join(wanted, "node", "left_semi")
        return stored(held.select("node", set_of("text").alias("set")), "shingle-sets")

    member = connected_components(_verified(banded.select("band", "key", "node", "words"), sets_of, similarity, tile))
    named = nodes.select("same", "lowest", "node").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("lowest").alias("first"))
    return marked.select("place", "same").join(named.join(low, "component").select("same", "first"), "same").select("place", "first")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar texts, columns unchanged: the one with the smallest id; a null id is the largest, and rows with one id are ordered as stored."""
    order = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"))
    rows = stored(docs.select(order.alias("place"), F.struct("*").alias("doc")), "simhash-rows")
    gone = cut(similar_groups(rows, "place", f"doc.`{text}`", words, similarity).filter("place != first").select(F.col("place.row").alias("row")))
    gone = shared_if_small(gone, gone.count(), 16)
    return rows.join(gone, rows["place.row"] == gone["row"], "left_anti").select("doc.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
