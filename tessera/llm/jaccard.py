"""N-gram Jaccard join by parity sketches.

The XOR of hashes of a set's shingles is a fingerprint of a bit sketch: each shingle flips one bit, so two
sketches differ in at most as many bits as the symmetric difference has elements. Two sets of sizes a and b
reach a Jaccard similarity of t only if that difference is at most d = (1 - t)(a + b)/(1 + t). Sketches are
cut into K blocks by hash (K > d for all pairs of a size band, in which sizes differ by the factor WIDTH at
most); by the pigeonhole principle a pair that links has equal blocks, so it meets in a join on (band,
block, XOR). Blocks of at most one shingle say little and empty ones nothing: all documents of a band that have
the same empty block would meet there, and their pairs grow with the square of the table. So K has blocks to
spare, and a document leaves such blocks out if it has no more of them than can be spared: those of at most one
shingle in bands that can spare as many, else the empty ones. Very small sets have too few blocks for that: they
send the XOR of every subset that may be all they share with a set they link with. So no pair that links is lost.

Pairs that meet are verified exactly on their whole sets. A key with many documents is never expanded to
its pairs: every document is first held against one pivot, and only keys whose documents are still in
several components are looked at again, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, takewhile
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, words
from tessera.llm.common import mixed
from tessera.llm.components import components

WIDTH = 1.38
#: Blocks of fewer shingles count as saying little; the second where a band can't spare the blocks for the first.
TELLING = (2, 1)
#: Sets of which more subsets would be sent are cut into blocks.
SUBSETS = 32
#: Entries that a task gathers before it sends them off, and documents of a tile.
ENTRIES, TILE = 500_000, 400
#: Pairs for each document of a tile up to which all are verified at once.
PAIRS = 4


@dataclass(frozen=True)
class Measure:
    """Links are pairs with den * |intersection| >= num * |union| over shingles of `size` words."""

    size: int = 5
    num: int = 80
    den: int = 100

    def most(self, a, b):
        """The largest symmetric difference of a pair that links."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def missing(self, n):
        """How many of its n shingles a set may not share with one that it links with."""
        return n * (self.den - self.num) // self.den


@cache
def bands(measure: Measure, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First sizes of the bands up to size top, and each band's number of blocks, of blocks to spare, and of shingles
    that make a block telling. Sets of the first band send subsets, not blocks."""
    first = [1]
    while first[-1] <= top:
        first.append(max(int(first[-1] * WIDTH), first[-1] * measure.den // measure.num + 1))
    first.append(max(int(first[-1] * WIDTH), first[-1] * measure.den // measure.num + 1))
    few = [*takewhile(lambda lo: sum(comb(lo - 1, i) for i in range(measure.missing(lo - 1) + 1)) <= SUBSETS, first[:-1])]
    first[: len(few)] = [1, few[-1]]
    blocks, spare, least = [1], [0], [1]
    for lo, end in zip(first[1:], first[2:], strict=False):
        base, low = measure.most(end - 1, end - 1) + 1, -(-lo * measure.num // measure.den)
        for telling in TELLING:
            extra = 0
            for _ in range(30):
                rate = low / (base + extra)
                share = np.exp(-rate) * (1 + rate * (telling > 1))  # of blocks that are not telling
                emitted = measure.most(low, low * measure.den // measure.num) + 1 + extra
                extra = max(1, int(emitted * share + (telling + 1) * np.sqrt(emitted * share) + (telling > 1)))
            if extra <= base // 3:
                break
        extra = min(extra, base)
        blocks.append(base + extra)
        spare.append(extra)
        least.append(telling)
    return np.array(first[:-1]), np.array(blocks), np.array(spare), np.array(least)


def keys(h: np.ndarray, n: np.ndarray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """The keys of sets (ascending hashes end to end, n of each) and the set of each key."""
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, *cut = bands(measure, 1 << int(n.max()).bit_length())
    own = np.searchsorted(first, n, side="right") - 1
    largest = n * measure.den // measure.num
    end = first[np.minimum(own + 1, len(first) - 1)]
    found = [_subsets(h, n, measure, int(first[1])), _emit(h, n, measure, np.flatnonzero(n >= first[1]), own, np.minimum(largest, end - 1), *cut)]
    above = np.flatnonzero((n > 0) & (largest >= end))
    found.append(_emit(h, n, measure, above, own + 1, largest, *cut))
    return np.concatenate([k for k, _ in found]), np.concatenate([s for _, s in found])


def _subsets(h, n, measure, end) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets smaller than end: the XOR of every subset that lacks no more shingles than a link allows."""
    start, key, of = np.cumsum(n) - n, [], []
    for size in range(1, end):
        sets = np.flatnonzero(n == size)
        if not len(sets):
            continue
        x = mixed(h[start[sets][:, None] + np.arange(size)] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        whole = np.bitwise_xor.reduce(x, axis=1)
        for left_out in range(measure.missing(size) + 1):
            for some in combinations(range(size), left_out):
                key.append(mixed((whole ^ np.bitwise_xor.reduce(x[:, list(some)], axis=1)) + mixed(np.uint64([size - left_out]))))
                of.append(sets)
    return (np.concatenate(key), np.concatenate(of)) if key else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _emit(h, n, measure, sets, band, partner, blocks, spare, least) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the given sets in the given band, in which no partner is larger than `partner`."""
    if not len(sets):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size, band = n[sets], band[sets].astype(np.uint64)
    k, a, telling_from = (x[band.astype(np.int64)] for x in (blocks, spare, least))
    sent = np.minimum(k, measure.most(size, partner[sets]) + 1 + a)
    start = (np.cumsum(n) - n)[sets]
    of = np.repeat(np.arange(len(sets)), size)
    x = h[common.spread(start, size)]
    block = ((x >> np.uint64(32)) * k[of].astype(np.uint64)) >> np.uint64(32)  # ascending in a set, as x is
    edge = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (of[1:] != of[:-1]))))
    xor, count = np.bitwise_xor.reduceat(mixed(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)), edge), np.diff(np.append(edge, len(x)))
    of, block = of[edge], block[edge].astype(np.int64)
    inside = block < sent[of]
    telling = inside & (count >= telling_from[of])
    weak = sent - np.bincount(of[telling], minlength=len(sets)) > a
    keep = np.where(weak[of], inside, telling)
    which, block, xor = of[keep], block[keep], xor[keep]
    # a set that can spare no block sends its empty ones too
    w = np.flatnonzero(weak)
    full = np.zeros(int(sent[w].sum()), bool)
    base = np.zeros(len(sets), np.int64)
    base[w] = np.cumsum(sent[w]) - sent[w]
    full[base[which[weak[which]]] + block[weak[which]]] = True
    empty = np.flatnonzero(~full)
    of_empty = np.repeat(w, sent[w])[empty]
    which, block, xor = np.concatenate([which, of_empty]), np.concatenate([block, empty - base[of_empty]]), np.concatenate([xor, np.zeros(len(empty), np.uint64)])
    return mixed(xor + mixed(band[which] * np.uint64(1 << 32) + block.astype(np.uint64))), sets[which]


def _multiple(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of key and document without repetitions, and whether an entry's key has several documents."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    same = key[1:] == key[:-1]
    several = np.zeros(len(key), bool)
    several[1:] |= same
    several[:-1] |= same
    return key, doc, several


def sketched(docs: DataFrame, measure: Measure) -> DataFrame:
    """Stored rows of two kinds: every document with n_shingles and a 128-bit digest of its set (key is null),
    and (key, doc_id) for every key that several documents have.

    A task sends a key's first document only, so that a reducer sees a key once for each run of documents.
    """
    parts = common.partitions(common.bounded(docs))
    buckets = min(60_000, 2 * parts)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, several = _multiple(np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held]))
            rows = []
            if several.any():
                rows.append((int(key[0] % np.uint64(buckets)), 1, key[several].tobytes(), doc[several].tobytes(), b"", b""))
            lead = np.ones(len(key), bool)
            lead[1:] = key[1:] != key[:-1]
            key, doc = key[lead], doc[lead]
            bucket = (key % np.uint64(buckets)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            key, doc = key[order], doc[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows += [(k, 2, key[a:b].tobytes(), doc[a:b].tobytes(), b"", b"") for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for run in common.slices(batch, chars=common.SMALL_CHARS):
                h, n = words.shingle_sets(*common.utf8(run.column(1)), measure.size)
                of = np.repeat(np.arange(len(n)), n)
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(h):
                    total = np.concatenate((np.zeros((2, 1), np.uint64), np.cumsum([mixed(h ^ np.uint64(0x1234567)), mixed(h + np.uint64(0x89ABCDEF))], axis=1)), axis=1)
                    ends = np.cumsum(n)
                    one, two = total[0][ends] - total[0][ends - n], total[1][ends] - total[1][ends - n]
                doc = np.asarray(pc.fill_null(run.column(0), 0), dtype=np.int64)
                null = ~np.asarray(run.column(0).is_valid())
                raw = [np.concatenate([doc, null.astype(np.int64)]).tobytes(), n.astype(np.int64).tobytes(), one.tobytes(), two.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([int(doc[0]) % buckets if len(doc) else 0, 0, *raw], schema.types, strict=True)], schema=schema)
                # repeated sets of a run send their keys once, by a row that has an id: the digest joins them
                lead = np.zeros(len(n), bool)
                known = np.flatnonzero(~null)
                lead[known[np.unique((one ^ mixed(two))[known], return_index=True)[1]]] = True
                key, of = keys(h[lead[of]], np.where(lead, n, 0), measure)
                if len(key):
                    held.append((key, doc[of]))
                    size += len(key)
                if size >= ENTRIES:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = []
        for batch in batches:
            for kind, a, b, c, d in zip(*(batch.column(i) for i in range(1, 6)), strict=True):
                ints = [np.frombuffer(x.as_buffer(), np.int64) for x in (a, b, c, d)]
                if kind.as_py() == 0:
                    n = len(ints[1])
                    doc = pa.array(ints[0][:n], mask=ints[0][n:].astype(bool))
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), doc, *(pa.array(x) for x in ints[1:])], names=["key", "doc_id", "n_shingles", "one", "two"])
                elif kind.as_py() == 1:
                    yield members(ints[0], ints[1])
                else:
                    entries.append((ints[0].view(np.uint64), ints[1]))
        if entries:
            key, doc, several = _multiple(np.concatenate([k for k, _ in entries]), np.concatenate([d for _, d in entries]))
            yield members(key[several].view(np.int64), doc[several])

    def members(key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        empty = pa.nulls(len(key), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), empty, empty, empty], names=["key", "doc_id", "n_shingles", "one", "two"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sent, "bucket int, kind int, a binary, b binary, c binary, d binary").repartition(parts, "bucket").drop("bucket")
    out = out.select(F.lit(0).alias("bucket"), "*").mapInArrow(met, "key long, doc_id long, n_shingles long, one long, two long")
    return common.stored(out, "sketches")


def sketch(h: np.ndarray) -> np.ndarray:
    """The parity sketch of a set, as 64-bit words: a power of two of bits, at least the set's size.

    XOR of its halves is the sketch of half the width."""
    width = max(64, 1 << int(len(h) - 1).bit_length()) if len(h) else 64
    bits = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def against_pivots(docs: DataFrame, assigned: DataFrame, measure: Measure) -> DataFrame:
    """Stored rows a, b: links among assigned(doc_id, pivot), each document's set held against its pivot's; and
    rows a, n, sketch for every document of assigned and every pivot (b is null). A document that is its own pivot is
    only sketched.

    A pivot with many documents is repeated for every few hundred of them, so no task gets them all.
    """
    parts = common.partitions(docs.sparkSession)
    counts = assigned.groupBy("pivot").agg(F.count("*").alias("n"))
    frequent, shares = common.small(common.shares_of(counts, "pivot", TILE)), F.coalesce("shares", F.lit(1).cast("long"))
    salted = assigned.where("doc_id <> pivot").join(frequent, "pivot", "left").select("doc_id", "pivot", F.pmod(F.xxhash64("doc_id"), shares).alias("share"), F.lit(1).alias("turn"))
    heads = counts.join(frequent, "pivot", "left").select(F.col("pivot").alias("doc_id"), "pivot", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), F.lit(0).alias("turn"))
    wanted = common.stored(salted.unionByName(heads), "pivots")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(common.small(wanted), "doc_id")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            for run in common.slices(batch, chars=common.SMALL_CHARS):
                h, n = words.shingle_sets(*common.utf8(run.column(4)), measure.size)
                ends, links, drawn = np.cumsum(n), [], []
                for i, (pivot, share, turn, doc) in enumerate(zip(*(run.column(k).to_pylist() for k in range(4)), strict=True)):
                    mine = h[ends[i] - n[i] : ends[i]]
                    if turn == 0:
                        at, own = (pivot, share), mine.copy()
                    elif at == (pivot, share) and doc != pivot and similar(own, mine, measure):
                        links.append((doc, pivot))
                    if turn or not share:
                        drawn.append((doc, len(mine), sketch(mine).tobytes()))
                a, b = zip(*links, strict=True) if links else ((), ())
                d, k, x = zip(*drawn, strict=True) if drawn else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a + d, pa.int64()), pa.array(b + (None,) * len(d), pa.int64()), pa.array((None,) * len(a) + k, pa.int64()), pa.array((None,) * len(a) + x, pa.binary())], names=["a", "b", "n", "sketch"]
                )

    rows = rows.select("pivot", "share", "turn", "doc_id", "text").repartition(parts, "pivot", "share").sortWithinPartitions("pivot", "share", "turn")
    told = common.stored(rows.mapInArrow(held, "a long, b long, n long, sketch binary"), "pivots")
    common.dropped(wanted)
    return told


def similar(x: np.ndarray, y: np.ndarray, measure: Measure) -> bool:
    a, b = len(x), len(y)
    if not a or not b or measure.den * min(a, b) < measure.num * max(a, b):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common_ones = int((both[1:] == both[:-1]).sum())
    return measure.den * common_ones >= measure.num * (a + b - common_ones)


def within_keys(groups: DataFrame, sketches: DataFrame, measure: Measure, forest: bool) -> DataFrame:
    """Pairs (a, b) of different components among groups(key, doc_id, component) whose sketches allow a link, tile by tile.

    sketches has doc_id, n and sketch. No pair of a key that links is left out, but with forest, if a tile has more
    than PAIRS pairs for each of its documents: then it gives those that would join all components at once, the
    likeliest first, and a row key (a and b are null), as its other pairs are still to be looked at.
    """
    count = groups.groupBy("key").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    t, u = F.col("tile"), F.col("other")
    tiled = groups.join(count, "key").withColumn("tile", F.pmod(F.xxhash64("doc_id"), "tiles")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    rows = tiled.select("key", F.least(t, u).alias("x"), F.greatest(t, u).alias("y"), "doc_id", "component").join(sketches, "doc_id")

    def allowed(table: pa.Table) -> pa.Table:
        doc, comp, n = (np.asarray(table[k].combine_chunks()) for k in ("doc_id", "component", "n"))
        drawn = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["sketch"].combine_chunks()]
        width = min(map(len, drawn))
        rows = np.zeros((len(drawn), width), np.uint64)
        for i, x in enumerate(drawn):
            rows[i] = np.bitwise_xor.reduce(x.reshape(-1, width), axis=0)
        a, b, score = [], [], []
        for i in range(len(n) - 1):
            far = np.bitwise_count(rows[i + 1 :] ^ rows[i]).sum(axis=1)
            small, large = np.minimum(n[i], n[i + 1 :]), np.maximum(n[i], n[i + 1 :])
            most = measure.most(n[i], n[i + 1 :])
            j = np.flatnonzero((far <= most) & (comp[i + 1 :] != comp[i]) & (measure.den * small >= measure.num * large))
            a.append(np.full(len(j), i))
            b.append(j + i + 1)
            score.append(far[j] / most[j])
        a, b, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, score))
        whole = pa.array([], pa.int64())
        if forest and len(a) > PAIRS * len(n):
            whole = pa.array([table["key"][0].as_py()], pa.int64())
            root = {c: c for c in comp.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            keep = []
            for k in np.argsort(score, kind="stable").tolist():
                x, y = find(int(comp[a[k]])), find(int(comp[b[k]]))
                if x != y:
                    root[y] = x
                    keep.append(k)
            a, b = a[keep].astype(np.int64), b[keep].astype(np.int64)
        a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
        return pa.table({
            "key": pa.concat_arrays([whole, pa.nulls(len(a), pa.int64())]),
            "a": pa.concat_arrays([pa.nulls(len(whole), pa.int64()), pa.array(np.maximum(doc[a], doc[b]), pa.int64())]),
            "b": pa.concat_arrays([pa.nulls(len(whole), pa.int64()), pa.array(np.minimum(doc[a], doc[b]), pa.int64())]),
        })

    return rows.groupBy("key", "x", "y").applyInArrow(allowed, "key long, a long, b long").distinct()


def join(docs: DataFrame, measure: Measure) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id.

    A row for every row of docs. Documents without words (null, empty) link with nothing. Rows of one doc_id are one node.
    A null doc_id is no node: its component_id is null. Long texts are taken whole; an empty table gives no rows; other
    columns aren't read.
    """
    found = sketched(docs, measure)
    rows = found.where("key is null").drop("key")
    # Classes of equal sets: the smallest doc_id stands for all.
    digest = ["one", "two", "n_shingles"]
    stands = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = common.stored(
        rows.where("doc_id is not null").join(stands, digest, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
        .unionByName(rows.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("rep"))),
        "classes",
    )
    other = classes.where("doc_id <> rep").select("doc_id", "rep").distinct()
    members = found.where("key is not null").select("key", "doc_id").join(other, "doc_id", "left").select("key", F.coalesce("rep", "doc_id").alias("doc_id")).distinct()
    members = common.stored(members, "members")
    common.dropped(found)
    # Of keys with the same documents one is enough.
    h = F.xxhash64("doc_id").cast("decimal(20,0)")
    sums = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(h).alias("s"), F.min("doc_id").alias("pivot"))
    chosen = common.stored(sums.where("n > 1").groupBy("n", "s", "pivot").agg(F.min("key").alias("key")), "chosen")
    groups = common.stored(members.join(chosen.select("key", "pivot"), "key"), "groups")
    common.dropped(members)
    # Each document against one pivot: that of its key with the smallest one, itself if it is the pivot of all its keys.
    assigned = groups.groupBy("doc_id").agg(F.min("pivot").alias("pivot"))
    told = against_pivots(docs, assigned, measure)
    links, sketches = told.where("b is not null").select("a", "b"), told.where("b is null").select(F.col("a").alias("doc_id"), "n", "sketch").dropDuplicates(["doc_id"])
    same = common.stored(components(links), "components")
    # Keys whose documents are still in several components: all pairs that may link, or of tiles with very many
    # first those that may join the components, and then all that are left.
    left = None
    for forest in (True, False):
        now = groups.select("key", "doc_id").join(common.small(same.withColumnRenamed("node", "doc_id")), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        open_keys = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        if left is not None:
            open_keys = open_keys.join(left, "key", "left_semi")
        found = common.stored(within_keys(now.join(open_keys, "key"), sketches, measure, forest), "pairs")
        pairs, left = found.where("key is null").select("a", "b"), found.where("key is not null").select("key").distinct()
        if pairs.isEmpty():
            break
        links = links.unionByName(against_pivots(docs, pairs.toDF("doc_id", "pivot"), measure).where("b is not null").select("a", "b"))
        same = common.stored(components(links), "components")
        if left.isEmpty():
            break
    for table in (chosen, groups, told):
        common.dropped(table)
    return classes.join(common.small(same.withColumnRenamed("node", "rep")), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
