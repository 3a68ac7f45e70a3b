"""Removal of repeated passages: every word covered by a window of `size` words that starts earlier as well.

1. A window's key is the least hash of the runs of ANCHOR words inside it, so equal windows have equal keys.
   Keys go to reducers in packed form; those that come once in the corpus are done with (most are).
2. Windows with other keys are cut out of their documents as short segments and dealt to shards by key: all
   occurrences of a window meet in one shard. A task sends equal segments once, the first; the others are
   known to be repeated. Keys of very many documents are dealt out window by window instead.
3. Each shard builds an FM-index of its segments and streams them through it: matching statistics by backward
   search give the first occurrence of each window, and those that start later are reported.
4. A document's reported windows are merged, and the words that they cover are left out.

Documents with the same words as an earlier one need no search: all their windows start earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, words
from tessera.llm.common import mixed
from tessera.llm.fm_index import FMIndex

ANCHOR = 8
#: Keys that a task gathers before it sends them off; words of a shard's index, and of segments before they are sent.
ENTRIES, SHARD_WORDS = 500_000, 400_000
#: Documents with a key beyond which its windows are dealt out one by one.
HOT = 2_000
#: A null doc_id counts as this one, after all others.
LAST = (1 << 63) - 1
NOTHING = hashlib.sha256(b"").hexdigest()


def _least(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every `width` neighbours: the least value and the leftmost place of it."""
    value, place, have = x, np.arange(len(x)), 1
    while have < width:
        by = min(have, width - have)
        later = value[by:] < value[:-by]
        value, place = np.where(later, value[by:], value[:-by]), np.where(later, place[by:], place[:-by])
        have += by
    return value, place


def windows(hashes: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of texts end to end: first word, key, place of the key, text."""
    if len(hashes) < size:
        return (*(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64)), np.zeros(0, np.int64))
    g = np.zeros(len(hashes) - ANCHOR + 1, np.uint64)
    for k in range(ANCHOR):
        g += hashes[k : len(g) + k] * np.uint64(words._RANDOM[k] | 1)
    key, place = _least(mixed(g), size - ANCHOR + 1)
    of = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(of[: len(key)] == of[size - 1 :])
    return inside, key[inside], place[inside], of[inside]


def digests(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of the word sequence of every text."""
    ends = np.cumsum(n)
    place = common.spread(np.zeros(len(n), np.int64), n).astype(np.uint64)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(hashes + (place + np.uint64(1)) * np.uint64(salt)))))
        out.append(mixed(total[ends] - total[ends - n] + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _several(key: np.ndarray, of: np.ndarray, repeated: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by key and document, each once; whether a key has several. repeated: one entry twice counts as several."""
    order = np.lexsort((of, key))
    key, of = key[order], of[order]
    same_key = np.concatenate(([False], key[1:] == key[:-1]))
    same = same_key & np.concatenate(([False], of[1:] == of[:-1]))
    tells = same_key if repeated else same_key & ~same
    group = np.cumsum(~same_key) - 1
    several = (np.bincount(group, weights=tells, minlength=1) > 0)[group] if len(key) else np.zeros(0, bool)
    return key[~same], of[~same], several[~same]


def anchored(docs: DataFrame, size: int) -> DataFrame:
    """Stored rows of two kinds: for every document (key null) doc_id, one, two, n_words, the digest of its words and
    xxhash64 of its text (mark); for every key that comes several times, key and one of a document that has it."""
    parts = common.partitions(common.bounded(docs))
    buckets = min(60_000, 2 * parts)
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("mark", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        bucket, kind, a, b = zip(*rows, strict=True)
        none = [pa.nulls(n, t) for t in schema.types[2:8]]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), *none, pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=schema)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            key, of, several = _several(np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held]), True)
            rows = [(int(key[0] % np.uint64(buckets)), 1, key[several].tobytes(), of[several].tobytes())] if several.any() else []
            lead = np.concatenate(([True], key[1:] != key[:-1]))
            key, of = key[lead], of[lead]
            bucket = (key % np.uint64(buckets)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            key, of = key[order], of[order]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            return packed(rows + [(k, 2, key[a:b].tobytes(), of[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a])

        for batch in batches:
            for run in common.slices(batch, chars=common.SMALL_CHARS):
                raw, at = common.utf8(run.column(1))
                hashes, _, _, n = words.words(raw, at)
                one, two = digests(hashes, n)
                body = raw.tobytes()
                sha = [hashlib.sha256(b" ".join(body[a:b].split())).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                m = run.num_rows
                # documents only pass through: those with the same words are dealt out as well
                dealt = (mixed(one.view(np.uint64) + np.arange(m, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(dealt), pa.array(np.zeros(m, np.int32)), run.column(0), pa.array(one), pa.array(two), pa.array(n.astype(np.int64)), pa.array(sha), run.column(2), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], schema=schema)
                _, key, place, of = windows(hashes, n, size)
                first = np.zeros(m, bool)
                first[np.unique(one, return_index=True)[1]] = True  # equal texts of a run send their keys once
                new = np.concatenate(([True], place[1:] != place[:-1])) & first[of] if len(of) else np.zeros(0, bool)
                held.append((key[new], one[of[new]]))
                total += int(new.sum())
                if total >= ENTRIES:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "one", "two", "n_words", "sha", "mark"]

        def members(key: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
            none = [pa.nulls(len(key), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(key), none[0], pa.array(of), *none[1:]], names=names)

        entries = []
        for batch in batches:
            kind = np.asarray(batch.column(1))
            docs_ = batch.filter(pa.array(kind == 0))
            if docs_.num_rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(docs_.num_rows, pa.int64()), *(docs_.column(i) for i in range(2, 8))], names=names)
            for i in np.flatnonzero(kind > 0).tolist():
                key, of = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (8, 9))
                if kind[i] == 1:
                    yield members(key, of)
                else:
                    entries.append((key, of))
        if entries:
            key, of, several = _several(np.concatenate([k for k, _ in entries]), np.concatenate([d for _, d in entries]), False)
            yield members(key[several], of[several])

    ddl = "bucket int, kind int, doc_id long, one long, two long, n_words long, sha string, mark long, a binary, b binary"
    out = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark")).mapInArrow(sent, ddl).repartition(parts, "bucket")
    return common.stored(out.mapInArrow(met, "key long, doc_id long, one long, two long, n_words long, sha string, mark long"), "anchors")


def repeated_windows(texts: DataFrame, size: int) -> DataFrame:
    """texts(at, one, text, keys, hot), documents with the keys that come several times, to at, one, starts: first words
    (32-bit integers) of windows that start earlier as well. A document can have several such rows."""
    parts = common.partitions(texts.sparkSession)
    buckets = min(60_000, 2 * parts)
    schema = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("key", "at", "one", "start", "length", "words"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            key, at, one, start, length = (np.concatenate([h[i] for h in held]) for i in range(5))
            body = np.concatenate([h[5] for h in held])
            first_word = np.cumsum(length) - length
            place = common.spread(np.zeros(len(length), np.int64), length).astype(np.uint64)
            sums = np.add.reduceat(mixed(body + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), first_word)
            order = np.lexsort((one, start, at, length, sums, key))
            same = np.zeros(len(order), bool)
            same[1:] = (key[order][1:] == key[order][:-1]) & (sums[order][1:] == sums[order][:-1]) & (length[order][1:] == length[order][:-1])
            group = np.cumsum(~same) - 1
            lead = order[~same][group]  # the first of the equal segments
            later = same & ((at[order] != at[lead]) | (start[order] != start[lead]))
            known = order[later]
            if len(known):
                told = (at[known], one[known], start[known], length[known] - size + 1)
                yield pa.RecordBatch.from_arrays([pa.array([int(key[known[0]] % np.uint64(buckets))], pa.int32()), pa.nulls(1, pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in told), pa.nulls(1, pa.binary())], schema=schema)
            send = np.sort(np.concatenate([order[~same], order[same & ~later]]))
            bucket = (key[send] % np.uint64(buckets)).astype(np.uint16)
            send = send[np.argsort(bucket, kind="stable")]
            cuts = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
            rows = []
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    s = send[a:b]
                    rows.append((k, *(x[s].tobytes() for x in (key, at, one, start, length)), body[common.spread(first_word[s], length[s])].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for run in common.slices(batch, chars=common.SMALL_CHARS):
                at_, one_ = (np.asarray(run.column(i)).astype(np.int64) for i in (0, 1))
                hashes, _, _, n = words.words(*common.utf8(run.column(2)))
                mine, _ = digests(hashes, n)
                first, key, place, of = windows(hashes, n, size)
                wanted, hot = np.zeros(len(of), bool), np.zeros(len(of), bool)
                cuts = np.searchsorted(of, np.arange(run.num_rows + 1))
                for i in range(run.num_rows):
                    if mine[i] == one_[i]:  # else another text of that doc_id
                        a, b = cuts[i], cuts[i + 1]
                        for mask, c in ((wanted, 3), (hot, 4)):
                            mask[a:b] = np.isin(key[a:b], np.asarray(run.column(c)[i].values, dtype=np.int64).view(np.uint64))
                doc_first = (np.cumsum(n) - n)[of]
                single = np.flatnonzero(wanted & hot)
                plain = np.flatnonzero(wanted & ~hot)
                new = np.concatenate(([True], (place[plain][1:] != place[plain][:-1]) | (first[plain][1:] != first[plain][:-1] + 1))) if len(plain) else np.zeros(0, bool)
                lead = plain[new]
                count = np.diff(np.append(np.flatnonzero(new), len(plain)))
                lead, count = np.concatenate([lead, single]), np.concatenate([count, np.ones(len(single), np.int64)])
                if not len(lead):
                    continue
                length = count + size - 1
                body = hashes[common.spread(first[lead], length)]
                shard = key[lead].copy()
                if len(single):
                    w = np.zeros(len(single), np.uint64)
                    for k in range(size):
                        w += hashes[first[single] + k] * np.uint64(words._RANDOM[k] | 1)
                    shard[len(shard) - len(single) :] = mixed(w)
                held.append((shard, at_[of[lead]], one_[of[lead]], first[lead] - doc_first[lead], length, body))
                total += len(body)
                if total >= SHARD_WORDS:
                    yield from flush()
                    held, total = [], 0
        if total:
            yield from flush()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_: list[list[np.ndarray]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i] for c in range(1, 7)]
                if not row[0].is_valid:
                    at, one, start, count = (np.frombuffer(x.as_buffer(), np.int64) for x in row[1:5])
                    yield reported(at, one, start, count)
                else:
                    parts_.append([np.frombuffer(x.as_buffer(), np.uint64 if c in (0, 5) else np.int64) for c, x in enumerate(row)])
        if not parts_:
            return
        key, at, one, start, length = (np.concatenate([p[c] for p in parts_]) for c in range(5))
        body = np.concatenate([p[5] for p in parts_])
        parts_.clear()
        first_word = np.cumsum(length) - length
        order = np.lexsort((one, start, at, key))
        total = np.cumsum(length[order] + 1)
        new_key = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        shard = (total[new_key] // SHARD_WORDS)[np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1]))) - 1]
        for a, b in zip(*(np.flatnonzero(np.concatenate(x)) for x in (([True], shard[1:] != shard[:-1]), (shard[1:] != shard[:-1], [True]))), strict=True):
            yield from indexed(order[a : b + 1], at, one, start, length, first_word, body)

    def indexed(segments, at, one, start, length, first_word, body) -> Iterator[pa.RecordBatch]:
        """Repeated windows of one shard, whose segments stand in order of key, document and place."""
        sizes = length[segments]
        begin = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int((sizes + 1).sum()), np.uint64)  # a 0 ends every segment
        text[common.spread(begin, sizes)] = body[common.spread(first_word[segments], sizes)]
        index = FMIndex(text, size)
        where, origin = index.repeats(text, begin, sizes)
        of, first = (np.searchsorted(begin, x, side="right") - 1 for x in (where, origin))
        a, b = segments[of], segments[first]
        s, t = start[a] + where - begin[of], start[b] + origin - begin[first]
        later = (at[b] < at[a]) | ((at[b] == at[a]) & (t < s))
        if later.any():
            yield reported(at[a][later], one[a][later], s[later], np.ones(int(later.sum()), np.int64))

    def reported(at: np.ndarray, one: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((start, one, at))
        at, one, start, count = at[order], one[order], start[order], count[order]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (one[1:] != one[:-1]))))
        ends = np.append(new[1:], len(at))
        starts = [common.spread(start[a:b], count[a:b]).astype(np.int32).tobytes() for a, b in zip(new.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(at[new]), pa.array(one[new]), pa.array(starts, pa.binary())], names=["at", "one", "starts"])

    cut_rows = texts.select("at", "one", "text", "keys", "hot").mapInArrow(cut, "bucket int, key binary, at binary, one binary, start binary, length binary, words binary")
    return cut_rows.repartition(parts, "bucket").mapInArrow(search, "at long, one long, starts binary")


def covered(texts: DataFrame, found: DataFrame, size: int) -> DataFrame:
    """texts(at, one, text) with their rows of found(at, one, starts) to at, one, n_removed, kept_sha256, kept.

    A document's reported windows are gathered in one row: at most one number for each of its own words."""
    whole = found.groupBy("at", "one").agg(F.collect_list("starts").alias("starts"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in common.slices(batch, chars=common.SMALL_CHARS):
                at, one, n_removed, sha, left = [], [], [], [], []
                hashes, _, _, n = words.words(*common.utf8(run.column(2)))
                mine, _ = digests(hashes, n)
                for i, text in enumerate(run.column(2).to_pylist()):
                    if mine[i] != run.column(1)[i].as_py():
                        continue
                    w = (text or "").encode().split()
                    change = np.zeros(len(w) + 1, np.int64)
                    for x in run.column(3)[i].values:
                        starts = np.frombuffer(x.as_buffer(), np.int32)
                        np.add.at(change, starts, 1)
                        np.add.at(change, starts + size, -1)
                    out = np.cumsum(change)[:-1] > 0
                    body = b" ".join(w[k] for k in np.flatnonzero(~out).tolist())
                    for column, value in zip((at, one, n_removed, sha, left), (run.column(0)[i].as_py(), run.column(1)[i].as_py(), int(out.sum()), hashlib.sha256(body).hexdigest(), body.decode()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(one, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())], names=["at", "one", "n_removed", "kept_sha256", "kept"])

    return texts.select("at", "one", "text").join(whole, ["at", "one"]).mapInArrow(kept, "at long, one long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) to two tables: rows and kept.

    rows: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), state ("whole", "cut"
    or "gone": all words removed), mark (xxhash64 of the text), at and one (which name a text in kept). A row for every
    row of docs.
    kept: at, one, kept: the kept words of the documents in state "cut".
    Null texts have no words. Rows of one doc_id are one document: equal places in them aren't earlier. A null
    doc_id comes after all others. Long texts are taken whole; an empty table gives no rows; other columns aren't read.
    """
    found = anchored(docs, size)
    rows = found.where("key is null").drop("key").withColumn("at", F.coalesce("doc_id", F.lit(LAST)))
    classes = common.stored(rows.groupBy("one", "two").agg(F.min("at").alias("first"), F.max("n_words").alias("n")), "classes")
    members = found.where("key is not null").select("key", "one").distinct()
    members = common.stored(members, "members")
    hot = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.lit(True).alias("is_hot"))
    hot = common.stored(hot, "hot")
    asked = members.join(common.small(hot), "key", "left").groupBy("one").agg(F.collect_list("key").alias("keys"), F.collect_list(F.when(F.col("is_hot"), F.col("key"))).alias("hot"))
    asked = common.stored(asked.join(classes.select("one", F.col("first").alias("at")).distinct(), "one"), "asked")
    ids = common.stored(asked.select("at").distinct(), "asked")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"), "text").join(common.small(ids), "at").join(asked, "at").select("at", "one", "text", "keys", "hot")
    texts = common.stored(texts, "texts")
    kept = common.stored(covered(texts, repeated_windows(texts, size), size).dropDuplicates(["at", "one"]), "kept")
    for table in (members, hot, asked, ids, texts):
        common.dropped(table)
    states = classes.join(kept.select("one", F.col("at").alias("first"), "n_removed", "kept_sha256"), ["one", "first"], "left").select("one", "two", "first", "n_removed", "kept_sha256")
    out = rows.join(states, ["one", "two"])
    gone = (F.col("at") > F.col("first")) & (F.col("n_words") >= size)
    state = F.when(gone, "gone").when((F.col("at") == F.col("first")) & F.col("n_removed").isNotNull(), "cut").otherwise("whole")
    return (
        out.select(
            "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(gone, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), state.alias("state"), "mark", "at", "one",
        ),
        kept.select("at", "one", "kept"),
    )
