"""The FM-index and the removal of repeated passages against brute force and SQL."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import queries, substrings
from tessera.llm.fm_index import Bits, FMIndex

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size=20):
    docs = [((d if d is not None else substrings.LAST), WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - size + 1):
            x = tuple(w[i : i + size])
            first[x] = min(first.get(x, (d, i)), (d, i))
    out = []
    for (d, w), (doc_id, _) in zip(docs, rows, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (d, i):
                gone.update(range(i, i + size))
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    draw = lambda n: rng.choices(vocabulary, k=n)
    passages = [draw(n) for n in (19, 20, 21, 60, 200)]
    rows = [(900, None), (901, ""), (902, " \x0b "), (903, "ab " * 200), (904, "a b c " * 40), (None, " ".join(passages[3])), (905, " ".join(passages[2])), (905, " ".join(passages[2])), (906, "é ü " * 50 + "x" * 5000)]
    for i in range(120):
        w = draw(rng.choice([0, 5, 19, 25, 80, 300]))
        for _ in range(rng.choice([0, 1, 2])):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        for _ in range(rng.choice([1, 1, 1, 3])):
            w = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.005]) else x for x in w]
            rows.append((len(rows) * 37 % 1009 + 2000, " ".join(w)))
    rng.shuffle(rows)
    return rows


def run(spark, rows, n=6):
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, one int, sha string").repartition(n)
    out, kept = substrings.remove_repeats(docs)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()), key=str)
    return got, kept


@pytest.mark.parametrize("seed,hot", [(0, 2000), (1, 3)])
def test_removal_equals_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "ENTRIES", 300)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 700)
    rows = corpus(seed)
    got, kept = run(spark, rows)
    assert got == brute(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() for r in kept.collect())


def test_odd_tables(spark):
    assert run(spark, [])[0] == []
    for rows in ([(1, None)], [(2, "a " * 19), (1, "a " * 19)], [(2, "a " * 20), (1, "a " * 20)], [(1, "a " * 21)], [(None, "a b " * 30), (None, "a b " * 30)], [(5, "x y z " * 20), (5, "q x y z " * 20)]):
        assert run(spark, rows, 2)[0] == brute(rows)


@pytest.mark.parametrize("k", [2, 3, 5, 20])
def test_fm_index(k):
    rng = np.random.default_rng(k)
    for n, sigma in ((k, 3), (200, 2), (1000, 30), (64 * 5, 7)):
        parts = [rng.integers(1, sigma + 1, rng.integers(k, k + 40)) for _ in range(max(1, n // (k + 20)))]
        parts += parts[:2]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.uint64)
        length = np.array([len(p) for p in parts])
        begin = np.cumsum(length + 1) - length - 1
        index = FMIndex(text, k)
        at, first = index.repeats(text, begin, length)
        seen, times = {}, {}
        for b, m in zip(begin, length, strict=True):
            for i in range(b, b + m - k + 1):
                seen.setdefault(text[i : i + k].tobytes(), i)
                times[text[i : i + k].tobytes()] = times.get(text[i : i + k].tobytes(), 0) + 1
        assert sorted(at.tolist()) == [i for b, m in zip(begin, length, strict=True) for i in range(b, b + m - k + 1) if times[text[i : i + k].tobytes()] > 1]
        assert all(seen[text[a : a + k].tobytes()] == f for a, f in zip(at.tolist(), first.tolist(), strict=True))


@pytest.mark.parametrize("share", [0.0, 0.001, 0.5, 0.999, 1.0])
def test_bits(share):
    rng = np.random.default_rng(7)
    for n in (1, 63, 64, 65, 5000):
        x = rng.random(n) < share
        bits, at = Bits(x), np.arange(n + 1)
        ones = np.concatenate(([0], np.cumsum(x)))
        assert (bits.rank(at) == ones).all() and (bits.get(at[:-1]) == x).all()
        assert (bits.select(np.arange(ones[-1])) == np.flatnonzero(x)).all() and (bits.select(ones[-1:]) >= n).all()


@pytest.mark.parametrize("passages,share", [(300, 0.6), (10, 0.2)])
def test_the_index_is_smaller_than_its_text(passages, share):
    rng = np.random.default_rng(2)
    words_ = rng.integers(1, 1 << 60, 20_000).astype(np.uint64)
    of = [rng.choice(words_, 200) for _ in range(passages)]
    text = np.concatenate([np.append(of[i], np.uint64(0)) for i in rng.integers(0, passages, 3000)])
    assert FMIndex(text, 20).nbytes() < share * text.nbytes


def test_query_against_sql(spark, sf_dir):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(tuple(r) for r in queries.op7_substrings(spark, sf_dir).collect()) == sorted(db.execute(queries.oracle_sql()["op7_substrings"]).fetchall())
