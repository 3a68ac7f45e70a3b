"""Fingerprints: the contract by brute force, and the estimate against the generalised Jaccard similarity."""

import hashlib
import math
import random
from collections import Counter

import pytest

from tessera.llm import queries, sampling


def expected(rows):
    """doc_id, n_chars and digest of the edited text, for rows of distinct ids."""
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    out = {}
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(t) // 3
        out[d] = (len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest())
    return out


def similarity(x, y):
    a, b = ({w: 1 + math.log(n) for w, n in Counter(t.lower().split()).items()} for t in (x, y))
    both = a.keys() | b.keys()
    top = sum(max(a.get(w, 0), b.get(w, 0)) for w in both)
    return sum(min(a.get(w, 0), b.get(w, 0)) for w in both) / top if top else 1.0


def make(spark, rows):
    return spark.createDataFrame([(d, t, 7, 1.0) for d, t in rows], "doc_id long, text string, bucket int, at double")


@pytest.mark.parametrize("ids", [range(40), range(0, 40_000, 997), [5], [3, -900, 2**40, -(2**50), 255, 256, 257], range(0, 2_000_000, 100_003)])
def test_edited_texts_and_estimates(spark, ids):
    rng = random.Random(len(ids))
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(d, " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(300)], k=rng.choice([0, 1, 2, 3, 30, 400])))) for d in ids]
    got = {r.doc_id: r for r in sampling.fingerprints(make(spark, rows)).collect()}
    want = expected(rows)
    assert {d: (r.n_chars, r.edited_sha256) for d, r in got.items()} == want
    order = sorted(rows, key=lambda r: -r[0])
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        assert abs(got[d].near_next - similarity(t, following)) < 0.3
        assert 0 <= got[d].near_edited <= 1 and len(got[d].fingerprint) <= 8 * sampling.SLOTS


def test_estimate_is_unbiased(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(500)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(500)], k=300)) for _ in range(200)]
    got = {r.doc_id: r.near_next for r in sampling.fingerprints(make(spark, list(enumerate(texts)))).collect()}
    errors = [got[i] - similarity(texts[i], texts[i - 1]) for i in range(200)]
    assert abs(sum(errors) / 200) < 0.02


@pytest.mark.parametrize("words,often", [(10, (3, 2)), (40, (3, 2)), (10, (8, 7)), (2, (5, 1))])
def test_estimate_is_unbiased_for_short_repetitive_texts(spark, words, often):
    """Pairs of the same words, each coming often[0] times in the one text and often[1] times in the other."""
    rows = [(2 * i + k, " ".join(f"p{i}w{j}" for j in range(words) for _ in range(often[1 - k]))) for i in range(150) for k in (0, 1)]
    got = {r.doc_id: r.near_next for r in sampling.fingerprints(make(spark, rows)).collect()}
    errors = [got[2 * i + 1] - similarity(rows[2 * i + 1][1], rows[2 * i][1]) for i in range(150)]
    assert abs(sum(errors) / 150) < 0.02


def test_odd_rows(spark):
    rows = [(4, None), (3, ""), (3, "same id"), (2, " \n"), (1, "a b c"), (0, "a b c"), (None, "no id"), (9, "word " * 30_000), (8, "张三 ÉÉ é" * 10)]
    got = sampling.fingerprints(make(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[1, 5].fingerprint == by[0, 5].fingerprint != "" and by[1, 5].near_next == 1.0
    assert by[4, 0].fingerprint == by[3, 0].fingerprint == by[2, 2].fingerprint == ""
    assert by[8, 70].edited_sha256 == hashlib.sha256((("张三 ÉÉ é" * 10)[:47]).encode()).hexdigest()
    assert sampling.fingerprints(make(spark, [])).count() == 0
    again = sampling.fingerprints(make(spark, [(7, "x y"), (7, "x y"), (6, "q r s")])).collect()
    assert len(again) == 3 and len({r.fingerprint for r in again}) == 2


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = queries.op2_fingerprints(spark, sf_dir)
    rows = df.collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == expected(docs)
    text = dict(docs)
    seen = {}
    assert all(seen.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint for r in rows)
    assert sum(r.near_edited for r in rows) / len(rows) > sum(r.near_next for r in rows) / len(rows) + 0.2
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
