"""Packing and token files: held against the tokenizers library, and round trips."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tessera.llm import packing, queries, token_files, tokens

ODD_DOCS = [(5, ""), (3, None), (9, "a\x1cb  c \n\n d" * 40), (1, "word " * 5000), (None, "no id"), (3, "again"), (7, "Ünïcödé 張三 🎉\t\r\n x")]


def table(spark, rows):
    return spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, start int, sequence_id string")


@lru_cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.path(name))


def reference_ids(name, text):
    return [*library(name).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("name,drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_the_library(spark, sf_dir, name, drops):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()] + [t for _, t in ODD_DOCS] + ["<|endoftext|> it's we'll  ", " ", "\n", "é ΑΣ İ"]
    e = tokens.Encoder(tokens.path(name), drops, kept=50)
    for part in (texts[:30], texts[30:], texts):
        ids, n = e.ids(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [reference_ids(name, t)[:-1] for t in part]


FUZZ = ["İ", "I", "\u0307", "\u0301", "e", "É", "ß", "ﬁ", "Σ", "ΑΣ", "K", "Å", "ö", "o\u0308", "한", "ᄒ", "ᅡ", "あ\u3099", "ा", "क", "張", "🎉", "👩\u200d", "7", "٣", "½", "²", "'s", "'LL", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "<", "\u0338", ",", ".", "!", "?", ";", ":", "…", "\u037e", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "\u200b", "\u3000", "a", "word", "The", "_", "-"]


@pytest.mark.parametrize("name,drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_equals_the_library_on_random_strings(name, drops):
    rng, e = random.Random(name), tokens.Encoder(tokens.path(name), drops, kept=3000)
    texts = ["".join(rng.choices(FUZZ, k=rng.randint(1, 12))) for _ in range(30_000)]
    texts += ["".join(chr(rng.choice((rng.randrange(0x20, 0xD800), rng.randrange(0x20, 0x600)))) for _ in range(rng.randint(1, 5))) + rng.choice(",.!?;: ") for _ in range(30_000)]
    expected = [x.ids for x in library(name).encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 2_000):
        ids, n = e.ids(texts[k : k + 2_000])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == expected[k : k + 2_000]


@pytest.mark.parametrize("name,drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_every_letter_with_a_mark_behind_it(name, drops):
    texts = [f"{chr(c)}," for c in range(0x30, 0x30000) if chr(c).isalpha()]
    ids, n = tokens.Encoder(tokens.path(name), drops).ids(texts)
    expected = [x.ids for x in library(name).encode_batch(texts, add_special_tokens=False)]
    wrong = [t for t, x, y in zip(texts, np.split(ids, np.cumsum(n)[:-1]), expected, strict=True) if x.tolist() != y]
    assert not wrong


def test_packed_uses_each_token_once():
    rng = random.Random(5)
    for case in ([], [1], [2048], [2049], [300, 300, 300], [rng.randint(1, 5000) for _ in range(400)], [7] * 1000):
        sequences = packing.packed(case)
        seen = {}
        for s in sequences:
            size = sum(n for _, _, n in s)
            assert size <= 2048 and size & (size - 1) == 0
            for doc, start, n in s:
                seen.setdefault(doc, []).append((start, n))
        for doc, n in enumerate(case):
            end = 0
            for start, length in sorted(seen[doc]):
                assert start == end
                end += length
            assert end == n


def check_packing(rows, texts):
    ids = {d: [reference_ids("byte_bpe_50k.json", t) for e, t in texts if e == d] for d, _ in texts}
    sequences, per_doc = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        per_doc.setdefault(r.doc_id, 0)
        per_doc[r.doc_id] += r.length
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    assert per_doc == {d: sum(map(len, x)) for d, x in ids.items()}
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_packing_of_odd_and_real_documents(spark, sf_dir):
    check_packing(packing.pack(table(spark, ODD_DOCS), tokens.path("byte_bpe_50k.json")).collect(), ODD_DOCS)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_packing(queries.op9_packing(spark, sf_dir).collect(), docs)
    assert packing.pack(table(spark, []), tokens.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (50_000, 1), (40_000, 30_000), (16_384, 7)])
def test_rans_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % kinds).astype(np.uint32) if n else np.zeros(0, np.uint32)
    file = token_files.encode([4, None], np.array([n // 3, n - n // 3]), ids)
    back = token_files.opened(file)
    assert back.doc_ids.to_pylist() == [4, None] and back.lengths.tolist() == [n // 3, n - n // 3] and (back.ids() == ids).all()
    if n > token_files.BLOCK:
        assert (back.ids(range(1, 2)) == ids[token_files.BLOCK : 2 * token_files.BLOCK]).all()
    for at in (-1, 20) if n else (20,):
        damaged = bytearray(file)
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            token_files.opened(bytes(damaged)).ids()


def test_documents_of_a_file_are_read_from_its_checkpoints():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 9_000, 60)
    lengths[7] = 70_000
    ids = (rng.zipf(1.5, lengths.sum()) % 500).astype(np.uint32)
    file, at = token_files.opened(token_files.encode(list(range(60)), lengths, ids)), 0
    for first in range(0, len(ids), 50_000):
        which, found, starts = file.documents(first, first + 50_000)
        assert which.start == at and (starts == (np.cumsum(lengths) - lengths)[which]).all()
        if which.stop > at:
            assert (found == ids[starts[0] : starts[-1] + lengths[which.stop - 1]]).all()
        at = which.stop
    assert at == 60


def expected_files(texts):
    out, at = [], 0
    for d, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = reference_ids("word_bpe_49k.json", t)
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op10_token_files(spark, sf_dir).collect())) == expected_files(docs)
    got = sorted(map(tuple, token_files.token_files(table(spark, ODD_DOCS), tokens.path("word_bpe_49k.json")).collect()), key=lambda r: r[1])
    assert got in [expected_files(x) for x in (ODD_DOCS, ODD_DOCS[::-1])]  # two documents have one doc_id
    files = token_files.write(table(spark, [*ODD_DOCS, (50, "many words " * 400_000)]), tokens.path("word_bpe_49k.json"))
    for f in files.collect():  # files that anything can open
        file = token_files.opened(open(f.path.removeprefix("file:"), "rb").read())
        assert len(file.ids()) == f.tokens == file.lengths.sum()
    back = {r.doc_id: r for r in token_files.read(files).collect()}
    assert back[50].n_tokens == 800_001 and len(back) == len({d for d, _ in ODD_DOCS}) + 1
    repeated = token_files.token_files(table(spark, [(2, "x y"), (2, "x y"), (1, "z")]), tokens.path("word_bpe_49k.json"))
    assert sorted(r.start for r in repeated.collect()) == [0, 2, 5]
    assert token_files.token_files(table(spark, []), tokens.path("word_bpe_49k.json")).count() == 0
