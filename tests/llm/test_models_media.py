"""Sentencepiece with dropout, language identification, media features."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import audio, language, pieces, queries, tokens
from tests.llm.test_tokens import ODD_DOCS, table

FILE = tokens.path("piece_bpe_32k.model")


def texts_of(spark, sf_dir, n=80):
    return [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(n).collect()] + [t or "" for _, t in ODD_DOCS]


ODD_WORDS = ["▁ literal ▁▁ bar", " ", "\n \n", "a\x00b", "\U0010ffff", "      deep", "x    \n   y  ", "張三李四" * 30, "=" * 150, "a" * 64, "b" * 63, "c" * 65, "\u0301" * 5, "thanedble " * 40]


def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=FILE)


def test_without_dropout_equals_the_library(spark, sf_dir):
    texts = texts_of(spark, sf_dir) + [t for t in ODD_WORDS if "▁" not in t]
    assert [x.tolist() for x in pieces.Encoder(FILE, dropout=0).ids(texts)] == library().encode(texts, num_threads=1)


def naive(text, dropout, seed):
    """Merge-dropout word by word, looking at all pairs again after every step."""
    sp = library()
    score = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    salt, out = pieces._mixed(zlib.crc32((" " + text).encode()) + (seed << 32)), []
    for k, word in enumerate(re.findall(" *[^ \n]+| +|\n", " " + text)):
        key, skipped = pieces._mixed(salt + k), set()
        parts = [("\ue000" if c == "▁" else c.replace(" ", "▁"), i) for i, c in enumerate(word)]
        while True:
            found = [(-score[a + b][0], i, n) for n, ((a, i), (b, _)) in enumerate(zip(parts, parts[1:])) if a + b in score and (a, i, b) not in skipped]
            if not found:
                break
            _, i, n = min(found)
            (a, _), (b, _) = parts[n : n + 2]
            if pieces._mixed(key + pieces._mixed((score[a + b][1] << 32) + (len(a) << 24) + i + 1)) / 2.0**64 < dropout:
                skipped.add((a, i, b))
            else:
                parts[n : n + 2] = [(a + b, i)]
        for p, _ in parts:
            out += [score[p][1]] if p in score else [sp.piece_to_id(f"<0x{x:02X}>") for x in p.replace("\ue000", "▁").encode()]
    return out


@pytest.mark.parametrize("dropout,seed", [(0.1, pieces.SEED), (0.5, 3)])
def test_dropout_equals_a_naive_agenda(spark, sf_dir, dropout, seed):
    texts = [*ODD_WORDS, *(t[:1500] for t in texts_of(spark, sf_dir, 12))]
    for t, ids in zip(texts, pieces.Encoder(FILE, dropout, seed).ids(texts), strict=True):
        assert ids.tolist() == (naive(t, dropout, seed) if t else [])


def test_dropout_varies_and_is_lossless(spark, sf_dir):
    texts = [*texts_of(spark, sf_dir), *ODD_WORDS]
    encoder, decoder = pieces.Encoder(FILE), pieces.Decoder(FILE)
    ids = encoder.ids(texts)
    assert [decoder.text(x) for x in ids] == texts
    assert all((a == encoder.ids([t])[0]).all() for a, t in zip(ids, texts, strict=True))
    assert sum(map(len, ids)) > sum(map(len, pieces.Encoder(FILE, dropout=0).ids(texts)))
    # one word of a text is segmented in many ways, more of them the more often it comes
    spelt = "".join(encoder.model.spelt[i].decode() + "|" for i in encoder.ids(["thanedble " * 2000])[0]).split("| ")
    assert len(set(spelt[:200])) < len(set(spelt)) and len(set(spelt)) > 30
    assert len(pieces.Encoder(FILE, dropout=1.0).ids(["thanedble"])[0]) == len(" thanedble")


def test_sentencepiece_query(spark, sf_dir):
    rows = queries.op3_sentencepiece(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.lossless and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in rows)
    d = pieces.decode(pieces.encode(table(spark, ODD_DOCS), FILE), FILE).collect()
    assert sorted(r.decoded for r in d) == sorted(t or "" for _, t in ODD_DOCS)
    assert pieces.decode(pieces.encode(table(spark, []), FILE), FILE).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"])
    b = rng.integers(0, 257, (5, 2 * language.CONTEXT + 40))
    n, label, weight = np.array([40, 7, 1, 20, 40]), np.array([0, 1, 2, 1, 0]), np.ones(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, grad = net.gradients(b, n, label, weight)
    for k, v in net.p.items():
        for at in (np.unravel_index(np.argmax(np.abs(grad[k])), v.shape), tuple(rng.integers(0, v.shape))):
            was, eps = v[at], 1e-4
            v[at] = was + eps
            up = net.gradients(b, n, label, weight)[0]
            v[at] = was - eps
            down = net.gradients(b, n, label, weight)[0]
            v[at] = was
            assert abs((up - down) / (2 * eps) - grad[k][at]) < 1e-4 * abs(grad[k][at]) + 1e-7, k


def test_windows_label_every_byte_once():
    raw = np.arange(1, 701, dtype=np.int64).astype(np.uint8)
    at = np.array([0, 0, 1, 258, 700])
    b, n, of = language.windows(raw, at)
    assert of.tolist() == [1, 2, 2, 3, 3] and n.tolist() == [1, 256, 1, 256, 186]
    c, w = language.CONTEXT, language.WIDTH
    assert (b[0][:c] == language.OUTSIDE).all() and b[0][c] == 1 and (b[0][c + 1 :] == language.OUTSIDE).all()
    assert b[2][: c + 1].tolist() == raw[257 - c : 258].tolist() and b[3][c:].tolist() == raw[258 : 258 + w + c].tolist()


def step_by_step(net, raw):
    """Mean probabilities of one text's bytes, one byte after the other."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, c, w = language.HIDDEN, language.CONTEXT, language.WIDTH
    total = np.zeros(len(net.languages))
    at = lambda i: raw[i] if 0 <= i < len(raw) else language.OUTSIDE
    for first in range(0, len(raw), w):
        score = {}
        for d, places in (("f", range(first - c, first + w)), ("b", range(first + w + c - 1, first - 1, -1))):
            state = np.zeros(h)
            for i in places:
                x, g = net.p[f"in_{d}"][:, at(i)].astype(float), net.p[f"re_{d}"].astype(float) @ state
                z, r = sigmoid(x[:h] + g[:h]), sigmoid(x[h : 2 * h] + g[h : 2 * h])
                state = (1 - z) * np.tanh(x[2 * h :] + r * g[2 * h :]) + z * state
                score[i] = score.get(i, net.p["bias"][:, 0]) + net.p[f"out_{d}"] @ state
        for i in range(first, min(first + w, len(raw))):
            e = np.exp(score[i] - score[i].max())
            total += e / e.sum()
    return total / len(raw)


def test_documents_equal_a_walk_byte_by_byte(spark, sf_dir):
    net = language.Network(["a", "b", "c", "d"])
    texts = [b"x", "Ünïcödé".encode() * 60, *(t.encode()[:700] for t in texts_of(spark, sf_dir, 4) if t)]
    p = net.documents(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for t, x in zip(texts, p, strict=True):
        assert np.allclose(step_by_step(net, t), x, atol=1e-4)


def test_sample_is_stratified_and_bounded(spark):
    rows = [(i, f"text {i}", "xx" if i < 20 else "yy", 1) for i in range(3000)] + [(9000 + i, "copy", "zz", 1) for i in range(2000)] + [(1, None, "xx", 1), (2, "", "xx", 1), (None, "t", "xx", 1), (3, "t", None, 1)]
    got = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string, hash int"), 100).collect()
    n = {lang: sum(r.lang == lang for r in got) for lang in ("xx", "yy", "zz")}
    assert n["xx"] == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(20)) and 60 < n["yy"] < 140 and n["zz"] <= 1


def test_language_accuracy_and_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op4_language(spark, sf_dir).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_of_odd_documents(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "en"), (4, "word " * 400, None), (None, "text", "en"), (6, "the cat", "en"), (7, "der Hund", "de")] + [(i, "the and of" if i % 2 else "der die und", "en" if i % 2 else "de") for i in range(10, 60)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, lang_pred string")
    net = language.fit(docs, iterations=30)
    got = {r.doc_id: r for r in language.predict(docs, net).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3))
    assert got[4].lang_pred in ("en", "de") and got[None].lang_pred in ("en", "de")
    assert language.fit(docs.limit(0)) is None and language.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_media_contract(spark, sf_dir):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_media(queries.op5_audio(spark, sf_dir).collect(), texts)
    odd = [*ODD_DOCS, (20, "x" * 576), (21, "word " * 5000)]
    check_media(audio.media_digests(table(spark, odd)).collect(), odd)
    assert audio.media_digests(table(spark, [])).count() == 0


def check_media(rows, texts):
    expected = []
    for d, t in texts:
        p = audio.payload((t or "").encode())
        assert len(p) % 576 == 0 and len(p) > 0
        w = audio.wav(p)
        assert audio.samples_of(w).tobytes() == p
        expected.append((d, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(w), hashlib.sha256(w).hexdigest()))
    key = lambda x: (str(x[0]), x[1:])
    assert sorted((tuple(r)[:7] for r in rows), key=key) == sorted(expected, key=key)
    by_media = {}
    for r in rows:
        assert by_media.setdefault(r.media_sha256, r.feature) == r.feature


def test_resampling_keeps_a_tone_and_segments_find_a_burst():
    t = np.arange(24_000) / 24_000
    y = audio.resampled(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert len(y) == 16_000
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000))[50:-50].max() < 0.02
    mels, energy = audio.log_mel(y)
    assert mels.shape == (99, 40) and len(audio.segments(np.zeros(7))) == 1
    burst = np.concatenate([np.zeros(50), np.ones(20), np.zeros(50)]) * 30
    assert audio.segments(burst) == [(50, 70)]
    assert audio.pooled(mels, [(0, 99), (3, 4)]).shape == (2, *audio.TENSOR)


def test_features_equal_a_direct_computation():
    """Resampling by the definition (zeros between samples, a windowed sinc, every third), frames by a plain Fourier sum."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal(1_501).astype(np.float32)
    y = audio.resampled(x)
    for k in [0, 1, 2, 7, 500, 501, 999]:
        centre = k * 1.5
        taps = np.arange(int(np.floor(centre)) - 5, int(np.floor(centre)) + 7)
        t = taps - centre
        h = np.sinc(t * 2 / 3) * (0.5 + 0.5 * np.cos(np.pi * t / 6))
        assert abs(sum(w / h.sum() * x[i] for w, i in zip(h, taps) if 0 <= i < len(x)) - y[k]) < 1e-4
    mels, energy = audio.log_mel(y)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = np.linspace(mel(20), mel(8000), 42)
    for frame in (0, 2, len(mels) - 1):
        part = np.zeros(400)
        piece = y[frame * 160 : frame * 160 + 400]
        part[: len(piece)] = piece
        part *= np.hanning(400)
        assert abs(10 * np.log10((part**2).mean() + 1e-9) - energy[frame]) < 1e-3
        f = np.arange(257) * 16_000 / 512
        power = np.abs(np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(400)) / 512) @ part) ** 2
        hertz = 700 * (10 ** (edges / 2595) - 1)
        for band in (0, 13, 39):
            low, mid, high = hertz[band : band + 3]
            w = np.clip(np.minimum((f - low) / (mid - low), (high - f) / (high - mid)), 0, None)
            assert abs(np.log10(power @ w + 1e-6) - mels[frame, band]) < 1e-3


def test_spans_are_stored_as_arrow_tensors(spark):
    t = np.arange(24_000) / 24_000
    sound = np.where((t > 0.3) & (t < 0.5), np.sin(2 * np.pi * 800 * t), 0.003 * np.sin(2 * np.pi * 50 * t))
    file = audio.wav((128 + np.round(sound * 100)).astype(np.uint8).tobytes())
    stored = audio.features(spark.createDataFrame([(7, 24_000, bytearray(file)), (8, 0, None), (8, 0, None)], "doc_id long, n_bytes long, media binary"))
    spans = stored and sorted(map(tuple, audio.spans(stored).collect()))
    assert [s[0] for s in spans] == [7, 8, 8] and abs(spans[0][1] - 0.29) < 0.03 and abs(spans[0][2] - 0.51) < 0.03 and len(spans[0][3]) == 320
    for r in stored.collect():
        with pa.ipc.open_file(r.path.removeprefix("file:")) as f:
            column = f.get_batch(r.batch).column("tensor")
            assert isinstance(column, pa.FixedShapeTensorArray) and column.type.shape == list(audio.TENSOR)
    mels, _ = audio.log_mel(audio.resampled((audio.samples_of(file).astype(np.float32) - 128) / 128))
    frames = [(round(spans[0][1] * 100), round((spans[0][2] - 0.025) * 100) + 1)]
    assert np.allclose(np.array(spans[0][3]).reshape(audio.TENSOR), audio.pooled(mels, frames)[0], atol=5e-3)


@pytest.mark.parametrize("seed", range(3))
def test_segments_equal_a_walk_frame_by_frame(seed):
    rng = random.Random(seed)
    e = np.array([rng.gauss(0, 5) for _ in range(300)])
    floor, on, expected = sorted(e)[30], False, []
    for i, x in enumerate(e):
        if not on and x - floor >= audio.BEGIN_DB:
            on, first = True, i
        elif on and x - floor < audio.END_DB:
            on = False
            expected.append((first, i))
    assert audio.segments(e) == expected + [(first, 300)] * on
