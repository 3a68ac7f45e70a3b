"""Language identification by a bidirectional gated recurrent network over bytes.

A forward and a backward state read a text byte by byte; every byte (position) gets a distribution over the
languages from both, and a document's probabilities are the means over all its positions. So that many states can
be computed at once, texts are read in windows: each state begins CONTEXT bytes before the window that it labels.
The network is trained in numpy by backpropagation through time, on the driver, on a bounded sample of labelled
rows; prediction reads only the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Bytes that a window labels, and bytes that its states read before.
WIDTH, CONTEXT = 256, 32
#: What a state reads beyond the ends of a text.
OUTSIDE = 256
HIDDEN = 12
#: Windows whose states are computed at once.
TOGETHER = 1_024
#: Bounds of the training sample: about so many labelled documents of each language, of each at most so many windows,
#: evenly over its text, and their width.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_WIDTH = 500, 12, 64
ITERATIONS, BATCH, RATE = 400, 128, 0.02
UNKNOWN = "und"


def windows(raw: np.ndarray, at: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of byte strings end to end: bytes (windows, CONTEXT + width + CONTEXT), OUTSIDE where there are none;
    how many bytes each labels; the string of each."""
    sizes = np.diff(at)
    each = -(-sizes // width)
    of = np.repeat(np.arange(len(sizes)), each)
    first = common.spread(np.zeros(len(sizes), np.int64), each) * width
    place = first[:, None] + np.arange(-CONTEXT, width + CONTEXT)
    inside = (place >= 0) & (place < sizes[of][:, None])
    out = np.full(place.shape, OUTSIDE, np.int64)
    out[inside] = raw[(place + at[:-1][of][:, None])[inside]]
    return out, np.minimum(width, sizes[of] - first), of


class Network:
    """Parameters p, by direction f and b: in (3 HIDDEN, 257) for the byte that is read, re (3 HIDDEN, HIDDEN) for the
    state before, each for update, reset and candidate; out (languages, HIDDEN); and bias (languages, 1)."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"bias": np.zeros((len(languages), 1), np.float32)}
        for d in "fb":
            self.p[f"in_{d}"] = (0.5 * rng.standard_normal((3 * HIDDEN, OUTSIDE + 1))).astype(np.float32)
            self.p[f"re_{d}"] = (rng.standard_normal((3 * HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
            self.p[f"out_{d}"] = (rng.standard_normal((len(languages), HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)

    def _run(self, d: str, b: np.ndarray, keep: list | None = None) -> np.ndarray:
        """What a direction adds to the scores (width, languages, windows) of the bytes (steps, windows) that are labelled."""
        read, re, out = self.p[f"in_{d}"], self.p[f"re_{d}"], self.p[f"out_{d}"]
        steps = b.shape[0] - CONTEXT  # the context on the far side isn't read
        y = np.empty((steps - CONTEXT, len(out), b.shape[1]), re.dtype)
        h = np.zeros((HIDDEN, b.shape[1]), re.dtype)
        x, g = np.empty((3 * HIDDEN, b.shape[1]), re.dtype), np.empty((3 * HIDDEN, b.shape[1]), re.dtype)
        for k in range(steps):
            t = k if d == "f" else b.shape[0] - 1 - k
            if keep is not None:
                x, g = np.empty_like(x), np.empty_like(g)
            read.take(b[t], axis=1, out=x, mode="clip")
            np.matmul(re, h, out=g)
            zr, n = x[: 2 * HIDDEN], x[2 * HIDDEN :]
            zr += g[: 2 * HIDDEN]
            zr *= 0.5  # the sigmoid of twice this
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:HIDDEN], zr[HIDDEN:]
            n += r * g[2 * HIDDEN :]
            np.tanh(n, out=n)
            new = h - n
            new *= z
            new += n
            if keep is not None:
                keep.append((t, h, z, r, n, g[2 * HIDDEN :], new))
            h = new
            if k >= CONTEXT:
                np.matmul(out, h, out=y[t - CONTEXT])
        return y

    def positions(self, b: np.ndarray) -> np.ndarray:
        """Probabilities (width, languages, windows) of every labelled byte of windows (windows, steps)."""
        b = np.ascontiguousarray(b.T)
        y = self._run("f", b) + self._run("b", b) + self.p["bias"]
        y = np.exp(y - y.max(axis=1, keepdims=True))
        return y / y.sum(axis=1, keepdims=True)

    def documents(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of byte strings end to end, the means over their bytes; an empty one gets zeros."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        b, n, of = windows(raw, at)
        for a in range(0, len(b), TOGETHER):
            last = slice(a, a + TOGETHER)
            there = np.arange(WIDTH)[:, None] < n[last]
            p = np.einsum("tlw,tw->lw", self.positions(b[last]), there.astype(np.float32), dtype=np.float64)
            np.add.at(out, of[last], p.T)
        return out / np.maximum(np.diff(at), 1)[:, None]

    def gradients(self, b: np.ndarray, n: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, weighted by language, and its gradients: backpropagation through time."""
        b = np.ascontiguousarray(b.T)
        kept: dict[str, list] = {"f": [], "b": []}
        y = sum(self._run(d, b, kept[d]) for d in "fb") + self.p["bias"]
        y = np.exp(y - y.max(axis=1, keepdims=True))
        y /= y.sum(axis=1, keepdims=True)
        w = ((np.arange(len(y))[:, None] < n) * weight[label]).astype(y.dtype)
        w /= w.sum()
        column = np.arange(len(label))
        loss = -float((np.log(y[:, label, column] + 1e-9) * w).sum())
        dy = y * w[:, None, :]
        dy[:, label, column] -= w
        grad = {"bias": dy.sum((0, 2))[:, None]}
        for d in "fb":
            re, out = self.p[f"re_{d}"], self.p[f"out_{d}"]
            dre, dout, carried = np.zeros_like(re), np.zeros_like(out), np.zeros((HIDDEN, b.shape[1]), re.dtype)
            dx, which = np.empty((3 * HIDDEN, len(kept[d]), b.shape[1]), re.dtype), np.empty((len(kept[d]), b.shape[1]), np.int64)
            for k in range(len(kept[d]) - 1, -1, -1):
                t, h, z, r, c, g, new = kept[d][k]
                dh = carried
                if k >= CONTEXT:
                    dh = dh + out.T @ dy[t - CONTEXT]
                    dout += dy[t - CONTEXT] @ new.T
                dc = dh * (1 - z) * (1 - c * c)
                x = dx[:, k]
                x[:HIDDEN] = dh * (h - c) * z * (1 - z)
                x[HIDDEN : 2 * HIDDEN] = dc * g * r * (1 - r)
                x[2 * HIDDEN :] = dc
                dg = np.concatenate([x[: 2 * HIDDEN], dc * r])
                dre += dg @ h.T
                carried = dh * z + re.T @ dg
                which[k] = b[t]
            flat = which.ravel()
            grad[f"in_{d}"] = np.stack([np.bincount(flat, weights=row.ravel(), minlength=OUTSIDE + 1) for row in dx]).astype(re.dtype)
            grad[f"re_{d}"], grad[f"out_{d}"] = dre, dout
        return loss, grad

    def train(self, b: np.ndarray, n: np.ndarray, label: np.ndarray, iterations: int = ITERATIONS, seed: int = 11) -> list[float]:
        """Adam; languages weigh alike however many rows they have."""
        rng, losses = np.random.default_rng(seed), []
        weight = (1 / np.maximum(1, np.bincount(label, minlength=len(self.languages)))).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(1, iterations + 1):
            rows = rng.integers(0, len(b), min(BATCH, len(b)))
            loss, grad = self.gradients(b[rows], n[rows], label[rows], weight)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * (1 - 0.9 * i / iterations)
            for k, g in grad.items():
                g = g * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
        return losses


def held_out() -> F.Column:
    """Of documents that nothing is learnt from: crc32 of doc_id as text is divisible by 5. A null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang and text of about per_language documents of each language, those whose hash is lowest, that can be learnt from:
    not held out, with an id, a language and a text. Repeated rows count once, so that no language gets many more."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & (F.length("text") > 0)).select("lang", "text", F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 40)).alias("hash"))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return usable.select("lang", "text").limit(0)
    below = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 40, -(-(per_language << 40) // n)))))
    return usable.where(F.col("hash") < below[F.col("lang")]).groupBy("lang", "hash").agg(F.first("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, iterations: int = ITERATIONS) -> Network | None:
    """A network trained on sample(docs, sample_docs), of which every document gives at most SAMPLE_WINDOWS windows of
    SAMPLE_WIDTH bytes, evenly over its whole text: a few MB come to the driver. None if there is nothing to learn from.

    Null ids, languages and texts and empty texts are not learnt from; extra columns aren't read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, labels, found = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py().encode()
                b, size, _ = windows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SAMPLE_WIDTH)
                for k in sorted({i * len(b) // SAMPLE_WINDOWS for i in range(SAMPLE_WINDOWS)}):
                    langs.append(lang)
                    labels.append(int(size[k]))
                    found.append(b[k].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(labels, pa.int64()), pa.array(found, pa.binary())], names=["lang", "n", "bytes"])

    common.bounded(docs)
    got = sample(docs, sample_docs).mapInArrow(cut, "lang string, n long, bytes binary").toArrow()
    if not got.num_rows:
        return None
    rows = sorted(zip(got["bytes"].to_pylist(), got["lang"].to_pylist(), got["n"].to_pylist(), strict=True))  # the order of tasks doesn't matter
    languages = sorted({r[1] for r in rows})
    b = np.frombuffer(b"".join(r[0] for r in rows), "<u2").reshape(len(rows), -1).astype(np.int64)
    network = Network(languages)
    network.train(b, np.array([r[2] for r in rows]), np.searchsorted(languages, np.array([r[1] for r in rows])), iterations)
    return network


def predict(docs: DataFrame, network: Network | None, keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns in keep (default doc_id) of docs, and two more of the given names: the language, and the mean
    probability of it over all positions.

    "und" with score 0 for a null or empty text, one without letters, or without a network. A row for every row,
    repeated ones alike; texts are read whole, however long. lang and source are not read unless kept. A name in keep
    must not be one of the two names.
    """
    keep = keep or ["doc_id"]
    if {k.lower() for k in keep} & {k.lower() for k in names}:
        raise ValueError(f"columns {keep} clash with {names}")
    common.bounded(docs)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    there = keep.index("text") if "text" in keep else len(keep)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in common.slices(batch, batch.schema.names[there], common.SMALL_CHARS):
                column = run.column(there)
                letters = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\pL"), False))
                found, score = np.full(run.num_rows, UNKNOWN, object), np.zeros(run.num_rows)
                if network and run.num_rows:
                    p = network.documents(*common.utf8(column))
                    best = p.argmax(axis=1)
                    found[letters] = np.array(network.languages, object)[best[letters]]
                    score[letters] = np.clip(p[np.arange(len(p)), best][letters], 0, 1)
                yield pa.RecordBatch.from_arrays([*(run.column(i) for i in range(len(keep))), pa.array(found, pa.string()), pa.array(score)], names=[*keep, *names])

    read = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("text to read"))
    return read.mapInArrow(predicted, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def identify(docs: DataFrame) -> DataFrame:
    """The rows of op4: doc_id, held_out, lang_pred, score; one for every row of docs, null ids too (not held out). An
    empty table gives none."""
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
