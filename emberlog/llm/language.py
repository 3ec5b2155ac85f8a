"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled documents. It reads all bytes of a text in windows, in
both directions, gives each position the probabilities of the languages, and a
document's probabilities are the means over its letters.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import stored, table
from emberlog.llm.textops import by_slice

#: Bytes that the network reads at a stretch, and its units in each direction.
WINDOW, UNITS = 64, 8
#: The training sample: about so many documents of each language, but no more than about SAMPLE_TOTAL of all; windows of each document.
SAMPLE_DOCS, SAMPLE_TOTAL, SAMPLE_WINDOWS = 500, 50_000, 4
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.02, 7
#: Windows that are worked on at once.
_BLOCK = 1024
_LETTER = np.zeros(256, np.float32)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


class Model(NamedTuple):
    """Both directions: inputs by byte (256 x 3H: update, reset, candidate), recurrent weights (H x 3H), candidate bias (H); outputs (2H x L), their bias."""

    languages: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    out_b: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(x: np.ndarray, u: np.ndarray, b: np.ndarray, data: np.ndarray, steps: range, tape: list | None = None) -> np.ndarray:
    """States by position (T x B x H)."""
    h = np.zeros((data.shape[1], len(u)), np.float32)
    states = np.empty((*data.shape, len(u)), np.float32)
    n_units = len(u)
    for t in steps:
        a, v = x[data[t]], h @ u
        zr = _sigmoid(a[:, : 2 * n_units] + v[:, : 2 * n_units])
        z, r = zr[:, :n_units], zr[:, n_units:]
        c = v[:, 2 * n_units :] + b
        n = np.tanh(a[:, 2 * n_units :] + r * c)
        if tape is not None:
            tape.append((t, h, z, r, c, n))
        h = n + z * (h - n)
        states[t] = h
    return states


def _backward(u: np.ndarray, data: np.ndarray, tape: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of x, u, b through time."""
    n_units = len(u)
    d_u, d_b = np.zeros_like(u), np.zeros(n_units, np.float32)
    d_in = np.empty((*data.shape, 3 * n_units), np.float32)
    dh = np.zeros((data.shape[1], n_units), np.float32)
    for t, h, z, r, c, n in reversed(tape):
        dh = dh + d_states[t]
        dz = dh * (h - n) * z * (1 - z)
        dn = dh * (1 - z) * (1 - n * n)
        dr = dn * c * r * (1 - r)
        dv = np.concatenate([dz, dr, dn * r], axis=1)
        d_in[t] = np.concatenate([dz, dr, dn], axis=1)
        d_u += h.T @ dv
        d_b += (dn * r).sum(0)
        dh = dh * z + dv @ u.T
    seen = np.zeros((256, data.size), np.float32)
    seen[data.ravel(), np.arange(data.size)] = 1
    return seen @ d_in.reshape(-1, 3 * n_units), d_u, d_b


def windows(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts as rows of width (the last of a text filled with spaces), and each row's text."""
    n = np.array([-(-len(t) // width) for t in texts])
    padded = b"".join(t.ljust(int(k) * width) for t, k in zip(texts, n, strict=True))
    return np.frombuffer(padded, np.uint8).reshape(-1, width), np.repeat(np.arange(len(texts)), n)


def train(texts: list[bytes], labels: list[str], units: int = UNITS, epochs: int = EPOCHS) -> Model:
    """Fits the network to windows of texts; the loss is the cross entropy of every letter's label. Languages count alike, however many texts they have."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], [], [], [], np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(SEED)
    data, of = windows(texts)
    data = data.T
    target = np.array([languages.index(x) for x in labels])[of]
    weight = (len(target) / len(languages) / np.maximum(1, np.bincount(target, minlength=len(languages))))[target].astype(np.float32)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    p = [normal(256, 3 * units, scale=0.3) for _ in range(2)] + [normal(units, 3 * units, scale=units**-0.5) for _ in range(2)]
    p += [np.zeros(units, np.float32) for _ in range(2)] + [normal(2 * units, len(languages), scale=0.3), np.zeros(len(languages), np.float32)]
    mean, square, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for epoch in range(epochs):
        order = rng.permutation(data.shape[1])
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            x, y = data[:, rows], target[rows]
            tapes: list[list] = [[], []]
            ways = (range(len(x)), range(len(x) - 1, -1, -1))
            states = [_forward(p[d], p[2 + d], p[4 + d], x, ways[d], tapes[d]) for d in (0, 1)]
            both = np.concatenate(states, axis=2)
            logits = both @ p[6] + p[7]
            prob = np.exp(logits - logits.max(2, keepdims=True))
            prob /= prob.sum(2, keepdims=True)
            share = _LETTER[x] * weight[rows]
            d = prob
            d[:, np.arange(len(rows)), y] -= 1
            d *= (share / max(1.0, float(share.sum())))[:, :, None]
            d_both = d @ p[6].T
            grads = [None] * 8
            for way in (0, 1):
                part = d_both[:, :, way * units : (way + 1) * units]
                grads[way], grads[2 + way], grads[4 + way] = _backward(p[2 + way], x, tapes[way], part)
            grads[6], grads[7] = np.einsum("tbh,tbl->hl", both, d), d.sum((0, 1))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = RATE * (1 - epoch / epochs) * min(1.0, 1.0 / max(norm, 1e-6))
            for i, g in enumerate(grads):  # Adam
                mean[i] += 0.1 * (g - mean[i])
                square[i] += 0.01 * (g * g - square[i])
                p[i] -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return Model(languages, p[0:2], p[2:4], p[4:6], p[6], p[7])


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of the languages over the letters of each text (without letters: zeros)."""
    data, of = windows(texts)
    n_units, n_lang = len(model.u[0]), len(model.languages)
    sums = np.zeros((len(texts), n_lang + 1))
    # Gates by rows: update and reset are halved for tanh, as sigmoid(x) = (1 + tanh(x / 2)) / 2.
    half = np.r_[np.full(2 * n_units, 0.5), np.ones(n_units)].astype(np.float32)
    xs = [np.ascontiguousarray((x * half)) for x in model.x]
    us = [np.ascontiguousarray((u * half).T) for u in model.u]
    outs = [np.ascontiguousarray(model.out[d * n_units : (d + 1) * n_units].T) for d in (0, 1)]
    for k in range(0, len(data), _BLOCK):
        part = np.ascontiguousarray(data[k : k + _BLOCK].T)
        width, size = part.shape
        logits = np.empty((width, n_lang, size), np.float32)
        for way in (0, 1):
            h = np.zeros((n_units, size), np.float32)
            b = model.b[way][:, None]
            for t in range(width) if way == 0 else range(width - 1, -1, -1):
                a = xs[way][part[t]].T
                v = us[way] @ h
                zr = a[: 2 * n_units] + v[: 2 * n_units]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                c = v[2 * n_units :]
                c += b
                c *= zr[n_units:]
                c += a[2 * n_units :]
                np.tanh(c, out=c)
                h -= c
                h *= zr[:n_units]
                h += c
                if way == 0:
                    np.matmul(outs[0], h, out=logits[t])
                else:
                    logits[t] += outs[1] @ h
        logits += model.out_b[:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        letter = _LETTER[part]
        logits *= (letter / logits.sum(1))[:, None, :]
        found = np.concatenate([logits.sum(0), letter.sum(0)[None]]).T
        np.add.at(sums, of[k : k + _BLOCK], found)
    return sums[:, :-1] / np.maximum(1, sums[:, -1:])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """lang, part: windows spread over the whole texts of up to per_language documents of each language, none held out.

    All languages are learned. Where that would make more than SAMPLE_TOTAL
    documents, fewer of each are taken, but at least one. A language with more
    documents than that gives the one with the least hash of each of so many
    buckets, a smaller one all; equal rows count once.
    """
    known = docs.select("doc_id", "lang", "text")
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    hashed = known.withColumn("hash", F.xxhash64("doc_id", "text", F.lit(SEED)))
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(1, min(per_language, SAMPLE_TOTAL // max(1, sizes.count())))
    bucket = F.when(F.col("n") <= each, F.col("hash")).otherwise(F.pmod(F.xxhash64("hash"), F.lit(each)))
    taken = hashed.select("lang", "hash").join(sizes, "lang").groupBy("lang", bucket.alias("bucket")).agg(F.min("hash").alias("hash")).select("lang", "hash")
    part = F.expr(
        f"transform(sequence(0, {SAMPLE_WINDOWS - 1}), i -> substring(text, 1 + cast(i * greatest(length(text) - {WINDOW}, 0) / {SAMPLE_WINDOWS - 1} as int), {WINDOW}))"
    )
    # SAMPLE_TOTAL rows at most, or one for each language, as many as the model has outputs
    drawn = hashed.join(F.broadcast(stored(taken, "taken")), ["lang", "hash"], "left_semi")
    return drawn.select("lang", "hash", F.explode(F.array_distinct(part)).alias("part")).distinct().select("lang", "part")


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    rows = sorted((r.lang, r.part) for r in training_sample(docs, per_language).collect())
    return train([r[1].encode() for r in rows], [r[0] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs, repeated ones included; und and 0 where the text is null or has no letter, or nothing was learned. A text is read to its end in windows, however long; other columns are ignored."""
    schema = docs.select("doc_id").schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        model = shared.value
        lettered = part.column(2).to_pylist()
        prob = probabilities(model, texts) if model.languages else np.zeros((len(texts), 1))
        best = prob.argmax(1)
        names = [model.languages[b] if ok and model.languages else "und" for b, ok in zip(best, lettered, strict=True)]
        score = [float(min(1.0, p[b])) if ok else 0.0 for p, b, ok in zip(prob, best, lettered, strict=True)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(score, pa.float64())], names=schema.names)

    own = docs.select(
        "doc_id",
        F.col("text").cast("binary").alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    return own.mapInArrow(by_slice(run), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; what is learned comes from documents that aren't held out. See identify() for odd rows; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
