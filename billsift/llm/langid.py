"""Language identification: a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import add_columns, labelled_sample

#: Units a direction, bytes of a chunk, languages from which on the sample is shared, sample bounds.
UNITS, LENGTH, LANGUAGES = 12, 160, 64
PER_LANGUAGE, CHUNKS = 400, 2
EPOCHS, BATCH, RATE = 10, 128, 0.01
#: Chunks read side by side in a task, fewer with many languages; bounds memory on texts of any length.
WIDTH = 2048
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Of each direction: gate inputs by byte (256 x 3U), recurrent gates (U x 2U) and candidate (U x U)."""

    inputs: list[np.ndarray]
    gates: list[np.ndarray]
    candidate: list[np.ndarray]
    outer: np.ndarray  # 2U x languages
    outer_bias: np.ndarray
    languages: list[str]


def gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid."""
    x *= 0.2
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def chunks(data: bytes) -> np.ndarray:
    """The text's bytes as rows; the last row is filled with zero bytes."""
    rows = -(-max(1, len(data)) // LENGTH)
    room = np.zeros(rows * LENGTH, np.uint8)
    room[:len(data)] = np.frombuffer(data, np.uint8)
    return room.reshape(rows, LENGTH)


def states(net: Network, rows: np.ndarray, way: int, trace: list | None = None) -> np.ndarray:
    """Hidden state at every place (time first), reading forwards (0) or backwards (1)."""
    steps = range(rows.shape[1]) if way == 0 else range(rows.shape[1] - 1, -1, -1)
    h = np.zeros((len(rows), UNITS), "f4")
    out = np.empty((rows.shape[1], len(rows), UNITS), "f4")
    table, gates, candidate = net.inputs[way], net.gates[way], net.candidate[way]
    for t in steps:
        x = table[rows[:, t]]
        zr = gate(x[:, :2 * UNITS] + h @ gates)
        z, r = zr[:, :UNITS], zr[:, UNITS:]
        c = np.tanh(x[:, 2 * UNITS:] + (r * h) @ candidate)
        if trace is not None:
            trace.append((t, h, zr, c))
        h = h + z * (c - h)
        out[t] = h
    return out


def places(net: Network, rows: np.ndarray) -> np.ndarray:
    """Language probabilities of every byte, time first."""
    logits = states(net, rows, 0) @ net.outer[:UNITS] + states(net, rows, 1) @ net.outer[UNITS:]
    logits += net.outer_bias
    logits -= logits.max(axis=2, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=2, keepdims=True)
    return logits


def predict(net: Network, texts: list[str]) -> tuple[list[str], list[float]]:
    """Label every byte of the whole texts and pool the means of each document."""
    width = max(1, WIDTH * LANGUAGES // max(LANGUAGES, len(net.languages)))
    total = np.zeros((len(texts), len(net.languages)))
    batch, owner, held = [], [], 0

    def flush():
        nonlocal batch, owner, held
        if batch:
            rows, own = np.concatenate(batch), np.concatenate(owner)
            for i in range(0, len(rows), width):
                part = rows[i:i + width]
                seen = places(net, part) * (part.T > 0)[:, :, None]
                np.add.at(total, own[i:i + width], seen.sum(axis=0, dtype="f8"))
        batch, owner, held = [], [], 0

    lettered = [bool(net.languages) and bool(LETTER.search(t)) for t in texts]
    for n, text in enumerate(texts):
        if lettered[n]:
            batch.append(chunks(text.encode()))
            owner.append(np.full(len(batch[-1]), n))
            held += len(batch[-1])
            if held >= width:
                flush()
    flush()
    sums = total.sum(axis=1)
    names, scores = [], []
    for n in range(len(texts)):
        if lettered[n] and sums[n] > 0:
            best = int(total[n].argmax())
            names.append(net.languages[best])
            scores.append(round(float(min(1.0, total[n, best] / sums[n])), 6))
        else:
            names.append(UNKNOWN)
            scores.append(0.0)
    return names, scores


def backward(net: Network, rows: np.ndarray, way: int, trace: list, d_out: np.ndarray) -> tuple:
    """Gradients of one direction, from the last step it read to the first."""
    d_in, d_gates = np.zeros_like(net.inputs[way]), np.zeros_like(net.gates[way])
    d_cand = np.zeros_like(net.candidate[way])
    d_h = np.zeros((len(rows), UNITS), "f4")
    for t, h, zr, c in reversed(trace):
        z, r = zr[:, :UNITS], zr[:, UNITS:]
        d_h = d_h + d_out[t]
        d_c = d_h * z * (1 - c * c)
        d_z = d_h * (c - h)
        d_rh = d_c @ net.candidate[way].T
        d_cand += (r * h).T @ d_c
        d_zr = np.concatenate([d_z, d_rh * h], axis=1) * 0.2 * ((zr > 0) & (zr < 1))
        d_gates += h.T @ d_zr
        d_x = np.concatenate([d_zr, d_c], axis=1)
        cell = rows[:, t].astype(np.int64)[:, None] * (3 * UNITS) + np.arange(3 * UNITS)
        d_in += np.bincount(cell.ravel(), d_x.ravel(), d_in.size).reshape(d_in.shape)
        d_h = d_h * (1 - z) + d_rh * r + d_zr @ net.gates[way].T
    return d_in, d_gates, d_cand


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Backpropagation through time over whole chunks; every byte has its document's language as target."""
    rng = np.random.default_rng(seed)
    two = range(2)
    net = Network([rng.normal(0, .2, (256, 3 * UNITS)).astype("f4") for _ in two],
                  [rng.normal(0, .25, (UNITS, 2 * UNITS)).astype("f4") for _ in two],
                  [rng.normal(0, .25, (UNITS, UNITS)).astype("f4") for _ in two],
                  rng.normal(0, .2, (2 * UNITS, len(languages))).astype("f4"),
                  np.zeros(len(languages), "f4"), languages)
    share = np.bincount(labels, minlength=len(languages))
    weight = (len(labels) / len(languages) / np.maximum(share, 1)).astype("f4")
    params = [*net.inputs, *net.gates, *net.candidate, net.outer, net.outer_bias]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            own = order[at:at + BATCH]
            x, y = rows[own], labels[own]
            traces = [[], []]
            h = np.concatenate([states(net, x, w, traces[w]) for w in two], axis=2)
            logits = h @ net.outer + net.outer_bias
            logits -= logits.max(axis=2, keepdims=True)
            d = np.exp(logits)
            d /= d.sum(axis=2, keepdims=True)
            d[:, np.arange(len(own)), y] -= 1
            d *= (x.T > 0)[:, :, None] * weight[y][None, :, None]
            d /= max(1, int((x > 0).sum()))
            d_h = d @ net.outer.T
            sides = [backward(net, x, w, traces[w], d_h[:, :, w * UNITS:(w + 1) * UNITS]) for w in two]
            grads = [*(s[0] for s in sides), *(s[1] for s in sides), *(s[2] for s in sides),
                     np.einsum("tbh,tbc->hc", h, d, optimize=True), d.sum(axis=(0, 1))]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS) + RATE / 50
            for p, g, m, s in zip(params, grads, mean, square):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += .1 * (g - m)
                s += .01 * (g * g - s)
                p -= (rate * (m / (1 - .9 ** step)) / (np.sqrt(s / (1 - .99 ** step)) + 1e-8)).astype("f4")
    return net


def fit(docs: DataFrame, allowed: Column, label: str = "lang", doc_id: str = "doc_id",
        text: str = "text", per_language: int = PER_LANGUAGE) -> Network:
    """Train on a bounded sample of the documents that ``allowed`` leaves.

    Every label is learned. At most ``per_language`` documents of each and ``CHUNKS``
    chunks of each document, spread over its text, come to the driver; more than
    ``LANGUAGES`` labels share the sample of so many, each with fewer documents. Without any labelled document the network knows no language
    and answers ``und``.
    """
    sample, counts = labelled_sample(docs, docs, label, allowed, per_language, doc_id, text, LANGUAGES)
    languages = sorted(counts)

    def cut(texts):
        out = []
        for t in texts:
            rows = chunks(t.encode())
            out.append([rows[i].tobytes() for i in np.unique(
                np.linspace(0, len(rows) - 1, CHUNKS + 2).astype(int)[1:-1])])
        return [out]

    field = T.StructField("chunks", T.ArrayType(T.BinaryType()))
    rows = add_columns(sample, "text", [field], lambda: cut).select("_id", "label", "chunks").collect()
    rows = sorted((r["_id"], r["label"], bytes(c)) for r in rows for c in r["chunks"])
    if not rows:
        return Network([], [], [], np.zeros(0), np.zeros(0), [])
    data = np.stack([np.frombuffer(r[2], np.uint8) for r in rows])
    return train(data, np.array([languages.index(r[1]) for r in rows]), languages)


def identify(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score``; columns of these names are replaced, others kept.

    Both directions label every byte of the whole text, read in chunks side by
    side; a document's probabilities are the means over its bytes (``score``: that of
    the best). Null texts and texts without a letter are ``und`` with score 0.
    Ties go to the language first in the alphabet; equal texts get equal
    answers. No shuffle; the network (under 200 kB, and 100 bytes a language) travels with the tasks.
    """
    # plain arrays: workers need no copy of this package to read them
    sent = df.sparkSession.sparkContext.broadcast(vars(net))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

    def make():
        net = Network(**sent.value)
        return lambda texts: predict(net, texts)

    return add_columns(df, text, fields, make)
