"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .common import add_columns, labelled_sample

#: Bytes of a chunk, from one chunk's start to the next, taps of a filter, filters, hidden units.
LENGTH, STEP, TAPS, FILTERS, HIDDEN = 512, 448, 4, 32, 16
#: Bounds of the training sample: documents of each label, chunks of a document.
PER_LABEL, CHUNKS = 1500, 6
STEPS, BATCH, RATE = 800, 48, 0.004
#: Bytes filtered at once in a task (128 times as many in memory, twice); bounds memory on texts of any length.
BLOCK = 1 << 15


@dataclass
class Network:
    """Filters as one table per tap: row = byte, column = filter."""

    taps: np.ndarray  # TAPS x 256 x FILTERS
    bias: np.ndarray
    inner: np.ndarray  # FILTERS x HIDDEN
    inner_bias: np.ndarray
    outer: np.ndarray  # 2 * HIDDEN: for means and maxima over chunks
    outer_bias: float
    constant: float | None = None


def starts(n_bytes: int) -> np.ndarray:
    """Chunk starts that cover every byte; one chunk for an empty text."""
    return np.arange(0, max(1, n_bytes - (LENGTH - STEP)), STEP)


def padded(data: bytes, at: np.ndarray) -> np.ndarray:
    """Chunks of ``data`` as rows, the last filled with zero bytes."""
    room = np.zeros(int(at[-1]) + LENGTH, np.uint8)
    room[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(room, LENGTH)[at]


def responses(net: Network, rows: np.ndarray) -> np.ndarray:
    """Filter responses at each place of each chunk."""
    width = LENGTH - TAPS + 1
    out = np.take(net.taps[0], rows[:, :width], axis=0)
    for k in range(1, TAPS):
        out += np.take(net.taps[k], rows[:, k:k + width], axis=0)
    return out


def pooled(net: Network, rows: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each chunk, above 0."""
    step = max(1, BLOCK // LENGTH)
    tops = [responses(net, rows[i:i + step]).max(axis=1) for i in range(0, len(rows), step)]
    return np.maximum(np.concatenate(tops) + net.bias, 0)


def combine(net: Network, hidden: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and maxima of the chunks of each document, and its probability."""
    sizes = np.diff(np.append(first, len(hidden)))[:, None]
    seen = np.concatenate([np.add.reduceat(hidden, first) / sizes,
                           np.maximum.reduceat(hidden, first)], axis=1)
    return seen, 1 / (1 + np.exp(-np.clip(seen @ net.outer + net.outer_bias, -30, 30)))


def score_texts(net: Network, texts: list[str]) -> list[float]:
    if net.constant is not None:
        return [net.constant] * len(texts)
    out: list[float] = []
    batch, sizes, held = [], [], 0

    def flush():
        nonlocal batch, sizes, held
        if batch:
            top = pooled(net, np.concatenate(batch))
            hidden = np.maximum(top @ net.inner + net.inner_bias, 0)
            first = np.cumsum([0, *sizes[:-1]])
            out.extend(combine(net, hidden, first)[1].astype(float).round(6).tolist())
        batch, sizes, held = [], [], 0

    for text in texts:
        data = text.encode()
        rows = padded(data, starts(len(data)))
        batch.append(rows)
        sizes.append(len(rows))
        held += rows.size
        if held >= 32 * BLOCK:
            flush()
    flush()
    return out


def train(examples: list[tuple[list[bytes], int]], weights: dict[int, float], seed: int = 5) -> Network:
    """Adam on the weighted log loss; a filter's gradient goes to the place of its maximum."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, .3, (TAPS, 256, FILTERS)).astype("f4"), np.zeros(FILTERS, "f4"),
                  rng.normal(0, .25, (FILTERS, HIDDEN)).astype("f4"), np.zeros(HIDDEN, "f4"),
                  rng.normal(0, .25, 2 * HIDDEN).astype("f4"), 0.0)
    chunks = [np.concatenate([padded(c, np.array([0])) for c in parts]) for parts, _ in examples]
    labels = np.array([y for _, y in examples], "f4")
    weight = np.array([weights[y] for _, y in examples], "f4")
    params = ["taps", "bias", "inner", "inner_bias", "outer", "outer_bias"]
    mean = {p: np.zeros_like(getattr(net, p)) if p != "outer_bias" else 0.0 for p in params}
    square = {p: np.zeros_like(getattr(net, p)) if p != "outer_bias" else 0.0 for p in params}
    order = np.concatenate([rng.permutation(len(examples))
                            for _ in range(-(-STEPS * BATCH // len(examples)))])
    for step in range(1, STEPS + 1):
        rate = RATE * (1 - step / STEPS) + RATE / 20
        own = order[(step - 1) * BATCH:step * BATCH]
        rows = np.concatenate([chunks[i] for i in own])
        sizes = np.array([len(chunks[i]) for i in own])
        first = np.cumsum(np.append(0, sizes[:-1]))
        place, top = [], []
        for i in range(0, len(rows), BLOCK // LENGTH):
            r = responses(net, rows[i:i + BLOCK // LENGTH])
            place.append(r.argmax(axis=1))
            top.append(np.take_along_axis(r, place[-1][:, None], 1)[:, 0])
        place, top = np.concatenate(place), np.concatenate(top)
        p = np.maximum(top + net.bias, 0)
        hidden = np.maximum(p @ net.inner + net.inner_bias, 0)
        seen, prob = combine(net, hidden, first)
        d = (prob - labels[own]) * weight[own] / len(own)
        d_seen = d[:, None] * net.outer
        owner = np.repeat(np.arange(len(own)), sizes)
        d_hidden = d_seen[owner, :HIDDEN] / sizes[owner, None]
        is_top = hidden == seen[owner, HIDDEN:]
        d_hidden = (d_hidden + d_seen[owner, HIDDEN:] * is_top) * (hidden > 0)
        d_top = (d_hidden @ net.inner.T) * (p > 0)
        d_taps = np.empty_like(net.taps)
        column = np.arange(FILTERS)
        for k in range(TAPS):
            cell = rows[np.arange(len(rows))[:, None], place + k].astype(np.int64) * FILTERS + column
            d_taps[k] = np.bincount(cell.ravel(), d_top.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        grads = {"taps": d_taps, "bias": d_top.sum(0), "inner": p.T @ d_hidden + 1e-4 * net.inner,
                 "inner_bias": d_hidden.sum(0), "outer": seen.T @ d + 1e-4 * net.outer,
                 "outer_bias": float(d.sum())}
        for name, g in grads.items():
            mean[name] = .9 * mean[name] + .1 * g
            square[name] = .99 * square[name] + .01 * g * g
            move = rate * (mean[name] / (1 - .9 ** step)) / (np.sqrt(square[name] / (1 - .99 ** step)) + 1e-7)
            new = getattr(net, name) - move
            setattr(net, name, new.astype("f4") if name != "outer_bias" else float(new))
    return net


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality",
        doc_id: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> Network:
    """Train on a bounded sample of labelled documents that ``allowed`` leaves.

    At most ``per_label`` documents of each label and ``CHUNKS`` chunks of each,
    spread over its whole text, come to the driver. The loss is weighted back to
    the labels' true shares. With one label only, or none, the score is
    that label's constant, or 0.5.
    """
    sample, counts = labelled_sample(docs, labels, label, allowed, per_label, doc_id, text)
    counts = {int(k): n for k, n in counts.items()}
    if len(counts) < 2:
        return Network(*[np.zeros(0)] * 5, 0.0, constant=float(next(iter(counts), 0.5)))

    def cut(texts):
        out = []
        for t in texts:
            data = t.encode()
            at = starts(len(data))
            at = at[np.unique(np.linspace(0, len(at) - 1, CHUNKS).astype(int))]
            out.append([data[i:i + LENGTH] for i in at])
        return [out]

    field = T.StructField("chunks", T.ArrayType(T.BinaryType()))
    rows = add_columns(sample, "text", [field], lambda: cut).select("_id", "label", "chunks").collect()
    rows.sort(key=lambda r: (r["_id"], bytes(r["chunks"][0])))
    examples = [([bytes(c) for c in r["chunks"]], int(r["label"])) for r in rows]
    taken = {y: sum(1 for _, v in examples if v == y) for y in counts}
    if not all(taken.values()):
        return Network(*[np.zeros(0)] * 5, 0.0, constant=counts.get(1, 0) / sum(counts.values()))
    total = sum(counts.values())
    weights = {y: counts[y] / total * len(examples) / taken[y] for y in counts}
    return train(examples, weights)


def score(df: DataFrame, net: Network, text: str = "text", out: str = "score") -> DataFrame:
    """Append each whole text's probability of label 1; other columns are kept.

    A document is cut into overlapping chunks that cover all its bytes. Each
    filter's largest response in a chunk feeds a hidden layer; means and maxima
    of its units over the chunks make one probability. Null counts as empty, and
    an empty text is one chunk of zero bytes, so it has a score like any other.
    Equal texts have equal scores. A column named ``out`` is replaced. No
    shuffle; the network (under 200 kB) travels with the tasks.
    """
    # plain arrays: workers need no copy of this package to read them
    sent = df.sparkSession.sparkContext.broadcast(vars(net))

    def make():
        net = Network(**sent.value)
        return lambda texts: [score_texts(net, texts)]

    return add_columns(df, text, [T.StructField(out, T.DoubleType())], make)
