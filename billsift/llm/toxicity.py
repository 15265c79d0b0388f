"""Toxicity by weak supervision: many voters, a label model, a linear classifier."""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, labelled_sample

#: Bounds: training documents of each label, lexicon entries kept, those of them that vote.
PER_LABEL, ENTRIES, VOTERS = 2000, 2048, 256
#: Lengths of word beginnings; a whole word is one with an end mark. Least documents of an entry.
SHORTEST, LONGEST, SUPPORT = 3, 8, 3
#: Times likelier in toxic documents, two standard errors off, for an entry of the classifier and for a voter.
RATIO, VOTER_RATIO = 3.0, 15.0
ROUNDS, RELATED = 8, 0.6
OTHERS = regex.compile(r"\P{L}+")
#: Voters on the writing itself; each is a feature of the classifier too.
PATTERNS = (
    ("shouting", regex.compile(r"\b\p{Lu}{4,}\b")),
    ("exclamations", regex.compile(r"!{2,}|[!?]{3,}")),
    ("masked", regex.compile(r"\p{L}[*@#$]+\p{L}")),
    ("address", regex.compile(r"\b(?:you|du|tu|vous|usted)\b", regex.I)),
)


@dataclass
class Model:
    entries: list[str]
    weights: np.ndarray  # of entries, then patterns
    bias: float
    accuracies: dict[str, tuple[float, float]]  # voter: share of hits in toxic and in clean documents
    discounts: dict[str, float]  # voter: weight left after its correlations


def mine(sample: DataFrame) -> list[tuple[str, float]]:
    """(entry, ratio): words and word beginnings that mark toxic sample documents.

    Counted in Spark over the bounded sample. A longer entry that occurs in just
    the documents of its own beginning adds nothing and is left out.
    """
    total = {int(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    word = sample.select("_id", "label", F.explode(F.array_distinct(
        F.split(F.lower("text"), r"\P{L}+"))).alias("w")).where(F.length("w") >= SHORTEST)
    starts = F.transform(F.sequence(F.lit(SHORTEST), F.least(F.length("w"), F.lit(LONGEST))),
                         lambda n: F.substring(F.col("w"), F.lit(1), n))
    entry = word.select("_id", "label", F.explode(
        F.array_append(starts, F.concat("w", F.lit(" ")))).alias("e")).distinct()
    toxic = F.sum((F.col("label") == 1).cast("long"))
    counts = entry.groupBy("e").agg(toxic.alias("t"), F.count("*").alias("n")).where(F.col("t") >= SUPPORT)
    clean = F.col("n") - F.col("t")
    rate = ((F.col("t") - 2 * F.sqrt("t")) / max(1, total.get(1, 0))) / (
        (clean + 2 * F.sqrt(clean) + 0.5) / max(1, total.get(0, 0)))
    best = counts.withColumn("r", rate).where(F.col("r") >= RATIO) \
        .orderBy((F.col("t") * F.log("r")).desc(), F.length("e"), "e").limit(2 * ENTRIES).collect()
    seen = {r["e"]: (r["t"], r["n"]) for r in best}
    return [(r["e"], r["r"]) for r in best
            if not any(seen.get(r["e"][:k]) == seen[r["e"]] for k in range(SHORTEST, len(r["e"])))][:ENTRIES]


class Finder:
    """Entries and patterns that occur in a text."""

    def __init__(self, entries: list[str]):
        self.size = len(entries)
        self.machine = ahocorasick.Automaton()
        for n, entry in enumerate(entries):
            self.machine.add_word(" " + entry, n)
        if entries:
            self.machine.make_automaton()

    def __call__(self, text: str) -> list[int]:
        words = " " + OTHERS.sub(" ", text.lower()) + " "
        hits = {n for _, n in self.machine.iter(words)} if self.size else set()
        hits.update(self.size + k for k, (_, p) in enumerate(PATTERNS) if p.search(text))
        return sorted(hits)


def label_model(votes: np.ndarray, weight: np.ndarray, start: np.ndarray, prior: float):
    """Posterior of each document, hit rates of each voter by class, and its discount.

    A voter votes toxic or abstains; the last column votes clean (no voter
    hit). Expectation maximisation estimates each voter's rates from the
    posteriors alone, from those that the lexicon's own ratios (``start``, log
    odds by voter) give. Voters that hit together more than their class explains
    (correlation within a class above ``RELATED``) share their say: each counts
    by 1 / (1 + sum of such correlations).
    """
    base = np.log(prior / (1 - prior))
    q = 1 / (1 + np.exp(-np.clip(base + votes @ start, -30, 30)))
    for _ in range(ROUNDS):
        w1, w0 = weight * q, weight * (1 - q)
        hit1 = (w1 @ votes + 0.5) / (w1.sum() + 1)
        hit0 = (w0 @ votes + 0.5) / (w0.sum() + 1)
        related = np.zeros((votes.shape[1],) * 2)
        for w, rate in ((w1, hit1), (w0, hit0)):
            off = votes - rate
            cov = (off * w[:, None]).T @ off / max(w.sum(), 1e-9)
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-4))
            related = np.maximum(related, cov / scale / scale[:, None])
        np.fill_diagonal(related, 0)
        discount = 1 / (1 + np.where(related > RELATED, related, 0).sum(axis=1))
        odds = base + votes @ (discount * np.log(hit1 / hit0))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, hit1, hit0, discount


def ballots(x: np.ndarray, columns: list[int], ratios: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Votes of lexicon entries, of patterns (no say at the start) and of silence."""
    votes = x[:, columns]
    silent = ~votes[:, :len(ratios)].any(axis=1)
    start = np.array([*ratios, *[0.0] * (len(columns) - len(ratios)), -2.0])
    return np.column_stack([votes, silent]), start


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear classifier on soft labels by Adam, with a small squared penalty."""
    w, b = np.zeros(x.shape[1]), -2.0
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        d = weight * (p - target) / weight.sum()
        g, gb = d @ x + 2e-5 * w, float(d.sum())
        m, s = .9 * m + .1 * g, .99 * s + .01 * g * g
        mb, sb = .9 * mb + .1 * gb, .99 * sb + .01 * gb * gb
        fix = np.sqrt(1 - .99 ** step) / (1 - .9 ** step)
        w -= .05 * fix * m / (np.sqrt(s) + 1e-9)
        b -= .05 * fix * mb / (sb ** .5 + 1e-9)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic",
        doc_id: str = "doc_id", text: str = "text", per_label: int = PER_LABEL) -> Model:
    """Mine voters, estimate the label model and train the classifier.

    Labels serve to find the lexicon and the share of toxic documents; the
    classifier itself learns the label model's posteriors. All on a bounded sample:
    at most ``per_label`` documents of each label that ``allowed`` leaves, of
    which only the hits come to the driver. With one label only, or none, the
    score is constant.
    """
    sample, counts = labelled_sample(docs, labels, label, allowed, per_label, doc_id, text)
    counts = {int(k): n for k, n in counts.items()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return Model([], np.zeros(len(PATTERNS)), 30.0 if share else -30.0 if counts else 0.0, {}, {})
    mined = mine(sample)
    entries = [e for e, _ in mined]

    def find():
        finder = Finder(entries)
        return lambda texts: [[finder(t) for t in texts]]

    field = T.StructField("hits", T.ArrayType(T.IntegerType()))
    rows = add_columns(sample, "text", [field], find).select("_id", "label", "hits").collect()
    rows.sort(key=lambda r: (r["_id"], r["hits"]))
    x = np.zeros((len(rows), len(entries) + len(PATTERNS)))
    for n, r in enumerate(rows):
        x[n, r["hits"]] = 1
    y = np.array([int(r["label"]) for r in rows])
    taken = np.maximum(1, np.bincount(y, minlength=2))
    weight = np.where(y == 1, share / taken[1], (1 - share) / taken[0]) * len(rows)
    voting = [n for n, (_, ratio) in enumerate(mined) if ratio >= VOTER_RATIO][:VOTERS]
    columns = voting + list(range(len(entries), x.shape[1]))
    votes, start = ballots(x, columns, [np.log(mined[n][1]) for n in voting])
    q, hit1, hit0, discount = label_model(votes, weight, start, min(max(share, 1e-4), 1 - 1e-4))
    w, b = logistic(x, q, weight)
    names = [*entries, *(n for n, _ in PATTERNS)]
    return Model(entries, w, b, {names[c]: (float(a), float(z)) for c, a, z in zip(columns, hit1, hit0)},
                 {names[c]: float(v) for c, v in zip(columns, discount)})


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Append each whole text's probability of being toxic; other columns are kept.

    One automaton finds all entries in a text in a single pass. Null and empty
    texts have no hits and get the classifier's base probability. Equal texts
    have equal scores. A column named ``out`` is replaced. No shuffle; the model
    (at most ``ENTRIES`` words) travels with the tasks.
    """
    # plain arrays and lists: workers need no copy of this package to read them
    sent = df.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        model = Model(**sent.value)
        finder = Finder(model.entries)

        def compute(texts):
            odds = np.array([model.weights[finder(t)].sum() + model.bias for t in texts])
            return [(1 / (1 + np.exp(-np.clip(odds, -30, 30)))).round(6).tolist()]

        return compute

    return add_columns(df, text, [T.StructField(out, T.DoubleType())], make)
