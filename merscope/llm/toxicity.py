"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merscope.llm.batches import bound_batches
from merscope.llm.samples import label_rows, lowest_hashes, with_columns_of

# Bounds of the sample. Each classifier gets all positive examples and its
# share of the unlabelled ones.
MEMBERS = 3
MOST_POSITIVE = 2_000
MOST_UNLABELLED = 9_000
MOST_FEATURES = 2_048

PREFIXES = range(3, 9)
HASH_BITS = 20
LEAST_Z = 5.0
STEPS, RATE, DECAY = 300, 0.1, 1e-4
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LEAST_PURITY = 0.5
REMEMBERED = 200_000


def features_of_word(word: str) -> list[str]:
    """The word and its beginnings, which inflected forms share."""
    return [word] + [f"{word[:k]}*" for k in PREFIXES if len(word) >= k]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class Classifier:
    """A linear model: logit = bias + sum of the weights of the features present."""

    weights: dict[str, float]
    bias: float


def surprising(positive: list[set[str]], unlabelled: list[set[str]], prior: float) -> list[str]:
    """Features more frequent in the positive documents, most significant first.

    A feature must be in more positive documents than chance explains and, by
    the prior, in at least as many toxic documents as others. Counted by hash
    first, in arrays of fixed size; only features of buckets
    that stand out are then counted by name.
    """

    def z_scores(p, u):
        rate = (p + u) / (len(positive) + len(unlabelled))
        spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12) * (1 / len(positive) + 1 / len(unlabelled)))
        return (p / len(positive) - u / len(unlabelled)) / spread

    size = 1 << HASH_BITS
    counts = np.zeros((2, size))
    for row, group in enumerate((positive, unlabelled)):
        for words in group:
            found = {zlib.crc32(f.encode()) & (size - 1) for w in words for f in features_of_word(w)}
            counts[row, list(found)] += 1
    hot = set(np.flatnonzero(z_scores(*counts) >= LEAST_Z).tolist())
    named = [Counter(), Counter()]
    for count, group in zip(named, (positive, unlabelled), strict=True):
        for words in group:
            count.update({f for w in words for f in features_of_word(w) if zlib.crc32(f.encode()) & (size - 1) in hot})
    names = sorted(named[0])
    if not names:
        return []
    p, u = (np.array([count[f] for f in names]) for count in named)
    z, purity = z_scores(p, u), prior * (p / len(positive)) / ((u + 1) / len(unlabelled))
    best = sorted((-s, f) for s, q, f in zip(z, purity, names, strict=True) if s >= LEAST_Z and q >= LEAST_PURITY)
    return [f for _, f in best[:MOST_FEATURES]]


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, with logistic loss.

    The risk of negatives is what unlabelled rows cost as negatives, less the
    share of it, by the class prior, that positives cause. Where that
    difference is below zero, which no true risk can be, the step goes the
    other way (Kiryo et al., 2017).
    """
    both = np.vstack([positive, unlabelled]).astype(np.float32)
    both = np.hstack([both, np.ones((len(both), 1), np.float32)])
    n_p, n_u = len(positive), len(unlabelled)
    w = np.zeros(both.shape[1], np.float64)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        g = (both @ w.astype(np.float32)).astype(np.float64)
        as_negative = softplus(g)
        negative_risk = as_negative[n_p:].mean() - prior * as_negative[:n_p].mean()
        slope = sigmoid(g)
        pull = np.zeros_like(g)
        if negative_risk >= 0:
            pull[:n_p] = prior * (slope[:n_p] - 1) / n_p - prior * slope[:n_p] / n_p
            pull[n_p:] = slope[n_p:] / n_u
        else:
            pull[:n_p] = prior * slope[:n_p] / n_p
            pull[n_p:] = -slope[n_p:] / n_u
        gradient = both.T @ pull.astype(np.float32) + DECAY * np.append(w[:-1], 0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def presence(docs: list[set[str]], names: list[str]) -> np.ndarray:
    at = {f: i for i, f in enumerate(names)}
    out = np.zeros((len(docs), len(names)), np.float32)
    for row, words in enumerate(docs):
        out[row, [at[f] for w in words for f in features_of_word(w) if f in at]] = 1
    return out


def train_member(sample: pd.DataFrame, prior: float) -> Classifier:
    """One classifier from ``(text, positive)`` rows."""
    chosen = sample["positive"].to_numpy(bool)
    words = [words_of(t) for t in sample["text"]]
    positive = [w for w, p in zip(words, chosen, strict=True) if p]
    unlabelled = [w for w, p in zip(words, chosen, strict=True) if not p]
    if not positive or not unlabelled:
        return Classifier({}, float(np.log(prior / (1 - prior))))
    names = surprising(positive, unlabelled, prior)
    weights, bias = fit_nnpu(presence(positive, names), presence(unlabelled, names), prior)
    return Classifier(dict(zip(names, weights.tolist(), strict=True)), bias)


def average(models: list[Classifier]) -> Classifier:
    total: Counter = Counter()
    for model in models:
        total.update(model.weights)
    return Classifier({f: w / len(models) for f, w in total.items()}, sum(m.bias for m in models) / len(models))


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The mean of ``MEMBERS`` classifiers, each trained in a task of its own.

    ``labels`` are ``(doc_id, toxic)``; the confirmed toxic ones are the
    positive examples and the share of them estimates the class prior.
    ``docs`` gives their text and, whatever their labels, the unlabelled text.
    """
    known = label_rows(labels, "toxic")
    prior = known.agg(F.avg("label")).first()[0]
    if not prior:
        return Classifier({}, -np.inf)
    prior = float(np.clip(prior, 1e-4, 0.5))
    positive = lowest_hashes(known.where("label = 1").select("doc_id"), MOST_POSITIVE, "toxic").withColumn("positive", F.lit(True))
    unlabelled = lowest_hashes(docs.select("doc_id"), MOST_UNLABELLED, "unlabelled").withColumn("positive", F.lit(False))
    rows = with_columns_of(docs, positive.unionByName(unlabelled), ["text"])
    share = F.pmod(F.xxhash64("doc_id", F.lit("member")), F.lit(MEMBERS))
    every = F.sequence(F.lit(0).cast("long"), F.lit(MEMBERS - 1).cast("long"))
    member = F.explode(F.when(F.col("positive"), every).otherwise(F.array(share)))

    def train(sample: pd.DataFrame) -> pd.DataFrame:
        model = train_member(sample, prior)
        return pd.DataFrame({"names": [list(model.weights)], "weights": [list(model.weights.values())], "bias": [model.bias]})

    trained = rows.select(member.alias("member"), "text", "positive").groupBy("member")
    found = trained.applyInPandas(train, "names array<string>, weights array<double>, bias double").collect()
    models = [Classifier(dict(zip(r["names"], r["weights"], strict=True)), r["bias"]) for r in found]
    return average(models) if models else Classifier({}, -np.inf)


class Scorer:
    """Scores of texts; remembers which words have a feature of the model."""

    def __init__(self, model: Classifier) -> None:
        self.model = model
        self.plain: set[str] = set()
        self.telling: dict[str, list[str]] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.plain) > REMEMBERED:
            self.plain.clear()
        for word in words:
            if found := [f for f in features_of_word(word) if f in self.model.weights]:
                self.telling[word] = found
            else:
                self.plain.add(word)

    def score(self, text: str | None) -> float:
        rest = words_of(text) - self.plain
        self.learn({w for w in rest if w not in self.telling})
        present = {f for w in rest for f in self.telling.get(w, ())}
        return float(sigmoid(self.model.bias + sum(self.model.weights[f] for f in sorted(present))))


def toxic_score(text: Column, model: Classifier) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return score(text)


def held_out() -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Only the text is scored, whole; null or empty text has no features and
    gets the score that the bias alone gives. Labels of held-out ids, null
    labels and null ids are not learnt from; without a toxic label all scores
    are 0. Repeated rows give repeated rows, an empty table none; other
    columns are not read.
    """
    bound_batches(docs.sparkSession)
    model = fit_toxicity(docs.where(~held_out()), labels.where(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), toxic_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
