"""Quality by co-training a view of the text and a view of the metadata."""

from __future__ import annotations

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

# Bounds of the samples that the views are fitted on.
MOST_LABELLED = 6_000
MOST_UNLABELLED = 12_000

ROUNDS = 5
CONFIDENT = 0.95
PER_ROUND = 600
BINS = 12
STEPS, RATE, DECAY = 250, 0.1, 1e-3
SOURCES = 64


def byte_classes() -> np.ndarray:
    """Class of each byte of UTF-8: letters by case, digits, spaces, kinds of signs."""
    out = np.full(256, 9)
    groups = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n", ".,;:", "|", "!?", "#$%&*@^_~"]
    for k, group in enumerate(groups):
        out[list(group.encode())] = k
    out[128:] = 10
    return out


CLASS_OF_BYTE = byte_classes()
N_CONTENT = 11 + 5


def content_numbers(text: str | None) -> np.ndarray:
    """What the text is made of: shares of byte classes, and its words' length and repetition."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    by_byte = np.bincount(raw, minlength=256)
    shares = np.bincount(CLASS_OF_BYTE, weights=by_byte, minlength=11) / max(1, len(raw))
    words = text.split()
    counts = Counter(words)
    n = max(1, len(words))
    lines = text.split("\n")
    own = [
        np.log1p(len(words)),
        len(raw) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        len(set(lines)) / len(lines),
    ]
    return np.concatenate([shares, own])


def metadata_numbers(source: str | None, lang: str | None, n_chars: float | None) -> list[int]:
    """Categories of the row's metadata: source and language by hash, size by power of two."""
    size = 0 if n_chars is None or n_chars != n_chars or n_chars < 1 else min(40, int(np.log2(n_chars)) + 1)
    return [
        zlib.crc32((source or "").encode()) % SOURCES,
        SOURCES + zlib.crc32((lang or "").encode()) % SOURCES,
        2 * SOURCES + size,
    ]


N_METADATA = 2 * SOURCES + 41


def one_hot(numbers: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Each number as the bin it falls in, bins laid end to end."""
    out = np.zeros((len(numbers), edges.shape[0] * (BINS + 1)), np.float32)
    for k, cuts in enumerate(edges):
        bins = np.searchsorted(cuts, numbers[:, k], side="right")
        out[np.arange(len(numbers)), k * (BINS + 1) + bins] = 1
    return out


def metadata_matrix(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), N_METADATA), np.float32)
    for i, at in enumerate(rows):
        out[i, at] = 1
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, bias last, of a regularised logistic regression."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w, first, second = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, STEPS + 1):
        p = 0.5 * (1 + np.tanh(x @ w / 2))
        gradient = x.T @ (p - y) / len(y) + DECAY * np.append(w[:-1], 0)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def probability(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


@dataclass(frozen=True)
class CoTrained:
    """Both views with their calibration (slope, offset), and how they are combined."""

    edges: np.ndarray
    content: np.ndarray
    metadata: np.ndarray
    calibration: np.ndarray
    prior: float

    def score(self, numbers: np.ndarray, rows: list[list[int]]) -> np.ndarray:
        """Calibrated log odds of the views added, the prior's counted once."""
        views = (logits(one_hot(numbers, self.edges), self.content), logits(metadata_matrix(rows), self.metadata))
        base = np.log(self.prior / (1 - self.prior))
        total = sum(a * z + b - base for z, (a, b) in zip(views, self.calibration, strict=True)) + base
        return probability(total)


def confident(p: np.ndarray, free: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows to hand over with their pseudo-labels: the surest of each class, in the classes' proportion."""
    rows, labels = [], []
    for label, sure, part in ((1, p, share), (0, 1 - p, 1 - share)):
        able = np.flatnonzero(free & (sure >= CONFIDENT))
        take = able[np.argsort(-sure[able], kind="stable")][: max(1, round(PER_ROUND * part))]
        rows.append(take)
        labels.append(np.full(len(take), label))
    return np.concatenate(rows), np.concatenate(labels)


def co_train(content: np.ndarray, metadata: list[list[int]], label: np.ndarray) -> CoTrained | None:
    """Fit both views; ``label`` is 0, 1 or -1 for an unlabelled row.

    A fifth of the labelled rows is set aside for calibration. In each round
    each view hands the rows it is surest of to the other view's training set.
    """
    known = np.flatnonzero(label >= 0)
    if len(np.unique(label[known])) < 2:
        return None
    aside, own = known[::5], np.setdiff1d(known, known[::5])
    if len(np.unique(label[own])) < 2 or len(np.unique(label[aside])) < 2:
        aside = own = known
    cuts = np.linspace(0, 1, BINS + 2)[1:-1]
    edges = np.quantile(content, cuts, axis=0).T
    views = [one_hot(content, edges), metadata_matrix(metadata)]
    share = float(label[own].mean())
    taught = [(own, label[own]), (own, label[own])]
    free = [label < 0, label < 0]
    for _ in range(ROUNDS):
        fitted = [fit_logistic(x[rows], y) for x, (rows, y) in zip(views, taught, strict=True)]
        for teacher, pupil in ((0, 1), (1, 0)):
            p = probability(logits(views[teacher], fitted[teacher]))
            rows, labels = confident(p, free[pupil], share)
            free[pupil][rows] = False
            taught[pupil] = (np.append(taught[pupil][0], rows), np.append(taught[pupil][1], labels))
    fitted = [fit_logistic(x[rows], y) for x, (rows, y) in zip(views, taught, strict=True)]
    calibration = [
        fit_logistic(logits(x[aside], w)[:, None].astype(np.float32), label[aside]) for x, w in zip(views, fitted, strict=True)
    ]
    return CoTrained(edges, fitted[0], fitted[1], np.array(calibration), float(np.clip(label[known].mean(), 1e-3, 1 - 1e-3)))


SCORED = ["text", "source", "lang", "n_chars"]


def numbers_of(rows: list[tuple]) -> tuple[np.ndarray, list[list[int]]]:
    content = np.array([content_numbers(r[0]) for r in rows]).reshape(-1, N_CONTENT)
    return content, [metadata_numbers(r[1], r[2], r[3]) for r in rows]


def fit_quality(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """Both views from ``labels`` ``(doc_id, quality)`` and unlabelled rows of ``docs``."""
    known = label_rows(labels, "quality")
    labelled = lowest_hashes(known, MOST_LABELLED, "labelled")
    pool = docs.select("doc_id").join(known, "doc_id", "left_anti")
    unlabelled = lowest_hashes(pool, MOST_UNLABELLED, "pool").withColumn("label", F.lit(-1))
    rows = with_columns_of(docs, labelled.unionByName(unlabelled), SCORED)

    @F.pandas_udf("struct<content:array<double>,metadata:array<int>>")
    def measure(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            content, metadata = numbers_of(list(zip(*columns, strict=True)))
            yield pd.DataFrame({"content": list(content), "metadata": metadata})

    sample = rows.select("doc_id", "label", measure(*SCORED).alias("m")).select("doc_id", "label", "m.*").collect()
    sample.sort(key=lambda r: (r["doc_id"], r["label"]))
    if not sample:
        return None
    label = np.array([r["label"] for r in sample])
    return co_train(np.array([r["content"] for r in sample]), [r["metadata"] for r in sample], label)


def quality_score(model: CoTrained | None) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            rows = list(zip(*columns, strict=True))
            yield pd.Series(model.score(*numbers_of(rows)) if model and rows else np.full(len(rows), 0.5))

    return score(*SCORED)


def held_out() -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    ``score`` estimates the chance that the quality label is 1. The content
    view reads the whole text, the metadata view source, lang and n_chars;
    nulls count as empty text, empty names and no size. Labels of held-out
    ids are not learnt from; unless both labels occur, all scores are 0.5.
    Repeated rows give repeated rows, an empty table none; further columns
    are not read.
    """
    bound_batches(docs.sparkSession)
    model = fit_quality(docs.where(~held_out()), labels.where(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
