"""Toxicity: cumulative-link ordinal regression on hashed words, which gives an expected severity.

A text's features are its distinct words, hashed to PLACES places. All thresholds share one weight for each
place: P(grade > j) = 1 / (1 + exp(cut_j - w.x)), with rising cuts. The expected severity is the sum of
these over j: a number between 0 and the highest grade. The model is fitted to all rows of a bounded
sample at a time, by gradient steps of adapting size with a penalty on the weights.

Texts come with grades 0, 1, ... for a fit. labelled_grades() makes three of a yes/no label: 0 for
no; of the others, 2 with more tell-tale words than their median text and else 1. A word is tell-tale by
a first fit to the label alone.

Inputs: null texts and texts without words have no features, and so the severity of the cuts alone.
Rows without a grade aren't learnt from; with nothing to learn from, the severity is 0. A text of any
length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilscan.llm import kernels as K
from veilscan.llm.store import text_or_empty

#: Labelled texts learnt from at most (about: rows are picked by a hash).
SAMPLE = 20_000
PLACES = 1 << 18


class Ordinal(NamedTuple):
    """A fitted model."""

    weights: np.ndarray
    cuts: np.ndarray

    def chances(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) of each row."""
        return np.where(np.isinf(self.cuts), 0.0, 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -40, 40))))


def features(texts: pa.Array) -> list[np.ndarray]:
    """Places of the distinct words of each text; ASCII marks part words."""
    return [np.unique(words % K.U(PLACES)).astype(np.int64) for words in K.words_of(texts, marks=True)]


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 300, least: float = 0.05, most: float = 100.0) -> Ordinal:
    """Fit by gradient steps (Adam) on the mean log loss of the grades.

    Each place of the rows has a weight. Its penalty falls from most to least with the standard
    errors z between the share of grades over 0 in the rows that hold it and in all rows, as exp(-z^2 / 2):
    the less likely a place is to tell that much by chance, the freer its weight. The more places
    there are, the larger the z that it takes.
    """
    top = int(grades.max()) if len(grades) else 0
    if top == 0:
        return Ordinal(np.zeros(PLACES, np.float32), np.full(1, np.inf))
    owner, places = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.concatenate(rows)
    counts = np.bincount(places, minlength=PLACES)
    used = np.flatnonzero(counts)
    spot = (np.cumsum(counts > 0) - 1)[places]
    counts = counts[used]
    shares = np.array([(grades > j).mean() for j in range(top)]).clip(1e-6, 1 - 1e-6)
    more = np.bincount(spot, (grades > 0)[owner].astype(float), len(used)) - counts * shares[0]
    square_z = more**2 / (shares[0] * (1 - shares[0]) * counts)
    penalty = np.minimum(least + len(used) / 30 * np.exp(-square_z / 2), most) / len(rows)
    cuts = np.log((1 - shares) / shares)
    theta = np.concatenate([np.zeros(len(used)), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    mean, square, n = np.zeros_like(theta), np.zeros_like(theta), len(rows)
    for step in range(1, steps + 1):
        w, cuts = theta[: len(used)], theta[len(used)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(used) + 1 :]))])
        score = np.bincount(owner, w[spot], n)
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))  # of each cut
        edges = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        slope = edges * (1 - edges)
        k = np.arange(n)
        chance = np.maximum(edges[k, grades] - edges[k, grades + 1], 1e-9)
        by_score = -(slope[k, grades] - slope[k, grades + 1]) / chance / n
        by_cut = np.zeros(top)
        for j in range(top):  # a cut is the lower edge of grade j + 1 and the upper one of grade j
            by_cut[j] = (slope[grades == j + 1, j + 1] / chance[grades == j + 1]).sum() / n - (slope[grades == j, j + 1] / chance[grades == j]).sum() / n
        rest = np.cumsum(by_cut[::-1])[::-1]  # a cut moves all those above it
        grad = np.concatenate([np.bincount(spot, by_score[owner], len(used)) + penalty * w, rest[:1], rest[1:] * np.exp(theta[len(used) + 1 :])])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta = theta - 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(PLACES, np.float32)
    weights[used] = theta[: len(used)]
    return Ordinal(weights, theta[len(used)] + np.concatenate([[0], np.cumsum(np.exp(theta[len(used) + 1 :]))]))


def sample_features(labelled: DataFrame, text_col: str, label_col: str, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of about sample rows at most, gathered."""
    rows = labelled.select(text_or_empty(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).filter("label is not null")
    total = rows.select("label").count()
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < int(sample / total * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [x.astype(np.int32).tobytes() for x in features(batch["text"])]
            yield pa.record_batch({"places": pa.array(places, pa.binary()), "label": batch["label"]})

    found = list(rows.mapInArrow(run, "places binary, label int").toLocalIterator())
    return [np.frombuffer(x.places, np.int32).astype(np.int64) for x in found], np.array([x.label for x in found], np.int64)


def labelled_grades(rows: list[np.ndarray], toxic: np.ndarray, share: float = 0.25) -> np.ndarray:
    """Grades of texts with a yes/no label. Tell-tale words: weights of a share of the largest one at least."""
    weights = fit(rows, toxic).weights
    tell = weights >= max(share * weights.max(), 1e-3)
    found = np.array([int(tell[x].sum()) for x in rows])
    middle = np.median(found[toxic > 0]) if (toxic > 0).any() else 0
    return np.where(toxic > 0, np.where(found > middle, 2, 1), 0).astype(np.int64)


def learn(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    """A model of three grades from rows with a yes/no label."""
    rows, toxic = sample_features(labelled, text_col, label_col, sample)
    return fit(rows, labelled_grades(rows, (toxic > 0).astype(np.int64)))


def severity(docs: DataFrame, model: Ordinal, text_col: str = "text", out_col: str = "severity", grade_col: str = "grade") -> DataFrame:
    """All rows and columns, and the expected severity and the median grade, the number of cuts with a chance of 0.5 at least."""
    if {out_col, grade_col} & set(docs.columns):
        raise ValueError(f"there is a column {out_col} or {grade_col} already")
    position = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ordinal(*sent.value)
        for batch in (part for whole in batches for part in K.slices(whole, position)):
            scores = np.array([float(model.weights[x].sum()) for x in features(batch.column(position))])
            above = model.chances(scores)
            more = [pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, out_col, grade_col])

    fields = [T.StructField(out_col, T.DoubleType()), T.StructField(grade_col, T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
