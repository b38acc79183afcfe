"""Toxicity as ordinal severity: a cumulative-link model over words and beginnings of words.

P(grade > k) = sigmoid(w . x - t_k): one weight for each feature, shared by all grades, and
ordered thresholds t_0 < t_1 < ... The features x say which words a text holds, and which
beginnings of words, out of all that LEAST_DOCS labelled texts hold; none is left out for being
weak. A feature's value is how far its toxic texts are from the number expected, in units of
STEP standard deviations, so that the ridge holds back features that tell little. Features go by
64 bits of hash.

The label itself is yes or no. A toxic row's grade is learnt on rows that it is not among: each
half of the labelled texts is scored by a model of the other half, and the half's toxic texts
are parted by their scores into mild, plain and severe. The result is the expected grade, and a
document is rejected where P(grade > 0) is at least one half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled documents that the model is fitted on, at most; they are chosen by a hash of the id.
SAMPLE = 10_000
#: The least number of labelled documents of a feature, and the unit of a feature's value.
LEAST_DOCS, STEP = 4, 10.0
#: Bytes of the beginnings of words.
BEGINNINGS = (4, 7)
GRADES = 4
#: Steps of a fit, and of the fits that grade.
ROUNDS, GRADING = 200, 80
REJECT_AT = 0.5
#: Text handled at once, in bytes; a longer document is taken alone.
CHUNK = 1 << 20

#: What parts words: ASCII but for letters and digits.
_GAP = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the features of a column of texts, repeats included."""
    scan = common.Scan(column, BEGINNINGS, _GAP)
    row = np.repeat(np.arange(len(column)), scan.per_row())
    return np.concatenate([row, *[row[at] for at, _ in scan.begun]]), np.concatenate([scan.hashes, *[h for _, h in scan.begun]])


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """print, toxic (0/1), features: of up to `sample` labelled documents; equal texts with one
    label once. A document is toxic if one of its labels says so."""
    known = labels.where("doc_id is not null and toxic is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic")
    )
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches, CHUNK):
            row, found = features(part.column(1))
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(row[new], minlength=part.num_rows)))).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[new].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), held], ["print", "toxic", "features"])

    rows = common.documents(docs).join(F.broadcast(known), "doc_id")  # `sample` rows at most
    return rows.select("doc_id", "text", "print", "toxic").mapInArrow(run, "print long, toxic int, features array<long>").dropDuplicates(["print", "toxic"])


def evidence(docs: np.ndarray, toxic: np.ndarray, rate: float) -> np.ndarray:
    """How far `toxic` of a feature's `docs` texts are from the `rate` of all texts."""
    return np.abs(toxic - docs * rate) / np.sqrt(np.maximum(docs * rate * (1 - rate), 1e-12)) / STEP


class _Sparse:
    """A matrix by its entries, for products with vectors."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    def __matmul__(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * vector[self.column], self.shape[0])

    @property
    def T(self) -> _Sparse:
        return _Sparse(self.column, self.row, self.value, self.shape[::-1])


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, rounds: int = ROUNDS, ridge: float = 1e-4):
    """(weights, thresholds) of the cumulative-link model by gradient steps on the likelihood.
    The thresholds are a first one and positive gaps, so that they stay in order."""
    n, m = x.shape
    cuts = grades - 1
    above = np.array([(grade > k).mean() for k in range(cuts)]).clip(1e-4, 1 - 1e-4)
    first = -np.log(above / (1 - above))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    at = np.concatenate((np.zeros(m), first[:1], gaps))
    speed, mean, square = 0.1, np.zeros_like(at), np.zeros_like(at)
    for step in range(1, rounds + 1):
        w, t = at[:m], np.cumsum(np.concatenate((at[m : m + 1], np.exp(at[m + 1 :]))))
        s = x @ w
        edge = np.concatenate(([-np.inf], t, [np.inf]))
        hi, lo = _sigmoid(edge[grade + 1] - s), _sigmoid(edge[grade] - s)
        p = np.maximum(hi - lo, 1e-9)
        up, down = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_t = np.array([np.where(grade == k, -up, 0).sum() + np.where(grade == k + 1, down, 0).sum() for k in range(cuts)]) / n
        slope = np.cumsum(g_t[::-1])[::-1]
        grad = np.concatenate((x.T @ (up - down) / n + ridge * w, slope[:1], slope[1:] * np.exp(at[m + 1 :])))
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        at = at - speed * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return at[:m], np.cumsum(np.concatenate((at[m : m + 1], np.exp(at[m + 1 :]))))


def _fitted(row: np.ndarray, column: np.ndarray, toxic: np.ndarray, grade: np.ndarray, grades: int, width: int, rounds: int):
    """(weight of each feature, thresholds) from the rows of `toxic` and `grade`."""
    docs_of, toxic_of = np.bincount(column, minlength=width), np.bincount(column, toxic[row], width)
    value = evidence(docs_of, toxic_of, toxic.mean())
    w, t = fit_ordinal(_Sparse(row, column, value[column], (len(toxic), width)), grade, grades, rounds)
    return w * value, t


def graded(row: np.ndarray, column: np.ndarray, toxic: np.ndarray, width: int) -> np.ndarray:
    """0 for a row that is not toxic; of a half's toxic rows 1, 2 or 3 by the thirds of the scores
    that a model of the other half gives them."""
    half, grade = np.arange(len(toxic)) % 2, np.zeros(len(toxic), np.int64)
    place = np.cumsum(half) * half + np.cumsum(1 - half) * (1 - half) - 1  # of a row in its half
    for k in (0, 1):
        mine, other = np.flatnonzero(half == k), np.flatnonzero(half != k)
        score = np.zeros(len(mine))
        if 0 < toxic[other].sum() < len(other):
            there = half[row] != k
            w, _ = _fitted(place[row[there]], column[there], toxic[other], toxic[other], 2, width, GRADING)
            score = np.bincount(place[row[~there]], w[column[~there]], len(mine))
        bad = np.flatnonzero(toxic[mine])
        rank = np.argsort(np.argsort(score[bad], kind="stable"), kind="stable")
        grade[mine[bad]] = 1 + rank * (GRADES - 1) // max(1, len(bad))
    return grade


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """{"hashes": sorted features, "weights": theirs, "thresholds": [...]}, fitted in one task on
    the bounded sample. Unless some labelled texts are toxic and some are not there is no model,
    and no document is graded above 0."""
    rows = common.stored(labelled(docs, labels, sample))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, toxic, sizes, held = [], [], [], []
        for batch in batches:
            prints.append(batch.column(0).to_numpy())
            toxic.append(batch.column(1).to_numpy())
            sizes.append(pc.list_value_length(batch.column(2)).to_numpy())
            held.append(pc.list_flatten(batch.column(2)).to_numpy().view(np.uint64))
        if not prints:
            return
        prints, toxic, sizes = np.concatenate(prints), np.concatenate(toxic), np.concatenate(sizes).astype(np.int64)
        order = np.lexsort((-toxic, prints))
        kept = order[np.concatenate(([True], prints[order][1:] != prints[order][:-1]))]  # of equal texts the toxic one
        number = np.full(len(prints), -1)
        number[kept] = np.arange(len(kept))
        row, toxic = np.repeat(number, sizes), toxic[kept]
        if not 0 < toxic.sum() < len(toxic):
            return
        found = np.concatenate(held)
        del held
        hashes, count = np.unique(found, return_counts=True)
        hashes = hashes[count >= LEAST_DOCS]
        if not len(hashes):
            return
        column = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        keep = (row >= 0) & (hashes[column] == found)
        row, column = row[keep], column[keep]
        del found, keep
        grade = graded(row, column, toxic, len(hashes))
        w, t = _fitted(row, column, toxic, grade, GRADES, len(hashes), ROUNDS)
        yield pa.RecordBatch.from_arrays([pa.array([hashes.tobytes()]), pa.array([w.tobytes()]), pa.array([t.tolist()])], ["h", "w", "t"])

    model = rows.coalesce(1).mapInArrow(train, "h binary, w binary, t array<double>").first()
    if model is None:
        return {"hashes": np.empty(0, np.uint64), "weights": np.empty(0), "thresholds": [30.0 + k for k in range(GRADES - 1)]}
    return {"hashes": np.frombuffer(model["h"], np.uint64), "weights": np.frombuffer(model["w"], float), "thresholds": list(model["t"])}


def grade(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, severity (expected grade), p_toxic, grade (most likely),
    rejected. A null or empty text holds no feature. Rows that repeat a doc_id or have none are
    graded like any other; an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast((model["hashes"], model["weights"]))  # of a bounded sample
    thresholds = np.array(model["thresholds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = shared.value
        for part in common.slices(batches, CHUNK):
            s = np.zeros(part.num_rows)
            if len(hashes):
                row, found = features(part.column(1))
                at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                held = hashes[at] == found
                each = np.unique(row[held] * len(hashes) + at[held])
                s = np.bincount(each // len(hashes), weights[each % len(hashes)], part.num_rows)
            over = _sigmoid(s[:, None] - thresholds[None, :])
            each = np.diff(np.concatenate((np.ones((len(s), 1)), over, np.zeros((len(s), 1))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(over.sum(axis=1)),
                    pa.array(over[:, 0]),
                    pa.array((-each).argmax(axis=1).astype(np.int32)),
                    pa.array(over[:, 0] >= REJECT_AT),
                ],
                ["doc_id", "severity", "p_toxic", "grade", "rejected"],
            )

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, rejected boolean")


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the model does not reject, with their own columns; rows without
    doc_id stay. Rows that repeat a doc_id go together if one of them is rejected."""
    found = grade(docs, fit(docs, labels)).where("rejected and doc_id is not null").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
