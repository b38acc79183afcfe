"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed to FEATURES places, or to so many fewer that there
are no more than WEIGHTS for all languages together. The document frequencies
behind the IDF come from all training documents. The weights are learnt by
follow-the-regularised-leader with an L1 and an L2 penalty, on a sample of bounded size, and
a part of the sample that the weights never saw sets the temperature of the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = 1 << 14
#: Training documents of each language that the weights are fitted on, in expectation.
PER_LANGUAGE = 600
#: Weights of a model, at most: 4,096 languages have all FEATURES each, and more have fewer.
WEIGHTS = 1 << 26
#: Rows of the table of languages that is broadcast; a longer one is joined by its key.
BROADCAST = 10_000
UNKNOWN = "und"
#: Of the follow-the-regularised-leader steps: rate, smoothing, L1 and L2 penalties, epochs.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.01, 3


def places_for(languages: int) -> int:
    """A power of two of places, whose weights for all languages are within WEIGHTS."""
    return min(FEATURES, 1 << max(4, (WEIGHTS // max(1, languages)).bit_length() - 1))


def grams(text: str, places: int) -> np.ndarray:
    """The hashed places of all n-grams of a text, one for each time one occurs."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = (c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (one[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
    three = (two[:-1] ^ (one[2:] >> np.uint64(11))) * np.uint64(0x165667B19E3779F9)
    return (np.concatenate((one, two, three)) >> np.uint64(64 - places.bit_length() + 1)).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): log-scaled counts times IDF, of length one."""
    counts = np.bincount(grams(text, len(idf)), minlength=len(idf))
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at]) * idf[at]
    return at, value / max(float(np.sqrt(value @ value)), 1e-12)


def document_frequencies(docs: DataFrame, places: int) -> np.ndarray:
    """[number of documents, then the documents that hold each place] over all rows of doc_id
    and text: each task sums its own, and Spark sums the tasks' by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(places, np.int64), 0
        for _, texts in common.chunks(batches):
            for text in texts:
                seen = np.zeros(places, bool)
                seen[grams(text, places)] = True
                total += seen
                n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((at, [places]))), pa.array(np.concatenate((total[at], [n])))], ["place", "n"]
        )

    rows = docs.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(places + 1, np.int64)
    out[rows["place"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return np.roll(out, 1)


class Leader:
    """Follow-the-regularised-leader for softmax regression with elastic-net penalties."""

    def __init__(self, places: int, classes: int):
        self.bias = places  # the last row
        self.z = np.zeros((places + 1, classes))
        self.n = np.zeros((places + 1, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        scale = (BETA + np.sqrt(self.n[at])) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0, -(z - np.sign(z) * L1) / scale)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, self.bias), np.append(value, 1.0)
        w = self.weights(at)
        p = softmax(value @ w)
        p[label] -= 1
        g = value[:, None] * p[None, :]
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The scale of the logits that makes held-back labels most likely."""
    best, low, high = 1.0, -4.0, 4.0
    for _ in range(3):
        tries = np.linspace(low, high, 33)
        loss = [-np.log(np.maximum(softmax(logits * np.exp(t))[np.arange(len(labels)), labels], 1e-12)).sum() for t in tries]
        best = tries[int(np.argmin(loss))]
        low, high = best - (high - low) / 16, best + (high - low) / 16
    return float(np.exp(best))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """A model from rows of doc_id, text and lang; rows whose lang is null teach nothing."""
    rows = docs.where("lang is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = common.stored(rows.groupBy("lang").agg(F.count("*").alias("n")))
    languages = counts.count()
    places = places_for(languages)
    frequencies = document_frequencies(rows.select("doc_id", "text"), places)
    n = int(frequencies[0])
    if not n:
        return {"languages": []}
    idf = np.log((1 + n) / (1 + frequencies[1:])) + 1
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # FEATURES numbers at most
    unit = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(counts) if languages <= BROADCAST else counts, "lang").where(unit < F.lit(float(per_language)) / F.col("n"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, langs in common.chunks(batches):
            made = [features(t, shared.value) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(langs, pa.string()),
                    pa.array([m[0] for m in made], pa.list_(pa.int64())),
                    pa.array([m[1] for m in made], pa.list_(pa.float64())),
                ],
                ["doc_id", "lang", "at", "value"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, langs, at, value = [], [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            langs += batch.column(1).to_pylist()
            at += [np.array(x.values if hasattr(x, "values") else x, np.int64) for x in batch.column(2)]
            value += [np.array(x.values if hasattr(x, "values") else x, float) for x in batch.column(3)]
        if not langs:
            return
        names = sorted(set(langs))
        number = {name: k for k, name in enumerate(names)}
        labels = np.array([number[x] for x in langs])
        scrambled = np.argsort(common.mix64(np.array([i or 0 for i in ids], np.int64).astype(np.uint64)), kind="stable")
        held = scrambled[: len(scrambled) // 5]
        leader = Leader(places, len(names))
        for _ in range(EPOCHS):
            for k in scrambled[len(held) :]:
                leader.learn(at[k], value[k], labels[k])
        w = leader.weights()
        scale = 1.0
        if len(held):
            logits = np.stack([value[k] @ w[at[k]] + w[places] for k in held])
            scale = temperature(logits, labels[held])
        yield pa.RecordBatch.from_arrays(
            [pa.array([names]), pa.array([w.astype("<f4").tobytes()]), pa.array([scale])], ["languages", "weights", "scale"]
        )

    made = chosen.select("doc_id", "text", "lang").mapInArrow(featurise, "doc_id long, lang string, at array<long>, value array<double>")
    model = common.stored(made).coalesce(1).mapInArrow(train, "languages array<string>, weights binary, scale double").first()
    if model is None or not model["languages"]:
        return {"languages": []}
    names = list(model["languages"])
    return {
        "languages": names,
        "idf": idf,
        "weights": np.frombuffer(model["weights"], "<f4").reshape(places + 1, len(names)).astype(float),
        "scale": model["scale"],
    }


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score (its calibrated probability) for every row.

    `und` and 0 where the text is null or has no letter, or where the model learnt no
    language. Rows that repeat a doc_id are predicted each; an empty table gives an empty one.
    """
    names = model["languages"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WEIGHTS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for ids, texts in common.chunks(batches):
            found = []
            for text in texts:
                if not names or not has_letter(text):
                    found.append((UNKNOWN, 0.0))
                    continue
                at, value = features(text, m["idf"])
                p = softmax(m["scale"] * (value @ m["weights"][at] + m["weights"][-1]))
                best = int(np.argmax(p))
                found.append((names[best], float(p[best])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
