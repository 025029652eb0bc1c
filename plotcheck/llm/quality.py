"""Quality classifier: a linear support vector machine over n-gram indicators scaled by naive Bayes ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotcheck.llm.common import held_out, mix, slices, texts

#: Buckets of byte n-grams, and their lengths.
GRAMS, LENGTHS = 1 << 18, (1, 2, 3, 4)
#: Further indicators: classes of word bigrams that repeat their word, and of distinct words, each by length.
_REPEATS, _DISTINCT, _SIZES = 6, 11, 16
BUCKETS = GRAMS + _SIZES * (_REPEATS + _DISTINCT)
#: Labelled texts of each class that are learnt from at most: those with the least hash of their id.
SAMPLE = 4000
#: Passes of dual coordinate descent, and its bound on a text's weight.
EPOCHS, BOUND = 12, 1.0
#: Smoothing of the class counts.
SMOOTH = 1.0

_SLOTS = np.zeros(GRAMS, np.int32)


def _word_classes(text: bytes) -> list[int]:
    """How often a word follows itself, and how many words are distinct, each with the text's length class."""
    words = text.split()
    n = len(words)
    if not n:
        return []
    size = min(n.bit_length(), _SIZES - 1)
    twice = sum(map(bytes.__eq__, words, words[1:]))
    often = sum(100 * twice > limit * n for limit in (0, 1, 5, 20, 50))
    distinct = (_DISTINCT - 1) * len(set(words)) // n
    return [GRAMS + size * _REPEATS + often, GRAMS + _SIZES * _REPEATS + size * _DISTINCT + distinct]


def indicators(text: bytes) -> np.ndarray:
    """Buckets of the n-grams that occur in ``text``, each once, and its word classes."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    found, code = [], np.zeros(len(data), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
        if n in LENGTHS:
            found.append((mix(code + (np.uint64(n) << np.uint64(56))) >> np.uint64(64 - 18)).astype(np.int32))
    if not found:
        return np.zeros(0, np.int32)
    at = np.concatenate(found)
    order = np.arange(len(at), dtype=np.int32)
    _SLOTS[at] = order
    return np.r_[np.sort(at[_SLOTS[at] == order]), np.array(_word_classes(text), np.int32)]


@dataclass
class Model:
    """margin = weight * ratio over the indicators, scaled to unit length, + bias; score = logistic(slope * margin + shift)."""

    scaled: np.ndarray  # weight * ratio
    square: np.ndarray  # ratio ** 2
    bias: float
    slope: float
    shift: float

    def margin(self, at: np.ndarray) -> float:
        length = float(np.sqrt(self.square[at].sum()))
        return (float(self.scaled[at].sum()) / length if length else 0.0) + self.bias

    def score(self, text: bytes) -> float:
        x = self.slope * self.margin(indicators(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratio of each bucket between the classes."""
    counts = [np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)]
    for at, c in zip(rows, y > 0):  # noqa: B905
        counts[int(c)][at] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """(weight, bias) of the hinge-loss machine with unit-length scaled indicators, by dual coordinate descent."""
    weight, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    # Scaled indicators are formed anew for each step: held, they would take twice the memory of the sample.
    length = [float(np.sqrt((ratio[at] ** 2).sum())) or 1.0 for at in rows]
    square = [float(((ratio[at] / n) ** 2).sum()) + 1.0 for at, n in zip(rows, length)]  # noqa: B905
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            u = ratio[at] / length[i]
            gradient = y[i] * (weight[at] @ u + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), BOUND)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weight[at] += step * u
                bias += step
                alpha[i] = new
    return weight, bias


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    """The model of labelled indicators; its scores are calibrated on each fifth row, left out once, to the share ``prior`` of label 1."""
    y = np.where(labels > 0, 1.0, -1.0)
    if not len(rows) or (y > 0).all() or (y < 0).all():
        share = prior if len(rows) else 0.5
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))

    def trained(part: np.ndarray, epochs: int) -> Model:
        some = [rows[i] for i in part]
        ratio = ratios(some, y[part])
        weight, bias = descend(some, y[part], ratio, epochs)
        return Model(weight * ratio, ratio**2, bias, 1.0, 0.0)

    every = np.arange(len(rows))
    slope, shift = 2.0, 0.0
    test = every[every % 5 == 4]
    if (y[test] > 0).any() and (y[test] < 0).any():
        left_out = trained(every[every % 5 != 4], 4)
        m = np.array([left_out.margin(rows[i]) for i in test])
        # Platt's targets; a few Newton steps on the two-parameter logistic loss.
        pos, neg = (y[test] > 0).sum(), (y[test] < 0).sum()
        t = np.where(y[test] > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -40, 40)))
            v = p * (1 - p) + 1e-9
            h = np.array([[(v * m * m).sum() + 1e-6, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
            step = np.linalg.solve(h, [((p - t) * m).sum(), (p - t).sum()])
            slope, shift = slope - float(np.clip(step[0], -2, 2)), shift - float(np.clip(step[1], -2, 2))
            if abs(step).max() < 1e-6:
                break
    model = trained(every, EPOCHS)
    share = float((y > 0).mean())
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    model.slope, model.shift = slope, shift + float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return model


_STATE: dict[str, np.ndarray] = {}


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled texts of each class, none of them held out.

    The chosen ids (of a fixed number) are broadcast, so no text is shuffled but the sample's. Labels other than 0 and 1,
    and rows with a null id, are not used; should an id have both labels, 0 counts. Of rows that repeat an id one is learnt from. No label at all gives scores of 0.5.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    first = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at = pa.array([indicators(t) for t in texts(batch.column("text"))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), at], names=["doc_id", "y", "at"])

    prior = counts.get(1, 0) / max(sum(counts.values()), 1)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, at = [], [], []
        for batch in batches:
            ids.append(batch.column("doc_id").to_numpy())
            y.append(batch.column("y").to_numpy())
            col = batch.column("at")
            flat, ends = col.values.to_numpy(), col.offsets.to_numpy()
            at += [flat[a:b].copy() for a, b in zip(ends, ends[1:])]  # noqa: B905
        if ids:
            size = np.array([len(a) for a in at])
            order = np.lexsort((size, np.concatenate(ids)))  # alike in every run
            model = fit([at[i] for i in order], np.concatenate(y)[order], prior)
        else:
            model = fit([], np.zeros(0), prior)
        packed = [x.astype("<f4").tobytes() for x in (model.scaled, model.square)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*packed, model.bias, model.slope, model.shift)], names=["scaled", "square", "bias", "slope", "shift"])

    # A row for each id: of rows that repeat it, the one whose text has the least hash, however many there are.
    each = rows.mapInArrow(features, "doc_id long, y int, at array<int>").groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("at").alias("hash"), "at")).alias("one"))
    found = each.select("doc_id", "y", "one.at").repartition(1).mapInArrow(solve, "scaled binary, square binary, bias double, slope double, shift double").collect()
    if not found:
        return fit([], np.zeros(0), prior)
    r = found[0]
    return Model(*(np.frombuffer(r[c], "<f4") for c in ("scaled", "square")), r["bias"], r["slope"], r["shift"])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; only its text decides the score, from 0 to 1.

    Null and empty texts have the score of no n-gram. Rows that repeat an id, or have none, keep a row each; equal texts
    have equal scores. An empty table gives no rows; without labels all scores are 0.5, with one class alone all are near
    it. predicted is 1 from ``threshold`` on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scores = [shared.value.score(t) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; nulls and ties as in ``quality_scores``."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    packed = docs.select(F.struct(*docs.columns).alias("row"))  # so that no name can clash
    field = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_text = (pa.RecordBatch.from_arrays([b.column("row"), pc.struct_field(b.column("row"), [field])], names=["row", "text"]) for b in batches)
        for batch in slices(with_text, "text"):
            good = pa.array([shared.value.score(t) >= threshold for t in texts(batch.column("text"))], pa.bool_())
            yield batch.select(["row"]).filter(good)

    return packed.mapInArrow(run, packed.schema).select("row.*")
