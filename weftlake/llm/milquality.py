"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Every passage is described by
style measures that do not depend on a language (word lengths, shares of upper
case, digits and signs, repeated words and pairs, line and sentence ends) and
encoded by a learned layer.  Gated attention weighs the passages, a logistic
unit scores the weighted sum, and all of it is trained on document labels.

Training reads at most ``MAX_DOCS`` labelled documents (those with the smallest
hashed ids, a fixed choice); of one with more than ``MAX_PASSAGES`` passages it
takes that many, evenly spread over the whole text.  Scoring reads whole texts
of any length.

Defined results: null, empty and wordless texts have no passage and score 0;
without any usable label all other scores are 0.5; labels that are null are
ignored and a document with both labels counts as its lower one; repeated rows
have equal scores; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textnum import Words, chunks

WORDS = 64
MAX_DOCS = 2000
MAX_PASSAGES = 512
HIDDEN, ATTENTION = 16, 8
EPOCHS = 150
THRESHOLD = 0.3
FOLDS = 5

_UPPER, _LETTER, _DIGIT, _SIGN, _LINE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_DIGIT[48:58] = True
_SIGN[[b for b in range(33, 127) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = True
_LINE[[10, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_SOFT = np.zeros(256, bool)
_SOFT[list(b".,;:")] = True
FEATURES = 14


def passages(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For groups of texts: passages of each text, and one row of measures per passage."""
    for begin, end in chunks(texts):
        w = Words(texts[begin:end])
        per_doc = -(-w.count // WORDS)
        total = int(per_doc.sum())
        if not total:
            yield per_doc, np.zeros((0, FEATURES))
            continue
        # word k of a text goes to its passage's row
        place = np.arange(len(w.start)) - np.repeat(w.first[:-1], w.count)
        row = np.repeat(np.cumsum(per_doc) - per_doc, w.count) + place // WORDS
        n = np.bincount(row, minlength=total).astype(float)
        upto = {k: np.concatenate([[0], np.cumsum(t[w.raw], dtype=np.int32)]) for k, t in (("upper", _UPPER), ("letter", _LETTER), ("digit", _DIGIT), ("sign", _SIGN), ("line", _LINE))}
        inside = {k: (u[w.end] - u[w.start]).astype(float) for k, u in upto.items()}
        size = (w.end - w.start).astype(float)
        add = lambda x: np.bincount(row, x, total)
        h = w.hashes(lower=False)
        grid = np.zeros((total, WORDS), np.uint64)
        grid[row, place % WORDS] = h
        grid.sort(axis=1)
        distinct = ((grid[:, 1:] != grid[:, :-1]).sum(1) + 1 - (n < WORDS)).astype(float)  # the padding is one value
        follows = np.zeros(len(h), bool)
        follows[1:] = (h[1:] == h[:-1]) & (place[1:] > 0)
        pair = h + np.roll(h, 1) * np.uint64(3)
        grid[:] = 0
        grid[row, place % WORDS] = pair
        grid.sort(axis=1)
        pairs = ((grid[:, 1:] != grid[:, :-1]).sum(1) + 1 - (n < WORDS)).astype(float)
        last, letters, mean = w.raw[w.end - 1], np.maximum(1, add(inside["letter"])), add(size) / n
        gap = upto["line"][np.append(w.start[1:], len(w.raw))] - upto["line"][w.end]
        x = np.stack(
            [
                np.log(n) / np.log(WORDS),
                mean / 10,
                np.sqrt(np.maximum(0, add(size * size) / n - mean * mean)) / 10,
                add(inside["upper"]) / letters,
                add(inside["digit"]) / add(size),
                add(inside["sign"]) / add(size),
                add(inside["sign"] >= 2) / n,
                add(_SIGN[last] & ~_SOFT[last]) / n,
                distinct / n,
                add(follows) / n,
                pairs / n,
                np.minimum(1, add(gap > 0) / n * 4),
                add(_STOP[last]) / n,
                add((inside["letter"] == 0) & (inside["digit"] == 0)) / n,
            ],
            1,
        )
        yield per_doc, x


def _sums(x: np.ndarray, bags: np.ndarray) -> np.ndarray:
    """Sums of rows by bag (of one row at least)."""
    return np.add.reduceat(x, np.cumsum(bags) - bags, axis=0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Encoder tanh(xW + b), attention softmax(u . (tanh(hV) * sigmoid(hU))), score sigmoid(z . c + d)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["u"]
        top = np.maximum.reduceat(e, np.cumsum(bags) - bags)
        a = np.exp(e - np.repeat(top, bags))
        a /= np.repeat(_sums(a, bags), bags)
        z = _sums(a[:, None] * h, bags)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"])}

    def normal(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """Scores of bags; an empty bag scores 0."""
        out, full = np.zeros(len(bags)), bags > 0
        if full.any():
            out[full] = self.forward(self.normal(x), bags[full])["y"]
        return out

    def gradients(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, bags)
        dy = (f["y"] - y) / len(bags)
        dz = np.repeat(dy[:, None] * p["c"], bags, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(_sums(f["a"] * da, bags), bags))
        dt, dg = de[:, None] * p["u"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["u"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
        grad = {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "u": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}
        return {k: v + (ridge * p[k] if k not in "bd" else 0) for k, v in grad.items()}


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """Full-batch Adam from a fixed start."""
    rng = np.random.default_rng(seed)
    shapes = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "u": (ATTENTION,), "c": (HIDDEN,), "d": (1,)}
    p = {k: np.zeros(s) if k in "bd" else rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    model = Model(x.mean(0), x.std(0) + 1e-6, p)
    x = model.normal(x)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for k in range(1, epochs + 1):
        for name, g in model.gradients(x, bags, y).items():
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            p[name] -= 0.03 * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-8)
    return model


def fold(doc_id, folds: int = FOLDS):
    """crc32 of the id as text, modulo folds; fold 0 is held out."""
    return F.crc32(doc_id.cast("string")) % folds


def training_ids(labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, quality of the labelled documents that are trained on."""
    usable = labels.filter("quality is not null and doc_id is not null").filter(fold(F.col("doc_id")) != 0)
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)


def fit(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_passages: int = MAX_PASSAGES) -> Model | None:
    """The model, from at most ``max_docs`` labelled documents; None without any."""
    chosen = materialize(training_ids(labels, max_docs), "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            rows = []
            for bags, x in passages(texts):
                for k, rows_x in zip(bags.tolist(), np.split(x, np.cumsum(bags)[:-1])):
                    spread = np.arange(k) if k <= max_passages else np.linspace(0, k - 1, max_passages).round().astype(int)
                    rows.append(rows_x[spread].astype("<f8").tobytes() if k else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])

    texts = documents.select(F.col("doc_id").cast("long"), "text").join(chosen.select("doc_id"), "doc_id", "left_semi")
    bags = texts.mapInArrow(run, "doc_id long, x binary").filter("x is not null").join(chosen, "doc_id").dropDuplicates(["doc_id"])
    found = bags.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()  # at most max_docs * max_passages passages
    if not found:
        return None
    x = [np.frombuffer(r["x"]).reshape(-1, FEATURES) for r in found]
    return train(np.concatenate(x), np.array([len(v) for v in x]), np.array([float(r["quality"]) for r in found]))


def score_column(model: Model | None):
    """A mapInArrow function: adds ``score`` to batches whose last column is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(batch.num_columns - 1).to_pylist()]
            scores = [np.zeros(0)]
            for bags, x in passages(texts):
                scores.append(model.score(x, bags) if model else np.where(bags > 0, 0.5, 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of documents."""
    model = fit(documents, labels)
    scored = documents.select("doc_id", "text").mapInArrow(score_column(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Whole documents that score at least ``threshold``; nothing is shuffled."""
    model = fit(documents, labels)
    at = documents.columns.index("text")
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(at).to_pylist()]
            keep = [np.zeros(0, bool)]
            for bags, x in passages(texts):
                keep.append((model.score(x, bags) if model else np.where(bags > 0, 0.5, 0.0)) >= threshold)
            yield batch.filter(pa.array(np.concatenate(keep)))

    return documents.mapInArrow(run, schema)
