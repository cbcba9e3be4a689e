"""Quality rules: a hashed n-gram logistic regression over words and characters, calibrated, beside fixed base rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import byte_chunks, documents, trim
from evidra.llm.textstats import GAP, Batch, labelled_sample, one_label, sigmoid

#: Weights of each kind of feature (words, word pairs, n-grams of code points) as a power of two.
BITS = 15
#: Labelled rows of each label that the classifier is fitted on, and the longest of them in code points.
PER_LABEL, MAX_CHARS = 600, 20_000
#: A document is kept at this calibrated probability or more.
THRESHOLD = 0.5
_SCALE = 20.0


def features(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, share) of the words, word pairs and n-grams of 2 to 4 code points of a batch: counts over the number of words or code points."""
    mask = (1 << BITS) - 1
    pairs, of = batch.pairs()
    rows = [batch.doc, of]
    slots = [(batch.ids & np.uint64(mask)).astype(np.int64), (pairs & np.uint64(mask)).astype(np.int64) | 1 << BITS]
    size = np.maximum(batch.n_words, 1)
    vals = [_SCALE / size[batch.doc], _SCALE / size[of]]
    start, end = batch.point_bounds
    length = np.maximum(end - start, 1)
    inside = np.concatenate([np.arange(a, b) for a, b in zip(start, end)] or [np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(batch.n), end - start)
    for n in (2, 3, 4):
        rows.append(owner)
        slots.append((batch.point_grams(n, 0, len(batch._joined) - GAP)[inside] & np.uint32(mask)).astype(np.int64) | 2 << BITS)
        vals.append(_SCALE / 3 / length[owner])
    r, s, v = map(np.concatenate, (rows, slots, vals))
    both, at = np.unique(r * (4 << BITS) + s, return_inverse=True)
    return both // (4 << BITS), both % (4 << BITS), np.bincount(at, v)


def many_features(texts: list[str], step: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of many texts, made a few at a time so that the driver holds the distinct ones only."""
    parts = []
    for i in range(0, len(texts), step):
        r, s, v = features(Batch(texts[i : i + step]))
        parts.append(((r + i).astype(np.int32), s.astype(np.int32), v.astype(np.float32)))
    return tuple(map(np.concatenate, zip(*parts)))


class Model:
    """Logistic regression with Platt calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    @classmethod
    def fit(cls, texts: list[str], y: list[int], rounds: int = 120, l2: float = 1e-4) -> Model:
        """Adam on four fifths of the rows, calibration on the fifth; one label only gives a constant."""
        if len(set(y)) < 2:
            p = (sum(y) + 1.0) / (len(y) + 2.0) if y else 1.0
            return cls(np.zeros(3 << BITS), 0.0, 0.0, float(np.log(p / (1 - p + 1e-12) + 1e-12)))
        text, slot, val = many_features(texts)
        y = np.array(y, float)
        test = np.arange(len(y)) % 5 == 4
        if len(set(y[~test])) < 2 or len(set(y[test])) < 2:
            test[:] = False
        use = np.nonzero(~test)[0]
        w, b = np.zeros(3 << BITS), 0.0
        every = (text, slot, val)
        mine = ~test[text]
        at, slot, val = np.searchsorted(use, text[mine]), slot[mine], val[mine]
        weight = np.where(y[use] == 1, 0.5 / max(1, (y[use] == 1).sum()), 0.5 / max(1, (y[use] == 0).sum()))
        m = v = np.zeros(len(w) + 1)
        for k in range(1, rounds + 1):
            z = np.bincount(at, w[slot] * val, len(use)) + b
            d = (sigmoid(z) - y[use]) * weight
            g = np.append(np.bincount(slot, d[at] * val, len(w)) + l2 * w, d.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        fitted = cls(w, b, 1.0, 0.0)
        hold = np.nonzero(test)[0] if test.any() else use
        z = np.bincount(every[0], w[every[1]] * every[2], len(y))[hold] + b
        fitted.slope, fitted.shift = platt(z, y[hold])
        return fitted

    def scores(self, batch: Batch) -> np.ndarray:
        """Calibrated probabilities of the texts of a batch."""
        w, mask = self.weights, (1 << BITS) - 1
        pairs, of = batch.pairs()
        z = batch.by_word(w[(batch.ids & np.uint64(mask)).astype(np.int64)]) + np.bincount(of, w[(pairs & np.uint64(mask)).astype(np.int64) | 1 << BITS], batch.n)
        z = z * _SCALE / np.maximum(batch.n_words, 1)
        start, end = batch.point_bounds
        chars = batch.total_points(lambda lo, hi: sum(w[(batch.point_grams(n, lo, hi) & np.uint32(mask)).astype(np.int64) | 2 << BITS] for n in (2, 3, 4)))
        z += chars * _SCALE / 3 / np.maximum(end - start, 1)
        return sigmoid(self.slope * (z + self.bias) + self.shift)


def platt(z: np.ndarray, y: np.ndarray, prior: float = 0.5) -> tuple[float, float]:
    """Slope and shift of the calibrating sigmoid, labels weighted to `prior` for 1 and smoothed, by Newton steps with a ridge."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    y, was = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), y
    wt = np.where(was == 1, prior / max(1, n1), (1 - prior) / max(1, n0))
    unit = float(np.std(z)) or 1.0
    x = np.stack([z / unit, np.ones(len(z))], 1)

    def loss(t):
        p = sigmoid(x @ t)
        return -(wt * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() + 1e-4 * (t @ t)

    t = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(x @ t)
        h = (x * (wt * p * (1 - p))[:, None]).T @ x + 2e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (wt * (p - y)) + 2e-4 * t)
        k = 1.0
        while k > 1e-4 and loss(t - k * step) > loss(t):
            k /= 2
        t = t - k * step
    return max(float(t[0]) / unit, 1e-3), float(t[1])


def base_failed(base: dict[str, np.ndarray], min_words: int = 50, repeat_share: int = 50) -> np.ndarray:
    return (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > repeat_share * base["n_words"])


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Model:
    """The classifier of labels.quality, fitted on a bounded sample of the labelled rows of docs, without those that fail the base rules."""
    rows = labelled_sample(docs, one_label(labels, "quality"), per_label, max_chars)
    rows = [r for i in range(0, len(rows), 64) for r, bad in zip(rows[i : i + 64], base_failed(Batch([r[0] for r in rows[i : i + 64]]).base_counts())) if not bad]
    return Model.fit([r[0] for r in rows], [r[1] for r in rows])


_RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def _ruled(docs: DataFrame, model: Model, keep: tuple[str, ...], min_words: int, repeat_share: int, threshold: float) -> DataFrame:
    """The columns of _RESULT, and those of docs that `keep` names as keep_0, keep_1, ..."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    cols = [f"keep_{k}" for k in range(len(keep))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(f"`{c}`").alias(x) for c, x in zip(keep, cols)))
    names = [x.split()[0] for x in _RESULT.split(", ")] + cols
    schema = _RESULT + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches):
        for whole in batches:
            for b in byte_chunks(whole, 1):
                batch = Batch(b.column(1).to_pylist())
                base = batch.base_counts()
                failed = base_failed(base, min_words, repeat_share)
                p = held.value.scores(batch)
                made = [*(pa.array(c, pa.int64()) for c in base.values()), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays([b.column(0), *made, *b.columns[2:]], names=names)
        trim()

    return rows.mapInArrow(run, schema)


def apply_rules(docs: DataFrame, model: Model, min_words: int = 50, repeat_share: int = 50, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept) for every row of docs (doc_id, text).

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A document fails the base rules with fewer than
    min_words words or if more than repeat_share per cent of them are in repeated three-word windows; else it
    is kept if the classifier gives at least `threshold`. A null or empty text has no words and fails. A null
    doc_id stays; repeated rows are scored alike; an empty table gives an empty result; other columns are not
    read. No shuffle.
    """
    return _ruled(docs, model, (), min_words, repeat_share, threshold)


def kept_documents(docs: DataFrame, model: Model, min_words: int = 50, repeat_share: int = 50, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that apply_rules keeps, with all their columns, whatever their names. Edge cases are those of apply_rules."""
    rest = [c for c in docs.columns if c != "doc_id"]
    out = _ruled(docs, model, tuple(rest), min_words, repeat_share, threshold).where("kept")
    at = {c: f"keep_{k}" for k, c in enumerate(rest)} | {"doc_id": "doc_id"}
    return out.select(*(F.col(at[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def op7_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return apply_rules(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
