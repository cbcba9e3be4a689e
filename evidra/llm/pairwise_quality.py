"""Quality classifier: Bradley-Terry ranking learnt from preference pairs, thresholded at a score quantile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import byte_chunks, documents, trim, written
from evidra.llm.textstats import SLICE, Batch, gram_hashes, crc_rest, labelled_sample, mix64, one_label, sigmoid

#: Labelled rows of each label that pairs are drawn from, the longest of them in code points, and the pairs.
PER_LABEL, MAX_CHARS, PAIRS = 1500, 20_000, 8_000
#: Labels of rows with this remainder of crc32(doc_id) by 3 are never learnt.
HELD_OUT = (3, 1)
#: Slots of hashed byte pairs.
GRAM_BITS = 8
#: Scores are counted in classes this wide, within +-LIMIT; the threshold is one of their edges.
STEP, LIMIT = 0.02, 40.0


def _has(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_UPPER, _DIGIT, _MARK = _has(bytes(range(65, 91))), _has(b"0123456789"), _has(b"!?.,;:|#*$%&<>=+-_/\\@^~'\"()[]{}")
_WIDE = _has(bytes(range(128, 256)))


def features(batch: Batch) -> np.ndarray:
    """A row of features for each text: lengths, shares of kinds of characters, repeats, and hashed byte pairs."""
    c = batch.base_counts()
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    size = np.maximum(batch.end - batch.start, 1)
    lines = np.maximum(batch.share(_has(b"\n")) + 1, 1)
    distinct = np.unique(mix64(batch.ids + batch.doc.astype(np.uint64)), return_index=True)[1]
    kinds = np.bincount(batch.doc[distinct], minlength=batch.n) / n
    repeat = c["n_repeat_words"] / n
    cols = [
        np.log1p(c["n_words"]),
        np.minimum(c["n_words"], 50) / 50,
        c["word_chars"] / n,
        c["n_symbols"] / chars,
        np.minimum(10 * c["n_symbols"] / chars, 1),
        c["n_dup_lines"] / lines,
        repeat,
        np.minimum(4 * repeat, 1),
        (repeat > 0.5).astype(float),
        kinds,
        np.log1p(n / lines),
        *(batch.share(t) / size for t in (_UPPER, _DIGIT, _MARK, _WIDE)),
        (c["n_words"] == 0).astype(float),
    ]
    grams = np.zeros((batch.n, 1 << GRAM_BITS))
    for k, (a, b) in enumerate(zip(batch.start, batch.end)):
        for lo in range(a, b, SLICE):  # the last byte of a text pairs with the line feed behind it
            h = gram_hashes(batch.bytes[lo : min(b, lo + SLICE) + 1], 2)
            grams[k] += np.bincount(h & np.uint32((1 << GRAM_BITS) - 1), minlength=1 << GRAM_BITS)
    grams /= size[:, None]
    return np.concatenate([np.stack(cols, 1), np.sqrt(grams)], 1)


class Ranking:
    """A text's score is the product of its standardised features and the weights."""

    def __init__(self, mean: np.ndarray, unit: np.ndarray, weights: np.ndarray):
        self.mean, self.unit, self.weights = mean, unit, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = 200, l2: float = 1e-3, seed: int = 10) -> Ranking:
        """Weights that maximise the Bradley-Terry likelihood of pairs (a good text before a bad one)."""
        k = x.shape[1] if x.ndim == 2 else 0
        good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
        if not len(good) or not len(bad):
            return cls(np.zeros(k), np.ones(k), np.zeros(k))
        mean, unit = x.mean(0), x.std(0)
        unit = np.where(unit > 1e-9, unit, 1.0)
        z = np.clip((x - mean) / unit, -8, 8)
        r = np.random.default_rng(seed)
        d = z[r.choice(good, pairs)] - z[r.choice(bad, pairs)]
        w, m, v = np.zeros(k), np.zeros(k), np.zeros(k)
        for t in range(1, rounds + 1):
            g = -d.T @ sigmoid(-(d @ w)) / pairs + l2 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return cls(mean, unit, w)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.unit, -8, 8) @ self.weights, -LIMIT, LIMIT)


def learnable(labels: DataFrame) -> DataFrame:
    return one_label(labels, "quality").where(crc_rest(HELD_OUT[0]) != HELD_OUT[1])


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Ranking:
    """The ranking of labels.quality, from pairs of a bounded sample of the rows that are not held out."""
    rows = labelled_sample(docs, learnable(labels), per_label, max_chars)
    x = [features(Batch([r[0] for r in rows[i : i + 200]])) for i in range(0, len(rows), 200)]
    return Ranking.fit(np.concatenate(x) if x else features(Batch([])), np.array([r[1] for r in rows]))


def raw_scores(docs: DataFrame, model: Ranking) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for whole in batches:
            for b in byte_chunks(whole, 1):
                raw = held.value.raw(features(Batch(b.column(1).to_pylist())))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw)], names=["doc_id", "raw"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, raw double")


def _cell():
    return F.floor(F.col("raw") / STEP).alias("cell")


class Scores:
    """All scores counted by classes STEP wide (at most 2 LIMIT / STEP of them, which come to the driver)."""

    def __init__(self, raw: DataFrame):
        self.by = {r["cell"]: r["n"] for r in raw.groupBy(_cell()).agg(F.count("*").alias("n")).collect()}
        self.n = sum(self.by.values())

    def share_below(self, edge: int) -> float:
        return sum(n for c, n in self.by.items() if c < edge) / max(self.n, 1)

    def quantile(self, q: float) -> float:
        """The score that a share q of all is under: the middle of all such scores, by classes; without scores, or for 0, under all."""
        below, last = 0, None
        for c in sorted(self.by):
            if below >= q * self.n - 1e-6:
                return (c * STEP if last is None else (last + 1 + c) / 2 * STEP) if below else -LIMIT
            below, last = below + self.by[c], c
        return LIMIT if self.n else -LIMIT


def learn_quantile(raw: DataFrame, labels: DataFrame, scores: Scores) -> float:
    """The share of all scores to reject: of the edges of classes with the best mean accuracy over both learnable labels the middle one of the widest run, as its share.

    All learnable labels are counted, by classes. With one label only, or none, 0: nothing is rejected.
    """
    rows = raw.join(learnable(labels), "doc_id").groupBy(_cell(), "label").agg(F.count("*").alias("n")).collect()
    lo, hi = int(-LIMIT / STEP) - 1, int(LIMIT / STEP) + 2
    by = np.zeros((2, hi - lo))
    for r in rows:
        by[r["label"], r["cell"] - lo] += r["n"]
    total = by.sum(1)
    if not total.all():
        return 0.0
    below = np.concatenate([[0], np.cumsum(by[0])]) / total[0]  # share of bad rows under each edge
    right = below + 1 - np.concatenate([[0], np.cumsum(by[1])]) / total[1]
    best = np.nonzero(right >= right.max() - 1e-12)[0]
    run = max(np.split(best, np.nonzero(np.diff(best) > 1)[0] + 1), key=len)
    return scores.share_below(int(run[len(run) // 2]) + lo)


def classify(docs: DataFrame, labels: DataFrame, model: Ranking | None = None, quantile: float | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, quantile) for every row of docs (doc_id, text).

    The threshold is the score at `quantile` of all rows of docs, which is learnt from the learnable labels where
    it is not given; score is the sigmoid of the ranking score over the threshold, so 0.5 or more means at or
    above the quantile. Scores come from the text alone. A null or empty text is scored as a text without words;
    a null doc_id stays and is not held out; repeated rows are scored alike; an empty table gives an empty
    result; other columns are not read. Without labels of both kinds every row is predicted 1.
    """
    model = model or train(docs, labels)
    raw = written(raw_scores(docs, model), "scores")
    scores = Scores(raw)
    q = learn_quantile(raw, labels, scores) if quantile is None else quantile
    at = scores.quantile(q)
    held_out = F.coalesce(crc_rest(HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    score = 1 / (1 + F.exp(F.lit(at) - F.col("raw")))
    return raw.select("doc_id", held_out.alias("held_out"), score.alias("score"), F.lit(q).alias("quantile")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_bradley_terry(spark, sf_dir):
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
