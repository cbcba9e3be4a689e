"""Word statistics and hashed n-grams of whole texts, by numpy over batches, and bounded samples of labelled rows."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK_BYTES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Line feeds between the texts of a batch: one less than the longest n-gram.
GAP = 3
#: Items of a batch that sums are taken over at once: a very long text never makes arrays of its size but for its bytes and words.
SLICE = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_BLANK, _SYMBOL = _table(BLANK_BYTES), _table(SYMBOLS)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = mix64(np.arange(LONG_WORD, dtype=np.uint64) * _A + _B)


def gram_hashes(units: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n units from each on, but for the last n - 1."""
    units = units.astype(np.uint32)
    size = max(0, len(units) - n + 1)
    h = np.zeros(size, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + units[k : k + size] + np.uint32(1)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(12))


class Batch:
    """The words of several texts: their hashes, their texts, and sums by text.

    A word is a run of bytes other than 0x20 and 0x09-0x0D; its hash is a sum of its bytes by multipliers
    that depend on their place (a multilinear hash), mixed.
    """

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        self.data = [t.encode() for t in self.texts]
        self.n = len(texts)
        self.start, self.end = self._bounds(self.data)
        self.bytes = np.frombuffer((b"\n" * GAP).join(self.data) + b"\n" * GAP, np.uint8)
        blank = _BLANK[self.bytes]
        first = ~blank
        first[1:] &= blank[:-1]
        self.word_start = np.nonzero(first)[0]
        last = ~blank
        last[:-1] &= blank[1:]
        self.word_size = np.nonzero(last)[0] + 1 - self.word_start
        self.doc = np.searchsorted(self.start, self.word_start, "right") - 1
        self.blank = blank
        self.n_words = np.bincount(self.doc, minlength=self.n)

    @staticmethod
    def _bounds(parts: list) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(d) for d in parts], np.int64)
        start = np.cumsum(sizes + GAP) - sizes - GAP
        return start, start + sizes

    @cached_property
    def ids(self) -> np.ndarray:
        """The words' hashes."""
        out = np.zeros(len(self.word_start), np.uint64)
        short = self.word_size <= LONG_WORD
        for k in np.nonzero(~short)[0]:
            a = self.word_start[k]
            out[k] = xxhash.xxh64_intdigest(self.bytes[a : a + self.word_size[k]].tobytes())
        short = np.nonzero(short)[0]
        for i in range(0, len(short), SLICE // 8):
            k = short[i : i + SLICE // 8]
            size = self.word_size[k]
            begin = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(begin, size)
            val = (self.bytes[np.repeat(self.word_start[k], size) + place].astype(np.uint64) + np.uint64(1)) * _PLACE[place]
            out[k] = mix64(np.add.reduceat(val, begin))
        return out

    def total(self, of, n: int | None = None, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Sums by text of the values that of(lo, hi) gives for the bytes (or other n items) from lo to hi."""
        n, start, end = (len(self.bytes), self.start, self.end) if n is None else (n, start, end)
        out = 0
        for lo in range(0, n, SLICE):
            hi = min(n, lo + SLICE)
            v = of(lo, hi)
            s = np.concatenate([[0], np.cumsum(v, dtype=np.int64 if v.dtype == bool else None)])
            out = out + s[np.clip(end - lo, 0, hi - lo)] - s[np.clip(start - lo, 0, hi - lo)]
        return out if n else np.zeros(self.n, np.int64)

    def share(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each text a table of 256 flags holds."""
        return self.total(lambda lo, hi: table[self.bytes[lo:hi]])

    def by_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, values, self.n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word pairs and their texts."""
        same = self.doc[:-1] == self.doc[1:]
        return mix64(self.ids[:-1] * _A + self.ids[1:] * _B)[same], self.doc[:-1][same]

    @cached_property
    def _joined(self) -> str:
        return ("\n" * GAP).join(self.texts) + "\n" * (2 * GAP)

    @cached_property
    def point_bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each text starts and ends among the code points of all."""
        return self._bounds(self.texts)

    def point_grams(self, n: int, lo: int, hi: int) -> np.ndarray:
        """A hash of the n code points from each of those from lo to hi on (the last of a text are followed by line feeds)."""
        return gram_hashes(np.frombuffer(self._joined[lo : hi + n - 1].encode("utf-32-le"), np.uint32), n)

    def total_points(self, of) -> np.ndarray:
        """Sums by text of the values that of(lo, hi) gives for code points."""
        return self.total(of, len(self._joined) - GAP, *self.point_bounds)

    def n_repeat_words(self) -> np.ndarray:
        """Words in three-word windows that occur twice or more in their text, the first included."""
        i, d = self.ids, self.doc
        if len(i) < 4:
            return np.zeros(self.n, np.int64)
        same = d[:-2] == d[2:]
        t = mix64(i[:-2] * _A + i[1:-1] * _B + i[2:] * _C + d[:-2].astype(np.uint64))
        at = np.nonzero(same)[0]
        order = at[np.argsort(t[at], kind="stable")]
        s = t[order]
        eq = s[1:] == s[:-1]
        rep = np.zeros(len(order), bool)
        rep[1:] |= eq
        rep[:-1] |= eq
        covered = np.zeros(len(i), bool)
        for k in range(3):
            covered[order[rep] + k] = True
        return np.bincount(d[covered], minlength=self.n)

    def n_dup_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line."""
        out = []
        for data in self.data:
            seen, n = set(), 0
            for line in data.split(b"\n"):
                if line in seen:
                    n += bool(line.strip(BLANK_BYTES))
                else:
                    seen.add(line)
            out.append(n)
        return np.array(out, np.int64)

    def base_counts(self) -> dict[str, np.ndarray]:
        return {
            "n_words": self.n_words,
            "word_chars": self.share(~_BLANK & ((np.arange(256) & 0xC0) != 0x80)),
            "n_symbols": self.share(_SYMBOL),
            "n_dup_lines": self.n_dup_lines(),
            "n_repeat_words": self.n_repeat_words(),
        }


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) with label 0 or 1, a row per doc_id: 1 if any of its rows says so; null ids and labels go."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return rows.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))


def crc_rest(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, max_chars: int) -> list[tuple[str, int, int]]:
    """At most per_label whole texts (of at most max_chars code points) of each label, as (text, label, doc_id).

    `labels` is (doc_id, label). Ids are taken in the order of a hash, so the sample does not depend on
    partitions; the texts of at most 2 * per_label ids come to the driver, one (the least) for each id however
    many rows share it. The longer texts are left out of the sample, not cut.
    """
    picked = None
    for y in (0, 1):
        part = labels.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        picked = part if picked is None else picked.union(part)
    ids = docs.sparkSession.createDataFrame(picked.collect(), "doc_id long, label int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= max_chars)
    got = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return sorted(((r["text"], r["label"], r["doc_id"]) for r in got), key=lambda r: (xxhash.xxh64_intdigest(str(r[2])), r[2], r[0]))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
