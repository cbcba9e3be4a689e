"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph cells."""

from __future__ import annotations

import base64
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import byte_chunks, doc_key, documents, null_key, trim

#: Cells of the sketch that is stored; a retry doubles them.
BASE_CELLS = 12
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """The finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        x = x + _MIX[2] * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


def digests(text: str) -> np.ndarray:
    """64-bit digests of a text's paragraph cells.

    A cell is a line, or a sentence of one (cut after ". "); blank cells do not count. A cell that occurs
    again is hashed with its ordinal, so the digests of a text are distinct and repeats count.
    """
    seen: dict[str, int] = {}
    out = []
    for p in text.replace(". ", ".\n").split("\n"):
        if p and not p.isspace():
            k = seen[p] = seen.get(p, -1) + 1
            out.append(xxhash.xxh64_intdigest(p.encode(), k))
    return np.array(out, np.uint64)


class Sketches:
    """The sketches of several texts at one size: counts, xor of keys, xor of check values, each (texts, cells)."""

    def __init__(self, owner: np.ndarray, keys: np.ndarray, texts: int, cells: int):
        self.cells = cells
        self.count = np.zeros((texts, cells), np.int64)
        self.key = np.zeros((texts, cells), np.uint64)
        self.check = np.zeros((texts, cells), np.uint64)
        self._put(owner, keys, np.ones(len(keys), np.int64))

    def _put(self, owner, keys, sign):
        third = np.uint64(self.cells // 3)
        check = _mix(keys, 77)
        for j in range(3):
            at = (owner, (_mix(keys, j + 8 * self.cells) % third).astype(np.int64) + j * int(third))
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def subtract(self, other: Sketches) -> None:
        self.count -= other.count
        self.key ^= other.key
        self.check ^= other.check

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take out pure cells until none is left: (text, key, sign) of the recovered keys, and which texts came out whole."""
        got: list[tuple[np.ndarray, ...]] = []
        while True:
            t, c = np.nonzero((np.abs(self.count) == 1) & (self.check == _mix(self.key, 77)))
            if not len(t):
                break
            keys, sign = self.key[t, c], self.count[t, c]
            first = np.unique(np.stack([t.astype(np.uint64), keys], 1), axis=0, return_index=True)[1]
            t, keys, sign = t[first], keys[first], sign[first]
            self._put(t, keys, -sign)
            got.append((t, keys, sign))
            if len(got) > 4 * self.cells + 64:  # a false pure cell can put a key in and out for ever
                break
        whole = ~(self.count.any(1) | self.key.any(1) | self.check.any(1))
        t, k, s = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return t, k, s, whole

    def serialised(self) -> list[str]:
        """Counts (16 bits), keys (64) and check values (32) of each text's cells, base64."""
        parts = [self.count.astype("<i2"), self.key.astype("<u8"), self.check.astype("<u4")]
        return [base64.b64encode(b"".join(p[i].tobytes() for p in parts)).decode() for i in range(len(self.count))]


def _flat(lists: list[np.ndarray], rows) -> tuple[np.ndarray, np.ndarray]:
    owner = np.repeat(np.arange(len(rows)), [len(lists[r]) for r in rows])
    return owner, (np.concatenate([lists[r] for r in rows]) if len(rows) else np.zeros(0, np.uint64))


def reconcile(left: list[np.ndarray], right: list[np.ndarray], cells: int = BASE_CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of digest lists, the digests on the left only and on the right only.

    Sketches of `cells` cells are subtracted and peeled; pairs that do not come out whole are tried again
    at twice the size. From eight cells a digest on, what is left is compared directly.
    """
    out: list = [None] * len(left)
    todo = np.arange(len(left))
    while len(todo):
        over = [i for i in todo if cells > 8 * (len(left[i]) + len(right[i])) + 96]
        for i in over:
            out[i] = (np.setdiff1d(left[i], right[i]), np.setdiff1d(right[i], left[i]))
        todo = np.array([i for i in todo if out[i] is None], np.int64)
        again = []
        step = max(1, (1 << 18) // cells)
        for at in range(0, len(todo), step):
            rows = todo[at : at + step]
            a = Sketches(*_flat(left, rows), len(rows), cells)
            a.subtract(Sketches(*_flat(right, rows), len(rows), cells))
            t, k, s, whole = a.peel()
            order = np.argsort(t, kind="stable")
            t, k, s = t[order], k[order], s[order]
            lo, hi = np.searchsorted(t, np.arange(len(rows))), np.searchsorted(t, np.arange(len(rows)), "right")
            for i, r in enumerate(rows):
                if whole[i]:
                    kk, ss = k[lo[i] : hi[i]], s[lo[i] : hi[i]]
                    out[r] = (kk[ss > 0], kk[ss < 0])
                else:
                    again.append(r)
        todo, cells = np.array(again, np.int64), cells * 2
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray]) -> list[float]:
    """Twice the shared cells over all cells of both texts; 1 if neither has any."""
    out = []
    for a, b, (x, y) in zip(left, right, reconcile(left, right)):
        n = len(a) + len(b)
        out.append(1 - (len(x) + len(y)) / n if n else 1.0)
    return out


def stored(lists: list[np.ndarray]) -> list[str]:
    """The fingerprints as stored: number of cells of the text, then its base sketch."""
    sk = Sketches(*_flat(lists, range(len(lists))), len(lists), BASE_CELLS).serialised()
    return [f"{len(d)}:{s}" for d, s in zip(lists, sk)]


#: Bytes of text that a bucket is meant to hold, the most buckets that are told apart by id, and parts of one id's rows.
BUCKET_BYTES, MOST, SUB = 256 << 20, 1 << 16, 1 << 16


def _buckets(docs: DataFrame) -> int:
    spark = docs.sparkSession
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    size = int(str(size))
    return min(MOST, max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES if size < 1 << 60 else 0))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows (bucket, id, h, text, guest) dealt so that a bucket holds a range of (id, h) and, as guests, the rows that follow its last.

    h is a hash of the text. Bounds are quantiles of the ids; an id that is several quantiles at once (null, say)
    has its rows parted further by h. Only the bounds and the least row of each bucket come to the driver (at
    most MOST numbers and, with the parts, as many rows). The last bucket's guests are the rows with the least
    (id, h) of all.
    """
    spark = docs.sparkSession
    n = buckets or _buckets(docs)
    rows = docs.select(doc_key().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.select("id").agg(F.percentile_approx("id", [(i + 1) / n for i in range(n - 1)] or [0.5], 100 * n).alias("q")).first()["q"] or []
    times = Counter(cuts)
    cuts = sorted(times)
    lit = lambda x: f"{x}L" if x != -(2**63) else "(-9223372036854775807L - 1L)"
    wide = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    if groups:
        # the number of bounds at or below an id, found in two levels
        tops = "array(" + ",".join(lit(g[0]) for g in groups) + ")"
        inner = "array(" + ",".join("array(" + ",".join(map(lit, g)) + ")" for g in groups) + ")"
        top = f"size(filter({tops}, x -> x <= id))"
        place = f"if({top} = 0, 0, ({top} - 1) * {wide} + size(filter(element_at({inner}, {top}), x -> x <= id)))"
    else:
        place = "0"
    # rows of an id that is a bound m times: m parts by h, before the other ids of their place
    hot = {x: m for x, m in times.items() if m > 1}
    part = f"{SUB - 1}"
    if hot:
        many = "map(" + ",".join(f"{lit(x)},{min(m, SUB - 1)}" for x, m in hot.items()) + ")"
        part = f"coalesce(cast(floor((h / 18446744073709551616D + 0.5D) * element_at({many}, id)) as int), {SUB - 1})"
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("bucket", F.expr(f"cast({place} as long) * {SUB} + {part}"))
    heads = sorted((r["bucket"], *r["x"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("id", "h")).alias("x")).collect())
    if not heads:
        return rows.select("bucket", "id", "h", "text", F.lit(0).alias("guest"))
    hosts = [(*heads[i][1:], heads[i - 1][0]) for i in range(len(heads))]  # the first bucket's head goes to the last
    small = spark.createDataFrame(hosts, "head long, head_h long, host long")
    out = rows.join(F.broadcast(small), (F.col("id") == F.col("head")) & (F.col("h") == F.col("head_h")), "left")
    places = F.when(F.col("host").isNull(), F.array(F.struct("bucket", F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct("bucket", F.lit(0).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest")))
    )
    return out.select("id", "h", "text", F.inline(places)).select("bucket", "id", "h", "text", "guest")


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and likenesses, for docs (doc_id, text).

    The edited text is the text with its last floor(n/2) code points replaced by the first as many (or all)
    of the next row's, in ascending (doc_id, hash of the text, text); after the last row comes the first. Returns doc_id,
    n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next.
    A null text is empty (no cells; two empty texts are alike, 1.0). A null doc_id sorts first. Rows with
    equal ids follow each other by their texts' hashes; a very frequent id is parted by them. A single row is its own next. An empty table gives an empty result;
    other columns are not read. Texts move once, by ranges of ids.
    """

    def flush(part):
        ids, texts, nexts = zip(*part)
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
        a, e, x = ([digests(t) for t in col] for col in (texts, edited, nexts))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(edited, pa.string()), pa.array(stored(a)), pa.array(stored(e)), pa.array(likeness(a, e), pa.float64()), pa.array(likeness(a, x), pa.float64())],
            names=["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches):
        part, size, held, guest = [], 0, None, None
        for whole in batches:
            for b in byte_chunks(whole, 2):
                for bucket, i, t, g in zip(*(c.to_pylist() for c in b.columns)):
                    if held is not None and held[0] != bucket:  # the last row of a bucket is followed by its first guest
                        part.append((held[1], held[2], guest))
                        held = guest = None
                    if g:
                        guest = t if guest is None else guest
                        continue
                    if held is not None:
                        part.append((held[1], held[2], t))
                    held = (bucket, i, t)
                    size += len(t)
                    if size > 1 << 20 and part:
                        yield flush(part)
                        part, size = [], 0
        if held is not None:
            part.append((held[1], held[2], guest))
        if part:
            yield flush(part)
        trim()

    dealt = with_next(docs).repartition("bucket").sortWithinPartitions("bucket", F.desc("guest"), "id", "h", "text").select("bucket", "id", "text", "guest")
    out = dealt.mapInArrow(run, "id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(null_key(F.col("id")).alias("doc_id"), *out.columns[1:])


def op1_iblt_fingerprints(spark, sf_dir):
    out = compare_with_next(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
