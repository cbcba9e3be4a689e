"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import byte_chunks, doc_key, documents, null_key, trim, written

BLANKS = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
#: Filters of more bytes than this in all are not broadcast; the postings are then dealt to the filters' shards.
BROADCAST_BYTES = 16 << 20
#: Keys that a shard is meant to hold, and postings that are asked of a filter in one group where they are dealt.
SHARD_KEYS, GROUP = 1 << 15, 1 << 20


class CuckooFilter:
    """Buckets of four 16-bit marks; partial-key cuckoo hashing (Fan et al., 2014). Supports insertion and deletion."""

    KICKS = 500
    #: Share of slots in use up to which insertions find room.
    LOAD = 0.84

    def __init__(self, capacity: int, slots: np.ndarray | None = None, spill: dict | None = None):
        n = 1
        while n * 4 * self.LOAD < max(capacity, 4):
            n *= 2
        self.slots = np.zeros((n, 4), np.uint16) if slots is None else slots
        #: Marks that found no room, by bucket pair: nothing inserted is ever lost.
        self.spill: dict[tuple[int, int], int] = spill or {}

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key >> 48) % 65535 + 1
        a = key & (len(self.slots) - 1)
        return mark, a, self._other(a, mark)

    def _other(self, at: int, mark: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & (len(self.slots) - 1)

    def insert(self, key: int) -> None:
        mark, a, b = self._places(key)
        for at in (a, b):
            free = np.nonzero(self.slots[at] == 0)[0]
            if len(free):
                self.slots[at, free[0]] = mark
                return
        at = a
        for k in range(self.KICKS):
            slot = (mark + k) & 3
            self.slots[at, slot], mark = mark, int(self.slots[at, slot])
            at = self._other(at, mark)
            free = np.nonzero(self.slots[at] == 0)[0]
            if len(free):
                self.slots[at, free[0]] = mark
                return
        pair = (mark, min(at, self._other(at, mark)))
        self.spill[pair] = self.spill.get(pair, 0) + 1

    def delete(self, key: int) -> bool:
        """Take out one insertion of `key`; it must have been inserted."""
        mark, a, b = self._places(key)
        for at in (a, b):
            hit = np.nonzero(self.slots[at] == mark)[0]
            if len(hit):
                self.slots[at, hit[0]] = 0
                return True
        pair = (mark, min(a, b))
        if self.spill.get(pair):
            self.spill[pair] -= 1
            return True
        return False

    @property
    def full(self) -> bool:
        return bool(self.spill) or np.count_nonzero(self.slots) > self.LOAD * self.slots.size

    def contains(self, keys: np.ndarray) -> np.ndarray:
        k = keys.astype(np.uint64)
        mark = (k >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        mask = np.uint64(len(self.slots) - 1)
        a = k & mask
        b = (a ^ mark * np.uint64(0x5BD1E995)) & mask
        m = mark.astype(np.uint16)[:, None]
        hit = (self.slots[a.astype(np.int64)] == m).any(1) | (self.slots[b.astype(np.int64)] == m).any(1)
        if self.spill:
            lost = {p for p, n in self.spill.items() if n}
            hit |= np.array([(int(x), int(min(y, z))) in lost for x, y, z in zip(mark, a, b)], bool)
        return hit

    def to_bytes(self) -> bytes:
        extra = [(m, at, n) for (m, at), n in self.spill.items() if n]
        return np.array([len(self.slots), len(extra), *(v for e in extra for v in e)], "<i8").tobytes() + self.slots.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n, extra = np.frombuffer(data, "<i8", 2)
        rest = np.frombuffer(data, "<i8", 3 * extra, 16).reshape(-1, 3)
        slots = np.frombuffer(data, "<u2", 4 * n, 16 + 24 * int(extra)).reshape(int(n), 4).astype(np.uint16)
        return cls(0, slots, {(int(m), int(at)): int(k) for m, at, k in rest})


def line_key(line: str, min_chars: int = 20) -> bytes | None:
    """128-bit hash of a line's key (blanks stripped at both ends, A-Z lower-cased), None for keys under min_chars code points."""
    k = line.strip(BLANKS)
    return xxhash.xxh3_128_digest(k.translate(_LOWER).encode()) if len(k) >= min_chars else None


def _split(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def postings(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, id): one row for each distinct key of each row of docs."""

    def run(batches):
        for whole in batches:
            for b in byte_chunks(whole, 1):
                keys, ids = [], []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own = {line_key(x, min_chars) for x in (t or "").split("\n")} - {None}
                    keys += own
                    ids += [i] * len(own)
                h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(ids, pa.int64())], names=["h1", "h2", "id"])
        trim()

    return docs.select(doc_key().alias("id"), "text").mapInArrow(run, "h1 long, h2 long, id long")


def distinct_postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """postings, each once: rows of one doc_id may repeat them, so those of ids that several rows share are made distinct."""
    rows = written(postings(docs, min_chars), "postings")
    again = written(docs.groupBy(doc_key().alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    if again.isEmpty():
        return rows
    return written(rows.join(again, "id", "left_anti").union(rows.join(again, "id", "left_semi").distinct()).select("h1", "h2", "id"), "postings")


class LineIndex:
    """Exact postings and reference counts of line keys, with cuckoo filters by shard over the keys that many documents share.

    `posts` (h1, h2, id) holds a row for each key of each document (rows that share an id are one document);
    `counts` (h1, h2, n, last) gives each key's number of documents and its last one; `filters` (shard, data)
    hold the keys of at least min_docs documents: a negative answer is exact, a positive one is checked against
    the counts. `insert` and `delete` work on the keys of the documents that come or go: their counts are taken
    anew or summed and replace the old ones, and the filters put in or take out the keys that crossed min_docs,
    so insert followed by delete restores every count and every answer. Where a filter is full, all are built
    anew with twice the room or more shards, which happens each time the number of keys has doubled. An index that
    has been changed reads the old tables and those of its changes; `compacted` writes them as one.
    """

    def __init__(self, posts: DataFrame, counts: DataFrame, min_docs: int = 3, min_chars: int = 20, shards: int | None = None, filters: DataFrame | None = None):
        self.posts, self.counts, self.min_docs, self.min_chars, self.filters, self.shards = posts, counts, min_docs, min_chars, filters, shards

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> LineIndex:
        """The index of docs (doc_id, text)."""
        posts = distinct_postings(docs, min_chars)
        return cls(posts, written(_counted(posts), "counts"), min_docs, min_chars)

    def compacted(self) -> LineIndex:
        return LineIndex(written(self.posts, "postings"), written(self.counts, "counts"), self.min_docs, self.min_chars, self.shards, self.filters)

    def active(self) -> DataFrame:
        """(h1, h2, n, last) of the keys that at least min_docs documents hold."""
        return self.counts.where(F.col("n") >= self.min_docs)

    def _shard(self):
        return F.pmod(F.col("h2"), F.lit(self.shards)).cast("int").alias("shard")

    def built_filters(self) -> DataFrame:
        """(shard, data): the filter of every shard that has keys, built where the shard's keys are."""
        if self.filters is None:
            self.shards = 1 + self.active().count() // SHARD_KEYS

            def build(key, pdf):
                f = CuckooFilter(2 * max(len(pdf), 64))
                for h in pdf["h1"].to_numpy().astype(np.uint64):
                    f.insert(int(h))
                return _frame(key[0], f)

            self.filters = written(self.active().select(self._shard(), "h1").groupBy("shard").applyInPandas(build, "shard int, data binary, full boolean"), "filters")
        return self.filters

    def _changed(self, posts: DataFrame, touched: DataFrame, now: DataFrame) -> LineIndex:
        """The index over `posts`; touched (h1, h2): keys whose counts may have changed, now (h1, h2, n, last): their new counts."""
        old = written(self.counts.join(touched, ["h1", "h2"], "left_semi"), "old-counts")
        counts = self.counts.join(touched, ["h1", "h2"], "left_anti").union(now)
        new = LineIndex(posts, counts, self.min_docs, self.min_chars)
        was, many = (x.where(F.col("n") >= self.min_docs).select("h1", "h2") for x in (old, now))
        self.built_filters()
        up = many.join(was, ["h1", "h2"], "left_anti").select(self._shard(), "h1", F.lit(1).alias("d"))
        down = was.join(many, ["h1", "h2"], "left_anti").select(self._shard(), "h1", F.lit(-1).alias("d"))

        def change(key, old, moves):
            if not len(moves):
                return old
            d, h = moves["d"].to_numpy(), moves["h1"].to_numpy().astype(np.uint64)
            f = CuckooFilter.from_bytes(old["data"].iloc[0]) if len(old) else CuckooFilter(2 * max(len(moves), 64))
            for k in h[d < 0]:
                f.delete(int(k))
            for k in h[d > 0]:
                f.insert(int(k))
            return _frame(key[0], f)

        moved = self.filters.groupBy("shard").cogroup(up.union(down).groupBy("shard")).applyInPandas(change, "shard int, data binary, full boolean")
        moved = written(moved, "filters")
        if moved.where("full").isEmpty():
            new.filters, new.shards = moved, self.shards
        return new

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the documents of docs added; a document that is there already gains the keys it did not have."""
        came = distinct_postings(docs, self.min_chars)
        known = self.posts.join(came, ["h1", "h2", "id"], "left_semi")
        came = written(came.join(known, ["h1", "h2", "id"], "left_anti"), "postings")
        touched = came.select("h1", "h2").distinct()
        both = self.counts.join(touched, ["h1", "h2"], "left_semi").union(_counted(came))
        now = written(both.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")), "counts")
        return self._changed(self.posts.union(came), touched, now)

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents of ids (doc_id)."""
        gone = written(ids.select(doc_key().alias("id")).distinct(), "deleted")
        touched = written(self.posts.join(gone, "id", "left_semi").select("h1", "h2").distinct(), "touched")
        posts = self.posts.join(gone, "id", "left_anti").select("h1", "h2", "id")
        now = written(_counted(posts.join(touched, ["h1", "h2"], "left_semi")), "counts")
        return self._changed(posts, touched, now)

    def likely(self) -> DataFrame:
        """The postings whose key its shard's filter holds, by all filters in every worker, or, where they are too large for that, by filters and postings dealt by shard."""
        posts = self.posts
        size = self.built_filters().agg(F.sum(F.octet_length("data"))).first()[0] or 0
        if size <= BROADCAST_BYTES:
            data = {r["shard"]: bytes(r["data"]) for r in self.filters.collect()}
            held, shards = posts.sparkSession.sparkContext.broadcast(data), self.shards

            def ask(batches):
                filters = {s: CuckooFilter.from_bytes(d) for s, d in held.value.items()}
                for b in batches:
                    h1, h2 = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    shard = h2 % shards
                    hit = np.zeros(len(h1), bool)
                    for s in np.unique(shard):
                        if s in filters:
                            at = np.nonzero(shard == s)[0]
                            hit[at] = filters[s].contains(h1[at].astype(np.uint64))
                    yield b.filter(pa.array(hit))
                del filters
                trim()

            return posts.mapInArrow(ask, posts.schema)
        # a shard with many postings (a very common line) is dealt over several groups, each with its own copy of the filter
        posts = posts.withColumn("shard", self._shard())
        parts = written(posts.groupBy("shard").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")), "parts")
        posts = posts.join(parts, "shard").withColumn("part", F.expr("pmod(xxhash64(id), parts)").cast("int"))
        filters = self.filters.join(parts, "shard").select("shard", "data", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))

        def ask_one(filters: pa.Table, rows: pa.Table) -> pa.Table:
            rows = rows.select(["h1", "h2", "id"])
            if not filters.num_rows or not rows.num_rows:
                return rows.slice(0, 0)
            return rows.filter(pa.array(CuckooFilter.from_bytes(filters.column("data")[0].as_py()).contains(rows.column("h1").to_numpy().astype(np.uint64))))

        return filters.groupBy("shard", "part").cogroup(posts.groupBy("shard", "part")).applyInArrow(ask_one, "h1 long, h2 long, id long")

    def drops(self) -> DataFrame:
        """(id, keys): the keys that each document loses; a document holds no more of them than it has lines."""
        lost = self.likely().join(written(self.active().select("h1", "h2", "last"), "active"), ["h1", "h2"]).where("id < last")
        return lost.groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("keys"))


def _counted(posts: DataFrame) -> DataFrame:
    """(h1, h2, n, last) of postings; counted before they are shuffled."""
    return posts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last"))


def _frame(shard, f: CuckooFilter):
    import pandas as pd

    return pd.DataFrame({"shard": [shard], "data": [f.to_bytes()], "full": [f.full]})


def _deduped(docs: DataFrame, keep: tuple[str, ...], min_docs: int, min_chars: int, index: LineIndex | None) -> DataFrame:
    """(id, text, n_lines, n_dropped) of the rows of docs, and their columns named in `keep` as keep_0, keep_1, ..."""
    index = index or LineIndex.of(docs, min_docs, min_chars)
    rows = docs.select(doc_key().alias("id"), "text", *(F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(keep)))
    both = rows.join(index.drops().hint("shuffle_hash"), "id", "left")
    cols = [f"keep_{k}" for k in range(len(keep))]
    schema = "id long, text string, n_lines long, n_dropped long" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches):
        for whole in batches:
            for b in byte_chunks(whole, 1):
                texts, n_lines, n_dropped = [], [], []
                for t, keys in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    lines = (t or "").split("\n")
                    kept = lines
                    if keys:
                        lost = {(k["h1"], k["h2"]) for k in keys}
                        kept = [x for x in lines if (h := line_key(x, min_chars)) is None or _split(h) not in lost]
                    texts.append("\n".join(kept))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), *b.columns[3:]], names=["id", "text", "n_lines", "n_dropped", *cols])
        trim()

    return both.select("id", "text", "keys", *cols).mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, index: LineIndex | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row of docs (doc_id, text), dropped lines taken out.

    Lines end at line feeds. Keys of at least min_chars code points that at least min_docs documents hold lose
    all their lines except in the largest doc_id that holds them; a key that a document holds several times
    counts once for it. A null or empty text is one empty line (text ""). A null doc_id is an id of its own that
    sorts before all others. Rows that share a doc_id are one document for the counts and stay rows: the largest
    id keeps the line in all its rows. An empty table gives an empty result; other columns are not read.
    """
    out = _deduped(docs, (), min_docs, min_chars, index)
    return out.select(null_key(F.col("id")).alias("doc_id"), "text", "n_lines", "n_dropped")


def deduped_documents(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs (all columns, whatever their names) with the lines taken out that dedup_lines drops; n_chars, if it is there, follows. Edge cases are those of dedup_lines."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = _deduped(docs, tuple(rest), min_docs, min_chars, None)
    made = {c: F.col(f"keep_{k}") for k, c in enumerate(rest)} | {"doc_id": null_key(F.col("id")), "text": F.col("text")}
    if "n_chars" in rest:
        made["n_chars"] = F.length("text")
    return out.select(*(made[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def op5_line_dedup(spark, sf_dir):
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775807) AS id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT r, doc_id, id, i, parts[i] AS line FROM rows, unnest(range(1, len(parts) + 1)) AS u(i)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
  SELECT k, max(id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT id) >= 3
), marked AS (
  SELECT r, doc_id, i, line, shared.k IS NOT NULL AND id < last AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
