"""SimHash near-duplicates found through Golay-code keys."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import byte_chunks, components, doc_key, documents, null_key, trim, written

# The generator polynomial of the binary Golay code [23, 12, 7].
GOLAY_POLY = 0b110001110101
#: Bits of the three segments of a fingerprint, low bits first.
SEGMENTS = (22, 21, 21)
#: A key shared by more distinct fingerprints than this goes the exact way round (see `links`).
LIGHT = 64


def _tables():
    """Syndromes of bytes, and for every syndrome its error and the weight-7 codewords over a weight-3 error."""

    def rem(w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= GOLAY_POLY << (i - 11)
        return w

    syn = np.array([[rem(b << s) if b << s < 1 << 23 else 0 for b in range(256)] for s in (0, 8, 16)], np.int64)
    err = np.zeros(2048, np.int64)
    for k in (1, 2, 3):
        for bits in combinations(range(23), k):
            e = sum(1 << b for b in bits)
            err[rem(e)] = e
    sevens = [c for d in range(4096) if bin(c := d << 11 | rem(d << 11)).count("1") == 7]
    over: dict[int, list[int]] = {}
    for c in sevens:
        for bits in combinations([b for b in range(23) if c >> b & 1], 3):
            over.setdefault(sum(1 << b for b in bits), []).append(c)
    more = np.array([over.get(int(e), [0] * 5) for e in err], np.int64)
    return syn, err, more


_SYN, _ERR, _MORE = _tables()


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: an (n, 6) array of codeword indices and the mask of those that count.

    They are the codewords within distance 4: one for a word within 2 of its codeword, else six. Two words
    that differ in at most two bits share one, for the codeword nearest the word midway is within 3 of that.
    """
    w = words.astype(np.int64)
    s = _SYN[0][w & 255] ^ _SYN[1][w >> 8 & 255] ^ _SYN[2][w >> 16]
    near, more = w ^ _ERR[s], _MORE[s]
    out = np.concatenate([near[:, None], near[:, None] ^ more], 1) >> 11
    mask = np.ones(out.shape, bool)
    mask[:, 1:] = more != 0
    return out, mask


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 64-bit fingerprints: (row, key). Two fingerprints within two bits share a key.

    Two errors over three segments leave one segment whole, and if it is the only whole one, each of the
    others has one error. So, going round the segments, some whole segment is followed by one with at most
    one error: a key is that segment's bits and a Golay index of the next.
    """
    f = fps.astype(np.uint64)
    seg, at = [], 0
    for n in SEGMENTS:
        seg.append((f >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64))
        at += n
    rows, keys = [], []
    for k in range(3):
        idx, mask = golay_indices(seg[(k + 1) % 3])
        r, c = np.nonzero(mask)
        rows.append(r)
        keys.append(np.int64(k) << 40 | seg[k][r] << 12 | idx[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 (seed 42) of the word shingles, repeats included; of the whole sequence if it has fewer words."""
    w = text.encode().lower().split()  # on bytes: A-Z only, and blanks are 0x20 and 0x09-0x0D
    if not w:
        return []
    h = xxhash.xxh64_intdigest
    if len(w) <= words:
        return [h(b" ".join(w), 42)]
    return [h(x, 42) for x in map(b" ".join, zip(*(w[i:] for i in range(words))))]


def simhash(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], ">u8")
        votes += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(id, fp) for every row of docs (doc_id, text); a null text is empty, a null doc_id becomes the least id."""

    def run(batches):
        for whole in batches:
            for b in byte_chunks(whole, 1):
                fp = [simhash(shingle_hashes(t or "", words)) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(doc_key().alias("id"), "text").mapInArrow(run, "id long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the reps of distinct fingerprints (fp, rep) so that components are those of all pairs within two bits.

    Keys with at most LIGHT fingerprints are joined with themselves, the bit test inside the join. The
    fingerprints of larger keys take an exact way whose groups cannot grow: two fingerprints are within two
    bits if and only if some value is within one bit of both, and at most 65 distinct ones are within one
    bit of a value. Each such group gives a star about its least member, which is within two bits of all.
    """

    def keyed(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            r, k = golay_keys(fp.view(np.uint64))
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays([pa.array(k), b.column(0).take(take), b.column(1).take(take)], names=["key", "fp", "rep"])

    keys = nodes.select("fp", "rep").mapInArrow(keyed, "key long, fp long, rep long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(shared, "key"), "golay")
    light, heavy = members.where(F.col("n") <= LIGHT), members.where(F.col("n") > LIGHT)
    x, y = light.alias("x"), light.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 2)
    pairs = x.join(y, near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    flips = F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))")
    balls = heavy.select("fp", "rep").distinct().select("rep", flips.alias("v")).groupBy("v").agg(F.min("rep").alias("b"), F.collect_list("rep").alias("all"))
    stars = balls.where(F.size("all") > 1).select(F.explode("all").alias("a"), "b").where("a != b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    Fingerprints link at `max_bits` (2 or less) differing bits or fewer; component_id is the least doc_id
    that links reach. Texts without words, null ones too, have fingerprint zero and link like any other.
    Equal fingerprints are one node, so groups of copies of any size cost one row. A null doc_id sorts
    before all others (its component_id is null). Repeated rows stay. An empty table gives an empty result;
    other columns are not read.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("the keys find up to two differing bits")
    fps = written(fingerprints(docs, words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    if max_bits == 2:
        edges = links(nodes)
        comp = components(edges)
        nodes = nodes.join(comp, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    elif max_bits == 1:
        flips = F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))")
        near = nodes.select(F.col("rep").alias("a"), flips.alias("fp")).join(nodes, "fp").select("a", F.col("rep").alias("b"))
        nodes = nodes.join(components(near), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    else:
        nodes = nodes.select("fp", F.col("rep").alias("component"))
    # written, so that both sides of the join are dealt anew and the rows of a very frequent fingerprint can be split
    out = fps.join(written(nodes, "classes"), "fp")
    return out.select(null_key(F.col("id")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), null_key(F.col("component")).alias("component_id"))


def op3_simhash_golay(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


# --- near copies by the similarity of their shingles -------------------------------------------------

#: Anchors of a text (least shingle hashes under as many orders) and least hashes kept to estimate similarity.
ANCHORS, SKETCH = 8, 256
#: Open anchors of at most this many texts are compared by a join, larger ones in blocks.
FEW = 24
#: Sketches decide alone only so far from the threshold: six standard deviations of a sketch's estimate, or, for two
#: texts that the sketches hold whole, NEAR (their hashes are of 31 bits; some may coincide).
MARGIN, NEAR = 0.15, 0.02
#: Texts of a block; the blocks of an anchor that many texts share are compared pair by pair (see `_crossing`).
BLOCK = 512


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _same(text: str | None) -> int:
    h = xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()), 1)
    return h - (1 << 64) if h >> 63 else h


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, fp, same, size, anchors, sketch) of docs (doc_id, text): `same` is a hash of the words in order, equal for copies; size counts different shingles."""

    def run(batches):
        for whole in batches:
            for b in byte_chunks(whole, 1):
                fp, same, size, anchors, sketch = [], [], [], [], []
                for t in b.column(1).to_pylist():
                    h = shingle_hashes(t or "", words)
                    u = np.unique(np.array(h, np.uint64))
                    fp.append(simhash(h))
                    size.append(len(u))
                    same.append(_same(t))
                    anchors.append([int(_mix(u, k + 1).min().view(np.int64)) for k in range(ANCHORS)] if len(u) else [])
                    low = np.unique(_mix(u, 0) >> np.uint64(33)).astype(np.int32)  # 31 bits
                    sketch.append(low[:SKETCH].tolist())
                ints = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(same, pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0), *ints, pa.array(size, pa.int32()), pa.array(anchors, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int32()))], names=["id", "fp", "same", "size", "anchors", "sketch"])
        trim()

    return docs.select(doc_key().alias("id"), "text").mapInArrow(run, "id long, fp long, same long, size int, anchors array<long>, sketch array<int>")


def _stars(rows: DataFrame) -> DataFrame:
    """(a, b) of rows (key, node): each node with its key's leader, the least; as many pairs as rows at most."""
    lead = rows.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    return rows.join(lead, "key").where("node != a").select("a", F.col("node").alias("b"))


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """The rows (key, node, n, part) of members whose key holds nodes of different components (part)."""
    m = members.join(comp, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    parts = m.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("key")
    return written(m.join(parts, "key"), "open")


def _likely(pairs: DataFrame, node: DataFrame, similarity: float) -> DataFrame:
    """(a, b, sure, g) of pairs (a, b): without those that sketches or sizes rule out; sure ones are decided by the sketches.

    Groups g hold about 64 pairs and go by both ends, so that a text with many pairs does not land in one.
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x, y = ([F.col("node").alias(i), F.col("sketch").alias(f"s{i}"), F.col("size").alias(f"n{i}")] for i in "ab")
    left = pairs.join(node.select(*x), "a").join(node.select(*y), "b").where(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)
    whole = (F.col("na") <= SKETCH) & (F.col("nb") <= SKETCH)
    # of the least hashes of both (all, where the sketches hold them), the share that both have
    union = F.array_sort(F.array_union("sa", "sb"))
    left = left.withColumn("u", F.when(whole, union).otherwise(F.slice(union, 1, SKETCH))).where(F.size("u") > 0)
    left = left.withColumn("like", F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")) / F.size("u"))
    far = F.when(whole, NEAR).otherwise(MARGIN)
    left = written(left.where(F.col("like") >= similarity - far).select("a", "b", (F.col("like") >= similarity + far).alias("sure")), "likely")
    side = math.ceil(math.sqrt(left.where("not sure").count() / 64)) or 1
    return left.withColumn("g", F.pmod(F.xxhash64("a"), F.lit(side)) * side + F.pmod(F.xxhash64("b"), F.lit(side)))


def _few(m: DataFrame, node: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the rows (key, node, part) of small keys: pairs of different components whose sizes allow `similarity`."""
    m = m.join(node.select("node", "size"), "node").select("key", "node", "part", "size")
    x, y = m.alias("x"), m.alias("y")
    near = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-6
    j = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & near)
    return j.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _crossing(m: DataFrame, node: DataFrame, similarity: float) -> DataFrame:
    """(a, b, sure, g) of rows (key, node, part) that share a key, lie in different components and may be similar; g is the group they met in.

    Texts are laid out by size, one level for each step of `similarity` (similar texts are at most one level
    apart), and cut into blocks; every two blocks of a key at most one level apart meet in a group of their
    own, so that nothing is left out and no task holds more than two blocks.
    """
    step = max(-math.log(similarity), 0.01) * (1 + 1e-9)
    m = m.select("key", "node", "part").join(node.select("node", F.floor(F.log("size") / step).cast("int").alias("level")), "node")
    blocks = m.groupBy("key", "level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("n"))
    m = m.join(blocks, "key").withColumn("i", F.expr("cast(pmod(xxhash64(node), n[level]) as int)"))
    spots = F.expr("""explode(concat(
        transform(sequence(0, n[level] - 1), j -> struct(xxhash64(key, level, least(i, j), level, greatest(i, j)) as g, case when i = j then 2 when i < j then 0 else 1 end as side)),
        if(n[level + 1] is null, array(), transform(sequence(0, n[level + 1] - 1), j -> struct(xxhash64(key, level, i, level + 1, j) as g, 0 as side))),
        if(n[level - 1] is null, array(), transform(sequence(0, n[level - 1] - 1), j -> struct(xxhash64(key, level - 1, j, level, i) as g, 1 as side)))))""")
    rows = m.select("node", "part", spots.alias("s")).select("s.g", "s.side", "node", "part").join(node.select("node", "size", "sketch"), "node")

    def compare(t: pa.Table) -> pa.Table:
        side, name, part, size = (t.column(c).to_numpy() for c in ("side", "node", "part", "size"))
        sketch = t.column("sketch").combine_chunks()
        x, y = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(x) or not len(y) or part.min() == part.max():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "sure": pa.array([], pa.bool_()), "g": pa.array([], pa.int64())})
        whole = size <= SKETCH
        like = _likeness([sketch[i].values.to_numpy() for i in range(len(name))], whole, x, y)
        far = np.where(whole[x][:, None] & whole[y], NEAR, MARGIN)
        i, j = np.nonzero((like >= similarity - far) & (part[x][:, None] != part[y]))
        sure = like[i, j] >= similarity + far[i, j]
        # sure pairs join components: one link to the least of them says as much as all their pairs, and other pairs inside them are not needed
        parts, first, at = np.unique(part, return_index=True, return_inverse=True)
        u, v = at[x[i]], at[y[j]]
        top = _least_reachable(len(parts), u[sure], v[sure])
        moved = np.flatnonzero(top != np.arange(len(parts)))
        rest = np.flatnonzero(~sure & (top[u] != top[v]))
        a, b = np.concatenate([name[first[moved]], name[x[i[rest]]]]), np.concatenate([name[first[top[moved]]], name[y[j[rest]]]])
        chunk = np.concatenate([np.zeros(len(moved), np.uint64), np.arange(len(rest), dtype=np.uint64) >> np.uint64(12)])
        g = _mix(np.full(len(a), t.column("g")[0].as_py(), np.int64).view(np.uint64) + chunk, 9).view(np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": np.arange(len(a)) < len(moved), "g": g})

    return rows.groupBy("g").applyInArrow(compare, "a long, b long, sure boolean, g long")


def _least_reachable(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the edges (u, v) reach."""
    top = np.arange(n)
    while True:
        new, low = top.copy(), np.minimum(top[u], top[v])
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == top).all():
            return top
        top = new


def _verified(docs: DataFrame, node: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) of pairs (a, b, sure, g) that are similar: the sure ones, and the others by all shingles of both texts.

    The pairs of a g are compared in one task, to which each of their texts goes once.
    """
    pairs = written(pairs.groupBy("a", "b").agg(F.max("sure").alias("sure"), F.min("g").alias("g")), "pairs")
    rest = pairs.where("not sure").select("g", "a", "b")
    if rest.isEmpty():
        return pairs.select("a", "b")
    need = rest.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()

    def shingled(batches):
        for whole in batches:
            for b in byte_chunks(whole, 1):
                # of the rows that share a doc_id only those with the node's text
                b = b.filter(pa.array([_same(t) == s for t, s in zip(b.column(1).to_pylist(), b.column(0).to_pylist())], pa.bool_()))
                sets = [np.unique(np.array(shingle_hashes(t or "", words), np.uint64).view(np.int64)).tobytes() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])
        trim()

    ids = node.join(need.select("node").distinct(), "node", "left_semi").select("node", "id")
    texts = docs.select(doc_key().alias("id"), "text").join(ids, "id").select("node", "text")
    sets = written(texts.mapInArrow(shingled, "node long, shingles binary").dropDuplicates(["node"]), "shingles")

    def check(t: pa.Table, p: pa.Table) -> pa.Table:
        names = t.column("node").to_numpy()
        by = np.argsort(names)
        sets = [np.frombuffer(v.as_py(), np.int64) for v in t.column("shingles")]
        a, b = p.column("a").to_numpy(), p.column("b").to_numpy()
        i, j = (by[np.searchsorted(names, v, sorter=by)] for v in (a, b))
        ok = np.zeros(len(a), bool)
        for k in range(0, len(a), BLOCK):
            x, at_x = np.unique(i[k : k + BLOCK], return_inverse=True)
            y, at_y = np.unique(j[k : k + BLOCK], return_inverse=True)
            part = [sets[n] for n in np.concatenate([x, y])]
            like = _likeness(part, np.ones(len(part), bool), np.arange(len(x)), len(x) + np.arange(len(y)))
            ok[k : k + BLOCK] = like[at_x, at_y] >= similarity
        return pa.table({"a": a[ok], "b": b[ok]})

    full = need.join(sets.select("node", "shingles"), "node").groupBy("g").cogroup(rest.select(F.col("g").alias("h"), "a", "b").groupBy("h")).applyInArrow(check, "a long, b long")
    return written(pairs.where("sure").select("a", "b").union(full), "near")


def _likeness(sketch: list[np.ndarray], whole: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarities of the texts x with the texts y from what the sketches of both cover (all their shingles where they are whole)."""
    values, which = np.unique(np.concatenate(sketch), return_inverse=True)
    owner = np.repeat(np.arange(len(sketch)), [len(s) for s in sketch])
    count = np.bincount(which)
    place = np.cumsum(count > 1) - 1
    keep = count[which] > 1
    owner, at = owner[keep], place[which[keep]]
    by = np.argsort(at, kind="stable")
    owner, at = owner[by], at[by]
    both = np.zeros((len(x), len(y)))
    shared = int((count > 1).sum())
    for k in range(0, shared, 4096):
        lo, hi = np.searchsorted(at, (k, k + 4096))
        m = np.zeros((len(sketch), min(4096, shared - k)), np.float32)
        m[owner[lo:hi], at[lo:hi] - k] = 1
        both += m[x] @ m[y].T
    top = np.array([2**63 - 1 if w else s[-1] for s, w in zip(sketch, whole)], np.int64)
    union = np.stack([np.searchsorted(sketch[i], top[y], "right") for i in x]) + np.stack([np.searchsorted(sketch[j], top[x], "right") for j in y], 1) - both
    return both / union


def classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(id, same) of every row of docs (doc_id, text), and (same, keep): the least id of the class of copies and near copies of each different text.

    Texts that differ in their words are nodes; exact copies are one node whatever their number. Nodes whose
    shingle sets (of `words` words) have a Jaccard similarity of `similarity` or more are linked, and the
    classes are the components. Two rounds add links, each verified by sketches or, near the threshold, by all
    shingles of both texts:

    1. the Golay keys of the SimHash fingerprints (all pairs within two bits), and of each anchor (a shingle
       least under a hash, which two texts share with a probability of their similarity) its least node with
       each other one: as many pairs as texts, so a group of any size with a common centre is joined;
    2. of anchors whose texts are still in different components every pair of different components: by a join
       where few texts share the anchor, else in blocks of sketches.

    So no two texts that share an anchor remain apart unless they were compared. The second round grows with the
    square of the number of texts of an anchor that are not near copies of its leader.
    """
    sig = written(signatures(docs, words), "signatures")
    per = sig.groupBy("same").agg(F.min("id").alias("id"), F.any_value(F.struct("fp", "size", "anchors", "sketch")).alias("x"))
    node = written(per.select(F.col("same").alias("node"), "id", "x.*"), "nodes")
    by_fp = node.groupBy("fp").agg(F.min("node").alias("rep"))
    found = links(by_fp).union(_stars(node.select(F.col("fp").alias("key"), "node")))
    anchored = node.select("node", F.explode(F.expr("transform(anchors, (x, i) -> xxhash64(x, i))")).alias("key"))
    size = anchored.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(anchored.join(size, "key"), "anchors")
    edges = _verified(docs, node, _likely(found.union(_stars(members.select("key", "node"))), node, similarity), words, similarity)
    comp = components(edges)
    still = _open(members, comp)
    few, large = still.where(F.col("n") <= FEW), still.where(F.col("n") > FEW)
    pairs = _likely(_few(few, node, similarity), node, similarity)
    if not large.isEmpty():
        pairs = pairs.unionByName(_crossing(large, node, similarity))
    comp = components(edges.union(_verified(docs, node, pairs, words, similarity)))
    whole = comp.union(comp.select(F.col("component").alias("node"), "component").distinct()).join(node.select("node", "id"), "node")
    least = written(whole.groupBy("component").agg(F.min("id").alias("keep")), "least")
    keep = written(whole, "classes").join(least, "component").select(F.col("node").alias("m"), "keep")
    keep = node.select(F.col("node").alias("same"), "id").join(keep, F.col("same") == F.col("m"), "left").select("same", F.coalesce("keep", "id").alias("keep"))
    return sig.select("id", "same"), written(keep, "keep")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, same, rep) of every row of docs (doc_id, text): rep is the least id of its class of copies and near copies (see `classes`).

    A null text is empty, texts without words are copies of each other; a null doc_id is NULL_ID; repeated rows
    stay; an empty table gives an empty result; other columns are not read.
    """
    rows, keep = classes(docs, words, similarity)
    return rows.join(keep.withColumnRenamed("keep", "rep"), "same").select("id", "same", "rep")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs (all columns) with one document of each class of near copies: that of the least doc_id.

    Texts without words are copies of each other. A null doc_id counts as the least; rows that share a doc_id
    stay or go together: they go if one of them is a copy of a lesser id. An empty table stays empty; other
    columns are carried along, whatever their names.
    """
    rows, keep = classes(docs, words, similarity)
    # a row stays if its id is that of its class; the join is by both, so that no group of copies meets in one task
    k = keep.select(F.col("same").alias("k_same"), F.col("keep").alias("k_id"))
    gone = rows.join(k, (F.col("id") == F.col("k_id")) & (F.col("same") == F.col("k_same")), "left_anti").select("id").distinct()
    name = "gone_id"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = written(gone.select(F.col("id").alias(name)), "gone")
    return docs.join(gone.hint("shuffle_hash"), doc_key() == F.col(name), "left_anti")
