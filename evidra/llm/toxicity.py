"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import byte_chunks, documents, trim
from evidra.llm.quality_rules import platt
from evidra.llm.textstats import crc_rest, labelled_sample, mix64, one_label, sigmoid

#: Tokens of a window and from one window's start to the next: every text is covered, with overlap.
WINDOW, STRIDE = 48, 36
#: Rows of each input table (words; groups of three characters) as a power of two, input width, hidden width.
BITS, WIDE, HIDDEN = 14, 8, 8
#: Words of more code points are cut into pieces of PIECE that begin every PIECE - OVERLAP.
PIECE, OVERLAP = 24, 8
#: Code points of a text that are made tokens at once: what a worker holds of a very long text is its tokens.
SLICE = 1 << 20
#: Labelled rows of each label that the network is fitted on, and the longest of them in code points.
PER_LABEL, MAX_CHARS = 900, 12_000
#: Labels of rows with this remainder of crc32(doc_id) by 4 are never learnt.
HELD_OUT = (4, 2)
#: Words (slots) of fewer training texts than this have no vector of their own.
MIN_TEXTS = 5
#: Share of toxic texts that probabilities are calibrated to.
PRIOR = 0.2

_WORD = np.zeros(128, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PLACE = mix64(np.arange(1, PIECE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _spans(text: str):
    """Slices of a text of at most about SLICE code points, cut behind a blank where there is one near."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.rfind(" ", at + SLICE // 2, at + SLICE) + 1 or at + SLICE
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class Tokens:
    """The tokens of several texts, and the inputs of the different ones.

    A token is a run of letters and digits (all of ASCII's others, U+0080 to U+00BF, general punctuation and
    CJK punctuation part tokens), A-Z lower-cased, or a piece of a longer run. `text` and `which` give each
    token's text and its row of inputs; row k has a slot of the word table, and of the character table a slot
    for every character with its two neighbours (slots start[k]:start[k + 1] of `chars`).
    """

    def __init__(self, texts: list[str | None]):
        parts, known = [], 0
        group, size = [], 0
        for k, t in enumerate(texts):
            for s in _spans(t or ""):
                if group and size + len(s) > SLICE:
                    parts.append(self._part(group, known))
                    known += len(parts[-1][2])
                    group, size = [], 0
                group.append((k, s))
                size += len(s)
        parts.append(self._part(group, known))
        text, which, word, count, chars = zip(*parts)
        self.n = len(texts)
        self.text, self.which, self.word, self.chars = map(np.concatenate, (text, which, word, chars))
        self.count = np.concatenate(count)
        self.start = np.concatenate([[0], np.cumsum(self.count)])
        self.sizes = np.bincount(self.text, minlength=self.n)

    @staticmethod
    def _part(group: list[tuple[int, str]], known: int):
        points = np.frombuffer(("\n" + "\n".join(s for _, s in group) + "\n").encode("utf-32-le"), np.uint32)
        low = points + np.uint32(32) * ((points >= 65) & (points <= 90))
        inside = np.where(points < 128, _WORD[np.minimum(points, 127)], (points > 0xBF) & ((points < 0x2000) | (points > 0x206F)) & ((points < 0x3000) | (points > 0x303F)))
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        begin, size = edge[::2], edge[1::2] - edge[::2]
        if (size > PIECE).any():
            n = 1 + np.maximum(0, -(-(size - PIECE) // (PIECE - OVERLAP)))
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            end = np.repeat(begin + size, n)
            begin = np.repeat(begin, n) + k * (PIECE - OVERLAP)
            size = np.minimum(PIECE, end - begin)
        bound = np.cumsum([1 + len(s) for _, s in group])
        text = np.array([k for k, _ in group], np.int64)[np.searchsorted(bound, begin)]
        # a hash of each token, over its characters in their places
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        if len(begin):
            value = (low[np.repeat(begin, size) + place].astype(np.uint64) + np.uint64(1)) * _PLACE[place]
            hashes = mix64(np.add.reduceat(value, np.cumsum(size) - size))
        else:
            hashes = np.zeros(0, np.uint64)
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        b, n = begin[first], size[first]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(b, n) + place
        c = low[at]
        left = np.where(place == 0, np.uint32(1), low[at - 1])
        right = np.where(place == np.repeat(n, n) - 1, np.uint32(2), low[at + 1])
        h = mix64((left.astype(np.uint64) * np.uint64(0x1F1F1F) + c) * np.uint64(0x1F1F1F) + right)
        mask = np.uint64((1 << BITS) - 1)
        return text, (which + known).astype(np.int32), (kinds & mask).astype(np.int32), n, (h & mask).astype(np.int32)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All overlapping windows: first token, number of tokens, text. A text without tokens has none."""
        n = self.sizes
        count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
        text = np.repeat(np.arange(self.n), count)
        k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        begin = np.cumsum(n) - n
        first = begin[text] + k * STRIDE
        return first, np.minimum(WINDOW, begin[text] + n[text] - first), text


def _gate(x):
    return np.clip(0.25 * x + 0.5, 0, 1)


def _state(x):
    return x / (1 + np.abs(x))


class Network:
    """Embeddings of a token's word and characters; a GRU each way (hard sigmoid gates, softsign states); attention; a logit."""

    def __init__(self, seed: int = 9):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {"word": r.normal(0, 0.1, (1 << BITS, WIDE)), "char": r.normal(0, 0.1, (1 << BITS, WIDE))}
        for d in "fb":
            self.p["w" + d], self.p["u" + d], self.p["c" + d] = r.normal(0, 0.4, (WIDE, 3 * h)), r.normal(0, 0.3, (h, 3 * h)), np.zeros(3 * h)
        self.p |= {"att": r.normal(0, 0.3, 2 * h), "out": r.normal(0, 0.3, 2 * h), "bias": np.array([-1.0])}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.slope, self.shift = 1.0, 0.0
        #: Slots of words that count; words of others are read by their characters alone.
        self.known = np.ones(1 << BITS, bool)

    def _ragged(self, t: Tokens, rows: np.ndarray):
        """Characters of rows: their slots, the row of each (0, 1, ...), and its share."""
        n = t.count[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        at = np.repeat(t.start[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return t.chars[at], owner, np.repeat((n**-0.5).astype(np.float32), n)

    def _embed(self, t: Tokens, rows: np.ndarray) -> np.ndarray:
        """Inputs of rows of tokens: the word's vector and the sum of the characters' over the root of their number."""
        x = self.p["word"][t.word[rows]] * self.known[t.word[rows]][:, None]
        if not len(rows):
            return x
        n = t.count[rows]
        slots, _, _ = self._ragged(t, rows)
        return x + np.add.reduceat(self.p["char"][slots], np.cumsum(n) - n) * (n**-0.5).astype(np.float32)[:, None]

    def _run(self, pre, mask, u, keep=None):
        """States of one direction, (steps, windows, hidden); pre: (steps, windows, 3 hidden)."""
        h = HIDDEN
        s = np.zeros((pre.shape[1], h), np.float32)
        out = np.empty((pre.shape[0], pre.shape[1], h), np.float32)
        for t in range(pre.shape[0]):
            a = s @ u
            g = _gate(pre[t, :, : 2 * h] + a[:, : 2 * h])
            z, r = g[:, :h], g[:, h:]
            c = pre[t, :, 2 * h :] + r * a[:, 2 * h :]
            n = _state(c)
            new = n + z * (s - n)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((s, a, z, r, c, n, m))
            s = np.where(m, new, s)
            out[t] = s
        return out

    def _forward(self, x, at, mask, keep=None):
        """Logits of windows: `at` (windows, steps) are rows of x, mask (windows, steps)."""
        m = mask.T
        hs = []
        for d, way in (("f", slice(None)), ("b", slice(None, None, -1))):
            gates = x @ self.p["w" + d] + self.p["c" + d]
            k = None if keep is None else keep.setdefault(d, [])
            hs.append(self._run(gates[at.T[way]], m[way], self.p["u" + d], k)[way])
        h = np.concatenate(hs, 2)
        e = np.where(m, h @ self.p["att"], -1e9)
        e = np.exp(e - e.max(0))
        a = e / e.sum(0)
        ctx = (a[:, :, None] * h).sum(0)
        if keep is not None:
            keep |= {"h": h, "a": a, "ctx": ctx}
        return ctx @ self.p["out"] + self.p["bias"][0]

    def _places(self, first, size):
        mask = np.arange(WINDOW) < size[:, None]
        return np.where(mask, first[:, None] + np.arange(WINDOW), first[:, None]), mask

    def window_logits(self, t: Tokens, first, size, step: int = 2048):
        out = np.zeros(len(first), np.float32)
        for i in range(0, len(first), step):
            at, mask = self._places(first[i : i + step], size[i : i + step])
            rows, at = np.unique(t.which[at], return_inverse=True)
            out[i : i + step] = self._forward(self._embed(t, rows), at.reshape(mask.shape), mask)
        return out

    def tops(self, t: Tokens) -> np.ndarray:
        """The highest logit of each text's windows; without windows one below the bias."""
        first, size, text = t.windows()
        best = np.full(t.n, -np.inf)
        np.maximum.at(best, text, self.window_logits(t, first, size))
        return np.where(np.isfinite(best), best, self.p["bias"][0] - 4.0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text: of its highest window; a text without tokens gets that of the bias alone."""
        return sigmoid(self.slope * self.tops(Tokens(texts)) + self.shift)

    def gradient(self, t: Tokens, first, size, y, weight):
        """Gradients of the weighted log loss by back-propagation through time."""
        p, h = self.p, HIDDEN
        at, mask = self._places(first, size)
        rows, at = np.unique(t.which[at], return_inverse=True)
        at = at.reshape(mask.shape)
        x = self._embed(t, rows)
        k: dict = {}
        z = self._forward(x, at, mask, k)
        dz = ((sigmoid(z) - y) * weight).astype(np.float32)
        g = {"bias": np.array([dz.sum()]), "out": k["ctx"].T @ dz}
        dctx = dz[:, None] * p["out"]
        a, hid = k["a"], k["h"]
        da = (hid * dctx).sum(2)
        de = a * (da - (a * da).sum(0))
        dh = a[:, :, None] * dctx + de[:, :, None] * p["att"]
        g["att"] = np.einsum("tbh,tb->h", hid, de)
        dx = np.zeros_like(x)
        flat_at = at.reshape(-1)
        by = np.argsort(flat_at, kind="stable")
        cuts = np.searchsorted(flat_at[by], np.arange(len(rows)))
        for d, o in (("f", 0), ("b", h)):
            u, steps = p["u" + d], k[d]
            ds = np.zeros((len(y), h), np.float32)
            gu, dpre = np.zeros_like(u), np.zeros((WINDOW, len(y), 3 * h), np.float32)
            order = range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)
            for i, s in reversed(list(enumerate(order))):
                s0, aa, zz, rr, cc, nn, m = steps[i]
                ds = ds + dh[s, :, o : o + h]
                dn = ds * m
                dzz = dn * (s0 - nn) * 0.25 * ((zz > 0) & (zz < 1))
                dc = dn * (1 - zz) / (1 + np.abs(cc)) ** 2
                drr = dc * aa[:, 2 * h :] * 0.25 * ((rr > 0) & (rr < 1))
                da_ = np.concatenate([dzz, drr, dc * rr], 1)
                dpre[s] = np.concatenate([dzz, drr, dc], 1)
                gu += s0.T @ da_
                ds = ds * ~m + dn * zz + da_ @ u.T
            g["u" + d] = gu
            by_row = np.add.reduceat(dpre.transpose(1, 0, 2).reshape(-1, 3 * h)[by], cuts)
            g["w" + d], g["c" + d] = x.T @ by_row, by_row.sum(0)
            dx += by_row @ p["w" + d].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], t.word[rows], dx * self.known[t.word[rows]][:, None])
        slots, owner, share = self._ragged(t, rows)
        np.add.at(g["char"], slots, dx[owner] * share[:, None])
        return g


def _loss(top: np.ndarray, y: np.ndarray) -> float:
    """Log loss of texts by their highest logits, calibrated, both labels weighted equally."""
    slope, shift = platt(top, y)
    p = np.clip(sigmoid(slope * top + shift), 1e-6, 1 - 1e-6)
    return float(-(np.log(p[y == 1]).mean() + np.log(1 - p[y == 0]).mean()) / 2)


def fit(texts: list[str], y: list[int], rounds: int = 12, steps: int = 60, patience: int = 8, batch: int = 160, rate: float = 0.05) -> Network:
    """Fit on texts with labels by multiple-instance learning: a toxic text has some toxic window, a clean one none.

    A fifth of the texts validates. The first round draws windows of both labels alike; later ones take, of each
    toxic text, the windows that the network scores highest, and of clean texts half at random and half from those
    that it scores highest. After every half round the loss of the validating texts is taken; when it has not
    become better for `patience` times, or after all rounds, the best weights are kept. Platt's sigmoid, weighted
    to PRIOR, maps a text's highest logit to a probability. Warns if the validating texts are told apart no better
    than by chance.
    """
    net = Network()
    if len(set(y)) < 2:
        net.slope, net.shift = 0.0, 4.0 if sum(y) else -4.0
        return net
    y = np.array(y)
    t = Tokens(texts)
    first, size, text = t.windows()
    # words of few texts would be learnt by heart
    held = np.unique(t.text.astype(np.int64) << BITS | t.word[t.which])
    net.known = np.bincount(held & (1 << BITS) - 1, minlength=1 << BITS) >= MIN_TEXTS
    valid = np.zeros(len(y), bool)
    for label in (0, 1):
        valid[np.flatnonzero(y == label)[4::5]] = True
    if len(set(y[valid])) < 2:
        valid[:] = False
    check = valid if valid.any() else ~valid
    mine = ~valid[text]
    r = np.random.default_rng(3)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    best, best_p, waited, step = np.inf, net.p, 0, 0
    pos, neg = (np.flatnonzero(mine & (y[text] == c)) for c in (1, 0))
    if not len(pos) or not len(neg):
        return net
    of_check = np.flatnonzero(check[text])
    hard = neg
    for k in range(rounds):
        if k:
            score = net.window_logits(t, first, size)
            order = np.lexsort((-score, text))
            begin = np.searchsorted(text[order], text[order])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - begin
            many = np.bincount(text, minlength=len(y))[text]
            pos = np.flatnonzero(mine & (y[text] == 1) & (rank <= many // 4))
            hard = neg[np.argsort(-score[neg], kind="stable")[: max(batch, len(neg) // 10)]]
        for s in range(steps):
            step += 1
            pick = np.concatenate([r.choice(pos, batch // 2), r.choice(neg, batch // 4), r.choice(hard, batch // 4)])
            g = net.gradient(t, first[pick], size[pick], y[text[pick]], np.full(len(pick), 1 / len(pick)))
            for name, x in net.p.items():
                gk = g[name].astype(np.float32) + 1e-5 * x
                m[name] = 0.9 * m[name] + 0.1 * gk
                v[name] = 0.99 * v[name] + 0.01 * gk * gk
                net.p[name] = x - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)
            if s % 30 == 29:
                top = np.full(len(y), net.p["bias"][0] - 4.0)
                np.maximum.at(top, text[of_check], net.window_logits(t, first[of_check], size[of_check]))
                now = _loss(top[check], y[check])
                if now < best - 1e-3:
                    best, best_p, waited = now, dict(net.p), 0
                else:
                    waited += 1
                if waited >= patience:
                    break
        if waited >= patience:
            break
    net.p = best_p
    if best > 0.66:
        warnings.warn(f"the toxicity network has learnt nothing from {len(y)} texts (validation loss {best:.2f})", stacklevel=2)
    net.slope, net.shift = platt(net.tops(t), y, PRIOR)
    return net


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_chars: int = MAX_CHARS) -> Network:
    """The network of labels.toxic, fitted on a bounded sample of the rows that are not held out."""
    rows = labelled_sample(docs, one_label(labels, "toxic").where(crc_rest(HELD_OUT[0]) != HELD_OUT[1]), per_label, max_chars)
    return fit([r[0] for r in rows], [r[1] for r in rows])


def score(docs: DataFrame, net: Network, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text); scores come from the text alone.

    A text is scored by the highest of all its overlapping windows. A null or empty text has no window and
    gets a low score; a null doc_id stays and is not held out; repeated rows are scored alike; an empty table
    gives an empty result; other columns are not read. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for whole in batches:
            for b in byte_chunks(whole, 1):
                p = held.value.scores(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.astype(np.float64))], names=["doc_id", "score"])
        trim()

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(crc_rest(HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op9_toxicity_bigru(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
