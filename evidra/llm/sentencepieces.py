"""SentencePiece models on the tokenizers library: the model file is parsed and its parts rebuilt."""

from __future__ import annotations

import os
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import byte_chunks, documents, trim

MARK = "▁"
# Piece types and model types of the SentencePiece file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Code points of a slice of a long text, bytes of texts that are encoded together, and the library's threads in a
#: worker: encodings take many times the memory of their texts, and executors run several workers.
SLICE, BATCH_BYTES, THREADS = 1 << 17, 1 << 18, 2


def fields(data: bytes):
    """(number, value) of a protobuf message: integers for varints, bytes for the others."""
    at = 0

    def varint():
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """What a model file says: pieces with scores and types, the normaliser and the trainer's switches."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        self.kind, self.byte_fallback = UNIGRAM, False
        for number, value in fields(data):
            if number == 1:
                f = dict(fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(fields(value))
                self.kind, self.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(fields(value))
                self.charsmap, self.dummy_prefix, self.squeeze, self.escape = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        """The pairs that make each piece, best pieces first: a BPE model merges the pair whose piece scores highest."""
        vocab = {p for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED, UNUSED)}
        out = []
        for i, (p, score, t) in enumerate(self.pieces):
            if t == NORMAL:
                out += [((-score, i, k), (p[:k], p[k:])) for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab]
        return [pair for _, pair in sorted(out)]

    def scores(self) -> list[tuple[str, float]]:
        """Pieces and scores of a unigram model.

        User-defined pieces score a little under their bytes times the best score (0 where all are negative), as the
        library has it, so that they nearly always win. Control pieces get names that no text holds, and pieces
        that are not scored the least score.
        """
        normal = [s for _, s, t in self.pieces if t == NORMAL]
        low, top = min(normal, default=0.0), max([0.0, *normal])
        score = {NORMAL: lambda p, s: s, USER_DEFINED: lambda p, s: len(p.encode()) * top - 0.1}
        return [(p if t in (NORMAL, USER_DEFINED, BYTE, UNKNOWN) else f"\0{p}", score[t](p, s) if t in score else low) for p, s, t in self.pieces]

    def tokenizer(self):
        """A tokenizer of the tokenizers library with the same pieces for the same text."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        own = [p for p, _, t in self.pieces if t == USER_DEFINED]
        if self.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            model = models.Unigram(self.scores(), self.unknown, self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are known")
        tok = Tokenizer(model)
        if own and self.kind == BPE:  # user-defined pieces are taken first, the longest at each place, and never merged
            tok.add_tokens([AddedToken(p, normalized=False) for p in own])
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if steps:
            tok.normalizer = normalizers.Sequence(steps)
        if self.units_are_safe():
            # the text comes with marks for blanks; a piece has marks at its start only, so it never spans the end of a unit
            tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        return tok

    def units_are_safe(self) -> bool:
        return all(MARK not in p.lstrip(MARK) for p, _, t in self.pieces if t in (NORMAL, USER_DEFINED))


#: Texts on which a model is held against the sentencepiece library when it is loaded.
PROBES = ["", " ", "Hello  world. ", "1234 a1b2, x=y;", "naïve café ﬁne \u00a0x", "中文字 かな 한글", "😀👍🏽 \u200d", "\t\n\r mixed\x00", "aaaa bbbb $$$$ ----", "<s> </s> <unk> <0x41>", "▁▁a ▁b"]


def own_probes(model: Model) -> list[str]:
    """Texts with the first user-defined pieces of a model."""
    own = [p.replace(MARK, " ") for p, _, t in model.pieces if t == USER_DEFINED][:20]
    return [f"a{p}b {p}{p} x" for p in own] + ["".join(own), " ".join(own)] * bool(own)


class Codec:
    """Encodes and decodes texts by batches; texts are cut, if they are long, where no piece can span.

    A model whose pieces differ from those of the sentencepiece library on PROBES is refused.
    """

    CUT = re.compile(f"(?<=[^{MARK}]){MARK}")

    def __init__(self, path: str, check: bool = True):
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        with open(path, "rb") as f:
            self.model = Model(f.read())
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.tok = self.model.tokenizer()
        self.safe = self.model.units_are_safe()
        self.out = [p.replace(MARK, " ").encode() if t in (NORMAL, USER_DEFINED, UNUSED) else b"" for p, _, t in self.model.pieces]
        for i, (p, _, t) in enumerate(self.model.pieces):
            if t == BYTE:
                self.out[i] = bytes([int(p[1:-1], 16)])
            elif t == UNKNOWN:
                self.out[i] = " ⁇ ".encode()
        #: The library itself, for unigram models: see `encode`.
        self.library = None
        if check:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            probes = [*PROBES, *own_probes(self.model)]
            if self.model.kind == UNIGRAM:
                self.library = library
            elif self.encode(probes) != library.encode(probes):
                raise ValueError("the model's pieces are not those of the sentencepiece library")

    def _marked(self, texts: list[str]) -> list[str]:
        """Normalised texts with marks: a leading blank is put in front (of texts that are not empty), blanks are marks."""
        if self.tok.normalizer is not None:
            texts = [self.tok.normalizer.normalize_str(t) for t in texts]
        if self.model.dummy_prefix:
            texts = [" " + t if t else t for t in texts]
        return [t.replace(" ", MARK) for t in texts] if self.model.escape else texts

    def _raw(self, marked: list[str]) -> list[list[int]]:
        """Pieces of marked texts by the library, multithreaded; they are normalised already."""
        keep, self.tok.normalizer = self.tok.normalizer, None
        try:
            return [e.ids for e in self.tok.encode_batch_fast(marked, add_special_tokens=False)]
        finally:
            if keep is not None:
                self.tok.normalizer = keep

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts, owner = [], []
        for i, t in enumerate(self._marked(texts)):
            pos = 0
            while self.safe and len(t) - pos > SLICE and (m := self.CUT.search(t, pos + SLICE)):
                parts.append(t[pos : m.start()])
                owner.append(i)
                pos = m.start()
            parts.append(t[pos:] if pos else t)
            owner.append(i)
        out: list[list[int]] = [[] for _ in texts]
        for i, ids in zip(owner, self._raw(parts)):
            out[i] = out[i] + ids if out[i] else ids
        if self.library is not None:
            # unigram paths of equal score fall as single precision has it in the library, as double precision has it here: every text is checked
            want = self.library.encode(texts, num_threads=THREADS)
            score = [s for _, s in self.model.scores()]
            for x, y in zip(out, want):
                if x != y and abs(sum(score[i] for i in x) - sum(score[i] for i in y)) > 1e-4 * (1 + len(y)):
                    raise ValueError("the model's pieces are not those of the sentencepiece library")
            out = want
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of pieces: marks are blanks, runs of bytes are UTF-8 (what is not is U+FFFD), the blank put in front goes."""
        table, out = self.out, []
        for row in ids:
            t = b"".join([table[i] for i in row]).decode("utf-8", "replace")
            out.append(t[1:] if self.model.dummy_prefix and t[:1] == " " else t)
        return out


def _checked(path: str) -> bool:
    """Hold the model against the library once, on the driver; whether workers must check every text (unigram models)."""
    return Codec(path).library is not None


def encode(docs: DataFrame, path: str = "piece_bpe_32k.model", decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>, and with `decoded` decoded_text) for every row of docs (doc_id, text).

    The ids are those of the SentencePiece library for the whole text, without begin or end marks. A null
    or empty text has none and decodes to "". A null doc_id stays; repeated rows are encoded alike; an empty
    table gives an empty result; other columns are not read. No shuffle.
    """

    check = _checked(path)

    def run(batches):
        codec = Codec(path, check)
        for whole in batches:
            for b in byte_chunks(whole, 1, BATCH_BYTES):
                ids = codec.encode([t or "" for t in b.column(1).to_pylist()])
                cols, names = [b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                if decoded:
                    cols.append(pa.array(codec.decode(ids), pa.string()))
                    names.append("decoded_text")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        del codec
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + (", decoded_text string" if decoded else ""))


def encode_checked(docs: DataFrame, path: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_pieces, ids, whole) for every row of docs (doc_id, text); whole: the ids decode to the text. Else as `encode`."""

    check = _checked(path)

    def run(batches):
        codec = Codec(path, check)
        for whole in batches:
            for b in byte_chunks(whole, 1, BATCH_BYTES):
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids = codec.encode(texts)
                same = [x == t for x, t in zip(codec.decode(ids), texts)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "whole"])
        del codec
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, whole boolean")


def decode(rows: DataFrame, path: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids decode to ""."""

    def run(batches):
        codec = Codec(path, False)
        for b in batches:
            texts = codec.decode([i or [] for i in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op8_sentencepiece(spark, sf_dir):
    """doc_id, n_pieces, ids_hash (XXH64 of the ids), decoded_sha256 of every document."""
    out = encode(documents(spark, sf_dir), decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded_text", 256).alias("decoded_sha256"))
