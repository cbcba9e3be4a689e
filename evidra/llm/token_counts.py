"""Token counts: lengths of byte-level BPE encodings, by the tokenizers library, in Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from evidra.llm.common import byte_chunks, documents, trim

#: A unit is a run of white space and what follows up to the next safe boundary: the place between a
#: character that is not white space and a blank or line feed. No piece of a byte-level BPE pre-tokenizer
#: spans such a place (white space can only lead a piece), nor does an added token without white space.
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*|\s+")
CUT = re.compile(r"(?<=\S)[ \n]")
#: Units kept in a worker's memory (with their lengths; of those seen once, without), and the longest unit that is kept.
CACHE_UNITS, CACHE_CHARS = 300_000, 64


def load(path: str):
    """The tokenizer at `path`; a bare file name is looked up among the public tokenizer files."""
    from tokenizers import Tokenizer

    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def safe_slices(text: str, limit: int = 1 << 18):
    """Cut a text into slices of about `limit` code points at safe boundaries."""
    pos = 0
    while len(text) - pos > limit and (m := CUT.search(text, pos + limit)):
        yield text[pos : m.start()]
        pos = m.start()
    yield text[pos:] if pos else text


class Counter:
    """Counts tokens: units met before have known lengths; the new ones of a text are joined again and encoded.

    Units that begin with a blank or line feed and do not end in white space can be joined, for that gives
    safe boundaries between them. A unit that comes a second time is encoded on its own and kept.
    """

    def __init__(self, path: str, batch_bytes: int = 1 << 20):
        self.tok, self.known, self.once, self.batch_bytes = load(path), {}, set(), batch_bytes

    def _lengths(self, texts: list[str]) -> list[int]:
        """Lengths of the encodings, by batches of about batch_bytes."""
        out, part, size = [], [], 0
        for u in [*texts, None]:
            n = 0 if u is None else len(u) if u.isascii() else len(u.encode())
            if part and (u is None or size + n > self.batch_bytes):
                out += map(len, self.tok.encode_batch_fast(part, add_special_tokens=False))
                part, size = [], 0
            if u is not None:
                part.append(u)
                size += n
        return out

    def counts(self, texts: list[str]) -> list[int]:
        out, known, once = [0] * len(texts), self.known, self.once
        rest: list[str] = []
        owner: list[int] = []
        again: dict[str, None] = {}
        later: list[tuple[int, str]] = []
        for i, t in enumerate(texts):
            for s in safe_slices(t):
                n, new = 0, []
                for u in UNIT.findall(s):
                    if u in known:
                        n += known[u]
                    elif u in once:
                        again[u] = None
                        later.append((i, u))
                    else:
                        if len(u) <= CACHE_CHARS:
                            once.add(u)
                        if u[0] in " \n" and not u[-1].isspace():
                            new.append(u)
                        else:
                            rest.append(u)
                            owner.append(i)
                out[i] += n
                if new:
                    rest.append("".join(new))
                    owner.append(i)
        for i, k in zip(owner, self._lengths(rest)):
            out[i] += k
        if again:
            got = dict(zip(again, self._lengths(list(again))))
            for i, u in later:
                out[i] += got[u]
            if len(known) + len(got) > CACHE_UNITS:
                known.clear()
            known.update(got)
        if len(once) > CACHE_UNITS:
            once.clear()
        return out


def token_counts(docs: DataFrame, path: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of `docs` (doc_id, text); no shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null; repeated rows give repeated
    results. Added tokens (such as an end-of-text mark) that occur in a text are single tokens, as the
    library has it by default. Long texts are cut at safe boundaries only, so the counts are those of the
    whole text. An empty table gives an empty result; columns besides doc_id and text are not read.
    """

    def count(batches):
        counter = Counter(path)
        for whole in batches:
            for b in byte_chunks(whole, 1):
                texts = [t or "" for t in b.column(1).to_pylist()]
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )
        del counter
        trim()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir):
    return token_counts(documents(spark, sf_dir))
