"""Text functions as columns. Python runs only for characters that Unicode normalisation can change."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.config import NOVELTY, SIMHASH_PREFIX

#: White space of all code points, as Python's str.isspace has it.
SPACE = r"(?U)[\s\x1c-\x1f]"
TOKEN = r"(?U)[\w.+#/\-]+"


def arrow(schema: str):
    """A vectorised function that becomes a UDF when it is called, so that modules import without a session."""

    def made(f):
        return lambda *columns: F.pandas_udf(f, schema)(*columns)

    return made


#: Bytes of the texts that a function works on at once.
_AT_ONCE = 1 << 18


def _groups(sizes, limit: int = _AT_ONCE):
    """Ranges of items that hold about `limit` characters (one item at least)."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def bounded(schema: str):
    """A function of lists of texts that becomes a UDF when it is called, so that modules import without a session.

    It gets about _AT_ONCE bytes of an Arrow batch at a time, and its values go into Arrow arrays at once: a worker's
    memory does not depend on how many Python objects the rows of a batch would be. It returns a list or an Arrow array.
    """

    def made(f):
        def call(*columns):
            from pyspark.sql.pandas.types import to_arrow_type

            kind = to_arrow_type(T._parse_datatype_string(schema))

            def run(*texts: pa.Array) -> pa.Array:
                sizes = sum(pc.fill_null(pc.binary_length(t), 0).cast(pa.int64()).to_numpy() for t in texts)
                out = []
                for lo, hi in _groups(sizes.tolist()):
                    got = f(*(t.slice(lo, hi - lo).to_pylist() for t in texts))
                    out.append(got if isinstance(got, pa.Array) else pa.array(got, kind))
                return pa.concat_arrays(out) if out else pa.array([], kind)

            return F.arrow_udf(run, schema)(*columns)

        return call

    return made


def _normal(form: str):
    @bounded("string")
    def run(s: list) -> list:
        return [None if t is None else unicodedata.normalize(form, t) for t in s]

    return run


#: Code points among which those that a normal form leaves alone are looked for.
_BLOCKS = ((0, 0x24F), (0x370, 0x52F), (0x2010, 0x205E), (0x20A0, 0x20BF), (0x3001, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF))


@lru_cache
def _inert(form: str, without: str = "") -> str:
    """The inside of a class of characters that the normal form keeps and before which a text can be cut: they join with nothing before them."""
    joins = set()
    for k in range(0x110000):
        d = unicodedata.decomposition(chr(k))
        if d and d[0] != "<" and " " in d:
            joins.add(d.split()[1])
    joins = {chr(int(x, 16)) for x in joins}
    ok = lambda c: not unicodedata.combining(c) and unicodedata.normalize(form, c) == c and (d := unicodedata.normalize("NFD", c)[0]) not in joins and c not in joins and not unicodedata.combining(d)
    ranges: list[list[int]] = []
    for k in (k for lo, hi in _BLOCKS for k in range(lo, hi + 1) if chr(k) not in without and ok(chr(k))):
        if ranges and ranges[-1][1] == k - 1:
            ranges[-1][1] = k
        else:
            ranges.append([k, k])
    return "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges)


def normal_form(col: Column, form: str) -> Column:
    """Unicode normal form. Python sees only runs of characters that may change, each with the character before it.

    Runs are joined with line feeds, which no run holds and no normal form joins with others or makes.
    """
    run = f"[{_inert(form, chr(10))}]?[^{_inert(form)}]+"
    some = F.regexp_replace(col, "[\\x00-\\x7f]+", "").rlike(f"[^{_inert(form)}]")  # a class of many ranges is slow, so ASCII goes first
    runs = F.array_join(F.regexp_extract_all(col, F.lit(run), F.lit(0)), "\n")
    made = F.split(_normal(form)(F.when(some, runs)), "\n")
    return F.coalesce(F.array_join(F.zip_with(made, F.split(col, run), lambda m, t: F.concat(t, F.coalesce(m, F.lit("")))), ""), col)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+$", "")


def box_text(col: Column, normalise: bool = True) -> Column:
    """NFC, stripped, runs of white space as one blank."""
    return F.regexp_replace(strip(normal_form(col, "NFC") if normalise else col), SPACE + "+", " ")


def comparison_text(col: Column, normalise: bool = True) -> Column:
    """NFKC, lower case, no white space. `normalise=False` for text known to be in normal form keeps the plan free of Python."""
    return F.regexp_replace(F.lower(normal_form(col, "NFKC") if normalise else col), SPACE, "")


def fingerprint_text(col: Column) -> Column:
    """Stripped, runs of white space as one blank; no normal form."""
    return F.regexp_replace(strip(col), SPACE + "+", " ")


def protected_tokens(col: Column) -> Column:
    """Words with their symbols (letters, digits, _ . + # / -) that hold a letter or digit."""
    return F.filter(F.regexp_extract_all(col, F.lit(f"({TOKEN})"), 1), lambda t: t.rlike(r"(?U)[\p{L}\p{N}]"))


@bounded("array<struct<text:string,is_protected:boolean>>")
def _parts(s: list) -> pa.Array:
    import re

    pattern = re.compile(r"[\w.+#/\-]+")
    texts, marks, ends = [], [], []
    for t in s:
        ends.append(None if t is None else len(texts))
        at = 0
        for m in pattern.finditer(t or ""):
            if any(c.isalnum() for c in m[0]):
                if m.start() > at:
                    texts.append(t[at : m.start()])
                    marks.append(False)
                texts.append(m[0])
                marks.append(True)
                at = m.end()
        if at < len(t or ""):
            texts.append(t[at:])
            marks.append(False)
    parts = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(marks, pa.bool_())], ["text", "is_protected"])
    return pa.ListArray.from_arrays(pa.array([*ends, len(texts)], pa.int32()), parts)


def token_parts(col: Column) -> Column:
    """The text as parts, protected tokens marked; nothing is lost."""
    return _parts(col)


def joined_parts(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p.text), "")


def raw_text(boxes: Column, engine: Column) -> Column:
    """(raw_text, source): the engine's text as it is, or the boxes' by (original_index, box_id) with line feeds."""
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(b.original_index.alias("i"), b.box_id.alias("id"), b.raw_text.alias("t"))))
    own = F.array_join(F.transform(ordered, lambda b: b.t), "\n")
    source = F.when(engine.isNotNull(), "engine_screen_text").otherwise("derived_from_box_raw_text")
    return F.struct(F.coalesce(engine, own).alias("text"), source.alias("source"))


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def content_chars(col: Column) -> Column:
    """Length without line feeds."""
    return F.length(F.translate(col, "\n", ""))


def char_count(comparison: Column) -> Column:
    """Length of a comparison text; fails where it holds white space, which none may."""
    return F.when(has_space(comparison), F.raise_error(F.lit("comparison text contains white space")).cast("int")).otherwise(F.length(comparison))


def has_space(col: Column) -> Column:
    return col.rlike(SPACE)


def offset_timestamp(col: Column) -> Column:
    """The instant of an ISO text with an offset (Z or +hh:mm); null for others."""
    ok = col.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d(:\d\d)?)$")
    return F.when(ok, F.try_to_timestamp(col))


def grams(col: Column, n: int) -> Column:
    """The character n-grams in order, repeats included; none for shorter texts."""
    return F.when(F.length(col) >= n, F.transform(F.sequence(F.lit(1), F.length(col) - (n - 1)), lambda i: F.substring(col, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _gram_ids(texts: list[str], n: int):
    """(text, id, place) of every n-gram of texts, for each size up to n: equal grams have equal ids; exact, for ids are made size by size."""
    import numpy as np

    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array(list(map(len, texts)), np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))  # characters from here to the text's end
    ids = points
    for k in range(1, n + 1):
        if k > 1:
            ids = np.unique(ids[: len(points) - k + 1] << 21 | points[k - 1 :], return_inverse=True)[1] if len(points) >= k else ids[:0]
        ok = np.flatnonzero(left[: len(ids)] >= k)
        yield k, owner[ok], ids[ok], ok


@bounded("struct<score:double,scores:array<struct<n:int,weight:double,left_count:int,right_count:int,dice:double>>,warning:string>")
def _dice(left: list, right: list) -> list:
    import numpy as np

    pairs = list(zip(left, right))
    limit = NOVELTY["max_comparison_text_length"]
    out: list = [(None, None, None)] * len(pairs)
    ready = []
    for k, (a, b) in enumerate(pairs):
        if a is None or b is None:
            continue
        if max(len(a), len(b)) > limit:
            out[k] = (None, [], "comparison_text_too_long")
        elif not a or not b:
            out[k] = (float(a == b), [], None)
        else:
            ready.append(k)
    weight = dict(zip(NOVELTY["ngram_sizes"], NOVELTY["ngram_weights"]))
    for lo, hi in _groups([len(pairs[k][0]) + len(pairs[k][1]) for k in ready]):
        mine = ready[lo:hi]
        n = len(mine)
        both = {}
        for size, owner, ids, _ in _gram_ids([pairs[k][0] for k in mine] + [pairs[k][1] for k in mine], max(weight)):
            if size in weight:
                key = owner % n << 32 | ids
                (x, m), (y, q) = (np.unique(key[side], return_counts=True) for side in (owner < n, owner >= n))
                shared, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                both[size] = np.bincount(shared >> 32, np.minimum(m[i], q[j]), n)
        for at, k in enumerate(mine):
            a, b = pairs[k]
            rows, top, total = [], 0.0, 0.0
            for size, w in weight.items():
                x, y = max(0, len(a) - size + 1), max(0, len(b) - size + 1)
                if x or y:
                    d = 2.0 * int(both[size][at]) / (x + y)
                    rows.append({"n": size, "weight": w, "left_count": x, "right_count": y, "dice": d})
                    top, total = top + w * d, total + w
            out[k] = (min(1.0, max(0.0, top / total)) if rows else float(a == b), rows, None)
    return [dict(zip(("score", "scores", "warning"), x)) for x in out]


def dice(left: Column, right: Column) -> Column:
    """Weighted multiset Dice of 2-, 3- and 4-grams: score, scores by n, warning for texts over the length limit."""
    return _dice(left, right)


@bounded("string")
def _simhash(s: list) -> list:
    import hashlib

    import numpy as np

    prefix = hashlib.sha256(SIMHASH_PREFIX.encode() + b"\0")

    def bits(grams) -> np.ndarray:
        raw = bytearray()
        for g in grams:
            h = prefix.copy()
            h.update(g.encode("utf-8", "surrogatepass"))
            raw += h.digest()[:8]
        return 2 * np.unpackbits(np.frombuffer(bytes(raw), np.uint8)).reshape(-1, 64).astype(np.int32) - 1

    out: list = [None] * len(s)
    ready = []
    for k, t in enumerate(s):
        if t and len(t) <= NOVELTY["max_comparison_text_length"]:
            if len(t) < 3:
                out[k] = np.packbits(bits([t])[0] > 0).tobytes().hex()
            else:
                ready.append((k, t))
    for lo, hi in _groups([len(t) for _, t in ready], _AT_ONCE // 4):  # a gram takes 64 votes
        texts = [t for _, t in ready[lo:hi]]
        whole = "".join(texts)
        *_, (_, owner, ids, place) = _gram_ids(texts, 3)
        kinds, first, ids = np.unique(ids, return_index=True, return_inverse=True)
        signs = bits([whole[p : p + 3] for p in place[first]])  # each different gram is hashed once
        pair, count = np.unique(owner << 32 | ids, return_counts=True)
        votes = np.add.reduceat(signs[pair & 0xFFFFFFFF] * count[:, None].astype(np.int32), np.searchsorted(pair >> 32, np.arange(len(texts))))
        for (k, _), v in zip(ready[lo:hi], np.packbits(votes > 0, axis=1)):
            out[k] = v.tobytes().hex()
    return out


def simhash(col: Column) -> Column:
    """64-bit SimHash of 3-grams by SHA-256; null for empty and over-long texts."""
    return _simhash(col)


def hamming(left: Column, right: Column) -> Column:
    """Differing bits of two 16-digit hex hashes."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("long")
    return F.bit_count(half(left, 1).bitwiseXOR(half(right, 1))) + F.bit_count(half(left, 9).bitwiseXOR(half(right, 9)))


def is_protected(comparison: Column, normalized: Column) -> Column:
    """Listed short terms, years, dates, ranges and versions, or any protected token."""
    terms = [t.casefold() for t in NOVELTY["business_short_terms"]]
    shapes = (
        r"^(19|20)\d{2}年?$",
        r"^(19|20)\d{2}[-/.年]\d{1,2}([-/.月]\d{1,2}日?)?$",
        r"^\d+([-~–—]\d+)+(年|月|天|小时|h|%)?$",
        r"(?i)^(v|version)?\d+(\.\d+){1,}([-+._][a-z0-9]+)?$",
    )
    # some protected token is there if and only if some letter or digit is that tokens can hold
    found = normalized.rlike(r"(?U)[\w&&[\p{L}\p{N}]]") | F.lower(comparison).isin(terms) | F.lower(normalized).isin(terms)
    for s in shapes:
        found = found | comparison.rlike(s)
    return found


def format_only(comparison: Column, normalized: Column) -> Column:
    """Not empty, not protected, and punctuation, separators and control characters only."""
    return format_chars(comparison) & ~is_protected(comparison, normalized)


def format_chars(comparison: Column) -> Column:
    """Not empty, and punctuation, separators and control characters only."""
    return comparison.rlike(r"^[\p{P}\p{Z}\p{C}]+$")


def has_content(comparison: Column) -> Column:
    return comparison.rlike(r"[\p{L}\p{Nd}\x{4e00}-\x{9fff}]")


def key(prefix: str, *parts) -> Column:
    """Identifiers such as match:2:0."""
    return F.concat_ws(":", F.lit(prefix), *[(p if isinstance(p, Column) else F.lit(p)).cast(T.StringType()) for p in parts])


def document_segment_id(order: Column) -> Column:
    """document:segment:n; null for negative orders."""
    return F.when(order >= 0, key("document:segment", order))


def match_id(screen_index: Column, order: Column) -> Column:
    """match:i:n; null where the index is under 1 or the order negative."""
    return F.when((screen_index >= 1) & (order >= 0), key("match", screen_index, order))
