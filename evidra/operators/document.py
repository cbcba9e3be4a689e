"""Screens of a candidate folded into one document: exact, fuzzy and historical overlap, with the lineage of each line.

The fold is sequential by nature and bounded: a candidate has at most eight matched screens of at most 256
lines (further screens and lines are kept, unmatched). Candidates are gathered by one shuffle on their key.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra import config

SEGMENT = "struct<normalized_text:string,comparison_text:string,box_ids:array<string>>"
EVIDENCE = "struct<match_id:string,match_type:string,screen_id:string,screen_index:int,current_lines:array<int>,document_lines:array<int>,score:double,exact_basis:string,risk:string>"
SCREEN_RESULT = (
    f"struct<screen_id:string,screen_index:int,is_formal:boolean,aggregation_status:string,warnings:array<string>,match_evidence:array<{EVIDENCE}>,matched:array<int>,new:array<int>,uncertain:array<int>,"
    "overlap_text:string,new_text:string,overlap_char_count:int,new_text_char_count:int,uncertain_char_count:int,overlap_segment_count:int,new_segment_count:int,certain_new_segment_count:int,"
    f"uncertain_segment_count:int,duplicate_risk:string,segments:array<{SEGMENT}>>"
)
DOCUMENT_SEGMENT = "struct<normalized_text:string,comparison_text:string,occurrences:array<struct<screen_id:string,screen_index:int,lines:array<int>,box_ids:array<string>,role:string,match_id:string>>>"
# How many document and screen lines a fuzzy group may hold.
SHAPES = ((1, 1), (1, 2), (2, 1))


@cache
def tilings(d: int, c: int) -> tuple[tuple[tuple[int, int], ...], ...]:
    """All ways to tile d document and c screen lines by SHAPES, in order."""
    if d == c == 0:
        return ((),)
    return tuple((s, *rest) for s in SHAPES if s[0] <= d and s[1] <= c for rest in tilings(d - s[0], c - s[1]))


class Group:
    """The likeness of a few document lines and a few screen lines."""

    def __init__(self, left: tuple[str, ...], right: tuple[str, ...], c: dict):
        a, b = "\n".join(left), "\n".join(right)
        self.left, self.right = sum(map(len, left)), sum(map(len, right))
        self.score, self.accepted, self.gray = 0.0, False, False
        equal = len(left) == len(right) == 1 and a == b
        if max(self.left, self.right) > c["fuzzy_max_group_char_count"]:
            self.gray = True
            return
        bound = 2.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b))
        if not equal and bound < c["fuzzy_uncertain_similarity_floor"]:
            self.score = bound  # no alignment can be better, and under the floor none counts
            return
        m = SequenceMatcher(None, a, b, autojunk=False)
        self.score = m.ratio()
        lost = [0, 0]
        for op, i, j, k, n in m.get_opcodes():
            if op != "equal":
                lost[0] += j - i - a.count("\n", i, j)
                lost[1] += n - k - b.count("\n", k, n)
        fits = min(self.left, self.right) >= c["fuzzy_min_char_count"] and max(lost) <= c["fuzzy_max_unmatched_chars_per_side"]
        self.accepted = not equal and fits and self.score >= c["fuzzy_similarity_threshold"]
        self.gray = equal or not self.accepted and self.score >= c["fuzzy_uncertain_similarity_floor"]


def fuzzy_overlap(tail: list[str], head: list[str], c: dict):
    """("accepted", tiling, groups), ("ambiguous" | "limit" | "gray" | "none", number of uncertain head lines)."""
    known: dict = {}
    found, gray, n = [], 0, 0
    for d in range(1, len(tail) + 1):
        for k in range(1, len(head) + 1):
            for tiling in tilings(d, k):
                n += 1
                if n > c["fuzzy_candidate_limit"]:
                    return "limit", len(head)
                groups, i, j = [], len(tail) - d, 0
                for x, y in tiling:
                    at = (i, i + x, j, j + y)
                    if at not in known:
                        known[at] = Group(tuple(tail[i : i + x]), tuple(head[j : j + y]), c)
                    groups.append(known[at])
                    i, j = i + x, j + y
                if all(g.accepted for g in groups):
                    weight = [max(g.left, g.right) for g in groups]
                    score = sum(g.score * w for g, w in zip(groups, weight)) / sum(weight)
                    left, right = sum(g.left for g in groups), sum(g.right for g in groups)
                    found.append(((-right, -k, -left, -score, len(groups), tiling), groups))
                if any(g.gray for g in groups):
                    gray = max(gray, k)
    if not found:
        return ("gray", gray) if gray else ("none", 0)
    found.sort(key=lambda f: f[0])
    best = found[0][0]
    tied = [f[0] for f in found[1:] if f[0][:3] == best[:3] and f[0][4] == best[4] and abs(f[0][3] - best[3]) <= c["fuzzy_tie_epsilon"]]
    if tied:
        return "ambiguous", -best[1]
    return "accepted", best[5], found[0][1]


def exact_overlap(doc: list[str], cur: list[str], c: dict):
    """(lines, basis) of the longest admissible equal tail and head; else (0, None) and the longest inadmissible in the third place."""
    bad = 0
    for k in range(min(len(doc), len(cur), c["max_screen_segments"]), 0, -1):
        if doc[-k:] != cur[:k]:
            continue
        sizes = [len(t) for t in cur[:k]]
        if k >= c["exact_min_segment_count"] and sum(sizes) >= c["exact_min_char_count"] and max(sizes) > c["short_segment_char_threshold"]:
            return k, "comparison_sequence_equal", 0
        if k == 1 == len(cur) and sizes[0] >= c["exact_single_segment_min_char_count"]:
            return 1, "single_full_screen_equal", 0
        bad = max(bad, k)
    return 0, None, bad


#: Bytes of an Arrow batch that become Python objects at once.
_AT_ONCE = 1 << 20


def pieces(batch: pa.RecordBatch, limit: int = _AT_ONCE):
    """A batch halved until its pieces hold `limit` bytes or one row: what Python holds does not grow with the rows of a batch."""
    if batch.num_rows > 1 and batch.nbytes > limit:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), limit)
        yield from pieces(batch.slice(half), limit)
    elif batch.num_rows:
        yield batch


def exact_overlaps(rows: DataFrame, before: str, after: str, c: dict = config.DOCUMENT) -> DataFrame:
    """rows with overlap_lines, overlap_basis, inadmissible_lines: how the comparison texts of `before` (array) end like those of `after` begin."""
    schema = T.StructType([*rows.schema.fields, T.StructField("overlap_lines", T.IntegerType()), T.StructField("overlap_basis", T.StringType()), T.StructField("inadmissible_lines", T.IntegerType())])
    i, j = rows.columns.index(before), rows.columns.index(after)

    def run(batches):
        for b in (piece for batch in batches for piece in pieces(batch)):
            got = [exact_overlap(x or [], y or [], c) for x, y in zip(b.column(i).to_pylist(), b.column(j).to_pylist())]
            k, basis, bad = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int32()), pa.array(basis, pa.string()), pa.array(bad, pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


class Fold:
    """The document of one candidate as its screens come."""

    def __init__(self, c: dict = config.DOCUMENT):
        self.c = c
        self.lines: list[dict] = []
        self.places: dict[tuple[str, ...], list[int]] = {}
        self.seen: dict[str, dict] = {}
        self.indexes: set = set()
        self.warnings: dict[str, None] = {}
        self.evidence: list[dict] = []
        self.formal = self.safe = self.matched = self.unsure = 0

    def _append(self, screen: dict, at: list[int], role: str) -> None:
        for k in at:
            s = screen["segments"][k]
            seen = {"screen_id": screen["screen_id"], "screen_index": screen["screen_index"], "lines": [k], "box_ids": s["box_ids"], "role": role, "match_id": None}
            self.lines.append({"normalized_text": s["normalized_text"], "comparison_text": s["comparison_text"], "occurrences": [seen]})
            for n in range(self.c["historical_min_segment_count"], self.c["historical_max_segment_count"] + 1):
                if len(self.lines) >= n:
                    self.places.setdefault(tuple(x["comparison_text"] for x in self.lines[-n:]), []).append(len(self.lines) - n)

    def _match(self, screen: dict, kind: str, cur: list[int], doc: list[int], order: int, score=None, basis=None, risk="none") -> dict:
        """Evidence of a match; its lines gain an occurrence. Equally many lines pair up, others share all sources."""
        segs = screen["segments"]
        e = {
            "match_id": f"match:{screen['screen_index']}:{order}", "match_type": kind, "screen_id": screen["screen_id"], "screen_index": screen["screen_index"],
            "current_lines": cur, "document_lines": doc, "score": score, "exact_basis": basis, "risk": risk,
        }
        for k, d in enumerate(doc):
            src = [cur[k]] if score is None else cur
            boxes = [i for s in src for i in segs[s]["box_ids"]]
            self.lines[d]["occurrences"].append({"screen_id": e["screen_id"], "screen_index": e["screen_index"], "lines": src, "box_ids": boxes, "role": "matched", "match_id": e["match_id"]})
        return e

    def _historical(self, screen: dict, rest: list[int], order: int):
        """Repeats of two to four lines anywhere before, anchored by an equal neighbour on each side."""
        c, keys = self.c, [screen["segments"][k]["comparison_text"] for k in rest]
        evidence, warn, taken, unsure, used = [], {}, set(), {}, set()
        hit: set[int] = set()
        if len(self.lines) < c["historical_min_segment_count"]:
            return evidence, hit, [], []
        text = [x["comparison_text"] for x in self.lines]
        for n in range(c["historical_max_segment_count"], c["historical_min_segment_count"] - 1, -1):
            for i in range(len(rest) - n + 1):
                span = range(i, i + n)
                group = tuple(keys[i : i + n])
                if taken.intersection(span) or sum(map(len, group)) < c["historical_min_char_count"] or min(map(len, group)) <= c["short_segment_char_threshold"]:
                    continue
                where = self.places.get(group, [])
                if not where:
                    continue
                h = where[0]
                anchored = 0 < i and 0 < h and i + n < len(keys) and h + n < len(text) and keys[i - 1] == text[h - 1] and keys[i + n] == text[h + n]
                if len(where) > 1:
                    code = "historical_duplicate_ambiguous"
                elif not anchored:
                    code = "historical_context_insufficient"
                elif any(len(self.lines[d]["occurrences"]) != 1 for d in range(h, h + n)):
                    code = "historical_duplicate_ambiguous"
                elif used.intersection(range(h, h + n)):
                    code = "historical_mapping_conflict"
                else:
                    evidence.append(("historical_exact", [rest[k] for k in span], list(range(h, h + n)), order + len(evidence)))
                    used.update(range(h, h + n))
                    hit.update(rest[k] for k in span)
                    taken.update(span)
                    continue
                warn[code] = None
                unsure |= {rest[k]: None for k in span}
                if code != "historical_context_insufficient":
                    taken.update(span)
        made = [self._match(screen, kind, cur, doc, k, basis="historical_sequence_with_context") for kind, cur, doc, k in evidence]
        return made, hit, [k for k in unsure if k not in hit], list(warn)

    def _whole_uncertain(self, screen: dict, code: str) -> dict:
        """All lines are kept as uncertain: text is never dropped."""
        if screen["normalization_status"] != "completed" or not self._mapped(screen):
            return self._failed("segment_mapping_invalid")
        self.safe += 1
        at = list(range(len(screen["segments"])))
        self._append(screen, at, "uncertain_origin")
        self.unsure += len(at)
        self.warnings[code] = None
        return {"aggregation_status": "partial", "warnings": [code], "match_evidence": [], "matched": [], "new": [], "uncertain": at}

    def _failed(self, code: str) -> dict:
        self.warnings[code] = None
        return {"aggregation_status": "failed", "warnings": [code], "match_evidence": [], "matched": [], "new": [], "uncertain": []}

    @staticmethod
    def _mapped(screen: dict) -> bool:
        return isinstance(screen["screen_index"], int) and screen["screen_index"] >= 1 and all(s["comparison_text"] and s["normalized_text"] for s in screen["segments"])

    def add(self, screen: dict, force: str | None = None) -> dict:
        """The result of a screen: its lines parted into matched, new and uncertain."""
        if not screen["is_formal"]:
            return {"aggregation_status": "not_attempted", "warnings": [], "match_evidence": [], "matched": [], "new": [], "uncertain": []}
        before = self.seen.get(screen["screen_id"])
        if force is None and before is not None and before["screen"] == screen:
            return before["result"]
        self.formal += 1
        if force is not None or before is not None:
            return self._whole_uncertain(screen, force or "duplicate_screen_id_conflict")
        result = self._add(screen)
        self.seen[screen["screen_id"]] = {"screen": screen, "result": result}
        return result

    def _add(self, screen: dict) -> dict:
        c, index, segs = self.c, screen["screen_index"], screen["segments"]
        if len(segs) > c["max_screen_segments"]:
            return self._whole_uncertain(screen, "screen_segment_limit_exceeded")
        if index is None or not 1 <= index <= c["max_formal_screen_count"]:
            return self._whole_uncertain(screen, "formal_screen_index_invalid")
        if index in self.indexes:
            return self._whole_uncertain(screen, "duplicate_formal_screen_index")
        self.indexes.add(index)
        if index != len(self.indexes):
            return self._whole_uncertain(screen, "formal_screen_out_of_order")
        if screen["normalization_status"] != "completed":
            return self._failed("r04_not_completed")
        if not self._mapped(screen):
            return self._failed("segment_mapping_invalid")
        self.safe += 1
        keys = [s["comparison_text"] for s in segs]
        rest, doubt, warn, evidence = list(range(len(segs))), set(), [], []
        doc = [x["comparison_text"] for x in self.lines]
        k, basis, bad = exact_overlap(doc, keys, c)
        if k:
            evidence.append(self._match(screen, "adjacent_exact", rest[:k], list(range(len(doc) - k, len(doc))), 0, basis=basis))
            rest = rest[k:]
        else:
            doubt.update(rest[:bad])
            warn += ["screen_aggregation_partial"] * bool(bad)
            tail, head = doc[-c["fuzzy_max_tail_segments"] :], keys[: c["fuzzy_max_head_segments"]]
            what, *more = fuzzy_overlap(tail, head, c) if doc and keys else ("none", 0)
            if what == "accepted":
                tiling, groups = more
                i, j = len(doc) - sum(s[0] for s in tiling), 0
                for n, ((x, y), g) in enumerate(zip(tiling, groups)):
                    evidence.append(self._match(screen, f"adjacent_fuzzy_{x}_{y}", list(range(j, j + y)), list(range(i, i + x)), n, score=g.score, risk="low"))
                    i, j = i + x, j + y
                rest = rest[j:]
            elif more[0]:
                doubt.update(rest[: more[0]])
                warn.append("screen_aggregation_partial")
        sure = [r for r in rest if r not in doubt]
        made, hit, unsure, codes = self._historical(screen, sure, len(evidence)) if sure else ([], set(), [], [])
        evidence += made
        warn += codes
        doubt.update(unsure)
        rest = [r for r in rest if r not in hit]
        uncertain, new = [r for r in rest if r in doubt], [r for r in rest if r not in doubt]
        self._append(screen, uncertain, "uncertain_origin")
        self._append(screen, new, "origin")
        self.matched += sum(len(e["current_lines"]) for e in evidence)
        self.unsure += len(uncertain)
        self.evidence += evidence
        self.warnings |= dict.fromkeys(warn)
        matched = sorted({n for e in evidence for n in e["current_lines"]})
        return {"aggregation_status": "partial" if warn or uncertain else "completed", "warnings": list(dict.fromkeys(warn)), "match_evidence": evidence, "matched": matched, "new": new, "uncertain": uncertain}

    def document(self, capture_status: str | None) -> dict:
        partial = bool(self.warnings)
        stopped = {"aborted": "candidate_aborted", "interrupted": "candidate_interrupted"}.get(capture_status)
        if not self.formal:
            status = "not_attempted"
            self.warnings["no_formal_screen"] = None
            partial = True
        elif not self.safe:
            status = "failed"
        else:
            if stopped:
                self.warnings[stopped] = None
                partial = True
            status = "partial" if partial else "completed"
        lines = self.lines if self.formal and self.safe else []
        fuzzy = any(e["match_type"].startswith("adjacent_fuzzy") for e in self.evidence)
        return {
            "document_build_status": status, "document_text": "\n".join(x["normalized_text"] for x in lines) if status in ("partial", "completed") else None, "document_segments": lines,
            "document_warnings": list(self.warnings), "document_duplicate_risk": "elevated" if partial or self.unsure else "low" if fuzzy else "none",
            "formal_screen_count": self.formal, "matched_line_count": self.matched, "uncertain_line_count": self.unsure,
        }


def projected(screen: dict, r: dict) -> dict:
    """A screen's result with its texts, counts and risk."""
    out = {"screen_id": screen["screen_id"], "screen_index": screen["screen_index"], "is_formal": screen["is_formal"], "segments": screen["segments"], **r}
    names = ("overlap_text", "new_text", "overlap_char_count", "new_text_char_count", "uncertain_char_count", "overlap_segment_count", "new_segment_count", "certain_new_segment_count", "uncertain_segment_count")
    if r["aggregation_status"] in ("not_attempted", "failed"):
        return out | dict.fromkeys(names) | {"duplicate_risk": "elevated" if r["aggregation_status"] == "failed" else None}
    segs = screen["segments"]

    def text(at):
        return "\n".join(segs[k]["normalized_text"] for k in at), sum(len(segs[k]["comparison_text"]) for k in at)

    (over, over_n), (new, new_n) = text(r["matched"]), text(r["new"] + r["uncertain"])
    risk = "elevated" if r["aggregation_status"] == "partial" else "low" if any(e["risk"] == "low" for e in r["match_evidence"]) else "none"
    values = (over, new, over_n, new_n, text(r["uncertain"])[1], len(r["matched"]), len(r["new"]) + len(r["uncertain"]), len(r["new"]), len(r["uncertain"]))
    return out | dict(zip(names, values)) | {"duplicate_risk": risk}


#: Why a stored screen is not trusted in its place.
DISTRUST = ("duplicate_screen_id_conflict", "duplicate_formal_screen_index", "formal_screen_out_of_order")


def distrusted(screens: list[dict]) -> dict[int, str]:
    """Places of formal screens that are not trusted, and why.

    One screen out of order (none above the index before) makes all formal screens suspect, as does a missing
    index its own screen; a second screen of an index or another one of an id is named so.
    """
    formal = [k for k, s in enumerate(screens) if s["is_formal"]]
    indexed = [k for k in formal if screens[k]["screen_index"] is not None]
    indexes = [screens[k]["screen_index"] for k in indexed]
    broken = any(b <= a for a, b in zip([0, *indexes], indexes))
    why = {k: "formal_screen_out_of_order" for k in formal if broken or screens[k]["screen_index"] is None}
    first_of_index: dict[int, int] = {}
    first_of_id: dict[str, int] = {}
    for k in indexed:
        if first_of_index.setdefault(screens[k]["screen_index"], k) != k:
            why[k] = "duplicate_formal_screen_index"
        if screens[first_of_id.setdefault(screens[k]["screen_id"], k)] != screens[k]:
            why[k] = "duplicate_screen_id_conflict"
    return why


def fold(screens: list[dict], capture_status: str | None, c: dict = config.DOCUMENT, tolerant: bool = False) -> dict:
    """The document of a candidate's screens and each screen's result, in the order of screens.

    `tolerant` rebuilds stored candidates: screens are taken by index, those without one first, and the
    distrusted ones (see above) keep all their lines as uncertain.
    """
    f, why, order = Fold(c), {}, list(range(len(screens)))
    if tolerant and (why := distrusted(screens)):
        order.sort(key=lambda k: -1 if screens[k]["screen_index"] is None else screens[k]["screen_index"])
    done = {k: projected(screens[k], f.add(screens[k], why.get(k))) for k in order}
    return f.document(capture_status) | {"screens": [done[k] for k in range(len(screens))]}


RESULT = (
    f"document_build_status string, document_text string, document_segments array<{DOCUMENT_SEGMENT}>, document_warnings array<string>, document_duplicate_risk string,"
    f" formal_screen_count int, matched_line_count int, uncertain_line_count int, screens array<{SCREEN_RESULT}>"
)


_SCREEN = ("screen_id", "screen_index", "is_formal", "normalization_status", "segments")


def gather(screens: DataFrame, keys: tuple[str, ...] = ("run_id", "candidate_record_id"), order: str = "screen_index") -> DataFrame:
    """One row per candidate of screens: keys, capture_status and screens, in the order of `order`."""
    status = F.max("capture_status") if "capture_status" in screens.columns else F.lit(None).cast("string")
    per = screens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), *_SCREEN))).alias("_s"), status.alias("capture_status"))
    return per.select(*keys, "capture_status", F.transform("_s", lambda s: F.struct(*(s[c].alias(c) for c in _SCREEN))).alias("screens"))


def build_documents(screens: DataFrame, keys: tuple[str, ...] = ("run_id", "candidate_record_id"), order: str = "screen_index", c: dict = config.DOCUMENT, tolerant: bool = False) -> DataFrame:
    """One row per candidate of screens (keys, screen_id, screen_index, is_formal, normalization_status, segments, capture_status).

    `segments` is an array of SEGMENT, `order` the column by which screens came. Columns: keys and RESULT.
    """
    return fold_candidates(gather(screens, keys, order), keys, c, tolerant)


def fold_candidates(candidates: DataFrame, keys: tuple[str, ...] = ("run_id", "candidate_record_id"), c: dict = config.DOCUMENT, tolerant: bool = False, columns: tuple[str, ...] | None = None) -> DataFrame:
    """build_documents of candidates whose screens are gathered (see above): no shuffle. columns: those of RESULT that are handed on (all)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    status = F.col("capture_status") if "capture_status" in candidates.columns else F.lit(None).cast("string")
    per = candidates.select(*keys, F.col("screens").alias("_screens"), status.alias("_status"))
    names = list(keys)
    kinds = [(k, per.schema[k].dataType) for k in keys] + [(f.name, f.dataType) for f in _parse_datatype_string(RESULT).fields if columns is None or f.name in columns]
    schema = T.StructType([T.StructField(n, t) for n, t in kinds])

    def run(batches):
        arrow = to_arrow_schema(schema)
        for b in (piece for batch in batches for piece in pieces(batch)):
            rows = []
            for r in b.to_pylist():
                group = [{k: s[k] for k in _SCREEN} | {"segments": s["segments"] or [], "is_formal": bool(s["is_formal"])} for s in r["_screens"] or []]
                rows.append({k: r[k] for k in names} | fold(group, r["_status"], c, tolerant))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return per.mapInArrow(run, schema)
