"""Screens of recognised boxes: duplicate suppression, reading orders, text, fingerprints.

A screen is one row with its boxes in an array, so the order-dependent folds run in Arrow batches where the
rows are, without a shuffle. `gather` makes such rows of a flat table of boxes.
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from bisect import insort
from functools import lru_cache
from statistics import median

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra import config
from evidra.functions import text as txt

BOX = "struct<box_id:string,raw_text:string,confidence:double,bbox:string,original_index:int>"
# Characters that decide how fragments of a line are joined.
OPENING = "([{<（【《「『"
CLOSING = ")]}>）】》」』,.;:!?，。；：！？、%％"
CONNECTORS = "+#./-_\\"
CJK = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF))

_PAIR = "struct<left_box_id:string,right_box_id:string,iou:double,horizontal_overlap_ratio:double,vertical_overlap_ratio:double,center_distance_ratio:double,center_distance_size_ratio:double,width_similarity:double,height_similarity:double,size_similarity:double,decision:string,basis:array<string>>"
RESULT = (
    "normalization_status string, normalization_error_type string, raw_text string, raw_text_source string, normalized_text string, comparison_text string,"
    " lines array<struct<normalized_text:string,comparison_text:string,box_ids:array<string>>>, ordered_box_ids array<string>, excluded_empty_box_ids array<string>,"
    f" suppressed_duplicate_box_ids array<string>, duplicate_groups array<struct<retained_box_id:string,suppressed_duplicate_box_ids:array<string>,pair_evidence:array<{_PAIR}>>>,"
    " deduplicated_box_count int, duplicate_gray_pair_count int, duplicate_risk boolean, eligible_box_count int, low_confidence_box_count int, empty_normalized_box_count int,"
    " warnings array<struct<box_id:string,code:string>>"
)


class Failure(Exception):
    """A screen that cannot be trusted as a whole; carries its error type."""

    def __init__(self, kind: str, warnings=()):
        super().__init__(kind)
        self.kind, self.warnings = kind, list(warnings)


class Rect:
    """A box's bounds, centre and size; heights under one count as one in `tall`."""

    __slots__ = ("x0", "y0", "x1", "y1", "width", "height", "tall", "cx", "cy", "area")

    def __init__(self, x0, y0, x1, y1):
        self.x0, self.y0, self.x1, self.y1 = x0, y0, x1, y1
        self.width, self.height = x1 - x0, y1 - y0
        self.tall = max(1.0, self.height)
        self.cx, self.cy, self.area = (x0 + x1) / 2, (y0 + y1) / 2, self.width * self.height


def _number(v) -> float:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise ValueError("bbox_invalid_number")
    if not math.isfinite(v):
        raise ValueError("bbox_non_finite")
    return float(v)


@lru_cache(maxsize=1 << 16)
def rect(bbox: str | None) -> Rect:
    """The bounds of a bounding-box text; ValueError says what is wrong."""
    if bbox is None:
        raise ValueError("bbox_missing")
    try:
        v = json.loads(bbox)
    except ValueError:
        raise ValueError("bbox_invalid_type") from None
    if v is None:
        raise ValueError("bbox_missing")
    if not isinstance(v, list):
        raise ValueError("bbox_invalid_type")
    if not v:
        raise ValueError("bbox_empty")
    nested = [isinstance(x, list) for x in v]
    if all(nested):
        if any(len(p) != 2 for p in v):
            raise ValueError("bbox_invalid_point")
        xs, ys = zip(*[(_number(x), _number(y)) for x, y in v])
        return Rect(min(xs), min(ys), max(xs), max(ys))
    if any(nested):
        raise ValueError("bbox_mixed_format")
    if len(v) != 4:
        raise ValueError("bbox_invalid_flat_count")
    r = Rect(*map(_number, v))
    if r.width < 0 or r.height < 0:
        raise ValueError("bbox_negative_size")
    return r


def box_text(t: str) -> str:
    return " ".join((t if t.isascii() else unicodedata.normalize("NFC", t)).split())


def plain(t: str) -> str:
    """Comparison text."""
    return "".join((t if t.isascii() else unicodedata.normalize("NFKC", t)).lower().split())


def source_key(b: dict):
    return (b["original_index"], b["box_id"])


def eligible(boxes: list[dict], c: dict) -> set[str]:
    """Boxes of a confidence at or above the threshold, or of none; a confidence outside 0..1 is an error."""
    out = set()
    for b in boxes:
        p = b["confidence"]
        if p is not None and not 0 <= p <= 1:
            raise Failure("reading_order_build_failed")
        if p is None or p >= c["effective_min_confidence"]:
            out.add(b["box_id"])
    return out


# --- duplicates ------------------------------------------------------------------------------------------


def _share(a0, a1, b0, b1) -> float:
    short = min(a1 - a0, b1 - b0)
    if short > 0:
        return max(0.0, min(a1, b1) - max(a0, b0)) / short
    return float(a0 == b0 and a1 == b1)


def _alike(a, b) -> float:
    return 1.0 if a == b == 0 else 0.0 if max(a, b) <= 0 else min(a, b) / max(a, b)


def pair_evidence(left: dict, right: dict, tall: float, c: dict) -> dict:
    """Scores and decision for two boxes with equal comparison text."""
    a, b = left["rect"], right["rect"]
    inter = max(0.0, min(a.x1, b.x1) - max(a.x0, b.x0)) * max(0.0, min(a.y1, b.y1) - max(a.y0, b.y0))
    union = a.area + b.area - inter
    far = math.hypot(a.cx - b.cx, a.cy - b.cy)
    unit = min(math.sqrt(max(1.0, r.width) * r.tall) for r in (a, b))
    s = {
        "iou": inter / union if union > 0 else 0.0,
        "horizontal_overlap_ratio": _share(a.x0, a.x1, b.x0, b.x1),
        "vertical_overlap_ratio": _share(a.y0, a.y1, b.y0, b.y1),
        "center_distance_ratio": far / max(1.0, tall),
        "center_distance_size_ratio": far / max(1.0, unit),
        "width_similarity": _alike(a.width, b.width),
        "height_similarity": _alike(a.height, b.height),
    }
    s["size_similarity"] = size = min(s["width_similarity"], s["height_similarity"])
    flat = min(a.area, b.area) <= 0
    if flat:
        sure = "exact_zero_area_geometry" if (a.x0, a.y0, a.x1, a.y1) == (b.x0, b.y0, b.x1, b.y1) else None
    elif s["iou"] >= c["duplicate_confirm_iou"] and size >= c["duplicate_confirm_size_similarity"]:
        sure = "primary_geometry"
    elif s["iou"] >= c["duplicate_secondary_iou"] and s["center_distance_ratio"] <= c["duplicate_confirm_center_ratio"] and size >= c["duplicate_secondary_size_similarity"]:
        sure = "secondary_geometry"
    else:
        sure = None
    near = s["iou"] >= c["duplicate_gray_iou"] or s["center_distance_ratio"] <= c["duplicate_gray_center_ratio"] and size >= c["duplicate_gray_size_similarity"]
    if sure:
        s |= {"decision": "confirmed", "basis": ["text_exact", sure]}
    elif near:
        s |= {"decision": "gray", "basis": ["text_exact", "gray_geometry", "retain_both"]}
    else:
        s |= {"decision": "retained", "basis": ["text_exact_geometry_insufficient", "retain_both"]}
    return {"left_box_id": left["box_id"], "right_box_id": right["box_id"], **s}


def survivor_key(b: dict):
    """Known confidence first, then high confidence, large area, source order, place."""
    p, r = b["confidence"], b["rect"]
    return (p is None, -(p or 0.0), -r.area, b["original_index"], r.x0, r.y0, r.x1, r.y1, b["box_id"])


def duplicates(boxes: list[dict], c: dict) -> tuple[list[dict], int]:
    """Groups of suppressed boxes by survivor, and the number of gray pairs.

    Boxes with the same comparison text are taken by priority; each is compared with the survivors so far
    that lie within the margin, in their order, and belongs to the first that is confirmed.
    """
    ready = []
    for b in boxes:
        if key := plain(b["text"]):
            try:
                ready.append(b | {"rect": rect(b["bbox"]), "key": key})
            except ValueError:
                continue
    if not ready:
        return [], 0
    tall = median(b["rect"].tall for b in ready)
    margin = tall * c["duplicate_candidate_margin_height_ratio"]
    by_key: dict[str, list[dict]] = {}
    for b in sorted(ready, key=survivor_key):
        by_key.setdefault(b["key"], []).append(b)
    gray, groups = 0, {}
    for same in by_key.values():
        alive: list[dict] = []
        for b in same:
            r = b["rect"]
            for s in alive:
                q = s["rect"]
                if q.x1 + margin < r.x0 or r.x1 + margin < q.x0 or q.y1 + margin < r.y0 or r.y1 + margin < q.y0:
                    continue
                e = pair_evidence(s, b, tall, c)
                if e["decision"] == "confirmed":
                    groups.setdefault(s["box_id"], (survivor_key(s), []))[1].append((b, e))
                    break
                gray += e["decision"] == "gray"
            else:
                alive.append(b)
    out = []
    for kept, (_, members) in sorted(groups.items(), key=lambda g: g[1][0]):
        lost = [b["box_id"] for b, _ in sorted(members, key=lambda m: source_key(m[0]))]
        out.append({"retained_box_id": kept, "suppressed_duplicate_box_ids": lost, "pair_evidence": [e for _, e in members]})
    return out, gray


# --- reading orders --------------------------------------------------------------------------------------


def _middle(values: list[float]) -> float:
    n = len(values)
    return values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2


class _Line:
    """A line as it grows: sorted centres and heights give running medians."""

    __slots__ = ("members", "centers", "heights", "top", "left", "source", "center", "height")

    def __init__(self, b: dict):
        self.members, self.centers, self.heights = [], [], []
        self.top, self.left, self.source = math.inf, math.inf, (math.inf, "")
        self.add(b)

    def add(self, b: dict) -> None:
        r = b["rect"]
        self.members.append(b)
        insort(self.centers, r.cy)
        insort(self.heights, r.tall)
        self.center, self.height = _middle(self.centers), _middle(self.heights)
        self.top, self.left, self.source = min(self.top, r.y0), min(self.left, r.x0), min(self.source, source_key(b))

    @property
    def place(self):
        return (self.center, self.top, self.left, *self.source)


def median_lines(boxes: list[dict], c: dict) -> tuple[list[list[dict]], float | None]:
    """Lines of boxes with bounds, top to bottom and left to right, and the median height.

    Boxes come by centre; each joins the nearest line whose median centre is within the tolerance or whose
    band it overlaps enough, else it opens one.
    """
    if not boxes:
        return [], None
    tall = float(median(b["rect"].tall for b in boxes))
    least = min(c["line_tolerance_max_px"], max(c["line_tolerance_min_px"], tall * c["line_tolerance_height_ratio"]))
    lines: list[_Line] = []
    pair, share = c["line_pair_height_ratio"], c["same_line_vertical_overlap_ratio"]
    for b in sorted(boxes, key=lambda b: ((r := b["rect"]).cy, r.y0, r.x0, r.y1, r.x1, *source_key(b))):
        r, best = b["rect"], None
        cy, y0, y1, tall_ = r.cy, r.y0, r.y1, r.tall
        for k, line in enumerate(lines):
            mid, high = line.center, line.height
            away, low = abs(cy - mid), min(tall_, high)
            over = max(0.0, min(y1, mid + high / 2) - max(y0, mid - high / 2)) / low
            if away <= max(least, low * pair) or over >= share:
                rank = (away, -over, *line.place, k)
                best = rank if best is None or rank < best else best
        if best is None:
            lines.append(_Line(b))
        else:
            lines[best[-1]].add(b)
    lines.sort(key=lambda s: s.place)
    return [sorted(s.members, key=lambda b: ((r := b["rect"]).x0, r.cy, r.y0, r.x1, r.y1, *source_key(b))) for s in lines], tall


def mean_lines(items: list[tuple], floor: float = 8.0, ratio: float = 0.5) -> list[tuple[float, list[tuple]]]:
    """(mean centre, items) of lines of (center, height, ...) items in their order: an item joins the first line within max(floor, ratio * lesser height) of its mean centre."""
    lines: list[list] = []  # sum of centres, sum of heights, mean centre, mean height, items
    for it in items:
        for line in lines:
            if abs(it[0] - line[2]) <= max(floor, ratio * min(it[1], line[3])):
                line[4].append(it)
                n = len(line[4])
                line[0], line[1] = line[0] + it[0], line[1] + it[1]
                line[2], line[3] = line[0] / n, line[1] / n
                break
        else:
            lines.append([it[0], it[1], it[0], it[1], [it]])
    return [(line[2], line[4]) for line in lines]


def fingerprint_order(boxes: list[dict]) -> list[dict]:
    """The fingerprint's reading order: running means; every box must have a polygon."""
    items = []
    for i, b in enumerate(boxes):
        r = rect(b["bbox"])
        items.append((r.cy, r.tall, r.y0, r.x0, r.y1, r.x1, i, b))
    items.sort(key=lambda t: (t[0], t[2], t[3], t[4], t[5], t[6]))
    lines = mean_lines(items)
    lines.sort(key=lambda ln: (ln[0], ln[1][0][2], ln[1][0][3]))
    return [m[-1] for _, ln in lines for m in sorted(ln, key=lambda t: (t[3], t[2], t[5], t[4], t[6]))]


def anchor_order(boxes: list[dict]) -> list[dict]:
    """The first tool's reading order: by upper left corner, running means; boxes without bounds come last."""
    items, rest = [], []
    for i, b in enumerate(boxes):
        try:
            r = rect(b["bbox"])
        except ValueError:
            rest.append(b)
            continue
        items.append((r.cy, r.tall, r.y0, r.x0, i, b))
    items.sort(key=lambda t: (t[2], t[3]))
    lines = sorted(mean_lines(items), key=lambda ln: ln[0])
    return [m[-1] for _, ln in lines for m in sorted(ln, key=lambda t: t[3])] + rest


def is_cjk(ch: str) -> bool:
    return any(a <= ord(ch) <= b for a, b in CJK)


def separator(left: str, right: str, a: Rect, b: Rect, tall: float | None, c: dict) -> str:
    """What stands between two fragments of a line: nothing or a blank."""
    if not left or not right:
        return ""
    gap = None if not tall else max(0.0, b.x0 - a.x1) / tall
    x, y = left[-1], right[0]
    joined = (
        gap == 0
        or x in OPENING
        or y in CLOSING
        or x in CLOSING and len(left) > 1 and is_cjk(left[-2])
        or is_cjk(x) and is_cjk(y)
        or gap is not None and (x in CONNECTORS or y in CONNECTORS) and gap <= c["symbol_join_gap_height_ratio"]
        or gap is not None and x.isascii() and x.isalnum() and y.isascii() and y.isalnum() and gap <= c["compact_join_gap_height_ratio"]
    )
    return "" if joined else " "


def normalise(boxes: list[dict], engine_text: str | None, c: dict) -> dict:
    """The text of a screen. What goes wrong makes a failed result with an error type, never an exception."""
    boxes = sorted(boxes or [], key=source_key)
    out = {
        "raw_text": engine_text if engine_text is not None else "\n".join(b["raw_text"] or "" for b in boxes),
        "raw_text_source": "engine_screen_text" if engine_text is not None else "derived_from_box_raw_text",
        "eligible_box_count": 0, "low_confidence_box_count": 0, "excluded_empty_box_ids": [],
    }
    try:
        if len({b["box_id"] for b in boxes}) != len(boxes) or any(not b["box_id"] for b in boxes):
            raise Failure("reading_order_build_failed")
        good = eligible(boxes, c)
        mine = [b | {"text": box_text(b["raw_text"]) if b["raw_text"] is not None else None} for b in boxes if b["box_id"] in good]
        out |= {"eligible_box_count": len(mine), "low_confidence_box_count": len(boxes) - len(mine)}
        out["excluded_empty_box_ids"] = [b["box_id"] for b in mine if b["text"] == ""]
        broken = [b["box_id"] for b in mine if b["text"] is None]
        full = [b for b in mine if b["text"]]
        if broken:
            raise Failure("box_text_normalization_failed" if full else "all_box_text_normalization_failed", [(i, "box_text_normalization_failed") for i in broken])
        groups, gray = duplicates(full, c)
        gone = {i for g in groups for i in g["suppressed_duplicate_box_ids"]}
        bad = []
        for b in mine:
            try:
                b["rect"] = rect(b["bbox"])  # kept from above
            except ValueError as e:
                bad.append((b["box_id"], str(e)))
        if bad:
            raise Failure("layout_degraded", bad)
        lines, tall = median_lines([b for b in full if b["box_id"] not in gone], c)
        made = []
        for line in lines:
            text, last = "", None
            for b in line:
                text += ("" if last is None else separator(text, b["text"], last["rect"], b["rect"], tall, c)) + b["text"]
                last = b
            made.append({"normalized_text": text, "comparison_text": plain(text), "box_ids": [b["box_id"] for b in line]})
        whole = "\n".join(m["normalized_text"] for m in made)
        return out | {
            "normalization_status": "completed", "normalization_error_type": None, "normalized_text": whole, "comparison_text": plain(whole), "lines": made,
            "ordered_box_ids": [i for m in made for i in m["box_ids"]], "suppressed_duplicate_box_ids": [b["box_id"] for b in full if b["box_id"] in gone],
            "duplicate_groups": groups, "deduplicated_box_count": len(full) - len(gone), "duplicate_gray_pair_count": gray, "duplicate_risk": gray > 0,
            "empty_normalized_box_count": len(out["excluded_empty_box_ids"]), "warnings": [],
        }
    except Failure as e:
        return out | {
            "normalization_status": "failed", "normalization_error_type": e.kind, "normalized_text": None, "comparison_text": None, "lines": [], "ordered_box_ids": [],
            "suppressed_duplicate_box_ids": [], "duplicate_groups": [], "deduplicated_box_count": 0, "duplicate_gray_pair_count": 0, "duplicate_risk": False,
            "empty_normalized_box_count": len(out["excluded_empty_box_ids"]), "warnings": [{"box_id": i, "code": w} for i, w in e.warnings],
        }


def fingerprint(boxes: list[dict], threshold: float) -> dict:
    """Hash of a screen's text in the fingerprint's order; null hash if a box has no bounds."""
    kept = [b for b in sorted(boxes or [], key=source_key) if (b["confidence"] if b["confidence"] is not None else 1.0) >= threshold]
    try:
        ordered = fingerprint_order(kept)
    except ValueError:
        return {"exact_hash": None, "fingerprint_version": None, "raw_text_length": None, "normalized_text_length": None}
    texts = [t for t in (" ".join((b["raw_text"] or "").split()) for b in ordered) if t]
    whole = "\n".join(texts)
    return {"exact_hash": hashlib.sha256(whole.encode()).hexdigest(), "fingerprint_version": "r03-v1", "raw_text_length": sum(len(b["raw_text"] or "") for b in ordered), "normalized_text_length": len(whole)}


# --- DataFrames ------------------------------------------------------------------------------------------


def gather(boxes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row per screen with its boxes; a screen holds as many as fit on a display."""
    cols = [F.col(c).cast(t).alias(c) for c, t in (("box_id", "string"), ("raw_text", "string"), ("confidence", "double"), ("bbox", "string"), ("original_index", "int"))]
    return boxes.groupBy(*keys).agg(F.collect_list(F.struct(*cols)).alias("boxes"))


def _values(col) -> list:
    """to_pylist, field by field for arrays of structs."""
    if not (pa.types.is_list(col.type) and pa.types.is_struct(col.type.value_type)):
        return col.to_pylist()
    names = [f.name for f in col.type.value_type]
    flat, ends = col.flatten(), col.offsets.to_pylist()
    items = [dict(zip(names, v)) for v in zip(*(flat.field(k).to_pylist() for k in range(len(names))))]
    base = ends[0] if ends else 0
    valid = col.is_valid().to_pylist()
    out, at = [], 0
    for k, ok in enumerate(valid):
        n = ends[k + 1] - ends[k] if ok else 0
        out.append(items[at : at + n] if ok else None)
        at += n
    assert at == len(items) and base >= 0
    return out


#: Boxes whose results are made before they are handed on.
_AT_ONCE = 1 << 13


def _pieces(batch: pa.RecordBatch, k: int):
    """A batch in pieces of about _AT_ONCE items of the arrays in column k (one row at least): what Python holds does not grow with the rows of a batch."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(k)), 0).to_pylist()
    for lo, hi in txt._groups([max(1, n) for n in sizes], _AT_ONCE):
        yield batch.slice(lo, hi - lo)


def _per_row(df: DataFrame, inputs: list[str], schema: str, make) -> DataFrame:
    """df with columns of `schema`, made row by row in pieces of Arrow batches; the first of inputs is the array of boxes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    whole = StructType(df.schema.fields + added.fields)

    def run(batches):
        arrow = to_arrow_schema(added)
        at = [df_names.index(c) for c in inputs]
        for b in (piece for batch in batches for piece in _pieces(batch, at[0])):
            rows = [make(*r) for r in zip(*(_values(b.column(k)) for k in at))]
            cols = [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*df_names, *(f.name for f in arrow)])

    df_names = df.columns
    return df.mapInArrow(run, whole)


def normalise_screens(screens: DataFrame, c: dict = config.LAYOUT, engine_text: str | None = None) -> DataFrame:
    """screens (boxes array, ...) with the columns of RESULT."""
    src = screens if engine_text is None else screens.withColumn("_engine", F.col(engine_text))
    if engine_text is None:
        src = src.withColumn("_engine", F.lit(None).cast("string"))
    return _per_row(src, ["boxes", "_engine"], RESULT, lambda boxes, engine: normalise(boxes, engine, c)).drop("_engine")


FINGERPRINT = "exact_hash string, fingerprint_version string, raw_text_length int, normalized_text_length int"


def fingerprint_screens(screens: DataFrame, threshold: float = 0.85) -> DataFrame:
    """screens with exact_hash, fingerprint_version, raw_text_length, normalized_text_length."""
    return _per_row(screens, ["boxes"], FINGERPRINT, lambda b: fingerprint(b, threshold))


def read_screens(screens: DataFrame, c: dict = config.LAYOUT, threshold: float = 0.85) -> DataFrame:
    """screens (boxes array, ...) with the columns of RESULT and FINGERPRINT, in one pass over the boxes."""
    return _per_row(screens, ["boxes"], f"{RESULT}, {FINGERPRINT}", lambda b: normalise(b, None, c) | fingerprint(b, threshold))


def failed_views(screens: DataFrame, error_type: str) -> DataFrame:
    """screens as views whose text could not be built again: the columns of RESULT as a failure of `error_type`, rule comparison columns null."""

    def make(boxes):
        return normalise([], None, config.LAYOUT) | {"raw_text": "\n".join(b["raw_text"] or "" for b in sorted(boxes or [], key=source_key)), "normalization_status": "failed", "normalization_error_type": error_type, "normalized_text": None, "comparison_text": None}

    names = [x.split()[0] for x in ("normalization_status", "normalization_error_type", "raw_text", "raw_text_source", "normalized_text", "comparison_text", "lines", "ordered_box_ids", "excluded_empty_box_ids", "suppressed_duplicate_box_ids", "duplicate_groups", "deduplicated_box_count", "duplicate_gray_pair_count", "duplicate_risk", "eligible_box_count", "low_confidence_box_count", "empty_normalized_box_count", "warnings")]
    s = _per_row(screens.drop(*names), ["boxes"], RESULT, make)
    for c in ("legacy_match", "r04_match", "comparison_outcome", "legacy_rule_index", "r04_rule_index"):
        if c in s.columns:
            s = s.withColumn(c, F.lit(None).cast(s.schema[c].dataType))
    return s


def unknown_boxes(screens: DataFrame) -> DataFrame:
    """screens with unknown_box_ids: ids that the layout names and the screen's boxes do not have; a stored result with any is rejected."""
    named = F.array_distinct(F.concat("ordered_box_ids", "suppressed_duplicate_box_ids", "excluded_empty_box_ids"))
    return screens.withColumn("unknown_box_ids", F.array_except(named, F.coalesce(F.transform("boxes", lambda b: b.box_id), F.array().cast("array<string>"))))


def searchable_text(screens: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """screens with searchable_text: comparison text in the first tool's order."""

    def make(boxes):
        kept = [b for b in sorted(boxes or [], key=source_key) if (b["confidence"] if b["confidence"] is not None else 1.0) >= min_confidence]
        return {"searchable_text": plain("\n".join(b["raw_text"] or "" for b in anchor_order(kept)))}

    return _per_row(screens, ["boxes"], "searchable_text string", make)


def load_gate(boxes, text_length, box_limit: int = 5, text_limit: int = 30):
    """(loaded, reason) from the number of boxes and the length of their stripped text."""
    reason = F.when(boxes == 0, "zero_ocr_boxes").when((boxes <= box_limit) & (text_length < text_limit), "low_box_count_and_short_text")
    return F.struct(reason.isNull().alias("loaded"), reason.alias("reason"))


def load_metrics(boxes):
    """(box_count, text_length) of an array of boxes."""
    return F.struct(F.size(boxes).alias("box_count"), F.aggregate(boxes, F.lit(0), lambda a, b: a + F.length(txt.strip(b.raw_text))).alias("text_length"))
