"""Configurations of the three text layers, their canonical JSON and digests."""

from __future__ import annotations

import hashlib
import json

# Algorithm identities, thresholds and vocabularies that stored runs carry.
LAYOUT = {
    "normalization_version": "r04-v1",
    "normalization_config_version": "r04-config-v1",
    "effective_min_confidence": 0.85,
    "unknown_confidence_policy": "include",
    "line_tolerance_height_ratio": 0.45,
    "line_tolerance_min_px": 4.0,
    "line_tolerance_max_px": 18.0,
    "line_pair_height_ratio": 0.5,
    "same_line_vertical_overlap_ratio": 0.5,
    "compact_join_gap_height_ratio": 0.25,
    "symbol_join_gap_height_ratio": 0.75,
    "duplicate_candidate_margin_height_ratio": 1.0,
    "duplicate_confirm_iou": 0.85,
    "duplicate_confirm_size_similarity": 0.9,
    "duplicate_confirm_center_ratio": 0.2,
    "duplicate_secondary_iou": 0.7,
    "duplicate_secondary_size_similarity": 0.95,
    "duplicate_gray_iou": 0.65,
    "duplicate_gray_center_ratio": 0.35,
    "duplicate_gray_size_similarity": 0.8,
}
DOCUMENT = {
    "aggregation_version": "r05-v1",
    "aggregation_config_version": "r05-config-v1",
    "max_formal_screen_count": 8,
    "max_screen_segments": 256,
    "exact_min_segment_count": 2,
    "exact_min_char_count": 24,
    "exact_min_nonshort_segment_count": 1,
    "exact_single_segment_min_char_count": 48,
    "short_segment_char_threshold": 8,
    "fuzzy_similarity_threshold": 0.94,
    "fuzzy_uncertain_similarity_floor": 0.88,
    "fuzzy_tie_epsilon": 0.005,
    "fuzzy_min_char_count": 32,
    "fuzzy_max_tail_segments": 4,
    "fuzzy_max_head_segments": 4,
    "fuzzy_max_combined_segments": 3,
    "fuzzy_max_unmatched_chars_per_side": 2,
    "fuzzy_max_group_char_count": 512,
    "fuzzy_candidate_limit": 128,
    "historical_min_segment_count": 2,
    "historical_max_segment_count": 4,
    "historical_min_char_count": 48,
    "historical_context_anchor_count": 2,
}
SHORT_TERMS = ("SLG", "UE5", "3D", "C++", "C#", ".NET", "Unity", "主美", "UI", "TA", "3A", "0-1", "2D/3D")
SHORT_TERMS_VERSION = "r06-business-short-v1"
SIMHASH_PREFIX = "r06-simhash-3gram-v1"
NOVELTY = {
    "similarity_version": "r06-v1",
    "similarity_config_version": "r06-config-v1",
    "primary_similarity_metric": "weighted_multiset_dice",
    "ngram_sizes": [2, 3, 4],
    "ngram_weights": [0.2, 0.3, 0.5],
    "simhash_bit_count": 64,
    "simhash_ngram_size": 3,
    "simhash_feature_hash_algorithm": "sha256_first_8_bytes_big_endian",
    "simhash_domain_prefix": SIMHASH_PREFIX,
    "high_similarity_threshold": 0.85,
    "effective_min_confidence": 0.85,
    "low_confidence_delta": 0.03,
    "low_confidence_max_chars": 2,
    "business_short_terms_version": SHORT_TERMS_VERSION,
    "business_short_terms": list(SHORT_TERMS),
    "ui_min_formal_screen_occurrences": 3,
    "ui_center_tolerance_min_px": 8.0,
    "ui_center_tolerance_height_ratio": 0.5,
    "ui_min_size_similarity": 0.9,
    "max_comparison_text_length": 100000,
    "max_formal_screens": 8,
    "floating_point_tolerance": 1e-12,
}
#: Warning codes of the novelty layer, in the order in which they are reported.
WARNINGS = (
    "reference_missing", "reference_conflict", "reference_run_mismatch", "reference_candidate_mismatch",
    "reference_capture_invalid", "reference_index_invalid", "duplicate_screen_id_conflict", "exact_hash_unavailable",
    "fingerprint_version_mismatch", "r04_not_completed", "r05_not_attempted", "r05_partial", "r05_failed",
    "r05_projection_mismatch", "segment_partition_invalid", "accounting_mismatch", "zero_effective_char_denominator",
    "comparison_text_too_long", "simhash_unavailable", "effective_evidence_insufficient", "ui_evidence_insufficient",
    "config_identity_mismatch", "legacy_reference_unavailable", "sidecar_source_mismatch",
    "cross_layer_similarity_conflict", "evaluation_failed",
)


def canonical_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def digest(value) -> str:
    """SHA-256 of the canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def novelty_snapshot() -> dict:
    terms = {"business_short_terms": list(SHORT_TERMS), "business_short_terms_version": SHORT_TERMS_VERSION}
    return NOVELTY | {"business_short_terms_digest": digest(terms)}


def restored(snapshot: dict, default: dict) -> dict:
    """A stored configuration; its keys and the kinds of its values must be those of `default`."""
    if set(snapshot) != set(default):
        raise ValueError("configuration has other keys")
    for k, v in default.items():
        s = snapshot[k]
        if isinstance(s, bool) or isinstance(v, (int, float)) != isinstance(s, (int, float)) or isinstance(v, str) != isinstance(s, str):
            raise ValueError(f"configuration value {k} has another type")
    return dict(snapshot)


def resolved(manifest: dict | None, override: dict | None, default: dict, mode: str = "record") -> tuple[dict, bool]:
    """(configuration, whether it is the override): an override first, then what the manifest of a recording run holds, then the default."""
    if override is not None:
        return restored(override, default), True
    if manifest is not None and mode == "record":
        return restored(manifest, default), False
    return dict(default), False


def bounded(c: dict) -> list[str]:
    """Keys of a configuration whose values are out of range: shares and thresholds in 0..1, counts at least 0, limits in order."""
    bad = [k for k, v in c.items() if isinstance(v, float) and (v != v or v < 0 or (k.endswith(("_threshold", "_floor", "_iou", "_similarity", "_confidence")) and v > 1))]
    bad += [k for k, v in c.items() if isinstance(v, int) and not isinstance(v, bool) and v < 0]
    for low, high in (("line_tolerance_min_px", "line_tolerance_max_px"), ("fuzzy_uncertain_similarity_floor", "fuzzy_similarity_threshold"), ("historical_min_segment_count", "historical_max_segment_count"), ("duplicate_gray_iou", "duplicate_secondary_iou")):
        if low in c and high in c and c[low] > c[high]:
            bad.append(low)
    return sorted(set(bad))
