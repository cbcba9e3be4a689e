"""SQL of the queries in evidra.plans.queries."""

from __future__ import annotations

_C = "regexp_replace(lower({0}), '\\s+', '', 'g')"
_TURNS = f"turns AS (SELECT conv_id, turn, role, text, {_C.format('text')} AS c FROM conversations)"


def _dice(n: int) -> str:
    g = f"SELECT conv_id, turn, substring(c, i::INT, {n}) AS g, count(*) AS n FROM turns, unnest(range(1, greatest(length(c) - {n - 1}, 0) + 1)) AS r(i) GROUP BY ALL"
    return f"""g{n} AS ({g}),
d{n} AS (SELECT p.conv_id, p.turn, CASE WHEN length(p.c) < {n} AND length(p.b) < {n} THEN NULL
   ELSE 2.0::DOUBLE * coalesce((SELECT sum(least(x.n, y.n)) FROM g{n} x JOIN g{n} y ON x.conv_id = y.conv_id AND x.g = y.g WHERE x.conv_id = p.conv_id AND x.turn = p.turn AND y.turn = p.turn - 1), 0)
        / (greatest(length(p.c) - {n - 1}, 0) + greatest(length(p.b) - {n - 1}, 0)) END AS d FROM pairs p)"""


_DICE = f"""WITH {_TURNS}, pairs AS (SELECT x.conv_id, x.turn, x.c, y.c AS b FROM turns x JOIN turns y ON x.conv_id = y.conv_id AND y.turn = x.turn - 1),
{_dice(2)}, {_dice(3)}, {_dice(4)},
scores AS (SELECT p.conv_id, p.turn, CASE WHEN p.c = '' AND p.b = '' THEN 1.0 WHEN p.c = '' OR p.b = '' THEN 0.0
   WHEN d2.d IS NULL THEN CASE WHEN p.c = p.b THEN 1.0 ELSE 0.0 END
   ELSE (coalesce(0.2::DOUBLE * d2.d, 0) + coalesce(0.3::DOUBLE * d3.d, 0) + coalesce(0.5::DOUBLE * d4.d, 0))
      / (CASE WHEN d2.d IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN d3.d IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN d4.d IS NULL THEN 0 ELSE 0.5::DOUBLE END) END::DOUBLE AS s
   FROM pairs p JOIN d2 USING (conv_id, turn) JOIN d3 USING (conv_id, turn) JOIN d4 USING (conv_id, turn))"""

_WINDOWS = f"""cut AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')), lambda x: x <> '') AS lines FROM documents),
windows AS (SELECT doc_id, i AS screen_index, list_transform(lines[(i - 1) * 4 + 1 : (i - 1) * 4 + 6], lambda x: {_C.format('x')}) AS a
  FROM cut, unnest(range(1, greatest(1, ceil((len(lines) - 6) / 4.0)::BIGINT + 1) + 1)) AS r(i) WHERE len(lines) > 0),
pairs AS (SELECT x.doc_id, x.screen_index, x.a, list_transform(x.a, lambda t: length(t)) AS z, list_filter(range(1, least(len(x.a), len(y.a)) + 1), lambda k: y.a[len(y.a) - k + 1 : len(y.a)] = x.a[1 : k]) AS eq FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND y.screen_index = x.screen_index - 1),
laps AS (SELECT doc_id, screen_index, a, z, eq, coalesce(list_max(list_filter(eq, lambda k: (k >= 2 AND list_sum(z[1 : k]) >= 24 AND list_max(z[1 : k]) > 8) OR (k = 1 AND len(a) = 1 AND z[1] >= 48))), 0)::BIGINT AS k FROM pairs)"""

_STATUS = "[402, 408, 401, 429, 400, 503, 404, 405, 418][(event_id % 9 + 1)::INT]"

SQL: dict[str, str] = {
    "comparison_text": f"SELECT doc_id, length({_C.format('text')})::BIGINT AS n, sha256({_C.format('text')}) AS digest FROM documents",
    "box_text": "SELECT doc_id, sha256(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')) AS digest FROM documents",
    "protected_tokens": "SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_.+#/\\-]+'), lambda t: regexp_matches(t, '[\\p{L}\\p{N}]')))::BIGINT AS n_tokens FROM documents",
    "protected_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), k AS (SELECT doc_id, t, {_C.format('t')} AS c, regexp_matches(t, '[\\p{{L}}\\p{{N}}]') AS p FROM l)
SELECT doc_id, count(*) FILTER (c <> '' AND NOT p AND regexp_full_match(c, '[\\p{{P}}\\p{{Z}}\\p{{C}}]+')) AS n_format_only, count(*) FILTER (p) AS n_protected, count(*) FILTER (regexp_matches(c, '[\\p{{L}}\\p{{Nd}}]')) AS n_content FROM k GROUP BY doc_id""",
    "load_gate": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), k AS (SELECT doc_id, len(lines)::BIGINT AS boxes, list_sum(list_transform(lines, lambda x: length(trim(x, ' ' || chr(9) || chr(13)))))::BIGINT AS chars FROM l)
SELECT doc_id, boxes, chars, NOT (boxes = 0 OR boxes <= 5 AND chars < 30) AS loaded, CASE WHEN boxes = 0 THEN 'zero_ocr_boxes' WHEN boxes <= 5 AND chars < 30 THEN 'low_box_count_and_short_text' END AS reason FROM k""",
    "exact_hash_groups": "SELECT sha256(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')) AS exact_hash, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "keyword_rules": f"""WITH k AS (SELECT doc_id, {_C.format('text')} AS c FROM documents)
SELECT doc_id, CASE WHEN contains(c, 'idiot') AND NOT (contains(c, 'moron') OR contains(c, 'clown')) THEN 0
  WHEN contains(c, 'the') AND (contains(c, 'erst') OR contains(c, 'thth')) OR contains(c, 'und') AND NOT contains(c, 'der') THEN 1
  WHEN contains(c, 'que') OR contains(c, 'los') THEN 2 END AS rule_index FROM k""",
    "first_keyword": f"WITH k AS (SELECT page_id, {_C.format('html')} AS c FROM pages) SELECT page_id, CASE WHEN contains(c, 'zzzz') THEN 'zzzz' WHEN contains(c, 'table') THEN 'TABLE' WHEN contains(c, 'script') THEN 'script' WHEN contains(c, 'html') THEN 'html' END AS keyword FROM pages JOIN k USING (page_id)",
    "rule_decisions": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'ai_failed' WHEN doc_id % 10 = 0 THEN NULL
  WHEN (quality = 1 AND toxic = 0) OR (quality = 1 AND toxic = 1) OR ((quality = 1 AND toxic = 1) AND (quality = 0 AND toxic = 0)) THEN 'qualified' ELSE 'rejected' END AS decision FROM labels""",
    "dice_pairs": f"{_DICE} SELECT conv_id, turn, round(s, 9) AS score FROM scores",
    "score_histogram": f"""{_DICE}, r AS (SELECT round(s, 9) AS s FROM scores), k AS (SELECT floor(s * 10) AS k FROM r)
SELECT format('{{:.1f}}-{{:.1f}}', k / 10.0::DOUBLE, least(1.0::DOUBLE, (k + 1) / 10.0::DOUBLE)) AS tenth, count(*) AS n FROM k GROUP BY 1""",
    "simhash_pairs": f"""WITH {_TURNS}, g AS (SELECT conv_id, turn, CASE WHEN length(c) < 3 THEN c ELSE substring(c, i::INT, 3) END AS g, count(*) AS n FROM turns, unnest(range(1, greatest(length(c) - 2, 1) + 1)) AS r(i) WHERE c <> '' GROUP BY ALL),
d AS (SELECT conv_id, turn, n, j, ('0x' || substring(sha256('r06-simhash-3gram-v1' || chr(0) || g), j::INT, 1))::INT AS x FROM g, unnest(range(1, 17)) AS q(j)),
v AS (SELECT conv_id, turn, j, sum(CASE WHEN x & 8 > 0 THEN n ELSE -n END) > 0 AS b3, sum(CASE WHEN x & 4 > 0 THEN n ELSE -n END) > 0 AS b2, sum(CASE WHEN x & 2 > 0 THEN n ELSE -n END) > 0 AS b1, sum(CASE WHEN x & 1 > 0 THEN n ELSE -n END) > 0 AS b0 FROM d GROUP BY ALL),
h AS (SELECT conv_id, turn, string_agg(substring('0123456789abcdef', b3::INT * 8 + b2::INT * 4 + b1::INT * 2 + b0::INT + 1, 1), '' ORDER BY j) AS simhash FROM v GROUP BY ALL),
a AS (SELECT conv_id, turn, simhash FROM turns LEFT JOIN h USING (conv_id, turn))
SELECT x.conv_id, x.turn, x.simhash, bit_count(xor(('0x' || x.simhash)::UBIGINT::HUGEINT, ('0x' || y.simhash)::UBIGINT::HUGEINT))::BIGINT AS distance FROM a x LEFT JOIN a y ON x.conv_id = y.conv_id AND y.turn = x.turn - 1""",
    "reference_resolution": """SELECT x.conv_id, x.turn, CASE WHEN x.role = 'system' THEN 'unavailable' WHEN x.turn = 0 THEN 'no_reference' WHEN y.turn IS NULL THEN 'unavailable' ELSE 'resolved' END AS status,
  CASE WHEN x.role <> 'system' AND x.turn > 0 THEN y.conv_id || ':' || y.turn END AS reference_id, CASE WHEN x.role = 'system' OR (x.turn > 0 AND y.turn IS NULL) THEN 'reference_missing' END AS warning
FROM conversations x LEFT JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn - 1 AND y.role <> 'system'""",
    "hash_stability": """WITH t AS (SELECT *, substring(text, 1, 1) AS l, lag(role) OVER w AS pr, lag(substring(text, 1, 1)) OVER w AS pl FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN role <> 'system' AND pr <> 'system' THEN l = pl END AS hash_stable FROM t""",
    "matches_previous": """WITH m AS (SELECT x.conv_id, x.turn, CASE WHEN count(y.turn) = 0 THEN NULL WHEN x.role = 'system' THEN NULL WHEN bool_or(y.role <> 'system' AND substring(y.text, 1, 1) = substring(x.text, 1, 1)) THEN true WHEN bool_or(y.role = 'system') THEN NULL ELSE false END AS matches
FROM conversations x LEFT JOIN conversations y ON x.conv_id = y.conv_id AND y.turn < x.turn GROUP BY x.conv_id, x.turn, x.role, x.text) SELECT *, NOT matches AS differs FROM m""",
    "no_new_runs": """WITH q AS (SELECT conv_id, turn, length(text) < 300 AS quiet, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, turn, quiet, n, CASE WHEN quiet THEN n - coalesce(max(CASE WHEN NOT quiet THEN n END) OVER (PARTITION BY conv_id ORDER BY n), 0) ELSE 0 END AS run FROM q),
g AS (SELECT conv_id, arg_max(run, n)::BIGINT AS last, max(run) AS top, conv_id % 2 = 0 AS p, conv_id % 7 = 0 AS lost, bool_or(turn >= 2) AS seen, bool_or(turn >= 2 AND NOT quiet) AS fresh FROM r GROUP BY conv_id),
b AS (SELECT *, p AND seen AND NOT lost AS bottom FROM g)
SELECT conv_id, last AS consecutive_no_new_count, top >= 2 AS no_new_text_candidate, CASE WHEN bottom THEN 'possible_scroll_bottom' ELSE 'insufficient_evidence' END AS offline_bottom_status, CASE WHEN p AND NOT lost THEN fresh END AS prediction_would_miss_content,
  CASE WHEN p AND NOT lost THEN true END AS prediction_observation_complete, false AS legacy_rule_completed, lost OR conv_id % 5 = 0 OR NOT bottom AS insufficient_evidence FROM b""",
    "attempt_numbers": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt_index FROM events",
    "final_attempts": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), f AS (SELECT user_id, coalesce(min(CASE WHEN event_type = 'purchase' THEN k END), max(k)) AS u FROM k WHERE k <= 3 GROUP BY user_id)
SELECT f.user_id, CASE WHEN k.event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS ai_status, k.value > 20 AS passed, f.u AS attempts_used FROM f JOIN k ON f.user_id = k.user_id AND k.k = f.u""",
    "error_codes": f"""WITH e AS (SELECT {_STATUS} AS s, user_id % 3 AS p, user_id % 2 = 0 AS complete, event_type AS t, CASE WHEN event_id % 11 = 0 THEN 'model' WHEN event_id % 13 = 0 THEN 'bill' ELSE '' END AS c FROM events)
SELECT CASE WHEN p = 0 AND s = 402 OR p = 1 AND c = 'bill' THEN 'quota_or_billing' WHEN p = 1 AND complete AND c = 'model' THEN 'model_unavailable' WHEN p = 1 AND NOT complete AND s IN (404, 405) THEN 'capability_unavailable'
  WHEN t = 'click' OR s = 408 THEN 'timeout' WHEN t = 'error' THEN 'network' WHEN s IN (401, 403) THEN 'authentication' WHEN s = 429 THEN 'rate_limit' WHEN s IN (400, 422) THEN 'invalid_request' WHEN s BETWEEN 500 AND 599 THEN 'provider_server_error'
  WHEN complete AND s = 404 THEN 'model_unavailable' WHEN s IN (404, 405) THEN 'invalid_request' ELSE 'unknown' END AS code, count(*) AS n FROM e GROUP BY 1""",
    "benchmark_report": """WITH e AS (SELECT *, event_type <> 'view' AS called, event_type NOT IN ('view', 'error') AS ok, event_id % 1000 AS i, user_id % 100 AS o FROM events),
k AS (SELECT *, CASE WHEN ok AND i <= 500 THEN (i * 0.8 + o * 2) / 1000000.0::DOUBLE END AS cost FROM e)
SELECT count(*) AS rows_recorded, count(*) FILTER (called) AS calls_attempted, count(*) FILTER (ok) AS provider_successes, count(*) FILTER (event_type = 'error') AS provider_errors,
  count(*) FILTER (ok AND event_id % 5 <> 0) AS contract_valid, count(*) FILTER (ok AND event_id % 5 = 0) AS contract_invalid, count(*) FILTER (event_type = 'view') AS no_document_text,
  round(median(value) FILTER (called), 1) AS latency_median, round(quantile_cont(value, 0.9) FILTER (called), 1) AS latency_p90, round(min(value) FILTER (called), 1) AS latency_min, round(max(value) FILTER (called), 1) AS latency_max,
  (sum(i) FILTER (ok))::BIGINT AS input_tokens_total, (sum(o) FILTER (ok))::BIGINT AS output_tokens_total, (sum(i + o) FILTER (ok))::BIGINT AS total_tokens_total,
  round(sum(cost), 6) AS estimated_total_cost, round(avg(cost), 6) AS mean_cost, round(avg(cost) * 1000, 6) AS estimated_cost_per_1000 FROM k""",
    "normalization_summary": """WITH k AS (SELECT conv_id::VARCHAR AS candidate_record_id, role <> 'system' AS f, CASE WHEN length(text) > 1500 THEN 'f' WHEN length(text) < 100 THEN 'n' ELSE 'c' END AS s FROM conversations)
SELECT candidate_record_id, count(*) FILTER (f AND s = 'c') AS formal_normalization_completed_count, count(*) FILTER (f AND s = 'f') AS formal_normalization_failed_count, count(*) FILTER (f AND s = 'n') AS formal_normalization_not_attempted_count,
  count(*) FILTER (NOT f AND s = 'c') AS nonformal_normalization_completed_count, count(*) FILTER (NOT f AND s = 'f') AS nonformal_normalization_failed_count, count(*) FILTER (NOT f AND s = 'n') AS nonformal_normalization_not_attempted_count FROM k GROUP BY 1""",
    "capture_summary": """SELECT conv_id::VARCHAR AS candidate_record_id, count(DISTINCT turn) FILTER (role = 'assistant') AS actual_screen_count, count(*) AS ocr_attempt_count, count(*) FILTER (role = 'user') AS scroll_attempt_count,
  count(*) FILTER (role = 'user' AND turn > 1) AS scroll_retry_count, (max(turn + 1) FILTER (role = 'assistant'))::BIGINT AS end_screen_index FROM conversations GROUP BY 1""",
    "exact_overlaps": f"""WITH {_WINDOWS} SELECT doc_id, screen_index, k, CASE WHEN k > 1 THEN 'comparison_sequence_equal' WHEN k = 1 THEN 'single_full_screen_equal' END AS basis, CASE WHEN k = 0 THEN coalesce(list_max(eq), 0) ELSE 0 END::BIGINT AS inadmissible FROM laps""",
    "accounting": f"""WITH {_WINDOWS}, c AS (SELECT doc_id, screen_index AS win, k, coalesce(list_sum(z[1 : k]), 0)::BIGINT AS o, list_sum(z)::BIGINT AS t, CASE WHEN k = 0 THEN z[len(z)] ELSE 0 END::BIGINT AS u FROM laps)
SELECT doc_id, win, o AS overlap_chars, t - o - u AS new_chars, u AS uncertain_chars, t AS chars, round(o / t::DOUBLE, 9) AS overlap_ratio, round((t - o - u) / t::DOUBLE, 9) AS new_ratio, CASE WHEN k = 0 THEN 'r05_partial' ELSE '' END AS warnings FROM c""",
    "id_sets": "SELECT user_id, count(DISTINCT event_type) = 5 AS whole, 5 - count(DISTINCT event_type) AS missing FROM events GROUP BY user_id",
    "survivors": """WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 10 = 0, CASE WHEN event_id % 10 <> 0 THEN 0.85::DOUBLE + value / 5000 END DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT user_id, event_id, n - 1 AS suppressed FROM k WHERE k = 1 AND n > 1""",
    "box_geometry": """WITH e AS (SELECT event_id, user_id, (event_id % 100)::DOUBLE AS x, (event_id % 37)::DOUBLE AS y, (event_id % 13 + 1)::DOUBLE AS w FROM events),
p AS (SELECT *, lag(x) OVER u AS a, lag(y) OVER u AS b, lag(w) OVER u AS c FROM e WINDOW u AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT *, greatest(0, least(x + w, a + c) - greatest(x, a)) AS ix, greatest(0, least(y + 20, b + 20) - greatest(y, b)) AS iy FROM p WHERE a IS NOT NULL)
SELECT event_id, round(ix * iy / (20 * w + 20 * c - ix * iy), 9) AS iou, round(ix / least(w, c), 9) AS overlap_x, round(sqrt((x + w / 2 - a - c / 2) ** 2 + (y - b) ** 2) / 20, 9) AS distance, round(least(w, c) / greatest(w, c), 9) AS size_similarity, 9.0::DOUBLE AS tolerance FROM k""",
    "confidence_filter": """WITH k AS (SELECT user_id, event_id, CASE WHEN event_id % 10 <> 0 THEN (event_id % 101) / 100.0::DOUBLE END AS c FROM events)
SELECT user_id, count(*) FILTER (c IS NULL OR c >= 0.85) AS eligible, count(*) FILTER (c < 0.85) AS low, count(*) FILTER (c IS NULL OR c >= 0.85) AS n_lines, sha256(coalesce(string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id) FILTER (c IS NULL OR c >= 0.85), '')) AS text_sha256 FROM k GROUP BY user_id""",
    "switch_states": """WITH e AS (SELECT event_id, user_id, event_type AS t, CASE WHEN event_type IN ('error', 'signup') THEN NULL WHEN event_type = 'view' THEN 'old' ELSE 'new' END AS r FROM events),
k AS (SELECT *, lag(r) OVER u AS pr, lag(t) OVER u AS pt FROM e WINDOW u AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, r AS relation, CASE WHEN t = 'error' THEN 'switch_loading' WHEN r IS NULL THEN 'switch_unverifiable' WHEN pr = r AND pt = t AND r = 'old' THEN 'switch_unchanged' WHEN pr = r AND pt = t THEN 'switch_confirmed' ELSE 'switch_observing' END AS switch_status FROM k""",
    "prompt_payloads": """SELECT conv_id, turn, sha256('{"criteria":[{"criterion_id":"C001","criterion_text":"x > 1"}],"resume_text":' || to_json(text) || '}') AS digest FROM conversations""",
    # between two words of a line stands a blank, unless one of the characters beside it joins
    "reading_order": """WITH cut AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(trim(x, ' ' || chr(9) || chr(10) || chr(13)), '\\s+', ' ', 'g')), lambda x: x <> '') AS lines FROM documents),
s AS (SELECT doc_id, i AS screen_index, lines[(i - 1) * 6 + 1 : i * 6] AS l FROM cut, unnest(range(1, ceil(len(lines) / 6.0)::BIGINT + 1)) AS r(i)),
j AS (SELECT doc_id, screen_index, l, list_transform(l, lambda x: regexp_replace(regexp_replace(x, ' ([)\\]}>）】》」』,.;:!?，。；：！？、%％+#/_\\\\-])', '\\1', 'g'), '([(\\[{<（【《「『+#./_\\\\-]) ', '\\1', 'g')) AS m FROM s)
SELECT doc_id, screen_index, 'completed' AS normalization_status, len(l)::BIGINT AS n_lines, sha256(array_to_string(m, chr(10))) AS text_sha256, sha256(replace(array_to_string(l, chr(10)), ' ', chr(10))) AS exact_hash, list_sum(list_transform(l, lambda x: len(string_split(x, ' '))))::BIGINT AS boxes, 0::BIGINT AS gray FROM j""",
    "reply_contracts": """SELECT event_id, CASE WHEN event_id % 6 = 0 THEN true END AS passed,
  CASE event_id % 6 WHEN 1 THEN 'passed_not_a_boolean' WHEN 2 THEN 'duplicate_criterion' WHEN 3 THEN 'criteria_incomplete_or_unknown' WHEN 4 THEN 'duplicate_member' WHEN 5 THEN 'item_schema' END AS error FROM events""",
    "profile_latest": """WITH p AS (SELECT user_id, event_id % 4 + 1 AS v, max(event_id) % 2000 AS m FROM events GROUP BY ALL)
SELECT user_id, max(v) AS profile_version, max(v) = count(*) AND min(v) = 1 AS contiguous, 'C' || lpad((max(m) + 1)::VARCHAR, greatest(3, length((max(m) + 1)::VARCHAR))::INT, '0') AS next_id FROM p GROUP BY user_id""",
}
