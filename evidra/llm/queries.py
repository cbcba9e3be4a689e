"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from evidra.llm import fingerprints, line_dedup, mixing, pairwise_quality, quality_rules, sentencepieces, simhash, token_counts, tool_calls, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        fingerprints.op1_iblt_fingerprints,
        token_counts.op2_token_counts,
        simhash.op3_simhash_golay,
        tool_calls.op4_tool_call_linking,
        line_dedup.op5_line_dedup,
        mixing.op6_pareto_mixing,
        quality_rules.op7_quality_rules,
        sentencepieces.op8_sentencepiece,
        toxicity.op9_toxicity_bigru,
        pairwise_quality.op10_bradley_terry,
    )
}
SQL: dict[str, str] = {"op5_line_dedup": line_dedup.OP5_SQL, "op6_pareto_mixing": mixing.OP6_SQL}
