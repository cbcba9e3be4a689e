"""The scan's control loop as a stateful stream: one key per candidate, screens in order of their index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from evidra.operators.stopping import NO_NEW_LIMIT, SLOTS

INPUT = "run_id string, candidate_record_id string, screen_index int, screen_id string, exact_hash string, healthy boolean, doubtful boolean, doubtful_if_same boolean, new_text boolean, no_new_text boolean, bottom_confirmed boolean, interrupted boolean, failed boolean"
OUTPUT = "run_id string, candidate_record_id string, screen_index int, position_status string, reference_screen_id string, no_new_run int, stop_reason string"
STATE = "reference_id string, reference_hash string, no_new_run int, stopped string, last_index int"


def advance(state: tuple, row, mode: str = "full", limit: int = NO_NEW_LIMIT, slots: int = SLOTS) -> tuple[tuple, tuple]:
    """(state, (position, reference, run, stop reason)) after one screen. A stopped candidate stays so."""
    ref, ref_hash, run, stopped, last = state
    yes = lambda v: v is not None and v == v and bool(v)
    same = ref_hash is not None and ref_hash == row.exact_hash
    if ref is None:
        position = "initial"
    elif not yes(row.healthy) or row.exact_hash is None:
        position = "unavailable"
    elif yes(row.doubtful_if_same) if same else yes(row.doubtful):
        position = "uncertain"
    else:
        position = "same" if same and not yes(row.new_text) else "changed"
    out_ref = ref
    if position in ("initial", "same", "changed"):
        ref, ref_hash = row.screen_id, row.exact_hash
    run = run + 1 if position == "changed" and yes(row.no_new_text) else 0
    reason = None
    if stopped is None:
        if yes(row.interrupted):
            reason = "interrupted"
        elif yes(row.failed):
            reason = "failed"
        elif row.screen_index >= slots:
            reason = "max_screens"
        elif mode in ("safe", "full") and yes(row.bottom_confirmed):
            reason = "scroll_bottom"
        elif mode == "full" and run >= limit:
            reason = "no_new_text"
    return (ref, ref_hash, run, stopped or reason, max(last, int(row.screen_index))), (position, out_ref, run, reason)


def control_stream(screens: DataFrame, mode: str = "full") -> DataFrame:
    """A stream of screens (INPUT) as a stream of verdicts (OUTPUT), up to each candidate's stop.

    State is a handful of values per candidate. Screens of one batch are taken by index; a screen that comes
    after a later one is taken when it comes, as in a live scan. Exactly once by the checkpoint and an
    idempotent sink.
    """

    def run(key, batches, store):
        state = store.get if store.exists else (None, None, 0, None, 0)
        rows = pd.concat(list(batches)).sort_values(["screen_index", "screen_id"], kind="stable")
        out = []
        for row in rows.itertuples(index=False):
            if state[3] is not None:
                break
            state, (position, ref, n, reason) = advance(tuple(state), row, mode)
            out.append((*key, int(row.screen_index), position, ref, n, reason))
        store.update(tuple(state))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return screens.groupBy("run_id", "candidate_record_id").applyInPandasWithState(run, OUTPUT, STATE, "append", "NoTimeout")


def control_batch(screens: DataFrame, mode: str = "full") -> DataFrame:
    """The same verdicts over a finished table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = (None, None, 0, None, 0), []
        for row in pdf.sort_values(["screen_index", "screen_id"], kind="stable").itertuples(index=False):
            if state[3] is not None:
                break
            state, (position, ref, n, reason) = advance(state, row, mode)
            out.append((row.run_id, row.candidate_record_id, int(row.screen_index), position, ref, n, reason))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return screens.groupBy("run_id", "candidate_record_id").applyInPandas(run, OUTPUT)
