"""Queries over events of odd values and of many boxes."""

import duckdb
import pyarrow as pa

from evidra.operators import layout
from evidra.plans.registry import QUERIES, SQL


def test_survivors_of_any_value(spark, tmp_path):
    values = (0.0, 10.0, 749.0, 751.0, 9000.0, 9000.0, 751.0, None, -5.0, 1e9)
    rows = [(k, k % 3, ("view", "click")[k % 2], values[k % len(values)]) for k in range(1, 61)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = [(r["user_id"], r["event_id"], r["suppressed"]) for r in QUERIES["survivors"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.execute(SQL["survivors"]).fetchall())


def test_screens_of_many_boxes_come_in_pieces():
    sizes = [3000] * 20 + [0, 1, 30_000, 2]
    batch = pa.RecordBatch.from_pylist([{"k": k, "boxes": None if n == 0 else list(range(n))} for k, n in enumerate(sizes)])
    pieces = list(layout._pieces(batch, 1))
    assert [k for p in pieces for k in p.column(0).to_pylist()] == list(range(len(sizes)))
    assert all(p.num_rows == 1 or sum(len(x or ()) for x in p.column(1).to_pylist()) <= 1 << 13 for p in pieces)
