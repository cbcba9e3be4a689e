"""Shared plumbing of the training-data operators: written intermediates and components."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.shared import discard, shared_dir, written

#: Stands for a null doc_id inside an operator, so that null ids sort first and still join.
NULL_ID = -(2**63)
__all__ = ["NULL_ID", "byte_chunks", "trim", "components", "discard", "doc_key", "documents", "null_key", "shared_dir", "written"]


def doc_key(col: str = "doc_id"):
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def null_key(col):
    """The inverse of doc_key."""
    return F.when(col != F.lit(NULL_ID), col)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def trim() -> None:
    """Give freed memory back to the system: workers live on between stages, and executors count all of theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def byte_chunks(batch: pa.RecordBatch, text_col: int, limit: int = 1 << 19):
    """Row ranges of an Arrow batch that hold about `limit` bytes of text each (one row at least)."""
    col = batch.column(text_col)
    start = size = 0
    for i in range(batch.num_rows):
        v = col[i]
        n = len(v.as_buffer()) if v.is_valid else 0
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _star_small(e: DataFrame) -> DataFrame:
    m = e.groupBy("a").agg(F.min("b").alias("m"))
    rest = e.join(m, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(m.select("a", F.col("m").alias("b"))).distinct()


def _star_large(e: DataFrame) -> DataFrame:
    sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return sym.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b: long).

    Alternates large-star and small-star steps (Kiveris et al., 2014); each round is a few joins and
    partially aggregated minima, and is written to the shared folder. Returns (node, component) for every
    node that is not the least of its component; component is the least node.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, last = written(e, "edges"), None
    for _ in range(max_rounds):
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == last:
            break
        last, before = (state["n"], state["h"]), e
        e = written(_star_small(_star_large(e)), "edges")
        discard(before)
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
