"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import NULL_ID, doc_key, documents, null_key, written

#: Regular expression of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Classes of the Pareto rank that are counted before any row is ordered.
BINS = 16384
#: A per-source plan of at most this many rows is broadcast; a longer one is joined by a shuffle.
BROADCAST_SOURCES = 20_000


def sized(docs: DataFrame, *keep: str, seed: int = 6) -> DataFrame:
    """docs (doc_id, text, source) as (id, source, size, g, u, *keep): words, their root's integer part, and a number in (0, 1) hashed from doc_id."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = doc_key()
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return docs.select(key.alias("id"), "source", size.alias("size"), F.floor(F.sqrt(size.cast("double"))).alias("g"), u.alias("u"), *keep)


def targets(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of sized rows.

    The target level: sources ordered by cap over weight stay at their cap until the level that shares what
    remains by weight is under the next cap. The windows order one row per source.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(whole) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.first(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), ignorenulls=True).over(whole))
    return per.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _by_source(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    p = plan.withColumnRenamed("source", "p_source")
    return rows.join(F.broadcast(p) if few else p, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")


#: Inclusion probability of a fractional copy, and the Pareto rank: the row's random odds over its inclusion odds.
_PI = "least(1D, c * g)"
_RANK = "if(pi < 1 and pi > 0, u * (1 - pi) / ((1 - u) * pi), null)"


def plan(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, bool]:
    """What decides every row's copies, a row per source, and whether it is short enough to broadcast.

    copies: whole copies that all the source's rows get; c: a fractional copy's inclusion probability is
    min(1, c g), so that the expected words fill the target; cut: the last (rank, id, size) that is taken.
    """
    goal = written(targets(rows, weights, share, most), "targets")
    few = goal.count() <= BROADCAST_SOURCES
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    # c: rows of large g are certain (probability 1) until c g <= 1 for the next; a source has at most sqrt(longest text) values of g
    levels = rows.where("size > 0").groupBy("source", "g").agg(F.sum("size").alias("words"))
    levels = _by_source(levels, goal, few)
    down = Window.partitionBy("source").orderBy(F.desc("g"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    rest = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = levels.withColumn("certain", F.coalesce(F.sum("words").over(before), F.lit(0)))
    levels = levels.withColumn("c", (F.col("rest") - F.col("certain")) / F.sum(F.col("g") * F.col("words")).over(rest))
    fit = F.col("c") * F.col("g") <= 1
    chosen = levels.where(fit).groupBy("source").agg(F.max_by(F.struct("c", "certain"), "g").alias("x"))
    goal = goal.join(chosen.withColumnRenamed("source", "x_source"), F.col("source").eqNullSafe(F.col("x_source")), "left").select("source", "source_size", "target", "copies", F.coalesce(F.greatest("x.c", F.lit(0.0)), F.lit(0.0)).alias("c"), (F.col("rest") - F.coalesce("x.certain", F.lit(0))).alias("rest"))
    goal = written(goal, "mix")
    # where the cut falls: count words by class of the rank, then order the rows of one class
    ranked = _by_source(rows.where("size > 0"), goal, few).where("c > 0").withColumn("pi", F.expr(_PI)).withColumn("rank", F.expr(_RANK)).where("rank is not null")
    ranked = ranked.withColumn("bin", F.floor(F.col("rank") / (F.col("rank") + 1) * BINS))
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("below", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = bins.where("below <= rest").groupBy("source").agg(F.max_by(F.struct("bin", "below"), "bin").alias("e"))
    edge = edge.select("source", F.col("e.bin").alias("edge"), F.col("e.below").alias("below"))
    at = _by_source(ranked, edge, few).where("bin = edge")
    order = Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("before", F.col("below") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    cuts = at.where(F.col("before") + F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("rank", "id", "size")).alias("cut"))
    out = goal.join(edge.withColumnRenamed("source", "e_source"), F.col("source").eqNullSafe(F.col("e_source")), "left")
    out = out.join(cuts.withColumnRenamed("source", "c_source"), F.col("source").eqNullSafe(F.col("c_source")), "left")
    return written(out.select("source", "source_size", "target", "copies", "c", "edge", "cut"), "plan"), few


def copies(rows: DataFrame, how: DataFrame, few: bool) -> DataFrame:
    """The sized rows with source_size, target and n, the number of copies that the mix takes."""
    all_ = _by_source(rows, how, few).withColumn("pi", F.expr(_PI)).withColumn("rank", F.expr(_RANK))
    bin_ = F.floor(F.col("rank") / (F.col("rank") + 1) * BINS)
    under = (bin_ < F.col("edge")) | ((bin_ == F.col("edge")) & F.col("cut").isNotNull() & (F.struct("rank", "id", "size") <= F.col("cut")))
    extra = F.when((F.col("c") <= 0) | (F.col("size") == 0), 0).when(F.col("pi") >= 1, 1).when(under, 1).otherwise(0)
    return all_.withColumn("n", F.when(F.col("size") == 0, 0).otherwise(F.col("copies") + extra).cast("long"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 6) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source).

    Every row of a source gets floor(target / source_size) certain whole copies. The rest of the target is
    filled with one more copy of some rows: each has an inclusion probability in proportion to the root of
    its size (so the sample is of unequal probabilities; where that is 1 or more, the copy is certain), and
    rows are taken in the order of their random odds over their inclusion odds until the words nearest to
    the rest are reached: a source's words miss its target by half a text at most. The random numbers are
    hashes of doc_id and `seed`, so reruns agree. Hot sources are counted by classes of the rank; only the
    rows of one class of 16,384 are ordered, by a window.
    A null text has size 0 and is never taken; a null source is a source of its own, the last; a null
    doc_id is an id like any other; rows alike in doc_id, source and size at the cut are taken together.
    An empty table gives an empty result; other columns are not read.
    """
    rows = written(sized(docs, seed=seed), "sized")
    how, few = plan(rows, weights, share, most)
    out = copies(rows, how, few)
    return out.select(null_key(F.col("id")).alias("doc_id"), "size", "source_size", "target", (F.col("n") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; all columns stay, whatever their names. Edge cases are those of `mix`. Texts are not shuffled."""
    rows = written(sized(docs), "sized")
    p, few = plan(rows, **how)
    cols = docs.columns
    whole = sized(docs.select("doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row")), "row")
    return copies(whole, p, few).where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op6_pareto_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir))


OP6_SQL = """
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(doc_id::VARCHAR || '|6'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), sized AS (SELECT *, floor(sqrt(size::DOUBLE))::BIGINT AS g FROM rows),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, [3, 1, 2][(place % 3 + 1)::INT]::BIGINT AS w, 2.0::DOUBLE * source_size AS cap FROM per
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY cap / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / ((sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER (ORDER BY cap / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE AS level
  FROM weighed
), goal AS (
  SELECT l.source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM levels WHERE level * w <= cap) * w, cap)) AS target FROM levels l
), whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM goal
), rest AS (SELECT *, target - copies * source_size AS rest FROM whole),
classes AS (
  SELECT sized.source, g, sum(size)::BIGINT AS words FROM sized WHERE size > 0 GROUP BY ALL
), odds AS (
  SELECT c.source, g, r.rest, coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS certain,
         (sum(g * words) OVER (PARTITION BY c.source ORDER BY g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS mass
  FROM classes c JOIN rest r ON c.source IS NOT DISTINCT FROM r.source
), fitted AS (
  SELECT source, arg_max(greatest((rest - certain) / mass::DOUBLE, 0.0), g) AS c, arg_max(rest - certain, g) AS rest
  FROM odds WHERE (rest - certain) / mass::DOUBLE * g <= 1 GROUP BY source
), ranked AS (
  SELECT s.doc_id, s.source, s.size, s.u, f.c, f.rest, least(1.0::DOUBLE, f.c * s.g) AS pi FROM sized s JOIN fitted f ON s.source IS NOT DISTINCT FROM f.source WHERE s.size > 0 AND f.c > 0
), ordered AS (
  SELECT *, u * (1 - pi) / ((1 - u) * pi) AS rank FROM ranked WHERE pi < 1
), taken AS (
  SELECT doc_id, CASE WHEN coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS n FROM ordered
  UNION ALL SELECT doc_id, 1 FROM ranked WHERE pi >= 1
)
SELECT s.doc_id, s.size, r.source_size, r.target, CASE WHEN s.size = 0 THEN 0 ELSE ((r.copies + coalesce(t.n, 0)) * s.size)::BIGINT END AS taken
FROM sized s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN taken t ON s.doc_id = t.doc_id
"""
