"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight.  A source may give at most
``max_epochs`` times its size; what it cannot take is shared again among the
others by weight until nobody is above its cap.  That iteration has a closed
form: with sources sorted by cap/weight the water level is the largest of
(budget - caps before) / (weights from here on), and a target is
min(cap, level * weight).

A source with target t and size s takes every document floor(t / s) times and a
seeded choice of documents once more, which fills the rest of t to within half
a document: documents in the order of a seeded hash, up to a cut.  The cut is
found by sums over hashed ranges and an exact running sum, over distinct (hash,
doc_id, size), inside the one range that holds it, so a source with a third of
all rows is never sorted in one task.  Of rows that tie at the cut exactly as
many are taken as fit, by their places in a stored table of them.

Defined results: null text has size 0 and takes nothing; a null source is a
source of its own, ranked last; an empty table gives an empty result; a
document row that occurs twice is two documents.  The mix adds columns and
replaces inputs of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Hex digits of the hash that name a range.
RANGE_DIGITS = 3


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size)`` -> also target, whole (epochs), rest (words).

    One row per source throughout; the windows below are over that small table.
    """
    rank = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_rank", F.row_number().over(rank)).withColumn("_w", F.element_at(cycle, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(max_epochs))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_cap") / F.col("_w"), "_rank")
    everything = Window.partitionBy(F.lit(0))
    level = (F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("_level", level).withColumn("target", F.least(F.col("_cap").cast("double"), F.max("_level").over(everything) * F.col("_w")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    filled = filled.withColumn("whole", whole)
    return filled.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def seeded_hash(key: str = "doc_id", seed: str = SEED):
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))


def plan_mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sized(source, size, _h, doc_id)``, a stored table -> one row per source with its cut."""
    grouped = materialize(sized.groupBy("source", F.substring("_h", 1, RANGE_DIGITS).alias("_range")).agg(F.sum("size").alias("_words")), "ranges")
    plan = materialize(water_fill(grouped.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, budget, max_epochs), "plan")
    running = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    upto = grouped.withColumn("_upto", F.sum("_words").over(running)).join(plan.select(F.col("source").alias("_src"), "rest"), F.col("source").eqNullSafe(F.col("_src")))
    # the ranges in which the rest may end: all words before lie below it, not all words with it
    edge = upto.filter((F.col("_upto") - F.col("_words") <= F.col("rest")) & (F.col("_upto") >= F.col("rest")) & (F.col("_words") > 0))
    edge = edge.select("_src", F.col("_range").alias("_edge"), (F.col("_upto") - F.col("_words")).alias("_before"), "rest")
    inside = sized.filter(F.col("size") > 0).join(edge, F.col("source").eqNullSafe(F.col("_src")) & (F.substring("_h", 1, RANGE_DIGITS) == F.col("_edge")))
    ties = inside.groupBy("_src", "_edge", "_before", "rest", "_h", "doc_id", "size").agg(F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy("_src", "_edge").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ties = ties.withColumn("_below", F.col("_before") + F.sum(F.col("size") * F.col("_n")).over(within) - F.col("size") * F.col("_n"))
    fits = lambda k: 2 * (F.col("_below") + k * F.col("size")) - F.col("size") <= 2 * F.col("rest")
    near = F.greatest(F.lit(0), F.floor((F.col("rest") - F.col("_below")) / F.col("size") + F.lit(0.5))).cast("long")
    taken = ties.withColumn("_k", near).withColumn("_k", F.when(fits(F.col("_k") + 1), F.col("_k") + 1).when(fits(F.col("_k")), F.col("_k")).otherwise(F.col("_k") - 1))
    taken = taken.withColumn("_fit", F.least("_k", "_n")).filter("_fit > 0")
    cuts = taken.groupBy("_src").agg(F.max(F.struct(F.struct("_h", "doc_id", "size").alias("last"), "_fit", "_n")).alias("_c"))
    cuts = cuts.select("_src", F.col("_c.last").alias("_last"), F.when(F.col("_c._fit") < F.col("_c._n"), F.col("_c._fit")).alias("_fit"))
    starts = edge.groupBy(F.col("_src").alias("_from")).agg(F.min("_edge").alias("_first"))
    bound = plan.join(cuts, F.col("source").eqNullSafe(F.col("_src")), "left").join(starts, F.col("source").eqNullSafe(F.col("_from")), "left")
    return materialize(bound.select(F.col("source").alias("_source"), "source_size", "target", "whole", "_last", "_fit", "_first"), "cuts")


def mix(documents: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Add size, source_size, target, copies and taken to every document.

    Only sizes and hashes are shuffled, texts are not: the decision about a
    document compares its hash with its source's cut.
    """
    lean = documents.select("doc_id", "source", word_count().alias("size"), seeded_hash(seed=seed).alias("_h"))
    cuts = plan_mix(materialize(lean, "sizes"), weights, budget, max_epochs)
    whole_rows = documents.drop("size", "source_size", "target", "copies", "taken").withColumn("size", word_count()).withColumn("_h", seeded_hash(seed=seed))
    return _apply(whole_rows, cuts)


def _apply(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    below = F.col("_last").isNotNull() & (F.struct("_h", "doc_id", "size") <= F.col("_last"))
    below = below | (F.col("_first").isNotNull() & (F.substring("_h", 1, RANGE_DIGITS) < F.col("_first")))
    if not cuts.filter("_fit is not null").limit(1).count():
        return _copies(joined, below)
    tied = F.col("_fit").isNotNull() & (F.struct("_h", "doc_id", "size") == F.col("_last"))
    tied = F.coalesce(tied, F.lit(False))
    chosen, first = _some(materialize(joined.filter(tied).withColumn("_place", F.monotonically_increasing_id()), "tied"))
    return _copies(joined.filter(~tied), below).unionByName(_copies(chosen, first))


def _some(tied: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with the last place taken in their source, and whether a row is one of its ``_fit`` first.

    The upper bits of ``_place`` number the task that wrote a row: whole tasks
    are counted, rows only within the one in which the number is reached.
    """
    lean = tied.select("_source", "_fit", "_place", F.shiftright("_place", 33).alias("_task"))
    upto = Window.partitionBy("_source").orderBy("_task").rowsBetween(Window.unboundedPreceding, 0)
    edge = lean.groupBy("_source", "_fit", "_task").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    edge = edge.filter((F.col("_upto") >= F.col("_fit")) & (F.col("_upto") - F.col("_n") < F.col("_fit")))
    edge = edge.select(F.col("_source").alias("_s"), F.col("_task").alias("_t"), (F.col("_fit") - F.col("_upto") + F.col("_n")).alias("_left"))
    inside = lean.join(F.broadcast(edge), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t")))
    turn = F.row_number().over(Window.partitionBy("_source").orderBy("_place"))
    ends = inside.withColumn("_turn", turn).filter("_turn = _left").select("_s", F.col("_place").alias("_end"))
    ends = materialize(ends, "ends")
    return tied.join(F.broadcast(ends), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"), F.col("_place") <= F.col("_end")


def _copies(joined: DataFrame, once_more: Column) -> DataFrame:
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(once_more, F.lit(False)).cast("long")).otherwise(F.lit(0))
    return joined.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("_h", "_source", "_last", "_fit", "_first", "whole", "_place", "_end")


def mix_digest(documents: DataFrame) -> DataFrame:
    """The mix without texts: reads each text once."""
    lean = materialize(documents.select("doc_id", "source", word_count().alias("size"), seeded_hash().alias("_h")), "sizes")
    return _apply(lean, plan_mix(lean)).select("doc_id", "size", "source_size", "target", "taken")


def mixture(documents: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: whole rows of ``documents``, each as often as the mix takes it."""
    key = [F.col("doc_id"), F.col("source"), word_count().alias("size"), seeded_hash(seed=seed).alias("_h")]
    cuts = plan_mix(materialize(documents.select(*key), "sizes"), weights, budget, max_epochs)
    taken = _apply(documents.select(*key, F.struct("*").alias("_row")), cuts).filter(F.col("copies") > 0)
    turns = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.select("_row", turns.alias("_turn")).select("_row.*")


#: The same rows in DuckDB.
ORACLE = rf"""
WITH s AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM t),
w AS (SELECT *, CAST(CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, CAST(source_size * 2 AS DOUBLE) AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
g AS (SELECT source, source_size, least(cap, max(lev) OVER () * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
d AS (SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
             sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
      FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * run - size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d
"""
