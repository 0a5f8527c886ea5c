"""Problem 5: a bounded number of rows per contributor, chosen by score.

Limits are solved by water-filling: the rows of each contributor are poured out up to one common level per group, and
the level is raised as far as every contributor's share of the resulting output stays within the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.ranking import SALTS, top_per_group


def water_levels(counts: DataFrame, group: Sequence[str], size: str, max_count: int | None, max_share: float | None) -> DataFrame:
    """Per group the `level`: the most rows that one contributor may keep.

    `counts` has one row per group and contributor with its number of rows in `size`. Contributors are folded into a
    histogram of sizes first; its sorted distinct sizes are at most sqrt(2 x rows) many, so the pass over them is
    small however many rows a group has. Between two neighbouring sizes the output T(L) = S + n L is linear in the
    level L (S rows of contributors below the level, n contributors at or above it), so L <= share x T(L) is solved
    in closed form there, and the largest consistent L wins. A share limit that no output can meet (fewer
    contributors than 1 / share) leaves level 1: each contributor keeps its best row.
    """
    if max_share is None or max_share >= 1:
        top = counts.groupBy(*group).agg(F.max(size).alias("__most"))
        level = F.col("__most") if max_count is None else F.least(F.col("__most"), F.lit(int(max_count)))
        return top.select(*group, level.cast("bigint").alias("level"))
    histogram = counts.groupBy(*group, F.col(size).alias("__size")).agg(F.count("*").alias("__holders"))
    up = Window.partitionBy(*group).orderBy("__size")
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    at_least = up.rowsBetween(0, Window.unboundedFollowing)
    s = histogram.select(
        *group,
        "__size",
        F.coalesce(F.sum(F.col("__size") * F.col("__holders")).over(below), F.lit(0)).alias("__rows_below"),
        F.sum("__holders").over(at_least).alias("__holders_above"),
        F.coalesce(F.lag("__size").over(up), F.lit(0)).alias("__previous"),
    )
    share = F.lit(float(max_share))
    slack = F.lit(1.0) - share * F.col("__holders_above")
    bound = F.when(slack <= 1e-12, F.col("__size")).otherwise(
        F.least(F.col("__size").cast("double"), F.floor(share * F.col("__rows_below") / slack + 1e-9).cast("double"))
    )
    solved = s.withColumn("__level", F.when(bound > F.col("__previous"), bound).otherwise(F.lit(1.0)))
    level = F.max("__level")
    if max_count is not None:
        level = F.least(level, F.lit(float(max_count)))
    return solved.groupBy(*group).agg(level.cast("bigint").alias("level"))


def cap_contributors(
    df: DataFrame,
    group: Sequence[str],
    contributor: str,
    score: str,
    row_id: str,
    max_count: int | None = None,
    max_share: float | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Every row of `df` with `quality_rank`, the group's `level` and `kept` (columns of these names are replaced).

    Rows of one contributor rank by higher score (NaN highest, nulls last), ties by smaller `row_id`; those ranked up
    to the level are kept. Null groups or contributors form groups of their own. `level` and ranks are bigint.

    A contributor with a third of all rows is ranked in `salts` parts: rows beyond the level inside their own part
    are beyond it in the whole too (their rank is then the rank in the part plus the level, a lower bound), so only
    `salts x level` rows of a contributor are ever compared in one task.
    """
    df = df.drop("quality_rank", "level", "kept")
    keys = [*group, contributor]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__rows"))
    levels = water_levels(sizes, group, "__rows", max_count, max_share)
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"d.{g}")) for g in group]
    cond: Column = same[0] if same else F.lit(True)
    for c in same[1:]:
        cond = cond & c
    with_level = df.alias("d").join(levels.alias("l"), cond, "left").select("d.*", "l.level") if group else df.crossJoin(F.broadcast(levels))  # without groups there is one level
    order = [F.desc_nulls_last(score), F.asc(row_id)]
    part = with_level.withColumn("__salt", F.pmod(F.xxhash64(F.col(row_id)), F.lit(salts)))
    local = Window.partitionBy(*keys, "__salt").orderBy(*order)
    ranked = part.withColumn("__local", F.row_number().over(local)).withColumn("__in", F.col("__local") <= F.col("level"))
    # rows already beyond the level keep their salt in the second key, so they stay spread over the tasks
    second = Window.partitionBy(*keys, "__in", F.when(F.col("__in"), F.lit(-1)).otherwise(F.col("__salt"))).orderBy(*order)
    rank = F.when(F.col("__in"), F.row_number().over(second)).otherwise(F.col("__local") + F.col("level")).cast("bigint")
    return (
        ranked.withColumn("quality_rank", rank)
        .withColumn("kept", F.col("__in") & (F.col("quality_rank") <= F.col("level")))
        .drop("__salt", "__local", "__in")
    )


def first_of_repeats(hits: DataFrame) -> DataFrame:
    """Of rows that repeat (question_id, retriever, chunk_id) the one with the smallest hit_id (map-side combined)."""
    return (
        hits.groupBy("question_id", "retriever", "chunk_id")
        .agg(F.min(F.struct("hit_id", "doc_id", "score")).alias("__first"))
        .select("question_id", "retriever", "chunk_id", "__first.hit_id", "__first.doc_id", "__first.score")
    )


def capped_hits(hits: DataFrame, max_count: int | None = 4, max_share: float | None = None) -> DataFrame:
    """Result lists with at most `max_count` hits, or a share of `max_share`, per doc_id."""
    columns = hits.select("hit_id", "question_id", "retriever", "chunk_id", "doc_id", "score")
    return cap_contributors(first_of_repeats(columns), ["question_id", "retriever"], "doc_id", "score", "hit_id", max_count, max_share)


def kept_hits(hits: DataFrame, most: int = 4) -> DataFrame:
    """The rows of result lists that keep at most `most` hits per doc_id, with their place among those (`quality_rank`).

    With a count for limit the level is given, so the best of each document are picked where they lie, before anything
    is moved, and the result is that of `capped_hits`. Null ids form groups of their own.
    """
    once = first_of_repeats(hits.select("hit_id", "question_id", "retriever", "chunk_id", "doc_id", "score"))
    order = [F.desc_nulls_last("score"), F.asc("hit_id")]
    return top_per_group(once, ["question_id", "retriever", "doc_id"], order, most, F.col("hit_id"), "quality_rank")


def dropped_hits(hits: DataFrame, most: int = 4) -> DataFrame:
    """(hit_id): the rows that `kept_hits` leaves out, repeats aside. Only ids are moved to tell them."""
    once = first_of_repeats(hits.select("hit_id", "question_id", "retriever", "chunk_id", "doc_id", "score"))
    return once.select("hit_id").join(kept_hits(hits, most).select("hit_id"), "hit_id", "left_anti")
