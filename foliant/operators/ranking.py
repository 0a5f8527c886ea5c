"""Ordered selection inside groups that may be arbitrarily large.

A plain window sorts a whole group in one task. The operators here first work on salted or range-split
parts of a group, so no task ever holds more than a share of a hot one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.tables import materialize

SALTS = 32
#: Spark's own threshold for limiting groups before a window's shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column, salt: Column, rank: str = "rank", salts: int = SALTS
) -> DataFrame:
    """The first `n` rows of each group with their rank (1-based, bigint).

    For a number up to GROUP_LIMIT the planner itself limits each group in every task before the shuffle. Otherwise, and
    where `n` is a column (constant inside a group), two stages do: the first `n` of every salted part, then the first
    `n` of those. `order` must be total for a deterministic result; a null or non-positive `n` keeps nothing.
    """
    if isinstance(n, int) and n <= GROUP_LIMIT:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("bigint"))
    if not isinstance(n, int):
        df, n = df.withColumn("__n", n), F.col("__n")
    part = df.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    local = Window.partitionBy(*keys, "__salt").orderBy(*order)
    kept = part.withColumn(rank, F.row_number().over(local)).filter(F.col(rank) <= n).drop("__salt", rank)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(whole).cast("bigint")).filter(F.col(rank) <= n).drop("__n")


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, parts: int = 64) -> DataFrame:
    """Per group and distinct non-null value: `n_equal` rows with it, `n_below` rows with a smaller one, `n_group` rows.

    Exact and skew-proof: values are counted first (map-side), cut into `parts` value ranges per group by approximate
    quantiles (which only balance the work), and the prefix sums run over range totals and inside single ranges.
    NaN ranks above every number, as in Spark's ordering. Null values are left out; an empty input gives no rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_equal"))
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx(F.when(~F.isnan(F.col(value).cast("double")), F.col(value)), [i / parts for i in range(1, parts)], 200).alias("__cuts"),
        F.sum("n_equal").alias("n_group"),
    )
    placed = counts.join(cuts, [*keys]).withColumn(
        "__part", F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(value))), F.lit(0))
    ).drop("__cuts")
    totals = placed.groupBy(*keys, "__part").agg(F.sum("n_equal").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    inside = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, [*keys, "__part"])
        .withColumn("n_below", F.col("__offset") + F.coalesce(F.sum("n_equal").over(inside), F.lit(0)))
        .drop("__part", "__offset")
    )


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, width: int = 1024) -> DataFrame:
    """Adds `out`, the sum of `value` over the rows of the group with a smaller `order` (an integer, unique in a group).

    Order positions are cut into ranges of `width`; range totals are summed first, so a group of any size is spread.
    Rows with a null order are dropped, a null value counts 0.
    """
    placed = df.filter(F.col(order).isNotNull()).withColumn("__range", F.floor(F.col(order) / width))
    totals = placed.groupBy(*keys, "__range").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    inside = Window.partitionBy(*keys, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(offsets, [*keys, "__range"])
        .withColumn(out, F.col("__offset") + F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside), F.lit(0)))
        .drop("__range", "__offset")
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Adds `out`, the sum of `value` over the earlier rows of the group in the total order `order`.

    `bucket` must not decrease along the order (an hour of a time, say; nulls come first): its totals are summed first
    and rows are ordered inside single buckets, so a group of any size is spread. A null value counts 0.
    """
    placed = df.withColumn("__bucket", bucket)
    totals = placed.groupBy(*keys, "__bucket").agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total").withColumnsRenamed({k: f"__{k}" for k in keys}).withColumnRenamed("__bucket", "__b")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*(F.asc_nulls_first(o) for o in order)).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__bucket").eqNullSafe(F.col("__b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = placed.join(offsets, same).withColumn(out, F.col("__offset") + F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside), F.lit(0)))
    return joined.drop("__bucket", "__offset", "__b", *(f"__{k}" for k in keys))


#: Rows that one range of a sorted pass may hold on average.
ROWS_PER_RANGE = 1_000_000


def reached_shares(df: DataFrame, keys: Sequence[str], value: str, tie: str, out: str, rows: int = 0) -> DataFrame:
    """(keys, tie, out): the share of its group's rows whose value is at most a row's own, exact for groups of any size.

    Keys, values and ties must not be null; NaN ranks above every number, as in Spark's ordering. Rows are sorted once
    into ranges over all groups, cut by keys, value and tie, so neither a hot group nor a hot value is ever in one task.
    Every range counts for itself; only its first and last group may go on in its neighbours, and those two rows a range
    are put together on the driver. There are as many ranges as shuffle partitions, or more where `rows`, a bound of the
    rows of `df` if one is known, would put more than ROWS_PER_RANGE into each.
    """
    spark, keys = df.sparkSession, list(keys)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))
    ordered = df.select(*keys, tie, F.col(value).cast("double").alias("__v")).repartitionByRange(ranges, *keys, "__v", tie).sortWithinPartitions(*keys, "__v")
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in (*keys, tie))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        parts = list(frames)  # one range of rows
        f = pd.concat(parts, ignore_index=True) if parts else None
        if f is None or not len(f):
            return
        v = f["__v"].to_numpy()
        new = np.ones(len(f), dtype=bool)
        new[1:] = np.any([f[k].to_numpy()[1:] != f[k].to_numpy()[:-1] for k in keys], axis=0)
        step = new.copy()
        step[1:] |= (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
        begins, runs = np.flatnonzero(new), np.flatnonzero(step)
        group, run = np.cumsum(new) - 1, np.cumsum(step) - 1
        run_end = np.append(runs[1:], len(f))
        size = np.diff(np.append(begins, len(f)))
        edge = (group == 0) | (group == group[-1])
        last = run_end[run] == (begins + size)[group]  # rows of the group's last value here
        first = (run_end[run[begins]] - begins)[group]  # how many rows have its first value here
        at = begins[group]
        yield f[[*keys, tie]].assign(__at_most=run_end[run] - at, __n=size[group], __edge=edge, __last=last & edge, __part=TaskContext.get().partitionId(), __first=first, __low=v[at], __high=v[at + size[group] - 1])

    counted = materialize(ordered.mapInPandas(count, kinds + ", __at_most long, __n long, __edge boolean, __last boolean, __part int, __first long, __low double, __high double"))
    ends = counted.filter("__edge").groupBy("__part", *keys).agg(*(F.max(c).alias(c) for c in ("__n", "__first", "__low", "__high"))).toPandas()  # two rows a range at most
    rows = []
    for _, g in ends.sort_values("__part").groupby(keys, sort=False):
        n, first, low, high = (g[c].tolist() for c in ("__n", "__first", "__low", "__high"))
        for i in range(len(g)):
            more = 0
            for j in range(i + 1, len(g)):  # rows of its last value in the ranges after it
                if not (low[j] == high[i] or (low[j] != low[j] and high[i] != high[i])):
                    break
                more += first[j]
                if first[j] < n[j]:
                    break
            rows.append((int(g["__part"].iloc[i]), *(x.item() if hasattr(x, "item") else x for x in g[keys].iloc[i]), int(sum(n[:i])), int(more), int(sum(n))))
    names = ["__p", *(f"__k{i}" for i in range(len(keys))), "__before", "__more", "__all"]
    types = ["int", *(df.schema[k].dataType.simpleString() for k in keys), "long", "long", "long"]
    around = F.broadcast(spark.createDataFrame(rows, ", ".join(f"{a} {b}" for a, b in zip(names, types))))
    same = F.col("__edge") & (F.col("__part") == F.col("__p"))
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__k{i}"))
    at_most = F.col("__at_most") + F.coalesce(F.col("__before") + F.when(F.col("__last"), F.col("__more")).otherwise(0), F.lit(0))
    return counted.join(around, same, "left").select(*keys, tie, (at_most / F.coalesce("__all", "__n")).alias(out))
