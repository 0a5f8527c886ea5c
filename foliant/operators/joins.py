"""Joins for keys that may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.ranking import SALTS


def salted_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """`left` with the columns of `right`, whose rows must be unique in `keys` and few beside those of `left`.

    Every right row is repeated `salts` times and each left row meets one copy, chosen by a hash of `spread`; so the left
    rows of one key go to up to `salts` tasks. Rows of a null key keep nulls.
    """
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [*keys, "__salt"], "left").drop("__salt")


#: Rows of the right side up to which a join is told to broadcast it.
BROADCAST_ROWS = 20_000


def small_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, most: int = BROADCAST_ROWS) -> DataFrame:
    """`salted_left_join` for a right side that is written already: it is counted, and broadcast up to `most` rows."""
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), [*keys], "left")
    return salted_left_join(left, right, keys, spread)


def small_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread: Column, most: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """The inner join of `left` with a right side that is written already: broadcast up to `most` rows; beyond them its
    rows are repeated for `salts` parts of the left rows, so that a hot key goes to as many tasks."""
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), [*keys])
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(copies, [*keys, "__salt"]).drop("__salt")


def semi_join(left: DataFrame, keys: DataFrame, key: str, most: int = 50 * BROADCAST_ROWS) -> DataFrame:
    """The rows of `left` whose `key` is among `keys` (one column, written already), which are broadcast up to `most`."""
    few = keys.limit(most + 1).count() <= most
    return left.join(F.broadcast(keys) if few else keys, key, "left_semi")
