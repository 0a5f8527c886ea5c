"""Corpus tables: the best stored variant of each document, catalogue, samples, set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.ranking import top_per_group


def best_variant(manifests: DataFrame, tiebreak: Sequence[Column]) -> DataFrame:
    """One row per doc_id: complete runs first, then the most pages, then the order of `tiebreak`.

    Rows are combined map-side, so a document stored any number of times needs no window.
    """
    complete = F.coalesce((F.col("n_pages") == F.col("source_pages")).cast("int"), F.lit(0))
    order = [F.desc("canonical"), F.desc_nulls_last("n_pages"), *tiebreak]
    marked = manifests.filter("doc_id is not null").withColumn("canonical", complete)
    return top_per_group(marked, ["doc_id"], order, 1, F.col("source_path"), "__rank").drop("__rank").withColumn("canonical", F.col("canonical") == 1)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str) -> DataFrame:
    """The newest row per key: largest `order` columns, then largest `row_id`; nulls are oldest.

    Map-side combined; all columns of `df` travel with the aggregate, so select those that are needed first."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, row_id)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row")).select(*keys, "__row.*")


def nested_sample(df: DataFrame, category: str, item: str, per_category: int, seed: int = 0) -> DataFrame:
    """The first `per_category` items of each category in the order of a seeded hash: a smaller sample is always part
    of a larger one. Adds `draw`, the place in that order."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(category), F.lit("")), F.col(item).cast("string")), 256)
    once = df.select(category, item).distinct().withColumn("__order", order)
    return top_per_group(once, [category], [F.asc("__order"), F.asc(item)], per_category, F.col(item), "draw").drop("__order")


def compare_sets(**tables: DataFrame) -> DataFrame:
    """(name_a, name_b, both, only_a, only_b) for each pair of one-column key tables, duplicates and nulls aside.

    Every key is tagged with the tables that hold it and counted once; no table is compared with another.
    """
    names = sorted(tables)
    tagged = None
    for i, n in enumerate(names):
        d = tables[n].toDF("key").filter("key is not null").select("key", F.lit(1 << i).alias("bit"))
        tagged = d if tagged is None else tagged.unionByName(d)
    masks = tagged.groupBy("key").agg(F.bit_or("bit").alias("mask")).groupBy("mask").count()
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    has = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count")).otherwise(0)), F.lit(0)).cast("bigint")
    rows = masks.agg(F.array(*(F.struct(F.lit(names[i]).alias("name_a"), F.lit(names[j]).alias("name_b"), total(has(i) & has(j)).alias("both"), total(has(i) & ~has(j)).alias("only_a"), total(~has(i) & has(j)).alias("only_b")) for i, j in pairs)).alias("r"))
    return rows.select(F.explode("r").alias("r")).select("r.*")


def owner_as_of(rows: DataFrame, owners: DataFrame, row: str = "row", start: str = "start", size: str = "size") -> DataFrame:
    """Each row with the owner whose block [start, start + size) holds it; rows outside all blocks are left out.

    An as-of join without a comparison of all pairs: blocks are spread over buckets of row numbers.
    """
    width = 4096
    blocks = owners.filter(F.col(size) > 0).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(start) + F.col(size) - 1) / width))))
    placed = rows.withColumn("__b", F.floor(F.col(row) / width))
    return placed.join(blocks, "__b").filter((F.col(row) >= F.col(start)) & (F.col(row) < F.col(start) + F.col(size))).drop("__b")


def first_pages(pages: DataFrame, n: int, page: str = "page") -> DataFrame:
    """Pages up to number `n`, from 1."""
    return pages.filter(F.col(page) <= n)


def page_range(pages: DataFrame, first: int, last: int, limit: int, page: str = "page", text: str = "text") -> DataFrame:
    """Pages from `first` to `last` with `too_large`: whether the text has more than `limit` characters; null texts have none."""
    return pages.filter(F.col(page).between(first, last)).withColumn("too_large", F.coalesce(F.length(text), F.lit(0)) > limit)
