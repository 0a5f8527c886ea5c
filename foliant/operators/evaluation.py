"""Test suites and their units: listing, scoring by failures, exclusions, extremes, merged scores."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.corpus import latest


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """(category, pdf, page, id, type, …) of JSON-lines test files, the category from the name of the file or of the folder that holds its parts."""
    rows = spark.read.schema("pdf string, page int, id string, type string, max_diffs int, checked string").json(path)
    return rows.withColumn("category", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1))


def samples(tests: DataFrame, order: Sequence[str]) -> DataFrame:
    """(pdf, category, tests): one sample per file; the first category in `order` that tests it wins, others by name."""
    place = F.coalesce(*(F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(order)), F.lit(len(order)))
    counts = tests.filter("pdf is not null").groupBy("pdf", "category").agg(F.count("*").alias("tests")).withColumn("__p", place)
    return counts.groupBy("pdf").agg(F.min(F.struct("__p", "category", "tests")).alias("s")).select("pdf", "s.category", "s.tests")


def with_baseline(tests: DataFrame) -> DataFrame:
    """Adds a baseline test for every file that has none."""
    has = tests.filter("type = 'baseline'").select("pdf").distinct()
    bare = tests.select("pdf", "category").groupBy("pdf").agg(F.min("category").alias("category")).join(has, "pdf", "left_anti")
    extra = bare.select("pdf", "category", F.concat("pdf", F.lit("_baseline")).alias("id"), F.lit("baseline").alias("type"))
    return tests.unionByName(extra, allowMissingColumns=True)


def unit_scores(tests: DataFrame, failed: DataFrame, candidate: str = "candidate") -> DataFrame:
    """(candidate, unit, group, cluster, value): 1 for every test that no failure names, 0 for the others.

    `failed` holds (candidate, test); a candidate without any failure must be in it with a null test.
    """
    names = failed.filter(F.col(candidate).isNotNull()).agg(F.collect_set(candidate).alias("__names"))  # one row: a run has few candidates
    units = tests.select(F.col("id").alias("unit"), F.col("category").alias("group"), F.col("pdf").alias("cluster"))
    every = units.crossJoin(F.broadcast(names)).select("unit", "group", "cluster", F.explode("__names").alias("__c"))
    misses = failed.filter("test is not null").select(F.col(candidate).alias("__c"), F.col("test").alias("unit"), F.lit(0.0).alias("__v")).distinct()
    return every.join(misses, ["__c", "unit"], "left").select(F.col("__c").alias(candidate), "unit", "group", "cluster", F.coalesce("__v", F.lit(1.0)).alias("value"))


def cluster_key(pdf: Column, page: Column) -> Column:
    """The page that all degraded copies of it share, pages from 0."""
    return F.format_string("%s#p%03d", pdf, page + 1)


def merged_scores(old: DataFrame, new: DataFrame, name: str = "candidate") -> DataFrame:
    """Scores by candidate, the new ones replacing the old."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(both, [name], ["__new"], "__new").drop("__new")


def exploded_scores(scores: DataFrame, name: str = "candidate", metrics: str = "metrics") -> DataFrame:
    """(candidate, metric, mean, low, high, n) from a map of estimates."""
    return scores.select(name, F.explode(metrics).alias("metric", "e")).select(name, "metric", "e.mean", "e.low", "e.high", "e.n")


def without_clusters(units: DataFrame, excluded: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Units of the headline: those of excluded clusters are scored apart."""
    return units.join(excluded.select(cluster), cluster, "left_anti")


def subset_mean(units: DataFrame, keep: DataFrame, keys: Sequence[str], group: str, value: str, cluster: str = "cluster") -> DataFrame:
    """(keys, mean): mean of group means over the clusters in `keep`."""
    kept = units.join(keep.select(cluster).distinct(), cluster, "left_semi").filter(F.col(value).isNotNull())
    return kept.groupBy(*keys, group).agg(F.avg(value).alias("m")).groupBy(*keys).agg(F.avg("m").alias("mean"))


def long_enough(pages: DataFrame, text: str, least: int) -> DataFrame:
    """Pages with at least `least` characters that are no white space; null texts have none."""
    return pages.filter(F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s", "")) >= least)


def blank_output(text: Column) -> Column:
    """An output without anything but white space or a header of settings."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    header = F.json_object_keys(bare)
    only = F.size(F.array_except(header, F.array(*(F.lit(k) for k in ("primary_language", "is_rotation_valid", "rotation_correction", "is_table", "is_diagram"))))) == 0
    return (bare == "") | F.coalesce(bare.startswith("{") & header.isNotNull() & only, F.lit(False))


def extremes(rows: DataFrame, name: str, value: str) -> DataFrame:
    """One row: who is lowest and highest on `value`, both values and their ratio; ties by name."""
    known = rows.filter(F.col(value).isNotNull())
    got = known.agg(F.min(F.struct(F.col(value).alias("v"), F.col(name).alias("n"))).alias("a"), F.max(F.struct(F.col(value).alias("v"), F.col(name).alias("n"))).alias("b"))
    return got.select(F.col("a.n").alias("lowest"), F.col("a.v").alias("lowest_value"), F.col("b.n").alias("highest"), F.col("b.v").alias("highest_value"), F.try_divide("b.v", "a.v").alias("ratio"))


def by_first_appearance(contexts: DataFrame, query: str, doc: str, place: str) -> DataFrame:
    """(query, doc, contexts, number): documents in the order of their first context, from 1."""
    firsts = contexts.groupBy(query, doc).agg(F.min(place).alias("__first"), F.count("*").alias("contexts"))
    return firsts.withColumn("number", F.row_number().over(Window.partitionBy(query).orderBy("__first", doc)).cast("bigint")).drop("__first")  # bounded by the contexts of a question


def covers_all(answers: DataFrame, request: str, index: str, size: str) -> DataFrame:
    """Requests whose answers do not carry exactly the places 0 to size - 1, each once."""
    per = answers.groupBy(request).agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi"), F.max(size).alias("size"))
    return per.filter("n != size or d != size or lo != 0 or hi != size - 1").select(request)


def simple_bootstrap(values: DataFrame, keys: Sequence[str], value: str, n: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(keys, mean, low, high): percentile bootstrap of a mean over single units, which a key must hold few of (use
    `statistics.bootstrap` over clusters otherwise). Ends are order statistics by index."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        v = f[value].dropna().tolist()
        if not v:
            return pd.DataFrame([(*key, None, None, None)], columns=[*keys, "mean", "low", "high"])
        rng = random.Random(seed)
        means = sorted(sum(rng.choices(v, k=len(v))) / len(v) for _ in range(n))
        return pd.DataFrame([(*key, sum(v) / len(v), means[int(n * alpha / 2)], means[int(n * (1 - alpha / 2)) - 1])], columns=[*keys, "mean", "low", "high"])

    schema = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys) + ", mean double, low double, high double"
    return values.select(*keys, value).groupBy(*keys).applyInPandas(run, schema)


def shared_and_added(first: DataFrame, second: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, state): clusters of the second round that the first had too, and those added."""
    a = first.select(cluster).distinct().withColumn("__a", F.lit(True))
    return second.select(cluster).distinct().join(a, cluster, "left").select(cluster, F.when(F.col("__a"), "shared").otherwise("added").alias("state"))


def output_path(candidate: Column, pdf: Column) -> Column:
    """Where a scorer finds a candidate's output for the first page of a file."""
    return F.concat(candidate, F.lit("/"), F.regexp_replace(pdf, r"\.pdf$", ""), F.lit("_pg1_repeat1.md"))


def truth_pages(records: DataFrame, truth: DataFrame, doc: str = "doc_id", page: str = "page", pages: str = "pages") -> DataFrame:
    """`records` (doc, page, …) with the `truth` of their page, from (doc, pages: an array in order), and `complete`:
    whether the document has as many records as true pages. Pages without either side are left out."""
    true = truth.select(doc, F.size(pages).alias("__n"), F.posexplode(pages).alias("__at", "truth")).withColumn(page, F.col("__at") + 1).drop("__at")
    have = records.groupBy(doc).agg(F.count("*").alias("__have"))
    return records.join(true, [doc, page]).join(have, doc).withColumn("complete", F.col("__have") == F.col("__n")).drop("__n", "__have")


def suite_identity(samples: DataFrame, suite: str, sample: str) -> DataFrame:
    """(suite, samples, identity): the SHA-256 over the digests of a suite's distinct samples in order, in ranges of their
    own digests, so that no suite is brought together."""
    each = samples.select(suite, F.sha2(F.col(sample), 256).alias("d")).distinct()
    ranges = each.groupBy(suite, F.substring("d", 1, 2).alias("r")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("k"))
    whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "k"))), lambda x: x["k"]), ""), 256)
    return ranges.groupBy(suite).agg(F.sum("n").alias("samples"), whole.alias("identity"))


def given_documents(contexts: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Contexts with `given`: whether their document is among `documents`; one that is not is the caller's error."""
    known = documents.select(doc).distinct().withColumn("__given", F.lit(True))
    return contexts.join(known, doc, "left").withColumn("given", F.coalesce("__given", F.lit(False))).drop("__given")
