"""Runs of candidates: latest attempts, speed and failure rates, streaks, budgets, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.ranking import prefix_sums, running_sums


def _rate(hits: Column) -> Column:
    """Share of the ok rows for which `hits` holds, 4 digits, null without ok rows."""
    ok = F.col("error").isNull()
    return F.round(F.try_divide(F.sum(F.when(ok & F.coalesce(hits, F.lit(False)), 1.0).otherwise(0.0)), F.sum(F.when(ok, 1.0).otherwise(0.0))), 4)


def throughput_columns(digits: int = 3, total_digits: int = 1) -> list[Column]:
    """Aggregates over the latest record of each sample (with `empty`: it has no text): counts, exact quantiles of seconds, speed and its basis,
    peak memory, truncation, retry and empty rates; quantiles keep `digits` digits, totals and speeds `total_digits`. Rows with an error count only as errors."""
    ok = F.col("error").isNull()
    seconds = F.when(ok, F.col("seconds"))
    decode = F.bool_and(F.when(ok, F.col("gen_seconds").isNotNull()))
    timed = ok & F.col("seconds").isNotNull() & (F.col("seconds") > 0) & F.col("gen_tokens").isNotNull()
    used = F.when(F.coalesce("total_gen_tokens", F.lit(0)) > 0, F.col("total_gen_tokens")).otherwise(F.col("gen_tokens"))
    by_decode = F.try_divide(F.sum(F.when(ok, F.coalesce("total_gen_tokens", F.lit(0)))), F.nullif(F.sum(F.when(ok, F.col("gen_seconds"))), F.lit(0.0)))
    by_page = F.try_divide(F.sum(F.when(timed, used)), F.nullif(F.sum(F.when(timed, F.col("seconds"))), F.lit(0.0)))
    speed = F.when(decode, by_decode).otherwise(by_page)
    known = F.sum(F.when(ok & F.col("attempts").isNotNull(), 1).otherwise(0))
    return [
        F.count("*").alias("pages"),
        F.sum(ok.cast("int")).cast("bigint").alias("ok"),
        F.sum((~ok).cast("int")).cast("bigint").alias("errors"),
        F.round(F.percentile(seconds, 0.5), digits).alias("median_s"),
        F.round(F.percentile(seconds, 0.9), digits).alias("p90_s"),
        F.round(F.coalesce(F.sum(seconds), F.lit(0.0)), total_digits).alias("total_s"),
        F.round(speed, total_digits).alias("gen_tok_s"),
        F.when(speed.isNotNull(), F.when(decode, "decode").otherwise("end-to-end")).alias("gen_tok_s_basis"),
        F.round(F.max(F.when(ok, F.col("peak_memory_gb"))), 2).alias("peak_memory_gb"),
        _rate(F.coalesce("first_finish_reason", "finish_reason") == "length").alias("first_truncation_rate"),
        _rate(F.col("finish_reason") == "length").alias("truncation_rate"),
        F.when(known > 0, F.round(F.try_divide(F.sum(F.when(ok & (F.col("attempts") > 1), 1.0).otherwise(0.0)), F.sum(F.when(ok, 1.0).otherwise(0.0))), 4)).alias("retried_rate"),
        F.coalesce(known < F.sum(ok.cast("int")), F.lit(False)).alias("lower_bound"),
        _rate(F.col("empty")).alias("empty_rate"),
    ]


def throughput(records: DataFrame, overall: str, category: str, digits: int = 3, total_digits: int = 1) -> DataFrame:
    """The aggregates per `overall` and, at a second grain, per `category` in it (null category: overall)."""
    # an "Expand" of only the columns the aggregates read, each grain combined map-side
    return records.groupingSets([[F.col(overall)], [F.col(overall), F.col(category)]], F.col(overall), F.col(category)).agg(F.grouping(category).cast("int").alias("is_overall"), *throughput_columns(digits, total_digits))


def failure_streaks(records: DataFrame, keys: list[str], order: list[str], failed: Column, bucket: Column | None = None) -> DataFrame:
    """(keys, streak, length, first, last) of every run of consecutive failures, by gaps and islands; `first` and
    `last` are the first order column at its ends. Streaks are numbered from 1 inside a key.

    An island is numbered by the successes before it: a running sum over buckets of the order, since a key may hold any
    share of the rows.
    """
    marked = records.select(*dict.fromkeys([*keys, *order]), F.coalesce(failed, F.lit(False)).alias("__f")).withColumn("__ok", (~F.col("__f")).cast("long"))
    placed = running_sums(marked, keys, order, F.lit(0) if bucket is None else bucket, "__ok", "__island")
    runs = placed.filter("__f").groupBy(*keys, "__island").agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    numbered = prefix_sums(runs.withColumn("__one", F.lit(1)), keys, "__island", "__one", "__before", 4096)
    return numbered.withColumn("streak", (F.col("__before") + 1).cast("bigint")).drop("__island", "__one", "__before")


def within_budget(records: DataFrame, keys: list[str], order: list[str], seconds: str, budget: float, bucket: Column | None = None) -> DataFrame:
    """Records that begin before the running time of their key has reached `budget`; adds `elapsed` before the record."""
    return running_sums(records, keys, order, F.lit(0) if bucket is None else bucket, seconds, "elapsed").filter(F.col("elapsed") < budget)


def rank_candidates(scores: DataFrame, name: str, mean: str, has_errors: str, higher_is_better: str) -> DataFrame:
    """Adds `place`: complete candidates before those with errors before those without score, better means first (in
    the metric's own direction), then names. One row per candidate is ranked."""
    tier = F.when(F.col(mean).isNull(), 2).when(F.col(has_errors), 1).otherwise(0)
    value = F.when(F.col(mean).isNull(), F.lit(None)).when(F.col(higher_is_better), -F.col(mean)).otherwise(F.col(mean))
    return scores.withColumn("place", F.row_number().over(Window.orderBy(tier, F.asc_nulls_last(value), name)).cast("bigint"))


def stale_scores(saved: DataFrame, current: DataFrame, name: str, version: int) -> DataFrame:
    """(name, stale): candidates whose saved score is missing, failed, incomplete, under other rules, or older than
    the telemetry. `saved`: name, errors, n_outputs, n_samples, mean, scoring_version, records; `current`: name, records."""
    s = saved.select(F.col(name).alias("__n"), "errors", "n_outputs", "n_samples", "mean", "scoring_version", F.col("records").alias("__seen"))
    j = current.join(s, F.col(name) == F.col("__n"), "left")
    bad = F.col("__n").isNull() | (F.coalesce("errors", F.lit(0)) > 0) | (F.col("n_outputs") < F.col("n_samples")) | F.col("mean").isNull() | (F.col("scoring_version") != version) | ~F.col("__seen").eqNullSafe(F.col("records"))
    return j.select(name, F.coalesce(bad, F.lit(True)).alias("stale"))


def todo(samples: DataFrame, outputs: DataFrame, failures: DataFrame | None, key: str) -> DataFrame:
    """Samples without output, and those that failed last time if `failures` are to be retried."""
    missing = samples.join(outputs.select(key), key, "left_anti")
    if failures is None:
        return missing
    return missing.unionByName(samples.join(failures.select(key), key, "left_semi")).dropDuplicates([key])


def attempt_ladder(max_tokens: Column, retries: Column) -> Column:
    """The attempts that may be made for a page: token limits and temperatures, the first one plain, later ones warmer."""
    step = F.transform(F.sequence(F.lit(0), F.greatest(retries, F.lit(0))), lambda i: F.struct((i + 1).alias("attempt"), max_tokens.alias("max_tokens"), (i * 0.2).alias("temperature")))
    return step


def acceptable(finish_reason: Column, text: Column) -> Column:
    """Whether an attempt may stand: it ended by itself and is not blank."""
    return F.coalesce(finish_reason != "length", F.lit(True)) & (F.trim(F.coalesce(text, F.lit(""))) != "")


def environmental(code: Column) -> Column:
    """Whether an exit code points at the machine rather than the document."""
    return F.coalesce(~code.between(1, 99), F.lit(True))


def run_counters(samples: DataFrame, outputs_before: DataFrame, attempts: DataFrame, key: str = "sample_id") -> DataFrame:
    """(candidate, total, skipped, done, errors, remaining) of one run per candidate."""
    total = samples.select(key).distinct().agg(F.count("*").alias("total"))
    before = outputs_before.select("candidate", key).distinct().groupBy("candidate").agg(F.count("*").alias("skipped"))
    now = attempts.groupBy("candidate").agg(F.sum(F.col("error").isNull().cast("bigint")).alias("done"), F.sum(F.col("error").isNotNull().cast("bigint")).alias("errors"))
    both = before.join(now, "candidate", "full_outer").na.fill(0, ["skipped", "done", "errors"]).crossJoin(F.broadcast(total))  # one row
    return both.select("candidate", "total", "skipped", "done", "errors", (F.col("total") - F.col("skipped") - F.col("done") - F.col("errors")).alias("remaining"))


def medians(records: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median): exact medians of the known values."""
    return records.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("median"))


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, place): values by descending count, ties by value; nulls aside. Distinct values are ranked, not rows."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), column)).cast("bigint"))


def page_record(rows: DataFrame, page: Column, text: Column, seconds: Column, model: Column) -> DataFrame:
    """`rows` as page rows of a manifest: index from 0, method, characters, seconds of three digits, and the model."""
    return rows.withColumns({"index": (page - 1).cast("int"), "method": F.lit("ocr"), "n_chars": F.length(F.coalesce(text, F.lit(""))).cast("bigint"), "seconds": F.round(seconds, 3), "model": model})
