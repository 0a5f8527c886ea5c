"""Small result tables as Markdown, on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "–"


def number(x: float | None, digits: int = 3) -> str:
    return MISSING if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.{digits}f}"


def percent(x: float | None, digits: int = 1) -> str:
    return MISSING if x is None or math.isnan(x) else f"{100 * x:.{digits}f} %"


def interval(mean: float | None, low: float | None, high: float | None, digits: int = 3) -> str:
    """`mean [low, high]`, the mean alone without an interval."""
    if mean is None or math.isnan(mean):
        return MISSING
    return number(mean, digits) if low is None or high is None or math.isnan(low) else f"{number(mean, digits)} [{number(low, digits)}, {number(high, digits)}]"


def p_value(p: float | None) -> str:
    return MISSING if p is None or math.isnan(p) else "< 0.001" if p < 0.001 else f"{p:.3f}"


def table(df: DataFrame, limit: int = 200) -> str:
    """A Markdown table of a small result; cells with pipes are escaped. Longer results are cut and say so."""
    rows = df.limit(limit + 1).collect()
    cell = lambda v: MISSING if v is None else number(v) if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:limit]]
    return "\n".join(lines + ([f"… more than {limit} rows"] if len(rows) > limit else []))


def report(title: str, **parts: DataFrame) -> str:
    """A Markdown document with one section per table."""
    return "\n\n".join([f"# {title}", *(f"## {n.replace('_', ' ')}\n\n{table(d)}" for n, d in parts.items())]) + "\n"


def result_table(scores: DataFrame, throughput: DataFrame, tests: DataFrame, name: str = "candidate") -> DataFrame:
    """Candidates best first with interval, speed, and the verdict against the best one."""
    return scores.join(throughput, name, "left").join(tests, name, "left").orderBy(F.asc_nulls_last("place"))


def score_gate(outputs: DataFrame, samples: DataFrame, name: str = "candidate", key: str = "sample_id") -> DataFrame:
    """(candidate, n_outputs, n_samples, problem): candidates whose outputs are incomplete get a problem, not a score."""
    total = samples.select(key).distinct().agg(F.count("*").alias("n_samples"))
    have = outputs.join(samples.select(key).distinct(), key, "left_semi").groupBy(name).agg(F.countDistinct(key).alias("n_outputs"))
    short = F.col("n_outputs") < F.col("n_samples")
    return have.crossJoin(F.broadcast(total)).withColumn("problem", F.when(short, F.concat((F.col("n_samples") - F.col("n_outputs")).cast("string"), F.lit(" outputs missing"))))  # one row


def not_in_second_round(first: DataFrame, second: DataFrame, name: str = "candidate") -> DataFrame:
    """Candidates that the first round could not tell from the best, but that the second lacks."""
    return first.filter("verdict in ('best', 'tied')").join(second.select(name), name, "left_anti").select(name)


def formatted(rows: DataFrame, name: str, mean: str, low: str, high: str, share: str) -> DataFrame:
    """(name, estimate, share): an interval and a share as text, the same as `interval` and `percent` print them."""
    fixed = lambda c, d: F.format_string(f"%.{d}f", F.col(c).cast("double"))
    estimate = F.when(F.col(mean).isNull(), MISSING).when(F.col(low).isNull() | F.col(high).isNull(), fixed(mean, 3)).otherwise(F.concat(fixed(mean, 3), F.lit(" ["), fixed(low, 3), F.lit(", "), fixed(high, 3), F.lit("]")))
    return rows.select(name, estimate.alias("estimate"), F.when(F.col(share).isNull(), MISSING).otherwise(F.concat(F.format_string("%.1f", F.col(share) * 100), F.lit(" %"))).alias("share"))
