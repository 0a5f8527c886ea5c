"""Links in Markdown texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def links_outside_code(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, target): targets of inline links with their line number from 1, outside fenced and inline code.

    A line is inside a fence if an odd number of fence lines precede it; fence lines themselves hold no links.
    """
    lines = df.filter(F.col(text).contains("](")).select(key, F.split(F.col(text), "\n").alias("ls"))
    fence = lambda x: x.rlike(r"^\s*```").cast("int")
    # running parity as one pass over the lines of a text
    state = F.aggregate(
        "ls",
        F.struct(F.lit(0).alias("open"), F.array().cast("array<int>").alias("inside")),
        lambda s, x: F.struct(((s["open"] + fence(x)) % 2).alias("open"), F.concat(s["inside"], F.array(F.greatest(s["open"], fence(x)))).alias("inside")),
    )
    marked = lines.withColumn("inside", state["inside"]).select(key, F.posexplode(F.arrays_zip("ls", "inside")).alias("at", "x"))
    free = marked.filter("x.inside = 0").select(key, (F.col("at") + 1).cast("bigint").alias("line"), F.regexp_replace("x.ls", r"`[^`]*`", "").alias("t"))
    return free.select(key, "line", F.explode(F.regexp_extract_all("t", F.lit(r"\[[^\[\]]*\]\(([^()\s]+)\)"), F.lit(1))).alias("target"))
