"""Logs of a scorer: lines with the candidate whose section they stand in, and the numbers they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The lines of the log.
CANDIDATE, SUMMARY, SUMMED = r"^Candidate: (\S+)\s*$", "Final Summary with", r"^(\S+)\s*: Average Score: "
AVERAGE = r"^\s+Average Score: [\d.]+% \(\d+% CI: \[([\d.]+)%, ([\d.]+)%\]\) over (\d+) tests\."
FINAL = r"^\S+\s*: Average Score: (?:FAILED \(errors\)|([\d.]+)%)(?:\s*± ([\d.]+)%)?"
BY_TYPE = r"^ {4}(\S+)\s*: ([\d.]+)% average pass rate over (\d+)"
BY_FILE = r"^ {8}(\S+)\s*: [\d.]+% \((\d+)/(\d+) tests\)"
FAILED, ERROR = r"^\s+\[FAIL\] Test (.+)$", r"^\s+\[ERROR\] (.+)$"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, line, text): every line of every file with its number."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return whole.select("log", (F.col("line") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def sections(lines: DataFrame) -> DataFrame:
    """Adds `final` (the line stands in the final summary) and `candidate` (carried forward from the last heading)."""
    upto = Window.partitionBy("log").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    final = F.max(F.col("text").startswith(SUMMARY).cast("int")).over(upto) == 1
    marked = lines.withColumn("final", final)
    named = F.regexp_extract("text", CANDIDATE, 1)
    summed = F.regexp_extract("text", SUMMED, 1)
    name = F.when(~F.col("final") & (named != ""), named).when(F.col("final") & (summed != ""), summed)
    within = Window.partitionBy("log", "final").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("candidate", F.last(name, ignorenulls=True).over(within))


def _percent(text, pattern: str, group: int = 1):
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", F.round(found.cast("double") / 100, 4))


def scores(lines: DataFrame) -> DataFrame:
    """(log, candidate, overall, half_width, ci_low, ci_high, n_tests)."""
    t = F.col("text")
    average, final = AVERAGE, FINAL
    s = sections(lines).filter("candidate is not null")
    in_final = lambda c: F.max(F.when(F.col("final") & t.rlike(final), c))
    in_own = lambda c: F.max(F.when(~F.col("final") & t.rlike(average), c))
    return s.groupBy("log", "candidate").agg(
        in_final(_percent(t, final, 1)).alias("overall"), in_final(_percent(t, final, 2)).alias("half_width"),
        in_own(_percent(t, average, 1)).alias("ci_low"), in_own(_percent(t, average, 2)).alias("ci_high"),
        in_own(F.regexp_extract(t, average, 3).cast("int")).alias("n_tests"),
    )


def breakdown(lines: DataFrame) -> DataFrame:
    """(log, candidate, kind, name, rate, passed, total): rates by type of test, counts by file."""
    t = F.col("text")
    kind, file = BY_TYPE, BY_FILE
    s = sections(lines).filter("final and candidate is not null")
    types = s.filter(t.rlike(kind)).select("log", "candidate", F.lit("type").alias("kind"), F.regexp_extract(t, kind, 1).alias("name"), _percent(t, kind, 2).alias("rate"), F.lit(None).cast("int").alias("passed"), F.regexp_extract(t, kind, 3).cast("int").alias("total"))
    files = s.filter(t.rlike(file)).select("log", "candidate", F.lit("file").alias("kind"), F.regexp_replace(F.regexp_extract(t, file, 1), r"\.jsonl$", "").alias("name"), F.lit(None).cast("double").alias("rate"), F.regexp_extract(t, file, 2).cast("int").alias("passed"), F.regexp_extract(t, file, 3).cast("int").alias("total"))
    return types.unionByName(files)


def failed_tests(lines: DataFrame, known: DataFrame) -> DataFrame:
    """(log, candidate, test): ids of failed tests. An id may itself hold " on ": the shortest beginning before one that
    is a known id counts, else the shortest beginning."""
    rest = F.regexp_extract("text", FAILED, 1)
    s = sections(lines).filter("not final and candidate is not null").select("log", "candidate", "line", rest.alias("rest")).filter("rest != ''")
    words = F.split("rest", " on ")
    cuts = s.select("log", "candidate", "line", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(words, F.lit(1), n), " on ").alias("id")))).alias("c")).filter("c.id is not null")
    ids = known.select(F.col(known.columns[0]).alias("id"), F.lit(True).alias("known")).distinct()
    met = cuts.select("log", "candidate", "line", "c.n", "c.id").join(ids, "id", "left")
    best = met.groupBy("log", "candidate", "line").agg(F.min(F.struct(F.coalesce("known", F.lit(False)).cast("int") * -1, "n", "id")).alias("b"))
    return best.select("log", "candidate", F.col("b.id").alias("test")).distinct()


def errors(lines: DataFrame) -> DataFrame:
    """(log, candidate, message) of error lines."""
    message = F.regexp_extract("text", ERROR, 1)
    return sections(lines).filter("not final and candidate is not null").select("log", "candidate", message.alias("message")).filter("message != ''")
