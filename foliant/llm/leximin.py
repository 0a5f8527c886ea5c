"""Problem 7: one ranking from scores that cannot be compared.

Each score becomes a percentile of its own list, an item's percentiles are sorted ascending, and the sorted arrays are
compared lexicographically, larger first (leximin): an item is as good as its weakest score, ties fall to the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.ranking import reached_shares, top_per_group


def percentile_vectors(df: DataFrame, group: str, item: str, rater: str, score: str, raters: Sequence[str]) -> DataFrame:
    """One row per (group, item): `percentiles`, sorted ascending, one entry per rater of `raters`.

    The percentile of a score is the share of the list's scored rows that it reaches or exceeds, so equal scores get
    equal percentiles and any strictly increasing rescaling of a list changes nothing. An item that a list lacks, or
    holds only with a null score, has percentile 0 there: nothing speaks for it. An item listed twice counts once,
    with its larger score. Rows with a null group, item or rater, or a rater not in `raters`, take no part.
    """
    known = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(rater).isin(*raters))
    once = known.filter(F.col(score).isNotNull()).groupBy(group, item, rater).agg(F.max(score).alias("__score"))
    shares = reached_shares(once, [group, rater], "__score", item, "__percent", df.select().count())  # read from the files' footers
    # items that have null scores only are in the ranking too
    unscored = known.filter(F.col(score).isNull()).select(group, rater, item).distinct().withColumn("__percent", F.lit(0.0))
    scored = shares.unionByName(unscored)
    per_rater = [F.coalesce(F.max(F.when(F.col(rater) == r, F.col("__percent"))), F.lit(0.0)) for r in raters]
    return scored.groupBy(group, item).agg(F.array_sort(F.array(*per_rater)).alias("percentiles"))


def leximin_ranking(
    hits: DataFrame, questions: DataFrame, raters: Sequence[str] = ("dense", "keyword", "rerank")
) -> DataFrame:
    """(question_id, chunk_id, percentiles, rank): the first `top_k` chunks of each question's leximin order.

    Ties of whole vectors fall to the smaller chunk_id. A question that repeats takes its largest top_k; one without
    top_k, or with none above 0, has no rows. A question may hold any share of all hits: its ranking is salted.
    """
    vectors = percentile_vectors(hits.select("question_id", "chunk_id", "retriever", "score"), "question_id", "chunk_id", "retriever", "score", raters)
    wanted = questions.groupBy("question_id").agg(F.max("top_k").alias("top_k"))
    order = [F.desc(F.col("percentiles")[i]) for i in range(len(raters))] + [F.asc("chunk_id")]
    ranked = top_per_group(vectors.join(wanted, "question_id"), ["question_id"], order, F.col("top_k"), F.col("chunk_id"))
    return ranked.select("question_id", "chunk_id", "percentiles", "rank")
