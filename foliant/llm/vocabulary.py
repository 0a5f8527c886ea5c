"""Corpus word counts, bounded in every worker and combined before the shuffle."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct entries that a worker counts before it hands them on.
HELD = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def lower_words(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def word_counts(df: DataFrame, text: str, group: str | None = None, words: Callable[[str], list[str]] = lower_words) -> DataFrame:
    """(grp, word, n): how often each word occurs in all texts, per value of `group` ('' for null or none given).

    Each partition counts in memory and emits its table whenever that holds HELD entries, so a word is shuffled about
    once per partition rather than once per occurrence. Null texts count nothing.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def emit() -> pd.DataFrame:
            rows = [(g, w, n) for g, c in held.items() for w, n in c.items()]
            held.clear()
            return pd.DataFrame(rows, columns=["grp", "word", "n"])

        for f in frames:
            for g, t in zip(f["g"], f["t"]):
                held.setdefault(g, Counter()).update(words(t))
            if sum(map(len, held.values())) > HELD:
                yield emit()
        yield emit()

    g = F.coalesce(F.col(group), F.lit("")) if group else F.lit("")
    rows = df.filter(F.col(text).isNotNull()).select(g.alias("g"), F.col(text).alias("t"))
    return rows.mapInPandas(count, "grp string, word string, n long").groupBy("grp", "word").agg(F.sum("n").alias("n"))
