"""Problem 10: how demanding a text is, on the scale of human labels.

Words are ranked by corpus frequency inside their language. A document's coverage rank is the size of the smallest
frequency-ranked vocabulary that covers a fixed share of its words; together with measures of sentence complexity it is
calibrated to the labelled documents by SQL aggregates: class means per language, shrunk to those of all languages, and
one pooled covariance give a linear discriminant, whose score is an expression over the feature columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.vocabulary import LETTERS, word_counts
from foliant.operators.ranking import value_ranks
from foliant.tables import materialize

#: Words that are broadcast with their ranks, over all languages together the most frequent ones; rarer ones are joined.
VOCABULARY = 200_000
SHARES = (0.80, 0.95)
MIN_WORDS = 60
#: Labelled rows by which a language's class mean is drawn to the mean of all languages.
SHRINK = 5.0
FEATURES = ("rank_80", "rank_95", "sentence_words", "word_chars", "long_words", "very_long_words", "stops")
SENTENCE = re.compile(r"[.!?…]+[\"”»'’)\]]*\s+|\n\s*\n")
STOPS = re.compile(r"[,;:()]")


def ranked_vocabulary(counts: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """(grp, word, rank) of the words of `counts` (grp, word, n) that are frequent enough for at most `most` of all
    languages to be, ranked inside their language; and whether those are all words."""
    level, total, floor = F.floor(F.log2("n") * 8).cast("int"), 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # a few hundred levels at most
        total += r["count"]
        if total > most:
            floor = r["level"] + 1
            break
    some = counts if floor is None else counts.filter(level >= floor)
    inside = Window.partitionBy("grp").orderBy(F.desc("n"), F.asc("word"))  # at most `most` rows
    return some.select("grp", "word", F.row_number().over(inside).alias("rank")), floor is None


def reading_features(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(key, lang, n_words, FEATURES) of every text of at least `min_words` words, split at whitespace.

    Ranks are natural logarithms. A word's rank is its place among the words of its language with a non-null code, by
    count; one too rare to be broadcast has the number of words that are at least as frequent, from a join. A text
    without language code gets the language whose 100 most frequent words cover most of it. Null keys and texts, and
    texts without any letter, give no rows; keys must be unique.
    """
    rows = documents.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    counts = materialize(word_counts(documents.filter(F.col(lang).isNotNull()), text, lang))
    sent, whole = ranked_vocabulary(counts, vocabulary)
    ranks: dict[str, dict[str, int]] = {}
    for r in sent.toPandas().itertuples(index=False):
        ranks.setdefault(r.grp, {})[r.word] = r.rank
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        common = {g: {w for w, r in t.items() if r <= 100} for g, t in table.items()}
        for f in frames:
            out = []
            for k, t, g in zip(f["k"], f["t"], f["l"]):
                n = len(t.split())
                words = LETTERS.findall(t.lower()) if n >= min_words else []
                if not words:
                    continue
                if g not in table and (g is None or whole):
                    g = max(sorted(table), key=lambda x: sum(w in common[x] for w in words), default="")
                own = table.get(g, {})
                beyond = len(own) + 1
                rank = np.fromiter((own.get(w, beyond) for w in words), dtype="int64", count=len(words))
                at = [min(len(words) - 1, int(len(words) * s)) for s in SHARES]
                rank.partition(at)
                # places among the words that are not here, and those words, where a rank is one of theirs
                short = int((rank < beyond).sum())
                asked = [] if whole else [a - short for a in at]
                rest = [w for w in words if w not in own] if asked and max(asked) >= 0 else []
                size = np.fromiter(map(len, words), dtype="int64", count=len(words))
                sentences = max(1, sum(1 for s in SENTENCE.split(t) if s.strip()))
                out.append((k, g, n, *np.log(rank[at]).tolist(), float(np.log(len(words) / sentences)), float(size.mean()), float((size >= 9).mean()), float((size >= 12).mean()), len(STOPS.findall(t)) / sentences, asked if rest else [], rest))
            if out:
                yield pd.DataFrame(out, columns=[key, "lang", "n_words", *FEATURES, "__asked", "__rest"])

    kind = documents.schema[key].dataType.simpleString()
    measured = rows.mapInPandas(measure, f"{key} {kind}, lang string, n_words int, " + ", ".join(f"{c} double" for c in FEATURES) + ", __asked array<int>, __rest array<string>")
    if whole:
        return measured.drop("__asked", "__rest")
    measured = materialize(measured)
    # the rarer words of the texts that need them meet their ranks; a word of no language is beyond all
    rare = value_ranks(counts, ["grp"], "n").select("grp", "n", (F.col("n_group") - F.col("n_below")).alias("place"), F.col("n_group").alias("all"))
    places = counts.join(rare, ["grp", "n"]).select(F.col("grp").alias("lang"), "word", "place")
    sizes = rare.groupBy(F.col("grp").alias("lang")).agg(F.max("all").alias("all"))
    asked = measured.filter(F.size("__rest") > 0).select(key, "lang", F.explode("__rest").alias("word"))
    met = asked.join(places.hint("merge"), ["lang", "word"], "left").join(F.broadcast(sizes), "lang", "left")  # a row per language
    found = met.groupBy(key).agg(F.sort_array(F.collect_list(F.coalesce("place", F.col("all") + 1, F.lit(1)))).alias("__places"))  # the words of one text
    done = measured.join(found, key, "left")
    rank = lambda i, c: F.when((F.size("__rest") > 0) & (F.get("__asked", F.lit(i)) >= 0), F.log(F.get("__places", F.get("__asked", F.lit(i))).cast("double"))).otherwise(F.col(c))
    return done.withColumns({"rank_80": rank(0, "rank_80"), "rank_95": rank(1, "rank_95")}).select(key, "lang", "n_words", *FEATURES)


def _discriminants(labelled: DataFrame) -> dict[tuple[str, int], tuple[float, list[float]]]:
    """Per (language, level) the constant and the weights of its linear score, from SQL moments of `labelled`.

    Only sums over groups reach the driver: a row per language and level, and one of pooled second moments.
    """
    spark = labelled.sparkSession
    d = len(FEATURES)
    cells = spark.sql(f"select lang, level, count(*) as n, {', '.join(f'avg({c}) as {c}' for c in FEATURES)} from {{t}} group by lang, level", t=labelled).collect()
    if not cells:
        return {}
    products = ", ".join(f"sum({FEATURES[i]} * {FEATURES[j]}) as m_{i}_{j}" for i in range(d) for j in range(i, d))
    moments = spark.sql(f"select count(*) as n, {products} from {{t}}", t=labelled).first()
    second = np.array([[moments[f"m_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    mean = {(c.lang, c.level): (c.n, np.array([c[x] for x in FEATURES])) for c in cells}
    within = second - sum(n * np.outer(m, m) for n, m in mean.values())
    grand = sum(n * m for n, m in mean.values()) / moments.n
    total = np.diag(second) / moments.n - grand**2
    pooled = within / moments.n + np.diag(0.01 * total + 1e-6)
    inverse = np.linalg.inv(pooled)
    levels = sorted({level for _, level in mean})
    overall = {level: sum(n * m for (_, y), (n, m) in mean.items() if y == level) / sum(n for (_, y), (n, _) in mean.items() if y == level) for level in levels}
    scores = {}
    for language in sorted({x for x, _ in mean}) + [""]:
        for level in levels:
            n, m = mean.get((language, level), (0, np.zeros(d)))
            mu = (n * m + SHRINK * overall[level]) / (n + SHRINK)
            w = inverse @ mu
            scores[language, level] = (float(-0.5 * mu @ w), [float(x) for x in w])
    return scores


def _level(scores: dict[tuple[str, int], tuple[float, list[float]]]):
    """The level with the largest linear score, as an expression over the feature columns; null without labels."""
    if not scores:
        return F.lit(None).cast("int")

    def best(language: str):
        options = [F.struct((F.lit(c) + sum((F.lit(x) * F.col(f) for x, f in zip(w, FEATURES)), F.lit(0.0))).alias("s"), F.lit(-y).alias("y")) for (g, y), (c, w) in scores.items() if g == language]
        return -(F.greatest(*options) if len(options) > 1 else options[0]).getField("y")

    chain = None
    for g in sorted({x for x, _ in scores} - {""}):
        chain = F.when(F.col("lang") == g, best(g)) if chain is None else chain.when(F.col("lang") == g, best(g))
    return (best("") if chain is None else chain.otherwise(best(""))).cast("int")


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS) -> DataFrame:
    """`reading_features` with `level`, 1 to 4.

    Every label with a level counts; after a first fit, labels that it contradicts are left out of the second, since
    raters err. Ties fall to the lower level. Without any usable label `level` is null.
    """
    features = materialize(reading_features(documents, key, text, lang, min_words))
    rated = labels.filter(F.col("level").isNotNull()).select(F.col(key).alias("rated_key"), F.col("level").cast("int").alias("level"))
    labelled = materialize(features.join(rated, F.col(key) == F.col("rated_key")).drop("rated_key"))
    first = _discriminants(labelled)
    agreed = labelled.filter(F.col("level") == _level(first)) if first else labelled
    second = _discriminants(agreed)
    known = {y for _, y in second}
    scores = second if known == {y for _, y in first} else first
    return features.withColumn("level", _level(scores))
