"""Scores of a transcription against a reference, and the page furniture both are freed from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.normal import PAGE_NUMBER, STAMP, normalized, normalized_lines, word_distance

ZONE = 3
#: Fixed value: what ends a line.
LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"


def _bag_f1(pairs: DataFrame, key: Sequence[str], ref: Column, hyp: Column, out: str, digits: int) -> DataFrame:
    """F1 of two token bags per key; both bags are folded to counts before they meet."""
    tagged = pairs.select(*key, F.explode(F.concat(F.transform(ref, lambda t: F.struct(t.alias("t"), F.lit(1).alias("r"), F.lit(0).alias("h"))), F.transform(hyp, lambda t: F.struct(t.alias("t"), F.lit(0).alias("r"), F.lit(1).alias("h"))))).alias("x"))
    counts = tagged.groupBy(*key, "x.t").agg(F.sum("x.r").alias("r"), F.sum("x.h").alias("h"))
    sums = counts.groupBy(*key).agg(F.sum(F.least("r", "h")).alias("both"), F.sum("r").alias("rs"), F.sum("h").alias("hs"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("both"), F.col("rs") + F.col("hs")), F.lit(0.0))
    scored = sums.select(*key, F.round(f1, digits).alias(out))
    return pairs.select(*key).join(scored, list(key), "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def tokens(text: Column) -> Column:
    """Runs of what is no white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def trigrams(text: Column) -> Column:
    """Trigrams inside blank-padded words: independent of word order, sensitive to spelling."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


def word_f1(pairs: DataFrame, key: Sequence[str], ref: str, hyp: str, digits: int = 4) -> DataFrame:
    """(key, word_f1) of reference and hypothesis texts; 0 where they share no word, empty texts included."""
    return _bag_f1(pairs, key, tokens(F.col(ref)), tokens(F.col(hyp)), "word_f1", digits)


def char3_f1(pairs: DataFrame, key: Sequence[str], ref: str, hyp: str, digits: int = 4) -> DataFrame:
    return _bag_f1(pairs, key, trigrams(F.col(ref)), trigrams(F.col(hyp)), "char3_f1", digits)


def cer(ref: Column, hyp: Column, digits: int = 4) -> Column:
    """Character error rate, at most 1; null for an empty reference."""
    return F.when(F.length(ref) > 0, F.round(F.least(F.lit(1.0), F.levenshtein(ref, hyp) / F.length(ref)), digits))


def score(pairs: DataFrame, key: Sequence[str], ref: str, hyp: str) -> DataFrame:
    """(key, cer, wer, word_f1, char3_f1, ref_chars, hyp_chars) of normalised texts; rates are null for an empty
    reference. Null texts count as empty."""
    ready = pairs.select(*key, normalized(F.coalesce(F.col(ref), F.lit(""))).alias("__r"), normalized(F.coalesce(F.col(hyp), F.lit(""))).alias("__h"))
    rates = ready.withColumns({"cer": cer(F.col("__r"), F.col("__h")), "wer": F.when(F.col("__r") != "", F.round(F.least(F.lit(1.0), word_distance("__r", "__h") / F.size(tokens(F.col("__r")))), 4))})
    f1, c3 = word_f1(ready, key, "__r", "__h"), char3_f1(ready, key, "__r", "__h")
    known = F.col("__r") != ""
    return rates.join(f1, list(key)).join(c3, list(key)).select(
        *key, "cer", "wer", F.when(known, F.col("word_f1")).alias("word_f1"), F.when(known, F.col("char3_f1")).alias("char3_f1"),
        F.length("__r").cast("bigint").alias("ref_chars"), F.length("__h").cast("bigint").alias("hyp_chars"),
    )


def zone_lines(pages: DataFrame, doc: str, page: str, text: str, zone: int = ZONE, line: Column | None = None) -> DataFrame:
    """(doc, page, place, line): the first and last `zone` lines of each page that are not blank."""
    lines = F.filter(F.split(F.col(text), LINE_END), lambda x: F.regexp_replace(x, r"(?U)\s", "") != "")
    cut = pages.filter(F.col(text).isNotNull()).select(doc, page, lines.alias("ls"))
    ends = F.when(F.size("ls") <= 2 * zone, F.col("ls")).otherwise(F.concat(F.slice("ls", 1, zone), F.slice("ls", F.size("ls") - zone + 1, zone)))
    return cut.select(doc, page, F.posexplode(ends).alias("place", "line"))


def running_lines(pages: DataFrame, doc: str, page: str, text: str, zone: int = ZONE) -> DataFrame:
    """(doc, line, pages): normalised lines near the top or bottom of at least half of a document's pages, and of at
    least two; at least four letters or digits, no bare page number. Distinct (line, page) pairs are combined before the
    shuffle by document and line."""
    zoned = zone_lines(pages, doc, page, text, zone).withColumn("line", normalized(F.col("line"))).filter("line != ''")
    total = pages.filter(F.col(text).isNotNull()).groupBy(doc).agg(F.countDistinct(page).alias("__all"))
    counts = zoned.select(doc, page, "line").distinct().groupBy(doc, "line").agg(F.count("*").alias("pages"))
    solid = F.length(F.regexp_replace("line", r"[^\p{L}\p{N}]", "")) >= 4
    number = F.col("line").rlike(PAGE_NUMBER)
    return counts.join(total, doc).filter((F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("__all") / 2))) & solid & ~number).select(doc, "line", "pages")


def _ends(places: Column, zone: int = ZONE) -> Column:
    """The first and last `zone` of an array of places, each once."""
    return F.when(F.size(places) <= 2 * zone, places).otherwise(F.concat(F.slice(places, 1, zone), F.slice(places, F.size(places) - zone + 1, zone)))


def _where(forms: Column, test: Callable[[Column], Column]) -> Column:
    """The places (from 0) of an array's elements that pass `test`."""
    return F.filter(F.transform(forms, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull())


def _without(lines: Column, gone: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(gone, i), x)), lambda x: x.isNotNull()), "\n")


def without_furniture(pairs: DataFrame, running: DataFrame, doc: str, ref: str, hyp: str) -> DataFrame:
    """`pairs` with furniture dropped from both texts: margin stamps, running lines in the zones, bare page numbers; a
    line leaves the hypothesis only if the same left this page's reference.

    Lines are told by their normal forms. The reference loses stamps, running lines in its zones, and then a bare number
    as the first or last line that is left. The hypothesis loses stamps, and in its zones as many lines of a form as the
    reference lost, the first ones. Null texts count as empty; extra columns stay.
    """
    lines = running.groupBy(doc).agg(F.collect_set("line").alias("__running"))  # bounded: six lines a page, on half the pages
    split = lambda c: F.split(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), rf"(?:{LINE_END})\z", ""), LINE_END)
    cut = pairs.join(lines, doc, "left").withColumns({"__r": split(ref), "__h": split(hyp), "__running": F.coalesce("__running", F.array().cast("array<string>"))})
    cut = cut.withColumns({"__rf": normalized_lines("__r"), "__hf": normalized_lines("__h")})
    form = lambda f, i: F.get(F.col(f), i)
    solid = lambda f: _where(F.col(f), lambda x: x != "")
    stamped = lambda f: _where(F.col(f), lambda x: x.rlike(STAMP))
    # the reference: stamps and running lines, then numbers at the ends of what is left
    cut = cut.withColumn("__gone", F.array_union(stamped("__rf"), F.filter(_ends(solid("__rf")), lambda i: F.array_contains("__running", form("__rf", i)))))
    cut = cut.withColumn("__left", F.array_except(solid("__rf"), "__gone"))
    edges = F.filter(F.array(F.get("__left", F.lit(0)), F.try_element_at("__left", F.when(F.size("__left") > 0, -1).otherwise(1))), lambda i: i.isNotNull() & form("__rf", i).rlike(PAGE_NUMBER))
    cut = cut.withColumn("__gone", F.array_union("__gone", edges))
    cut = cut.withColumn("__lost", F.filter(F.transform("__gone", lambda i: form("__rf", i)), lambda x: ~x.rlike(STAMP)))
    # the hypothesis: the n-th zone line of a form goes if the reference lost at least n of that form
    cut = cut.withColumn("__zone", _ends(F.array_except(solid("__hf"), stamped("__hf"))))
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    nth = lambda i, k: count(F.transform(F.slice("__zone", F.lit(1), k + 1), lambda j: form("__hf", j)), form("__hf", i))
    taken = F.filter(F.transform("__zone", lambda i, k: F.when(nth(i, k) <= count(F.col("__lost"), form("__hf", i)), i)), lambda i: i.isNotNull())
    freed = cut.withColumns({ref: _without(F.col("__r"), F.col("__gone")), hyp: _without(F.col("__h"), F.array_union(stamped("__hf"), taken))})
    return freed.drop("__r", "__h", "__rf", "__hf", "__running", "__gone", "__left", "__lost", "__zone")


def metric_estimates(scores: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, n, mean): known values of each metric column, melted."""
    melted = scores.unpivot(list(keys), list(metrics), "metric", "value")
    return melted.filter("value is not null").groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def category_matrix(scores: DataFrame, candidate: str, category: str, value: str, categories: Sequence[str]) -> DataFrame:
    """One row per candidate, one column per category of `categories`, holding the mean of `value`."""
    return scores.groupBy(candidate).pivot(category, list(categories)).agg(F.avg(value))


def category_spread(scores: DataFrame, candidate: str, category: str, value: str) -> DataFrame:
    """(candidate, worst, worst_mean, best, best_mean): extremes of the category means, ties by name."""
    means = scores.filter(F.col(value).isNotNull()).groupBy(candidate, category).agg(F.avg(value).alias("m"))
    low, high = F.min(F.struct(F.col("m"), F.col(category).alias("c"))), F.max(F.struct(F.col("m"), F.col(category).alias("c")))
    return means.groupBy(candidate).agg(low.alias("l"), high.alias("h")).select(candidate, F.col("l.c").alias("worst"), F.col("l.m").alias("worst_mean"), F.col("h.c").alias("best"), F.col("h.m").alias("best_mean"))
