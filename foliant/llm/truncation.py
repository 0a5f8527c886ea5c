"""Problem 3: text cut off by field limits.

Lengths of every source are fitted by right-censored maximum likelihood: a log-normal distribution of which the values
piled up at a limit are only known to reach it. Limits are found where a narrow window of lengths holds many more rows
than the fit explains; the excess is the window's censoring posterior. Expectation maximisation over the counts of
endings inside and outside those windows then fits how cut and whole texts end, and how many rows of every window and
of every source are cut; the censoring posteriors are its prior, cuts at random places of whole texts its examples. A
row is truncated where the posterior of its place and its ending together exceeds one half. Only the fits of histograms
and of small count tables run in Python, everything else is an expression.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.joins import small_left_join
from foliant.tables import materialize

#: Widths of the windows in which values pile up, and how many more rows than expected make one a limit.
WIDTHS = (1, 8, 32)
LEAST_ROWS, LEAST_RATIO = 8, 5.0
FIT_PARTITIONS = 32
ENDINGS = ("mark", "broken", "open", "standalone", "closed")
#: How whole and cut texts are believed to end before any is counted: shares that count as PRIOR_ROWS rows each. Whole
#: texts end with a mark, broken or open no more often than WHOLE says, whatever is counted.
WHOLE = (0.0001, 0.0001, 0.0001, 0.0997, 0.9)
CUT = (0.05, 0.15, 0.74, 0.04, 0.02)
PRIOR_ROWS = 50
#: Rows that all texts cut at random places count as together.
DRAWN_ROWS = 200
#: Rows that a window's censoring posterior, or the rate of all sources, counts as beside a place's own rows.
BELIEF = 20
#: Share of cut rows away from any limit that the fit starts from, and its rounds.
BASE_RATE, ROUNDS = 0.05, 200
#: About so many whole texts of at least LEAST_LENGTH characters, drawn by a hash, are cut at random places.
SAMPLE, LEAST_LENGTH = 2_000, 100
#: Lines before the last one that are looked at to tell a list.
LIST_LINES = 40


# ---------------------------------------------------------------------------------------------- endings


def _roman(n: Column) -> Column:
    """`n` from 1 to 399 as a Roman numeral in small letters, else null."""
    digits = [("", "c", "cc", "ccc"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")]
    places = [F.get(F.array(*(F.lit(x) for x in d)), (F.floor(n / 10**k) % 10).cast("int")) for k, d in zip((2, 1, 0), digits)]
    return F.when(n.between(1, 399), F.concat(*places))


#: The characters that Unicode counts as white space.
BLANKS = " \t\n\u000b\f\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def ending(text: Column, page: Column | None = None) -> Column:
    """Kind of a text's end: mark, broken, open, standalone, closed; null for null, empty and blank texts.

    mark: an ellipsis, a note like [truncated] or a broken character; broken: an unclosed bracket, tag, entity, command,
    number or table row; closed: final punctuation, a whole table row, a page number; standalone: a heading, caption,
    list item or formula that needs no punctuation; open: words without any of these.

    A last line is a page number if it gives `page` in digits, misread digits or Roman numerals, or if it is a well-formed
    number after a finished line, a blank one, or between two dashes or brackets. Letters alone that give the page after
    an unfinished line may be the start of a word as well: standalone.
    """
    # all that is looked at are whole lines at the end, so no pattern runs over the text before them
    t = F.substring_index(F.rtrim(text, F.lit(BLANKS)), "\n", -LIST_LINES)
    last = F.trim(F.substring_index(t, "\n", -1))
    two = F.substring_index(t, "\n", -2)
    apart = ~t.contains("\n") | F.trim(F.substring_index(two, "\n", 1)).isin("")
    lines_in_block = F.substring_index(F.regexp_replace(t, r"\n[ \t]*\n", "\u0001"), "\u0001", -1)
    end = F.right(last, F.lit(80))
    before = F.trim(F.substring_index(two, "\n", 1))
    proper = apart | before.rlike(r"[.!?:;。！？][\"'”’»)\]]*$|\|$")
    number = F.regexp_extract(last, r"^[-–—(\[* ]*([0-9lIoO|]{1,4}|[ivxlIVXL]{1,7})[-–—)\]* .]*$", 1)
    is_number = (number != "") & ~last.rlike(r"^[(\[][^)\]]*$") & ~two.rlike(r"^\[\d+\] [^\n]*\n\[\d+\]$")
    place = (F.lit(None) if page is None else page).cast("int")
    digits, roman = F.translate(number, "lI|Oo", "11100").try_cast("int").eqNullSafe(place) & place.isNotNull(), F.lower(number).eqNullSafe(_roman(place)) & place.isNotNull()
    formed = number.rlike(r"[0-9]|^[ivx]$|^(?=..)(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})$|^(?=..)(?:XL|L?X{0,3})(?:IX|IV|V?I{0,3})$")
    framed = last.rlike(r"^(?:\(.*\)|\[.*\]|[-–—*].*[-–—*])$")
    numbered = digits & number.rlike("[0-9]") | roman & (F.length(number) > 1) | framed & formed | proper & (digits | roman | formed)
    named = r"(?i)(?:page|seite|página|pág\.?|p\.|s\.) *[0-9lioé]{1,5}(?: *(?:of|von|de|sur|/) *[0-9lio]{1,5})?"
    enumerated = r"(?:\(?[0-9]{1,3}[.)]|\([a-zA-Z]{1,4}\)|[a-z]\)|[-•*–+]) +\S.*"
    caption = r"(?:Fig|Tab|Abb|Figure|Table|Tabelle|Abbildung|Tableau|Tabla|Figura)\.? *[0-9]+[.]? +[^\s:].*|[0-9]{1,3}(?:\.[0-9]{1,3})*\.? +\p{Lu}.*|#{1,6} +.*"
    formula = r".{0,30}[=≤≥≠≈∑∫√].{0,30}"
    listed = lines_in_block.rlike(r"^(?:(?:\(?[0-9]{1,3}[.)]|\([a-zA-Z]{1,4}\)|[-•*–+]) +[^\n]*\n?)+$")
    sentences = last.rlike(r"\p{L}{3}[.!?] +\p{L}")  # a line of several needs a stop after the last
    return (
        F.when(text.isNull() | t.isin("") | ~F.coalesce(t.rlike(r"(?U)\S"), F.lit(False)), F.lit(None).cast("string"))
        .when(end.rlike(r"(?:\.\.\.|…|�)$|(?i)[\[(](?:truncated|more|cut|continued|\.\.\.|…)[\])]$"), "mark")
        .when(last.rlike(r"^" + named + r"$") & (last.rlike("[0-9]") | proper) | is_number & numbered, "closed")
        .when(is_number & (digits | roman), "standalone")
        .when(last.rlike(r"^\|.*\|$"), "closed")
        .when(last.rlike(r"^\||\|[^|]{0,12}$"), "broken")
        .when(end.rlike(r"<[/a-zA-Z][^<>]{0,20}$|&#?[a-zA-Z0-9]{0,6}$|\\[a-zA-Z]*\{?$|[(\[{]$|\([^()\s][^()]{0,40}$|(?:^|\s)0[.,]$|[\p{L}\d][-¬]$"), "broken")
        .when(end.rlike(r"(?:[.!?。！？]|[:;])[\"'”’»)\]]*$|[.!?)][\"'”’»\]]*\[\d+\]$") | last.rlike("^[-*_= ]{3,}$"), "closed")
        .when(last.rlike(r"\(\d+\)$") & last.rlike(formula), "closed")
        .when(apart & last.rlike(r"^" + formula + r"$"), "standalone")
        .when(apart & last.rlike(r"^(?:" + caption + r")$") & ~sentences, "standalone")
        .when(listed & last.rlike(r"^" + enumerated + r"$") & ~sentences, "standalone")
        .when(two.rlike(r"^\[\d+\] [^\n]*\n\[\d+\]$"), "standalone")
        .when(last.rlike(r"\([^()]*\)$"), "standalone")
        .otherwise("open")
    )


# ---------------------------------------------------------------------------------------------- censored lengths


def _cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _cdfs(z: np.ndarray) -> np.ndarray:
    """The normal distribution function of many values, by Chebyshev fit (relative error below 1.2e-7)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = np.zeros_like(t)
    for c in (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    tail = 0.5 * t * np.exp(poly - x * x)
    return np.where(z > 0, 1 - tail, tail)


def fit_censored(x: np.ndarray, n: np.ndarray, censored: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Mean and deviation of a normal distribution by maximum likelihood, where `n` rows have value `x` and those
    `censored` are only known to be at least it. Expectation maximisation with the moments of the cut-off normal."""
    used = n > 0
    x, n, censored = x[used], n[used], censored[used]
    total = n.sum()
    mu = float((n * x).sum() / total)
    sd = max(1e-3, float(np.sqrt((n * (x - mu) ** 2).sum() / total)))
    if not censored.any():
        return mu, sd
    first, second, at = x.copy(), x**2, x[censored]
    for _ in range(rounds):
        z = (at - mu) / sd
        tail = np.maximum(1e-12, 0.5 * np.array([math.erfc(v / math.sqrt(2)) for v in z]))
        hazard = np.exp(-0.5 * z**2) / math.sqrt(2 * math.pi) / tail
        first[censored] = mu + sd * hazard
        second[censored] = mu**2 + sd**2 + sd * (at + mu) * hazard
        mu = float((n * first).sum() / total)
        sd = max(1e-3, math.sqrt(max(0.0, float((n * second).sum() / total) - mu**2)))
    return mu, sd


def find_limits(value: np.ndarray, count: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(low, high, posterior, mean, deviation) of the windows [low, high] in which lengths pile up.

    Starting from an uncensored fit, the window with the largest excess over the fit becomes a limit, its excess is
    treated as censored, the fit is repeated, and so on until no window of any width stands out.
    """
    order = np.argsort(value)
    value, count = value[order].astype("int64"), count[order].astype(float)
    x = np.log(np.maximum(1, value))
    natural, extra = count.copy(), np.zeros_like(count)
    found: list[tuple[int, int]] = []
    upto = np.append(0.0, np.cumsum(count))
    taken = np.zeros(len(value), dtype=bool)
    mu, sd = fit_censored(x, count, np.zeros(len(x), dtype=bool))
    while True:  # every window takes at least one length, so this ends
        cdf = _cdfs((np.log(np.maximum(0.5, value + 0.5)) - mu) / sd)
        best = (0.0, 0, 0, 0.0)
        for w in WIDTHS:
            j = np.searchsorted(value, value - w, side="right")  # window (v - w, v]
            seen = upto[1:] - upto[j]
            low = _cdfs((np.log(np.maximum(0.5, value - w + 0.5)) - mu) / sd)
            expected = np.maximum(natural.sum() * np.maximum(cdf - low, 0), 0.5)
            # the fit's own roughness: lengths around the window say how dense rows are there as well
            side = 10 * w
            around = (upto[np.searchsorted(value, value - w, side="right")] - upto[np.searchsorted(value, value - w - side, side="right")]) / side * w
            expected = np.maximum(expected, around)
            ok = (seen >= LEAST_ROWS) & (seen >= LEAST_RATIO * expected) & ~taken
            if ok.any():
                score = np.where(ok, (seen - expected) / np.sqrt(expected + 1), 0)
                k = int(score.argmax())
                if score[k] > best[0]:
                    best = (float(score[k]), int(j[k]), k, float(1 - expected[k] / seen[k]))
        if not best[0]:
            break
        _, j, k, p = best
        found.append((j, k))
        taken[j : k + 1] = True
        extra[j : k + 1] = count[j : k + 1] * p
        natural[j : k + 1] = count[j : k + 1] * (1 - p)
        mu, sd = fit_censored(np.concatenate([x, x]), np.concatenate([natural, extra]), np.repeat([False, True], len(x)))
    out = []
    for j, k in found:
        expected = natural.sum() * max(0.0, _cdf((math.log(value[k] + 0.5) - mu) / sd) - _cdf((math.log(max(0.5, value[j] - 0.5)) - mu) / sd))
        seen = upto[k + 1] - upto[j]
        out.append((int(value[j]), int(value[k]), float(np.clip(1 - expected / seen, 0.0, 0.999)), mu, sd))
    return out


def fit_endings(counts: np.ndarray, prior: np.ndarray, limited: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How texts cut at a limit end, how those cut elsewhere do, how whole ones do, and the cut share of every place, by
    expectation maximisation.

    `counts` has a row per place with its numbers of ENDINGS, `prior` the place's censoring posterior, `limited` says
    which places are limits, `drawn` has the endings of texts that were cut at random places.
    """
    believed, most = np.asarray(CUT) * PRIOR_ROWS, np.asarray(WHOLE)
    known = believed + drawn * (DRAWN_ROWS / max(1.0, drawn.sum()))
    at, off, whole, rate = known / known.sum(), np.asarray(CUT), most, prior.copy()
    for _ in range(ROUNDS):
        a = rate[:, None] * np.where(limited[:, None], at, off)
        share = counts * a / (a + (1 - rate[:, None]) * whole)
        at, off = share[limited].sum(0) + known, share[~limited].sum(0) + believed
        whole = (counts - share).sum(0) + most * PRIOR_ROWS
        at, off, whole = at / at.sum(), off / off.sum(), whole / whole.sum()
        whole[:3] = np.minimum(whole[:3], most[:3])
        whole[3:] *= (1 - whole[:3].sum()) / whole[3:].sum()
        rate = (share.sum(1) + BELIEF * prior) / (counts.sum(1) + BELIEF)
    return at, off, whole, rate


def cut_rates(counts: np.ndarray, prior: np.ndarray, cut: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The cut share of every place where the shares of endings are known, those of cut texts by place; rows of `counts`
    are independent."""
    rate = prior.copy()
    for _ in range(ROUNDS):
        a = rate[:, None] * cut
        rate = ((counts * a / (a + (1 - rate[:, None]) * whole)).sum(1) + BELIEF * prior) / (counts.sum(1) + BELIEF)
    return rate


def length_limits(lengths: DataFrame) -> DataFrame:
    """(source, measure, low, high, posterior, mean, deviation) from `lengths` (source, measure, value).

    Only histograms are grouped: one row per source, measure and distinct length, however many rows a source has.
    """
    histogram = lengths.filter(F.col("value") > 0).groupBy("source", "measure", "value").agg(F.count("*").alias("n"))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        found = find_limits(f["value"].to_numpy(), f["n"].to_numpy())
        return pd.DataFrame([(key[0], key[1], *x) for x in found], columns=["source", "measure", "low", "high", "posterior", "mean", "deviation"])

    # a number of partitions is named, else all these small groups end in one task
    return histogram.repartition(FIT_PARTITIONS, "source", "measure").groupBy("source", "measure").applyInPandas(run, "source string, measure string, low long, high long, posterior double, mean double, deviation double")


def _drawn(df: DataFrame, text: str, page: str | None, closed: int) -> np.ndarray:
    """Endings of about SAMPLE whole texts, cut at random places of their second half."""
    half = F.floor(F.length(text) / 2)
    drawn = df.filter((F.length(text) >= LEAST_LENGTH) & (F.pmod(F.xxhash64(text), F.lit(max(1, closed // SAMPLE))) == 0))
    shortened = drawn.select(F.col(text).alias("whole"), F.substring(F.col(text), F.lit(1), (half + F.pmod(F.xxhash64(text, F.lit(1)), half)).cast("int")).alias("text"), (F.col(page) if page else F.lit(None)).alias("page"))
    both = shortened.select(F.explode(F.array(F.struct(ending(F.col("whole"), F.col("page")).alias("whole"), ending(F.col("text"), F.col("page")).alias("ending")))).alias("x"))
    found = both.filter("x.whole = 'closed'").groupBy("x.ending").count().collect()
    n = {r["ending"]: r["count"] for r in found}
    return np.array([n.get(e, 0) for e in ENDINGS], dtype=float)


def truncation(df: DataFrame, key: str, text: str, source: str, measures: Mapping[str, Column], page: str | None = None) -> DataFrame:
    """(key, source, ending, censored, cut_rate, posterior, truncated, by_ending) of every row with a text that is not blank.

    `measures` name the lengths that may be limited, as integer expressions over `df`; null ones are ignored. A row lies
    at the limit with the largest censoring posterior of those whose window holds one of its lengths (`censored`), or at
    none; `cut_rate` is the fitted share of cut rows there, `posterior` that of rows with this ending there. `by_ending`
    is what the ending says where no length is looked at. Null sources form one.
    """
    names = list(measures)
    # exploding an ending or nothing keeps the planner from computing it once more to filter by it, before rows are dealt out
    found = F.explode(F.array_compact(F.array(ending(F.col(text), F.col(page) if page else None))))
    rows = materialize(df.select(key, F.coalesce(F.col(source).cast("string"), F.lit("?")).alias("source"), found.alias("ending"), *(c.cast("long").alias(f"__{m}") for m, c in measures.items())))
    melted = rows.select("source", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"__{m}").alias("value")) for m in names))).alias("m")).select("source", "m.*")
    limits = materialize(length_limits(melted).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("posterior", "measure", "low", "high"))).alias("__limits")))
    placed = small_left_join(rows, limits, ["source"], F.col(key))

    def holds(limit: Column) -> Column:
        hit = F.lit(False)
        for m in names:
            hit = hit | ((limit["measure"] == m) & F.coalesce(F.col(f"__{m}").between(limit["low"], limit["high"]), F.lit(False)))
        return hit

    # limits are sorted by their posterior, so the last one that holds a length is the row's place
    hits = F.transform("__limits", lambda x, i: F.when(holds(x), F.struct(x["posterior"].alias("p"), i.alias("i"))))
    placed = placed.withColumn("__at", F.array_max(F.filter(hits, lambda x: x.isNotNull()))).select(
        key, "source", "ending", F.coalesce("__at.i", F.lit(-1)).alias("place"), F.col("__at.p").alias("censored")
    )
    sums = [F.sum((F.col("ending") == e).cast("long")).alias(e) for e in ENDINGS]
    cells = materialize(placed.groupBy("source", "place").agg(F.max("censored").alias("censored"), *sums))
    # for the fit, places of like posterior and like share of closed ends are taken together: a few hundred at most
    share = F.col("closed") / (F.col("mark") + F.col("broken") + F.col("open") + F.col("standalone") + F.col("closed"))
    binned = cells.groupBy(F.floor(F.col("censored") * 20).alias("p"), F.floor(share * 20).alias("c")).agg(F.avg("censored").alias("censored"), *(F.sum(e).alias(e) for e in ENDINGS))
    bins = binned.toPandas().sort_values(["p", "c"])
    counts = bins[[*ENDINGS]].to_numpy(dtype=float)
    limited = bins["censored"].notna().to_numpy()
    at, off, whole, rate = fit_endings(counts, bins["censored"].astype(float).fillna(BASE_RATE).to_numpy(), limited, _drawn(df, text, page, int(bins["closed"].sum())))
    base = float((rate * counts.sum(1))[~limited].sum() / counts[~limited].sum()) if counts[~limited].sum() else BASE_RATE

    def rated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = f["censored"].astype(float)
            cut = np.where(p.notna().to_numpy()[:, None], at, off)
            yield f[["source", "place"]].assign(cut_rate=cut_rates(f[[*ENDINGS]].to_numpy(dtype=float), p.fillna(base).to_numpy(), cut, whole))

    rates = materialize(cells.mapInPandas(rated, "source string, place int, cut_rate double"))
    # how much more often cut texts end so than whole ones
    ratio = lambda cut: F.element_at(F.create_map(*(F.lit(x) for e, c, w in zip(ENDINGS, cut, whole) for x in (e, float(c / w)))), F.col("ending"))
    joint = lambda p, r: p * r / (p * r + 1 - p)
    return (
        small_left_join(placed, rates, ["source", "place"], F.col(key))
        .withColumn("posterior", joint(F.col("cut_rate"), F.when(F.col("place") < 0, ratio(off)).otherwise(ratio(at))))
        .select(key, "source", "ending", "censored", "cut_rate", "posterior", (F.col("posterior") > 0.5).alias("truncated"), (joint(F.lit(base), ratio(off)) > 0.5).alias("by_ending"))
    )


def truncation_rates(found: DataFrame) -> DataFrame:
    """(source, rows, truncated, rate) over rows with text."""
    return found.groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.col("truncated").cast("long")).alias("truncated"), F.avg(F.col("truncated").cast("double")).alias("rate"))
