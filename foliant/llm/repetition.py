"""Problem 2: repetition inside a single document.

Cheap statistics of every text (distinct words, distinct word sequences, repeated lines and sentences), all of them
expressions, feed a learned decision list: sequential covering grows conjunctions of thresholds on labelled statistics,
prunes them on rows held back, and emits them as one ordered Spark conditional expression. The labels are exact:
`repeated_share` measures a bounded sample. The list selects the rows that may repeat themselves, its last rule being
wide enough for all that the others leave over; the exact share of those rows decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text repeats itself when this share of its words does. The list is taught a lower bar, the exact check decides.
SHARE, TAUGHT_SHARE = 0.4, 0.3
#: Rows measured to teach the list: about so many are drawn, whatever the size of the table.
SAMPLE = 20_000
GRAM, LONG_RUN, SENTENCE_RUN, LOOP_RUN = 4, 14, 6, 4
STATISTICS = ("n_words", "distinct_words", "distinct_grams", "distinct_lines", "distinct_sentences")
EDGE = ".,;:!?()[]{}|\"'`*_#<>–—-“”«»"
END = re.compile(r"[.!?:|]$")


def _near(a: str, b: str) -> bool:
    """Equal but for one character changed, lost or doubled."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def repeated_share(text: str | None) -> float:
    """Share of a text's words that stand in a stretch which already occurred earlier in it.

    Words are compared without case and edge punctuation; a slip of one character and a running number do not end a
    stretch, as long as they are at most a quarter of it. Numbers among numbers are compared as they are: a table's
    figures do not repeat each other, a number that goes on and on does. A stretch counts if it repeats what directly
    precedes it (a loop of any period), if it is a whole sentence or row of at least SENTENCE_RUN words, or if it has at
    least LONG_RUN words; shorter likeness of wording does not. Null and empty texts have share 0.
    """
    marks = [w for w in text.lower().split() if w.strip("|-:")] if text else []
    words = [w.strip(EDGE) or w for w in marks]
    n = len(words)
    if n < 2 * LOOP_RUN:
        return 0.0
    number = [w.isdigit() for w in words]
    keys = ["#" if d else w for w, d in zip(words, number)]
    grams = list(zip(*(keys[k:] for k in range(GRAM))))
    if "#" in keys:  # sequences of numbers alone are themselves
        alone = ("#",) * GRAM
        grams = [tuple(words[k : k + GRAM]) if g == alone else g for k, g in enumerate(grams)]
    if len(set(grams)) == len(grams):
        return 0.0
    seen: dict[tuple, int] = {}
    first: dict[tuple, int] = {}
    covered, i = 0, 0
    while i < len(grams):
        g = grams[i]
        best = i
        for j in {seen[g], first[g]} if g in seen else ():
            k, slips, d, letter = i, 0, i - j, -1
            while k < n:
                a, b = words[k], words[k - d]
                if a != b:
                    # a counter stands beside words
                    if not (number[k] and number[k - d] and (k - letter < GRAM or not all(number[k + 1 : k + GRAM]))) and not _near(a, b):
                        break
                    slips += 1
                    if 4 * slips > k - i + 4:
                        break
                if not number[k]:
                    letter = k
                k += 1
            while k > i and words[k - 1] != words[k - 1 - d] and not number[k - 1]:
                k -= 1
            run = k - i
            whole = (i == 0 or END.search(marks[i - 1])) and (k == n or END.search(marks[k - 1]))
            if run > best - i and 4 * slips <= run and (run >= LONG_RUN or (d <= run and run >= LOOP_RUN) or (whole and run >= SENTENCE_RUN)):
                best = k
        for p in range(i, max(best, i + 1)):
            if p < len(grams):
                first.setdefault(grams[p], p)
                seen[grams[p]] = p
        covered += best - i
        i = max(best, i + 1)
    return covered / n


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def statistics(text: Column, names: Sequence[str] = STATISTICS) -> Column:
    """Those of STATISTICS that `names` has, of a text, as one struct: its number of words, and the shares of different ones
    among its words, sequences of three words, lines and sentences; in the latter three digits are masked. 1 where there
    is nothing to count."""
    share = lambda a: once(a, lambda x: F.when(F.size(x) > 0, F.size(F.array_distinct(x)) / F.size(x)).otherwise(F.lit(1.0)))
    parts = lambda x, d: F.filter(F.split(x, d), lambda y: y != "")
    t = F.lower(F.coalesce(text, F.lit("")))
    of_words = {"n_words": lambda w: F.size(w).cast("double"), "distinct_words": share}
    of_masked = {
        # what a word is followed by is a sequence; the first word of all belongs to none
        "distinct_grams": lambda m: share(F.regexp_extract_all(m, F.lit(r"\S+(?=(\s+\S+\s+\S+\s+\S+))"), F.lit(1))),
        "distinct_lines": lambda m: share(parts(m, "\n")),
        "distinct_sentences": lambda m: share(parts(m, r"[.!?:]\s+|\n")),
    }
    chosen = lambda of: lambda x: F.struct(F.lit(0).alias("_"), *(f(x).alias(k) for k, f in of.items() if k in names))
    some = lambda of, value: once(value if set(names) & set(of) else F.lit(None), chosen({k: f for k, f in of.items() if k in names}))
    pair = F.struct(some(of_words, F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0))).alias("w"), some(of_masked, F.regexp_replace(t, r"[0-9]+", "#")).alias("m"))
    return once(pair, lambda x: F.struct(F.lit(0).alias("_"), *(x["w" if k in of_words else "m"][k].alias(k) for k in STATISTICS if k in names)))


# ---------------------------------------------------------------------------------------------- decision list


class Condition(NamedTuple):
    statistic: str
    at_most: bool
    threshold: float


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in rule:
        out &= x[c.statistic] <= c.threshold if c.at_most else x[c.statistic] > c.threshold
    return out


def learn_list(x: dict[str, np.ndarray], y: np.ndarray, cuts: int = 40, most_rules: int = 12, least_precision: float = 0.5, widened_precision: float = 0.75) -> list[Rule]:
    """Rules that select positive rows, by sequential covering.

    Two rows of three grow, the third prunes. A rule grows by the condition with the largest information gain until
    it covers no negative row; conditions are then dropped from its end while that does not lower (p - n) / (p + n) on
    the pruning rows. Thresholds are then widened while the rule's precision stays at `widened_precision`: an exact check
    follows, so a missed row costs more than a false one. Rules stop when one is no better than `least_precision` or no positive row is left. Thresholds are
    tried at `cuts` quantiles of the rows a rule still covers. Positives that no rule covers in the end get a last one:
    the single threshold that lets all of them in with the fewest others. Without any positive row the only rule is the
    empty one, which always holds: what was not seen cannot be told from the rest.
    """
    n = len(y)
    grow = np.arange(n) % 3 != 0
    rules: list[Rule] = []
    open_rows = np.ones(n, dtype=bool)
    while len(rules) < most_rules and (y & open_rows & grow).any():
        rule: Rule = ()
        inside = open_rows & grow
        while (inside & ~y).any() and len(rule) < 6:
            p0, n0 = (inside & y).sum(), (inside & ~y).sum()
            base, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
            for s, values in x.items():
                for t in np.unique(np.quantile(values[inside & y], np.linspace(0, 1, cuts))):
                    for at_most in (True, False):
                        hit = inside & (values <= t if at_most else values > t)
                        p, q = (hit & y).sum(), (hit & ~y).sum()
                        if p and (gain := p * (np.log2(p / (p + q)) - base)) > best[0]:
                            best = (gain, Condition(s, at_most, float(t)), hit)
            if best[1] is None:
                break
            rule, inside = (*rule, best[1]), best[2]
        if not rule:
            break

        def worth(r: Rule) -> float:
            hit = _holds(r, x, n) & open_rows & ~grow
            p, q = (hit & y).sum(), (hit & ~y).sum()
            return (p - q) / (p + q) if p + q else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        for i, c in enumerate(rule):
            beyond = np.unique(x[c.statistic][open_rows & (x[c.statistic] > c.threshold if c.at_most else x[c.statistic] <= c.threshold)])
            lo, hi = 0, len(beyond)
            while lo < hi:  # the farthest threshold at which the precision holds
                mid = (lo + hi) // 2
                t = beyond[mid] if c.at_most else beyond[len(beyond) - 1 - mid] - 1e-9
                wider = (*rule[:i], c._replace(threshold=float(t)), *rule[i + 1 :])
                hit = _holds(wider, x, n) & open_rows
                if (hit & y).sum() >= widened_precision * hit.sum():
                    rule, lo = wider, mid + 1
                else:
                    hi = mid
        hit = _holds(rule, x, n) & open_rows
        if not hit.any() or (hit & y).sum() / hit.sum() < least_precision:
            break
        rules.append(rule)
        open_rows &= ~hit
    rest = y & open_rows
    if not y.any():
        return [()]
    if rest.any():
        last = [Condition(s, True, float(v[rest].max())) for s, v in x.items()] + [Condition(s, False, float(v[rest].min()) - 1e-9) for s, v in x.items()]
        rules.append((min(last, key=lambda c: _holds((c,), x, n).sum()),))
    return rules


def list_expression(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (1-based), 0 where none does, as one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        test = F.lit(True)
        for c in rule:
            test = test & (F.col(c.statistic) <= c.threshold if c.at_most else F.col(c.statistic) > c.threshold)
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def with_statistics(df: DataFrame, key: str, text: str, names: Sequence[str] = STATISTICS) -> DataFrame:
    """(key, text, and those of STATISTICS that `names` has)."""
    rows = df.select(F.col(key), F.col(text).alias("text"), F.explode(F.array(statistics(F.col(text), names))).alias("__s"))
    return rows.select(key, "text", *(F.col(f"__s.{c}").alias(c) for c in STATISTICS if c in names))


def measured(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, share): `repeated_share` of every row."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "share": [repeated_share(t) for t in f["text"]]})

    return df.select(F.col(key), F.col(text).alias("text")).mapInPandas(run, f"{key} {kind}, share double")


def teach(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> list[Rule]:
    """A decision list from about `sample` rows, drawn by a hash of the key, with exactly measured labels.

    Rows are drawn where they lie, by a threshold on the hash that the table's count gives; only their statistics are
    brought together.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key), F.col(text).alias("text"))
    share = min(1.0, sample / max(1, rows.count()))
    drawn = rows.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0))
    stats = with_statistics(drawn, key, "text")

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[*STATISTICS]].assign(key=f[key].astype(str), share=[repeated_share(t) for t in f["text"]])

    rows = stats.mapInPandas(label, ", ".join(f"{s} double" for s in STATISTICS) + ", key string, share double").toPandas().sort_values("key")
    return learn_list({s: rows[s].to_numpy() for s in STATISTICS}, (rows["share"] >= TAUGHT_SHARE).to_numpy())


def repetitive(df: DataFrame, key: str, text: str, sample: int = SAMPLE) -> DataFrame:
    """(key, rule, share) of the rows that a rule of the learned list selects and that repeat at least SHARE of their
    words: the number of the first rule that holds, and the exact share. Null keys give no rows."""
    learned = teach(df, key, text, sample)
    rules, named = list_expression(learned), [c.statistic for rule in learned for c in rule]
    kind = df.schema[key].dataType.simpleString()

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[[key, "rule"]].assign(share=[repeated_share(t) for t in f["text"]])

    # exploding a rule or nothing keeps the planner from computing the rules once more to filter by them
    rows = with_statistics(df.filter(F.col(key).isNotNull()), key, text, named).select(key, "text", F.explode(F.when(rules > 0, F.array(rules))).alias("rule"))
    return rows.mapInPandas(check, f"{key} {kind}, rule int, share double").filter(F.col("share") >= SHARE)
