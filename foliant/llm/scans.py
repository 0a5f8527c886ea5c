"""Problem 6: noise in text from scanned pages.

A lexicon of corpus word frequencies is indexed by symmetric deletes, twice. First rare words meet frequent ones under
the forms that both have with one part of up to two characters deleted at any place; which parts then stand for which in
words of all kinds, and not only at their ends, teaches the confusions of this corpus and their weights. Then every word
is entered under each form in which one or two parts that are ever confused are deleted, every doubtful token looked up
under each form in which one or two wrong parts are, and forms keep the place of the deletion. Candidates are weighed by
the edit distance whose costs are those weights, and must be much more frequent than the token; where frequencies leave
a doubt, or several candidates do, the bigrams around each occurrence decide. Lines split by hyphens are joined by the
same lexicon. A running header is a first line that recurs, up to confusions, on other pages of its document; a page
number is a first or last line, or an end of the header, that gives the number of the page.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.vocabulary import HELD, word_counts
from foliant.tables import materialize

#: What scanners produce, and the character it stands for; known before any corpus is seen.
CONFUSIONS = (
    ("c", "e"), ("b", "h"), ("!", "i"), ("ri", "n"), ("†", "t"), ("@", "a"), ("0", "o"), ("5", "s"), ("1", "l"), ("¢", "c"),
    ("ii", "u"), ("cl", "d"), ("rn", "m"), ("9", "g"), ("6", "b"), ("vv", "w"), ("8", "b"), ("l", "1"), ("o", "0"), ("i", "1"),
    ("m", "rn"), ("d", "cl"), ("ß", "ss"),
)
#: Cost of a confusion that is only known beforehand, of one that is learned by how often it strikes the words it can, and
#: the most a repair may cost.
CONFUSION_COST, LEAST_COST, MOST_COST = 0.4, 0.25, 0.8
#: A confusion is learned from so many different words, if it strikes at least this share of the frequent words that it
#: can, and not mostly at their ends, where words differ by grammar.
LEAST_WORDS, LEAST_STRUCK, LEAST_INNER = 5, 0.05, 0.5
#: A repair is this many times as frequent as the token; above the second number no context is asked.
LEAST_RATIO, SURE_RATIO = 8, 60
#: A lexicon word occurs at least so often, whatever the size of the corpus. Up to the second number of words are sent to
#: every worker, the most frequent ones; what depends on rarer words is joined. Filters of words have so many bits.
LEAST_COUNT, SENT_WORDS, FILTER_BITS = 4, 300_000, 1 << 24
TOKEN = re.compile(r"!?[\w†@¢]+(?:![\w†@¢]+)*")
#: A hyphen at a line's end, with what follows up to the next letter; its class comes first, so that it is found fast.
HYPHEN = re.compile(r"[-¬\xad‐][ \t]*\n[ \t]*(?=[^\W\d_])")
TAIL = re.compile(r"[\w†@¢!]*$")
SYMBOL = re.compile(r"[^\W\d_][†@¢!][^\W\d_]|[^\W\d_]{2}[0156 9][^\W\d_]{2}")
OPENING = re.compile(r"\s*(?:```[a-z]*[ \t]*\n|Here is the text of the page:\s*|<[a-z]{2,8}>\s*)")
CLOSING = re.compile(r"(?:\n```|</[a-z]{2,8}>|<\|[a-z]{2,8}\|>)$")
MARK = "\u0001"


def unwrapped(text: str) -> str:
    """The text without what a model put around it: fences, tags, an introduction."""
    at = 0
    while m := OPENING.match(text, at):
        at = m.end()
    text = text[at:].rstrip()
    while m := CLOSING.search(text, max(0, len(text) - 12)):
        text = text[: m.start()].rstrip()
    return text


def split_points(text: str) -> Iterator[tuple[re.Match, str, str]]:
    """Hyphens between two lines of letters, each with the token before and the token after it."""
    for m in HYPHEN.finditer(text):
        if text[m.start() - 1 : m.start()].isalpha():
            yield m, TAIL.search(text, max(0, m.start() - 60), m.start())[0], TOKEN.match(text, m.end())[0]


def _glue(m: re.Match) -> str:
    return "" if m.string[m.start() - 1 : m.start()].isalpha() else m[0]


def tokens(text: str) -> list[str]:
    """Lower-cased tokens, words split over lines joined; a last token that may be cut off is left out."""
    joined = HYPHEN.sub(_glue, text) if "\n" in text else text
    found = TOKEN.findall(joined.lower())
    return found[:-1] if found and joined[-1:].isalnum() else found


def corpus_counts(df: DataFrame, texts: list[str]) -> DataFrame:
    """(word, n) over all texts in the columns `texts`."""
    melted = df.select(F.explode(F.array(*texts)).alias("text"))
    return word_counts(melted, "text", None, tokens).select("word", "n")


# ---------------------------------------------------------------------------------------------- the index


class Confusions(NamedTuple):
    """(wrong, right, cost) of the confusions of a corpus, dearest last."""

    pairs: tuple[tuple[str, str, float], ...] = tuple((a, b, CONFUSION_COST) for a, b in CONFUSIONS)

    def pattern(self, right: bool) -> re.Pattern:
        return re.compile("|".join(sorted({re.escape(x[1] if right else x[0]) for x in self.pairs}, key=lambda x: (-len(x), x))))


def any_forms(word: str) -> list[tuple[str, str, bool]]:
    """(form, deleted part, whether it ends the word): the word with nothing, one or two characters replaced by a mark."""
    return [(word[:i] + MARK + word[i + n :], word[i : i + n], i + n == len(word)) for i in range(len(word) + 1) for n in (0, 1, 2) if i + n <= len(word)]


def learned_confusions(counts: DataFrame) -> Confusions:
    """The confusions of a corpus: those known beforehand, and those that its own words show, with their costs.

    Rare words are met with words SURE_RATIO times as frequent that differ in one part; a rare word with a single such
    neighbour is an example of its parts' confusion. All rare words are looked at that are letters but for one part; others
    have no such neighbour. Only pairs of parts that are confusions, or known ones, reach the driver.
    """
    rare = counts.filter((F.length("word").between(4, 40)) & (F.col("n") < LEAST_COUNT * SURE_RATIO) & F.col("word").rlike(r"^\p{L}*.{0,2}\p{L}*$"))
    frequent = counts.filter((F.col("n") >= LEAST_COUNT * SURE_RATIO) & F.col("word").rlike(r"^\p{L}{4,40}$"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, w, n, p, e) for w, n in zip(f["word"], f["n"]) for k, p, e in any_forms(w)], columns=["form", "word", "n", "part", "ends"])

    schema = "form string, word string, n long, part string, ends boolean"
    q, x = rare.select("word", "n").mapInPandas(run, schema).alias("q"), frequent.select("word", "n").mapInPandas(run, schema).alias("x")
    a, b = F.col("q.part"), F.col("x.part")
    # the smallest part only: neither the first nor the last character of both is the same
    smallest = (a != b) & ~((F.left(a, F.lit(1)) == F.left(b, F.lit(1))) & (a != "") & (b != "")) & ~((F.right(a, F.lit(1)) == F.right(b, F.lit(1))) & (a != "") & (b != ""))
    met = q.join(x.hint("merge"), F.col("q.form") == F.col("x.form")).filter(smallest & (F.col("x.n") >= SURE_RATIO * F.col("q.n")))
    one = met.groupBy("q.word").agg(F.countDistinct("x.word").alias("c"), F.min(F.struct(F.col("x.word").alias("word"), a.alias("a"), b.alias("b"), F.col("q.ends").alias("ends"))).alias("m")).filter("c = 1")
    struck = one.groupBy("m.a", "m.b").agg(F.countDistinct("m.word").alias("words"), F.avg(1 - F.col("m.ends").cast("int")).alias("inner")).filter((F.col("words") >= LEAST_WORDS) & (F.col("inner") >= LEAST_INNER) & (F.col("a") != "") & (F.col("b") != ""))
    found = materialize(struck)
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.array(F.substring("word", i, F.lit(1)), F.substring("word", i, F.lit(2))))))
    able = frequent.select(F.explode(parts).alias("b")).groupBy("b").agg(F.count("*").alias("able"))
    cost = {(a, b): CONFUSION_COST for a, b in CONFUSIONS}
    share, known = F.col("words") / F.col("able"), F.struct("a", "b").isin([F.struct(F.lit(a), F.lit(b)) for a, b in CONFUSIONS])
    for r in found.join(able.hint("merge"), "b").filter((share >= LEAST_STRUCK) | known).select("a", "b", share.alias("share")).collect():  # bounded by the alphabet
        cost[r.a, r.b] = max(LEAST_COST, CONFUSION_COST - (CONFUSION_COST - LEAST_COST) * min(1.0, 4 * r.share))
    return Confusions(tuple((a, b, c) for (a, b), c in sorted(cost.items(), key=lambda x: (x[1], x[0]))))


def deleted_forms(word: str, lexicon: bool, confusions: Confusions | None = None) -> list[tuple[str, str, str]]:
    """(form, first deleted, second deleted): the word with one or two confusable parts replaced by a mark."""
    parts = {x[1] if lexicon else x[0] for x in (confusions or Confusions()).pairs}
    spots = [(i, word[i : i + n]) for n in (1, 2) for i in range(len(word) - n + 1) if word[i : i + n] in parts]
    out = [(word[:i] + MARK + word[i + len(s) :], s, "") for i, s in spots if len(word) > 1]
    if len(word) >= 5:
        out += [(word[:i] + MARK + word[i + len(s) : j] + MARK + word[j + len(u) :], s, u) for (i, s), (j, u) in combinations(sorted(spots), 2) if j >= i + len(s)]
    return out


def _forms(df: DataFrame, lexicon: bool, confusions: Confusions) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, w, n, a, b) for w, n in zip(f["word"], f["n"]) for k, a, b in deleted_forms(w, lexicon, confusions)], columns=["form", "word", "n", "a", "b"])

    return df.select("word", "n").mapInPandas(run, "form string, word string, n long, a string, b string")


def repairs(counts: DataFrame, confusions: Confusions | None = None) -> DataFrame:
    """(word, n, candidates, sure) for every token that has a repair; candidates are structs (cost, repair, n), best first.

    The cost is the sum of those of the confusions between token and candidate; candidates cost at most MOST_COST and are
    at least LEAST_RATIO times as frequent. `sure` where the best is SURE_RATIO times as frequent and no other candidate
    is near it. Forms with equal places are joined by a shuffle; a form holds at most one word per character of the
    alphabet and deletion, so no group grows with the corpus. Tokens of more than 40 characters are no words.
    """
    known = confusions or Confusions()
    right = counts.filter((F.col("n") >= LEAST_COUNT) & F.col("word").rlike(r"^(?:\p{L}+|[0-9]+)$") & (F.length("word") <= 40))
    wrong = counts.filter(F.length("word").between(2, 40) & ~F.col("word").rlike(r"^x{0,3}(?:ix|iv|v?i{0,3})$"))  # Roman numerals stand
    q, x = _forms(wrong, False, known).alias("q"), _forms(right, True, known).alias("x")
    costs = F.create_map(*(F.lit(v) for a, b, c in known.pairs for v in (f"{a}>{b}", c)))
    of = lambda a, b: F.try_element_at(costs, F.concat_ws(">", a, b))
    cost = of("q.a", "x.a") + F.when(F.col("q.b") == "", F.lit(0.0)).otherwise(of("q.b", "x.b"))  # null for parts that are never confused
    same_kind = (F.col("q.form") == F.col("x.form")) & ((F.col("q.b") == "") == (F.col("x.b") == ""))
    met = q.join(x.hint("merge"), same_kind).select("q.word", "q.n", F.col("x.word").alias("repair"), F.col("x.n").alias("repair_n"), cost.alias("cost"))
    met = met.filter((F.col("cost") <= MOST_COST + 1e-9) & (F.col("repair_n") >= LEAST_RATIO * F.col("n")))
    best = met.groupBy("word", "n", "repair", "repair_n").agg(F.min("cost").alias("cost"))
    # words and numbers are not mixed up: a token of letters has no number for repair and vice versa
    best = best.filter(~(F.col("word").rlike(r"^\p{L}+$") & F.col("repair").rlike(r"^[0-9]")) & ~F.col("word").rlike(r"^[0-9]+$"))
    grouped = best.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct((F.col("cost") - F.log10("repair_n") / 10).alias("cost"), "repair", F.col("repair_n").alias("n")))).alias("candidates"))
    first, second = F.col("candidates")[0], F.try_element_at("candidates", F.lit(2))
    sure = (first["n"] >= SURE_RATIO * F.col("n")) & (second.isNull() | (second["n"] * 20 < first["n"]))
    return grouped.withColumn("sure", sure)


# ---------------------------------------------------------------------------------------------- lines of a page


class Lines(NamedTuple):
    """First and last lines of one page."""

    header: str | None
    number_first: bool
    number_last: bool
    number_in_header: bool
    misread_number: bool


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= value:
            out, n = out + sign, n - value
    return out


NUMBER = r"([0-9lIOo|]{1,4}|[ivxlcIVXLC]{1,8})"
ALONE = re.compile(rf"^(?:[-–—•~*] ?{NUMBER} ?[-–—•~*]|\[{NUMBER}\]|{NUMBER}|(?:p|s|pág|S)\. ?{NUMBER}|(?i:page|seite|página) {NUMBER}(?: (?:of|von|de|sur|/) ?[0-9lIOo]{{1,4}})?)$")
HEAD_NUMBER = re.compile(rf"^(?:{NUMBER}(?: *[|·–—-])? +(?=\S*[^\W\d_]{{2}})|.*?(?: *[|·–—-])? {NUMBER}$)")
COUNTED = re.compile(r"(?:\b(?:Vol|No|Nr|Bd|Issue|Heft|Band|Tome|Tomo|Num)|n°)\.? *$", re.I)
TO_DIGITS = str.maketrans("lI|Oo", "11100")


def is_page(number: str, page: int | None) -> tuple[bool, bool]:
    """Whether the printed `number` is that of the page, and whether characters of it are misread."""
    digits = number.translate(TO_DIGITS)
    if page is None or page != page:
        return number.isdigit(), False
    if digits.isdigit() and int(digits) == page and any(c.isdigit() or c in "lIO|" for c in number):
        return True, digits != number
    return number.lower() == roman(int(page)), False


def fold(line: str) -> str:
    """A line as a key that is the same whichever of its characters are misread."""
    out = line.lower()
    for s, t in CONFUSIONS[:17]:
        if len(s) == 2 or not s.isalpha():
            out = out.replace(s, t)
    out = out.replace("ß", "ss").replace("e", "c").replace("h", "b")
    return re.sub(r"[\W_]+", " ", out).strip()


def header_key(line: str, page: int | None) -> tuple[str, bool, bool]:
    """The folded line without numbers at its ends, whether one of them is the page's, and whether that is misread.
    The number of a volume or an issue is no page number."""
    m = HEAD_NUMBER.match(line)
    yes = wrong = False
    if m and (number := m[1] or m[2]) and not (m[2] and COUNTED.search(line, 0, m.start(2))):
        yes, wrong = is_page(number, page)
        if yes:
            line = line[m.end(1) :] if m[1] else line[: m.start(2)]
    return fold(re.sub(r"^\W*[0-9]{1,4} +| +[0-9]{1,4}\W*$", "", line)), yes, yes and wrong


def page_lines(text: str, page: int | None) -> Lines:
    """The header candidate of a page (its first line without a page number) and where its page number is printed."""
    lines = [x.strip() for x in unwrapped(text).split("\n") if x.strip()]
    if not lines:
        return Lines(None, False, False, False, False)
    first = last = in_head = misread = False
    at = 0
    for i in (0, -1):
        m = ALONE.match(lines[i])
        if m and (i == 0 or len(lines) > 1):
            yes, wrong = is_page(next(g for g in m.groups() if g), page)
            misread |= wrong and yes
            if i == 0:
                first, at = yes, int(yes)
            else:
                last = yes
    head = lines[at] if at < len(lines) else ""
    if not 6 <= len(head) <= 100 or not re.search(r"[^\W\d_]{3}", head):
        return Lines(None, first, last, False, misread)
    key, in_head, wrong = header_key(head, page)
    return Lines(key or None, first, last, in_head, misread | wrong)


def split_words(text: str, known: set[str] | frozenset[str]) -> bool:
    """Whether a single word is split over two lines. A hyphen of a compound (two-/to, mid-/or) is none: both of its
    parts are words of the lexicon and their joined form is not."""
    for m, left, right in split_points(text):
        if m[0][0] not in "-‐":
            return True
        a, b = left.lower(), right.lower()
        if a + b in known or not (a in known and b in known):
            return True
    return False


def hyphened_pairs(text: str, known: set[str] | frozenset[str]) -> tuple[bool, set[tuple[str, str]]]:
    """`split_words` where `known` lacks the rarer words: whether a word is split for certain, and the parts of those
    that may be compounds."""
    sure, pairs = False, set()
    for m, left, right in split_points(text):
        a, b = left.lower(), right.lower()
        if m[0][0] not in "-‐" or a + b in known:
            sure = True
        else:
            pairs.add((a, b))
    return sure, pairs


# ---------------------------------------------------------------------------------------------- defects


class WordFilter:
    """A set of words in fixed memory that may hold a few more than were added."""

    def __init__(self, bits: bytes | bytearray):
        self.bits = bits

    @staticmethod
    def bits_of(words: DataFrame) -> bytes:
        """The bits of a table (w) of words; at most FILTER_BITS / 32 numbers reach the driver."""
        at = F.pmod(F.crc32(F.encode("w", "utf-8")), F.lit(FILTER_BITS))
        rows = words.select(at.alias("at")).groupBy(F.floor(F.col("at") / 32).cast("int").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 as int)))").alias("b"))
        bits = array("I", bytes(FILTER_BITS // 8))
        for r in rows.toLocalIterator():
            bits[r.i] = r.b
        if sys.byteorder != "little":
            bits.byteswap()
        return bits.tobytes()

    def __contains__(self, word: str) -> bool:
        at = zlib.crc32(word.encode()) % FILTER_BITS
        return bool(self.bits[at >> 3] >> (at & 7) & 1)

    def isdisjoint(self, words: list[str]) -> bool:
        return not any(w in self for w in words)


class Index(NamedTuple):
    """`known` are the trusted words, or if there are too many of them the most frequent ones; then all are in `trusted`."""

    counts: DataFrame
    repairs: DataFrame
    known: frozenset[str]
    trusted: DataFrame | None = None
    confusions: Confusions = Confusions()


def build_index(df: DataFrame, fields: list[str], sent: int = SENT_WORDS) -> Index:
    """Counts, repairs and the trusted words of a corpus, of which at most `sent` reach the driver."""
    counts = materialize(corpus_counts(df, fields))
    confusions = learned_confusions(counts)
    fixed = materialize(repairs(counts, confusions))
    trusted = materialize(counts.filter((F.col("n") >= LEAST_COUNT) & F.col("word").rlike(r"^\p{L}+$")).join(fixed.hint("merge"), "word", "left_anti"))
    level, total, floor = F.floor(F.log2("n")).cast("int"), 0, None
    for r in sorted(trusted.groupBy(level.alias("level")).count().collect(), reverse=True):  # one row per power of two
        total += r["count"]
        if total > sent:
            floor = r["level"] + 1
            break
    some = trusted if floor is None else trusted.filter(level >= floor)
    return Index(counts, fixed, frozenset(r.word for r in some.select("word").toLocalIterator()), None if floor is None else trusted, confusions)


def occurrences(df: DataFrame, key: str, fields: list[str], page: str, group: str, index: Index, sent: int = SENT_WORDS) -> DataFrame:
    """(key, grp, page, field, kind, value, before, after, n): what one pass over the pages finds.

    Kinds: split, pair (only where `index.trusted` is asked; before, after: parts of what may be a compound, value: both,
    n: 0 if they meet only without the spaces at line ends), number, in_head (the page number in the header line), misread (certain by itself), header (value: the
    folded line), token (value: a token outside the trusted words, with its neighbours; once per page, token and
    neighbours) and, without key, bigram (before, after: a pair that holds a doubtful token or a candidate for one; n:
    how often, combined in the worker).
    """
    kind = df.schema[key].dataType.simpleString()
    doubtful = index.repairs.filter("not sure").select(F.explode(F.concat(F.array("word"), F.col("candidates.repair"))).alias("w")).distinct()
    doubtful = materialize(doubtful)
    few = doubtful.limit(sent + 1).count() <= sent
    shared = df.sparkSession.sparkContext.broadcast((index.known, frozenset(r.w for r in doubtful.collect()) if few else WordFilter.bits_of(doubtful)))  # only built-in types: executors have no package
    odd = index.confusions.pattern(False)
    whole = index.trusted is None
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(group).cast("string").alias("g"), F.col(page).cast("int").alias("p"), *fields)
    columns = [key, "grp", "page", "field", "kind", "value", "before", "after", "n"]
    types = {key: "Int64" if kind in ("bigint", "int", "smallint", "tinyint") else "object", "page": "Int64"}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, wanted = shared.value
        wanted = wanted if isinstance(wanted, frozenset) else WordFilter(wanted)
        pairs: Counter = Counter()

        def counted() -> pd.DataFrame:
            found = pd.DataFrame([(None, None, None, None, "bigram", None, a, b, n) for (a, b), n in pairs.items()], columns=columns)
            pairs.clear()
            return found.astype(types)

        for f in frames:
            out = []
            for field in fields:
                for k, g, p, t in zip(f["k"], f["g"], f["p"], f[field]):
                    if not t:
                        continue
                    p = None if p != p or p is None else int(p)
                    if "\n" in t and whole:
                        if split_words(t, words):
                            out.append((k, g, p, field, "split", "", "", "", 1))
                    elif "\n" in t:
                        sure, parts = hyphened_pairs(t, words)
                        if sure:
                            out.append((k, g, p, field, "split", "", "", "", 1))
                        out += [(k, g, p, field, "pair", a + b, a, b, 1) for a, b in parts]
                        tidy = "\n".join(x.rstrip() for x in t.split("\n"))
                        if tidy != t:
                            out += [(k, g, p, field, "pair", a + b, a, b, 0) for a, b in hyphened_pairs(tidy, words)[1] - parts]
                    lines = page_lines(t, p)
                    if lines.number_first or lines.number_last:
                        out.append((k, g, p, field, "number", "", "", "", 1))
                    if lines.number_in_header:
                        out.append((k, g, p, field, "in_head", "", "", "", 1))
                    if lines.header:
                        out.append((k, g, p, field, "header", lines.header, "", "", 1))
                    if lines.misread_number:
                        out.append((k, g, p, field, "misread", "", "", "", 1))
                    ts = tokens(t)
                    if not wanted.isdisjoint(ts):
                        pairs.update((a, b) for a, b in zip(ts, ts[1:]) if a in wanted or b in wanted)
                    seen = set()
                    for i in [i for i, w in enumerate(ts) if w not in words]:
                        w = ts[i]
                        if len(w) < 2 or w.isdigit():
                            continue
                        if SYMBOL.search(w):
                            seen.add((w, None, None))
                        elif odd.search(w):
                            seen.add((w, ts[i - 1] if i else "", ts[i + 1] if i + 1 < len(ts) else ""))
                    out += [(k, g, p, field, "misread" if b is None else "token", w, b or "", a or "", 1) for w, b, a in seen]
            yield pd.DataFrame(out, columns=columns).astype(types)
            if len(pairs) > HELD:
                yield counted()
        yield counted()

    return rows.mapInPandas(run, f"{key} {kind}, grp string, page int, field string, kind string, value string, before string, after string, n long")


def judged_pairs(found: DataFrame, key: str, trusted: DataFrame) -> DataFrame:
    """(key, field, before, after, n, compound): the pairs that occurrences left open, by shuffles over all trusted words."""
    out = found.filter("kind = 'pair'").select(key, "field", "before", "after", "value", "n")
    for c in ("before", "after", "value"):
        out = out.join(trusted.select(F.col("word").alias(f"__{c}"), F.lit(True).alias(f"__{c}_known")).hint("merge"), F.col(c) == F.col(f"__{c}"), "left")
    compound = F.col("__before_known").isNotNull() & F.col("__after_known").isNotNull() & F.col("__value_known").isNull()
    return out.select(key, "field", "before", "after", "n", compound.alias("compound"))


def misread_tokens(found: DataFrame, key: str, index: Index) -> DataFrame:
    """(key, field, value, before, after, repair): token occurrences that are misread, with the repair.

    A sure repair holds everywhere. Otherwise each reading is weighed by the bigrams that it forms with its neighbours,
    and the token stands unless a candidate is met there at least five times as often.
    """
    hits = found.filter("kind = 'token'").join(index.repairs.hint("merge"), F.col("value") == F.col("word"))  # grows with the vocabulary: never broadcast
    sure = hits.filter("sure").select(key, "field", "value", "before", "after", F.col("candidates")[0]["repair"].alias("repair"))
    bigrams = found.filter("kind = 'bigram'").groupBy("before", "after").agg(F.sum("n").alias("n"))
    open_hits = hits.filter("not sure").select(key, "field", "value", "before", "after", F.explode(F.concat(F.array(F.col("value")), F.col("candidates.repair"))).alias("reading"))
    left = bigrams.select(F.col("before").alias("lb"), F.col("after").alias("la"), F.col("n").alias("ln"))
    right = bigrams.select(F.col("before").alias("rb"), F.col("after").alias("ra"), F.col("n").alias("rn"))
    weighed = (
        open_hits.join(left.hint("merge"), (F.col("before") == F.col("lb")) & (F.col("reading") == F.col("la")), "left")
        .join(right.hint("merge"), (F.col("reading") == F.col("rb")) & (F.col("after") == F.col("ra")), "left")
        .withColumn("support", F.coalesce("ln", F.lit(0)) + F.coalesce("rn", F.lit(0)))
    )
    place = [key, "field", "value", "before", "after"]
    chosen = weighed.groupBy(*place).agg(
        F.max(F.when(F.col("reading") == F.col("value"), F.col("support"))).alias("own"),
        F.max(F.when(F.col("reading") != F.col("value"), F.struct("support", "reading"))).alias("best"),
    ).filter((F.col("best.support") >= 2) & (F.col("best.support") >= 5 * F.col("own")))
    return sure.unionByName(chosen.select(*place, F.col("best.reading").alias("repair")))


def running_headers(found: DataFrame, key: str) -> DataFrame:
    """(key, field) of the pages whose first line recurs on another page of the document, or carries the page's number:
    only running headers do, even where the pages they recur on are missing or misread beyond recognition.

    Distinct (document, line, page) triples are counted, so a document of any size is combined before the shuffle.
    """
    heads = found.filter("kind = 'header' and grp is not null and page is not null")
    shared = heads.select("grp", "value", "page").distinct().groupBy("grp", "value").count().filter("count >= 2").select("grp", "value")
    recurring = heads.join(shared.hint("merge"), ["grp", "value"], "left_semi").select(key, "field")
    return recurring.unionByName(found.filter("kind = 'in_head'").select(key, "field")).distinct()


def defects(df: DataFrame, key: str = "result_id", fields: tuple[str, ...] = ("text", "raw_text"), page: str = "page_no", group: str = "doc_id", sent: int = SENT_WORDS) -> DataFrame:
    """(key, field, defect): hyphenation, misread, header and pagenum, at most one row each per key and field.

    Null, empty and blank fields have no defect. A null page number makes a bare number line a page number; rows
    without document have no running header.
    """
    names = list(fields)
    index = build_index(df, names, sent)
    found = materialize(occurrences(df, key, names, page, group, index, sent))
    label = lambda d, name: d.select(key, "field", F.lit(name).alias("defect"))
    heads = running_headers(found, key)
    wrong = misread_tokens(found, key, index).select(key, "field").unionByName(found.filter("kind = 'misread'").select(key, "field"))
    numbered = found.filter("kind in ('number', 'in_head')").select(key, "field")
    split = found.filter("kind = 'split'").select(key, "field")
    if index.trusted is not None:
        split = split.unionByName(judged_pairs(found, key, index.trusted).filter("n = 1 and not compound").select(key, "field"))
    parts = [label(split, "hyphenation"), label(wrong, "misread"), label(heads, "header"), label(numbered, "pagenum")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# ---------------------------------------------------------------------------------------------- repair

FIRST_UPPER = re.compile(r"^(?:[-•*–]|\(?\w{1,3}[.)]\s|\||#|\d+(?:\.\d+)*\.?\s+\w|(?:Fig|Tab|Abb|Figure|Table)\b)")


def continuous(text: str, page: int | None, header: str | None, repairs_of: dict[str, str], known: set[str] | frozenset[str], judged: dict[str, bool] | None = None) -> str:
    """The page's own text in paragraphs: wrappers, the running header and page numbers dropped, split words joined,
    misread tokens repaired (case kept), lines of a paragraph joined; list items, table rows and headings keep lines. `judged` says
    which pairs (before, a hyphen, after) are compounds, where `known` does not."""
    lines = [x.rstrip() for x in unwrapped(text).split("\n")]
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()

    def number(x: str) -> bool:
        m = ALONE.match(x.strip())
        return bool(m) and is_page(next(g for g in m.groups() if g), page)[0]

    if len(lines) > 1 and number(lines[-1]):
        lines.pop()
    if len(lines) > 1 and number(lines[0]):
        lines.pop(0)
    if header and len(lines) > 1 and header_key(lines[0].strip(), page)[0] == header:
        lines.pop(0)

    raw, body, at = "\n".join(lines), "", 0
    for m, left, right in split_points(raw):
        a, b = left.lower(), right.lower()
        compound = m[0][0] in "-‐" and a + b not in known and (judged or {}).get(f"{a}-{b}", a in known and b in known)
        body += raw[at : m.start()] + (m[0][0] if compound else "")
        at = m.end()
    body += raw[at:]

    def repair(m: re.Match) -> str:
        fixed = repairs_of.get(m[0].lower())
        if fixed is None:
            return m[0]
        return fixed.upper() if len(m[0]) > 1 and m[0].isupper() else fixed.capitalize() if m[0][:1].isupper() else fixed

    if repairs_of:
        body = TOKEN.sub(repair, body)
    out: list[str] = []
    for block in re.split(r"\n[ \t]*\n\s*", body):
        joined = ""
        for line in (x.strip() for x in block.split("\n")):
            if line:
                joined += ("\n" if FIRST_UPPER.match(line) else " ") + line if joined else line
        if joined:
            out.append(joined)
    return "\n\n".join(out)


def repaired(df: DataFrame, key: str = "result_id", fields: tuple[str, ...] = ("text", "raw_text"), page: str = "page_no", group: str = "doc_id", sent: int = SENT_WORDS) -> DataFrame:
    """(key, field, text): every field that is not null as continuous paragraphs of the page's own text.

    Repairs are those of `misread_tokens`; where one token has several on a page, the one found most often there.
    """
    names = list(fields)
    index = build_index(df, names, sent)
    found = materialize(occurrences(df, key, names, page, group, index, sent))
    best = misread_tokens(found, key, index)
    symbol = found.filter("kind = 'misread' and value != ''").join(index.repairs, F.col("value") == F.col("word")).select(key, "field", "value", F.col("candidates")[0]["repair"].alias("repair"))
    fixes = best.select(key, "field", "value", "repair").unionByName(symbol).groupBy(key, "field", "value", "repair").count()
    fixes = fixes.groupBy(key, "field", "value").agg(F.max_by("repair", F.struct("count", "repair")).alias("repair")).groupBy(key, "field").agg(F.map_from_entries(F.collect_list(F.struct("value", "repair"))).alias("fixes"))
    heads = found.filter("kind = 'header'").join(running_headers(found, key), [key, "field"], "left_semi").select(key, "field", F.col("value").alias("head"))
    rows = df.filter(F.col(key).isNotNull()).select(key, F.col(page).cast("int").alias("page"), F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names))).alias("x")).select(key, "page", "x.*").filter("text is not null")
    ready = rows.join(fixes, [key, "field"], "left").join(heads, [key, "field"], "left")
    if index.trusted is None:
        ready = ready.withColumn("judged", F.lit(None).cast("map<string,boolean>"))
    else:
        pairs = judged_pairs(found, key, index.trusted).groupBy(key, "field", F.concat_ws("-", "before", "after").alias("pair")).agg(F.max("compound").alias("compound"))
        ready = ready.join(pairs.groupBy(key, "field").agg(F.map_from_entries(F.collect_list(F.struct("pair", "compound"))).alias("judged")), [key, "field"], "left")
    known = df.sparkSession.sparkContext.broadcast(index.known)
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [
                continuous(t, None if p != p or p is None else int(p), h if isinstance(h, str) else None, dict(m) if m is not None else {}, known.value, dict(j) if j is not None else None)
                for t, p, h, m, j in zip(f["text"], f["page"], f["head"], f["fixes"], f["judged"])
            ]
            yield f[[key, "field"]].assign(text=texts)

    return ready.select(key, "field", "page", "head", "text", "fixes", "judged").mapInPandas(run, f"{key} {kind}, field string, text string")
