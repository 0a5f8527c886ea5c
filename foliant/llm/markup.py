"""Problem 1: markup residue.

`host_paths` is the consensus operator: the containers of every page are scored, generalised tag-class paths are voted
on per host, and pages are extracted again by the winning paths. `clean` turns HTML, Markdown, wiki and LaTeX markup
into plain text that keeps headings, lists, code blocks, tables and formulas. `has_markup` is the test whether a text
holds any piece of markup: voted paths select containers and cannot tell whether a single inline mark is there.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.joins import small_left_join
from foliant.tables import materialize

TAG = r"</?[A-Za-z][A-Za-z0-9]{0,19}(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[\w#.-]+))*\s*/?>"
#: Pieces of markup, each starting with one of the characters of STARTS; the same syntax in Java's and Python's regex.
PIECES = (
    TAG,  # element
    r"<!--|-->",  # comment
    r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});",  # entity
    r"^#{1,6} +\S",  # Markdown from here on: heading
    r"\*\*(?=[^\s*])[^*\n]+?\*\*",
    r"(?<!\w)__(?=[^\s_])[^\n]+?__(?!\w)",
    r"~~(?=\S)[^~\n]+?~~",
    r"`[^`\n]+`|```",
    r"\[[^\[\]\n]*\]\((?=[^()\s])\S*?\)",
    r"\[\^[^\]\s]{1,20}\]",
    r"^[|:-][ \t:|-]*-{2,}[ \t:|-]*\|[ \t:|-]*$",  # table rule
    r"^\|(?:[^|\n]*\|){2,}[ \t]*$",
    r"(?<=\n)> +\S|^> +[^\W\d]",
    r"(?<=\n)[-*+] +\S|^[-*+] +(?:[^\W\d]|\[[ xX]\])",
    r"(?<=\n)(?:={3,}|-{3,})[ \t]*$",
    r"\[\[[^\[\]\n]+\]\]",  # wiki from here on
    r"(?<!')'{2,3}(?=[^'\s])[^'\n]*(?:'[^'\n]+)*'{2,3}",
    r"^={2,6} [^\n]+ ={2,6}[ \t]*$",
    r"^\{\||^\|[-}]|^\|[^\n]*\|\|",
    r"\{\{[^{}]+\}\}",
    r"\[https?://[^\]\s]+[^\]\n]*\]",
    r"^(?:\*\*+|##+) +\S|(?<=\n)[*#]*[:;]+ +\S",
    r"\\[a-zA-Z]{2,}\*?[\[{]",  # LaTeX from here on
    r"(?<![\w:\\])\\[a-zA-Z]{2,}(?![a-zA-Z])",
    r"\\[%&_#$,;!]|\\\\",
    r"(?<![\w$])\$(?=[^\s$])[^$\n]+\$(?!\w)|\$\$",
    r"\\[\[\]()]",
    r"``[^`'\n]+''",
    r"\{\\[a-z]+\b",
    r"^%+ ?[a-z]",
)
STARTS = r"[<&#*_~`\[|:>+=\-'{;\\$%]"
ANY = "(?m)(?=" + STARTS + ")(?:" + "|".join(PIECES) + ")"


def has_markup(text: Column) -> Column:
    """True where a text holds at least one piece of markup; false for null and empty texts."""
    return F.coalesce(text.rlike(ANY), F.lit(False))


# ---------------------------------------------------------------------------------------------- clean text

#: Characters that LaTeX commands stand for.
SYMBOLS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "lambda": "λ", "mu": "μ", "pi": "π", "sigma": "σ",
    "tau": "τ", "phi": "φ", "omega": "ω", "ge": "≥", "geq": "≥", "le": "≤", "leq": "≤", "neq": "≠", "times": "×", "cdot": "·",
    "int": "∫", "sum": "∑", "prod": "∏", "infty": "∞", "propto": "∝", "mid": "|", "to": "→", "rightarrow": "→", "pm": "±",
    "approx": "≈", "partial": "∂", "nabla": "∇", "in": "∈", "top": "⊤", "ldots": "…", "dots": "…",
}
HEAD, END = "\ue000", "\ue001"  # around the number of a kept block
CODE = re.compile(
    r"```[^\n`]*\n(?P<a>.*?)(?:\n```|\Z)|<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(?P<b>.*?)(?:</code>\s*)?</pre>|<syntaxhighlight\b[^>]*>(?P<c>.*?)</syntaxhighlight>"
    r"|\\begin\{(?P<e>verbatim|lstlisting)\}(?P<d>.*?)\\end\{(?P=e)\}",
    re.S,
)
FORMULA = re.compile(
    r"\$\$(?P<a>.+?)\$\$|\\\[(?P<b>.+?)\\\]|\\\((?P<c>.+?)\\\)|<math\b[^>]*>(?P<d>.*?)</math>|\\begin\{(?P<f>equation|align|displaymath)\*?\}(?P<e>.+?)\\end\{(?P=f)\*?\}"
    r"|(?<![\w$])\$(?=[^\s$])(?P<g>[^$\n]+)\$(?!\w)",
    re.S,
)
TABULAR = re.compile(r"\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", re.S)
WIKI_TABLE = re.compile(r"^\{\|[^\n]*\n(.*?)^\|\}[ \t]*$", re.S | re.M)
#: Where a link leads, with balanced parentheses in it up to ten levels deep.
TARGET = r"[^()\s]*+"
for _ in range(10):
    TARGET = r"[^()\s]*+(?:\(" + TARGET + r"\)[^()\s]*+)*+"

STEPS: tuple[tuple[re.Pattern, str], ...] = tuple(
    (re.compile(p, f), r)
    for p, f, r in (
        (r"<!--.*?(?:-->|\Z)", re.S, ""),
        (r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>|<(script|style)\b[^>]*>.*?</\1>", re.S | re.I, ""),
        (r"(?m)^%+ ?[a-z][^\n]*\n?", 0, ""),
        (r"<h[1-6]\b[^>]*>\s*(.*?)\s*</h[1-6]>", re.S | re.I, r"\n\n\1\n\n"),
        (r"\s*<li\b[^>]*>\s*", re.I, "\n• "),
        (r"</t[dh]>\s*<t[dh]\b[^>]*>", re.I, "\t"),
        (r"\s*</tr>\s*", re.I, "\n"),
        (r"<br\s*/?>", re.I, "\n"),
        (r"<sup\b[^>]*>(.*?)</sup>", re.I, r"^\1"),
        (r"<sub\b[^>]*>(.*?)</sub>", re.I, r"_\1"),
        (r"</?(?:p|div|ul|ol|table|section|article|blockquote|tbody|thead)\b[^>]*>", re.I, "\n\n"),
        (r"(?m)^#{1,6} +([^\n]*?)[ #]*$", 0, r"\n\1\n"),
        (r"(?m)^={2,6} *([^\n]+?) *={2,6}[ \t]*$", 0, r"\n\1\n"),
        (r"(?m)(?<=\n)(?:={3,}|-{3,})[ \t]*$", 0, ""),
        (r"\\(?:(?:sub)*section|chapter|paragraph|title)\*?\{([^{}]*)\}", 0, r"\n\n\1\n\n"),
        (r"\\begin\{[a-z]+\*?\}(?:\[[^\]]*\])?|\\end\{[a-z]+\*?\}", 0, "\n"),
        (r"(?m)^[ \t]*\\item\b\s*(?:\[[^\]]*\])?", 0, "• "),
        (r"~?\\(?:cite[tp]?|label|ref|eqref|pageref|footnote)\*?(?:\[[^\]]*\])?\{[^{}]*\}", 0, ""),
        (r"\\href\{[^{}]*\}\{([^{}]*)\}", 0, r"\1"),
        (r"\{\\[a-z]+\s+([^{}]*)\}", 0, r"\1"),
        (r"\\[a-zA-Z]{2,}\*?\{([^{}]*)\}", 0, r"\1"),
        (r"(?<![\w:\\])\\(?:hline|centering|noindent|newpage|toprule|midrule|bottomrule|maketitle)\b *", 0, ""),
        (r"``([^`'\n]+)''", 0, r"“\1”"),
        (r"(?m)^\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\n?", 0, ""),
        (r"!?\[([^\[\]\n]*)\]\((?=[^()\s])" + TARGET + r"\)", 0, r"\1"),
        (r"\[\^[^\]\s]{1,20}\]:?", 0, ""),
        (r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", 0, r"\1"),
        (r"\[https?://[^\]\s]+\s*([^\]\n]*)\]", 0, r"\1"),
        (r"\{\{[^{}]+\}\}", 0, ""),
        (r"(?m)^(?:\*+|[-+]) +(?:\[[ xX]\] +)?", 0, "• "),
        (r"(?m)^#+ +(?=\S)|(?<=\n)[*#]*[:;]+ +(?=\S)", 0, "• "),
        (r"(?:(?<=\n)|\A)> +(?=\D)|(?<=\n)> +", 0, ""),
        (r"\*\*(?=[^\s*])([^*\n]+?)\*\*", 0, r"\1"),
        (r"(?<!\w)__(?=[^\s_])([^\n]+?)__(?!\w)", 0, r"\1"),
        (r"~~(?=\S)([^~\n]+?)~~", 0, r"\1"),
        (r"`([^`\n]+)`", 0, r"\1"),
        (r"```[^\n]*\n?", 0, ""),
        (r"'{3}(?=[^'\s])([^\n]*?)'{3}|(?<!')'{2}(?=[^'\s])([^\n]*?)'{2}(?!')", 0, r"\1\2"),
        (TAG, 0, ""),
        (r"-->", 0, ""),
        (r"\\([%&_#$])", 0, r"\1"),
        (r"\\[,;!]", 0, " "),
        (r"\\\\", 0, "\n"),
    )
)
ROW = re.compile(r"(?m)^\|(.*)\|[ \t]*$")
ENTITY = re.compile(PIECES[2])


def formula_text(tex: str) -> str:
    """A formula in plain characters: known commands become signs, fractions and roots get parentheses."""
    if "<" in tex:
        tex = re.sub(r"<[^<>]*>", "", tex)
    tex = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", tex)
    tex = re.sub(r"\\sqrt\{((?:[^{}]|\{[^{}]*\})*)\}", r"√(\1)", tex)
    tex = re.sub(r"\\(?:hat|bar|tilde|vec|mathrm|text|mathbf)\{([^{}]*)\}", r"\1", tex)
    tex = re.sub(r"\\([a-zA-Z]+)(?![a-zA-Z])", lambda m: SYMBOLS.get(m[1], m[1]), tex)
    return re.sub(r"\s+", " ", re.sub(r"\\[,;! ]|[{}]|\\", lambda m: " " if m[0][1:] else "", tex)).strip()


def clean(text: str) -> str:
    """Plain text: headings and formulas as paragraphs or in place, list items after "• ", table cells parted by tabs,
    code blocks verbatim, indented by four spaces, paragraphs parted by blank lines."""
    kept: list[str] = []

    def keep(block: str) -> str:
        kept.append(block)
        return f"{HEAD}{len(kept) - 1}{END}"

    def code(m: re.Match) -> str:
        body = next(m[g] for g in "abcd" if m[g] is not None)
        body = html.unescape(body) if m["b"] is not None else body
        return "\n\n" + keep("\n".join("    " + x for x in body.strip("\n").split("\n"))) + "\n\n"

    def formula(m: re.Match) -> str:
        return keep(formula_text(next(m[g] for g in "abcdeg" if m[g] is not None)))

    def tabular(m: re.Match) -> str:
        rows = [re.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", r).strip() for r in m[1].split("\\\\")]
        return "\n\n" + "\n".join(re.sub(r"\s*(?<!\\)&\s*", "\t", r) for r in rows if r) + "\n\n"

    def wiki_table(m: re.Match) -> str:
        rows = [x.lstrip("|! ") for x in m[1].split("\n") if x.strip() and not x.startswith(("|-", "|+"))]
        return "\n\n" + "\n".join(re.sub(r"\s*(?:\|\||!!)\s*", "\t", r) for r in rows) + "\n\n"

    text = text.replace(HEAD, "").replace(END, "")
    text = FORMULA.sub(formula, CODE.sub(code, text))
    text = WIKI_TABLE.sub(wiki_table, TABULAR.sub(tabular, text))
    for pattern, by in STEPS:
        text = pattern.sub(by, text)
    text = ROW.sub(lambda m: "\t".join(x.strip() for x in m[1].split("|")), text)
    text = ENTITY.sub(lambda m: html.unescape(m[0]).replace("\xa0", " "), text)
    text = re.sub(r"(?<![\w:\\])\\([a-zA-Z]{2,})(?![a-zA-Z])", lambda m: SYMBOLS.get(m[1], ""), text)
    text = re.sub(r"[ \t]+(?=\n)", "", re.sub(r" {2,}", " ", text))
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return re.sub(f"{HEAD}(\\d+){END}", lambda m: kept[int(m[1])], text)


def clean_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, had_markup): every row with its text cleaned. Texts without markup, nulls included, pass unchanged
    and never leave the JVM."""
    kind = df.schema[key].dataType.simpleString()
    rows, marked = df.select(F.col(key), F.col(text).alias("text")), has_markup(F.col("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(text=[clean(t) for t in f["text"]])

    dirty = rows.filter(marked).withColumn("had_markup", F.lit(True)).mapInPandas(run, f"{key} {kind}, text string, had_markup boolean")
    return rows.filter(~marked).withColumn("had_markup", F.lit(False)).unionByName(dirty)


# ---------------------------------------------------------------------------------------------- consensus host paths

#: Hosts whose lost paths are broadcast; with more of them, the pages of a host meet them in parts.
BROADCAST_HOSTS = 5000
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "wbr"}
INLINE = {"a", "b", "i", "em", "strong", "span", "sup", "sub", "code", "u", "s", "small", "ref", "mi", "mo", "mn", "font", "abbr"}


class Containers(HTMLParser):
    """The containers of one page, and its markup in order, each stretch with the container that it belongs to."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.stack = [0]
        self.paths, self.own, self.linked_own = [""], [0], [0]
        self.linked = 0
        self.stretches: list[tuple[int, str, bool]] = []  # container, markup, whether it is text

    @property
    def at(self) -> int:
        return self.stack[-1]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        raw = self.get_starttag_text() or ""
        if tag == "a":
            self.linked += 1
        if tag not in INLINE and tag not in VOID:
            css = re.sub(r"\d+", "", (dict(attrs).get("class") or "").split(" ")[0])
            self.paths.append(f"{self.paths[self.at]}/{tag}{'.' + css if css else ''}")
            self.own.append(0)
            self.linked_own.append(0)
            self.stack.append(len(self.paths) - 1)
        self.stretches.append((self.at, raw, False))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.stretches.append((self.at, self.get_starttag_text() or "", False))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.linked = max(0, self.linked - 1)
        if tag in INLINE or tag in VOID:
            self.stretches.append((self.at, f"</{tag}>", False))
            return
        names = [self.paths[i].rpartition("/")[2].split(".")[0] for i in self.stack[1:]]
        if tag in names:
            keep = len(names) - names[::-1].index(tag)  # the innermost open one of that name
            self.stretches.append((self.stack[keep], f"</{tag}>", False))
            del self.stack[keep:]

    def handle_data(self, data: str, n: int | None = None) -> None:
        n = len(data.strip()) if n is None else n
        self.own[self.at] += n
        self.linked_own[self.at] += n if self.linked else 0
        self.stretches.append((self.at, data, True))

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};", 1)

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};", 1)

    def scored(self) -> list[tuple[str, int, int]]:
        """(path, text characters, linked characters) of the containers with text; scripts and styles have none."""
        return [(p, n, k) for p, n, k in zip(self.paths, self.own, self.linked_own) if n and not re.search(r"/(?:script|style)(?:[./]|$)", p)]

    def kept(self, wanted: set[str]) -> str:
        """The page's markup without the texts of containers outside `wanted` and the tags that hold nothing else."""
        around = {p[: m.start()] for p in wanted for m in re.finditer("/", p)} | wanted
        return "".join(raw for i, raw, text in self.stretches if self.paths[i] in (wanted if text else around))


def parsed(text: str) -> Containers:
    parser = Containers()
    parser.feed(text)
    parser.close()
    return parser


def containers(text: str) -> list[tuple[str, int, int, str]]:
    """(path, text characters, linked characters, text) of a page's containers with text."""
    page = parsed(text)
    return [(p, n, k, "".join(raw for i, raw, is_text in page.stretches if is_text and page.paths[i] == p).strip()) for p, n, k in page.scored()]


def host_paths(pages: DataFrame, key: str, text: str, host: str, least_share: float = 0.02, least_pages: float = 0.002) -> DataFrame:
    """(key, host, paths, text): every page extracted by the container paths that its host agrees on, as clean text.

    A container's score is its own text without linked text, as a share of the page. Pages vote with these scores for
    generalised paths (tags with the first class, digits removed), sums are combined before the shuffle. A path loses on a
    host if at least two of its pages, and `least_pages` of them, hold it and it gets less than `least_share` of a page
    on average there; navigation does, a heading or a list item does not, and what too few pages hold to agree on stays.
    A page whose containers all lose keeps its best one.
    What is left of a page is its markup with the texts of the winners, which `clean` turns into text, so headings, lists,
    tables, code and formulas stay, as do the marks of other languages inside elements. Pages without any element are
    one container, the path '', and are cleaned whole. Null texts give an empty text; a null host is '?'.
    A host may hold any share of all pages: only (path, votes) rows are grouped by host, and of those the losers, which
    are at most the paths of a page over `least_pages`.
    """
    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key), F.coalesce(F.col(host).cast("string"), F.lit("?")).alias("host"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(TAG), F.lit(False)).alias("is_page"))
    marked = rows.filter("is_page")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for h, t in zip(f["host"], f["text"]):
                found = parsed(t).scored()
                whole, own = sum(n for _, n, _ in found) or 1, {}
                for p, n, linked in found:
                    own[p] = own.get(p, 0.0) + (n - linked) / whole
                out += [(h, p, v) for p, v in own.items()] + [(h, None, 0.0)]
            yield pd.DataFrame(out, columns=["host", "path", "score"])

    votes = marked.select("host", "text").mapInPandas(score, "host string, path string, score double").groupBy("host", "path").agg(F.sum("score").alias("votes"), F.count("*").alias("pages"))
    votes = materialize(votes)
    of_host = votes.filter("path is null").select("host", F.col("pages").alias("all_pages"))
    lost = votes.filter("path is not null").join(of_host, "host").filter((F.col("pages") >= F.greatest(F.lit(2), least_pages * F.col("all_pages"))) & (F.col("votes") < least_share * F.col("pages")))
    losers = lost.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("lost"))

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, h, t, e in zip(f[key], f["host"], f["text"], f["lost"]):
                page, lost = parsed(t), set(e if e is not None else ())
                found = page.scored()
                kept = {x[0] for x in found if x[0] not in lost} or {x[0] for x in sorted(found, key=lambda x: x[2] - x[1])[:1]}
                out.append((k, h, sorted(kept), clean(page.kept(kept))))
            yield pd.DataFrame(out, columns=[key, "host", "paths", "text"])

    met = small_left_join(marked, materialize(losers), ["host"], F.col(key), BROADCAST_HOSTS)
    extracted = met.select(key, "host", "text", "lost").mapInPandas(extract, f"{key} {kind}, host string, paths array<string>, text string")
    bare = clean_texts(rows.filter("not is_page").withColumn("__key", F.struct(F.col(key).alias("k"), "host")), "__key", "text")
    plain = bare.select(F.col("__key.k").alias(key), "__key.host", F.array(F.lit("")).alias("paths"), F.coalesce("text", F.lit("")).alias("text"))
    return plain.unionByName(extracted)
