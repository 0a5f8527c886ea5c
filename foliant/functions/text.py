"""Quality signals, clean-up, page markup, keys and labels of documents as column expressions.

Null texts give null, except where a default is named. Nothing here leaves the JVM but `soft_hyphens_joined`'s caller
passes the document's vocabulary in as an array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mark that stands for a line-end hyphen, the page marker, the page break, widths of names and hashes.
HYPHEN_MARK = "\u0002"
PAGE_MARKER = r"(?md)^<!-- page (\d+) \| method=(\w+) -->$"
PAGE_BREAK = "\n\n"
NAME_LENGTH = 16
HASH_LENGTH = 12

SPACE = r"(?U)\s"


def solid_length(text: Column) -> Column:
    """Characters that are not white space (bigint)."""
    return F.length(F.regexp_replace(text, SPACE, "")).cast("bigint")


def _count(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("bigint")


def garbage_ratio(text: Column) -> Column:
    """Share of the solid characters that point to a broken text layer: replacement, control and private-use characters
    and the length of `(cid:n)`; the hyphen mark is none. 0 for blank text."""
    bad = _count(text, r"[�-\u0000\u0001\u0003-\u0008\u000E-\u001B]") + _count(text, r"\(cid:[0-9]+\)")
    return F.when(solid_length(text) > 0, bad / solid_length(text)).when(text.isNotNull(), F.lit(0.0))


def alpha_ratio(text: Column) -> Column:
    """Share of letters among the solid characters; 0 for blank text."""
    return F.when(solid_length(text) > 0, _count(text, r"\p{L}") / solid_length(text)).when(text.isNotNull(), F.lit(0.0))


def vocabulary(text: Column) -> Column:
    """Distinct lower-cased words of a text."""
    words = F.regexp_extract_all(F.lower(F.translate(text, HYPHEN_MARK, " ")), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.array_distinct(words)


def soft_hyphens_joined(text: Column, words: Column) -> Column:
    """Words parted by the hyphen mark: joined where the joined form is in `words`, else kept with a hyphen."""
    parts = F.split(text, HYPHEN_MARK)
    tail = lambda s: F.regexp_extract(s, r"(?U)(\w+)$", 1)
    head = lambda s: F.regexp_extract(s, r"(?U)^(\w+)", 1)
    glued = lambda acc, x: F.when(
        (tail(acc) != "") & (head(x) != "") & F.array_contains(words, F.lower(F.concat(tail(acc), head(x)))), F.concat(acc, x)
    ).otherwise(F.concat_ws("-", acc, x))
    return F.when(F.size(parts) > 1, F.aggregate(F.slice(parts, F.lit(2), F.size(parts) - 1), parts[0], glued)).otherwise(text)


def clean_text_layer(text: Column, words: Column | None = None) -> Column:
    """A text layer with line ends made uniform, split words joined when `words` (by default the text's own) know them,
    hyphens kept between numbers and names, control characters dropped and at most one blank line between paragraphs."""
    lines = F.regexp_replace(text, "\r\n?", "\n")
    joined = soft_hyphens_joined(lines, vocabulary(lines) if words is None else words)
    kept = F.regexp_replace(joined, r"(?U)(?<=\w)-\n(?=\w)", "-")
    plain = F.regexp_replace(kept, r"[\u0000-\u0008\u000B\u000C\u000E-\u001F]", "")
    return stripped(F.regexp_replace(F.regexp_replace(plain, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def render_pages(title: Column, pages: Column) -> Column:
    """Page-marked Markdown; `pages` is an array of structs (number, method, text) in order."""
    body = F.transform(pages, lambda p: F.concat(F.lit("<!-- page "), p["number"].cast("string"), F.lit(" | method="), p["method"], F.lit(" -->\n"), p["text"], F.lit("\n")))
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(stripped(F.array_join(F.concat(F.array(head), body), "\n")), F.lit("\n"))


def split_pages(markdown: Column) -> Column:
    """Array of structs (number, text) from page-marked Markdown. A repeated number keeps its first place and its last
    text."""
    numbers = F.regexp_extract_all(markdown, F.lit(PAGE_MARKER), F.lit(1))
    parts = F.split(markdown, PAGE_MARKER.replace("(\\d+)", "\\d+").replace("(\\w+)", "\\w+"))
    texts = F.slice(parts, F.lit(2), F.size(parts) - 1)
    raw = F.zip_with(numbers, texts, lambda n, t: F.struct(n.cast("int").alias("number"), stripped(t).alias("text")))
    first = F.array_distinct(F.transform(raw, lambda p: p["number"]))
    return F.transform(first, lambda n: F.struct(n.alias("number"), F.element_at(F.filter(raw, lambda p: p["number"] == n), -1)["text"].alias("text")))


def retitled(markdown: Column, old: Column, new: Column) -> Column:
    """Markdown whose first line `# old` is exchanged for `# new`; null where it does not start so."""
    head = F.concat(F.lit("# "), old, F.lit("\n"))
    return F.when(markdown.startswith(head), F.concat(F.lit("# "), new, F.lit("\n"), F.substr(markdown, F.length(head) + 1)))


def citation(title: Column, authors: Column, year: Column, reference: Column, fallback: Column) -> Column:
    """`Last et al. (year). Title. arXiv:id` with the parts that are known."""
    last = F.element_at(F.split(F.trim(authors[0]), r"\s+"), -1)
    who = F.when(F.size(authors) > 1, F.concat(last, F.lit(" et al."))).when(F.size(authors) == 1, last)
    head = F.concat_ws(" ", who, F.when(year > 0, F.concat(F.lit("("), year.cast("string"), F.lit(")"))))
    named = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(fallback)
    return F.array_join(F.filter(F.array(head, named, F.concat(F.lit("arXiv:"), reference)), lambda p: p.isNotNull() & (p != "")), ". ")


def config_hash(*parts: Column) -> Column:
    """The first 12 hex digits of the SHA-256 of a JSON list of strings, written with blanks after commas."""
    return F.substring(F.sha2(F.concat(F.lit('["'), F.concat_ws('", "', *parts), F.lit('"]')), 256), 1, HASH_LENGTH)


def slug(name: Column) -> Column:
    """Lower case with everything that is no letter or digit as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_part(identity: Column) -> Column:
    """The first 16 characters of an id if those are safe in a path, else of its SHA-256."""
    return F.when(identity.rlike("^[A-Za-z0-9_-]+$"), F.substring(identity, 1, NAME_LENGTH)).otherwise(F.substring(F.sha2(identity, 256), 1, NAME_LENGTH))


def chunk_name(doc_id: Column, first: Column, last: Column) -> Column:
    return F.concat(F.substring(doc_id, 1, NAME_LENGTH), F.lit(" pages "), first.cast("string"), F.lit("-"), last.cast("string"))


def format_query(instruction: Column, text: Column) -> Column:
    return F.when(F.coalesce(instruction, F.lit("")) != "", F.concat(F.lit("Instruct: "), instruction, F.lit("\nQuery:"), text)).otherwise(text)


# ---------------------------------------------------------------------------------------------- routing

#: The routing thresholds.
MIN_CHARS, IMAGE_COVERAGE, IMAGE_MAX_CHARS, MAX_GARBAGE, MIN_ALPHA = 50, 0.6, 400, 0.10, 0.5


def percent(x: Column) -> Column:
    return F.concat(F.bround(x * 100, 0).cast("int").cast("string"), F.lit("%"))


def ocr_reasons(n_chars: Column, image_coverage: Column, garbage: Column, alpha: Column, force: Column | None = None) -> Column:
    """Ordered reasons why a page needs recognition, empty if it does not. Forcing is a reason only where no other is."""
    found = F.array_compact(
        F.array(
            F.when(n_chars < MIN_CHARS, F.concat(F.lit("only "), n_chars.cast("string"), F.lit(f" embedded chars (<{MIN_CHARS})"))),
            F.when((image_coverage >= IMAGE_COVERAGE) & (n_chars < IMAGE_MAX_CHARS), F.concat(F.lit("image covers "), percent(image_coverage), F.lit(" of page with little text"))),
            F.when(garbage > MAX_GARBAGE, F.concat(F.lit("garbled text layer ("), percent(garbage), F.lit(" bad glyphs)"))),
            F.when((n_chars >= MIN_CHARS) & (alpha < MIN_ALPHA), F.concat(F.lit("low alphabetic ratio ("), percent(alpha), F.lit(")"))),
        )
    )
    if force is None:
        return found
    return F.when(force & (F.size(found) == 0), F.array(F.lit("forced (--ocr-all)"))).otherwise(found)


# ---------------------------------------------------------------------------------------------- language of questions

#: Function words of English, and of other languages as far as they are no English words too.
ENGLISH = (
    "the of and is are was were be been what which who whom whose how why when where does do did can could should would will "
    "with without for from this that these those it its in on at by as than then there their they we our you your not or if "
    "between about into over under has have had"
).split()
OTHER = (
    "el la los las un una unos unas de del que qué es son por para con como cómo cuál cuáles cuándo dónde quién quiénes se su "
    "sus al lo y o pero más muy entre sobre desde hasta hay está están ser fue "
    "le les des du est sont pour dans avec comment quel quelle quels quelles qui quoi pourquoi quand où et ou mais plus très sur "
    "sous entre être "
    "der die das den dem des ein eine einer einen und ist sind für mit von zu im wie was welche welcher warum wann wo nicht auch "
    "auf aus bei "
    "uma uns umas dos das não são você como qual quais porque quando onde "
    "il gli lo della dello degli delle che cosa quale quali perché dove sono è con"
).split()


def looks_english(question: Column) -> Column:
    """More English function words than others; with none of either, only ASCII letters. False for null."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"(\p{L}+)"), F.lit(1))
    count = lambda known: F.size(F.filter(words, lambda w: F.array_contains(F.array(*(F.lit(x) for x in sorted(set(known)))), w)))
    english, other = count(ENGLISH), count(OTHER)
    plain = ~F.exists(words, lambda w: w.rlike(r"[^\x00-\x7F]"))
    return F.coalesce(F.when((english > 0) | (other > 0), english > other).otherwise(plain), F.lit(False))


# ---------------------------------------------------------------------------------------------- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector divided by its length plus 1e-12."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / (norm + 1e-12))


# ---------------------------------------------------------------------------------------------- names of papers, headers


def arxiv_id(value: Column) -> Column:
    """A bare identifier: without URL, `arXiv:` prefix, file ending or version."""
    bare = F.regexp_replace(F.trim(value), r"(?i)^(?:https?://(?:www\.)?arxiv\.org/(?:abs|pdf|e-print|src)/|arxiv:)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)\.pdf$", ""), r"v\d+$", "")


def arxiv_version(value: Column) -> Column:
    found = F.regexp_extract(F.regexp_replace(F.trim(value), r"(?i)\.pdf$", ""), r"(v\d+)$", 1)
    return F.when(found != "", found)


def safe_file_name(value: Column) -> Column:
    return F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "_")


def id_list(value: Column) -> Column:
    """Distinct identifiers of `ids: a, b c`, in order of appearance."""
    body = F.regexp_replace(value, r"(?i)^\s*ids:\s*", "")
    return F.array_distinct(F.transform(F.filter(F.split(body, r"[,\s]+"), lambda x: x != ""), arxiv_id))


def disposition_name(header: Column) -> Column:
    """The file name of a Content-Disposition header, null if there is none."""
    quoted = F.regexp_extract(header, r"(?i)filename=\"([^\"]+)\"", 1)
    bare = F.regexp_extract(header, r"(?i)filename=([^\";\s]+)", 1)
    return F.when(quoted != "", quoted).when(bare != "", bare)


def bare_etag(header: Column) -> Column:
    return F.regexp_replace(header, r"^(?:W/)?\"|\"$", "")


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds to wait, from a number of seconds or an HTTP date; never negative, null if it is neither."""
    date = F.regexp_extract(value, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    at = F.try_to_timestamp(F.when(date != "", date), F.lit("d MMM yyyy HH:mm:ss"))
    wait = F.unix_timestamp(at) - F.unix_timestamp(now)
    return F.when(F.trim(value).rlike(r"^\d+(\.\d+)?$"), F.trim(value).cast("double")).when(at.isNotNull(), F.greatest(F.lit(0.0), wait.cast("double")))


def with_query(url: Column, **params: Column) -> Column:
    """The URL with encoded parameters appended."""
    query = F.concat_ws("&", *(F.concat(F.lit(k), F.lit("="), F.url_encode(v)) for k, v in params.items()))
    return F.concat(url, F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?")), query)


def is_html(text: Column) -> Column:
    """A document type or html element within the first 15 characters after white space."""
    head = F.lower(F.substring(F.regexp_replace(text, r"(?U)^\s+", ""), 1, 15))
    return head.startswith("<!doctype html") | head.startswith("<html")


# ---------------------------------------------------------------------------------------------- identities


def fingerprint(**parts: Column) -> Column:
    """A canonical identity: the parts as JSON, sorted by name."""
    return F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))))


def subset_id(suite: Column, category: Column, size: Column, seed: Column) -> Column:
    """A name for a drawn subset with eight digits of the SHA-1 of what it was drawn by."""
    drawn = F.concat_ws(":", category, size.cast("string"), seed.cast("string"))
    return F.concat(suite, F.lit("-"), size.cast("string"), F.lit("-"), F.substring(F.sha1(drawn), 1, 8))
