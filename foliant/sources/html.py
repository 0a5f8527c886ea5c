"""HTML files as Markdown text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SKIPPED = {"script", "style", "head", "noscript", "template"}
BREAKS = {"p", "div", "section", "article", "table", "ul", "ol", "blockquote", "header", "footer", "main", "figure"}


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.pre = False
        self.title: str | None = None
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.in_title = tag == "title"
        if tag in SKIPPED:
            self.hidden += 1
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "tr":
            self.out.append("\n|")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in BREAKS:
            self.out.append("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag in ("td", "th"):
            self.out.append(" |")
        elif tag in BREAKS or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title = (self.title or "") + data
        elif not self.hidden:
            self.out.append(data if self.pre else " ".join(data.split()) if data.strip() else " " if data else "")


def convert(html: str) -> tuple[str | None, str]:
    """(title, Markdown text) of one page: headings, lists, rows and code blocks kept, scripts and styles dropped."""
    w = _Writer()
    w.feed(html)
    w.close()
    lines = [x.strip() if not x.startswith("    ") else x.rstrip() for x in "".join(w.out).split("\n")]
    kept: list[str] = []
    for x in lines:
        if x or (kept and kept[-1]):
            kept.append(x)
    return (" ".join(w.title.split()) if w.title and w.title.strip() else None), "\n".join(kept).strip()


def converted(pages: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, title, text): one segment per page; null pages give none."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(k, *convert(t)) for k, t in zip(f[key], f[text])], columns=[key, "title", "text"])

    return pages.filter(f"`{text}` is not null").select(key, text).mapInPandas(run, f"{key} {kind}, title string, text string")
