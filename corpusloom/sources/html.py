"""Web pages to text."""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HIDDEN = {"script", "style", "noscript", "template", "svg"}
_AROUND = {"nav", "header", "footer", "aside"}
_BREAKS = {"p", "div", "br", "li", "tr", "section", "article", "blockquote", "pre", "ul", "ol", "table", "main", "form"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Extractor(HTMLParser):
    """Text outside hidden elements and, if ``trim``, outside what surrounds the content. An element that isn't closed ends with its parent."""

    def __init__(self, trim: bool = True):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.meta: dict[str, str] = {}
        self.open: list[str] = []
        self.around = _AROUND if trim else set()
        self.in_title = False

    @property
    def skip(self) -> bool:
        return any(t in _HIDDEN or t in self.around for t in self.open)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("content"):
            self.meta.setdefault((a.get("property") or a.get("name") or "").lower(), a["content"])
        elif tag == "title" and "svg" not in self.open:
            self.in_title = True
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " " if not self.skip else "")
        elif tag == "li":
            self.parts.append("\n- " if not self.skip else "")
        elif tag in _BREAKS:
            self.parts.append("\n")
        if tag in ("article", "main"):  # content, wherever it lies
            self.open = [t for t in self.open if t not in self.around]
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.open:
            while self.open.pop() != tag:
                pass
        if tag in _BREAKS or re.fullmatch("h[1-6]", tag):
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.parts.append(data)


def extract_html(html: str | None) -> tuple[str, str, str, str]:
    """(title, author, text, status); status is failed for pages without text. Where all text surrounds the content, it is the content."""
    for trim in (True, False):
        x = _Extractor(trim)
        x.feed(html or "")
        x.close()
        text = re.sub(r"[^\S\n]+", " ", "".join(x.parts))
        text = re.sub(r" ?\n ?", "\n", text)
        text = re.sub(r"\n{3,}", "\n\n", text).strip()
        if text:
            break
    title = x.meta.get("og:title") or "".join(x.title).strip()
    return title, x.meta.get("author", ""), text, "ok" if text else "failed"


# Signs of a page made by scripts, and of one that refuses its reader, in its source in lower case.
SCRIPTED = ["__next_data__", 'id="root"', 'id="app"', "loading", "enable javascript"]
REFUSED = ["captcha", "access denied", "sign in to continue", "enable javascript"]


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, author, text, status, needs_rendering (no text, or less than 240 characters and signs of scripts), blocked.

    The signs are found in the JVM; html goes to Python once, and only its text comes back. Null html is a failed page.
    """
    any_of = lambda signs: F.coalesce(reduce(Column.__or__, (F.contains(F.lower("html"), F.lit(s)) for s in signs)), F.lit(False))

    def parse(batches):
        for b in batches:
            t = [extract_html(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "scripted": b["scripted"], "blocked": b["blocked"], "title": [x[0] for x in t], "author": [x[1] for x in t], "text": [x[2] for x in t], "status": [x[3] for x in t]})

    signed = pages.select("page_id", "url", "html", any_of(SCRIPTED).alias("scripted"), any_of(REFUSED).alias("blocked"))
    out = signed.mapInPandas(parse, "page_id long, url string, scripted boolean, blocked boolean, title string, author string, text string, status string")
    rendering = (F.col("status") == "failed") | (F.col("scripted") & (F.length("text") < 240))
    return out.select("page_id", "url", "title", "author", "text", "status", rendering.alias("needs_rendering"), "blocked")
