"""Rows out of HTML pages: a table function over article blocks, JSON-LD and anchors."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

_LD = re.compile(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>')
_ARTICLE = re.compile(r"(?is)<article\b.*?</article>")
_ANCHOR = re.compile(r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>""")
_HEAD = re.compile(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>")
_PARA = re.compile(r"(?is)<p\b[^>]*>(.*?)</p>")
_TIME = re.compile(r"""(?is)<time\b(?:[^>]*?\bdatetime=["']([^"']+)["'])?[^>]*>(.*?)</time>""")


def plain(text: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())


@udtf(returnType="title string, link string, summary string, published string, origin string")
class ArticleRows:
    """The entries of a page: its JSON-LD articles, else its article blocks, else its anchors with a text of four words or more."""

    def eval(self, page: str) -> Iterator[tuple]:
        if not page:
            return
        found = False
        for block in _LD.findall(page):
            try:
                data = json.loads(block)
            except ValueError:
                continue
            for x in data if isinstance(data, list) else data.get("@graph", [data]) if isinstance(data, dict) else []:
                if isinstance(x, dict) and x.get("headline"):
                    found = True
                    yield x["headline"], x.get("url"), x.get("description"), x.get("datePublished"), "json-ld"
        if found:
            return
        for block in _ARTICLE.findall(page):
            a, h, p, t = _ANCHOR.search(block), _HEAD.search(block), _PARA.search(block), _TIME.search(block)
            title = plain(h.group(1)) if h else plain(a.group(2)) if a else ""
            if title:
                found = True
                yield title, a.group(1) if a else None, plain(p.group(1)) if p else None, (t.group(1) or plain(t.group(2))) if t else None, "article"
        if found:
            return
        for link, text in _ANCHOR.findall(page):
            if len(plain(text).split()) >= 4:
                yield plain(text), link, None, None, "anchor"


def anchors(page: Column) -> Column:
    """``(href, text)`` of every anchor, by built-in expressions."""
    pattern = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    texts = F.transform(F.regexp_extract_all(page, F.lit(pattern), F.lit(2)), lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"\s+", " ")))
    return F.arrays_zip(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)).alias("href"), texts.alias("text"))


def best_anchor(pairs: Column, words: Column) -> Column:
    """The link whose text shares most words with a title; the shorter text and the earlier link win ties."""
    scored = F.transform(
        pairs,
        lambda a, i: F.struct(
            F.size(F.array_intersect(F.regexp_extract_all(F.lower(a["text"]), F.lit("([a-z0-9]+)"), F.lit(1)), words)).alias("score"), (-F.length(a["text"])).alias("short"), (-i).alias("early"), a["href"].alias("href")
        ),
    )
    return F.array_max(scored)["href"]
