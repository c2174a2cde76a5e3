"""HTML on columns (patterns), and an exact mode by the standard parser over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsgraph.functions.text import collapse

_DROPPED = {"script", "style", "iframe", "noscript", "svg"}
_KEPT_ATTRIBUTES = {"a": {"href", "title"}, "img": {"src", "alt", "title"}, "blockquote": {"cite"}, "q": {"cite"}}
_BARE = {"img", "br", "hr"}  # tags that may be empty
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    for name, mark in _ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(mark))
    return c


def to_text(html: Column) -> Column:
    """Scripts, styles, comments and tags to blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return collapse(unescape(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")))


def paragraph_length(html: Column) -> Column:
    """Characters of text in closed paragraphs."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda n, p: n + F.length(F.regexp_replace(p, r"(?s)<[^>]*>", "")))


def meta(html: Column, name: str) -> Column:
    """Content of the first meta tag of that name or property, whichever attribute comes first; null if there is none."""
    name = name.replace(".", r"\.")
    after = F.regexp_extract(html, rf"(?is)<meta\s[^>]*?(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*?content\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 1)
    before = F.regexp_extract(html, rf"(?is)<meta\s[^>]*?content\s*=\s*\"([^\"]*)\"[^>]*?(?:name|property)\s*=\s*[\"']{name}[\"']", 1)
    single = F.regexp_extract(html, rf"(?is)<meta\s[^>]*?(?:name|property)\s*=\s*[\"']{name}[\"'][^>]*?content\s*=\s*'([^']*)'", 1)
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (after, single, before)])


#: Meta tags of an article, and where its date may stand.
META = {
    "og_title": "og:title", "og_description": "og:description", "og_url": "og:url", "og_image": "og:image", "og_type": "og:type", "og_site_name": "og:site_name",
    "twitter_card": "twitter:card", "twitter_title": "twitter:title", "twitter_description": "twitter:description", "twitter_image": "twitter:image", "twitter_site": "twitter:site",
    "description": "description", "keywords": "keywords", "author": "author",
}
PUBLISHED = ["article:published_time", "pubdate", "sailthru.date", "date"]


def metadata(html: Column) -> Column:
    """The meta fields of META, publication_date (a timestamp: by the whole value, else by its day) and language."""
    written = F.coalesce(*[meta(html, name) for name in PUBLISHED])
    moment = F.coalesce(*[F.try_to_timestamp(written, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")], F.try_to_timestamp(F.substring_index(written, "T", 1), F.lit("yyyy-MM-dd")))
    language = F.nullif(F.regexp_extract(html, r"(?is)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1), F.lit(""))
    return F.struct(*[meta(html, name).alias(field) for field, name in META.items()], moment.alias("publication_date"), language.alias("language"))


def by_site(html: Column, site: Column, rules: dict[str, list[str]], other: list[str]) -> Column:
    """A field by the ordered patterns of the page's site (the first that isn't empty), by `other` on sites without rules."""
    out = first_of(html, *other)
    for name, patterns in rules.items():
        out = F.when(site == name, first_of(html, *patterns)).otherwise(out)
    return out


def first_of(html: Column, *patterns: str) -> Column:
    """The first pattern's first group that isn't empty."""
    return F.coalesce(*[F.nullif(collapse(unescape(F.regexp_replace(F.regexp_extract(html, p, 1), r"(?s)<[^>]*>", " "))), F.lit("")) for p in patterns])


def fields(html: Column) -> Column:
    """title, heading, language, author, published, description, links, images."""
    return F.struct(
        first_of(html, r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>").alias("title"), first_of(html, r"(?is)<h1[^>]*>(.*?)</h1>").alias("heading"),
        F.nullif(F.regexp_extract(html, r"(?is)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("language"),
        F.coalesce(meta(html, "author"), meta(html, "article:author")).alias("author"), F.coalesce(meta(html, "article:published_time"), meta(html, "date"), F.nullif(F.regexp_extract(html, r"(?is)<time[^>]*datetime=[\"']([^\"']+)", 1), F.lit(""))).alias("published"),
        F.coalesce(meta(html, "description"), meta(html, "og:description")).alias("description"),
        F.size(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href="), F.lit(0))).alias("links"), F.size(F.regexp_extract_all(html, F.lit(r"(?is)<img\s"), F.lit(0))).alias("images"),
    )


def is_article(url: Column, html: Column, by_url: Callable[[Column], Column], least: int = 500) -> Column:
    marked = html.rlike(r"(?is)schema\.org/(News)?Article|property=[\"']article:|og:type[\"'][^>]*content=[\"']article")
    return by_url(url) | marked | (paragraph_length(html) > least)


class _Sanitiser(HTMLParser):
    """Keeps open elements as [tag, what to write, whether there is text in it]; one without text is dropped when it closes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open, self.skipped = [["", [], False]], 0

    def handle_starttag(self, tag, attrs):
        if tag in _DROPPED:
            self.skipped += 1
        elif not self.skipped:
            head = "<" + tag + "".join(f' {k}="{v or ""}"' for k, v in attrs if k in _KEPT_ATTRIBUTES.get(tag, ())) + ">"
            if tag not in _VOID:
                self.open.append([tag, [head], False])
            elif tag in _BARE:
                self.open[-1][1].append(head)

    def handle_startendtag(self, tag, attrs):
        if tag not in _DROPPED:
            self.handle_starttag(tag, attrs)

    def _close(self):
        tag, parts, told = self.open.pop()
        if told:
            self.open[-1][1].append("".join(parts) + f"</{tag}>")
            self.open[-1][2] = True

    def handle_endtag(self, tag):
        if tag in _DROPPED:
            self.skipped = max(0, self.skipped - 1)
        elif not self.skipped and any(o[0] == tag for o in self.open[1:]):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if not self.skipped:
            self.open[-1][1].append(data)
            self.open[-1][2] |= bool(data.strip())

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def sanitised(html: str | None) -> str | None:
    """Without scripts, styles, frames, comments and elements without text; only listed attributes stay, and white space is collapsed."""
    if html is None:
        return None
    parser = _Sanitiser()
    parser.feed(html)
    parser.close()
    while len(parser.open) > 1:
        parser._close()
    return re.sub(r"\s+", " ", re.sub(r">\s+<", "><", "".join(parser.open[0][1])))


@F.pandas_udf(StringType())
def sanitise(html: pd.Series) -> pd.Series:
    return html.map(sanitised)
