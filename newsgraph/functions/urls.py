"""URL functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source"]
#: Patterns of the classes of a news site's URLs. What is excluded is no article whatever else it fits.
EXCLUDED = ["/search", "/login", "/register", "/signup", "/signin", "/logout", "/admin", "/wp-admin", "/feed", "/rss", "/print/", r"\.pdf$", r"\.(jpg|jpeg|png|gif|webp|svg)$", r"\.(mp3|mp4|avi|mov)$", r"\.(zip|rar|gz|tar)$"]
ARTICLE = [r"/\d{4}/\d{2}/\d{2}/", "/article/", "/articles/", "/news/", "/story/", "/post/", "/blog/", r"-\d+\.html$", r"/p/[\w-]+"]
CATEGORY = ["/category/", "/categories/", "/section/", "/sections/", "/topic/", "/tag/", "/tags/"]
ARCHIVE = ["/archive/", "/archives/", r"/\d{4}/$", r"/\d{4}/\d{2}/$"]


def fits(url: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found, whatever the case; one alternation for all."""
    return F.coalesce(url.rlike("(?i)" + "|".join(patterns)), F.lit(False))


def is_article(url: Column, *more: str) -> Column:
    """Not excluded, and like an article by the patterns or by the given ones."""
    return ~fits(url, EXCLUDED) & fits(url, [*ARTICLE, *more])


def without_parameters(url: Column, pattern: str) -> Column:
    """The URL less query parameters whose name fits the pattern."""
    base, query, fragment = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({pattern})(=|$)")), "&")
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""), fragment)


def normal_loaded(url: Column) -> Column:
    """Without tracking parameters."""
    return without_parameters(F.trim(url), "|".join(TRACKING))


def normal_cleaned(url: Column) -> Column:
    """Without fragment, utm parameters and a closing slash."""
    bare = without_parameters(F.regexp_replace(F.trim(url), "#.*$", ""), "utm_[^=]*")
    return F.regexp_replace(bare, r"(?<=[^/:])/+(?=\?|$)", "")


def domain(url: Column) -> Column:
    """Host and port in lower case; null without a host."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))


def url_class(url: Column) -> Column:
    return F.when(fits(url, EXCLUDED), "excluded").when(fits(url, ARTICLE), "article").when(fits(url, CATEGORY), "category").when(fits(url, ARCHIVE), "archive").otherwise("other")
