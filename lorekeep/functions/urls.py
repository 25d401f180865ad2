"""URL predicates and rewrites as Column expressions.

The splits below follow the generic URI grammar (scheme, authority, path, query, fragment), with
the parameter part of the last path segment set aside.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# URL fragments that mark pages without content.
SKIP_PATTERNS = (
    "/book-an-appointment",
    "/book-",
    "/booking",
    "/contact",
    "/privacy-policy",
    "/privacy",
    "/terms",
    "/cookie",
    "/login",
    "/signup",
    "/register",
    "/cart",
    "/checkout",
    "?",
    "#",
)

# URL fragments that mark content pages at any depth.
CONTENT_PATTERNS = (
    "/about",
    "/services",
    "/team",
    "/staff",
    "/blog",
    "/article",
    "/post",
    "/faq",
    "/help",
    "/guide",
    "/our-",
    "/what-",
    "/how-",
)

MAX_PLAIN_DEPTH = 2

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_ORIGIN = r"^(https?://[^/?#]+)"
# A path of at most MAX_PLAIN_DEPTH non-empty segments, the parameters of the last one aside.
_SHALLOW = (
    r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?"
    rf"/*(?:[^/?#]+(?:/+[^/?#]+){{0,{MAX_PLAIN_DEPTH - 1}}})?/*(?:;[^/?#]*)?(?:[?#]|$)"
)


def _any_of(haystack: Column, needles: tuple[str, ...]) -> Column:
    """One alternation, so that a filter evaluates ``haystack`` once and not once per needle."""
    return haystack.rlike("|".join(re.escape(needle) for needle in needles))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    """Host with port and letter case as written; empty when there is no ``//`` part."""
    return F.regexp_extract(url, _NETLOC, 1)


def site(url: Column) -> Column:
    """Comparison key of the host: every ``www.`` taken out."""
    return F.replace(netloc(url), F.lit("www."), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), ";[^/]*$", "")


def path_depth(url: Column) -> Column:
    """Number of non-empty path segments."""
    return F.regexp_count(path(url), F.lit("[^/]+"))


def normalize(url: Column) -> Column:
    """Trailing slashes go first, then the fragment, then the query (so ``/a/#x`` keeps its slash)."""
    bare = F.regexp_replace(url, "/+$", "")
    return F.substring_index(F.substring_index(bare, "#", 1), "?", 1)


def canonical(url: Column) -> Column:
    """Key under which ``www`` and plain spellings of one page coincide."""
    whole = F.concat(scheme(url), F.lit("://"), site(url), path(url))
    return F.regexp_replace(whole, "/+$", "")


def same_site(url: Column, base: Column) -> Column:
    return site(url) == site(base)


def should_crawl(url: Column) -> Column:
    """Not a skip pattern, and either a content pattern or a shallow path. A home page has no path
    segments, so it is shallow. Crawls test many links: the depth is one pattern, not a split."""
    lowered = F.lower(url)
    worthwhile = _any_of(lowered, CONTENT_PATTERNS) | url.rlike(_SHALLOW)
    return ~_any_of(lowered, SKIP_PATTERNS) & worthwhile


def is_http(source: Column) -> Column:
    return source.startswith("http")


def source_type(source: Column) -> Column:
    lowered = F.lower(source)
    return (
        F.when(lowered.endswith(".pdf"), "pdf")
        .when(lowered.startswith("http://") | lowered.startswith("https://"), "website")
        .when(lowered.endswith(".doc") | lowered.endswith(".docx"), "document")
        .otherwise("text")
    )


def file_name(url: Column) -> Column:
    """Last path part, null when the path ends in a slash or is empty."""
    last = F.element_at(F.split(path(url), "/"), -1)
    return F.when(last != "", last)


@F.arrow_udf(StringType())
def _join_url(base: pa.Array, href: pa.Array) -> pa.Array:
    def one(page, link):
        if page is None or link is None:
            return None
        try:
            return urljoin(page, link)
        except ValueError:
            return None

    return pa.array([one(b, h) for b, h in zip(base.to_pylist(), href.to_pylist())], pa.string())


# Links that need no joining beyond a prefix: absolute, host-rooted or path-rooted, without dot
# segments, parameters, white space or an empty query or fragment.
_PLAIN_LINK = (
    r"^(?:(?:https?:)?//[^/?#;\[\]\x{00}-\x{20}]+(?=[/?#]|$)|/(?![/.]))"
    r"(?:(?!/\.|[?]#)[^;\x{00}-\x{20}])*(?<![?#])$"
)
_PLAIN_BASE = r"^https?://[^/?#\[\]\t\r\n]+(?:[/?#][^\t\r\n]*)?$"


def resolve(base: Column, href: Column) -> Column:
    """Relative reference against its page.

    Plain links are string work and stay in the JVM. Only the rest is handed to Python: for the plain
    ones the function's input is null, so they cost it nothing but a validity bit.
    """
    plain = base.rlike(_PLAIN_BASE) & href.rlike(_PLAIN_LINK)
    native = (
        F.when(~href.startswith("/"), href)
        .when(href.startswith("//"), F.concat(F.substring_index(base, "//", 1), href))
        .otherwise(F.concat(F.regexp_extract(base, _ORIGIN, 1), href))
    )
    rest = F.when(~plain, F.struct(base.alias("base"), href.alias("href")))
    return F.when(plain, native).otherwise(_join_url.asNondeterministic()(rest["base"], rest["href"]))
