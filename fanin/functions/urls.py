"""URL splitting and canonical form as Column expressions.

The split follows the generic RFC 3986 reading that Python's ``urlsplit``
applies (scheme, ``//netloc``, path, ``?query``, ``#fragment``), written as
regular expressions so that it runs inside Spark's generated code.  No
``parse_url``: it throws or returns NULL on the malformed URLs that result
lists carry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanin.functions.text import col_, pystrip
from fanin.params import TRACKING_KEYS, USES_NETLOC

SCHEME_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
LEADING_C0_RE = r"^[\x{0}-\x{20}]+"
UNSAFE_RE = r"[\t\r\n]"


def _ipv6_re() -> str:
    h = "[0-9A-Fa-f]{1,4}"
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"{octet}(?:\.{octet}){{3}}"
    alts = [rf"(?:{h}:){{7}}{h}", rf"(?:{h}:){{6}}{v4}", rf"::(?:{h}(?::{h}){{0,6}})?", rf"::(?:{h}:){{0,5}}{v4}"]
    for k in range(1, 8):
        right = rf"(?:{h}(?::{h}){{0,{6 - k}}})?" if k < 7 else ""
        alts.append(rf"(?:{h}:){{{k}}}:{right}")
        if k <= 5:
            alts.append(rf"(?:{h}:){{{k}}}:(?:{h}:){{0,{5 - k}}}{v4}")
    return "^(?:" + "|".join(alts) + r")(?:%[^%]+)?\z"


IPV6_RE = _ipv6_re()
IPVFUTURE_RE = r"(?s)^v[a-fA-F0-9]+\..+\z"


@dataclass
class UrlParts:
    scheme: Column      # lower-cased, '' when absent
    has_netloc: Column  # '//' present
    netloc: Column
    path: Column
    query: Column
    valid: Column       # False where urlsplit raises (bad IPv6 brackets)


def url_parts(url: Column | str) -> UrlParts:
    """Split like ``urllib.parse.urlsplit`` (leading C0/space dropped, tab/CR/LF removed)."""
    t = F.regexp_replace(F.regexp_replace(col_(url), LEADING_C0_RE, ""), UNSAFE_RE, "")
    scheme = F.lower(F.regexp_extract(t, "(" + SCHEME_RE[:-1] + "):", 1))
    rest = F.regexp_replace(t, SCHEME_RE, "")
    has_netloc = rest.startswith("//")
    netloc = F.when(has_netloc, F.regexp_extract(rest, r"^//([^/?#]*)", 1)).otherwise(F.lit(""))
    after = F.when(has_netloc, F.regexp_replace(rest, r"^//[^/?#]*", "")).otherwise(rest)
    path_query = F.regexp_extract(after, r"^([^#]*)", 1)
    path = F.regexp_extract(path_query, r"^([^?]*)", 1)
    query = F.when(path_query.contains("?"), F.regexp_replace(path_query, r"^[^?]*\?", "")).otherwise(F.lit(""))
    has_open, has_close = netloc.contains("["), netloc.contains("]")
    host_in_brackets = F.regexp_extract(netloc, r"\[([^\]]*)", 1)
    bracket_ok = F.when(host_in_brackets.startswith("v"), host_in_brackets.rlike(IPVFUTURE_RE)) \
        .otherwise(host_in_brackets.rlike(IPV6_RE))
    valid = F.when(has_open & has_close, bracket_ok).otherwise(has_open == has_close)
    return UrlParts(scheme, has_netloc, netloc, path, query, valid)


def _drop_tracking(query: Column) -> Column:
    keys = F.array(*[F.lit(k) for k in TRACKING_KEYS])
    kept = F.filter(F.split(query, "&", -1),
                    lambda pair: ~F.array_contains(keys, F.lower(F.substring_index(pair, "=", 1))))
    return F.array_join(kept, "&")


def canonical_url(url: Column | str) -> Column:
    """Dedupe key for result URLs.

    Stripped; scheme and netloc lower-cased; path loses its trailing slashes
    (empty path -> '/'); fragment dropped; tracking pairs dropped from the query
    (key compared case-insensitively) with the other pairs kept in order.  A URL
    that cannot be split becomes its stripped, lower-cased text.
    """
    s = pystrip(url)
    p = url_parts(s)
    path = F.regexp_replace(p.path, r"(?<!/)/+\z", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    netloc_form = F.concat(F.lit("//"), F.lower(p.netloc), path)
    uses_netloc = F.array(*[F.lit(x) for x in USES_NETLOC])
    body = (F.when(p.netloc != "", netloc_form)
            .when(path.startswith("//"), F.concat(F.lit("//"), path))
            .when((p.scheme != "") & F.array_contains(uses_netloc, p.scheme) & path.startswith("/"),
                  F.concat(F.lit("//"), path))
            .otherwise(path))
    with_scheme = F.when(p.scheme != "", F.concat(p.scheme, F.lit(":"), body)).otherwise(body)
    q = _drop_tracking(p.query)
    rebuilt = F.when(q != "", F.concat(with_scheme, F.lit("?"), q)).otherwise(with_scheme)
    return F.when(p.valid, rebuilt).otherwise(F.lower(s))


def url_path(url: Column | str) -> Column:
    p = url_parts(url)
    return F.when(p.valid, p.path).otherwise(F.lit(""))


def looks_like_pdf_url(url: Column | str) -> Column:
    path = F.lower(url_path(url))
    return path.endswith(".pdf") | path.contains(";.pdf")


def pdf_title(url: Column | str) -> Column:
    """Last path segment without its extension, '_' and '-' as spaces; the URL if empty."""
    name = F.regexp_extract(url_path(url), r"([^/]*)\z", 1)
    base = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)
    return F.when(name == "", col_(url)).otherwise(F.translate(base, "_-", "  "))


def result_domain(url: Column | str) -> Column:
    """Lower-cased netloc with every 'www.' removed; the URL itself where it cannot be split."""
    p = url_parts(url)
    return F.when(p.valid, F.replace(F.lower(p.netloc), F.lit("www."), F.lit(""))).otherwise(col_(url))


# ---- staged forms ------------------------------------------------------------
# The Column forms above nest each part inside the next, and conditional
# branches keep Spark from sharing the repeats.  The frame forms below project
# every part once; Catalyst keeps the projections apart because the regex
# results are used more than once.

def _staged_parts(df: DataFrame, url: Column, p: str) -> DataFrame:
    d = df.select("*", F.regexp_replace(F.regexp_replace(url, LEADING_C0_RE, ""), UNSAFE_RE, "").alias(f"{p}t"))
    t = F.col(f"{p}t")
    d = d.select("*", F.lower(F.regexp_extract(t, "(" + SCHEME_RE[:-1] + "):", 1)).alias(f"{p}scheme"),
                 F.regexp_replace(t, SCHEME_RE, "").alias(f"{p}rest"))
    rest = F.col(f"{p}rest")
    has_netloc = rest.startswith("//")
    d = d.select("*", F.when(has_netloc, F.regexp_extract(rest, r"^//([^/?#]*)", 1)).otherwise(F.lit("")).alias(f"{p}netloc"),
                 F.regexp_extract(F.when(has_netloc, F.regexp_replace(rest, r"^//[^/?#]*", "")).otherwise(rest),
                                  r"^([^#]*)", 1).alias(f"{p}pq"))
    pq, netloc = F.col(f"{p}pq"), F.col(f"{p}netloc")
    host = F.regexp_extract(netloc, r"\[([^\]]*)", 1)
    bracket_ok = F.when(host.startswith("v"), host.rlike(IPVFUTURE_RE)).otherwise(host.rlike(IPV6_RE))
    has_open, has_close = netloc.contains("["), netloc.contains("]")
    return d.select("*", F.regexp_extract(pq, r"^([^?]*)", 1).alias(f"{p}path"),
                    F.when(pq.contains("?"), F.regexp_replace(pq, r"^[^?]*\?", "")).otherwise(F.lit("")).alias(f"{p}query"),
                    F.when(has_open & has_close, bracket_ok).otherwise(has_open == has_close).alias(f"{p}valid"))


_PART_COLS = ("t", "scheme", "rest", "netloc", "pq", "path", "query", "valid")


def with_canonical_url(df: DataFrame, url: str = "href", out: str = "canonical_url") -> DataFrame:
    """``df`` plus ``out`` = ``canonical_url(url)``, each part computed once per row."""
    p = "_cu_"
    s = df.select("*", pystrip(url).alias(f"{p}s"))
    d = _staged_parts(s, F.col(f"{p}s"), p)
    path = F.regexp_replace(F.col(f"{p}path"), r"(?<!/)/+\z", "")
    d = d.select("*", F.when(path == "", F.lit("/")).otherwise(path).alias(f"{p}p2"),
                 _drop_tracking(F.col(f"{p}query")).alias(f"{p}q2"))
    path, scheme, netloc, q = F.col(f"{p}p2"), F.col(f"{p}scheme"), F.col(f"{p}netloc"), F.col(f"{p}q2")
    uses_netloc = F.array(*[F.lit(x) for x in USES_NETLOC])
    body = (F.when(netloc != "", F.concat(F.lit("//"), F.lower(netloc), path))
            .when(path.startswith("//"), F.concat(F.lit("//"), path))
            .when((scheme != "") & F.array_contains(uses_netloc, scheme) & path.startswith("/"), F.concat(F.lit("//"), path))
            .otherwise(path))
    with_scheme = F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)
    rebuilt = F.when(q != "", F.concat(with_scheme, F.lit("?"), q)).otherwise(with_scheme)
    final = F.when(F.col(f"{p}valid"), rebuilt).otherwise(F.lower(F.col(f"{p}s")))
    helpers = [f"{p}{c}" for c in _PART_COLS] + [f"{p}s", f"{p}p2", f"{p}q2"]
    return d.select("*", final.alias(out)).drop(*helpers)


def with_result_domain(df: DataFrame, url: str = "url", out: str = "domain") -> DataFrame:
    """``df`` plus ``out`` = ``result_domain(url)``, each part computed once per row."""
    p = "_dm_"
    d = _staged_parts(df, F.col(url), p)
    dom = F.when(F.col(f"{p}valid"), F.replace(F.lower(F.col(f"{p}netloc")), F.lit("www."), F.lit(""))) \
        .otherwise(F.col(url))
    return d.select("*", dom.alias(out)).drop(*[f"{p}{c}" for c in _PART_COLS])


def with_url_path(df: DataFrame, url: str = "url", out: str = "url_path") -> DataFrame:
    """``df`` plus ``out`` = the URL's path ('' where the URL cannot be split)."""
    p = "_up_"
    d = _staged_parts(df, F.col(url), p)
    return d.select("*", F.when(F.col(f"{p}valid"), F.col(f"{p}path")).otherwise(F.lit("")).alias(out)) \
        .drop(*[f"{p}{c}" for c in _PART_COLS])


def pdf_title_from_path(path: Column, url: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    base = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(name)
    return F.when(name == "", url).otherwise(F.translate(base, "_-", "  "))


def pdf_path(path: Column) -> Column:
    low = F.lower(path)
    return low.endswith(".pdf") | low.contains(";.pdf")
