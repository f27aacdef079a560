"""DuckDB SQL renderings of the Column functions, for the oracle queries.

Same rules, same constants, written for DuckDB: ``regexp_replace(.., 'g')``,
``lambda x:`` list filters, ``\\x{..}`` escapes.  Multi-step expressions are
rendered as a chain of sub-selects (``rel`` helpers) so that no text is
repeated inside one expression.
"""

from __future__ import annotations

from fanin.functions import html as H
from fanin.functions import urls as U
from fanin.params import PY_WHITESPACE, TRACKING_KEYS, USES_NETLOC
from fanin.plans import sqlhtml as SH


def lit(s: str) -> str:
    """A DuckDB string literal; control and line-separator characters go through chr()."""
    out, buf = [], []
    for ch in s:
        if ord(ch) < 32 or ord(ch) in (0x85, 0x2028, 0x2029):
            if buf:
                out.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            out.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not out:
        out.append("'" + "".join(buf).replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")" if len(out) > 1 else out[0]


WS_LIT = lit(PY_WHITESPACE)


def strip(x: str) -> str:
    return f"trim({x}, {WS_LIT})"


def rr(x: str, pat: str, rep: str) -> str:
    return f"regexp_replace({x}, {lit(pat)}, {lit(rep)}, 'g')"


def re1(x: str, pat: str) -> str:
    """Replace the first match only (patterns anchored at the start)."""
    return f"regexp_replace({x}, {lit(pat)}, '')"


def rx(x: str, pat: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {lit(pat)}, {group})"


def nullif_empty(x: str) -> str:
    return f"nullif({x}, '')"


def unescape(x: str) -> str:
    return SH.unescape(x)


def collapse_ws(x: str) -> str:
    from fanin.functions.text import WS_CLASS
    return strip(rr(x, WS_CLASS + "+", " "))


def _in_list(x: str, values) -> str:
    return f"{x} IN (" + ", ".join(lit(v) for v in values) + ")"


# ---- URLs -------------------------------------------------------------------

def url_parts_rel(src: str, url: str, prefix: str = "_u") -> str:
    """Sub-select adding {prefix}_scheme/_netloc/_path/_query/_valid columns."""
    p = prefix
    r1 = (f"SELECT *, {rr(rr(url, U.LEADING_C0_RE, ''), U.UNSAFE_RE, '')} AS {p}_t FROM ({src}) {p}0")
    r2 = (f"SELECT *, lower({rx(f'{p}_t', '(' + U.SCHEME_RE[:-1] + '):')}) AS {p}_scheme, "
          f"{re1(f'{p}_t', U.SCHEME_RE)} AS {p}_rest FROM ({r1}) {p}1")
    has_nl = f"starts_with({p}_rest, '//')"
    after = f"CASE WHEN {has_nl} THEN {re1(f'{p}_rest', '^//[^/?#]*')} ELSE {p}_rest END"
    r3 = (f"SELECT *, CASE WHEN {has_nl} THEN {rx(f'{p}_rest', '^//([^/?#]*)')} ELSE '' END AS {p}_netloc, "
          f"{rx(after, '^([^#]*)')} AS {p}_pq FROM ({r2}) {p}2")
    host = rx(f"{p}_netloc", r"\[([^\]]*)")
    ok = (f"CASE WHEN starts_with({host}, 'v') THEN regexp_matches({host}, {lit(U.IPVFUTURE_RE)}) "
          f"ELSE regexp_matches({host}, {lit(U.IPV6_RE)}) END")
    r4 = (f"SELECT *, {rx(f'{p}_pq', '^([^?]*)')} AS {p}_path, "
          f"CASE WHEN contains({p}_pq, '?') THEN {re1(f'{p}_pq', '^[^?]*[?]')} ELSE '' END AS {p}_query, "
          f"CASE WHEN contains({p}_netloc, '[') AND contains({p}_netloc, ']') THEN {ok} "
          f"ELSE contains({p}_netloc, '[') = contains({p}_netloc, ']') END AS {p}_valid "
          f"FROM ({r3}) {p}3")
    return r4


def _helpers(p: str) -> str:
    return ", ".join(f"{p}_{c}" for c in ("t", "scheme", "rest", "netloc", "pq", "path", "query", "valid"))


def canonical_rel(src: str, url: str, out: str = "canonical_url") -> str:
    """``src`` plus column ``out`` = canonical form of ``url``."""
    p = "_cu"
    s0 = f"SELECT *, {strip(url)} AS {p}_s FROM ({src}) {p}s"
    parts = url_parts_rel(s0, f"{p}_s", p)
    path = f"coalesce(nullif({rr(f'{p}_path', r'/+\z', '')}, ''), '/')"
    keys = ", ".join(lit(k) for k in TRACKING_KEYS)
    q = (f"array_to_string(list_filter(string_split({p}_query, '&'), "
         f"lambda x: lower(split_part(x, '=', 1)) NOT IN ({keys})), '&')")
    r5 = f"SELECT *, {path} AS {p}_p2, {q} AS {p}_q2 FROM ({parts}) {p}4"
    body = (f"CASE WHEN {p}_netloc <> '' THEN '//' || lower({p}_netloc) || {p}_p2 "
            f"WHEN starts_with({p}_p2, '//') THEN '//' || {p}_p2 "
            f"WHEN {p}_scheme <> '' AND {_in_list(f'{p}_scheme', USES_NETLOC)} AND starts_with({p}_p2, '/') THEN '//' || {p}_p2 "
            f"ELSE {p}_p2 END")
    ws = f"CASE WHEN {p}_scheme <> '' THEN {p}_scheme || ':' || {body} ELSE {body} END"
    full = f"CASE WHEN {p}_q2 <> '' THEN {ws} || '?' || {p}_q2 ELSE {ws} END"
    final = f"CASE WHEN {p}_valid THEN {full} ELSE lower({p}_s) END"
    return (f"SELECT * EXCLUDE ({p}_s, {_helpers(p)}, {p}_p2, {p}_q2), {final} AS {out} FROM ({r5}) {p}5")


def domain_rel(src: str, url: str, out: str = "domain") -> str:
    p = "_dm"
    parts = url_parts_rel(src, url, p)
    return (f"SELECT * EXCLUDE ({_helpers(p)}), CASE WHEN {p}_valid THEN replace(lower({p}_netloc), 'www.', '') "
            f"ELSE {url} END AS {out} FROM ({parts}) {p}x")


def path_rel(src: str, url: str, out: str = "url_path") -> str:
    p = "_pt"
    parts = url_parts_rel(src, url, p)
    return (f"SELECT * EXCLUDE ({_helpers(p)}), CASE WHEN {p}_valid THEN {p}_path ELSE '' END AS {out} "
            f"FROM ({parts}) {p}x")


def pdf_title_expr(path: str, url: str) -> str:
    name = rx(path, r"([^/]*)\z")
    base = f"CASE WHEN contains({name}, '.') THEN {re1(name, r'[.][^.]*\z')} ELSE {name} END"
    return f"CASE WHEN {name} = '' THEN {url} ELSE translate({base}, '_-', '  ') END"


def looks_like_pdf_expr(path: str) -> str:
    return f"(ends_with(lower({path}), '.pdf') OR contains(lower({path}), ';.pdf'))"


# ---- HTML -------------------------------------------------------------------

def extract_expr(html: str, markdown: bool, text_mode: bool = False) -> str:
    body = SH.markdown(html) if markdown and not text_mode else rr(SH.noisy(html), H.MD_NOISE_RE2, "") if text_mode else SH.text(html)
    blank = strip(f"coalesce({html}, '')")
    return f"CASE WHEN {blank} = '' THEN '' ELSE {strip(body)} END"


def extract_text(html: str) -> str:
    return extract_expr(html, markdown=False)


def extract_markdown(html: str) -> str:
    return extract_expr(html, markdown=True)


def markdown_to_text(md: str) -> str:
    return strip(rr(md, H.MD_NOISE_RE2, ""))


def meta_title(html: str) -> str:
    return nullif_empty(collapse_ws(rx(html, H.TITLE_RE)))


def meta_field(html: str, name: str) -> str:
    found = ", ".join(f"nullif({rx(html, p)}, '')" for p in H.META_FIELDS[name])
    return nullif_empty(collapse_ws(f"coalesce({found})"))


def meta_language(html: str) -> str:
    return nullif_empty(strip(rx(html, H.LANG_RE)))


def dom_title(html: str) -> str:
    return strip(unescape(rx(html, H.TITLE_RE)))
