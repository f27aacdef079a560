"""HTML -> readable text, markdown and metadata as Column expressions.

Comments, scripts and styles go first, then boilerplate regions by the balance of their tags (``regions``); what is
left is a chain of regex replaces without nested quantifiers and, for markdown, one fold over the tags of block
structure (``markdown``).  The steps are linear on Java's backtracking engine.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from fanin.functions import markdown as M
from fanin.functions.folds import only_if
from fanin.functions.regions import drop_regions
from fanin.functions.text import WS_CLASS, col_, collapse_ws, nullif_empty, pystrip, unescape_entities
from fanin.params import BLOCK_TAGS, MD_MARKS_RE, TITLE_RE

SP = r"[ \t\r\n\f]"           # HTML white space
ATTRS = rf"(?:{SP}[^>]*|/[^>]*)?"
#: Control characters, comments and elements of raw text.  Without an end, the rest of the text is taken in one match and
#: put back, so that it is not searched again from every later opener.
RAW_STEP = (rf"(?is){M.CONTROLS}|(?=<)(?:<!--.*?-->|<script{ATTRS}>.*?</script{SP}*>|<style{ATTRS}>.*?</style{SP}*>"
            rf"|(<!--.*+|<(?:script|style){ATTRS}>.*+)|(<(?:script|style)(?:{SP}|/)[^>]*+\z))", "$1$2")
TAG_STEP = (r"<[^>]*>|(<[^>]*+)", "$1")


#: What tags become in a text; in one whose marks at line starts are dropped again; and in markdown before its fold.
TEXT_TAGS = {"br": "\n", "/td": " ", "/th": " ", **{"/" + t: "\n" for t in BLOCK_TAGS}}
NOISY_TAGS = {**TEXT_TAGS, **M.HEADINGS, "li": "\n- "}
MARKDOWN_TAGS = {"br": "\n", **M.HEADINGS, **M.INLINE, **{"/" + t: "\n" for t in BLOCK_TAGS if t not in M.STRUCTURE}}
# Markdown marks at line starts, dropped in text mode (may eat the newline).
MD_NOISE_RE2 = MD_MARKS_RE + WS_CLASS + "*"
MD_NOISE_JAVA = "(?d)" + MD_NOISE_RE2


def tidy(c: Column) -> Column:
    """Blanks at the ends of lines go, and runs of line feeds become two."""
    trimmed = F.array_join(F.transform(F.split(c, "\n"), lambda line: F.btrim(line, F.lit(" \t"))), "\n")
    return only_if(trimmed, lambda x: x.contains("\n\n\n"), lambda x: F.regexp_replace(x, r"(?<!\n)\n{3,}", "\n\n"))


@lru_cache(maxsize=64)
def _built(jvm: int, html: str, markdown: bool, text_mode: bool) -> Column:
    return _extraction(F.col(html), markdown, text_mode)


def _extract(html: Column | str, markdown: bool, text_mode: bool) -> Column:
    """The expression is large; of a named column it is built once per JVM."""
    if isinstance(html, str):
        return _built(id(SparkContext._gateway), html, markdown, text_mode)
    return _extraction(html, markdown, text_mode)


def _extraction(h: Column, markdown: bool, text_mode: bool) -> Column:
    body = drop_regions(M.steps(h, [RAW_STEP]))
    if markdown and not text_mode:
        body = M.mark_structure(M.written_as(M.steps(body, M.LINK_STEPS), MARKDOWN_TAGS))
        body = M.finish(M.fold_structure(M.steps(body, [TAG_STEP])))
    else:
        body = M.steps(M.written_as(body, NOISY_TAGS if text_mode else TEXT_TAGS), [TAG_STEP])
    body = tidy(unescape_entities(body))
    if text_mode:
        body = F.regexp_replace(body, MD_NOISE_JAVA, "")
    elif markdown:
        body = M.unfix(body)
    return F.when(pystrip(F.coalesce(h, F.lit(""))) == "", F.lit("")).otherwise(pystrip(body))


def extract_text(html: Column | str) -> Column:
    """Readable text: boilerplate regions gone, block ends as newlines, entities decoded."""
    return _extract(html, markdown=False, text_mode=False)


def extract_markdown(html: Column | str) -> Column:
    """As ``extract_text`` with ATX headings, links, emphasis, code, nested lists, quotes, tables and fenced text."""
    return _extract(html, markdown=True, text_mode=False)


def extract_content(html: Column | str, fmt: str = "markdown") -> Column:
    """Markdown, or its text without marks at line starts."""
    return _extract(html, markdown=True, text_mode=(fmt == "text"))


def markdown_to_text(md: Column | str) -> Column:
    return pystrip(F.regexp_replace(col_(md), MD_NOISE_JAVA, ""))


# ---- metadata ---------------------------------------------------------------

def _meta_re(attr: str, value: str) -> tuple[str, ...]:
    """One pattern per attribute order and kind of quote; a value ends at its own quote only."""
    q = "[\"']"
    tag = rf"(?is)<meta[^>]*"
    name = rf"{attr}={q}{value}{q}"
    contents = ('content="([^"]*)"', "content='([^']*)'")
    return tuple(rf"{tag}{name}[^>]*{c}" for c in contents) + tuple(rf"{tag}{c}[^>]*{name}" for c in contents)


META_FIELDS = {
    "author": _meta_re("name", "author"),
    "description": _meta_re("name", "description"),
    "sitename": _meta_re("property", "og:site_name"),
}
LANG_RE = rf"(?is)<html{SP}[^>]*lang=[\"']([^\"']*)[\"']"


def _java_extract(pat: str, opener: str, closed_region: bool) -> str:
    """Find-first form that stays linear on Java's engine.

    An opener with no ``>`` before the end can never match, nor can any later
    one: one match takes the rest of the text with an empty group 1, which
    ``regexp_extract`` returns as '' -- the same as no match.  For a region
    pattern (``<title ...>...</title>``) the same holds for an opener whose
    closer is missing.  Tag patterns that can fail on their attributes get
    only the first alternative.
    """
    alts = [pat]
    if closed_region:
        alts.append(rf"(?is){opener}[^>]*>.*+")
    alts.append(rf"(?is){opener}[^>]*+\z")
    return "|".join(alts)


def _find(c: Column, pat: str) -> Column:
    return F.regexp_extract(c, JAVA_EXTRACT.get(pat, pat), 1)


def meta_title(html: Column | str) -> Column:
    """``<title>`` text, white space collapsed; NULL when empty."""
    return nullif_empty(collapse_ws(_find(col_(html), TITLE_RE)))


def page_metadata(html: Column | str) -> Column:
    """STRUCT(title, author, description, sitename, language); empty values are NULL."""
    h = col_(html)
    fields = {"title": meta_title(h)}
    for name, patterns in META_FIELDS.items():
        fields[name] = nullif_empty(collapse_ws(F.coalesce(*[nullif_empty(_find(h, p)) for p in patterns])))
    fields["language"] = nullif_empty(pystrip(_find(h, LANG_RE)))
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def dom_title(html: Column | str) -> Column:
    """Title as a page parser reports it: the ``<title>`` text, entities decoded, stripped."""
    return pystrip(unescape_entities(_find(col_(html), TITLE_RE)))


JAVA_EXTRACT = {TITLE_RE: _java_extract(TITLE_RE, "<title", True), LANG_RE: _java_extract(LANG_RE, rf"<html{SP}", False)}
for _patterns in META_FIELDS.values():
    for _p in _patterns:
        JAVA_EXTRACT[_p] = _java_extract(_p, "<meta", False)
