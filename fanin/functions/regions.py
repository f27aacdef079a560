"""Removal of nested boilerplate regions by the balance of their tags.

The text is cut before every region tag.  Going forward, each piece gets per tag name its depth, the number of openers
not yet closed (a closer at depth 0 counts nothing).  The least depth from a piece to the end is the number of openers
before it that are never closed, so a piece lies inside a closed region of that name just if its depth exceeds it.  Such
pieces go, with all that is nested in them; an opener without a closer loses its tag only.  Every piece is read twice,
whatever the nesting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fanin.functions.folds import let, only_if, scan
from fanin.params import STRIPPED_TAGS

REGION_TAGS = ("head",) + tuple(t for t in STRIPPED_TAGS if t not in ("script", "style"))
TAG_REST = r"(?:[ \t\r\n\f/][^>]*)?>"
REGION_TAG_RE = rf"(?i)<(/?(?:{'|'.join(REGION_TAGS)})){TAG_REST}"
CUT, END = "\x1e", "\x1f"           # before a tag's name and after it; control characters are no text


def _inside(codes: Column) -> Column:
    """Per piece, whether it lies inside a closed region.  A code is twice a name's place plus 1 for an opener, 2 for a closer."""
    def forward(depths, code):
        return F.transform(depths, lambda d, k: F.when(code == 2 * k + 1, d + 1).when(code == 2 * k + 2, F.greatest(d - 1, F.lit(0))).otherwise(d))

    def back(s, depths):
        least = F.zip_with(s["least"], depths, lambda m, d: F.least(m, d))
        return let(least, lambda m: F.struct(m.alias("least"), F.exists(F.zip_with(depths, m, lambda d, x: d > x), lambda x: x).alias("inside")))

    flat = lambda v: F.array_repeat(F.lit(v), len(REGION_TAGS))
    depths = F.reverse(scan(codes, flat(0), forward, lambda d: d, "array<int>"))
    return F.reverse(scan(depths, F.struct(flat(1 << 30).alias("least"), F.lit(False).alias("inside")), back, lambda s: s["inside"], "boolean"))


def drop_regions(html: Column) -> Column:
    """``html`` without what lies inside closed regions; the tags themselves go too."""
    names = F.array(*[F.lit(t) for tag in REGION_TAGS for t in (tag, "/" + tag)])

    def kept(parts):
        codes = F.transform(parts, lambda p, i: F.when(i == 0, 0).otherwise(F.array_position(names, F.lower(F.substring_index(p, END, 1)))).cast("int"))
        text = lambda flags: F.transform(parts, lambda p, i: F.when(F.get(flags, i), "").when(i == 0, p).otherwise(after(p)))
        return F.array_join(let(_inside(codes), text), "")

    marked = F.regexp_replace(html, REGION_TAG_RE, f"{CUT}$1{END}")
    return only_if(marked, lambda x: x.contains(CUT), lambda x: let(F.split(x, CUT), kept))


def after(piece: Column) -> Column:
    """What follows the tag that begins a piece."""
    return F.substr(piece, F.instr(piece, END) + 1)
