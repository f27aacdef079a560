"""String helpers as Column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fanin.functions.folds import let, only_if
from fanin.params import ENTITIES, PY_WHITESPACE

#: A reference after its ``&``: a name, or a decimal or hexadecimal number.
REFERENCE_RE = r"^(?:([A-Za-z]+)|#0*([0-9]{1,7})|#[xX]0*([0-9a-fA-F]{1,6}));"

# Regex character class of Python's whitespace set, written with \x{..} escapes
# that Java regex and RE2 read alike.
WS_CLASS = "[" + "".join(
    (lambda c: f"\\x{{{ord(c):x}}}" if not ("a" <= c <= "z") else c)(ch) for ch in PY_WHITESPACE
) + "]"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c: Column | str) -> Column:
    """Python ``str.strip()``: removes the full Unicode whitespace set at both ends."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def pystrip_null_safe(c: Column | str) -> Column:
    """``(x or "").strip()``."""
    return pystrip(F.coalesce(col_(c), F.lit("")))


def collapse_ws(c: Column | str) -> Column:
    """``re.sub(r"\\s+", " ", x).strip()`` with Python's whitespace set."""
    return pystrip(F.regexp_replace(col_(c), WS_CLASS + "+", " "))


def unescape_entities(c: Column | str) -> Column:
    """Named (``ENTITIES``) and numeric references as their characters; any other ``&`` stays.

    The text is cut at ``&`` and each reference is looked up once, so what it stands for is never read as a reference
    again.  A text without ``&`` is left alone."""
    names = F.create_map(*[F.lit(x) for ent, ch in (*ENTITIES, ("&amp;", "&")) for x in (ent[1:-1], ch)])

    def char(x: Column) -> Column:
        name, dec, hexa = (F.regexp_extract(x, REFERENCE_RE, k) for k in (1, 2, 3))
        code = F.when(dec != "", dec.cast("int")).when(hexa != "", F.conv(hexa, 16, 10).cast("int"))
        number = let(code, lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        return let(name, lambda n: F.when(n != "", F.try_element_at(names, n)).otherwise(number))

    def part(x: Column, i: Column) -> Column:
        known = let(char(x), lambda ch: F.when(ch.isNull(), F.concat(F.lit("&"), x)).otherwise(F.concat(ch, F.substr(x, F.instr(x, ";") + 1))))
        return F.when(i == 0, x).otherwise(known)

    return only_if(col_(c), lambda x: x.contains("&"), lambda x: F.array_join(F.transform(F.split(x, "&"), part), ""))


def nullif_empty(c: Column | str) -> Column:
    return F.nullif(col_(c), F.lit(""))
