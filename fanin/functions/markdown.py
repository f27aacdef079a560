"""HTML to markdown: links, emphasis, code, lists, quotes, tables and preformatted text.

Inline elements become marks, control characters that no text holds, by regex replaces.  The tags of block structure cut
the text into pieces, which are folded once from left to right with a stack of open lists and quotes; ``scan`` emits one
string per piece.  Marks that pair within a line become markdown at the end, all others go, so that an element that is
never closed leaves no stray sign.

* Lists nest by 2 (bulleted) or 3 (numbered) spaces; numbers begin at ``start``.  Quotes prefix every line with ``> ``.
* A table is written with a rule after its first row; a cell is one line, with ``|`` escaped.  Block structure inside
  a cell is plain text, as is a table inside a table.  Cells and rows may lack their end tags.
* Preformatted text is fenced and keeps its line feeds and blanks; inline elements in it are plain text.
* Lists and quotes nested deeper than ``DEEPEST`` are written at that depth.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fanin.functions.folds import let, only_if, scan
from fanin.functions.regions import CUT, END, TAG_REST, after

DEEPEST = 64
STRUCTURE = ("ul", "ol", "li", "blockquote", "table", "tr", "td", "th", "pre")
STRUCTURE_RE = rf"(?i)<(/?(?:{'|'.join(STRUCTURE)})(?:[ \t\r\n\f/][^>]*)?)>"

#: Marks: a link's URL, text and end; strong, emphasis and code, begin and end; blank, tab and line feed of fixed text.
URL, TEXT, LINK_END, STRONG, STRONG_END, EM, EM_END, CODE, CODE_END, BLANK, TAB, BREAK = (chr(n) for n in (2, 3, 4, 5, 6, 14, 15, 16, 17, 1, 7, 8))
CONTROLS = r"[\x01-\x08\x0e-\x11\x1e\x1f]"

LINK_STEPS = [
    (r"""(?i)<a[ \t\r\n\f/](?:[^<>]*?[ \t\r\n\f"'/])??href[ \t\r\n\f]*=[ \t\r\n\f]*(?:"([^"<>]*)"|'([^'<>]*)'|([^ \t\r\n\f"'<>]+))[^<>]*>""", f"{URL}$1$2$3{TEXT}"),
    (r"(?i)</a[ \t\r\n\f]*>", LINK_END),
]
#: What the tags of inline elements and headings become.
INLINE = {"b": STRONG, "/b": STRONG_END, "strong": STRONG, "/strong": STRONG_END, "i": EM, "/i": EM_END, "em": EM, "/em": EM_END,
          **{slash + tag: CODE_END if slash else CODE for tag in ("code", "kbd", "samp") for slash in ("", "/")},
          "/a": LINK_END, "hr": "\n---\n"}
HEADINGS = {f"h{n}": "\n" + "#" * n + " " for n in range(1, 7)}
#: The marks of a kind, and what pairs of them become.
FINAL_STEPS = [
    (CODE, rf"{CODE}([^{CODE}{CODE_END}\n]+){CODE_END}", "`$1`"),
    (STRONG, rf"{STRONG}([ \t]*)([^{STRONG}{STRONG_END}\n]*[^{STRONG}{STRONG_END}\n \t])([ \t]*){STRONG_END}", "$1**$2**$3"),
    (EM, rf"{EM}([ \t]*)([^{EM}{EM_END}\n]*[^{EM}{EM_END}\n \t])([ \t]*){EM_END}", "$1*$2*$3"),
    (URL, rf"{URL}([^{URL}{TEXT}{LINK_END}\n]+){TEXT}([^{URL}{TEXT}{LINK_END}\n]*[^{URL}{TEXT}{LINK_END}\n \t]){LINK_END}", "[$2]($1)"),
    (URL, rf"{URL}[^{URL}{TEXT}{LINK_END}]*{TEXT}", ""),
]
_PLAIN_RE = rf"{URL}[^{URL}{TEXT}{LINK_END}]*{TEXT}|[\x02-\x06\x0e-\x11]"
_STATE = "struct<stack:array<struct<kind:string,n:int,base:string,inner:string>>,deep:int,pre:int,tables:int,rows:int,cells:int,row:boolean,cell:boolean,text:string>"


def steps(c: Column, pairs) -> Column:
    for pattern, to in pairs:
        c = F.regexp_replace(c, pattern, to)
    return c


def written_as(c: Column, tags: dict[str, str]) -> Column:
    """The text with each tag of ``tags`` as its string; tags of the same names without one go."""
    names = "|".join(sorted({t.lstrip("/") for t in tags}))
    marked = F.regexp_replace(c, rf"(?i)<(/?(?:{names})){TAG_REST}", f"{CUT}$1{END}")
    as_text = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])

    def piece(p, i):
        text = F.try_element_at(as_text, F.lower(F.substring_index(p, END, 1)))
        return F.when(i == 0, p).otherwise(F.concat(F.coalesce(text, F.lit("")), after(p)))

    return only_if(marked, lambda x: x.contains(CUT), lambda x: F.array_join(F.transform(F.split(x, CUT), piece), ""))


def _one_line(text: Column) -> Column:
    return F.replace(F.btrim(F.regexp_replace(text, r"[ \t\r\n\f]+", " ")), F.lit("|"), F.lit("\\|"))


def _lines(text: Column, prefix: Column) -> Column:
    """The text's lines, all but the first after ``prefix``."""
    tidy = F.regexp_replace(F.btrim(text, F.lit(" \t\r\n\f")), r"(?<![ \t\r\n\f])[ \t\r\f]*\n[ \t\r\n\f]*", "\n")
    return F.replace(tidy, F.lit("\n"), F.concat(F.lit("\n"), prefix))


def _fixed(text: Column, prefix: Column) -> Column:
    plain = F.translate(F.regexp_replace(F.regexp_replace(text, _PLAIN_RE, ""), r"\r\n?", "\n"), " \t", BLANK + TAB)
    return F.replace(plain, F.lit("\n"), F.concat(F.lit(BREAK), prefix))


def _entry(kind: str, n: Column, base: Column, more: str) -> Column:
    """An open list or quote: its kind, next number, what begins its items' lines and what begins the lines within."""
    return F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("n"), base.alias("base"), F.concat(base, F.lit(more)).alias("inner"))


START_RE = r"""(?i)[ \t\r\n\f/]start[ \t\r\n\f]*=[ \t\r\n\f]*["']?(-?[0-9]{1,9})(?:["' \t\r\n\f/]|$)"""


def _stacked(s: Column, piece: Column, prefix: Column, top: Column) -> tuple[Column, Column]:
    """The stack after a piece's tag, and how many lists and quotes are open beyond the deepest level."""
    tag, stack, deep = piece["tag"], s["stack"], s["deep"]
    kinds = F.array_join(F.transform(stack, lambda e: e["kind"]), "")
    opens, closes = tag.isin("ul", "ol", "blockquote"), tag.isin("/ul", "/ol", "/blockquote")
    start = F.coalesce(F.regexp_extract(piece["head"], START_RE, 1).try_cast("int"), F.lit(1))
    entry = (F.when(tag == "ul", _entry("u", F.lit(0), prefix, BLANK * 2)).when(tag == "ol", _entry("o", start, prefix, BLANK * 3))
             .otherwise(_entry("q", F.lit(0), prefix, "> ")))
    # an end tag closes the innermost element of its kind and what is open in it
    left = F.when(tag == "/blockquote", F.length(F.regexp_extract(kinds, "^(.*)q[uo]*$", 1))).otherwise(F.length(F.regexp_extract(kinds, "^(.*)[uo]q*$", 1)))
    known = F.when(tag == "/blockquote", kinds.contains("q")).otherwise(kinds.rlike("[uo]"))
    counted = F.struct(top["kind"].alias("kind"), (top["n"] + 1).cast("int").alias("n"), top["base"].alias("base"), top["inner"].alias("inner"))
    frozen = (s["tables"] > 0) | (s["pre"] > 0)
    full = F.size(stack) >= DEEPEST
    after_tag = (F.when(frozen, stack).when(opens, F.when(full, stack).otherwise(F.concat(stack, F.array(entry))))
                 .when(closes, F.when((deep > 0) | ~known, stack).otherwise(F.slice(stack, 1, left)))
                 .when((tag == "li") & F.coalesce(top["kind"] == "o", F.lit(False)), F.concat(F.slice(stack, 1, F.size(stack) - 1), F.array(counted)))
                 .otherwise(stack))
    return after_tag, F.when(frozen, deep).when(opens & full, deep + 1).when(closes & (deep > 0), deep - 1).otherwise(deep)


def _step(s: Column, piece: Column) -> Column:
    """The state after a piece: the stack of open lists and quotes, what is open besides, and the piece's text."""
    top = F.try_element_at(s["stack"], F.lit(-1))
    prefix = F.coalesce(top["inner"], F.lit(""))
    stack, deep = _stacked(s, piece, prefix, top)
    inner = let(stack, lambda x: F.struct(x.alias("stack"), F.coalesce(F.try_element_at(x, F.lit(-1))["inner"], F.lit("")).alias("inner")))
    found = F.struct(top.alias("top"), prefix.alias("prefix"), inner.alias("now"), _one_line(piece["text"]).alias("line"), F.btrim(piece["text"], F.lit(" \t\r\n\f")).alias("bare"))
    return let(found, lambda v: _written(s, piece, v, deep))


def _written(s: Column, piece: Column, v: Column, deep: Column) -> Column:
    tag, text = piece["tag"], piece["text"]
    top, prefix, line, bare, stack, inner = v["top"], v["prefix"], v["line"], v["bare"], v["now"]["stack"], v["now"]["inner"]
    in_table, in_pre, outer = s["tables"] > 0, s["pre"] > 0, s["tables"] == 1
    row_ends, cell_opens = ~in_pre & outer & tag.isin("tr", "/tr", "/table"), ~in_pre & outer & tag.isin("td", "th")
    cell_ends, begins = ~in_pre & outer & tag.isin("/td", "/th"), ~in_pre & (tag == "table") & ~in_table
    tables = F.when(in_pre, s["tables"]).when(tag == "table", s["tables"] + 1).when((tag == "/table") & in_table, s["tables"] - 1).otherwise(s["tables"])
    rows = F.when(begins, 0).when(row_ends & s["row"], s["rows"] + 1).otherwise(s["rows"])
    cells = F.when(begins | row_ends, 0).when(cell_opens, s["cells"] + 1).otherwise(s["cells"])
    row = F.when(begins | row_ends, False).when(cell_opens, True).otherwise(s["row"])
    cell = F.when(begins | row_ends | cell_ends, False).when(cell_opens, True).otherwise(s["cell"])
    pre = F.when(in_table, s["pre"]).when(tag == "pre", s["pre"] + 1).when((tag == "/pre") & in_pre, s["pre"] - 1).otherwise(s["pre"])

    nl, nested = F.lit("\n"), F.size(stack) > 0
    body = F.when(bare == "", "").otherwise(F.concat(nl, inner, _lines(text, inner)))
    plain = F.when(nested, body).otherwise(text)
    end_cell = F.when(s["cell"], " |").otherwise("")
    rule = F.when(s["row"] & (s["rows"] == 0), F.concat(nl, prefix, F.lit("|"), F.repeat(F.lit(" --- |"), s["cells"]))).otherwise("")
    between = F.when(line == "", "").otherwise(F.concat(nl, prefix, line))
    in_rows = (F.when(cell_opens, F.concat(end_cell, F.when(s["row"], "").otherwise(F.concat(nl, prefix, F.lit("|"))), F.lit(" "), line))
               .when(cell_ends, F.concat(end_cell, F.when(line == "", "").otherwise(F.concat(F.lit(" "), line))))
               .when(row_ends, F.concat(end_cell, rule, F.when(tag == "/table", F.concat(F.when(nested, "").otherwise(nl), plain)).otherwise(between)))
               .when(line == "", "").otherwise(F.concat(F.lit(" "), line)))
    listed = F.coalesce(top["kind"] != "q", F.lit(False))
    marker = F.when(listed & (top["kind"] == "o"), F.concat(top["n"].cast("string"), F.lit(". "))).otherwise("- ")
    out = (F.when(in_pre & (tag == "/pre"), F.concat(nl, prefix, F.lit("```\n"), plain))
           .when(in_pre, _fixed(text, prefix))
           .when(in_table, in_rows)
           .when(tag == "pre", F.concat(nl, prefix, F.lit("```\n"), prefix, _fixed(F.regexp_replace(F.regexp_replace(text, _PLAIN_RE, ""), r"^\r?\n|\r?\n\z", ""), prefix)))
           .when(tag == "table", body)
           .when(tag == "li", F.concat(nl, F.when(listed, top["base"]).otherwise(prefix), marker, _lines(text, inner)))
           .when(tag.isin("/ul", "/ol", "/blockquote"), F.concat(F.when(nested, "").otherwise(nl), plain))
           .when(tag.isin("tr", "/tr"), F.concat(nl, plain)).when(tag.isin("/td", "/th"), F.concat(F.lit(" "), plain))
           .otherwise(plain))
    return F.struct(stack.alias("stack"), deep.cast("int").alias("deep"), pre.cast("int").alias("pre"), tables.cast("int").alias("tables"), rows.cast("int").alias("rows"),
                    cells.cast("int").alias("cells"), row.alias("row"), cell.alias("cell"), out.alias("text"))


def mark_structure(c: Column) -> Column:
    """The tags of block structure, cut out of the text; other tags can then be removed."""
    return F.regexp_replace(c, STRUCTURE_RE, f"{CUT}$1{END}")


def fold_structure(c: Column) -> Column:
    """The marked text with its lists, quotes, tables and preformatted parts as markdown."""
    def parsed(p, i):
        head = F.when(i == 0, "").otherwise(F.substring_index(p, END, 1))
        return F.struct(F.lower(F.regexp_extract(head, "^/?[a-zA-Z]+", 0)).alias("tag"), head.alias("head"), F.when(i == 0, p).otherwise(after(p)).alias("text"))

    zero = F.expr("named_struct('stack', array(), 'deep', 0, 'pre', 0, 'tables', 0, 'rows', 0, 'cells', 0, 'row', false, 'cell', false, 'text', '')").cast(_STATE)
    folded = lambda x: let(F.transform(F.split(x, CUT), parsed), lambda parts: F.array_join(scan(parts, zero, _step, lambda s: s["text"], "string"), ""))
    return only_if(c, lambda x: x.contains(CUT), folded)


def finish(c: Column) -> Column:
    """Marks that pair within a line as markdown; all others go."""
    for mark, pattern, to in FINAL_STEPS:
        c = only_if(c, lambda x, m=mark: x.contains(m), lambda x, p=pattern, t=to: F.regexp_replace(x, p, t))
    return F.translate(c, STRONG + STRONG_END + EM + EM_END + CODE + CODE_END + LINK_END, "")


def unfix(c: Column) -> Column:
    """Blanks, tabs and line feeds of fixed text as themselves."""
    return only_if(c, lambda x: x.rlike(r"[\x01\x07\x08]"), lambda x: F.translate(x, BLANK + TAB + BREAK, " \t\n"))
