"""DuckDB SQL of the extraction rules, for the oracles: its own patterns, windows for nested regions, one reduce for markdown.

Written from the rules, not from the Spark expressions: only the tables of fixed values (entities, tag names) are shared.
"""

from __future__ import annotations

from fanin.params import BLOCK_TAGS, ENTITIES, STRIPPED_TAGS

WS = r"[ \t\r\n\f]"
REST = r"(?:[ \t\r\n\f/][^>]*)?>"
CTRL = r"[\x01-\x08\x0e-\x11\x1e\x1f]"


def q(s: str) -> str:
    """A string literal; control characters go through chr()."""
    out, buf = [], ""
    for ch in s:
        if ord(ch) < 32:
            out += ["'" + buf.replace("'", "''") + "'"] * bool(buf) + [f"chr({ord(ch)})"]
            buf = ""
        else:
            buf += ch
    out += ["'" + buf.replace("'", "''") + "'"] * (bool(buf) or not out)
    return "(" + " || ".join(out) + ")" if len(out) > 1 else out[0]


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def let(value: str, name: str, use: str) -> str:
    return f"list_transform([{value}], lambda {name}: {use})[1]"


def without_raw(x: str) -> str:
    """Comments, scripts, styles and control characters go; an unclosed one leaves the rest as it is."""
    attrs = rf"(?:{WS}[^>]*|/[^>]*)?"
    whole = "|".join(rf"<{t}{attrs}>.*?</{t}{WS}*>" for t in ("script", "style"))
    return sub(x, rf"(?is){CTRL}|<!--.*?-->|{whole}|(<!--.*|<(?:script|style){attrs}>.*|<(?:script|style)(?:{WS}|/)[^>]*\z)", r"\1")


def without_regions(x: str) -> str:
    """Depths by running sums: a piece goes if, for a name, its depth exceeds the least depth from it to the end."""
    names = ["head", *[t for t in STRIPPED_TAGS if t not in ("script", "style")]]
    cut = sub(x, rf"(?i)<(/?(?:{'|'.join(names)})){REST}", chr(30) + r"\1" + chr(31))
    step = ", ".join(f"sum(CASE WHEN i = 1 THEN 0 WHEN t = '{n}' THEN 1 WHEN t = '/{n}' THEN -1 ELSE 0 END) OVER (ORDER BY i) AS s{k}" for k, n in enumerate(names))
    depth = ", ".join(f"s{k} - least(0, min(s{k}) OVER (ORDER BY i)) AS d{k}" for k in range(len(names)))
    inside = " OR ".join(f"d{k} > min(d{k}) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)" for k in range(len(names)))
    return f"""(SELECT coalesce(string_agg(CASE WHEN i = 1 THEN p ELSE substr(p, strpos(p, chr(31)) + 1) END, '' ORDER BY i) FILTER (WHERE NOT gone), '')
  FROM (SELECT i, p, ({inside}) AS gone FROM (SELECT i, p, {depth} FROM (SELECT i, p, {step}
  FROM (SELECT i, p, lower(split_part(p, chr(31), 1)) AS t FROM (SELECT unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT string_split({cut}, chr(30)) AS l) l0) l1) l2) l3) l4) l5)"""


def tags_as(x: str, tags: dict[str, str]) -> str:
    names = "|".join(sorted({t.lstrip("/") for t in tags}, key=lambda t: (-len(t), t)))
    cut = sub(x, rf"(?i)<(/?(?:{names})){REST}", chr(30) + r"\1" + chr(31))
    by_text: dict[str, list[str]] = {}
    for t, text in tags.items():
        by_text.setdefault(text, []).append(t)
    case = " ".join(f"WHEN lower(split_part(p_, chr(31), 1)) IN ({', '.join(q(t) for t in ts)}) THEN {q(text)}" for text, ts in by_text.items())
    return f"array_to_string(list_transform(string_split({cut}, chr(30)), lambda p_, i_: CASE WHEN i_ = 1 THEN p_ ELSE (CASE {case} ELSE '' END) || substr(p_, strpos(p_, chr(31)) + 1) END), '')"


def unescape(x: str) -> str:
    named = " ".join(f"WHEN {q(e[1:-1])} THEN {q(ch)}" for e, ch in (*ENTITIES, ("&amp;", "&")))
    dec, hexa = "TRY_CAST(nullif(regexp_extract(p_, '^#0*([0-9]{1,7});', 1), '') AS INTEGER)", "TRY_CAST('0x' || nullif(regexp_extract(p_, '^#[xX]0*([0-9a-fA-F]{1,6});', 1), '') AS INTEGER)"
    number = f"coalesce({dec}, {hexa})"
    char = f"coalesce(CASE regexp_extract(p_, '^([A-Za-z]+);', 1) {named} END, CASE WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr({number}) END)"
    return (f"array_to_string(list_transform(string_split({x}, '&'), lambda p_, i_: CASE WHEN i_ = 1 THEN p_ WHEN {char} IS NULL THEN '&' || p_ "
            f"ELSE {char} || substr(p_, strpos(p_, ';') + 1) END), '')")


def tidy(x: str) -> str:
    lines = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda y_: trim(y_, ' ' || chr(9))), chr(10))"
    return sub(lines, r"\n{3,}", "\n\n")


ENDS = {"/" + t: "\n" for t in BLOCK_TAGS}
HEADINGS = {f"h{n}": "\n" + "#" * n + " " for n in range(1, 7)}
STRUCTURE = ("ul", "ol", "li", "blockquote", "table", "tr", "td", "th", "pre")
MARKS = {"b": 5, "/b": 6, "strong": 5, "/strong": 6, "i": 14, "/i": 15, "em": 14, "/em": 15, "code": 16, "/code": 17, "kbd": 16, "/kbd": 17, "samp": 16, "/samp": 17, "/a": 4}


def text(html: str) -> str:
    return tidy(unescape(sub(tags_as(without_regions(without_raw(html)), {"br": "\n", **ENDS, "/td": " ", "/th": " "}), "<[^>]*>", "")))


def noisy(html: str) -> str:
    tags = {"br": "\n", **ENDS, "/td": " ", "/th": " ", "li": "\n- ", **HEADINGS}
    return tidy(unescape(sub(tags_as(without_regions(without_raw(html)), tags), "<[^>]*>", "")))


def _fold(x: str) -> str:
    """Pieces that begin with a tag of structure, reduced from the left; a piece and the state have one struct type."""
    bq = lambda *tags: "x_.tag IN (" + ", ".join(f"'{t}'" for t in tags) + ")"
    nl = "chr(10)"
    line = "replace(trim(regexp_replace(x_.txt, '[ \\t\\r\\n\\f]+', ' ', 'g')), '|', '\\|')"
    bare = "trim(x_.txt, ' ' || chr(9) || chr(10) || chr(12) || chr(13))"
    no_marks = lambda t: f"regexp_replace({t}, {q(chr(2) + '[^' + chr(2) + chr(3) + chr(4) + ']*' + chr(3) + '|[' + chr(2) + '-' + chr(6) + chr(14) + '-' + chr(17) + ']')}, '', 'g')"
    lines = lambda prefix: f"replace(regexp_replace(v_.bare, '[ \\t\\r\\f]*\\n[ \\t\\r\\n\\f]*', chr(10), 'g'), chr(10), chr(10) || {prefix})"
    fixed = lambda t: f"replace(translate(regexp_replace({no_marks(t)}, '\\r\\n?', chr(10), 'g'), ' ' || chr(9), chr(1) || chr(7)), chr(10), chr(8) || v_.prefix)"
    first = "regexp_replace(regexp_replace({0}, '^\\r?\\n', ''), '\\r?\\n\\z', '')".format(no_marks("x_.txt"))
    frozen, opens, closes = "(a_.tables > 0 OR a_.pre > 0)", bq("ul", "ol", "blockquote"), bq("/ul", "/ol", "/blockquote")
    entry = ("{'kind': CASE x_.tag WHEN 'ul' THEN 'u' WHEN 'ol' THEN 'o' ELSE 'q' END, 'n': CASE WHEN x_.tag = 'ol' THEN coalesce(TRY_CAST(regexp_extract(x_.head, "
             + q("(?i)[ \\t\\r\\n\\f/]start[ \\t\\r\\n\\f]*=[ \\t\\r\\n\\f]*[\"']?(-?[0-9]{1,9})(?:[\"' \\t\\r\\n\\f/]|$)") + ", 1) AS INTEGER), 1) ELSE 0 END, 'base': v_.prefix, "
             "'inner': v_.prefix || CASE x_.tag WHEN 'ul' THEN repeat(chr(1), 2) WHEN 'ol' THEN repeat(chr(1), 3) ELSE '> ' END}")
    kinds = "array_to_string(list_transform(a_.stack, lambda e_: e_.kind), '')"
    left = f"CASE WHEN x_.tag = '/blockquote' THEN length(regexp_extract({kinds}, '^(.*)q[uo]*$', 1)) ELSE length(regexp_extract({kinds}, '^(.*)[uo]q*$', 1)) END"
    known = f"CASE WHEN x_.tag = '/blockquote' THEN contains({kinds}, 'q') ELSE regexp_matches({kinds}, '[uo]') END"
    counted = "list_concat(a_.stack[1:len(a_.stack) - 1], [{'kind': v_.top.kind, 'n': v_.top.n + 1, 'base': v_.top.base, 'inner': v_.top.inner}])"
    stack = f"""CASE WHEN {frozen} THEN a_.stack WHEN {opens} THEN CASE WHEN len(a_.stack) >= 64 THEN a_.stack ELSE list_append(a_.stack, {entry}) END
  WHEN {closes} THEN CASE WHEN a_.deep > 0 OR NOT {known} THEN a_.stack ELSE a_.stack[1:{left}] END
  WHEN x_.tag = 'li' AND coalesce(v_.top.kind = 'o', false) THEN {counted} ELSE a_.stack END"""
    deep = f"CASE WHEN {frozen} THEN a_.deep WHEN {opens} AND len(a_.stack) >= 64 THEN a_.deep + 1 WHEN {closes} AND a_.deep > 0 THEN a_.deep - 1 ELSE a_.deep END"
    outer = "a_.pre = 0 AND a_.tables = 1"
    row_ends, cell_opens, cell_ends = f"({outer} AND {bq('tr', '/tr', '/table')})", f"({outer} AND {bq('td', 'th')})", f"({outer} AND {bq('/td', '/th')})"
    begins = "(a_.pre = 0 AND x_.tag = 'table' AND a_.tables = 0)"
    body = f"CASE WHEN v_.bare = '' THEN '' ELSE {nl} || w_.inner || {lines('w_.inner')} END"
    plain = f"CASE WHEN len(w_.stack) > 0 THEN {body} ELSE x_.txt END"
    after = f"CASE WHEN len(w_.stack) > 0 THEN '' ELSE {nl} END || {plain}"
    end_cell = "CASE WHEN a_.cell THEN ' |' ELSE '' END"
    rule = f"CASE WHEN a_.row AND a_.rows = 0 THEN {nl} || v_.prefix || '|' || repeat(' --- |', a_.cells) ELSE '' END"
    rows = f"""CASE WHEN {cell_opens} THEN {end_cell} || CASE WHEN a_.row THEN '' ELSE {nl} || v_.prefix || '|' END || ' ' || v_.line
  WHEN {cell_ends} THEN {end_cell} || CASE WHEN v_.line = '' THEN '' ELSE ' ' || v_.line END
  WHEN {row_ends} THEN {end_cell} || {rule} || CASE WHEN x_.tag = '/table' THEN {after} WHEN v_.line = '' THEN '' ELSE {nl} || v_.prefix || v_.line END
  WHEN v_.line = '' THEN '' ELSE ' ' || v_.line END"""
    listed = "coalesce(v_.top.kind <> 'q', false)"
    out = f"""CASE WHEN a_.pre > 0 AND x_.tag = '/pre' THEN {nl} || v_.prefix || '```' || {nl} || {plain}
  WHEN a_.pre > 0 THEN {fixed('x_.txt')} WHEN a_.tables > 0 THEN {rows}
  WHEN x_.tag = 'pre' THEN {nl} || v_.prefix || '```' || {nl} || v_.prefix || {fixed(first)}
  WHEN x_.tag = 'table' THEN {body}
  WHEN x_.tag = 'li' THEN {nl} || CASE WHEN {listed} THEN v_.top.base ELSE v_.prefix END || CASE WHEN {listed} AND v_.top.kind = 'o' THEN v_.top.n || '. ' ELSE '- ' END || {lines('w_.inner')}
  WHEN {closes} THEN {after} WHEN {bq('tr', '/tr')} THEN {nl} || {plain} WHEN {bq('/td', '/th')} THEN ' ' || {plain} ELSE {plain} END"""
    state = f"""{{'tag': '', 'head': '', 'txt': a_.txt || {out}, 'stack': w_.stack, 'deep': {deep},
  'pre': CASE WHEN a_.tables > 0 THEN a_.pre WHEN x_.tag = 'pre' THEN a_.pre + 1 WHEN x_.tag = '/pre' AND a_.pre > 0 THEN a_.pre - 1 ELSE a_.pre END,
  'tables': CASE WHEN a_.pre > 0 THEN a_.tables WHEN x_.tag = 'table' THEN a_.tables + 1 WHEN x_.tag = '/table' AND a_.tables > 0 THEN a_.tables - 1 ELSE a_.tables END,
  'rows': CASE WHEN {begins} THEN 0 WHEN {row_ends} AND a_.row THEN a_.rows + 1 ELSE a_.rows END,
  'cells': CASE WHEN {begins} OR {row_ends} THEN 0 WHEN {cell_opens} THEN a_.cells + 1 ELSE a_.cells END,
  'row': CASE WHEN {begins} OR {row_ends} THEN false WHEN {cell_opens} THEN true ELSE a_.row END,
  'cell': CASE WHEN {begins} OR {row_ends} OR {cell_ends} THEN false WHEN {cell_opens} THEN true ELSE a_.cell END}}"""
    found = f"{{'top': a_.stack[-1], 'prefix': coalesce(a_.stack[-1].inner, ''), 'line': {line}, 'bare': {bare}}}"
    step = let(found, "v_", let(f"({stack})", "k_", let("{'stack': k_, 'inner': coalesce(k_[-1].inner, '')}", "w_", state)))
    none = "CAST([] AS STRUCT(kind VARCHAR, n INTEGER, base VARCHAR, \"inner\" VARCHAR)[])"
    rest = f"'stack': {none}, 'deep': 0, 'pre': 0, 'tables': 0, 'rows': 0, 'cells': 0, 'row': false, 'cell': false"
    head = "CASE WHEN i_ = 1 THEN '' ELSE split_part(p_, chr(31), 1) END"
    pieces = (f"list_transform(string_split({x}, chr(30)), lambda p_, i_: {{'tag': lower(regexp_extract({head}, '^/?[a-zA-Z]+')), 'head': {head}, "
              f"'txt': CASE WHEN i_ = 1 THEN p_ ELSE substr(p_, strpos(p_, chr(31)) + 1) END, {rest}}})")
    return f"list_reduce({pieces}, lambda a_, x_: {step}, {{'tag': '', 'head': '', 'txt': '', {rest}}}).txt"


def markdown(html: str) -> str:
    x = without_regions(without_raw(html))
    x = sub(x, r"""(?i)<a[ \t\r\n\f/](?:[^<>]*?[ \t\r\n\f"'/])??href[ \t\r\n\f]*=[ \t\r\n\f]*(?:"([^"<>]*)"|'([^'<>]*)'|([^ \t\r\n\f"'<>]+))[^<>]*>""", chr(2) + r"\1\2\3" + chr(3))
    x = tags_as(x, {"br": "\n", "hr": "\n---\n", **HEADINGS, **{t: chr(n) for t, n in MARKS.items()}, **{t: e for t, e in ENDS.items() if t[1:] not in STRUCTURE}})
    x = sub(sub(x, rf"(?i)<(/?(?:{'|'.join(STRUCTURE)})(?:[ \t\r\n\f/][^>]*)?)>", chr(30) + r"\1" + chr(31)), "<[^>]*>", "")
    x = _fold(x)
    x = sub(x, r"\x10([^\x10\x11\n]+)\x11", r"`\1`")
    for a, b, sign in (("\\x05", "\\x06", "**"), ("\\x0e", "\\x0f", "*")):
        x = sub(x, rf"{a}([ \t]*)([^{a}{b}\n]*[^{a}{b}\n \t])([ \t]*){b}", rf"\1{sign}\2{sign}\3")
    x = sub(x, r"\x02([^\x02\x03\x04\n]+)\x03([^\x02\x03\x04\n]*[^\x02\x03\x04\n \t])\x04", r"[\2](\1)")
    x = sub(sub(x, r"\x02[^\x02\x03\x04]*\x03", ""), r"[\x04-\x06\x0e-\x11]", "")
    return f"translate({tidy(unescape(x))}, chr(1) || chr(7) || chr(8), ' ' || chr(9) || chr(10))"
