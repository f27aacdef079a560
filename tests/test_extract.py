from pyspark.sql import functions as F

from fanin.functions import html as H
from fanin.operators import extract as EX


def _one(spark, html, fn):
    return spark.createDataFrame([(html,)], "h string").select(fn("h").alias("x")).first().x


def test_text_from_html(spark):
    html = ("<html><head><title>Doc Title</title></head><body><article><h1>Heading</h1>"
            "<p>Some real body content here.</p></article></body></html>")
    md = _one(spark, html, H.extract_markdown)
    assert "Heading" in md and md.startswith("# Heading")
    assert "Doc Title" not in _one(spark, html, H.extract_text)


def test_blank_html(spark):
    assert _one(spark, "", H.extract_text) == "" and _one(spark, "   ", H.extract_text) == ""
    assert _one(spark, None, H.extract_text) == ""


def test_boilerplate_regions_and_entities(spark):
    html = ("<body><nav>menu</nav><header>top</header><form>f</form><aside>side</aside><script>var x='</p>'</script>"
            "<style>p{}</style><!-- c --><table><tr><td>cell</td></tr></table><p>a &lt;b&gt; &quot;c&quot; &#39;d&#39;"
            "&nbsp;e &copy; &middot; &amp;lt;</p><footer>bottom</footer></body>")
    t = _one(spark, html, H.extract_text)
    for gone in ("menu", "top", "side", "var x", "p{}", "bottom", " c "):
        assert gone not in t
    assert "cell" in t and "a <b> \"c\" 'd' e © · &lt;" in t


def test_markdown_marks_dropped_in_text_mode(spark):
    html = "<body><h2>Title</h2><ul><li>one</li><li>two</li></ul><p>x</p></body>"
    assert _one(spark, html, H.extract_markdown).splitlines()[:3] == ["## Title", "", "- one"] or \
        "## Title" in _one(spark, html, H.extract_markdown)
    plain = spark.createDataFrame([(html,)], "h string").select(H.extract_content("h", "text").alias("x")).first().x
    assert "#" not in plain and "- one" not in plain and "one" in plain


def test_metadata(spark):
    html = ("<html lang=\"en\"><head><title>  My\n Page </title><meta name=\"author\" content=\"Ann\">"
            "<meta content=\"About it\" name=\"description\"><meta property=\"og:site_name\" content=\"Site\"></head></html>")
    m = spark.createDataFrame([(html,), ("<html><body></body></html>",)], "h string") \
        .select(H.page_metadata("h").alias("m")).collect()
    assert m[0].m.asDict() == {"title": "My Page", "author": "Ann", "description": "About it",
                               "sitename": "Site", "language": "en"}
    assert m[1].m.title is None


def test_truncate(spark):
    df = spark.createDataFrame([("x" * 1000, 100), ("x" * 1000, 0), ("x" * 1000, 5000)], "t string, m int")
    out = df.select(F.length(EX.truncate("t", F.col("m"))).alias("n"), EX.content_length("t", F.col("m")).alias("c")).collect()
    assert [(r.n, r.c) for r in out] == [(100, 100), (1000, 1000), (1000, 1000)]


def test_assemble_pages_drops_blank_pages(spark):
    pages = spark.createDataFrame([(1, 2, "  \t "), (1, 3, "third"), (1, 1, "first"), (2, 1, " ")],
                                  "doc_id long, page_no int, text string")
    out = {r.doc_id: r.text for r in EX.assemble_pages(pages).collect()}
    assert out == {1: "first\n\nthird"}


def test_long_blank_runs(spark):
    html = "<p>a" + " " * 50000 + "b" + " " * 30000 + "\n\n\n\n" + "c</p>"
    assert _one(spark, html, H.extract_text) == "a" + " " * 50000 + "b\n\nc"


def _cases(seed, n, most):
    import random

    rng = random.Random(seed)
    parts = ["<p>", "</p>", "x", " y ", "\n", "&lt;", "&#38;lt;", "<b>", "</b>", "<i>", " </i>", "<a href='u'>", "<a name=q href=\"v w\">", "</a>", "<code>", "</code>",
             "<ul>", "</ul>", "<ol start=3>", "<ol>", "</ol>", "<li>", "</li>", "<blockquote>", "</blockquote>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>",
             "<th>", "|", "<pre>", "</pre>", "  ", "\t", "<br>", "<h2>", "</h2>", "<hr>", "<nav>", "</nav>", "<form a='1'>", "<form ", "</form>", "<header>", "</header>",
             "<!--", "-->", "<script>", "</script>", "<head>", "</head>", "<div>", "</div>", " < ", " > ", "</td x>", "<br/>", "<p <br>", "é", "\x02", "\x1e"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_random_markup_agrees_with_the_sql_rules(spark):
    """The oracles' rules are written on their own: windows for nested regions, a reduce for markdown."""
    import duckdb
    import pandas as pd

    from fanin.plans import sqlx as X

    cases = _cases(4, 600, 30)
    df = spark.createDataFrame(list(enumerate(cases)), "n long, h string")
    got = df.select("n", H.extract_text("h").alias("t"), H.extract_markdown("h").alias("m"), H.extract_content("h", "text").alias("c")).toPandas().sort_values("n")
    db = duckdb.connect()
    db.register("d", pd.DataFrame({"n": range(len(cases)), "h": cases}))
    want = db.sql(f"SELECT n, {X.extract_text('h')} AS t, {X.extract_markdown('h')} AS m, {X.extract_expr('h', True, True)} AS c FROM d ORDER BY n").df()
    for k, c in enumerate(cases):
        assert tuple(got.iloc[k]) == tuple(want.iloc[k]), repr(c)


def test_nested_regions_by_counting_depth(spark):
    import random
    import re

    from fanin.functions.regions import REGION_TAGS, drop_regions

    rng = random.Random(9)
    tags = [t for name in REGION_TAGS for t in (f"<{name}>", f"<{name} class='a'>", f"</{name}>", f"</{name.upper()} >")]
    cases = ["<nav>a<nav>b</nav>LEAK</nav>k", "<nav>a<form>b</nav>k", "</nav>k<nav>l"]
    cases += ["".join(rng.choice(tags) if rng.random() < .5 else rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    got = [r.x for r in df.select(drop_regions(F.col("h")).alias("x")).collect()]
    for c, g in zip(cases, got, strict=True):
        pieces, keep = re.split(r"(<[^>]*>)", c), None
        keep = [True] * len(pieces)
        for name in REGION_TAGS:
            depths, depth = [], 0
            for x in pieces:
                m = re.match(rf"(?i)<(/?){name}[ >]", x)
                depth = depth if not m else depth + 1 if not m[1] else max(depth - 1, 0)
                depths.append(depth)
            keep = [k and d <= min(depths[i:]) for i, (k, d) in enumerate(zip(keep, depths, strict=True))]
        assert g == "".join(x for x, k in zip(pieces, keep, strict=True) if k and not x.startswith("<")), c


MARKDOWN = [
    ("<p>a <b>bold</b> <i> it </i> <a href='http://x/?a=1&amp;b=2'>to <em>x</em></a> <code>c&lt;d</code></p>", "a **bold**  *it*  [to *x*](http://x/?a=1&b=2) `c<d`"),
    ("<a href=q>one</a> <a name=z>two</a> <A HREF=\"r\"></A><strong></strong>.", "[one](q) two ."),
    ("<p><b>never closed<br>next</p><i>x", "never closed\nnext\nx"),
    ("<ul><li>one<ul><li>in<ol start=3><li>n<li>m</ol></ul><li>two</ul>after", "- one\n  - in\n    3. n\n    4. m\n- two\nafter"),
    ("<ol><li><p>p1</p><p>p2</p></li><li>q</li></ol>", "1. p1\n   p2\n2. q"),
    ("<blockquote><p>a</p><blockquote>b<ul><li>x</ul></blockquote>c</blockquote>tail", "> a\n> > b\n> > - x\n> c\ntail"),
    ("<table><thead><tr><th>A<th>B|C</thead><tr><td>1<br>2</td><td><p>x</p><ul><li>y</ul></td></tr><tr><td>3<td><table><tr><td>4</table></table>end",
     "| A | B\\|C |\n| --- | --- |\n| 1 2 | x y |\n| 3 |  4 |\nend"),
    ("<p>code:</p><pre><code>def f(x):\n    return <b>x</b>\n\n\n\n# end  \n</code></pre><p>z</p>", "code:\n\n```\ndef f(x):\n    return x\n\n\n\n# end  \n```\nz"),
    ("<ul><li><pre>a\n b</pre></ul>", "-\n  ```\n  a\n   b\n  ```"),
    ("<h1>T</h1><hr><p>&#38;lt; &amp;lt; &nope; &#x41; &eacute;</p>", "# T\n\n---\n&lt; &lt; &nope; A é"),
]


def test_markdown_forms(spark):
    df = spark.createDataFrame([(h,) for h, _ in MARKDOWN], "h string")
    got = [r.x for r in df.select(H.extract_markdown("h").alias("x")).collect()]
    for (h, want), g in zip(MARKDOWN, got, strict=True):
        assert g == want, h


def test_long_structures_take_linear_time(spark):
    import time

    def seconds(html):
        df = spark.createDataFrame([(html,)], "h string").select(F.length(H.extract_markdown("h")).alias("n"))
        began = time.time()
        assert df.first().n > 0
        return time.time() - began

    for unit in ("<p>w <b>x</b> <a href='u'>l</a></p><ul><li>a<li>b</ul>", "<nav>x", "<table><tr><td>x", "<!-- <b>"):
        seconds(unit * 100)
        small, large = seconds(unit * 2_000), seconds(unit * 16_000)
        assert large < 16 * max(small, 1.0), unit
    deep = seconds("<ul><li>x" * 3_000) + seconds("<blockquote>x" * 3_000)
    assert deep < 60


def test_unclosed_tags_are_linear(spark):
    n = 20000
    big = "<p>" + "a < b " * n + "<script>" + "x" * n + "<form " * n
    out = spark.createDataFrame([(big,)], "h string").select(F.length(H.extract_text("h")).alias("n")).first().n
    assert out > 0


def test_linear_metadata_forms_agree_with_plain_patterns(spark):
    import random
    import re

    rng = random.Random(8)
    parts = ["<title>", "</title>", "<title ", "T", "<meta name='author' content='Ann'>", "<meta ", "<meta content=\"d\" name=\"description\">",
             "<html lang='fr'>", "<html ", " x ", ">", "<p>"]
    cases = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    got = df.select(H.page_metadata("h").alias("m")).collect()
    for c, r in zip(cases, got):
        m = re.search(H.TITLE_RE, c)
        title = " ".join(m.group(1).split()) if m else ""
        assert (r.m.title or "") == title, repr(c)
        m = re.search(H.LANG_RE, c)
        assert (r.m.language or "") == (m.group(1).strip() if m else ""), repr(c)
        found = (re.search(p, c) for p in H.META_FIELDS["author"])
        author = next((m.group(1) for m in found if m and m.group(1)), "")
        assert (r.m.author or "") == " ".join(author.split()), repr(c)
    big = "<title " * 20000 + "<meta " * 20000
    out = spark.createDataFrame([(big,)], "h string").select(H.page_metadata("h").alias("m")).first().m
    assert out.title is None and out.author is None
