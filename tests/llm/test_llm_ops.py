"""Quality rules, packing, mixing, language ID, HTML extraction, URL filter and training order on small inputs."""

import html
import json
import random
import re
import time
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fanin.llm import htmltext as H
from fanin.llm import langid as L
from fanin.llm import mixing as M
from fanin.llm import packing as P
from fanin.llm import quality as Q
from fanin.llm import trainorder as T
from fanin.llm import urlrules as U

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(P.TOKENIZER)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- quality ---------------------------------------------------------------------------------------------

def brute_measures(t):
    w, dup, seen = words(t), 0, set()
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def test_base_measures():
    rng = random.Random(4)
    texts = ["", " \n\t", "a b c d e a b c d e f", "x\nx\n x\n\n\n", "é 日本 #|<\u00a0>\u2028 \x1c z", "a " * 50, "a b c d e f " * 3 + "g"]
    texts += ["".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    for t in texts:
        assert Q.base_measures(t) == brute_measures(t), t


def test_viterbi_is_the_best_path():
    from itertools import product
    rng = random.Random(6)
    for _ in range(60):
        scores = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 7))]
        step = np.array([[rng.uniform(-1, 1) for _ in "ab"] for _ in "ab"])
        value = lambda p: sum(s * y for s, y in zip(scores, p, strict=True)) + sum(step[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(product((0, 1), repeat=len(scores)), key=value)
        assert value(Q.viterbi(scores, step)) == pytest.approx(value(best))


def test_field_holds_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    field = Q.fitted_field(docs, labels.filter("doc_id % 2 = 0"))
    rows = Q.judged(docs, field).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "content_share").collect()
    good = [r.content_share >= Q.MIN_CONTENT for r in rows if r.quality == 1]
    bad = [r.content_share < Q.MIN_CONTENT for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.9 and len(bad) > 10


def test_quality_rows(spark):
    good = "The first sentence of a plain text. The second one follows here, and says more.\nAnother line of it."
    docs = spark.createDataFrame([(1, good, True), (None, None, False), (3, "", True), (3, good, True)], "doc_id long, text string, kept boolean")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = Q.judged(docs, Q.fitted_field(docs, none)).collect()
    assert sorted((r.n_words, r.base_failed, r.kept) for r in out) == [(0, True, False), (0, True, False), (19, False, True), (19, False, True)]
    kept = Q.keep_good(docs, none)
    assert kept.columns == docs.columns and [r.kept for r in kept.collect()] == [True, True]
    assert Q.keep_good(docs.limit(0), none).count() == 0


# --- packing ---------------------------------------------------------------------------------------------

def test_encoder_equals_the_tokenizer(monkeypatch):
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    letters = "ñÑÉ²ªßaB'sé́ <|>endoftxr \x1c\n\t½ǅİΣσ.,!#日\u200b_-0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["<|endoftext|> a<|endoftext|>b", "don't I'LL we'Ve", ""]
    monkeypatch.setattr(P, "CACHE_WORDS", 50)
    for path in (PATH, public_tokenizers.path("byte_bpe_50k.json")):
        tok = Tokenizer.from_file(path)
        some = texts if path == PATH else texts[:100]
        for t, ids in zip(some, P.word_encoder(path)(some), strict=True):
            assert P.ids_of(ids).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_first_fit_decreasing():
    rng = random.Random(2)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(0, 40))), reverse=True)
        room, want = [], []
        for s in sizes:
            i = next((i for i, r in enumerate(room) if r >= s), len(room))
            if i == len(room):
                room.append(20)
            want.append((i, 20 - room[i]))
            room[i] -= s
        assert P.first_fit_decreasing(sizes, 20) == want


def test_packing_round_trip(spark):
    tok = Tokenizer.from_file(PATH)
    texts = ["a word", None, "", "many words here " * 40, "x", "a word"]
    docs = spark.createDataFrame([(i if i else None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = P.pack_documents(docs, length=32).collect()
    back = {}
    for r in rows:
        back.setdefault(r.doc, {})[r.start] = P.ids_of(r.ids).tolist()
    for i, t in enumerate(texts):
        pieces = back[i if i else None]
        assert sum((pieces[s] for s in sorted(pieces)), []) == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 32
    total = sum(r.length for r in rows)
    assert len(by) <= total / 32 + 1
    assert P.pack_documents(docs.limit(0)).count() == 0
    digest = {(r.doc_id, r.start): (r.ids_crc32, r.doc_tokens) for r in P.packed_digest(docs).collect()}
    assert digest[(3, 0)] == (P.checksum([*tok.encode(texts[3]).ids, 1]), len(tok.encode(texts[3]).ids) + 1)


# --- mixing ----------------------------------------------------------------------------------------------

def water_fill(sizes, weights, cap):
    total, left, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    rest = float(total)
    while left:
        share = {i: rest * weights[i] / sum(weights[j] for j in left) for i in left}
        over = {i for i in left if share[i] >= cap * sizes[i]}
        if not over:
            for i in left:
                target[i] = share[i]
            break
        for i in over:
            target[i] = float(cap * sizes[i])
            rest -= target[i]
        left -= over
    return target


@pytest.mark.parametrize("seed", range(6))
def test_mix_targets_and_budgets(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, None, 3]), rng.choice([None, "", "w " * rng.randint(1, 30), "w\u00a0x y"]),
             rng.choice(["b", "a", "Z", "é", None][:rng.randint(1, 5)]), 5) for i in range(rng.randint(0, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    plan = M.plan_mix(docs).collect()
    assert len(plan) == len(rows)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(words(r[1])) for r in rows if r[2] == s) for s in names]
    target = water_fill(sizes, [1 + i % 3 for i in range(len(names))], 3)
    for s, size, t in zip(names, sizes, target, strict=True):
        mine = [r for r in plan if r.source == s]
        assert all(r.source_size == size and r.target == pytest.approx(t) for r in mine)
        assert sum(r.taken for r in mine) == int(np.floor(t + 0.5)) and all(0 <= r.taken <= 3 * r.size for r in mine)
    again = docs.repartition(5)
    assert sorted(map(str, M.plan_mix(again).collect())) == sorted(map(str, plan))
    mixed = M.mix(docs)
    assert mixed.columns == docs.columns
    taken = {s: sum(r.taken for r in plan if r.source == s) for s in names}
    got = Counter()
    for r in mixed.collect():
        got[r.source] += len(words(r.text))
    assert all(got[s] == taken[s] for s in names)


# --- language --------------------------------------------------------------------------------------------

def test_codewords_are_apart():
    for n in range(2, 20):
        code = L.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= max(1, code.shape[1] // 4)
    assert L.codewords(1).shape == (1, 0) and L.codewords(0).shape == (0, 0)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = L.identify(L.with_fold(docs), L.train(docs)).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_counts_are_exact(spark):
    docs = spark.createDataFrame([("en", "The cat"), ("en", "the cat"), ("fr", "été"), (None, "x"), ("fr", None)], "lang string, text string")
    got = {(r.lang, r.feature): r.n for r in L.counts_by_language(docs).collect()}
    feature, _ = L.trigrams(["the cat"])
    assert sum(n for (lang, _), n in got.items() if lang == "en") == 2 * len(feature)
    assert {lang for lang, _ in got} == {"en", "fr"}


def test_language_edges(spark):
    rows = [(1, None, "en", 0.5), (None, "12 34 !", "en", 0.5), (2, "", None, 0.5), (3, "hello there", "en", 0.5), (4, "la été dans", "fr", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = L.train(docs)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, None, 2)] == ["und"] * 3 and got[3].lang_pred in model.languages
    empty = L.train(docs.limit(0))
    assert {r.lang_pred for r in L.identify(docs, empty).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0


# --- HTML ------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies, ok.</div><div class="wrap"><ul class="menu"><li><a href=a>A</a></ul><div id="content">
<h2>Title here</h2><p>First para, it has text &amp; <a href=x>a link</a>. More.<p>Second&nbsp;para<br>line, more text here.</p>
<ul><li>one item</li><li>two <b>item</b></ul><table><tr><td>c1<td>c2</table><script>var a="<p>no</p>"</script></div>
<div class="comments"><p>Nice article, thanks a lot.</p></div><div class=sidebar><p>side, text.</p></div></div>
<form><p>Sign up</p></form><footer>foot</footer>"""


def test_extract_by_blocks():
    assert H.extract(PAGE) == "Title here\nFirst para, it has text & a link. More.\nSecond para line, more text here.\none item\ntwo item\nc1\nc2"
    wrapped = "<body><nav><a href=x>Home</a></nav><main><article><header><h1>T</h1><p>By me</p></header><p>Body, of it.</p>"
    wrapped += "<aside>x</aside></article><section id=comments><article><p>I disagree, strongly, with all.</p></article></section></main>"
    assert H.extract(wrapped) == "T\nBody, of it."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("just text", "just text"), ("a < b", "a < b"), ("<p>x", "x"),
                                        ("<!-- <p>no", ""), ("<script>if (a<b) {}", ""), ("<p a='>'>q</p>", "q"), ("&#8217;&eacute;", "’é"),
                                        ("<div>" * 3000 + "deep" + "</div>" * 10, "deep")])
def test_extract_odd_pages(page, text):
    assert H.extract(page) == text


def test_extract_region_holds_all_content():
    text = lambda n: ("Words, and more of them. " * n).strip()
    want = ["Title", text(4), text(80)]
    assert H.extract(f"<div><h2>Title</h2><p>{text(4)}</p><p>{text(80)}</p></div>").split("\n") == want
    assert H.extract(f"<body><div><h2>Title</h2><ul><li>{text(80)}</li></ul></div></body>").split("\n") == ["Title", text(80)]
    parts = f"<div><p>{text(90)}</p></div><div><blockquote>{text(10)}</blockquote></div>"
    assert H.extract(f"<body>{parts}</body>").split("\n") == [text(90), text(10)]
    main = f"<body><main><article><p>{text(60)}</p></article><section><p>{text(40)}</p></section></main></body>"
    assert H.extract(main).split("\n") == [text(60), text(40)]
    teaser = f"<body><article><p>{text(4)}</p></article><div><p>{text(90)}</p></div></body>"
    assert H.extract(teaser).split("\n") == [text(4), text(90)]


def test_extract_forms():
    text = ("Words, and more of them. " * 20).strip()
    form = '<body><form id="aspnetForm"><input name=v><select><option>no</option></select>{}<button>Go</button></form></body>'
    for part in (f"<article><p>{text}</p></article>", f"<main><p>{text}</p></main>", f"<div><p>{text}</p></div>", f"<div>{text}</div>"):
        assert H.extract(form.format(part)) == text
    assert H.extract(form.format(f"<h1>T</h1><p>{text}</p><form><p>Sign up</p></form>")) == f"T\n{text}"
    assert H.extract(f"<body><form><h1>T</h1><p>In it, too.</p></form><p>{text}</p></body>").split("\n") == ["T", "In it, too.", text]
    assert H.extract(f"<body><div><p>{text}</p><form><p>Sign up, now.</p></form></div></body>") == text


LONG = "Words, and more of them in a row. " * 6


@pytest.mark.parametrize("page, word, kept", [
    (f'<article><p>{LONG}<span style="display:none">HIDDEN</span></p></article>', "HIDDEN", False),
    (f'<article><p>{LONG}<span class="advert">BUY <span>NOW</span></span> end.</p></article>', "NOW", False),
    (f'<article><p>{LONG}<span class="advert">BUY <span>NOW</span></span> end.</p></article>', "end.", True),
    (f'<article><p>{LONG}</p><my-comments class="comments">Nice post!</my-comments></article>', "Nice", False),
    (f'<div data-x="<b>junk</b>"><p>{LONG}</p></div>', "junk", False),
    (f'<article><p>{LONG}</p><div id="market-share"><p>Alpha, it is. {LONG}</p></div></article>', "Alpha", True),
    (f'<article><p>{LONG}</p><section class="search-and-rescue"><p>Alpha, it is. {LONG}</p></section></article>', "Alpha", True),
    (f'<article><p class="tags-explained">Alpha, it is. {LONG}</p><p>{LONG}</p></article>', "Alpha", True),
    (f'<article><header><h1>T</h1><p>Alpha, it is. {LONG}</p></header><p>{LONG}</p></article>', "Alpha", True),
    (f'<article><p>Short, it is.</p></article><div class="comments">{"<p>" + LONG * 5 + "</p>"}</div>', "Short", True),
    (f'<article><p>Short, it is.</p></article><div class="comments">{"<p>" + LONG * 5 + "</p>"}</div>', "Words", False),
    (f'<div class="widget"><h1>Title</h1><p>{LONG}</p></div><div>Small print</div>', "Words", True),
    (f'<div>Cheap shoes here.</div><div><h1>T</h1><p>{LONG}</p><ul><li>one</li></ul><p>{LONG}</p></div><div>All rights</div>', "one", True),
    (f'<div>Cheap shoes here.</div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div>All rights</div>', "Cheap", False),
    (f'<div>Cheap shoes here.</div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div>All rights</div>', "rights", False)])
def test_extract_parts(page, word, kept):
    assert (word in H.extract(page)) is kept


def test_extract_score_decides():
    """Pages without telling elements or names: the ratios leave menus, adverts and small print out, a constant leaves all in."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    said = lambda n: " ".join(rng.choice(words) + ("," if i % 7 == 6 else "") for i in range(n)) + "."
    changed = 0
    for _ in range(40):
        body = [said(rng.randrange(40, 90)) for _ in range(rng.randrange(3, 8))]
        menu = "".join(f"<li>{rng.choice(words)}</li>" for _ in range(rng.randrange(3, 30)))
        page = f"<div><ul>{menu}</ul></div><div>{said(4)}</div><div><h1>{said(5)}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div>{said(5)}</div>"
        got = H.extract(page).split("\n")
        assert got[1:] == body
        scores, H.scores = H.scores, lambda page, nodes: np.ones(len(nodes))
        try:
            changed += H.extract(page).split("\n") != got
        finally:
            H.scores = scores
    assert changed == 40


@pytest.mark.parametrize("page", ["<div>" * 50000 + "x", "<div>" * 20000 + "<li>a</li>" * 20000, '<a x="' * 50000, "<b y='>" * 50000,
                                  "<p>" * 30000 + "</section>" * 30000, '<span class="ad">' * 30000 + "t", '<div class="ad">' * 30000 + "x", "<div>x" * 30000])
def test_extract_is_linear(page):
    start = time.perf_counter()
    H.extract(page)
    assert time.perf_counter() - start < 10      # quadratic readings take minutes


def test_extract_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in H.with_main_text(pages.withColumn("text", F.lit(1))).collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"<(?:p|h1|/p|/h1)>", body))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)
    assert H.with_main_text(pages.limit(0)).count() == 0


# --- URLs ------------------------------------------------------------------------------------------------

def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p) for h, p, _ in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


def test_stated_rules(spark):
    urls = [None, "", "no host", "http://", "HTTP://A.Example.COM/en/1?x#y", "http://www.example.com/en/2", "x://www.example.com", "http://example.com/EN/",
            "http://b.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://b.net?/es/", "a://b://c/d", "http://É.com/é\n/z", "http://notexample.com/en/"]
    pages = spark.createDataFrame([(i if i else None, u, "x") for i, u in enumerate(urls * 2)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = U.filter_urls(pages, labels).collect()
    verdict = {h + p: v for h, p, v in U.RULES}
    want = [(*brute_url(u), verdict.get(brute_url(u)[2], "allow")) for u in urls * 2]
    key = lambda x: tuple("" if v is None else v for v in x)
    assert sorted(((r.host, r.path, r.rule, r.verdict) for r in rows), key=key) == sorted(want, key=key)
    assert U.filter_urls(pages.limit(0), labels).count() == 0


def test_mined_rules(spark):
    rows = [(i, f"http://{'win.casino' if i % 4 == 0 else 'blog.plain'}.org/{'free-bets' if i % 8 == 0 else 'page'}/{i}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 8 == 0 or i == 3 else 1, None) for i in range(0, 160)] + [(None, 0, 1), (8, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    out = {r.page: r for r in U.filter_urls(pages, labels, rules=()).collect()}
    assert all((out[i].verdict == "block") == (i % 8 == 0) for i in range(200))
    baskets = spark.createDataFrame([(["a", "b"], True), (["a"], False), (["a", "b"], True)], "tokens array<string>, blocked boolean")
    mined = {tuple(sorted(t for x in r["items"] for t in x)): (r.confidence, r.support) for r in U.mine_rules(baskets, 0.1, 0.5, min_count=1).collect()}
    assert mined == {("a",): (pytest.approx(2 / 3), 2), ("b",): (1.0, 2), ("a", "b"): (1.0, 2)}


def test_rules_need_the_same_evidence_at_every_size(spark):
    tokens = F.when(F.col("id") < 30, F.array(*[F.lit(x) for x in "abcde"])).otherwise(F.array(F.lit("x")))
    for n in (1_000, 20_000):
        baskets = spark.range(n).select(tokens.alias("tokens"), (F.col("id") < 30).alias("blocked"))
        mined = [(r["items"], r.confidence, r.support) for r in U.mine_rules(baskets).collect()]
        assert mined == [([list("abcde")], 1.0, 30)]       # five tokens of the same baskets are one item


@pytest.mark.parametrize("seed", range(3))
def test_mined_rules_against_brute_force(spark, seed):
    """Every combination of up to all tokens that enough baskets hold with confidence: the same URLs are blocked."""
    rng = random.Random(seed)
    names = list("abcdef") + ["g1", "g2", "g3"]
    rows = []
    for _ in range(80):
        own = {x for x in "abcdef" if rng.random() < 0.35} | ({"g1", "g2", "g3"} if rng.random() < 0.4 else set())
        rows.append((sorted(own), bool({"a", "b"} <= own or {"c", "g2"} <= own or rng.random() < 0.1)))
    sets = [frozenset(c) for k in range(1, len(names) + 1) for c in combinations(names, k)]
    rules = {}
    for one in sets:
        has = [blocked for own, blocked in rows if one <= set(own)]
        if sum(has) >= 5 and sum(has) / len(has) >= 0.8:
            rules[one] = sum(has) / len(has)
    urls = [(i, sorted(x for x in names if rng.random() < 0.4)) for i in range(200)]
    want = {}
    for i, own in urls:
        found = [c for one, c in rules.items() if one <= set(own)]
        if found:
            want[i] = pytest.approx(max(found))
    mined = U.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), min_count=5)
    got = U.match_rules(spark.createDataFrame(urls, "id long, tokens array<string>"), mined, "id")
    assert want and {r.id: r.confidence for r in got.collect()} == want


def test_long_templates_and_few_labels(spark):
    """40 shared segments are mined in seconds; labels below the support mine nothing."""
    long = "/".join(f"s{i}" for i in range(40))
    urls = [(i, f"https://a.org/{long}/{i}" if i % 2 else f"https://b.org/p{i}") for i in range(60)] + [(60, f"https://c.org/{long}"), (61, None)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    start = time.perf_counter()
    out = {r.page: r.verdict for r in U.filter_urls(pages, labels, rules=()).collect()}
    assert time.perf_counter() - start < 60
    assert {i for i, v in out.items() if v == "block"} == {i for i in range(60) if i % 2} | {60}
    few = U.filter_urls(pages, labels.filter("doc_id < 6"), rules=())
    assert {r.verdict for r in few.collect()} == {"allow"}


# --- training order --------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 4097])
def test_permutation(n):
    s = T.slots_of(np.arange(n), n)
    assert sorted(s.tolist()) == list(range(n)) and (T.numbers_of(s, n) == np.arange(n)).all()
    if n > 60:
        assert (s != T.slots_of(np.arange(n), n, "another key")).any()


def test_shards_round_trip(spark, tmp_path):
    tok = Tokenizer.from_file(PATH)
    texts = ["one two three " * i for i in range(30)] + [None, ""]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, slot int")
    rows = T.in_training_order(docs, length=8, shard_slots=16).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n)) and all(r.shard == r.slot // 16 for r in rows)
    back = {}
    for r in rows:
        ids = np.frombuffer(r.record, dtype="<u2").tolist()
        assert len(ids) == 8 and not any(ids[r.length:])
        back.setdefault(r.doc, {})[r.start] = ids[:r.length]
    for i, t in enumerate(texts):
        d = back[i if i else None]
        assert sum((d[s] for s in sorted(d)), []) == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    path = str(tmp_path / "shards")
    T.write_shards(docs, path, length=8, shard_slots=16)
    got = {r.slot: r.record for r in T.read_slots(spark, path, 10, 40, length=8, shard_slots=16).collect()}
    want = {r.slot: r.record for r in rows}
    assert got.keys() == set(range(10, 41)) and len({r.record for r in rows}) > 1
    assert Counter(bytes(x) for x in want.values()) >= Counter(bytes(x) for x in got.values())
    assert T.in_training_order(docs.limit(0)).count() == 0


def test_shards_slot_by_slot(spark, tmp_path):
    """Records against a plain reading: numbered by file, place and start, at the permutation's slot, whatever the splits."""
    tok = Tokenizer.from_file(PATH)
    texts = [("word " * (7 * i % 50) + str(i)) if i % 9 else None for i in range(300)]
    for part in range(3):
        rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts)][part * 100:part * 100 + 100]
        spark.createDataFrame(rows, "doc_id long, text string, _row string").coalesce(1).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "docs" / f"p={part}"))
    docs = spark.read.parquet(*[str(tmp_path / "docs" / f"p={part}") for part in range(3)])
    want = []
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i if i % 5 else None, a, len(ids[a:a + 8]), np.array((ids[a:a + 8] + [0] * 8)[:8], dtype="<u2").tobytes()) for a in range(0, len(ids), 8)]
    slots = T.slots_of(np.arange(len(want)), len(want))
    want = {int(s): w for s, w in zip(slots, want, strict=True)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for i, size in enumerate((before, "1500", "4000")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            path = str(tmp_path / f"shards{i}")
            T.write_shards(docs, path, length=8, shard_slots=64)
            index = {r.slot: r for r in T.read_index(spark, path, length=8).collect()}
            assert index.keys() == want.keys()
            for s, (doc, start, length, record) in want.items():
                r = index[s]
                assert (r.doc, r.start, r.length, r.shard, r.byte_offset, r.record_crc32) == (doc, start, length, s // 64, s % 64 * 16, zlib.crc32(record))
            assert {r.slot: bytes(r.record) for r in T.read_slots(spark, path, 60, 200, length=8, shard_slots=64).collect()} == {s: want[s][3] for s in range(60, 201)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    T.write_shards(docs.limit(0), str(tmp_path / "none"))
    assert T.read_index(spark, str(tmp_path / "none")).count() == 0


def test_words_before_signs_take_no_pattern(monkeypatch):
    """Letters followed by signs, most words that are not letters alone, are cut without the pre-tokeniser's pattern."""
    cut = []
    monkeypatch.setattr(P, "split", lambda word, f=P.split: cut.append(word) or f(word))
    tok = Tokenizer.from_file(PATH)
    words = ["word.", "Größe,", "naïve?!", "it's", "'s", "don't,", "a1.", "x_y", "end'", "é###", "ñ", "###", "İst.", "ab'sc", "a\u00ad."]
    for word, ids in zip(words, P._new_encoder(PATH)(words), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tok.encode(word, add_special_tokens=False).ids, word
    assert not {"word.", "größe,", "naïve?!", "end'", "é###"} & set(cut) and {"it's", "a1.", "ab'sc"} <= set(cut)


# --- queries ---------------------------------------------------------------------------------------------

def test_queries_with_sql(spark):
    from fanin.llm.queries import oracle_sql, queries
    for name, sql in oracle_sql().items():
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = con.execute(sql).df()
        got = queries()[name](spark, SF).toPandas()[list(want.columns)]
        a, b = (x.sort_values("doc_id").reset_index(drop=True) for x in (got, want))
        assert (a == b).all().all(), name


def test_pipeline_keeps_what_its_rules_say(spark):
    import corpus_pipeline
    from fanin.llm.exact_dedup import normalised

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = corpus_pipeline.materialise(stage["quality rules"](spark, docs, SF), "t")
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    unique = corpus_pipeline.materialise(stage["exact dedup"](spark, good, SF), "t")
    firsts = {}
    for r in sorted(good.collect(), key=lambda r: r.doc_id):
        firsts.setdefault(normalised(r.text), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(firsts.values())
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(out.doc_id) <= set(firsts.values())
    assert json.loads(out.groupby("sequence_id").length.sum().to_json()) and out.groupby("sequence_id").length.sum().max() <= 2048


@pytest.mark.parametrize("part, kept", [('<div class="left-menu"><p>Menu, here.</p></div>', False), ('<div id="header"><p>Site, name.</p></div>', False),
                                        ('<div class="page-footer"><p>All, rights.</p></div>', False), ('<div class="no-ads"><p>More, text.</p></div>', True),
                                        ('<section class="post-header"><h2>Part, two.</h2></section>', True), ('<p>More, text.</p>', True),
                                        ('<div role="complementary"><p>Aside, text.</p></div>', False), ('<noscript><p>Enable, it.</p></noscript>', False),
                                        ('<div hidden><p>Hidden, text.</p></div>', False), ('<ul class="shareButtons"><li>Share, it</li></ul>', False)])
def test_parts_by_class_and_role(part, kept):
    body = "<p>The article says much, in several words, over and over.</p>" * 4
    page = f'<html><body class="left-sidebar"><div class="with-sidebar"><div class="text">{body}{part}</div></div></body></html>'
    text = re.sub(r"<[^>]*>", "", part)
    assert (text in H.extract(page).split("\n")) is kept
    assert H.extract(page).count("The article says") == 4
