"""Property tests (hypothesis) over batches of generated inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fanin.functions import urls as U
from fanin.operators import fuse as FU
from fanin.params import FusionParams
from fanin.params import TRACKING_KEYS
from pyref import check_fused, url_classes

PAGES = url_classes()

schemes = st.sampled_from(["http", "https", "HTTPS", "ftp", "mailto", "svn+ssh", ""])
hosts = st.sampled_from(["Example.com", "www.A.org", "x.co:8080", "u:p@h.net", "[::1]", "[bad", "", "ÉX.fr"])
segments = st.lists(st.sampled_from(["a", "B", "", "c.pdf", "d;.pdf", "%20", "é", "x_y-z.v2"]), max_size=4)
pairs = st.lists(st.sampled_from(["q=1", "utm_source=x", "UTM_Medium=y", "ref=", "ref_src=z", "", "a", "b=2=3",
                                  "Ref=q"]), max_size=4)
frags = st.sampled_from(["", "#top", "#", "#a?b"])
pads = st.sampled_from(["", " ", "\t", " ", "\n"])


@st.composite
def urls(draw):
    s, h = draw(schemes), draw(hosts)
    path = "/".join(draw(segments))
    trail = draw(st.sampled_from(["", "/", "//"]))
    q = draw(pairs)
    url = (f"{s}:" if s else "") + (f"//{h}" if draw(st.booleans()) else h) + ("/" + path if path else "") + trail
    url += ("?" + "&".join(q) if q or draw(st.booleans()) else "") + draw(frags)
    return draw(pads) + url + draw(pads)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(urls(), min_size=50, max_size=200))
def test_canonical_url_ignores_what_does_not_name_a_page(spark, batch):
    """Fragment, white space around and tracking keys appended change nothing; the result has none of them."""
    rows = [(i, u.strip().split("#")[0]) for i, u in enumerate(batch) if "[bad" not in u]
    df = spark.createDataFrame(rows, "id int, u string")
    extra = [df.selectExpr("id", "u"), df.selectExpr("id", "concat(u, '#x') AS u"), df.selectExpr("id", "concat(' ', u, ' ') AS u"),
             df.selectExpr("id", "concat(u, CASE WHEN u LIKE '%?%' THEN '&' ELSE '?' END, 'UTM_Term=z') AS u")]
    forms = {}
    for f in extra:
        for r in U.with_canonical_url(f, "u", "c").select("id", "c").collect():
            forms.setdefault(r.id, set()).add(r.c)
    for i, c in forms.items():
        assert len(c) == 1, (i, c)
        c = c.pop()
        assert "#" not in c
        keys = [p.split("=", 1)[0].lower() for p in c.split("?", 1)[1].split("&")] if "?" in c else []
        assert not set(keys) & set(TRACKING_KEYS)


url_pool = st.sampled_from(sorted(PAGES))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.dictionaries(st.sampled_from(["a", "b", "c"]), st.lists(url_pool, max_size=10)),
                          st.integers(1, 12)), min_size=5, max_size=25))
def test_fusion_keeps_each_pages_best_occurrence(spark, cases):
    rows, reqs = [], []
    for qi, (lists, n) in enumerate(cases):
        q = f"q{qi}"
        reqs.append((q, n))
        rows += [(q, s, i, u) for s, items in lists.items() for i, u in enumerate(items)]
    df = spark.createDataFrame(rows, "query_id string, source string, raw_rank int, href string")
    req = spark.createDataFrame(reqs, "query_id string, num_results int")
    got = {}
    for r in sorted(FU.fuse(df, requests=req, params=FusionParams(("a", "b"))).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.source, r.href))
    for qi, (lists, n) in enumerate(cases):
        check_fused(got.get(f"q{qi}", []), lists, ["a", "b"], n, PAGES)
