import hashlib

from pyspark.sql import functions as F

from fanin.operators import memo as ME

AS_OF = 1_700_000_000_000_000
TTL = 60


def _memo(spark, rows):
    return spark.createDataFrame(rows, "key string, ts_us long, status int, content string")


def test_keys_match_sha256_of_text(spark):
    row = spark.range(1).select(ME.fetch_key(F.lit("https://e.com"), F.lit("markdown"), F.lit(8000)).alias("f"),
                                ME.search_key(F.lit("q"), F.lit(5), F.lit(""), ("a", "b")).alias("s")).first()
    assert row.f == hashlib.sha256(b"fetch|https://e.com|markdown|8000").hexdigest()
    assert row.s == hashlib.sha256(b"search|q|5||a,b").hexdigest()


def test_split_hit_miss_and_ttl_edges(spark):
    memo = _memo(spark, [("fresh", AS_OF - 10 * 10**6, 200, "x"), ("edge", AS_OF - TTL * 10**6, 200, "e"),
                         ("old", AS_OF - TTL * 10**6 - 1, 200, "o"), ("future", AS_OF + 10**9, 200, "f"),
                         ("nots", None, 200, "n")])
    req = spark.createDataFrame([(k,) for k in ("fresh", "edge", "old", "future", "nots", "missing")], "key string")
    got = {r.key: (r.cached, r.memo_content) for r in ME.split(req, memo, AS_OF, TTL).collect()}
    assert got == {"fresh": (True, "x"), "edge": (True, "e"), "old": (False, None), "future": (True, "f"),
                   "nots": (False, None), "missing": (False, None)}
    assert not ME.split(req, memo, AS_OF, -1).filter("cached AND key = 'fresh'").count()


def test_admit_upsert_prune_purge_stats(spark):
    memo = _memo(spark, [("a", 1, 200, "old"), ("b", 2, 200, "bb")])
    new = _memo(spark, [("a", 1, 200, "new"), ("c", 3, 200, "cc")])
    up = {r.key: r.content for r in ME.upsert(memo, new).collect()}
    assert up == {"a": "new", "b": "bb", "c": "cc"}        # same ts: the new write wins
    assert sorted(r.key for r in ME.prune(ME.upsert(memo, new), 2).collect()) == ["b", "c"]
    dele = spark.createDataFrame([("b",)], "key string")
    assert [r.key for r in ME.purge(memo, delete_keys=dele).collect()] == ["a"]
    assert ME.purge(memo, clear=True).count() == 0
    st = ME.stats(memo, 10).first()
    assert st.entries == 2 and st.size_bytes == 5 and st.oldest_age_s == 9e-6
    empty = ME.stats(memo.limit(0), 10).first()
    assert (empty.entries, empty.size_bytes, empty.oldest_age_s, empty.newest_age_s) == (0, 0, 0.0, 0.0)
    res = spark.createDataFrame([("u1", 200, "c"), ("u2", 200, ""), ("u3", 404, "x")], "url string, status int, content string")
    assert [r.url for r in ME.admit_fetches(res).collect()] == ["u1"]
