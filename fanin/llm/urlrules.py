"""URL filters: association rules over URL tokens, mined by FP-growth and matched by an inverted index.

A labelled page is a basket of its URL's tokens and its label; FP-growth finds the token combinations that occur
with the block label, and those with enough support and confidence become rules.  Tokens of exactly the same
labelled pages are mined as one item, which any of them stands for.  A URL is blocked if it holds all items of some
rule.  Matching goes through an index on each rule's rarest item: only URLs that hold it are compared.  Stated host and path rules stand above the mined ones; the longest that fits decides.

DataFrame functions only: mining, matching and verdicts run in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanin.llm.common import documents, materialise, numbered

#: The stated rules: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_COUNT = 20            # labelled pages that show a rule, however many there are in all
MIN_CONFIDENCE = 0.8
BLOCK_ITEM, ALLOW_ITEM = "label=block", "label=allow"       # tokens begin with their kind, so none equals a label
INDEX_BYTES = 4 << 20     # a rule index estimated below this is broadcast; a larger one is joined by shuffle


def url_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (after the first ``://``, A-Z lower-cased) and path (up to ``?`` or ``#``); both empty for a null URL
    or one without ``://``."""
    url = F.col(f"`{url_col}`")
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": lower, "path": path})


def stated_verdict(rules: Sequence[tuple[str, str, str]] = RULES):
    """(rule, verdict) of the longest stated rule that fits host and path, as a struct; null if none does.
    The rules are a short constant list; a rule's length is its host's and path's, ties going to the longer host."""
    order = sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), reverse=True)
    out = None
    for host, path, verdict in order:
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def tokens():
    """The distinct tokens of a URL: host labels, path segments, and the words of those that hold several."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    parts = F.filter(F.split(F.lower("path"), "/"), lambda x: x != "")
    joined = F.filter(F.concat(labels, parts), lambda x: F.rlike(x, F.lit(r"[\p{L}\p{N}][^\p{L}\p{N}]+[\p{L}\p{N}]")))
    words = F.filter(F.split(F.array_join(joined, " "), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.array_distinct(F.concat(*[F.transform(xs, lambda x, kind=kind: F.concat(F.lit(kind), x))
                                       for kind, xs in (("host:", labels), ("path:", parts), ("word:", words))]))


def token_classes(baskets: DataFrame, min_count: int) -> DataFrame:
    """(rep, members, n): the tokens that at least ``min_count`` baskets (basket, tokens) hold, those of exactly the same n
    baskets as one class.  Sets that look equal by count and two hashes are compared basket by basket; a class that
    turns out unequal falls into single tokens."""
    each = baskets.select("basket", F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("basket")).alias("h"),
                                     F.bit_xor(F.xxhash64(F.lit("second"), "basket")).alias("g")).filter(F.col("n") >= min_count)
    alike = held.groupBy("n", "h", "g").agg(F.array_sort(F.collect_list("token")).alias("members"))
    alike = materialise(alike.select(F.col("members")[0].alias("rep"), "members", "n"), "classes")
    several = alike.filter(F.size("members") > 1).select("rep", F.size("members").alias("size"), F.explode("members").alias("token"))
    seen = each.join(several, "token").groupBy("rep", "basket").agg(F.count(F.lit(1)).alias("held"), F.first("size").alias("size"))
    unequal = seen.filter(F.col("held") != F.col("size")).select("rep").distinct().withColumn("apart", F.lit(True))
    parts = F.when(F.col("apart"), F.transform("members", lambda x: F.array(x))).otherwise(F.array("members"))
    out = alike.join(unequal, "rep", "left").select(F.explode(parts).alias("members"), "n")
    return materialise(out.select(F.col("members")[0].alias("rep"), "members", "n"), "classes")


def mine_rules(baskets: DataFrame, min_support: float = 0.0, min_confidence: float = MIN_CONFIDENCE,
               min_count: int = MIN_COUNT) -> DataFrame:
    """(rule_id, items, confidence, support) from rows (tokens, blocked boolean).  ``min_support`` is a share that a caller
    may ask for above ``min_count``.

    Tokens of exactly the same baskets are one item, as every combination of them has the same counts: pages that share
    a long template are mined like pages that share one token.  An item of a rule is the array of its tokens, any of
    which stands for it; the rarest item comes first.  Support is pruned inside FP-growth, which runs distributed over
    item groups.  Confidence is the count of a combination with the block item over its count in all, both from the
    same run."""
    spark = baskets.sparkSession
    baskets = materialise(baskets.select(F.array_distinct("tokens").alias("tokens"), "blocked", F.monotonically_increasing_id().alias("basket")), "baskets")
    n = baskets.count()
    min_count = max(1, min_count, math.ceil(min_support * n))
    none = spark.createDataFrame([], "rule_id string, items array<array<string>>, confidence double, support long")
    if n < min_count:
        return none
    classes = token_classes(baskets, min_count)
    names = classes.select("rep", F.explode("members").alias("token"))
    label = F.when(F.col("blocked"), F.lit(BLOCK_ITEM)).otherwise(F.lit(ALLOW_ITEM))
    items = baskets.select("basket", label.alias("label"), F.explode("tokens").alias("token")).join(names, "token")
    items = items.groupBy("basket", "label").agg(F.collect_set("rep").alias("items"))
    items = materialise(items.select(F.array_append("items", F.col("label")).alias("items")), "baskets")
    n = items.count()
    if n < min_count:
        return none
    # half a basket below, so that rounding moves no count over the bound
    model = FPGrowth(itemsCol="items", minSupport=(min_count - 0.5) / n, minConfidence=min_confidence).fit(items)
    freq = materialise(model.freqItemsets, "itemsets")       # else each use would mine again
    block = freq.filter(F.array_contains("items", BLOCK_ITEM) & (F.col("freq") >= min_count)).select(
        F.array_sort(F.array_remove("items", BLOCK_ITEM)).alias("reps"), F.col("freq").alias("hits"))
    block = block.filter(F.size("reps") > 0)
    rest = freq.select(F.array_sort("items").alias("reps"), "freq")
    rules = block.join(rest, "reps").withColumn("confidence", F.col("hits") / F.col("freq")).filter(F.col("confidence") >= min_confidence)
    rules = rules.select(F.sha2(F.concat_ws("\u0001", "reps"), 256).alias("rule_id"), "reps", "confidence", F.col("hits").alias("support"))
    each = rules.select("rule_id", "confidence", "support", F.explode("reps").alias("rep")).join(classes, "rep")
    each = each.groupBy("rule_id", "confidence", "support").agg(F.array_sort(F.collect_list(F.struct("n", "members"))).alias("items"))
    return materialise(each.select("rule_id", F.col("items.members").alias("items"), "confidence", "support"), "rules")


def match_rules(urls: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """(id, confidence) of the URLs (id, tokens) that hold a token of each item of some rule: an inverted index from the
    tokens of each rule's first item, its rarest among the labelled pages, to the rule, so a URL meets only rules whose
    rarest item it has."""
    index = rules.select(F.explode(F.col("items")[0]).alias("token"), "items", "confidence")
    held = urls.select(F.col(id_col).alias("id"), "tokens", F.explode("tokens").alias("token"))
    size = index.agg(F.coalesce(F.sum(F.length(F.to_json("items")) + 64), F.lit(0))).first()[0]
    if size <= INDEX_BYTES:
        index = F.broadcast(index)
    found = held.join(index, "token").filter(F.forall("items", lambda x: F.arrays_overlap(x, F.col("tokens"))))
    return found.groupBy("id").agg(F.max("confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
                rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: id, host, path, rule (stated rule or null), verdict, confidence (of the mined rule, or null).

    A labelled page is one whose id is a label's doc_id; it counts as blocked if its quality is 0 or it is toxic, a null
    label counting as neither; labels of one id that disagree block.  A null URL has no tokens and is allowed;
    repeated rows are judged one by one; without labels no rule is mined; an empty table gives an empty result."""
    rows = numbered(pages, "_row", [id_col, url_col]).select(F.col("_row").alias("rid"), F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"))
    rows = url_parts(rows).drop("url").withColumn("stated", stated_verdict(rules)).withColumn("tokens", tokens())
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("blocked"))
    baskets = rows.join(known, rows.page == known.doc_id).select("tokens", "blocked")
    found = match_rules(rows.filter("stated is null").select("rid", "tokens"), mine_rules(baskets), "rid")
    out = rows.join(found, rows.rid == found.id, "left")
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page", "host", "path", F.col("stated.rule").alias("rule"),
                      F.coalesce("stated.verdict", mined).alias("verdict"), "confidence")


def op2_url_filter(spark, sf_dir):
    out = filter_urls(documents(spark, sf_dir, "pages"), documents(spark, sf_dir, "labels"))
    return out.withColumnRenamed("page", "page_id")
