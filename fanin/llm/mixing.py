"""Mixing sources to target weights.

Every document gets a hash-random key and is ranged by it within its source: the key's leading digits are
the range, so a source's rows spread evenly over ``16 ** RANGE_DIGITS`` ranges however hot the source is.
Prefix sums are distributed: word sums per (source, range), their prefix per source, then a running sum
inside each range.  A source whose target exceeds its size repeats whole epochs; the last epoch is cut at the
exact budget, inside a document if need be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanin.llm.common import WORD_RE, documents

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
RANGE_DIGITS = 3
SEED = "mix-1"


def with_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``size``, the number of words of the whole text (null: 0)."""
    return docs.withColumn("size", F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD_RE)).cast("long"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(sn, sv, source_size, target) per source, from rows with sn (1 for a null source), sv and size.

    One row per source takes part.  With sources in rising order of cap / weight, the sources before some
    point are at their cap and the others share what is left by weight; that point is found from running
    sums.  A source of size 0 has target 0."""
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.col("rn") % len(weights) + 1).cast("int"))
    per = sizes.groupBy("sn", "sv").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rn", F.row_number().over(Window.orderBy("sn", "sv")) - 1).withColumn("w", w)
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("w"), "rn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.select("*", F.sum("source_size").over(every).alias("total"),
                     F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"), F.sum("w").over(after).alias("wleft"))
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("wleft"))
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    # levels rise up to the first one that fits, which is the right one, and fall after it
    per = per.withColumn("lam", F.max(fits).over(every))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("lam") * F.col("w"), F.col("cap").cast("double")))
    return per.select("sn", "sv", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The input's rows with size, source_size, target, epochs (whole copies taken), part (words taken of one
    more copy) and taken (words in all).

    Nulls: a null source is a source of its own and comes last; a null text has size 0; a null id is keyed
    like an empty one.  Repeated rows are taken one by one.  An empty table gives an empty result."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    i, s, t = names[id_col], names[source_col], names[text_col]
    rows = with_sizes(rows, t).withColumn("sn", F.col(s).isNull().cast("int"))
    rows = rows.withColumn("sv", F.coalesce(F.col(s).cast("string"), F.lit("")))
    rows = rows.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.col(i).cast("string"))))
    rows = rows.withColumn("rng", F.substring("key", 1, RANGE_DIGITS))
    ranges = rows.groupBy("sn", "sv", "rng").agg(F.sum("size").alias("range_size"))
    up_to = Window.partitionBy("sn", "sv").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("sn", "sv", "rng", F.coalesce(F.sum("range_size").over(up_to), F.lit(0)).alias("range_start"))
    ranges = ranges.join(source_targets(rows.select("sn", "sv", "size"), weights, max_epochs), ["sn", "sv"])
    within = (Window.partitionBy("sn", "sv", "rng").orderBy("key", F.col(i), "size", F.xxhash64(t))
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("in_range", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(ranges, ["sn", "sv", "rng"])
    budget = F.round("target").cast("long")
    rows = rows.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    left = budget - F.col("epochs") * F.col("source_size") - F.col("range_start") - F.col("in_range")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    rows = rows.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))
    new = ["size", "source_size", "target", "epochs", "part", "taken"]
    return rows.select(*[F.col(n).alias(c) for c, n in names.items() if c not in new], *new)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves, with the input's columns: a row per copy taken, the copy that is cut
    holding its first words joined by single spaces.  Documents without words hold no tokens and are not taken."""
    rows = docs.toDF(*[f"_d{i}" for i in range(len(docs.columns))])
    i, s, t = (f"_d{docs.columns.index(c)}" for c in (id_col, source_col, text_col))
    plan = plan_mix(rows, i, s, t, weights, max_epochs, seed)
    cut = F.array_join(F.slice(F.regexp_extract_all(t, F.lit(WORD_RE), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    copies = F.concat(F.array_repeat(F.lit(False), F.col("epochs").cast("int")),
                      F.array_repeat(F.lit(True), F.when(F.col("part") > 0, 1).otherwise(0)))
    taken = plan.filter("taken > 0").withColumn("_cut", F.explode(copies))
    text = F.when(F.col("_cut") & (F.col("part") < F.col("size")), cut).otherwise(F.col(t))
    return taken.select(*[(text if c == t else F.col(c)).alias(c) for c in rows.columns]).toDF(*docs.columns)


def op6_mix_sources(spark, sf_dir):
    out = plan_mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(concat_ws('|', 'mix-1', CAST(doc_id AS VARCHAR))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
             coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wleft FROM s),
l AS (SELECT max((total - capped) / wleft) AS lam FROM r WHERE (total - capped) / wleft <= cap / w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(CAST(lam AS DOUBLE) * w, CAST(cap AS DOUBLE))) AS target FROM r, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size * size
            + greatest(0, least(size, budget % source_size - start)) ELSE 0 END AS BIGINT) AS taken
FROM p
"""
