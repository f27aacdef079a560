"""Exact dedup by deterministic block naming.

Each text is normalised and cut into blocks of ``block`` bytes.  Equal blocks get one integer
name (the smallest id of their occurrences), then adjacent pairs of names are named in the same way,
level by level, until each document is one name.  Two documents have the same (level, name) exactly if
their texts are equal: a name stands for one block or one pair, never for a hash.

One level shuffles its blocks or pairs once; hot blocks and hot pairs do not meet in one task
(``common.grouped``).  Rows shrink by half from level to level, and a document leaves as soon
as it is one name, so the levels are as many as log2 of the longest document's blocks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanin.llm.common import documents, fresh, grouped, map_text, materialise, numbered, ship

BLOCK = 4096             # bytes


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 with every run of white space as one space (a null text is empty)."""
    raw = (text or "").encode("utf-8", "replace")
    words = b" ".join(raw.split())
    if not words:
        return b" " if raw else b""
    return b" " * raw[:1].isspace() + words + b" " * raw[-1:].isspace()


def _blocks(docs: DataFrame, id_col: str, text_col: str, block: int, row: str | None) -> DataFrame:
    """One row per block: rid (the row), bid (the block, unique), pos, n (the row's blocks), doc, sha (at pos 0).
    Rows without a number in a column ``row`` get one that is fixed once the blocks are written."""
    def make():
        def run(texts):
            index, sha, n, pos, blocks = [], [], [], [], []
            for i, text in enumerate(texts):
                raw = normalised(text)
                parts = [raw[at:at + block] for at in range(0, len(raw), block)] or [b""]
                index += [i] * len(parts)
                sha += [hashlib.sha256(raw).hexdigest()] + [None] * (len(parts) - 1)
                n += [len(parts)] * len(parts)
                pos += range(len(parts))
                blocks += parts
            return index, [sha, n, pos, blocks]
        return run

    rid = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(rid.alias("rid"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = map_text(rows, "text", make, "sha string, n int, pos int, block binary", ["rid", "doc"])
    return rows.withColumn("bid", F.monotonically_increasing_id())


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, row: str | None = None) -> DataFrame:
    """(rid, doc, sha, level, name) per input row; rows with equal normalised texts share (level, name)."""
    rows = materialise(_blocks(docs, id_col, text_col, block, row), "blocks")
    nodes = materialise(grouped(rows, ["block"], {"name": F.min("bid")}).drop("block"), "names")
    most, left = nodes.agg(F.coalesce(F.max("n"), F.lit(1)), F.count_if(F.col("n") > 1)).first()
    done, level = nodes.filter("n = 1").select("rid", "doc", "sha", F.lit(0).alias("level"), "name"), 0
    while most > 1:
        level += 1
        pairs = (nodes.filter("n > 1").groupBy("rid", F.shiftright("pos", 1).alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"),
                      F.min("bid").alias("bid"), F.first("doc").alias("doc"), F.max("sha").alias("sha"),
                      F.ceil(F.first("n") / 2).cast("int").alias("n")))
        pairs = materialise(pairs, f"pairs{level}", left)
        nodes = materialise(grouped(pairs, ["l", "r"], {"name": F.min("bid")}).drop("l", "r"), f"names{level}", left)
        done = done.unionByName(nodes.filter("n = 1").select("rid", "doc", "sha", F.lit(level).alias("level"), "name"))
        most = (most + 1) // 2
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, row: str | None = None) -> DataFrame:
    """One row per input row: rid, doc, sha (of the normalised text), keep (doc of the row that stays),
    group_size, kept.  A null text counts as empty; of equal texts the row with the smallest non-null id
    stays, and of repeated rows with that id exactly one.  An empty table gives an empty result."""
    ident = identities(docs, id_col, text_col, block, row)
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "rid"))
    out = grouped(ident, ["level", "name"], {"f": first, "group_size": F.count(F.lit(1))})
    return out.select("rid", "doc", "sha", F.col("f.doc").alias("keep"), "group_size",
                      (F.col("rid") == F.col("f.rid")).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows that stay, with the input's columns."""
    row = fresh(docs, "_row")
    rows = numbered(docs, row)
    kept = exact_dedup(rows, id_col, text_col, block, row).filter("kept").select("rid")
    return rows.join(kept, rows[row] == kept["rid"], "left_semi").select(*docs.columns)


def op7_exact_dedup(spark, sf_dir):
    out = exact_dedup(documents(spark, sf_dir))
    return out.select(F.col("doc").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", "kept",
                      F.col("sha").alias("text_sha256"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

ship(__name__)
