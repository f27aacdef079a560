"""Merkle manifest of a table with a tree of SHA-256 states.

A row's leaf is the hash of its fields.  Per source the leaves ascend by id and every three consecutive nodes become
their parent's hash, level by level, until one node remains; the sources' nodes give the table's root likewise.

Positions come from a range partitioning by (source, id) and prefix sums over the partitions' counts, so a source that
holds a third of all rows is spread like any other.  A block is 3^6 consecutive positions: six levels are built in one
task at a time, and the block's node is a leaf of the next pass.  Paths go down the same blocks.  In a block every
parent retains its hash state before each child slot; a row is folded by copying the state of its slot and hashing the
replacement and the right siblings only, never the left ones.

Nulls: a null field is hashed as ``-``; a null source is a group of its own, before all others; null ids come first.
Repeated ids are ordered by their leaf, so that equal rows are interchangeable.  An empty table gives an empty result.
Memory: a task holds one block of at most 729 rows of digests, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanin.llm.common import documents, materialise, ship

FAN = 3
LEVELS = 6
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_A_PART = 1_000_000


def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def digest(parts: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


class Tree:
    """The levels of one block.  ``states[k][i]``: of the i-th parent on level k + 1, the hash states before each of its
    child slots; ``right[k][i]``: the digests right of each slot."""

    def __init__(self, leaves: list[bytes], levels: int):
        self.levels, self.states, self.right = [leaves], [], []
        for _ in range(levels):
            below, states, right, above = self.levels[-1], [], [], []
            for at in range(0, len(below), FAN):
                run, state, before = below[at:at + FAN], hashlib.sha256(), []
                for child in run:
                    before.append(state.copy())
                    state.update(child)
                states.append(before)
                right.append([b"".join(run[j + 1:]) for j in range(len(run))])
                above.append(state.hexdigest().encode())
            self.levels.append(above)
            self.states.append(states)
            self.right.append(right)

    def fold(self, at: int, node: bytes) -> bytes:
        """The block's node if the leaf at ``at`` were ``node``."""
        for states, right in zip(self.states, self.right, strict=True):
            at, slot = divmod(at, FAN)
            state = states[at][slot].copy()
            state.update(node)
            state.update(right[at][slot])
            node = state.hexdigest().encode()
        return node

    def path(self, at: int) -> list[str]:
        """Per level the slot and the siblings' digests, as text."""
        out = []
        for level in self.levels[:-1]:
            up, slot = divmod(at, FAN)
            run = level[up * FAN:up * FAN + FAN]
            out.append(str(slot) + b"".join(run[:slot] + run[slot + 1:]).decode())
            at = up
        return out


class Path:
    """The way from a block's node to the root: its states before the slots, and what is right of them."""

    def __init__(self, levels: Sequence[str]):
        self.steps, self.siblings = [], []
        for level in levels:
            slot, rest = int(level[0]), level[1:].encode()
            self.steps.append((hashlib.sha256(rest[:64 * slot]), rest[64 * slot:]))
            self.siblings.append(rest)

    def fold(self, node: bytes) -> bytes:
        for state, right in self.steps:
            state = state.copy()
            state.update(node)
            state.update(right)
            node = state.hexdigest().encode()
        return node


def levels_of(n: int) -> int:
    """Levels that a block of a group of ``n`` nodes has: all, or as many as leave one node of the group."""
    if n > BLOCK:
        return LEVELS
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def _column(table: pa.Table, name: str) -> list[bytes]:
    return [x.encode() for x in table.column(name).to_pylist()]


def _block_node(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    n, g, blk = (table.column(c)[0].as_py() for c in ("n", "g", "blk"))
    top = Tree(_column(table, "digest"), levels_of(n)).levels[-1][0]
    return pa.table({"g": [g], "pos": pa.array([blk], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": [top.decode()]})


def _down(nodes: pa.Table, above: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("pos")
    tree = Tree(_column(nodes, "digest"), levels_of(nodes.column("n")[0].as_py()))
    rest = above.column("path")[0].as_py()
    paths = [tree.path(i) + rest for i in range(nodes.num_rows)]
    same = lambda c: pa.array([above.column(c)[0].as_py()] * nodes.num_rows, pa.string())
    return pa.table({"g": nodes.column("g"), "pos": nodes.column("pos"), "path": pa.array(paths, pa.list_(pa.string())),
                     "subroot": same("subroot"), "root": same("root")})


def _leaves(rows: pa.Table, above: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos")
    leaves, other = _column(rows, "digest"), _column(rows, "other")
    tree = Tree(leaves, levels_of(rows.column("n")[0].as_py()))
    up = Path(above.column("path")[0].as_py())
    subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
    proof, folded = [], []
    for i, node in enumerate(other):
        own = [level[1:].encode() for level in tree.path(i)]
        proof.append(digest(own + up.siblings).decode())
        folded.append(up.fold(tree.fold(i, node)).decode())
    n = rows.num_rows
    return pa.table({"id": rows.column("id"), "source": rows.column("source"), "leaf": rows.column("digest"), "subroot": [subroot] * n, "root": [root] * n,
                     "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]})


def placed(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``rows`` (a written table with a group ``g``, never null) with pos, the row's place in its group by ``order``, and
    n, the group's rows.  Only one row per partition and group meets in the prefix sums."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_PART))
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order)]
    out = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    out = materialise(out.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), label)
    counts = out.groupBy("g", "part").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("g", "part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("lo")).alias("shift"),
                           F.sum("c").over(Window.partitionBy("g")).alias("n"))
    return out.join(counts, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("blk", F.floor(F.col("pos") / BLOCK))


NODES = "g string, pos long, n long, digest string"
PATHS = "g string, pos long, path array<string>, subroot string, root string"


def _passes(nodes: DataFrame, label: str) -> list[DataFrame]:
    """``nodes`` and what each pass makes of them; the last has one node per group."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rows = _blocks(out[-1].select("g", "pos", "n", "digest"))
        out.append(materialise(rows.groupBy("g", "blk").applyInArrow(_block_node, NODES), f"{label}{len(out)}"))
        most = -(-most // BLOCK)
    return out


def _lower(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of ``nodes`` from those of their blocks."""
    rows = _blocks(nodes.select("g", "pos", "n", "digest"))
    above = paths.withColumn("blk", F.col("pos"))
    return rows.groupBy("g", "blk").cogroup(above.groupBy("g", "blk")).applyInArrow(_down, PATHS)


def merkle_manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source",
                    seen: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, source, leaf, subroot (of its source), root (of the table), proof_sha256, folded_root, verified.

    ``fields`` are hashed in this order; ``seen`` gives, per field, the value found later in place of the recorded one:
    the row's folded root is recomputed from it and its recorded siblings, and ``verified`` tells if the root is met.
    Without ``seen`` every row verifies."""
    now = [(seen or {}).get(f, F.col(f"`{f}`")) for f in fields]
    source = F.col(f"`{source_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("g"),
                       leaf_hash([F.col(f"`{f}`") for f in fields]).alias("digest"), leaf_hash(now).alias("other"))
    rows = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "leaves")
    leaves = materialise(placed(rows, ["id", "digest", "rid"], "placed").drop("rid"), "positions")

    ups = _passes(leaves, "nodes")
    tops = materialise(ups[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest"), "subroots")
    sources = materialise(placed(tops, ["name"], "sources"), "order")
    tree = _passes(sources, "above")
    paths = tree[-1].select("g", "pos", F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(tree[:-1]):
        paths = _lower(nodes, paths)
    paths = (paths.join(sources.select("pos", "name", "digest"), "pos")
             .select(F.col("name").alias("g"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root"))
    paths = materialise(paths, "paths")
    for k, nodes in reversed(list(enumerate(ups[1:-1]))):
        paths = materialise(_lower(nodes, paths), f"paths{k}")
    rows = _blocks(leaves.select("g", "pos", "n", "digest", "other", "id", "source"))
    schema = f"id {docs.select(F.col(f'`{id_col}`').alias('id')).dtypes[0][1]}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    above = paths.withColumn("blk", F.col("pos"))
    return rows.groupBy("g", "blk").cogroup(above.groupBy("g", "blk")).applyInArrow(_leaves, schema)


def op12_merkle_manifest(spark, sf_dir):
    """``documents``; a text whose decimal id has an even crc32 is seen without its line feeds.  A null id is not tampered with."""
    docs = documents(spark, sf_dir)
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    seen = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    out = merkle_manifest(docs, seen=seen)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def crc32_sql(s: str) -> str:
    """DuckDB's expression for the unsigned crc32 of an ASCII string."""
    return f"""xor(list_reduce(list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295::BIGINT)"""


def _field_sql(x: str) -> str:
    return f"coalesce(octet_length(encode(({x})::VARCHAR)) || ':' || ({x})::VARCHAR, '-')"


#: Two trees by recursion over levels; a leaf's way to the root holds the digests left and right of it.  Ids are unique.
OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({' || '.join(_field_sql(f) for f in FIELDS)}) AS leaf,
         CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 2 = 0
              THEN sha256({' || '.join(_field_sql("replace(text, chr(10), '')" if f == 'text' else f) for f in FIELDS)}) END AS other
  FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos,
                  count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM d),
low AS (
  SELECT g, 0 AS lvl, pos::BIGINT AS pos, n::BIGINT AS n, leaf AS digest FROM leaves
  UNION ALL
  SELECT g, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, lvl, pos // 3, n),
top AS (
  SELECT 0 AS lvl, g::BIGINT AS pos, (SELECT count(DISTINCT source) + count(DISTINCT CASE WHEN source IS NULL THEN 1 END) FROM d)::BIGINT AS n, digest FROM low WHERE n = 1
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
low_runs AS (SELECT g, lvl, pos // 3 AS run, list(digest ORDER BY pos) AS kids FROM low WHERE n > 1 GROUP BY g, lvl, pos // 3),
top_runs AS (SELECT lvl, pos // 3 AS run, list(digest ORDER BY pos) AS kids FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
steps AS (
  SELECT doc_id, r.lvl, kids, (pos // (3 ** r.lvl)::BIGINT) % 3 AS slot FROM leaves l JOIN low_runs r ON r.g = l.g AND r.run = l.pos // (3 ** (r.lvl + 1))::BIGINT
  UNION ALL
  SELECT doc_id, 1000 + r.lvl, kids, (l.g // (3 ** r.lvl)::BIGINT) % 3 FROM leaves l JOIN top_runs r ON r.run = l.g // (3 ** (r.lvl + 1))::BIGINT),
ways AS (SELECT doc_id, list({{'l': l, 'r': r}} ORDER BY lvl) AS way, string_agg(l || r, '' ORDER BY lvl) AS sib
         FROM (SELECT doc_id, lvl, array_to_string(kids[1:slot], '') AS l, array_to_string(kids[slot + 2:], '') AS r FROM steps) GROUP BY doc_id),
out AS (
  SELECT l.doc_id, leaf, s.digest AS subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(coalesce(sib, '')) AS proof_sha256,
         list_reduce(list_transform(coalesce(way, []), lambda w: [w.l, w.r]), lambda a, w: [sha256(w[1] || a[1] || w[2])], [coalesce(other, leaf)])[1] AS folded_root
  FROM leaves l LEFT JOIN ways w ON w.doc_id = l.doc_id JOIN low s ON s.g = l.g AND s.n = 1)
SELECT *, folded_root = root AS verified FROM out
"""

ship(__name__)
