"""SimHash near-dedup over a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 2-bit segments, at even and at odd offsets.  Flipping one
bit moves one count of either vector by one, so the Manhattan distance of either vector is at most the bit
distance.  Candidates come from a grid over these vectors: the fingerprint is cut into six blocks of segments, at
most three of which can differ within distance 3, so two linked fingerprints share the cell of at least one choice
of three blocks, a cell being the counts of all segments inside those blocks.  Candidates within the distance in
both vectors are verified by their exact bit distance.

Documents of one fingerprint are one node.  A cell with more than ``MAX_CELL`` fingerprints is not paired but cut
by the same rule over its remaining bits, until a cell holds few fingerprints by the size of its key alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanin.llm.common import documents, fresh, join_back, map_text, materialise, numbered, ship
from fanin.llm.components import components

SHINGLE = 3
MAX_DISTANCE = 3
SEED = 42
MAX_CELL = 256
EVEN = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer; a null text or one without words has 0."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 14):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), SEED) for i in range(lo, min(n, lo + (1 << 14)))]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, keep=None) -> DataFrame:
    """Adds ``fp``, the fingerprint as a signed long."""
    def make():
        return lambda texts: (None, [[_signed(fingerprint(t, shingle)) for t in texts]])
    return map_text(docs, text_col, make, "fp long", keep)


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    """Runs of 2-bit segments, as even as they can be."""
    pairs = [bits[i:i + 2] for i in range(0, len(bits), 2)]
    at = [len(pairs) * i // parts for i in range(parts + 1)]
    return [sum(pairs[a:b], []) for a, b in zip(at, at[1:], strict=False)]


def grid_masks(fixed: int, distance: int = MAX_DISTANCE) -> list[int]:
    """The bits that a cell fixes, for every choice of blocks of the bits not in ``fixed``."""
    free = [b for b in range(64) if not fixed >> b & 1]
    parts = 2 * distance
    blocks = [sum(1 << b for b in part) for part in _cut(free, parts)]
    return [fixed | sum(c) for c in combinations(blocks, parts - distance)]


def _counts(fp, shift: int):
    """Per 2-bit field, the count of the segment that begins ``shift`` bits into it."""
    a = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit(EVEN))
    b = F.shiftrightunsigned(fp, shift + 1).bitwiseAND(F.lit(EVEN))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))       # their sum per field, without carries


def _fields(mask: int, shift: int) -> int:
    """The fields of ``_counts`` both of whose bits lie in ``mask``."""
    out = 0
    for i in range(32):
        a = 2 * i + shift
        if a + 1 < 64 and mask >> a & 1 and mask >> (a + 1) & 1:
            out |= 3 << 2 * i
    return out


def _manhattan(a, b):
    """Manhattan distance of two vectors of 2-bit counts (0 to 2): fields differ by 1 if their low bits differ."""
    x = a.bitwiseXOR(b)
    low = x.bitwiseAND(F.lit(EVEN))
    high = F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(EVEN)).bitwiseAND(F.bitwise_not(low))
    return F.bit_count(low) + 2 * F.bit_count(high)


def _cells(rows: DataFrame, masks: list[int]) -> DataFrame:
    """rows (fp) in each of their cells that hold more than one fingerprint: mask, even, odd, fp, n."""
    grid = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(_fields(m, 0))).alias("me"),
                              F.lit(_signed(_fields(m, 1))).alias("mo")) for m in masks])
    out = rows.withColumn("e", _counts(F.col("fp"), 0)).withColumn("o", _counts(F.col("fp"), 1))
    out = out.withColumn("g", F.explode(grid))
    out = out.select(F.col("g.mask").alias("mask"), F.col("e").bitwiseAND(F.col("g.me")).alias("even"),
                     F.col("o").bitwiseAND(F.col("g.mo")).alias("odd"), "fp")
    size = Window.partitionBy("mask", "even", "odd")
    return out.withColumn("n", F.count(F.lit(1)).over(size)).filter("n > 1")


def _pairs(cells: DataFrame, distance: int) -> DataFrame:
    a = cells.select("mask", "even", "odd", F.col("fp").alias("u"))
    b = cells.select("mask", "even", "odd", F.col("fp").alias("v"))
    u, v = F.col("u"), F.col("v")
    near = a.join(b, ["mask", "even", "odd"]).filter(u < v)
    near = near.filter((_manhattan(_counts(u, 0), _counts(v, 0)) <= distance) & (_manhattan(_counts(u, 1), _counts(v, 1)) <= distance))
    return near.filter(F.bit_count(u.bitwiseXOR(v)) <= distance).select("u", "v").distinct()


def linked(fps: DataFrame, distance: int = MAX_DISTANCE, max_cell: int = MAX_CELL, depth: int = 3) -> DataFrame:
    """(u, v), u < v: the pairs of distinct fingerprints ``fp`` within ``distance`` bits."""
    masks = grid_masks(0, distance)
    cells = materialise(_cells(fps.select("fp"), masks), "cells", len(masks) * fps.count())
    out = _pairs(cells.filter(F.col("n") <= max_cell), distance)
    for level in range(1, depth):
        # a full cell's members, cut again by its own remaining bits; three levels leave eight free bits
        full = cells.filter(F.col("n") > max_cell)
        crowded = [r["mask"] for r in full.select("mask").distinct().collect()]     # at most as many as there are masks
        if not crowded:
            return out
        deeper = None
        for mask in crowded:
            part = full.filter(F.col("mask") == mask).select("fp").distinct()
            rows = _cells(part, grid_masks(mask & (1 << 64) - 1, distance))
            deeper = rows if deeper is None else deeper.unionAll(rows)
        cells = materialise(deeper, "cells")
        out = out.unionAll(_pairs(cells if level == depth - 1 else cells.filter(F.col("n") <= max_cell), distance))
    return out


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
              distance: int = MAX_DISTANCE, row: str | None = None) -> DataFrame:
    """One row per input row: rid (its number in a column ``row``, if that is given), doc, fp, component (smallest id reachable over links), kept.

    A null or empty text has fingerprint zero and is linked like any other; null ids take part and are never a
    component's id unless all its ids are null; of repeated rows exactly one is kept; an empty table gives an
    empty result."""
    rid = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(rid.alias("rid"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = materialise(with_fingerprints(rows, "text", shingle, ["rid", "doc"]), "fingerprints")
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "rid"))
    nodes = rows.groupBy("fp").agg(first.alias("f"), F.count(F.lit(1)).alias("w"))
    nodes = materialise(nodes, "nodes", rows.count())
    roots = components(linked(nodes, distance))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    nodes = nodes.select("fp", "f", "w", "root")
    groups = nodes.groupBy("root").agg(F.min("f").alias("g"), F.count(F.lit(1)).alias("many"))
    nodes = join_back(nodes, groups, ["root"], "many", F.bitwise_not("fp")).select("fp", "w", "g")
    out = join_back(rows, nodes, ["fp"], "w", F.bitwise_not("rid"))
    return out.select("rid", "doc", "fp", F.col("g.doc").alias("component"), (F.col("rid") == F.col("g.rid")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     distance: int = MAX_DISTANCE) -> DataFrame:
    """One row of each group stays, with the input's columns."""
    row = fresh(docs, "_row")
    rows = numbered(docs, row)
    kept = near_dups(rows, id_col, text_col, shingle, distance, row).filter("kept").select("rid")
    return rows.join(kept, rows[row] == kept["rid"], "left_semi").select(*docs.columns)


def op5_simhash_near_dedup(spark, sf_dir):
    out = near_dups(documents(spark, sf_dir))
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))


ship(__name__)
