"""Order-dependent building blocks that stay parallel when one key is huge.

Histories are ordered per key by ``(ts, id)``.  A key may hold a large share
of all rows, so nothing here gathers a key's history into one task or one
list:

* ``equal_rows`` / ``attach_chunk`` -- the rows in order of key, time and id cut
  into ranges of about ``target_rows`` rows each, so that a burst of one key in
  one second is cut like any other rows; or a fixed width of time, or
  ``chunk_table``'s slices of equal time per key.
* ``chunked_index`` -- per-row position within the key, from windows over
  ``(key, chunk)`` plus a running sum over the small per-chunk count table
  (the carry).
* ``next_after`` -- as-of lookup: for each probe, the first row strictly
  after a position ``(t, r)``; a descending running ``min`` inside each chunk,
  and the first row of the later chunks from the chunk table.
* ``orbit`` -- the nodes ``(key, id)`` reached from start nodes through a
  successor column, by pointer doubling: ``O(log L)`` self-joins for orbits of
  length ``L``, each level checkpointed to cut lineage.

Keys must not be NULL here; callers use ``safe_key``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fanin.session import ensure_checkpoint_dir

LONG_MIN = -(2 ** 63)
LONG_MAX = 2 ** 63 - 1


Chunks = "int | DataFrame"   # a fixed width in micros, or a per-key table (key, _t0, _w)

DEFAULT_TARGET_ROWS = 1_000_000


def chunk_table(rows: DataFrame, key: str, ts: str, target_rows: int = DEFAULT_TARGET_ROWS) -> DataFrame:
    """Per-key chunking: ``(key, _t0, _w)`` so that a key's chunks hold about ``target_rows`` rows.

    ``_w = ceil(span / ceil(n / target))``: a key with fewer than ``target_rows``
    rows is one chunk; a hot key is cut into ``n / target`` time slices.  One
    partial aggregate; the table has one row per key.
    """
    st = rows.groupBy(key).agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"), F.count(F.lit(1)).alias("_n"))
    pieces = F.ceil(F.col("_n") / F.lit(float(target_rows)))
    width = F.greatest(F.lit(1), F.ceil((F.col("_t1") - F.col("_t0") + F.lit(1)) / pieces)).cast("bigint")
    return st.select(key, "_t0", width.alias("_w"))


@dataclass(frozen=True)
class EqualRows:
    """Ranges of equal rows; ``parts`` of them over the log."""
    parts: int


def equal_rows(rows: DataFrame, target_rows: int = DEFAULT_TARGET_ROWS) -> EqualRows:
    """As many ranges as hold about ``target_rows`` rows each (one job counts the rows)."""
    return EqualRows(max(1, -(-rows.count() // target_rows)))


def ranged(df: DataFrame, order: tuple[str, ...], parts: int) -> DataFrame:
    """Add ``_c``, the range of a row among ``parts`` ranges of equal rows in this order (rows equal in all of ``order`` share
    one).  The ranges come from a sample, so the rows are written once with their range."""
    if parts == 1:
        return df.withColumn("_c", F.lit(0).cast("bigint"))
    ensure_checkpoint_dir(df.sparkSession)
    out = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    return out.withColumn("_c", F.spark_partition_id().cast("bigint")).checkpoint(eager=True)


def attach_chunk(df: DataFrame, key: str, t: Column, chunks, order: tuple[str, ...] = (), more: int = 1) -> DataFrame:
    """Add ``_c``, the chunk of a row: of time ``t`` (fixed width, or the key's own width from ``chunk_table``), or its range
    by key and ``order`` (``EqualRows``; ``more`` times as many rows as the log has)."""
    if isinstance(chunks, EqualRows):
        return ranged(df, (key, *order), chunks.parts * more if chunks.parts > 1 else 1)
    if isinstance(chunks, int):
        return df.withColumn("_c", F.floor(t / F.lit(chunks)).cast("bigint"))
    j = df.join(chunks, key)
    return j.withColumn("_c", F.floor((t - F.col("_t0")) / F.col("_w")).cast("bigint")).drop("_t0", "_w")


def chunked_index(df: DataFrame, key: str, ts: str, rid: str, chunks) -> DataFrame:
    """Add ``_c`` (chunk), ``_l`` (0-based index in key and chunk), ``_off`` (rows of the key in
    earlier chunks); the global index is ``_off + _l``."""
    c = attach_chunk(df, key, F.col(ts), chunks, (ts, rid))
    local = c.withColumn("_l", (F.row_number().over(Window.partitionBy(key, "_c").orderBy(ts, rid)) - 1).cast("bigint"))
    counts = c.groupBy(key, "_c").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(key, "_c", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).cast("bigint").alias("_off"))
    return local.join(offs, [key, "_c"])


def next_after(rows: DataFrame, probes: DataFrame, key: str, chunks) -> DataFrame:
    """For each probe ``(key, pid, t, r)``: ``nxt`` = id of the first row ``(key, ts, rid)`` with
    ``(ts, rid) > (t, r)``, or NULL.

    Use ``r = LONG_MAX`` for "ts > t" and ``r = LONG_MIN`` for "ts >= t".
    """
    real = rows.select(key, F.col("ts").alias("_t"), F.col("rid").alias("_r"), F.lit(0).alias("_k"),
                       F.lit(None).cast("bigint").alias("pid"))
    prb = probes.select(key, F.col("t").alias("_t"), F.col("r").alias("_r"), F.lit(1).alias("_k"), "pid")
    both = attach_chunk(real.unionByName(prb), key, F.col("_t"), chunks, ("_t", "_r", "_k"), 2)
    desc = (Window.partitionBy(key, "_c").orderBy(F.col("_t").desc(), F.col("_r").desc(), F.col("_k").desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pos = F.struct(F.col("_t").alias("t"), F.col("_r").alias("r"))
    scanned = both.withColumn("_in", F.min(F.when(F.col("_k") == 0, pos)).over(desc)).filter(F.col("_k") == 1)
    # first row of every later chunk; the chunk table lists the probes' chunks too,
    # so a probe in a chunk without rows still finds its fallback
    firsts = both.groupBy(key, "_c").agg(F.min(F.when(F.col("_k") == 0, pos)).alias("_f"))
    later = Window.partitionBy(key).orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = firsts.select(key, "_c", F.min("_f").over(later).alias("_later"))
    out = scanned.join(carry, [key, "_c"], "left")
    return out.select(key, "pid", F.coalesce(F.col("_in"), F.col("_later"))["r"].alias("nxt"))


def safe_key(key: str) -> Column:
    """The key as text that is never NULL, so that rows without a key form one history of their own."""
    c = F.col(key)
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def previous_ts(rows: DataFrame, key: str, chunks) -> DataFrame:
    """``(key, ts, rid)`` with ``prev``, the time of the row before it in its key (NULL for the first)."""
    c = attach_chunk(rows, key, F.col("ts"), chunks, ("ts", "rid"))
    inside = c.withColumn("_p", F.lag("ts").over(Window.partitionBy(key, "_c").orderBy("ts", "rid")))
    ends = c.groupBy(key, "_c").agg(F.max("ts").alias("_e"))
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(key, "_c", F.max("_e").over(before).alias("_b"))
    return inside.join(carry, [key, "_c"]).select(key, "ts", "rid", F.coalesce("_p", "_b").alias("prev"))


def orbit(succ: DataFrame, starts: DataFrame, key: str, max_levels: int = 64) -> DataFrame:
    """``(key, id)`` reached from ``starts(key, id)`` by repeatedly following ``succ(key, id, nxt)`` (starts included).

    Nodes are identified by key and id together.  Level k holds
    ``id -> nxt^(2^k)(id)``; levels are built until no jump is left, then
    walked back down: after level k the set holds every orbit position that is
    a multiple of 2^k.  Orbits of different starts must not meet.
    """
    spark = succ.sparkSession
    ensure_checkpoint_dir(spark)

    def materialise(df: DataFrame) -> tuple[DataFrame, int]:
        # one job per level: the checkpoint write also counts the jumps left
        obs = Observation()
        out = df.observe(obs, F.count("j").alias("jumps")).checkpoint(eager=True)
        return out, obs.get["jumps"]

    level, jumps = materialise(succ.select(key, "id", F.col("nxt").alias("j")).filter("j IS NOT NULL"))
    levels = [level]
    while jumps and len(levels) < max_levels:
        b = level.select(F.col(key).alias("_bk"), F.col("id").alias("_bi"), F.col("j").alias("_bj"))
        nxt = level.join(b, (F.col(key) == F.col("_bk")) & (F.col("j") == F.col("_bi"))).select(key, "id", F.col("_bj").alias("j"))
        level, jumps = materialise(nxt)
        levels.append(level)
    reached = starts.select(key, "id")
    for lvl in reversed(levels[:-1] if len(levels) > 1 else levels):
        jumped = reached.join(lvl, [key, "id"]).select(key, F.col("j").alias("id"))
        reached = reached.unionByName(jumped).checkpoint(eager=True)
    return reached
