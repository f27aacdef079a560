"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fanin.session import ensure_checkpoint_dir

#: A word: a run of anything but space and the five ASCII control spaces.
WORD_RE = r"[^\x20\x09-\x0D]+"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so that workers need no package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ROWS_A_FILE = 250_000      # of a narrow table


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once to a fresh folder under the cluster's shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors, and fixes what is not deterministic.  The shuffle files of
    the write are dropped once it is done, as nothing reads them any more.  ``rows``, a bound on the rows of a
    narrow table, keeps it from being many tiny files: it is written by one task per ``ROWS_A_FILE`` at most."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (default: all) and a row number ``name`` that every later scan gives again, however its
    splits are cut: a Parquet table's rows are numbered by file and place in it, any others written once with their number."""
    keep = [F.col(f"`{c}`") for c in (docs.columns if keep is None else dict.fromkeys(keep))]
    in_file, at, start = (fresh(docs, x) for x in ("_file", "_at", "_from"))
    place = None
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            meta = docs.metadataColumn("_metadata")
            place = docs.select(*keep, meta.getField("file_path").alias(in_file), meta.getField("row_index").alias(at))
        except AnalysisException:         # not Parquet files
            place = None
    if place is None:
        return materialise(docs.select(*keep, F.monotonically_increasing_id().alias(name)), "numbered")
    files = sorted(r[0] for r in place.select(in_file).distinct().collect())
    files = docs.sparkSession.createDataFrame([(f, i << 40) for i, f in enumerate(files)], f"{in_file} string, {start} long")
    return place.join(F.broadcast(files), in_file).select(*keep, (F.col(start) + F.col(at)).alias(name))


def join_back(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], weight: str, spread: Column,
              hot: int = 1024) -> DataFrame:
    """Join every row to its key's aggregate although one key may hold a third of all rows.

    ``per_key`` has one row per value of ``keys`` and its row count in ``weight``.  The ``hot`` keys
    with the most rows (a fixed number, hence a bounded broadcast) are looked up without a shuffle;
    every other key holds at most one part in ``hot`` of the rows and is met by an ordinary join.
    Rows of hot keys pass that join under the value ``spread`` in place of their first key: it must be
    of that key's type and differ from row to row (what it may match is not used).  ``keys`` must not be null.
    The weight column is dropped.
    """
    values = [c for c in per_key.columns if c not in keys and c != weight]
    top = per_key.orderBy(F.desc(weight), *keys).limit(hot)
    top = top.select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_h_{v}") for v in values],
                     F.lit(True).alias("_hot"))
    cond = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    marked = rows.join(F.broadcast(top), cond, "left").drop(*[f"_h_{k}" for k in keys])
    marked = marked.withColumn("_k", F.when(F.col("_hot"), spread).otherwise(F.col(keys[0])))
    # the weight's filter keeps both uses of the aggregate alike, so that its shuffle is run once
    rest = per_key.filter(F.col(weight) > 0).select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(v).alias(f"_r_{v}") for v in values])
    cond = [F.col("_k") == F.col(f"_r_{keys[0]}")] + [F.col(k) == F.col(f"_r_{k}") for k in keys[1:]]
    out = marked.join(rest, cond, "left")
    return out.select(*rows.columns, *[F.when(F.col("_hot"), F.col(f"_h_{v}")).otherwise(F.col(f"_r_{v}")).alias(v)
                                       for v in values])


def grouped(rows: DataFrame, keys: Sequence[str], aggs: dict[str, Column], hot: int = 1024, full: int = 1_000) -> DataFrame:
    """Every row with aggregates over its key's rows, although one key may hold a third of all rows.

    ``rows`` should be a written table; it is read a few times, but its wide columns are shuffled once.  Keys that
    have at least ``full`` rows and are among the ``hot`` most frequent are aggregated with map-side combining into a
    table of at most ``hot`` keys, which is broadcast; all others are met in windows, each of which holds at most
    ``full`` rows or one part in ``hot`` of them.  ``keys`` must not be null."""
    mark = F.xxhash64(*keys)
    counts = rows.select(mark.alias("_hash")).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
    top = counts.filter(F.col("_n") >= full).orderBy(F.desc("_n"), "_hash").limit(hot).select("_hash")
    top = [r["_hash"] for r in top.collect()]
    if not top:
        return rows.select("*", *[a.over(Window.partitionBy(*keys)).alias(n) for n, a in aggs.items()])
    is_hot = mark.isin(top)
    cold = rows.filter(~is_hot).select("*", *[a.over(Window.partitionBy(*keys)).alias(n) for n, a in aggs.items()])
    few = rows.filter(is_hot).groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return cold.unionByName(rows.filter(is_hot).join(F.broadcast(few), list(keys)).select(*cold.columns))


BATCH_BYTES = 4 << 20
ARROW_LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 * BATCH_BYTES), "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}


def small_batches(spark: SparkSession) -> None:
    """Have Spark hand rows to Python in batches bounded by bytes, so that long texts need no more memory than short ones."""
    for key, value in ARROW_LIMITS.items():
        spark.conf.set(key, value)


def slices(batch: pa.RecordBatch, texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about ``most`` bytes; a longer text alone with its neighbours' rest."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def map_text(df: DataFrame, text_col: str, make: Callable, new: str, keep: Sequence[str] | None = None) -> DataFrame:
    """``df``'s columns ``keep`` (default: all) with the columns of the DDL ``new``, computed from a text column in
    bounded slices.  ``make()`` is called once per task and gives a function from a list of texts (None for
    null) to (index, columns): index names the slice's row of each output row, None meaning one each in order.
    If the function has a ``done``, it is called at the task's end.
    Kept columns pass as Arrow arrays, untouched; those named like a new one are replaced."""
    new_type = StructType.fromDDL(new)
    keep = [c for c in (df.columns if keep is None else keep) if c not in new_type.names]
    out_type = StructType([*df.select(*[f"`{c}`" for c in keep]).schema.fields, *new_type.fields])
    n = len(keep)

    def run(batches):
        f = make()
        fields = list(to_arrow_schema(new_type))
        for batch in batches:
            schema = pa.schema([batch.schema.field(i) for i in range(n)] + fields)
            for part in slices(batch, batch.column(n)):
                index, cols = f(part.column(n).to_pylist())
                kept = [part.column(i) for i in range(n)]
                if index is not None:
                    at = pa.array(index, type=pa.int64())
                    kept = [k.take(at) for k in kept]
                made = [pa.array(c, type=x.type, from_pandas=False) for c, x in zip(cols, fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=schema)
        getattr(f, "done", lambda: None)()

    small_batches(df.sparkSession)
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    return rows.mapInArrow(run, out_type)


ship(__name__)
