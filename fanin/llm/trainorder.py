"""Training-order materialisation: fixed-stride shards in a keyed random order.

Sequences are numbered 0 to n - 1 in the order of the documents' files and places, however scans are split; a keyed Feistel permutation, walked
along its cycle until it falls below n, gives each number its slot.  Slots map to shards of ``SHARD_SLOTS`` records
of one stride, so that a reader finds slot s at byte (s mod SHARD_SLOTS) * stride of shard s div SHARD_SLOTS and
can resume anywhere; beside its payload a shard holds the index of its slots (document, start, length).  The permutation needs no shuffle and no state: any slot's number, and the reverse, is
computed from key and n alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from fanin.llm.common import documents, fresh, map_text, materialise, ship, small_batches
from fanin.llm.common import numbered as number_rows
from fanin.llm.packing import END_ID, TOKENIZER, word_encoder
from fanin.session import ensure_checkpoint_dir

LENGTH = 512
PAD_ID = 0
KEY = "training-order-1"
SHARD_SLOTS = 1 << 14
ROUNDS = 6


def round_keys(key: str) -> np.ndarray:
    raw = hashlib.sha256(key.encode()).digest() + hashlib.sha256(key.encode() + b"+").digest()
    return np.frombuffer(raw, dtype="<u8")[:ROUNDS].copy()


def _half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _mix(x: np.ndarray, k: np.uint64) -> np.ndarray:
    x = (x ^ k) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _walk(values: np.ndarray, n: int, keys: np.ndarray, back: bool) -> np.ndarray:
    """The permutation of 0 to n - 1 (or its inverse): a balanced Feistel network over the next even number of bits,
    repeated on the values that fall outside."""
    half = np.uint64(_half_bits(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(values, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots_of(numbers: np.ndarray, n: int, key: str = KEY) -> np.ndarray:
    return _walk(numbers, n, round_keys(key), False)


def numbers_of(slots: np.ndarray, n: int, key: str = KEY) -> np.ndarray:
    return _walk(slots, n, round_keys(key), True)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID,
              pad_id: int = PAD_ID, tokenizer: str | None = None) -> DataFrame:
    """(doc, rid, start, length, record, seq): each document's ids and ``end_id`` in records of ``length`` ids, the last
    one padded; a record is little-endian, of 16 bits an id if the vocabulary allows, else 32.  rid is the document's
    file and place, seq holds the writing task and the row in it.  A task holds the ids of one slice of documents (4 MB
    of text) at a time; a longer text is encoded alone, with memory in proportion to it."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    kind = id_type(path)

    def make():
        encode = word_encoder(path)

        def run(texts):
            raws = encode([t or "" for t in texts])
            sizes = np.array([len(raw) // 4 + 1 for raw in raws], dtype=np.int64)
            rooms = -(-sizes // length)
            firsts = np.cumsum(rooms) - rooms
            full = np.full(int(rooms.sum()) * length, pad_id, dtype=kind)
            for raw, a in zip(raws, (firsts * length).tolist(), strict=True):
                b = a + len(raw) // 4
                full[a:b] = np.frombuffer(raw, dtype="<u4")
                full[b] = end_id
            starts = (np.arange(rooms.sum()) - np.repeat(firsts, rooms)) * length
            lengths = np.minimum(length, np.repeat(sizes, rooms) - starts).astype(np.int32)
            cuts = pa.array(np.arange(len(starts) + 1, dtype=np.int64) * length * full.itemsize).cast(pa.int32())
            records = pa.Array.from_buffers(pa.binary(), len(starts), [None, cuts.buffers()[1], pa.py_buffer(full)])
            return np.repeat(np.arange(len(raws)), rooms), [starts, lengths, records]

        run.done = encode.forget
        return run

    row = fresh(docs, "_row")
    rows = number_rows(docs, row, [id_col, text_col])
    rows = rows.select(F.col(f"`{id_col}`").alias("doc"), F.col(row).alias("rid"), F.col(f"`{text_col}`").alias("text"))
    rows = map_text(rows, "text", make, "start long, length int, record binary", ["doc", "rid"])
    return rows.withColumn("seq", F.monotonically_increasing_id())


def id_type(path: str) -> str:
    """The smallest unsigned type that holds a tokenizer's ids."""
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def numbered(table: DataFrame) -> tuple[DataFrame, int]:
    """Adds number, dense from 0 in the order of rid and start, and gives the count.  A task reads a run of rows of each of
    its files in order, so a prefix sum over one row per task and file, in the order of their rows, is all that is gathered."""
    task, file, place = F.shiftright("seq", 33), F.shiftright("rid", 33), F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    runs = table.groupBy(task.alias("task"), file.alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min("rid").alias("least"), F.min(place).alias("before"))
    first = F.sum("rows").over(Window.orderBy("least", "task").rowsBetween(Window.unboundedPreceding, -1))
    # a written table, so that its size decides whether it is broadcast
    runs = materialise(runs.select("task", "file", "rows", (F.coalesce(first, F.lit(0)) - F.col("before")).alias("shift")), "runs")
    n = runs.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    out = table.join(runs.drop("rows"), (task == F.col("task")) & (file == F.col("file")))
    return out.withColumn("number", F.col("shift") + place).drop("task", "file", "shift", "seq", "rid"), n


def in_training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY, length: int = LENGTH,
                      shard_slots: int = SHARD_SLOTS, **named) -> DataFrame:
    """(doc, start, length, record, number, slot, shard), whole shards to a partition, sorted by slot.

    Every sequence gets exactly one slot and every slot from 0 to n - 1 one sequence.  A null text is empty and still
    gives the record of its end id; null ids and repeated rows are sequences like any other; an empty table gives an
    empty result."""
    table = materialise(sequences(docs, id_col, text_col, length, **named), "sequences")
    rows, n = numbered(table)

    @F.pandas_udf("long")
    def slot(number: pd.Series) -> pd.Series:
        return pd.Series(slots_of(number.to_numpy(), n, key))

    shards = max(1, -(-n // shard_slots))
    parts = min(shards, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 16)))
    rows = rows.withColumn("slot", slot("number")).withColumn("shard", F.expr(f"slot div {shard_slots}"))
    # slots are dense, so the range of a partition is known without sampling
    return rows.repartitionById(parts, F.expr(f"cast(shard * {parts} div {shards} as int)")).sortWithinPartitions("slot")


def as_shards(ordered: DataFrame) -> DataFrame:
    """(shard, first_slot, n_slots, docs, starts, lengths, payload): the records of each shard one after another and, in
    the same order, what they hold.  A task holds one shard at a time."""
    rows = ordered.select("shard", "slot", "doc", "start", "length", "record")
    kind = rows.schema["doc"].dataType
    out_type = StructType([StructField("shard", LongType()), StructField("first_slot", LongType()), StructField("n_slots", LongType()),
                           StructField("docs", ArrayType(kind)), StructField("starts", ArrayType(LongType())),
                           StructField("lengths", ArrayType(IntegerType())), StructField("payload", BinaryType())])

    def run(batches):
        now, parts = None, []

        def flush():
            table = pa.Table.from_batches(parts).combine_chunks()
            one = lambda name: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), pa.concat_arrays(table.column(name).chunks))
            payload = b"".join(table.column("record").to_pylist())
            arrays = [pa.array([now], pa.int64()), table.column("slot").chunk(0)[:1], pa.array([table.num_rows], pa.int64()),
                      one("doc"), one("start"), one("length"), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=out_type.names)

        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if shards[a] != now and parts:
                    yield flush()
                    parts = []
                now = int(shards[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield flush()

    small_batches(ordered.sparkSession)
    return rows.mapInArrow(run, out_type)


def write_shards(docs: DataFrame, path: str, **named) -> None:
    """Write the shards of ``docs`` as a table at ``path``, one row a shard, by Spark's committer."""
    as_shards(in_training_order(docs, **named)).write.option("compression", "zstd").parquet(path)


def read_index(spark, path: str, length: int = LENGTH, id_bytes: int = 2) -> DataFrame:
    """(doc, start, length, slot, shard, byte_offset, record_crc32) of every slot of the shards at ``path``, from what is
    written there: the checksum is of the payload's bytes at the slot's offset.  A task holds one shard at a time; in an
    SQL expression each slot would copy the whole payload."""
    stride = length * id_bytes
    shards = spark.read.parquet(path).select("shard", "first_slot", "n_slots", "docs", "starts", "lengths", "payload")
    names = ["doc", "start", "length", "slot", "shard", "byte_offset", "record_crc32"]
    kinds = [shards.schema["docs"].dataType.elementType, LongType(), IntegerType(), *[LongType()] * 4]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, n = (batch.column(c)[i].as_py() for c in range(3))
                payload = memoryview(batch.column(6)[i].as_buffer())
                held = [batch.column(c)[i].values for c in (3, 4, 5)]
                at = np.arange(n, dtype=np.int64)
                sums = [zlib.crc32(payload[a:a + stride]) for a in range(0, n * stride, stride)]
                arrays = [*held, pa.array(first + at), pa.array(np.full(n, shard, dtype=np.int64)), pa.array(at * stride), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    small_batches(spark)
    return shards.mapInArrow(run, StructType([StructField(x, k) for x, k in zip(names, kinds, strict=True)]))


def read_slots(spark, path: str, first: int, last: int, length: int = LENGTH, id_bytes: int = 2,
               shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(slot, record) of slots ``first`` to ``last`` inclusive: only the shards that hold them are read."""
    shards = spark.read.parquet(path).filter(F.col("shard").between(first // shard_slots, last // shard_slots))
    stride = length * id_bytes

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                start, n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                payload = memoryview(batch.column(2)[i].as_buffer())
                slots = range(max(first, start), min(last, start + n - 1) + 1)
                records = [bytes(payload[(s - start) * stride:(s - start + 1) * stride]) for s in slots]
                yield pa.RecordBatch.from_arrays([pa.array(list(slots), pa.int64()), pa.array(records, pa.binary())], names=["slot", "record"])

    small_batches(spark)
    return shards.select("first_slot", "n_slots", "payload").mapInArrow(run, "slot long, record binary")


def op4_training_order(spark, sf_dir):
    """Writes the shards under the session's checkpoint folder; the rows come from the written payloads and index."""
    path = f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(documents(spark, sf_dir), path)
    return read_index(spark, path).withColumnRenamed("doc", "doc_id")


ship(__name__)
