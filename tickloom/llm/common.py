"""Helpers shared by the training-data operators: shared-folder tables, checkpoints and Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy step holds; temporaries are about ten times that.
SLICE_BYTES = 1_500_000
#: Rows that Spark hands to Python at once, where the session has Spark's own default; texts are long.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, so that the two copies of a batch stay small beside the work on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tickloom-checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of steps that nothing refers to any more; it does so only after a collection of the driver's heap."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read it back, so that the planner knows its size.

    The folder goes when the application ends.
    """
    spark = df.sparkSession
    release(spark)
    path = f"{shared_dir(spark).rstrip('/')}/tickloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame, least: int = 1) -> int:
    """Shuffle partitions that this session asks for."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in order, in batches of about `most` bytes of `column` (a single row may have more)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(texts_of(batch.column(column))[2])
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def packed(df: DataFrame) -> DataFrame:
    """doc_id, text with each text as zstd bytes, for texts that travel through shuffles; `unpacked` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor().compress
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if t is None else squeeze(t.encode()) for t in texts], pa.binary())], ["doc_id", "text"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, text binary")


def unpacked(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with the texts of `packed`, each of about `most` bytes of text (a single row may have more)."""
    expand = zstandard.ZstdDecompressor().decompress

    def made(batch: pa.RecordBatch, texts: list[bytes | None], end: int) -> pa.RecordBatch:
        some = batch.slice(end - len(texts), len(texts))
        return some.set_column(some.schema.get_field_index("text"), "text", pa.array(texts, pa.binary()).cast(pa.string()))

    for batch in batches:
        texts: list[bytes | None] = []
        held = 0
        for end, raw in enumerate(batch.column("text")):
            text = None if raw.as_py() is None else expand(raw.as_py())
            size = len(text or b"")
            if texts and held + size > most:
                yield made(batch, texts, end)
                texts, held = [], 0
            texts.append(text)
            held += size
        if texts:
            yield made(batch, texts, batch.num_rows)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, starts and lengths of a string column; a null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    lengths = at[1:] - at[:-1]
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at[:-1], lengths


def strings(column: pa.Array) -> list[str]:
    """Texts of a string column; a null is the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def ids_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the columns that an operator reads, under its own names, whatever else the table holds."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: A key with more than one row in so many is hot; so there are at most as many hot keys.
HOT_SHARE = 4096
#: A key with up to so many rows is never hot.
COLD_ROWS = 256


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row per key, whose column `count` bounds the key's number of rows.

    `total` bounds the sum of the counts. Hot keys, at most HOT_SHARE of them, reach the rows by broadcast, so that
    their rows stay where they are; the others are shuffled.
    """
    is_hot = F.col(count) > max(COLD_ROWS, total // HOT_SHARE)
    hot, cold = F.broadcast(table.filter(is_hot)), table.filter(~is_hot)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly: counts by 16-bit digits, four times. None if there is none."""
    if k <= 0:
        return None
    known, above = 0, 0
    for shift in (48, 32, 16, 0):
        # the first digit is signed, the others are not
        value = F.shiftright(column, shift)
        inside, digit = (rows, value) if shift == 48 else (rows.filter(F.shiftright(column, shift + 16) == known), value.bitwiseAND(F.lit(0xFFFF)))
        counts = sorted(((r["d"], r["count"]) for r in inside.groupBy(digit.alias("d")).count().collect()), reverse=True)  # at most 65,536 rows
        for d, n in counts:
            if above + n >= k:
                known = d if shift == 48 else (known << 16) | d
                break
            above += n
        else:
            return None
    return known


#: Bits of the filter that `maybe_in` sends to every task (4 MiB), whatever the size of the tables.
FILTER_BITS = 1 << 25


def maybe_in(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of `df` whose long `column` may be among those of `ids`: all that are, and few others.

    For a join that follows: rows that cannot match are not shuffled. One hash bit stands for each id; when there are
    many more ids than bits, most rows stay and the join decides as before.
    """
    bit = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER_BITS))
    numbered = ids.select((bit + 1).alias("_bit"))
    words = numbered.groupBy(F.bitmap_bucket_number("_bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("bits"))
    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in words.collect():  # at most FILTER_BITS / 32768 rows of 4 KiB
        at = (row["b"] - 1) * 4096
        table[at : at + 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    handle = df.sparkSession.sparkContext.broadcast(table)
    name = f"_bit_{uuid.uuid4().hex}"
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = handle.value
        for batch in batches:
            at = batch.column(name).to_numpy(zero_copy_only=False)
            keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.drop_columns([name]).filter(pa.array(keep.astype(bool)))

    return df.withColumn(name, bit).mapInArrow(run, schema)
