"""Best-fit packing in bulk-synchronous supersteps.

Lengths and gaps are whole numbers from 1 to the capacity, so the range-sorted documents are the size classes in
descending order, and the sorted gaps are the gap classes in ascending order. A superstep takes one size class:
its documents sweep to the successor gaps (the smallest gap that holds them, then the next), conflicts within a
class are resolved by rank, gaps are updated, and the rest open new sequences. The state is class counts and rank
intervals, so its size is bounded by the square of the capacity whatever the number of documents; ranks within a
class, and the placement of each document, are computed by Spark.

Defined results: a null text is the empty text (one end token); a row with a null id is packed as any other;
repeated rows are packed as often as they occur; ties are ordered by id, piece and checksum; other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import ids_and_text, parts, sliced, store, strings

CAPACITY = 1024
END_ID = 2
#: Rows of one rank bucket, about.
BUCKET_ROWS = 4_000
#: Buckets of one size whose order is found in one task.
BUCKET_GROUP = 4096
#: Special tokens of the vocabulary; a text that holds one goes through the general tokenizer.
SPECIAL = "<|endoftext|>"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class ByteBpe:
    """Ids of the byte-level BPE vocabulary file; the rank file of the same vocabulary makes them faster."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path = path
        self.general = None
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        if self.general is None:
            from tokenizers import Tokenizer

            self.general = Tokenizer.from_file(self.path)
        return self.general.encode(text, add_special_tokens=False).ids


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece: full pieces, after a first one that takes the remainder."""
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(s, (first if i == 0 else capacity)) for i, s in enumerate(starts)]


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and the little-endian 32-bit ids of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        for batch in sliced(batches, "text", 1_000_000):
            rows: list[tuple] = []
            for i, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text")), strict=True):
                raw = np.array([*bpe.ids(text), end_id], dtype="<u4").tobytes()
                rows += [(i, k, s, n, raw[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut_points(len(raw) // 4, capacity))]
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return ids_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, first rank, end rank, first sequence, offset) that place `counts[size]` documents of each size.

    Document `first rank + k` of the size goes to sequence `first sequence + k` at the offset.
    """
    gaps: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]  # by gap: (first sequence, number)
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for size in range(capacity, 0, -1):
        left, rank = counts.get(size, 0), 0
        while left:
            # successor sweep: the smallest gap that holds the size; what it leaves may hold another
            gap = next((g for g in range(size, capacity) if gaps[g]), 0)
            if gap:
                first, n = gaps[gap].popleft()
                take = min(n, left)
                if take < n:
                    gaps[gap].appendleft((first + take, n - take))
                plan.append((size, rank, rank + take, first, capacity - gap))
                if gap > size:
                    gaps[gap - size].append((first, take))
                rank += take
                left -= take
                continue
            # none: open sequences and fill each with the size, the last with what remains
            fit = capacity // size
            for new, layers in ((left // fit, fit), (1, left % fit)):
                if not new or not layers:
                    continue
                for k in range(layers):
                    plan.append((size, rank, rank + new, opened, k * size))
                    rank += new
                if capacity > layers * size:
                    gaps[capacity - layers * size].append((opened, new))
                opened += new
                left -= new * layers
    return plan


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece, start, length (and others); see `best_fit`.

    `items` is read twice: give a stored table.
    """
    spark = items.sparkSession
    total = items.count()
    buckets = max(1, total // BUCKET_ROWS)
    key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets))
    marked = items.withColumn("_bucket", key)
    sizes = marked.groupBy("length", "_bucket").count()
    # ranks run over (bucket, place in bucket) within a size, so that no size class meets in one task
    sizes = sizes.withColumn("_group", F.floor(F.col("_bucket") / BUCKET_GROUP))
    earlier = lambda *keys, by: F.coalesce(F.sum("count").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = sizes.groupBy("length", "_group").agg(F.sum("count").alias("count")).withColumn("_before", earlier("length", by="_group")).drop("count")
    bases = sizes.withColumn("_inside", earlier("length", "_group", by="_bucket")).join(groups, ["length", "_group"]).select("length", "_bucket", (F.col("_before") + F.col("_inside")).alias("_base"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = best_fit(counts, capacity)  # bounded by the capacity, not by the data
    steps: dict[int, list[tuple[int, int, int, int]]] = {}
    for size, a, b, first, offset in plan:
        steps.setdefault(size, []).append((a, b, first, offset))
    placed = spark.createDataFrame([(s, [dict(a=a, b=b, first=f, offset=o) for a, b, f, o in rows]) for s, rows in steps.items()] or [], "length long, steps array<struct<a:long,b:long,first:long,offset:long>>")
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = marked.withColumn("_place", F.row_number().over(inside) - 1).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_place") + F.col("_base"))
    return _place(ranked, placed, items.columns)


def _place(ranked: DataFrame, placed: DataFrame, columns: list[str]) -> DataFrame:
    spans = placed.select("length", F.explode("steps").alias("s")).select("length", "s.*")
    # rank intervals are laid on a grid of cells, so that the interval join is an equi-join
    width = BUCKET_ROWS
    grid = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    keyed = ranked.withColumn("_cell", F.floor(F.col("_rank") / width))
    joined = keyed.join(grid, ["length", "_cell"]).filter((F.col("_rank") >= F.col("a")) & (F.col("_rank") < F.col("b")))
    return joined.select(*columns, (F.col("first") + F.col("_rank") - F.col("a")).alias("sequence_id"), F.col("offset"))


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = pieces(df, path, id_col, text_col, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(store(made), capacity)
