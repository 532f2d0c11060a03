"""Structured Streaming forms of ingestion, roll-up, sessions, deduplication and monitoring.

Each function maps a streaming (or batch) DataFrame; `replay` runs it over files to the end and reads the result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WATERMARK = "1 day"


def shared_folder(spark: SparkSession) -> str:
    """Shared folder of checkpoints and replayed results; a temporary one only where the cluster names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tickloom-streams-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes a step of an iteration to the shared folder and reads it back, which cuts the lineage."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def read_quotes(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Quotes from a growing folder of Parquet files with the event schema, or from one such file."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    if _is_folder(spark, path):
        folder, name = path.rstrip("/"), "*.parquet"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)
    ts = F.col("ts").cast("timestamp")
    bid = F.lit(1.0) + F.col("value") / 1000.0
    k = F.get_json_object("props", "$.k").cast("double")
    return raw.select(F.col("event_type").alias("symbol"), "event_id", "user_id", ts.alias("ts"), bid.alias("bid"), (bid + k * F.lit(1e-5)).alias("ask"), k.alias("spread_points"))


def completed_bars(quotes: DataFrame, width: str = "15 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Tumbling bars, each emitted once, when the watermark has passed it; later ticks are dropped."""
    bars = quotes.withWatermark("ts", watermark).groupBy("symbol", F.window("ts", width))
    out = bars.agg(F.min_by("bid", "event_id").alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", "event_id").alias("close"), F.count("*").alias("tick_volume"))
    return out.select("symbol", F.unix_timestamp("window.start").alias("time"), "open", "high", "low", "close", "tick_volume")


def outages(quotes: DataFrame, gap: str = "300 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Runs of quotes no farther apart than the gap."""
    runs = quotes.withWatermark("ts", watermark).groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("n_ticks"))
    return runs.select("symbol", F.unix_timestamp("session_window.start").alias("start_time"), "n_ticks")


def once(quotes: DataFrame, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """The first row of each key within the watermark."""
    return quotes.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def accepted(bars: DataFrame, now: int, step: int) -> DataFrame:
    """Completed bars with sound prices; the others carry a reason for the quarantine."""
    box = (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close"))
    return bars.withColumn("reason", F.when(F.col("time") + step > now, "INCOMPLETE").when(~box, "BAD_OHLC"))


def stale(quotes: DataFrame, at: DataFrame, most_age_msc: int, bucket: int) -> DataFrame:
    """Instants (symbol, at_msc) with the age of the last quote, and whether evaluation is skipped for it.

    On a stream, call it in `foreachBatch` with the batch's instants; without any quote the feed is stale.
    """
    from tickloom.operators.asof import asof

    last = asof(at, quotes.select("symbol", "time_msc", "event_id"), ["symbol"], "at_msc", "time_msc", [], bucket, ties=["event_id"])
    age = F.col("at_msc") - F.col("time_msc")
    return last.select("symbol", "at_msc", age.alias("age_msc"), F.coalesce(age > most_age_msc, F.lit(True)).alias("is_stale"))


def running_counts(quotes: DataFrame) -> DataFrame:
    """Running counts and bounds of each symbol (update or complete mode)."""
    return quotes.groupBy("symbol").agg(F.count("*").alias("n_ticks"), F.min("spread_points").alias("min_spread"), F.max("spread_points").alias("max_spread"), F.avg("spread_points").alias("mean_spread"))


def running_decisions(called: DataFrame, threshold: float) -> DataFrame:
    """Running counts by symbol, decision, class and whether the confidence reaches the threshold, with confidences and latencies (update or complete mode)."""
    groups = called.groupBy("symbol", "action", "class", (F.col("top") >= threshold).alias("is_sure"))
    return groups.agg(F.count("*").alias("n"), F.min("top").alias("min_confidence"), F.max("top").alias("max_confidence"), F.avg("top").alias("mean_confidence"), F.avg("latency_ms").alias("mean_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))


def with_slow_table(bars: DataFrame, slow: DataFrame) -> DataFrame:
    """A static table of daily values joined to live bars by the day before, the last one that may be used."""
    return bars.withColumn("day", F.date_sub(F.timestamp_seconds("time").cast("date"), 1)).join(slow, "day", "left")


def replay(result: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming DataFrame over all files that are there, with a checkpoint, and reads what it wrote."""
    spark = result.sparkSession
    folder = shared_folder(spark)
    if mode == "append":
        result.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{folder}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")

    query = result.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    return spark.read.schema(result.schema).parquet(f"{folder}/out/{last}")


def replay_in_parts(parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Parts of a table arrive one after another; after each, the stream resumes from its checkpoint and runs to the end.

    `transform` maps the stream of quotes; the result is what one replay over all parts gives.
    """
    spark = parts[0].sparkSession
    folder = shared_folder(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        result = transform(read_quotes(spark, f"{folder}/in"))
        result.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


#: Bars of each symbol that live evaluation keeps, and that it needs for whole features.
HISTORY, WARMUP = 250, 81


def with_features(bars: DataFrame, names: list[str], columns: list[str], warmup: int = WARMUP) -> DataFrame:
    """Features with a status: WARMUP (too little history), MISSING or INFINITE (some value of the vector), else OK."""
    from tickloom.operators import features

    return checked(features.build(bars, names).select("symbol", "time", "bar_idx", *columns), columns, warmup)


def checked(made: DataFrame, columns: list[str], warmup: int) -> DataFrame:
    """Adds the status of each vector; drops the row index."""
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(c) for c in columns))
    infinite = reduce(lambda a, b: a | b, (F.abs(F.col(c)) == float("inf") for c in columns))
    status = F.when(F.col("bar_idx") + 1 < warmup, "WARMUP").when(missing, "MISSING").when(infinite, "INFINITE").otherwise("OK")
    return made.withColumn("status", status).drop("bar_idx")


def with_calls(rows: DataFrame, score: Callable[[DataFrame], DataFrame], step: int, at: int, threshold: float = 0.6) -> DataFrame:
    """BUY, SELL or NONE with its reason for bars with `status`; only sound bars that are complete at `at` are scored.

    `score` adds p_short, p_neutral and p_long. The first of the largest decides; equal to the threshold is enough.
    """
    late = F.col("time") + step > at
    marked = rows.withColumn("_bad", F.when(late, "LOOKAHEAD").when(F.col("status") != "OK", F.col("status")))
    scored = score(marked.filter("_bad is null"))
    none = F.lit(None).cast("double")
    rest = marked.filter("_bad is not null").withColumns({"p_short": none, "p_neutral": none, "p_long": none})
    both = scored.unionByName(rest.select(*scored.columns))
    short = (F.col("p_short") >= F.col("p_neutral")) & (F.col("p_short") >= F.col("p_long"))
    neutral = ~short & (F.col("p_neutral") >= F.col("p_long"))
    sure = F.greatest("p_short", "p_long") >= threshold
    reason = F.coalesce("_bad", F.when(neutral, "PREDICTED_NEUTRAL_HOLD").when(sure, "CONFIDENCE_THRESHOLD_MET").otherwise("CONFIDENCE_BELOW_THRESHOLD"))
    action = F.when(F.col("_bad").isNotNull() | neutral | ~sure, "NONE").when(short, "SELL").otherwise("BUY")
    return both.withColumns({"action": action, "reason": reason, "confidence": F.greatest("p_short", "p_long")}).drop("_bad")


def live(bars: DataFrame, work: Callable[[DataFrame], DataFrame], history: int = HISTORY) -> DataFrame:
    """Maps each micro-batch of new bars, with the newest `history` bars of each symbol before it, by `work`.

    Of what `work` gives (with symbol and time), the rows of new bars stay. Features that look back fewer than
    `history` bars equal the batch's; exponential filters start at the history's first bar. The history is a table of
    each batch in the shared folder, so a batch that is run again finds what its first run found.
    """
    spark = bars.sparkSession
    folder = shared_folder(spark)
    schema = spark.createDataFrame([], bars.schema).withColumn("_new", F.lit(True)).schema
    made = work(spark.createDataFrame([], bars.schema))
    made.limit(0).write.parquet(f"{folder}/out/none")

    def step(batch: DataFrame, number: int) -> None:
        both = batch.withColumn("_new", F.lit(True))
        if number:
            both = both.unionByName(spark.read.schema(bars.schema).parquet(f"{folder}/held/{number - 1}").withColumn("_new", F.lit(False)))
        both.write.mode("overwrite").parquet(f"{folder}/both/{number}")
        both = spark.read.schema(schema).parquet(f"{folder}/both/{number}")
        newest = Window.partitionBy("symbol").orderBy(F.desc("time"))
        both.drop("_new").withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= history).drop("_rn").write.mode("overwrite").parquet(f"{folder}/held/{number}")
        new = both.filter("_new").select("symbol", "time")
        work(both.drop("_new")).join(new, ["symbol", "time"], "left_semi").write.mode("overwrite").parquet(f"{folder}/out/{number}")

    bars.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out/*")
