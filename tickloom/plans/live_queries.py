"""Queries of live features and calls, slow values on streams, resumed replays, readers and writers, model comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom import streaming
from tickloom.operators import jobs, models, splits, stats
from tickloom.plans import sql as q
from tickloom.plans.catalog import query, rounded
from tickloom.plans.explore_queries import _REPORTS, reports
from tickloom.plans.feature_queries import PRICE, VOLATILITY
from tickloom.plans.job_queries import FITS, SHIFT
from tickloom.plans.model_queries import FEATURES, dataset, train_rows
from tickloom.sources import readers
from tickloom.sources.adapters import D1, H1, bars, exo_daily

_LIVE = ["return_1", "return_mean_20", "vol_std_20", "vol_std_80", "atr_norm_14"]
_CLOSED = f"(time+{H1})*1000000 <= (SELECT max(epoch_us(ts)) FROM events) - 86400000000"
_BEFORE = q.lag("close")
_R03 = (
    f"{q.bars_with(H1)}, f0 AS (SELECT *, row_number() OVER ({q.W}) - 1 AS i, ln(close/{_BEFORE}) AS lr, close/{_BEFORE} - 1 AS ret, greatest(high-low, abs(high-{_BEFORE}), abs(low-{_BEFORE})) AS tr FROM bars), "
    f"f1 AS (SELECT symbol, time, i, {', '.join(f'{(PRICE | VOLATILITY)[n]} AS {n}' for n in _LIVE)} FROM f0), f AS (SELECT *, CASE WHEN i + 1 < {streaming.WARMUP} THEN 'WARMUP' WHEN {' OR '.join(f'{n} IS NULL' for n in _LIVE)} THEN 'MISSING' ELSE 'OK' END AS status FROM f1 WHERE {_CLOSED})"
)


def _closed_bars(spark, sf_dir):
    return streaming.completed_bars(streaming.read_quotes(spark, f"{sf_dir}/events.parquet"), "1 hour")


def _vectors(df):
    return streaming.with_features(df, ["price", "volatility"], _LIVE)


@query("R03_live_features", f"{_R03} SELECT symbol, time, status, {q.rounded(_LIVE)} FROM f")
def r03(spark, sf_dir):
    return rounded(streaming.live(_closed_bars(spark, sf_dir), _vectors), *_LIVE)


_AT = 1_706_000_000


def _by_drift(rows):
    """Class probabilities from the drift in units of its spread, by a fixed rule in place of a fitted model."""
    x = F.col("return_mean_20") / (F.col("vol_std_20") + 1e-8) * 3.0
    total = F.exp(-x) + F.exp(F.lit(0.5)) + F.exp(x)
    return rows.withColumns({"p_short": F.exp(-x) / total, "p_neutral": F.exp(F.lit(0.5)) / total, "p_long": F.exp(x) / total})


@query(
    "R04_live_calls",
    f"{_R03}, b AS (SELECT *, CASE WHEN time + {H1} > {_AT} THEN 'LOOKAHEAD' WHEN status <> 'OK' THEN status END AS bad, return_mean_20/(vol_std_20+1e-8::DOUBLE)*3.0 AS x FROM f), p AS (SELECT *, exp(-x)/(exp(-x)+exp(0.5)+exp(x)) AS ps, exp(0.5)/(exp(-x)+exp(0.5)+exp(x)) AS pn, exp(x)/(exp(-x)+exp(0.5)+exp(x)) AS pl FROM b), "
    "c AS (SELECT *, CASE WHEN ps >= pn AND ps >= pl THEN 'SELL' WHEN pn >= pl THEN 'NONE' ELSE 'BUY' END AS side FROM p) SELECT symbol, time, CASE WHEN bad IS NOT NULL OR greatest(ps,pl) < 0.6::DOUBLE THEN 'NONE' ELSE side END AS action, "
    "CASE WHEN bad IS NOT NULL THEN bad WHEN side = 'NONE' THEN 'PREDICTED_NEUTRAL_HOLD' WHEN greatest(ps,pl) >= 0.6::DOUBLE THEN 'CONFIDENCE_THRESHOLD_MET' ELSE 'CONFIDENCE_BELOW_THRESHOLD' END AS reason, CASE WHEN bad IS NULL THEN round(greatest(ps,pl),6)+0.0 END AS confidence FROM c",
)
def r04(spark, sf_dir):
    out = streaming.live(_closed_bars(spark, sf_dir), lambda df: streaming.with_calls(_vectors(df), _by_drift, H1, _AT))
    return rounded(out.select("symbol", "time", "action", "reason", "confidence"), "confidence", digits=6)


@query("R09_slow_values_on_stream", f"WITH {q.TICKS}, {q.bars(H1)}, {q.EXO} SELECT symbol, time, round(close,8)+0.0 AS close, round(us_2y,8)+0.0 AS value FROM bars LEFT JOIN exo ON CAST(make_timestamp(time*1000000) AS DATE) - 1 = exo.d + {SHIFT} WHERE {_CLOSED}")
def r09(spark, sf_dir):
    slow = exo_daily(spark, sf_dir).select(F.date_add("d", SHIFT).alias("day"), F.col("us_2y").alias("value"))
    return rounded(streaming.replay(streaming.with_slow_table(_closed_bars(spark, sf_dir), slow)).select("symbol", "time", "close", "value"), "close", "value")


@query("R10_resumed_replay", f"WITH {q.TICKS}, {q.bars(H1)} SELECT symbol, time, round(open,8)+0.0 AS open, round(close,8)+0.0 AS close, tick_volume FROM bars WHERE {_CLOSED}")
def r10(spark, sf_dir):
    """The events of the first days arrive, then the others; the second run resumes the first."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    early = F.coalesce(F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"), F.lit(False))
    out = streaming.replay_in_parts([events.filter(early), events.filter(~early)], lambda quotes: streaming.completed_bars(quotes, "1 hour"))
    return rounded(out.select("symbol", "time", "open", "close", "tick_volume"), "open", "close")


# readers: each writes a file from the tables in the shared folder and reads it back
@query("S01_bars_by_suffix", f"WITH {q.TICKS}, {q.bars(H1)}, k AS (SELECT unnest(['csv', 'parquet']) AS kind) SELECT kind, symbol, time, round(close,8)+0.0 AS close, tick_volume, CAST(floor(spread) AS BIGINT) AS spread FROM bars, k")
def s01(spark, sf_dir):
    folder = streaming.shared_folder(spark)
    made = bars(spark, sf_dir, H1).withColumn("spread", F.floor("spread")).selectExpr("symbol", "time", "open", "high", "low", "close", "tick_volume", "spread", "real_volume")
    made.write.csv(f"{folder}/bars.csv", header=True)
    made.write.parquet(f"{folder}/bars.parquet")
    read = [readers.read_bars(spark, f"{folder}/bars.{kind}").select(F.lit(kind).alias("kind"), "symbol", "time", "close", "tick_volume", "spread") for kind in ("csv", "parquet")]
    return rounded(read[0].unionByName(read[1]), "close")


@query("S02_processed_bars", f"WITH {q.TICKS}, {q.bars(D1)} SELECT symbol, CAST(year(make_timestamp(time*1000000)) AS BIGINT) AS year, time, round(close,8)+0.0 AS close FROM bars")
def s02(spark, sf_dir):
    folder = streaming.shared_folder(spark)
    readers.write_bars(bars(spark, sf_dir, D1), f"{folder}/bars", f"{folder}/bars.csv")
    return rounded(spark.read.parquet(f"{folder}/bars").select("symbol", F.col("year").cast("long").alias("year"), "time", "close"), "close")


@query("S04_series_csv", f"WITH {q.EXO} SELECT d, round(us_2y,8)+0.0 AS value FROM exo")
def s04(spark, sf_dir):
    """A missing value is a point in the file."""
    folder = streaming.shared_folder(spark)
    exo_daily(spark, sf_dir).select(F.col("d").alias("DATE"), F.coalesce(F.col("us_2y").cast("string"), F.lit(".")).alias("DGS2")).write.csv(folder, header=True)
    return rounded(readers.read_series(spark, folder, "DATE", "DGS2"), "value")


@query("S05_semicolon_series", f"WITH {q.EXO} SELECT d, round(german_2y,8)+0.0 AS value FROM exo")
def s05(spark, sf_dir):
    """Decimal commas, a point for a missing value, and a preamble in each file."""
    folder = streaming.shared_folder(spark)
    line = F.concat(F.col("d").cast("string"), F.lit(";"), F.coalesce(F.replace(F.col("german_2y").cast("string"), F.lit("."), F.lit(",")), F.lit(".")), F.lit(";"))
    exo_daily(spark, sf_dir).select(line.alias("value")).union(spark.createDataFrame([("Title;yield",), ("unit;percent",)], "value string")).write.text(folder)
    return rounded(readers.read_semicolon_series(spark, folder), "value")


@query("S06_position_reports", f"WITH {_REPORTS} SELECT report_date, open_interest, long_all, short_all FROM reports WHERE code = 2 AND rest_long % 7 <> 0")
def s06(spark, sf_dir):
    """Yearly files with headers of another form; a row with a field that is no whole number goes."""
    folder = streaming.shared_folder(spark)
    made = reports(spark, sf_dir)
    odd = F.when(F.col("rest_long") % 7 == 0, "n/a").otherwise(F.col("long_all").cast("string"))
    fields = {"Report Date": F.col("report_date"), "Contract_Code": F.col("code"), "Open Interest (All)": F.col("open_interest"), "Long-All": odd, "SHORT ALL": F.col("short_all")}
    made.select(F.year("report_date").alias("file_year"), *(c.alias(n) for n, c in fields.items())).write.partitionBy("file_year").csv(folder, header=True)
    names = {"report_date": "report_date", "open_interest": "open interest all", "long_all": "long all", "short_all": "short all"}
    return readers.read_position_reports(spark, folder, "contract code", "2", names)


@query("S08_manifest")
def s08(spark, sf_dir):
    """Rows only: the checksums of the tables' own files (tested with another library)."""
    made = readers.manifest(spark, f"{sf_dir}/*.parquet")
    return made.select(F.element_at(F.split("path", "/"), -1).alias("name"), "n_bytes", "sha256")


@query("K03_importance_ranks")
def k03(spark, sf_dir):
    """Rows only: features by forest importance and by mean absolute coefficient (the fits have tests and SQL of their own)."""
    train = train_rows(spark, sf_dir)
    ranked = [models.importances(FITS[name](train, FEATURES), FEATURES).withColumn("model", F.lit(name)) for name in ("forest", "logistic")]
    return ranked[0].unionByName(ranked[1])


@query("C07_baselines")
def c07(spark, sf_dir):
    """Rows only: majority, logistic and forest models, weighted by class and not, on the validation rows."""
    table = streaming.stored(splits.split(dataset(spark, sf_dir)))
    return jobs.held_out(streaming.stored(jobs.calls_of(table, FEATURES, FITS, ("validation",))))


@query("C09_candidate_features")
def c09(spark, sf_dir):
    """Rows only: does the candidate set beat the base set over ten embargoed folds (gain, t, signed ranks, gates)?"""
    masked = streaming.stored(splits.fold_masks(dataset(spark, sf_dir), 300, 10, 4, 2))
    runs = streaming.stored(jobs.ablation(masked, {"base": FEATURES[:3], "candidate": FEATURES}, 10))
    gains = runs.filter("feature_set = 'candidate'")
    tested = stats.with_p_values(stats.one_sample(gains, ["feature_set"], "gain"))
    ranks = stats.with_signed_rank_p(stats.signed_rank(gains, ["feature_set"], "gain")).select("feature_set", "w_statistic", F.col("p_value").alias("signed_rank_p_value"))
    rules = {"mean_gain": "mean_value > 0", "most_folds": "n_positive > n / 2", "significant": "p_value < 0.05"}
    gates = stats.gates(tested, rules).groupBy().agg(F.bool_and("passed").alias("all_passed"), F.count_if("passed").alias("n_passed")).withColumn("feature_set", F.lit("candidate"))
    return tested.join(ranks, "feature_set", "left").join(gates, "feature_set")
