"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words, runs of punctuation, and pairs of neighbours; a pair of equal
words counts as one kind): `target` from labelled good documents, `raw` from all documents. A document's log
weight is the sum over its n-grams of log target - log raw, less a constant per n-gram, divided by a temperature. A
held-out part of the labelled documents sets both: the constant parts good from bad, and the temperature is the
highest at which Gumbel noise still leaves the held-out documents on their sides (LOST_GOOD, KEPT_BAD), one at
least. The sample is a Gumbel top-k: the k documents with the largest log weight plus Gumbel noise (a hash of seed,
id and text). k is `share` of all documents where that is given, else the number of documents that the models take
for target ones (log weight of zero or more).

Labelled documents are read up to `most_labelled` of them (those with the least id hash), for the target model,
the constant and the temperature. The raw model, the scores and k cover all documents. The k-th key is found by
counting key prefixes, so no sort or collection of all keys takes place.

Defined results: a text without n-grams (null, empty, blank) has log weight 0, so it counts among the k; a row
with a null id has no label; labels that are null or contradict each other for an id are left out; documents whose
keys equal the k-th all stay, so repeated rows stay or go together; without labelled good documents nothing is
rejected; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import kth_largest, sliced, small_batches, store, texts_of
from tickloom.llm.texthash import WordHasher, mix

BUCKETS = 1 << 16
MOST_LABELLED = 20_000
SMOOTHING = 0.5
#: One labelled document in HELD_OUT sets the constant; the others make the target model.
HELD_OUT = 4
#: A wrongly rejected good document weighs so many wrongly kept bad ones.
GOOD_WEIGHT = 3.0
#: Shares of held-out good documents near the line, and of bad ones there, that do not limit the temperature.
LOST_GOOD, KEPT_BAD = 0.002, 0.05
#: Gumbel noise is below -GOOD_MARGIN once in 1600 draws, and above BAD_MARGIN once in 55.
GOOD_MARGIN, BAD_MARGIN = 2.0, 4.0
_U = np.uint64


class Grams:
    """Hashed n-grams of batches of texts."""

    def __init__(self, buckets: int) -> None:
        self.hasher, self.buckets = WordHasher(split_marks=True), buckets

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket and text number of each n-gram, and a hash of each text."""
        words, counts = self.hasher.words(*texts_of(column))
        owner = np.repeat(np.arange(len(counts)), counts)
        same_text = owner[1:] == owner[:-1]
        pair = mix(words[:-1] * _U(0x9E6C63D0876A9A99) + words[1:] * _U(0xC2B2AE3D27D4EB4F))
        pair[words[1:] == words[:-1]] = _U(0x5DEECE66D)
        grams = np.concatenate([words, pair[same_text]]) % _U(self.buckets)
        order = np.arange(len(words), dtype=np.uint64)
        total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(mix(words + mix(order - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts))), out=total[1:])
        ends = np.cumsum(counts)
        return grams.astype(np.int64), np.concatenate([owner, owner[1:][same_text]]), total[ends] - total[ends - counts]


@dataclass(frozen=True)
class Model:
    """Log ratio of each bucket, the constant per n-gram, the seed, the temperature, and the least key (as `sortable`) that stays."""

    ratio: np.ndarray
    constant: float
    seed: int
    temperature: float = 1.0
    least_key: int | None = None

    def parts(self) -> tuple[np.ndarray, float, int, float, int | None]:
        """Plain values, for a broadcast."""
        return self.ratio, self.constant, self.seed, self.temperature, self.least_key

    def score(self, grams: Grams, ids: pa.Array, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of n-grams, log weight and sampling key of each text."""
        bucket, owner, text = grams(column)
        n = np.bincount(owner, minlength=len(column))
        weight = np.bincount(owner, weights=self.ratio[bucket], minlength=len(column)) - n * self.constant
        weight /= self.temperature
        number = np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64).astype(np.uint64)
        h = mix(mix(number ^ mix(np.array([self.seed & (2**64 - 1)], dtype=np.uint64))) + text)
        u = ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        return n, weight, weight - np.log(-np.log(u))


def labelled(labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and quality of at most `most` labelled documents."""
    rows = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("quality").alias("r"))
    rows = store(rows.filter("q = r").select("doc_id", "q", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h")))
    if rows.count() > most:
        # the hashes below the (most + 1)-th least, so that no sort of all labels takes place
        rows = rows.filter(F.col("h") < -kth_largest(rows.select((-F.col("h")).alias("g")), "g", most + 1))
    some = rows.toPandas()
    order = np.argsort(some["doc_id"].to_numpy(dtype=np.int64))
    return some["doc_id"].to_numpy(dtype=np.int64)[order], some["q"].to_numpy(dtype=np.int64)[order]


def among(ids: pa.Array, some: np.ndarray) -> np.ndarray:
    """Which ids are among some; a null is not."""
    return np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), some) & ids.is_valid().to_numpy(zero_copy_only=False)


def held_out(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64)) % _U(HELD_OUT) == 0


def fit(docs: DataFrame, labels: DataFrame, seed: int, buckets: int = BUCKETS, most_labelled: int = MOST_LABELLED) -> Model:
    """The model, without a least key. `docs` has doc_id and text."""
    known, quality = labelled(labels, most_labelled)
    good = known[(quality == 1) & ~held_out(known)]
    handle = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(buckets)
        good = handle.value
        total = np.zeros((2, buckets), dtype=np.int64)
        for batch in sliced(batches, "text"):
            bucket, owner, _ = grams(batch.column("text"))
            total[0] += np.bincount(bucket, minlength=buckets)
            chosen = among(batch.column("doc_id"), good)
            total[1] += np.bincount(bucket[chosen[owner]], minlength=buckets)
        for kind in (0, 1):
            some = np.flatnonzero(total[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, dtype=np.int32)), pa.array(some.astype(np.int32)), pa.array(total[kind][some])], ["kind", "bucket", "n"])

    counted = docs.mapInArrow(count, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2 * buckets rows
    totals = np.zeros((2, buckets))
    totals[counted["kind"].to_numpy(dtype=int), counted["bucket"].to_numpy(dtype=int)] = counted["n"].to_numpy(dtype=float)
    shares = np.log((totals + SMOOTHING) / (totals.sum(axis=1, keepdims=True) + SMOOTHING * buckets))
    ratio = shares[1] - shares[0] if totals[1].sum() else np.zeros(buckets)
    if not totals[1].sum():
        return Model(ratio, -1e6, seed)
    constant, temperature = line_of(held_out_scores(docs, Model(ratio, 0.0, seed), known, quality, buckets))
    return Model(ratio, constant, seed, temperature)


def held_out_scores(docs: DataFrame, model: Model, known: np.ndarray, quality: np.ndarray, buckets: int) -> list[tuple[float, int, int]]:
    """Mean log ratio, number of n-grams and quality of the held-out documents."""
    handle = docs.sparkSession.sparkContext.broadcast((model.parts(), known[held_out(known)]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = handle.value
        model = Model(*parts)
        grams = Grams(buckets)
        for batch in sliced(batches, "text"):
            part = batch.filter(pa.array(among(batch.column("doc_id"), held)))
            if part.num_rows:
                n, weight, _ = model.score(grams, part.column("doc_id"), part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weight / np.maximum(n, 1)), pa.array(n.astype(np.int64))], ["doc_id", "mean", "n"])

    rows = docs.mapInArrow(score, "doc_id long, mean double, n long").groupBy("doc_id").agg(F.max(F.struct("mean", "n")).alias("m")).select("doc_id", "m.*").toPandas()  # at most the labelled sample
    truth = dict(zip(known.tolist(), quality.tolist(), strict=True))
    return [(m, n, truth[i]) for i, m, n in zip(rows["doc_id"].tolist(), rows["mean"].tolist(), rows["n"].tolist(), strict=True)]


def line_of(scores: list[tuple[float, int, int]]) -> tuple[float, float]:
    """The mean log ratio that best parts good and bad documents (mean, n-grams, quality), and the temperature."""
    pairs = sorted((m, q) for m, _, q in scores)
    n_good = sum(q == 1 for _, q in pairs)
    n_bad = len(pairs) - n_good
    if not n_good or not n_bad:
        return (-1e6 if not n_bad else 0.0), 1.0
    # walk up: below the line are rejected documents
    best, line = 1.0, pairs[0][0] - 1.0
    lost = missed = 0
    for (m, q), (after, _) in zip(pairs, [*pairs[1:], (pairs[-1][0] + 1.0, 1)], strict=True):
        lost, missed = lost + (q == 1), missed + (q != 1)
        cost = GOOD_WEIGHT * lost / n_good + 1 - missed / n_bad
        if cost < best and after > m:
            best, line = cost, (m + after) / 2
    good = np.array([n * (m - line) for m, n, q in scores if q == 1 and m >= line])
    bad = np.array([n * (line - m) for m, n, q in scores if q != 1 and m < line])
    limits = [np.quantile(good, LOST_GOOD) / GOOD_MARGIN if len(good) else 1.0, np.quantile(bad, KEPT_BAD) / BAD_MARGIN if len(bad) else 1.0]
    return line, max(1.0, float(min(limits)))


def scored(docs: DataFrame, model: Model, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key of each row, and key_bits, the key as a sortable whole number."""
    handle = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = Grams(buckets), Model(*handle.value)
        for batch in sliced(batches, "text"):
            n, weight, key = model.score(grams, batch.column("doc_id"), batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(weight), pa.array(key), pa.array(sortable(key))], ["doc_id", "n_grams", "log_weight", "sample_key", "key_bits"])

    return docs.mapInArrow(run, "doc_id long, n_grams long, log_weight double, sample_key double, key_bits long")


def sortable(keys: np.ndarray) -> np.ndarray:
    """Whole numbers that order as the keys do."""
    bits = keys.astype(np.float64).view(np.int64)
    return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))


def sample(docs: DataFrame, labels: DataFrame, seed: int = 0, share: float | None = None) -> tuple[DataFrame, Model]:
    """The sampled rows of `scored`, and the model with its least key. `docs` has doc_id and text."""
    model = fit(docs, labels, seed)
    rows = store(scored(docs, model))
    k = rows.filter("log_weight >= 0").count() if share is None else round(share * rows.count())
    least = kth_largest(rows, "key_bits", k)
    kept = rows.filter(F.lit(False) if least is None else F.col("key_bits") >= least)
    return kept, Model(model.ratio, model.constant, seed, model.temperature, least)


def keep_good(df: DataFrame, labels: DataFrame, seed: int = 0, share: float | None = None) -> DataFrame:
    """The rows of `df` (with doc_id and text) that the sample holds, with all columns."""
    small_batches(df.sparkSession)
    _, model = sample(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, seed, share)
    handle = df.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, model = Grams(BUCKETS), Model(*handle.value)
        for batch in sliced(batches, "text"):
            _, _, key = model.score(grams, batch.column("doc_id").cast(pa.int64()), batch.column("text"))
            least = model.least_key
            yield batch.filter(pa.array(sortable(key) >= least if least is not None else np.zeros(len(key), dtype=bool)))

    return df.mapInArrow(run, df.schema)
