"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame operations only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's word shingles (five words,
lower case for A-Z; a shorter text is one shingle; a text without words has none). The smallest k of two sketches
together are the sketch of both texts together, so sketches merge. Estimates: resemblance (share of the k smallest
of the union that both hold), containment, and the number of distinct shingles from the k-th smallest hash.

Defined results: a null text is the empty text, with an empty sketch; two empty sketches are alike (1), an empty
and another are not (0); rows with a null id come after all others in the order of `edited_texts`; repeated rows
have equal sketches; ties in the order are broken by a hash of the text, then by the text; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import ids_and_text, store

SIZE = 128
WIDTH = 5
#: Rows of one ordering block, about.
BLOCK_ROWS = 500
#: Neighbouring blocks whose order is found in one task.
BLOCK_GROUP = 4096
STRATA = 64
_SPACE = "[\\x20\\x09-\\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, width: int = WIDTH) -> Column:
    """Hashes of the runs of `width` word hashes; of all of them if there are fewer; none if there are none."""
    n = F.size(hashes)
    many = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(*(F.get(hashes, i + (k - 1)) for k in range(width))))
    return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def merge_parts(df: DataFrame, key: str, sketch: str, size: int = SIZE) -> DataFrame:
    """One row for each key: the sketch of all its parts. Parts fold in two steps, so a key may have any number."""
    hashes = df.select(F.col(key), F.explode_outer(sketch).alias("h")).distinct()
    ranked = hashes.filter("h is not null").withColumn("_salt", F.pmod(F.col("h"), F.lit(64)))
    # the k smallest of each salt contain the k smallest of the key
    inner = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_salt").orderBy("h"))).filter(F.col("_r") <= size)
    outer = inner.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).filter(F.col("_r") <= size)
    some = outer.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(sketch))
    return hashes.select(key).distinct().join(some, key, "left").withColumn(sketch, F.coalesce(sketch, F.array().cast("array<bigint>")))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of the Jaccard resemblance, exact while both together have at most `size` shingles."""
    union = merged(a, b, size)
    common = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / F.size(union))


def distinct_count(a: Column, size: int = SIZE) -> Column:
    """Estimate of the number of distinct shingles; exact below `size`."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of the share of a's shingles that b holds."""
    r = resemblance(a, b, size)
    common = r / (1 + r) * (distinct_count(a, size) + distinct_count(b, size))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, size)))


def as_text(sketch: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def from_text(text: Column) -> Column:
    n = (F.length(text) / 16).cast("int")
    digits = lambda i, at: F.conv(F.substring(text, i * 16 + at, 8), 16, 10).cast("bigint")
    some = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.shiftleft(digits(i, 1), 32).bitwiseOR(digits(i, 9)))
    return F.when(n > 0, some).otherwise(F.array().cast("array<bigint>"))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and sketch of each row."""
    return ids_and_text(df, id_col, text_col).select("doc_id", bottom(shingle_hashes(word_hashes(F.col("text")))).alias("sketch"))


def _blocks(docs: DataFrame) -> Column:
    """Block number of each row by descending id, with about BLOCK_ROWS ids in each; rows without an id come last, by _tie.

    Quantiles part the ids into at most STRATA ranges, and each range is cut evenly, so that ids may lie unevenly.
    """
    total = docs.count()
    strata = min(STRATA, max(1, total // BLOCK_ROWS))
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / strata for i in range(1, strata)], 0.2 / strata))) if strata > 1 else []
    above = F.size(F.filter(F.array(*(F.lit(min(int(b), (1 << 63) - 1)) for b in bounds)), lambda b: b < F.col("doc_id"))) if bounds else F.lit(0)
    stats = {r["s"]: r for r in docs.filter("doc_id is not null").groupBy(above.alias("s")).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).collect()}  # at most STRATA rows
    firsts, lows, widths, at = [], [], [], 0
    for k in range(len(bounds), -1, -1):
        row = stats.get(k)
        n = max(1, row["n"] // BLOCK_ROWS) if row else 1
        low, high = (row["low"], row["high"]) if row else (0, 0)
        firsts.append(at)
        lows.append(high)
        widths.append(max(1, -(-(high - low + 1) // n)))
        at += n
    # ids may lie as far apart as longs can, so distances are wider numbers; rounding in the division keeps the order
    numbers = lambda x, kind="long": F.array(*(F.lit(str(v)).cast(kind) for v in reversed(x)))
    wide = "decimal(20,0)"
    place = F.floor((F.get(numbers(lows, wide), above) - F.col("doc_id").cast(wide)) / F.get(numbers(widths, wide), above))
    nameless = max(1, docs.filter("doc_id is null").count() // BLOCK_ROWS)
    last = F.floor((F.col("_tie") / F.lit(2.0**64) + 0.5) * nameless)
    return F.coalesce(F.get(numbers(firsts), above) + place, F.lit(at) + last).cast("long")


def edited_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: with those of the next document by descending id.

    After the last document comes the first. Documents are dealt into blocks of neighbouring ids; the next document
    of a block's last one is the first of the next block that has any.
    """
    docs = ids_and_text(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_tie", F.xxhash64("text"))
    dealt = docs.withColumn("block", _blocks(docs.select("doc_id")))
    w = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), "_tie", "text")
    near = dealt.withColumn("next_text", F.lead("text").over(w)).withColumn("words", word_hashes(F.col("text")))
    near = near.withColumn("sketch", bottom(shingle_hashes(F.col("words")), size)).drop("words").withColumn("next_sketch", F.lead("sketch").over(w))
    heads = store(dealt.groupBy("block").agg(F.min_by("text", F.struct(F.bitwise_not(F.coalesce("doc_id", F.lit(0))), "_tie", "text")).alias("head")))
    # numbers only, one for each block; order within groups of blocks, then one row for each group
    numbers = heads.select("block", F.floor(F.col("block") / BLOCK_GROUP).alias("group"))
    everywhere = Window.orderBy("group")
    groups = numbers.groupBy("group").agg(F.min("block").alias("low"))
    groups = groups.select("group", F.coalesce(F.lead("low").over(everywhere), F.first("low").over(everywhere)).alias("beyond"))
    after = numbers.withColumn("following", F.lead("block").over(Window.partitionBy("group").orderBy("block"))).join(groups, "group")
    after = after.select("block", F.coalesce("following", "beyond").alias("following"))
    heads = heads.withColumn("head_words", word_hashes(F.col("head"))).select(F.col("block").alias("following"), "head", bottom(shingle_hashes(F.col("head_words")), size).alias("head_sketch"))
    joined = near.join(after.join(heads, "following").drop("following"), "block", "left")
    return joined.select("doc_id", "text", "sketch", F.coalesce("next_text", "head").alias("next_text"), F.coalesce("next_sketch", "head_sketch").alias("next_sketch"))


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last half is replaced from the next document, and likenesses."""
    pairs = edited_texts(df, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    # each step is a column of its own, so that it is computed once
    sketched = pairs.withColumn("edited", edited).withColumn("words", word_hashes(F.col("edited"))).withColumn("edited_sketch", bottom(shingle_hashes(F.col("words"))))
    return sketched.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles_estimate"),
    )
