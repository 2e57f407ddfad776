"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Every five-word shingle is hashed once. The top eight bits of the hash choose one of 256 bins, and each bin keeps its
smallest hash. An empty bin is filled by optimal densification: it looks at bins in a pseudo-random order of its own,
the same for every text, and takes the value of the first that is not empty. Each bin's value is hashed once more with
the bin's number and the low four bits are stored: a fingerprint is 256 hexadecimal digits. Two bins agree by chance once in sixteen times, so the share of
equal digits E estimates the Jaccard likeness as (E - 1/16) / (1 - 1/16), held at 0 from below.

Cases: a null text counts as empty; a text without words has the fingerprint of zeros, whose likeness is 1 to itself
and 0 to all others; one of one to four words has one shingle, its words; equal texts have equal fingerprints; a text
is processed whole, in one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwright.llm.common import words_of
from labelwright.session import spread, table

SHINGLE = 5
BINS = 256
#: Probes before an empty bin ranks all filled bins instead; the order of bins goes on, it doesn't begin anew.
PROBES = 16
EMPTY = "0" * BINS
#: Ranges of keys at most, as their bounds are part of the plan. A range is sorted in one task, with spill.
MAX_RANGES = 4096


def _let(value: Column, body) -> Column:
    """`body(value)`, with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shingle_hashes(text: Column, k: int) -> Column:
    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        windows = _let(hashes, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))
        return F.when(F.size(words) >= k, windows).when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))

    return _let(words_of(text), of_words)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 56).cast("int")


def _bins(sorted_hashes: Column) -> Column:
    """An array with each bin's smallest hash as text, null where the bin is empty. Signed order puts bins 128 to 255 first; the array starts with bin 128, which serves as well."""
    first = F.filter(sorted_hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(sorted_hashes, i - 1))))
    place = lambda h: F.pmod(_bin(h) + F.lit(BINS // 2), F.lit(BINS))

    def spread(f: Column) -> Column:
        commas = lambda h, i: place(h) - F.when(i == 0, F.lit(0)).otherwise(place(F.get(f, i - 1)))
        parts = F.transform(f, lambda h, i: F.concat(F.repeat(F.lit(","), commas(h, i)), F.hex(h)))
        return F.concat(F.array_join(parts, ""), F.repeat(F.lit(","), F.lit(BINS - 1) - place(F.element_at(f, -1))))

    return F.transform(F.split(_let(first, spread), ","), lambda v: F.nullif(v, F.lit("")))


def _densified(bins: Column) -> Column:
    """The digits of all bins. A value is hashed with the bin that takes it, so that one value in many bins gives digits that agree by chance independently."""

    def fill(d: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(d, j).isNotNull())

        def at(k: Column, filled: Column) -> Column:
            probes = [F.get(d, F.xxhash64(k, F.lit(t)).bitwiseAND(F.lit(BINS - 1)).cast("int")) for t in range(PROBES)]
            nearest = F.array_min(F.transform(filled, lambda j: F.struct(F.xxhash64(k, j, F.lit(PROBES)).alias("rank"), F.get(d, j).alias("value"))))
            taken = F.coalesce(F.get(d, k), *probes, nearest["value"])
            return F.hex(F.xxhash64(taken, k).bitwiseAND(F.lit(15)))

        return _let(filled, lambda f: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: at(k, f)))

    return F.lower(F.array_join(_let(bins, fill), ""))


def fingerprint(text: Column, k: int = SHINGLE) -> Column:
    """The fingerprint of a text column, as a string of 256 hexadecimal digits."""
    hashes = F.sort_array(_shingle_hashes(text, k))
    return _let(hashes, lambda h: F.when(F.size(h) == 0, F.lit(EMPTY)).otherwise(_densified(_let(h, _bins))))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard likeness of two fingerprints, 0 to 1, rid of chance agreement."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda s: s))
    chance = 1 / 16
    return F.when(a == b, F.lit(1.0)).when((a == EMPTY) | (b == EMPTY), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def _group_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the key; null keys are below all. Two looks at about sqrt(n) bounds each."""
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*[F.lit(b).cast("bigint") for b in bounds[::step]])
    every = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    c = F.size(F.filter(coarse, lambda b: b <= key))
    inner = F.size(F.filter(F.slice(every, F.greatest(c - 1, F.lit(0)) * step + 1, step), lambda b: b <= key))
    return F.when(key.isNull() | (c == 0), F.lit(0)).otherwise((c - 1) * step + inner)


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Adds the struct `_next`, with `columns` of the next row by ascending key (nulls first, ties by `columns`); after the last row comes the first.

    A window over all rows would be one task. Here the keys are cut into ranges at keys that occur, each range is a
    group of its own window, and the first rows of a range are also put, as markers, at the end of the range before.
    Only the bounds, eight for each shuffle partition and MAX_RANGES at most, come to the driver.
    """
    groups = min(MAX_RANGES, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = docs.agg(
        F.percentile_approx(key, F.array(*[F.lit(i / groups) for i in range(1, groups)]), F.lit(50 * groups)).alias("bounds"),
        F.min(key).alias("least"),
        F.count_if(F.col(key).isNull()).alias("nulls"),
    ).first()
    bounds = sorted(set(found["bounds"] or []) - ({found["least"]} if not found["nulls"] else set()))
    own = [*docs.columns]
    # A row goes to its own range and, if its key is the range's bound, to the one before as a marker.
    if bounds:
        group = _group_of(F.col(key), bounds)
        every = F.array(*[F.lit(b).cast("bigint") for b in bounds])
        spread = docs.withColumn("_group", group)
        at = F.array(F.struct(F.col("_group").alias("g"), F.lit(0).alias("marker")))
        before = F.array(F.struct((F.col("_group") - 1).alias("g"), F.lit(1).alias("marker")))
        spread = spread.withColumn("_at", F.explode(F.when(F.get(every, F.col("_group") - 1) == F.col(key), F.concat(at, before)).otherwise(at))).drop("_group")
    else:
        spread = docs.withColumn("_at", F.struct(F.lit(0).alias("g"), F.lit(0).alias("marker")))
    first_key = F.lit(None).cast("bigint") if found["nulls"] else F.lit(found["least"]).cast("bigint")
    wrap = docs.where(F.col(key).eqNullSafe(first_key)).withColumn("_at", F.struct(F.lit(len(bounds)).alias("g"), F.lit(2).alias("marker")))
    order = Window.partitionBy("_at.g").orderBy(F.col("_at.marker"), F.col(key).asc_nulls_first(), *columns)
    chained = spread.unionByName(wrap).withColumn("_next", F.lead(F.struct(*columns)).over(order))
    return chained.where("_at.marker = 0").select(*own, "_next")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    marked = docs.withColumn("fingerprint", fingerprint(F.col("text")))
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("_next.text"), F.lit(1), part))
    chained = with_next(marked, "doc_id", ["text", "fingerprint"]).select(
        "doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("_next.fingerprint").alias("next_fingerprint")
    )
    return chained.withColumn("edited_fingerprint", fingerprint(F.col("edited"))).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
