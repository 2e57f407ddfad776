"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed by source, the sums give each source a target and so a repetition rate, and each document is emitted
floor(rate) times, plus once more if its hash-seeded number in [0, 1) lies below the fraction of the rate.

Targets are shares by weight, held at `max_repeat` times the source's size; what a held source leaves over is shared
again by weight. That end state has a closed form: sort sources by the weight at which each would be held, and the level
follows from running sums. It is one window over a table with a row per source.

Cases: a null text or one without words has size 0 and is emitted like others of its source; a source of size 0 has
target 0 and emits nothing; a null source is a source of its own, after all others; rows that repeat a key share their
draw; an empty table gives an empty result. Columns that the operator needs for itself begin with `_mix_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelwright.llm.common import WORD, unit_hash
from labelwright.session import table

SALT = "mix-1:"
MAX_REPEAT = 3
WEIGHT_CYCLE = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def cyclic_weights(sources: DataFrame, source: str, cycle: tuple[int, ...] = WEIGHT_CYCLE) -> DataFrame:
    """Adds `_mix_weight`: the cycle's numbers dealt to the sources by code point, null last."""
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last()))
    numbers = F.array(*[F.lit(w) for w in cycle])
    return sources.withColumn("_mix_weight", F.get(numbers, F.pmod(rank - 1, F.lit(len(cycle)))).cast("bigint"))


def source_targets(docs: DataFrame, size: Column, source: str = "source", weights=cyclic_weights, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: the source, `_mix_size`, `_mix_target` and `_mix_rate`. `weights` adds `_mix_weight` to a table of sources."""
    sums = docs.groupBy(F.col(source)).agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("_mix_size"))
    held_at = F.col("_mix_size") * max_repeat / F.col("_mix_weight")
    order = Window.orderBy(held_at.asc(), F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (
        weights(sums, source)
        .withColumn("_mix_all", F.sum("_mix_size").over(whole))
        .withColumn("_mix_held", F.coalesce(F.sum(F.col("_mix_size") * max_repeat).over(before), F.lit(0)))
        .withColumn("_mix_free", F.sum("_mix_weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    # A source is held if the level, as it stands when all earlier ones are held, would give it more than its limit.
    # The sources are in the order in which they reach their limits, so the first that is free fixes the level.
    share = (F.col("_mix_all") - F.col("_mix_held")) * F.col("_mix_weight")
    is_free = F.col("_mix_size") * max_repeat * F.col("_mix_free") >= share
    level = F.min(F.when(is_free, F.struct(held_at.alias("at"), (F.col("_mix_all") - F.col("_mix_held")).alias("rest"), F.col("_mix_free").alias("free")))).over(whole)
    return (
        ranked.withColumn("_mix_level", level)
        .withColumn("_mix_open", held_at >= F.col("_mix_level.at"))
        .withColumn(
            "_mix_target",
            F.when(F.col("_mix_size") == 0, F.lit(0.0))
            .when(F.col("_mix_open"), F.col("_mix_level.rest") * F.col("_mix_weight") / F.col("_mix_level.free"))
            .otherwise((F.col("_mix_size") * max_repeat).cast("double")),
        )
        .withColumn("_mix_rate", F.when(F.col("_mix_size") == 0, F.lit(0.0)).otherwise(F.col("_mix_target") / F.col("_mix_size")))
        .select(F.col(source).alias("_mix_source"), "_mix_size", "_mix_target", "_mix_rate")
    )


def with_copies(docs: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", salt: str = SALT) -> DataFrame:
    """Adds `_mix_size`, `_mix_target`, `_mix_rate` of each document's source and `_mix_copies`, how often the mix takes it.

    The table of sources is joined without a hint: Spark broadcasts it when it has measured it to be small, and else
    splits the partitions of hot sources. Columns of `docs` with the names of those added are replaced.
    """
    docs = docs.drop("_mix_source", "_mix_size", "_mix_target", "_mix_rate", "_mix_copies")
    extra = (unit_hash(F.col(key), salt) < F.col("_mix_rate") - F.floor("_mix_rate")).cast("bigint")
    joined = docs.join(targets, docs[source].eqNullSafe(targets["_mix_source"]), "left").drop("_mix_source")
    return joined.withColumn("_mix_copies", F.floor("_mix_rate") + extra)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", max_repeat: int = MAX_REPEAT, salt: str = SALT) -> DataFrame:
    """The mixed documents, with the columns of `docs`, whatever their names; a document that is taken twice is there twice."""
    targets = source_targets(docs, word_count(F.col(text)), source, max_repeat=max_repeat)
    rows = docs.select(F.struct("*").alias("_mix_row"), F.col(key).alias("_mix_key"), F.col(source).alias("_mix_from"))
    dealt = with_copies(rows, targets, "_mix_key", "_mix_from", salt).where("_mix_copies > 0")
    return dealt.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_mix_copies")))).select("_mix_row.*")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sized, F.col("size"))
    return with_copies(sized, targets).select(
        "doc_id",
        "size",
        F.col("_mix_size").alias("source_size"),
        F.round("_mix_target", 6).alias("target"),
        (F.col("size") * F.col("_mix_copies")).cast("bigint").alias("taken"),
    )


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sized GROUP BY source),
s AS (SELECT source, n, (rk - 1) % 3 + 1 AS w, 3.0 * n / ((rk - 1) % 3 + 1) AS held_at FROM s0),
level AS (
  SELECT a.held_at,
         (SELECT sum(n) FROM s) - coalesce(3 * (SELECT sum(n) FROM s AS b WHERE b.held_at < a.held_at), 0) AS rest,
         (SELECT sum(w) FROM s AS b WHERE b.held_at >= a.held_at) AS free
  FROM s AS a),
cut AS (SELECT held_at, rest, free FROM level WHERE held_at * free >= rest ORDER BY held_at LIMIT 1),
t AS (SELECT source, n, CASE WHEN n = 0 THEN 0.0 WHEN s.held_at >= cut.held_at THEN rest::DOUBLE * w / free ELSE 3.0 * n END::DOUBLE AS target FROM s, cut),
r AS (SELECT sized.doc_id, sized.size, t.n AS source_size, target, CASE WHEN t.n = 0 THEN 0.0 ELSE target / t.n END AS rate,
             ('0x' || substr(md5('mix-1:' || coalesce(sized.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
      FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
