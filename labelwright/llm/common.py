"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run without blanks, tabs and line ends.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder and read from there, so that a lost executor costs no recomputation.

    The folder is the one the session names in spark.checkpoint.dir; a folder of our own is set only where that is unset and
    Spark is local, as other machines couldn't read it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="checkpoints-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    context.setCheckpointDir(named or _own_folder())
    return context._jsc.sc().getCheckpointDir().get()


#: A key with more than this part of the rows is hot; so there are fewer hot keys than its inverse.
HOT_PART = 1e-3


def join_counted(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` joined to `facts`, which has one row per key with the number `n` of its rows, on the column `key`.

    `total` is the number of rows, or more. The facts of hot keys, 1 / HOT_PART at most, are broadcast, so that the rows
    of a hot key stay in the tasks that have them; all others are joined as Spark sees fit. Keys are not null.
    """
    hot = F.col("n") > total * HOT_PART
    named = facts.select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in facts.columns if c != key])
    marked = rows.join(F.broadcast(named.where(F.col("_hot_n") > total * HOT_PART)), F.col(key) == F.col("_hot"), "left")
    at_once = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot_{c}").alias(c) for c in facts.columns if c != key])
    return marked.where(F.col("_hot").isNull()).select(*rows.columns).join(facts.where(~hot), key).select(*at_once.columns).unionByName(at_once)


def release() -> None:
    """Memory that this process has freed goes back to the system. Workers are kept for later stages, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        release()


def words_of(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def unit_hash(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key and the salt alone: the first 52 bits of an MD5 digest.

    MD5 is used because other SQL engines have it too, so that results can be compared with theirs.
    """
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))
