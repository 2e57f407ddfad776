"""Token counts behind a cache of digests.

Each text is reduced to the SHA-256 digest of its normalised content (null becomes empty; nothing else may change, since
the tokenizer sees every byte), and the tokenizer to the digest of its file and of how it is called. Counts are stored
under both digests in a Parquet table; only the distinct texts that the table doesn't know are encoded, and their counts
are appended. A second run over the same texts encodes nothing.

A text that occurs often is dropped to one a task before the shuffle by digest, and to one in all after it. A task
remembers the digests that it has seen, 32 bytes each, for the texts of its partition.

Files are read by the library for their kind: tokenizers for .json, sentencepiece for .model. No begin, end or other
special tokens are added, nothing is truncated or padded, and special strings inside texts are treated as the library
treats them by default.

Cases: null texts count as empty and have 0 tokens; repeated rows and texts are counted for each row; texts are encoded
whole; an empty table gives an empty result and leaves the cache as it is. Columns of the input with the operator's
names are replaced. The cache may hold an entry twice, when two runs append it at once; both say the same.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm.common import cut, ensure_checkpoint_dir
from labelwright.session import spread, table

LIMIT = 512
TOKENIZER = "byte_bpe_50k.json"
#: Characters that are encoded in one call of the library.
CALL_CHARS = 1_000_000
_VERSION = "counts-1"
_CACHE = "digest binary, tokenizer string, n_tokens bigint"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + _VERSION.encode()).hexdigest()


def counter(path: str):
    """A function from a list of texts to their numbers of tokens."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        one = Tokenizer.from_file(path)
        one.no_truncation()
        one.no_padding()
        return lambda texts: [len(e.ids) for e in one.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        two = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in two.encode(texts, num_threads=1)]
    raise ValueError(f"no library for {path}")


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest hasn't come before in this task."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for digest in batch.column("digest").to_pylist():
            fresh.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def encode_distinct(texts: DataFrame, path: str | None) -> DataFrame:
    """`texts` (digest, text), dealt by digest: digest and n_tokens, once for each digest of a partition. A worker looks for the default tokenizer itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path or tokenizer_path())
        for batch in _unseen(batches):
            found: list[int] = []
            lengths = pc.utf8_length(batch.column("text")).to_pylist()
            start = size = 0
            for i, n in enumerate(lengths):
                size += n
                if size >= CALL_CHARS or i == len(lengths) - 1:
                    found += count(batch.column("text").slice(start, i + 1 - start).to_pylist())
                    start, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(found, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens bigint")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The stored counts of one tokenizer version, or None if there is no table yet."""
    if not _exists(spark, cache):
        return None
    return spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """`docs` without the text and with `n_bytes`, `n_tokens`, `over_limit`.

    `cache` is the table's path, in a folder that all executors share; later calls with the same path find what earlier
    ones stored. Without it a new, empty table is made in the checkpoint folder, so that every distinct text is encoded.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(path or tokenizer_path())
    cache = cache or f"{ensure_checkpoint_dir(spark)}/token-counts-{uuid4().hex}"
    plain = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(plain, 256))
    every = docs.select(digest.alias("digest"), plain.alias("text"))
    misses = every.mapInArrow(_unseen, "digest binary, text string").repartition("digest")
    known = read_cache(spark, cache, version)
    if known is not None:
        misses = misses.join(known, "digest", "left_anti")
    encode_distinct(misses, path).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = cut(read_cache(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    own = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c != text and c not in own]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(None).alias("_none"))
    keyed = docs.select(row.alias("_row"), F.octet_length(plain).cast("bigint").alias("n_bytes"), digest.alias("digest"))
    joined = keyed.join(counts, "digest", "left")
    return joined.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
