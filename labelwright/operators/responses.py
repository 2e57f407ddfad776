"""Replaying a model's cached answers: parsing, token counts and annotations. Nothing is called over a network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.sources.corpora import RESPONSE

def parsed(raw: Column, labels: Sequence[str], keep_label: bool = False) -> Column:
    """A struct label, confidence, parsed_ok, input_tokens, output_tokens, raw_text of an answer's JSON text.

    The first part that has a text, `raw_text`, is read as a JSON object, with nothing before and after it. The label is trimmed and lower-cased;
    one that isn't among `labels`, lower-cased too, is null. A confidence outside of [0, 1] is null and leaves the label; one
    that is no number makes both null, or with `keep_label` only itself. parsed_ok: both are there, or with `keep_label` the
    label is. Token counts that are missing are 0.
    """
    answer = F.from_json(raw, RESPONSE)
    parts = answer["candidates"][0]["content"]["parts"]
    text = F.get(F.filter(parts, lambda p: p["text"].isNotNull()), F.lit(0))["text"]
    inner = F.try_parse_json(F.when(F.regexp_like(text, F.lit(r"(?s)^\s*\{.*\}\s*$")), text))
    usage = answer["usageMetadata"]
    found = F.struct(
        F.lower(F.regexp_replace(F.try_variant_get(inner, "$.label", "string"), r"(?U)^\s+|\s+$", "")).alias("l"),
        F.try_variant_get(inner, "$.confidence", "double").alias("c"),
        F.coalesce(usage["promptTokenCount"], F.lit(0)).alias("i"),
        F.coalesce(usage["candidatesTokenCount"], F.lit(0)).alias("o"),
        text.alias("t"),
    )

    def judge(p: Column) -> Column:
        usable = F.lit(keep_label) | p["c"].isNotNull()
        label = F.when(usable & p["l"].isin([x.lower() for x in labels]), p["l"])
        confidence = F.when(p["c"].between(0, 1), p["c"])
        ok = label.isNotNull() & (F.lit(keep_label) | confidence.isNotNull())
        return F.struct(label.alias("label"), confidence.alias("confidence"), ok.alias("parsed_ok"), p["i"].alias("input_tokens"), p["o"].alias("output_tokens"), p["t"].alias("raw_text"))

    return F.get(F.transform(F.array(found), judge), F.lit(0))


def cache_key(id_col: str, prompt_version: str, prompt_sha256: str) -> Column:
    """The key under which the answer to a text is cached."""
    return F.concat(F.lit(f"pipeline:{prompt_version}:{prompt_sha256[:16]}:"), F.col(id_col).cast("string"))


def replay(texts: DataFrame, responses: DataFrame, labels: Sequence[str], key: Column, id_col: str = "chunk_id", prompt_version: str = "v1", prompt_sha256: str | None = None, model_id: str = "cached") -> DataFrame:
    """One annotation per text from the cache, whose file names are SHA-256 digests of keys; a text without an answer is an abstention."""
    keyed = texts.select(F.col(id_col), F.sha2(key, 256).alias("key_sha256"))
    got = keyed.join(responses, "key_sha256", "left").withColumn("_p", parsed(F.col("raw"), labels))
    return got.select(
        F.col(id_col).alias("chunk_id"),
        F.lit("gemini").alias("backend"),
        F.lit("1.0").alias("backend_version"),
        F.lit(model_id).alias("model_id"),
        F.lit(prompt_version).alias("prompt_version"),
        F.lit(prompt_sha256).cast("string").alias("prompt_sha256"),
        F.col("_p.label").alias("label"),
        F.col("_p.confidence").alias("confidence"),
        F.coalesce("_p.parsed_ok", F.lit(False)).alias("parsed_ok"),
        F.lit(0.0).alias("latency_ms"),
        F.col("_p.input_tokens").alias("input_tokens"),
        F.col("_p.output_tokens").alias("output_tokens"),
    )


def unfinished(items: DataFrame, done: DataFrame, key: str, ok: str = "parsed_ok") -> DataFrame:
    """Items that have no successful annotation yet."""
    return items.join(done.where(F.col(ok).cast("boolean")).select(key), key, "left_anti")
