"""The batch pipeline: chunk, check, deduplicate, annotate, score against reference labels, write a versioned batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import asdict
from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelwright.operators import agreement, annotate, chunk, dedup, responses
from labelwright.plans.contracts import AGREEMENT_METRICS, ANNOTATION, CHUNK, CONTRACT_VERSION, RAW_ABSTRACT, validate
from labelwright.plans.materialize import cut
from labelwright.plans.runs import RunLog
from labelwright.plans.settings import Settings
from labelwright.sources.corpora import read_prompt, read_responses

Annotator = Callable[..., DataFrame]
BACKENDS = ("gemini", "rule")
DEFAULT_PROMPT = "Classify the text into one of: {labels}.\n\n{text}"


def get_backend(name: str, cache_dir: str = "api_cache") -> Annotator:
    """A function of (texts, labels, prompt_version=, prompt_sha256=) that gives one annotation per text: by keywords, or from the model's answers in `cache_dir`."""
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}; known: {', '.join(BACKENDS)}")
    if name == "rule":
        return annotate.annotate

    def from_cache(texts: DataFrame, labels: Sequence[str], prompt_version: str, prompt_sha256: str) -> DataFrame:
        key = responses.cache_key("chunk_id", prompt_version, prompt_sha256)
        return responses.replay(texts, read_responses(texts.sparkSession, cache_dir), labels, key, prompt_version=prompt_version, prompt_sha256=prompt_sha256)

    return from_cache


def batch_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ-") + uuid4().hex[:8]


def run_batch(chunks: DataFrame, labels: Sequence[str], root: str, backend: str = "rule", prompt_version: str = "v1", prompt: str = DEFAULT_PROMPT, name: str | None = None, cache_dir: str = "api_cache", prompts: str | None = None) -> str:
    """With `prompts`, a folder of prompt files, the prompt is the version's file there. Annotates chunks and writes `annotations`, partitioned by batch, then the manifest's row; a batch without a manifest isn't finished. Gives the batch id."""
    if not labels:
        raise ValueError("labels must not be empty")
    run = get_backend(backend, cache_dir)
    name = name or batch_id()
    sha = read_prompt(chunks.sparkSession, prompts, prompt_version)[1] if prompts else hashlib.sha256(prompt.encode()).hexdigest()
    done = validate(cut(run(chunks, list(labels), prompt_version=prompt_version, prompt_sha256=sha)), ANNOTATION)
    done.withColumn("batch_id", F.lit(name)).write.mode("append").partitionBy("batch_id").parquet(f"{root}/annotations")
    manifest = annotate.batch_counters(done).select(
        F.lit(name).alias("batch_id"),
        F.lit(CONTRACT_VERSION).alias("contract_version"),
        F.lit(datetime.now(timezone.utc).isoformat()).alias("created_at"),
        F.lit(backend).alias("backend"),
        F.lit(prompt_version).alias("prompt_version"),
        F.lit(sha).alias("prompt_sha256"),
        F.array(*[F.lit(x) for x in labels]).alias("labels"),
        "*",
    )
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/manifests")
    return name


def run_pipeline(raw: DataFrame, labels: Sequence[str], root: str, settings: Settings | None = None, limit: int = 0, strict: bool = False) -> dict[str, object]:
    """The whole job over raw abstracts. `limit` takes the first documents by id, 0 all. Gives the batch id and the frames of each stage."""
    settings = settings or Settings()
    docs = validate(raw, RAW_ABSTRACT)
    if limit:
        docs = docs.orderBy("doc_id").limit(limit)
    chunks = chunk.chunk(docs, settings.chunk_tokens, settings.chunk_overlap, settings.min_chunk_chars, ref_col="ref_label")
    checked = cut(chunk.with_boundaries(chunks, settings.min_chunk_chars, strict=strict).select(*CHUNK.columns))
    validate(checked, CHUNK)
    marked = cut(dedup.deduplicate(checked, threshold=settings.dedup_threshold, min_chunk_chars=settings.min_chunk_chars if strict else None))
    kept = cut(marked.where("status = 'kept'").select(*CHUNK.columns))
    if kept.isEmpty():
        raise ValueError("no chunks are left")
    name = run_batch(kept, labels, root, settings.backend, settings.prompt_version, cache_dir=settings.cache_dir)
    spark = raw.sparkSession
    refs = kept.where("ref_label IS NOT NULL").select("chunk_id", "ref_label")
    refs.withColumn("batch_id", F.lit(name)).write.mode("append").partitionBy("batch_id").parquet(f"{root}/ref_labels")
    annotations = spark.read.parquet(f"{root}/annotations").where(F.col("batch_id") == name)
    pairs = cut(annotations.join(refs, "chunk_id", "left").where("parsed_ok AND ref_label IS NOT NULL").select("chunk_id", F.col("ref_label").alias("true"), F.col("label").alias("pred")))
    metrics = None
    if not pairs.isEmpty():
        metrics = cut(agreement.agreement_bundle(pairs, "chunk_id", batch_id=name))
        validate(metrics, AGREEMENT_METRICS)
        metrics.coalesce(1).write.mode("append").json(f"{root}/metrics")
        first = annotations.select("model_id", "backend_version", "prompt_sha256").first()
        values = {r["metric"]: (r["value"], r["ci_lo"], r["ci_hi"]) for r in metrics.collect()}  # a row per statistic and label
        RunLog(spark, f"{root}/runs").log(backend=settings.backend, model_id=first["model_id"], prompt_version=settings.prompt_version, prompt_sha256=first["prompt_sha256"], n_items=pairs.count(), metrics=values, config=asdict(settings), backend_version=first["backend_version"], prompt_path=f"prompts/{settings.prompt_version}_classify.md", batch_id=name, labels=labels, seed=settings.seed)
    return {"batch_id": name, "chunks": checked, "dedup": dedup.stats(marked, settings.dedup_threshold), "annotations": annotations, "metrics": metrics}
