"""Command-line programs. They end with 0; 2 for input that is missing, empty or wrong; 3 for drift, if that is asked for.

`python -m labelwright.cli PROGRAM --help`. Paths are opened by Spark; reports are written by the driver where it runs.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.operators import adversarial, annotate, chunk, dedup, drift, taxonomy
from labelwright.plans import batch, reports, runs, study
from labelwright.plans.contracts import RAW_ABSTRACT, validate
from labelwright.plans.settings import Settings
from labelwright.session import local_session
from labelwright.sources import corpora


class Unusable(Exception):
    """Input that a program can't work on; ends it with 2."""


def _filled(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise Unusable(f"no {what} in the input")
    return df


def _report(path: str | None, text: str) -> None:
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")


def extract(spark: SparkSession, a: argparse.Namespace, s: Settings) -> int:
    rows = corpora.read_abstracts_csv(spark, a.from_csv) if a.from_csv else corpora.read_atom(spark, a.feed)
    if a.max_results:
        rows = rows.limit(a.max_results)
    corpora.write_not_empty(validate(_filled(rows, "abstracts"), RAW_ABSTRACT), a.out)
    print(f"abstracts: {spark.read.parquet(a.out).count()}")
    return 0


def chunks(spark: SparkSession, a: argparse.Namespace, s: Settings) -> int:
    docs = spark.read.parquet(a.input)
    made = chunk.chunk(docs, a.chunk_tokens or s.chunk_tokens, s.chunk_overlap if a.overlap is None else a.overlap, s.min_chunk_chars, ref_col="ref_label" if "ref_label" in docs.columns else None)
    corpora.write_chunks_jsonl(chunk.with_boundaries(made, s.min_chunk_chars, strict=True), a.out)
    print(f"chunks: {corpora.read_chunks_jsonl(spark, a.out).count()}")
    return 0


def deduplicate(spark: SparkSession, a: argparse.Namespace, s: Settings) -> int:
    rows = _filled(corpora.read_chunks_jsonl(spark, a.input), "chunks")
    marked = batch.cut(dedup.deduplicate(rows, threshold=a.threshold or s.dedup_threshold, min_chunk_chars=s.min_chunk_chars, verify=not a.estimate, permutations=s.minhash_permutations))
    if a.out:
        marked.where("status = 'kept'").select("doc_id", "chunk_id", "chunk_index", "text").write.mode("overwrite").json(a.out)
    found = dedup.stats_document(marked)
    if a.stats:
        found.coalesce(1).write.mode("overwrite").json(a.stats)
    print(json.dumps(found.first().asDict()))
    return 0


def annotations(spark: SparkSession, a: argparse.Namespace, s: Settings) -> int:
    labels = corpora.parse_labels(a.labels)
    if not labels:
        raise Unusable("no labels")
    rows = _filled(corpora.read_chunks_jsonl(spark, a.chunks), "chunks")
    root = a.batch_dir or s.batch_dir
    name = batch.run_batch(rows, labels, root, a.backend or s.backend, a.prompt or s.prompt_version, name=a.batch_id, cache_dir=s.cache_dir, prompts=a.prompts)
    print(spark.read.parquet(f"{root}/manifests").where(F.col("batch_id") == name).toJSON().first())
    return 0


def monitor(spark: SparkSession, a: argparse.Namespace, s: Settings) -> int:
    base, came = _filled(corpora.read_baseline(spark, a.baseline), "baseline labels"), _filled(corpora.read_baseline(spark, a.incoming, "counts"), "incoming labels")
    verdict = batch.cut(drift.check_drift(base, came, psi_alert=a.psi_alert or s.psi_alert, psi_warn=s.psi_warn, alpha=s.chi2_alpha))
    _report(a.report, reports.drift_report(verdict, drift.aligned(base, came)))
    found = verdict.first().asDict()
    print(json.dumps(found))
    return 3 if a.fail_on_alert and found["alert"] else 0


def experiments(spark: SparkSession, a: argparse.Namespace, s: Settings) -> int:
    log = runs.RunLog(spark, a.db or s.runs_dir)
    try:
        if a.command == "list":
            for row in log.runs().select(*runs.LISTED).toJSON().toLocalIterator():
                print(row)
        elif a.command == "show":
            print(json.dumps(log.show(a.run_id), indent=2))
        else:
            log.export(a.out, a.run_id)
    except KeyError as e:
        raise Unusable(e.args[0]) from e
    return 0


def traps(spark: SparkSession, a: argparse.Namespace, s: Settings) -> int:
    if a.per_trap < 1:
        raise Unusable("--per-trap must be positive")
    cases = adversarial.cases(spark, s.seed if a.seed is None else a.seed, a.per_trap)
    found = batch.cut(adversarial.by_trap(adversarial.annotated(cases)))
    whole = adversarial.overall(found)
    _report(a.report, reports.adversarial_report(found, whole))
    print(json.dumps(whole.first().asDict()))
    return 0


def clusters(spark: SparkSession, a: argparse.Namespace, s: Settings) -> int:
    kinds = ["text", "true_label", "pred_label", "confidence", "source"]
    parts = [corpora.read_disagreements_csv(spark, a.disagreements).select(*kinds)] if a.disagreements else []
    if not a.no_synthetic:
        parts.append(taxonomy.synthetic_disagreements(spark, s.seed if a.seed is None else a.seed).select(*kinds))
    if not parts:
        raise Unusable("no disagreements")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = batch.cut(rows.withColumn("row_id", F.monotonically_increasing_id()))
    if rows.count() < a.min_cluster_size:
        raise Unusable(f"fewer than {a.min_cluster_size} disagreements")
    found = batch.cut(taxonomy.cluster(rows, min_cluster_size=a.min_cluster_size))
    described = taxonomy.describe_clusters(rows, found)
    if a.answers:
        described = taxonomy.named_clusters(described, corpora.read_responses(spark, a.answers)).withColumn("name", F.col("llm_name"))
    themed = batch.cut(rows.select(F.col("row_id").alias("id"), taxonomy.theme(F.col("text")).alias("theme")).join(found, "id"))
    ari, pure = taxonomy.adjusted_rand(themed, "theme", "cluster"), taxonomy.purity(themed, "cluster", "theme")
    _report(a.report, reports.taxonomy_report(batch.cut(described), ari, pure))
    print(json.dumps({**ari.first().asDict(), **pure.first().asDict()}))
    return 0


def score(spark: SparkSession, a: argparse.Namespace, s: Settings) -> int:
    abstracts, rows = corpora.read_study_csv(spark, a.abstracts, corpora.ABSTRACT_CSV), corpora.read_study_csv(spark, a.annotations, corpora.ANNOTATION_CSV)
    found = study.results(abstracts, _filled(rows, "annotations"), corpora.parse_labels(a.labels), a.model, with_baseline=not a.no_baseline)
    study.write_results(spark, found, a.out)
    print(json.dumps(study.headline(found)))
    return 0


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="labelwright", description="Prepares, labels and checks text annotations.")
    sub = top.add_subparsers(dest="program", required=True)

    def program(name: str, run: Callable[..., int], what: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=what)
        p.set_defaults(run=run)
        return p

    p = program("extract", extract, "abstracts from a table or a saved feed")
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--from-csv")
    source.add_argument("--feed")
    p.add_argument("--max-results", type=int)
    p.add_argument("--out", required=True)
    p = program("chunk", chunks, "chunks of abstracts")
    p.add_argument("input")
    p.add_argument("--out", required=True)
    p.add_argument("--chunk-tokens", type=int)
    p.add_argument("--overlap", type=float)
    p = program("dedup", deduplicate, "exact and near duplicates of chunks")
    p.add_argument("input")
    p.add_argument("--threshold", type=float)
    p.add_argument("--estimate", action="store_true", help="MinHash estimates in place of exact likeness")
    p.add_argument("--out")
    p.add_argument("--stats")
    p = program("annotate", annotations, "a versioned batch of annotations")
    p.add_argument("chunks")
    p.add_argument("--backend", choices=batch.BACKENDS)
    p.add_argument("--labels", default=",".join(annotate.DISEASES))
    p.add_argument("--prompt")
    p.add_argument("--prompts", help="folder of prompt files")
    p.add_argument("--batch-id")
    p.add_argument("--batch-dir")
    p = program("monitor", monitor, "drift of a batch against a baseline")
    p.add_argument("--baseline", required=True)
    p.add_argument("--incoming", required=True)
    p.add_argument("--report")
    p.add_argument("--psi-alert", type=float)
    p.add_argument("--fail-on-alert", action="store_true")
    p = program("experiments", experiments, "the run log")
    p.add_argument("--db")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    commands.add_parser("show").add_argument("run_id")
    one = commands.add_parser("export")
    one.add_argument("run_id")
    one.add_argument("--out", required=True)
    p = program("adversarial", traps, "adversarial cases and how the annotator does on them")
    p.add_argument("--per-trap", type=int, default=4)
    p.add_argument("--seed", type=int)
    p.add_argument("--report")
    p = program("taxonomy", clusters, "clusters of disagreements")
    p.add_argument("--disagreements")
    p.add_argument("--no-synthetic", action="store_true")
    p.add_argument("--answers", help="cached answers that name the clusters")
    p.add_argument("--min-cluster-size", type=int, default=3)
    p.add_argument("--seed", type=int)
    p.add_argument("--report")
    p = program("score", score, "the study's results document")
    p.add_argument("abstracts")
    p.add_argument("annotations")
    p.add_argument("--labels", default=",".join(annotate.DISEASES))
    p.add_argument("--model", default="cached")
    p.add_argument("--no-baseline", action="store_true")
    p.add_argument("--out", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        settings = Settings.from_env()
        return a.run(spark or SparkSession.getActiveSession() or local_session(), a, settings)
    except (Unusable, ValueError, FileNotFoundError, AnalysisException) as e:
        print(f"error: {str(e).splitlines()[0]}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
