"""Contracts of stages: a schema and constraints, all checked in one aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTRACT_VERSION = "1.0"


@dataclass(frozen=True)
class Contract:
    """Columns with their types, which may be null, which are unique, and conditions by name as SQL."""

    name: str
    columns: dict[str, str]
    nullable: frozenset[str] = frozenset()
    unique: frozenset[str] = frozenset()
    checks: tuple[tuple[str, str], ...] = ()


RAW_ABSTRACT = Contract(
    "RawAbstract",
    {"doc_id": "string", "title": "string", "text": "string", "source": "string", "retrieved_at": "string", "ref_label": "string"},
    frozenset({"title", "ref_label"}),
    frozenset({"doc_id"}),
)
CHUNK = Contract(
    "Chunk",
    {"doc_id": "string", "chunk_id": "string", "chunk_index": "bigint", "text": "string", "n_chars": "bigint", "boundary_ok": "boolean", "ref_label": "string"},
    frozenset({"ref_label"}),
    frozenset({"chunk_id"}),
    (("chunk_index >= 0", "chunk_index >= 0"), ("n_chars > 0", "n_chars > 0")),
)
ANNOTATION = Contract(
    "Annotation",
    {
        "chunk_id": "string", "backend": "string", "backend_version": "string", "model_id": "string", "prompt_version": "string", "prompt_sha256": "string", "label": "string", "confidence": "double",
        "parsed_ok": "boolean", "latency_ms": "double", "input_tokens": "bigint", "output_tokens": "bigint",
    },
    frozenset({"label", "confidence", "input_tokens", "output_tokens"}),
    checks=(
        ("backend in (rule, gemini)", "backend IN ('rule', 'gemini')"),
        ("length of prompt_sha256 = 64", "length(prompt_sha256) = 64"),
        ("confidence in [0, 1]", "confidence BETWEEN 0 AND 1"),
        ("latency_ms >= 0", "latency_ms >= 0"),
        ("input_tokens >= 0", "input_tokens >= 0"),
        ("output_tokens >= 0", "output_tokens >= 0"),
    ),
)
AGREEMENT_METRICS = Contract(
    "AgreementMetrics",
    {"batch_id": "string", "metric": "string", "value": "double", "ci_lo": "double", "ci_hi": "double", "n": "bigint"},
    frozenset({"ci_lo", "ci_hi"}),
    checks=(("n > 0", "n > 0"),),
)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """One row: a count of violations of each constraint. Columns that are missing, too many or of another type raise at once."""
    kinds = dict(df.dtypes)
    wrong = [f"missing {c}" for c in missing_columns(df, list(contract.columns))] + [f"not allowed {c}" for c in df.columns if c not in contract.columns]
    wrong += [f"{c} is {kinds[c]}, not {t}" for c, t in contract.columns.items() if c in kinds and kinds[c] != t]
    if wrong:
        raise ValueError(f"{contract.name} breaks its contract: " + "; ".join(wrong))
    counts = [F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in contract.columns if c not in contract.nullable]
    counts += [(F.count(c) - F.count_distinct(c)).alias(f"repeated {c}") for c in sorted(contract.unique)]
    counts += [F.count_if(~F.expr(sql)).alias(f"not {name}") for name, sql in contract.checks]
    return df.agg(*counts)


def validate(df: DataFrame, contract: Contract) -> DataFrame:
    """`df`, or a ValueError that names all broken constraints with their counts."""
    broken = {k: v for k, v in violations(df, contract).first().asDict().items() if v}
    if broken:
        raise ValueError(f"{contract.name} breaks its contract: " + ", ".join(f"{k}: {v}" for k, v in broken.items()))
    return df
