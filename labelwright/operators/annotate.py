"""The lexicon annotator: counts keywords, abstains on none, and gives a softmax confidence. Column expressions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.text import first_best, keyword_hits

# The built-in keyword lists, on which results depend.
LEXICONS: dict[str, list[str]] = {
    "diabetes": ["diabetes", "diabetic", "insulin", "glucose", "hba1c", "glycemic", "hyperglycemia", "metformin", "pancreatic", "type 1", "type 2", "t1d", "t2d"],
    "hypertension": ["hypertension", "hypertensive", "blood pressure", "antihypertensive", "systolic", "diastolic", "mmhg"],
    "asthma": ["asthma", "asthmatic", "bronchial", "inhaler", "wheezing", "airway hyperresponsiveness", "corticosteroid inhal"],
    "migraine": ["migraine", "headache", "aura", "triptan", "photophobia", "cephalgia"],
    "positive": ["love", "great", "excellent", "amazing", "perfect", "wonderful", "best", "recommend", "happy", "satisfied", "five star", "5 star"],
    "negative": ["hate", "terrible", "awful", "worst", "broken", "disappointed", "return", "refund", "waste", "poor", "one star", "1 star"],
}
DISEASES = ("diabetes", "hypertension", "asthma", "migraine")
REVIEWS = ("positive", "negative")
RULE_BACKEND = {"backend": "rule", "backend_version": "1.0", "model_id": "rule-keyword-scorer/1.0"}


def lexicon_label(text: Column, labels: Sequence[str], lexicons: Mapping[str, list[str]] = LEXICONS) -> Column:
    """A struct label, confidence, parsed_ok. Without a hit the label is null, the confidence 0 and parsed_ok false; a tie goes to the earlier label."""
    scores = [(label, keyword_hits(text, list(lexicons.get(label, [])))) for label in labels]

    def judge(s: Column) -> Column:
        best = F.array_max(s)
        named = [(label, F.get(s, F.lit(i))) for i, (label, _) in enumerate(scores)]
        share = 1.0 / F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - best))
        hit = best > 0
        return F.struct(
            F.when(hit, first_best(named)).alias("label"),
            F.when(hit, F.round(share, 4)).otherwise(F.lit(0.0)).alias("confidence"),
            hit.alias("parsed_ok"),
        )

    return F.get(F.transform(F.array(F.array(*[s for _, s in scores])), judge), F.lit(0))


def annotate(texts: DataFrame, labels: Sequence[str], id_col: str = "chunk_id", text_col: str = "text", prompt_version: str = "v1", prompt_sha256: str | None = None, lexicons: Mapping[str, list[str]] = LEXICONS) -> DataFrame:
    """One annotation per row, in the columns of the annotation contract. Each row's work is its own, so latency is given as 0.

    The annotation comes out of a generator of one element: a filter on it is not pushed below that, where it would search for all keywords again.
    """
    if not labels:
        raise ValueError("labels must not be empty")
    got = texts.select(F.col(id_col), F.explode(F.array(lexicon_label(F.col(text_col), labels, lexicons))).alias("_a"))
    return got.select(
        F.col(id_col).alias("chunk_id"),
        *[F.lit(v).alias(k) for k, v in RULE_BACKEND.items()],
        F.lit(prompt_version).alias("prompt_version"),
        F.lit(prompt_sha256).cast("string").alias("prompt_sha256"),
        F.col("_a.label").alias("label"),
        F.col("_a.confidence").alias("confidence"),
        F.col("_a.parsed_ok").alias("parsed_ok"),
        F.lit(0.0).alias("latency_ms"),
        F.lit(None).cast("bigint").alias("input_tokens"),
        F.lit(None).cast("bigint").alias("output_tokens"),
    )


def batch_counters(annotations: DataFrame) -> DataFrame:
    """Counts of a batch: items, annotated, abstentions, mean latency."""
    return annotations.agg(
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("label").isNotNull()).alias("n_annotated"),
        F.count_if(F.col("label").isNull()).alias("n_abstentions"),
        F.round(F.avg("latency_ms"), 2).alias("mean_latency_ms"),
    )
