"""A training-data pipeline over `documents`: five stages, each one an operator of labelwright.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of `documents`.

1. quality rules: documents that fail the base rules, or whose content share by the line field is too low, go;
2. quality classifier: documents whose score is under the threshold go;
3. SimHash near-duplicates: of each component the document with the smallest id stays;
4. mixing: sources are repeated or thinned to their target weights, so a document may be there several times, or not;
5. SentencePiece: each distinct document of the mix gets its sampled segmentations, with how often the mix takes it.

The models of stages 1 and 2 are trained on `labels` and on `documents`; what reaches stage 2 has hardly a bad document left
to learn from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelwright.llm import common, lattice_sampling, mixing, quality_classifier, quality_rules, simhash
from labelwright.session import table

#: Words in a shingle and the least likeness of near-duplicates.
NEAR_WORDS = 5
NEAR_LIKENESS = 0.8


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, quality_rules.trained_field(docs, table(spark, sf_dir, "labels")))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs, k=NEAR_WORDS, similarity=NEAR_LIKENESS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lattice_sampling.sample_segmentations(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("simhash near-dedup", near_duplicates_stage),
    ("mixing sources", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Trained models and sampled segmentations are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the checkpoint folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
