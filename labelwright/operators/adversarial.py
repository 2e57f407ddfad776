"""Adversarial cases from templates, and how an annotator does on each kind of trap."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.operators.annotate import DISEASES, REVIEWS, lexicon_label

# Trap, intended label, template and why it is hard, in the order in which cases are drawn.
TEMPLATES: list[tuple[str, str, str, str]] = [
    ("boundary_comorbidity", "diabetes", "In a cohort of {n} adults with type 2 diabetes and resistant hypertension, we examined whether intensive blood pressure lowering reduces cardiovascular events. Glycemic control was maintained with metformin throughout. The primary outcome was change in HbA1c at 24 months.", "Both diseases named; hypertension appears first and dominates the methods, but the measured outcome is glycemic (diabetes)."),
    ("boundary_comorbidity", "hypertension", "We randomized {n} hypertensive patients with comorbid type 2 diabetes to intensive vs standard blood pressure targets. Diabetes medications were held constant. The primary endpoint was systolic blood pressure below 130 mmHg.", "Diabetes named as a comorbidity; the endpoint is blood pressure (hypertension)."),
    ("drug_name_trap", "hypertension", "Metformin was co-prescribed in {pct}% of the hypertensive cohort for metabolic syndrome. After 12 weeks of the antihypertensive regimen, mean systolic pressure fell by {drop} mmHg. No diabetes diagnosis was present at baseline.", "A diabetes drug (metformin) appears in a hypertension study; keyword annotators latch onto the drug name."),
    ("drug_name_trap", "diabetes", "Participants with type 2 diabetes received lisinopril for renal protection. The trial's primary outcome was progression of albuminuria and HbA1c change; blood pressure was a secondary safety measure only.", "An antihypertensive (lisinopril) appears in a diabetes renal-outcome study."),
    ("symptom_overlap", "diabetes", "Patients reported fatigue, blurred vision, and slow wound healing over {n} months. Fasting glucose averaged {glu} mg/dL. Fundoscopic examination showed early diabetic retinopathy.", "Fatigue and blurred vision overlap with hypertension; the discriminating evidence (glucose, retinopathy) sits late in the abstract."),
    ("symptom_overlap", "hypertension", "The patient presented with headache, dizziness, and fatigue. Ambulatory monitoring showed mean 24-hour pressure of {bp} mmHg with a non-dipping pattern. No hyperglycemia was documented.", "Headache/dizziness/fatigue are shared symptoms; only the pressure reading discriminates."),
    ("ambiguous_multi_disease", "asthma", "In patients with chronic kidney disease, we compared inhaled corticosteroid response in those with and without comorbid diabetes. Asthma control questionnaire scores were the primary outcome in the {n}-patient substudy.", "Three diseases named (kidney disease, diabetes, asthma); the outcome is asthma control."),
    ("ambiguous_multi_disease", "migraine", "Among {n} emergency visits for headache with hypertensive urgency, we tested whether migraine history predicts admission. Triptan use was documented in {pct}% of cases with a final migraine diagnosis.", "Hypertension and headache co-occur; the classification target is migraine."),
    ("hedging_language", "diabetes", "These findings may suggest a possible association between the observed metabolic pattern and diabetes-related pathways, although the evidence remains inconclusive and further study is warranted.", "Hedged language with no definitive disease statement; annotators must commit despite the uncertainty."),
    ("hedging_language", "hypertension", "Blood pressure trends were suggestive but not conclusive of a treatment effect; the authors note the association with hypertension outcomes requires confirmation in larger samples.", "Same hedging pattern on the hypertension side."),
    ("sarcastic_review", "negative", "Oh great, another phone charger that works for exactly two days before dying. I just LOVE buying the same thing three times. Five stars for consistency, I guess.", "Sarcastic positive surface sentiment with negative intent; keyword annotators count 'love' and 'five stars'."),
    ("sarcastic_review", "negative", "Fantastic product. It broke the first week, customer service was super helpful (they hung up on me twice), and I would absolutely recommend it to my worst enemy.", "Praise words used ironically throughout; true label is negative."),
    ("sarcastic_review", "positive", "Yeah, the box was ugly and shipping took forever, but honestly this is the best purchase I have made all year. Works perfectly, zero complaints about the actual product.", "Negative surface details with a genuinely positive verdict; tests whether the annotator weighs the conclusion over the complaints."),
]
# What fills the templates' slots, in the order of drawing.
SLOTS = {"n": [120, 240, 480, 960], "pct": [18, 34, 47, 62], "drop": [8, 11, 14], "glu": [168, 192, 214], "bp": ["152/96", "148/94", "161/99"]}
REVIEW_TRAPS = {"sarcastic_review"}
CASE = "case_id string, trap_type string, intended_label string, label_set string, text string, why_hard string, generator string, seed bigint, ord bigint"


def cases(spark: SparkSession, seed: int = 20261008, per_template: int = 4) -> DataFrame:
    """The seeded cases in shuffled order, `ord`; every slot is drawn for every case, whether its template has it or not."""
    rng = random.Random(seed)
    rows = []
    for trap, intended, template, why in TEMPLATES:
        for _ in range(per_template):
            filled = template.format(**{slot: rng.choice(values) for slot, values in SLOTS.items()})
            rows.append((f"adv-{len(rows):03d}", trap, intended, "reviews" if trap in REVIEW_TRAPS else "diseases", filled, why, "dry-run-templates", seed))
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], CASE)


def llm_cases(responses: DataFrame, json_col: str, seed: int = 0) -> DataFrame:
    """Cases that a model wrote: one row per element of each JSON array; a text that is no such array gives none."""
    kind = "array<struct<trap_type string, intended_label string, label_set string, text string, why_hard string>>"
    found = responses.select(F.explode(F.from_json(F.col(json_col), kind)).alias("c")).where("c.text IS NOT NULL")
    return found.select(F.concat(F.lit("llm-"), F.substring(F.sha2("c.text", 256), 1, 8)).alias("case_id"), "c.*", F.lit("llm").alias("generator"), F.lit(seed).cast("bigint").alias("seed"))


def annotated(found: DataFrame) -> DataFrame:
    """Cases with the lexicon annotator's label, confidence and whether it is the intended one."""
    diseases, reviews = lexicon_label(F.col("text"), DISEASES), lexicon_label(F.col("text"), REVIEWS)
    got = found.withColumn("_a", F.when(F.col("label_set") == "reviews", reviews).otherwise(diseases))
    right = F.coalesce(F.col("_a.label") == F.col("intended_label"), F.lit(False))
    return got.select(*found.columns, F.col("_a.label").alias("predicted"), F.col("_a.confidence").alias("confidence"), right.alias("correct"))


def by_trap(judged: DataFrame) -> DataFrame:
    """One row per trap: n, correct, accuracy (3 places), held (accuracy of 0.75 or more), misses in order, first (its first case's place)."""
    miss = F.when(~F.col("correct"), F.struct("ord", "case_id", F.col("intended_label").alias("intended"), "predicted", "confidence", "why_hard"))
    sums = judged.groupBy("trap_type").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.sort_array(F.collect_list(miss)).alias("misses"), F.min("ord").alias("first"))
    accuracy = F.col("correct") / F.col("n")
    return sums.select("trap_type", "n", "correct", F.round(accuracy, 3).alias("accuracy"), (accuracy >= 0.75).alias("held"), "misses", "first")


def overall(traps: DataFrame) -> DataFrame:
    """One row: n, correct, accuracy (3 places), weakest trap (the first seen on a tie)."""
    return traps.agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"), F.min_by("trap_type", F.struct("accuracy", "first")).alias("weakest")).withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 3))
