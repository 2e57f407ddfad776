"""Calibration, paired comparison, error slices, bootstrap intervals and cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelwright.functions.intervals import Z95, binomial_two_sided, wilson

# Prices in dollars per million tokens, and what a human label costs.
PRICE_IN, PRICE_OUT, HUMAN_LABEL = 0.30, 2.50, 0.25


def bin_edges(n_bins: int = 10) -> list[float]:
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]


def calibration_bin(confidence: Column, n_bins: int = 10) -> Column:
    """The bin, from 0: bins hold their upper edge and not their lower, but the first holds both. Null outside [0, 1]."""
    edges = bin_edges(n_bins)
    number = F.when(confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1), F.lit(None))
    for i in range(n_bins):
        number = number.when(confidence <= edges[i + 1], F.lit(i))
    return number


def calibration_bins(rows: DataFrame, confidence: str = "confidence", correct: str = "correct", n_bins: int = 10) -> DataFrame:
    """One row per bin that isn't empty: bin, lo, hi, n, mean_confidence, accuracy."""
    edges = F.array(*[F.lit(e) for e in bin_edges(n_bins)])
    binned = rows.select(calibration_bin(F.col(confidence).cast("double"), n_bins).alias("bin"), F.col(confidence).cast("double").alias("c"), F.col(correct).cast("double").alias("ok")).where("bin IS NOT NULL")
    sums = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("mean_confidence"), F.avg("ok").alias("accuracy"))
    return sums.select("bin", F.get(edges, F.col("bin")).alias("lo"), F.get(edges, F.col("bin") + 1).alias("hi"), "n", "mean_confidence", "accuracy")


def calibration_error(bins: DataFrame) -> DataFrame:
    """One row: n and the expected calibration error."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.try_divide(F.sum(gap), F.sum("n").cast("double")).alias("ece"))


def discordant(rows: DataFrame, first_correct: str, second_correct: str) -> DataFrame:
    """One row: b01, first right and second wrong, and b10, the reverse."""
    a, b = F.col(first_correct).cast("boolean"), F.col(second_correct).cast("boolean")
    return rows.agg(F.count_if(a & ~b).alias("b01"), F.count_if(~a & b).alias("b10"))


def mcnemar(counts: DataFrame) -> DataFrame:
    """Adds the odds b01 / b10, infinite without b10, and the exact two-sided p-value."""
    odds = F.when(F.col("b10") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("b01").cast("double"), F.col("b10").cast("double")))
    return counts.select("b01", "b10", odds.alias("odds"), binomial_two_sided(F.col("b01"), F.col("b10")).alias("p_value"))


def accuracy_by(rows: DataFrame, group: str | Column, correct: str = "correct", z: float = Z95, clamp: bool = False) -> DataFrame:
    """One row per group: n, accuracy and Wilson's interval."""
    group = F.col(group) if isinstance(group, str) else group
    sums = rows.groupBy(group.alias("group")).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("bigint")).alias("k"))
    ci = wilson(F.col("k"), F.col("n"), z, clamp)
    return sums.select("group", "n", (F.col("k") / F.col("n")).alias("accuracy"), ci["lo"].alias("ci_lo"), ci["hi"].alias("ci_hi"))


def with_quartile(rows: DataFrame, value: str) -> DataFrame:
    """Adds `quartile`, 1 to 4, by linearly interpolated edges over all rows; bins hold their upper edge, so ties make unequal groups. The edges are one row."""
    edges = rows.agg(F.percentile(F.col(value).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_edges"))
    v = F.col(value).cast("double")
    number = F.when(v <= F.get("_edges", F.lit(0)), 1).when(v <= F.get("_edges", F.lit(1)), 2).when(v <= F.get("_edges", F.lit(2)), 3).otherwise(4)
    return rows.crossJoin(F.broadcast(edges)).withColumn("quartile", F.when(v.isNotNull(), number)).drop("_edges")


def describe(rows: DataFrame, value: str) -> DataFrame:
    """One row: count, mean, sample deviation, least, quartiles, greatest."""
    v = F.col(value).cast("double")
    quartile = lambda p: F.percentile(v, F.lit(p))
    return rows.agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), quartile(0.25).alias("p25"), quartile(0.5).alias("p50"), quartile(0.75).alias("p75"), F.max(v).alias("max")
    )


def token_cost(rows: DataFrame, tokens_in: str, tokens_out: str, price_in: float = PRICE_IN, price_out: float = PRICE_OUT, human: float = HUMAN_LABEL) -> DataFrame:
    """One row: items, tokens, cost in all, cost of 1,000 items by model and by hand."""
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(tokens_in), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(tokens_out), F.lit(0)).alias("tokens_out"))
    cost = F.col("tokens_in") / 1e6 * price_in + F.col("tokens_out") / 1e6 * price_out
    return sums.withColumn("cost", cost).withColumn("cost_per_1k", F.try_divide(F.col("cost") * 1000, F.col("n").cast("double"))).withColumn("human_per_1k", F.lit(1000 * human))


def review_triage(rows: DataFrame, confidence: str = "confidence", at: float = 0.9, human: float = HUMAN_LABEL, model_per_1k: float = 0.2058) -> DataFrame:
    """One row: items, items to review (confidence not above `at`, or none), their share, cost of 1,000 items with review."""
    sums = rows.agg(F.count("*").alias("n"), F.count_if(F.col(confidence).isNull() | (F.col(confidence) <= at)).alias("n_review"))
    share = F.try_divide(F.col("n_review").cast("double"), F.col("n").cast("double"))
    return sums.withColumn("share_review", share).withColumn("cost_per_1k", F.col("share_review") * 1000 * human + model_per_1k)


def kappa_of(counts: np.ndarray) -> np.ndarray:
    """Cohen's kappa of stacked confusion matrices (draws, K, K)."""
    n = counts.sum(axis=(1, 2))
    po = np.trace(counts, axis1=1, axis2=2) / n
    pe = (counts.sum(axis=2) * counts.sum(axis=1)).sum(axis=1) / n**2
    return np.where(pe == 1, 1.0, (po - pe) / np.where(pe == 1, 1.0, 1 - pe))


def ac1_of(counts: np.ndarray) -> np.ndarray:
    """Gwet's AC1 of stacked confusion matrices; K is their width."""
    n, k = counts.sum(axis=(1, 2)), counts.shape[1]
    pi = (counts.sum(axis=2) + counts.sum(axis=1)) / (2 * n[:, None])
    pe = (pi * (1 - pi)).sum(axis=1) / max(1, k - 1)
    return np.where((pe >= 1) | (k <= 1), 1.0, (np.trace(counts, axis1=1, axis2=2) / n - pe) / np.where(pe >= 1, 1.0, 1 - pe))


STATISTICS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"kappa": kappa_of, "ac1": ac1_of}


def bootstrap_ci(cells: DataFrame, labels: list[str], statistic: str | Callable[[np.ndarray], np.ndarray] = "kappa", draws: int = 2000, seed: int = 20261002, alpha: float = 0.05) -> DataFrame:
    """One row: estimate, lo, hi of a statistic of the confusion matrix, by percentiles over multinomial draws of its cells.

    Resampling items is resampling cells, so the work doesn't grow with the items: one task takes the cells, at most the
    square of the number of labels.
    """
    stat = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    name = statistic if isinstance(statistic, str) else getattr(statistic, "__name__", "statistic")
    at = {x: i for i, x in enumerate(labels)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((len(at), len(at)))
        for batch in batches:
            for t, p, n in zip(batch["true"], batch["pred"], batch["n"]):
                if t not in at or p not in at:
                    raise ValueError(f"label outside the list: {t}, {p}")
                table[at[t], at[p]] += n
        n = int(table.sum())
        if n == 0:
            return
        drawn = np.random.default_rng(seed).multinomial(n, (table / n).ravel(), size=draws).reshape(draws, *table.shape).astype(float)
        lo, hi = np.percentile(stat(drawn), [100 * alpha / 2, 100 * (1 - alpha / 2)])
        yield pd.DataFrame({"statistic": [name], "estimate": [float(stat(table[None])[0])], "lo": [float(lo)], "hi": [float(hi)], "draws": [draws], "n": [n]})

    return cells.coalesce(1).mapInPandas(run, "statistic string, estimate double, lo double, hi double, draws bigint, n bigint")
