"""Label drift between a baseline and a batch: PSI, chi-square and the verdict, for one batch or for many at once."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-4


def aligned(baseline: DataFrame, incoming: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Baseline (label, mass) and incoming (by..., label, mass) joined on label, each normalised to 1; what one side lacks is 0.

    Gives by..., label, expected, actual, observed (incoming mass as given). Negative masses count as 0. The baseline and
    the groups' labels are a row per label.
    """
    by = list(by)
    positive = F.greatest(F.col("mass").cast("double"), F.lit(0.0))
    base = baseline.groupBy("label").agg(F.sum(positive).alias("base"))
    came = incoming.groupBy(*by, "label").agg(F.sum(positive).alias("observed"))
    if by:
        labels = base.select("label").union(came.select("label")).distinct()
        frame = came.select(*by).distinct().crossJoin(F.broadcast(labels))
        joined = frame.join(came, [*by, "label"], "left").join(base, "label", "left")
    else:
        joined = base.join(came, "label", "full_outer")
    filled = joined.select(*by, "label", F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("observed", F.lit(0.0)).alias("observed"))
    totals = filled.groupBy(*by).agg(F.sum("base").alias("all_base"), F.sum("observed").alias("all_observed"))
    both = filled.join(totals, by) if by else filled.crossJoin(F.broadcast(totals))
    return both.select(*by, "label", F.try_divide("base", "all_base").alias("expected"), F.try_divide("observed", "all_observed").alias("actual"), "observed")


def chi_square_sf(x: float, df: int) -> float:
    """P(X > x) of the chi-square distribution, by the series or the continued fraction of the incomplete gamma function."""
    if df <= 0 or x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def drift_scores(baseline: DataFrame, incoming: DataFrame, by: Sequence[str] = (), epsilon: float = EPSILON) -> DataFrame:
    """by..., n, psi, chi2, df. Shares under epsilon are raised to it after normalising; expected counts are scaled to the batch's sum."""
    by = list(by)
    rows = aligned(baseline, incoming, by)
    e, a = F.greatest("expected", F.lit(epsilon)), F.greatest("actual", F.lit(epsilon))
    sums = rows.groupBy(*by).agg(
        F.sum("observed").alias("n"), F.sum((a - e) * F.ln(a / e)).alias("psi"), F.sum(e).alias("all_e"), F.sum(F.col("observed") * F.col("observed") / e).alias("squares"), (F.count("*") - 1).alias("df")
    )
    # The sum of (o - E)^2 / E with E = n e / sum(e) is sum(o^2 / e) sum(e) / n - n.
    chi2 = F.greatest(F.lit(0.0), F.col("squares") * F.col("all_e") / F.nullif("n", F.lit(0.0)) - F.col("n"))
    return sums.select(*by, "n", "psi", chi2.alias("chi2"), "df")


def with_p_value(scores: DataFrame) -> DataFrame:
    """Adds the p-value of chi2 with df degrees of freedom; a row per batch."""
    columns = scores.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["p_value"] = np.array([chi_square_sf(x, int(d)) if x == x and d == d else np.nan for x, d in zip(batch["chi2"], batch["df"])], float)
            yield batch

    return scores.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in scores.dtypes), "p_value double"])).select(*columns, "p_value")


def verdict(scores: DataFrame, psi_alert: float = 0.25, psi_warn: float = 0.10, alpha: float = 0.05) -> DataFrame:
    """Adds level (OK, WATCH, ALERT) and alert. A rejected chi-square alone gives level WATCH and alert true. PSI is rounded to 4 and chi-square to 3 places."""
    rejected = F.col("p_value") < alpha
    level = F.when(F.col("psi") >= psi_alert, "ALERT").when((F.col("psi") >= psi_warn) | rejected, "WATCH").otherwise("OK")
    alert = (F.col("psi") >= psi_alert) | rejected
    return scores.withColumns({"level": level, "alert": alert}).withColumns({"psi": F.round("psi", 4), "chi2": F.round("chi2", 3)})


def check_drift(baseline: DataFrame, incoming: DataFrame, by: Sequence[str] = (), psi_alert: float = 0.25, psi_warn: float = 0.10, alpha: float = 0.05) -> DataFrame:
    """The verdict for each batch. An empty baseline or batch is an error where there is one batch; of many, only those with rows are judged."""
    if not by:
        for name, side in (("baseline", baseline), ("incoming", incoming)):
            if not (side.agg(F.sum(F.greatest(F.col("mass").cast("double"), F.lit(0.0)))).first()[0] or 0) > 0:
                raise ValueError(f"the {name} distribution is empty")
    return verdict(with_p_value(drift_scores(baseline, incoming, by)), psi_alert, psi_warn, alpha)


def label_counts(rows: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Counts as masses, for `incoming`."""
    return rows.where(F.col(label).isNotNull()).groupBy(*by, F.col(label).alias("label")).agg(F.count("*").alias("mass"))
