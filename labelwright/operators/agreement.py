"""Agreement statistics. All come from counts of (true, predicted) or (item, label), so that data are shuffled once, as counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.functions.intervals import Z95, wilson


def confusion(pairs: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """Counts n of each (true, pred); rows with a null in either are left out."""
    return pairs.where(F.col(true).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def row_normalized(cells: DataFrame) -> DataFrame:
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true")))


def accuracy(cells: DataFrame, z: float = Z95, clamp: bool = True) -> DataFrame:
    """One row: n, n_correct, accuracy and Wilson's interval."""
    sums = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n"))), F.lit(0)).alias("n_correct"))
    ci = wilson(F.col("n_correct"), F.col("n"), z, clamp)
    return sums.select("n", "n_correct", F.try_divide(F.col("n_correct").cast("double"), F.col("n").cast("double")).alias("accuracy"), ci["lo"].alias("ci_lo"), ci["hi"].alias("ci_hi"))


def marginals(cells: DataFrame) -> DataFrame:
    """One row per label: row (as true), col (as predicted), hit (both)."""
    both = F.explode(F.array(F.struct(F.col("true").alias("label"), F.lit(1).alias("r"), F.lit(0).alias("c")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("r"), F.lit(1).alias("c"))))
    long = cells.select("true", "pred", "n", both.alias("m"))
    hit = F.when((F.col("true") == F.col("pred")) & (F.col("m.r") == 1), F.col("n")).otherwise(F.lit(0))
    return long.groupBy("m.label").agg(F.sum(F.col("n") * F.col("m.r")).alias("row"), F.sum(F.col("n") * F.col("m.c")).alias("col"), F.sum(hit).alias("hit"))


def cohen_kappa(cells: DataFrame, undefined: float = 1.0) -> DataFrame:
    """One row: n, po, pe, kappa. `undefined` is the value where chance agreement is 1: 1.0 or NaN."""
    sums = marginals(cells).agg(F.sum("row").alias("n"), F.sum("hit").alias("hits"), F.sum(F.col("row").cast("double") * F.col("col")).alias("cross"))
    po, pe = F.col("hits") / F.col("n"), F.col("cross") / (F.col("n").cast("double") * F.col("n"))
    return sums.select("n", po.alias("po"), pe.alias("pe")).withColumn("kappa", F.when(F.col("pe") == 1, F.lit(undefined)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))))


def gwet_ac1(cells: DataFrame, n_labels: int) -> DataFrame:
    """One row: n, po, pe, ac1. `n_labels` is the number of labels there may be, not of those seen."""
    m = marginals(cells)
    n = m.agg(F.sum("row").alias("n"), F.sum("hit").alias("hits"))
    shared = m.crossJoin(F.broadcast(n))  # one row on the right
    pi = (F.col("row") + F.col("col")) / (2.0 * F.col("n"))
    pe = shared.agg(F.first("n").alias("n"), (F.first("hits") / F.first("n")).alias("po"), (F.sum(pi * (1 - pi)) / max(1, n_labels - 1)).alias("pe"))
    value = (F.col("po") - F.col("pe")) / (1 - F.col("pe"))
    return pe.withColumn("ac1", F.when(F.lit(n_labels <= 1) | (F.col("pe") >= 1), F.lit(1.0)).otherwise(value))


def per_class(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where there is nothing to divide by."""
    m = marginals(cells)
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    p, r = over(F.col("hit"), F.col("col")), over(F.col("hit"), F.col("row"))
    return m.select("label", p.alias("precision"), r.alias("recall"), over(2 * p * r, p + r).alias("f1"), F.col("row").alias("support"))


def counts_of(ratings: DataFrame, item: str = "item_id", label: str = "label") -> DataFrame:
    """Counts n of each (item, label); null labels are missing ratings."""
    return ratings.where(F.col(label).isNotNull()).groupBy(F.col(item).alias("item"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def unknown_labels(ratings: DataFrame, known: list[str], label: str = "label") -> DataFrame:
    """Labels that occur and aren't among the known."""
    return ratings.where(F.col(label).isNotNull() & ~F.col(label).isin(known)).select(F.col(label).alias("label")).distinct()


def fleiss_kappa(counts: DataFrame) -> DataFrame:
    """One row: n_items, raters, p_bar, p_e, kappa. All items must have the same number of ratings, two or more; else kappa is null and `valid` false."""
    items = counts.groupBy("item").agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agreeing"), F.min("n").alias("least"))
    whole = items.agg(
        F.count("*").alias("n_items"), F.min("r").alias("raters"), F.max("r").alias("most"), F.min("least").alias("least"), F.avg(F.col("agreeing") / F.nullif(F.col("r") * (F.col("r") - 1), F.lit(0))).alias("p_bar")
    )
    labels = counts.groupBy("label").agg(F.sum("n").alias("m")).agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("squares"), F.sum("m").alias("all"))
    both = whole.crossJoin(F.broadcast(labels)).withColumn("p_e", F.col("squares") / (F.col("all").cast("double") * F.col("all")))
    valid = (F.col("n_items") > 0) & (F.col("raters") == F.col("most")) & (F.col("raters") >= 2) & (F.col("least") >= 0)
    kappa = F.when(F.col("p_e") >= 1, F.when(F.col("p_bar") >= 1, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise((F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e")))
    return both.select("n_items", "raters", "p_bar", "p_e", F.when(valid, kappa).alias("kappa"), F.coalesce(valid, F.lit(False)).alias("valid"))


def krippendorff_alpha(counts: DataFrame) -> DataFrame:
    """One row: n_units, n_values, d_o, d_e, alpha, for nominal data with missing ratings; alpha is null where no item has two ratings.

    Disagreement is summed from counts, not over pairs of ratings.
    """
    units = counts.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")).where("m >= 2")
    observed = units.agg(F.count("*").alias("n_units"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_values"), F.sum((F.col("m").cast("double") * F.col("m") - F.col("squares")) / (F.col("m") - 1)).alias("apart"))
    labels = counts.join(units.select("item"), "item", "left_semi").groupBy("label").agg(F.sum("n").alias("c")).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("same"))
    n = F.col("n_values").cast("double")
    both = observed.crossJoin(F.broadcast(labels)).select(
        "n_units", "n_values", F.try_divide(F.col("apart"), n).alias("d_o"), F.try_divide(n * n - F.col("same"), n * (n - 1)).alias("d_e")
    )
    return both.withColumn("alpha", F.when(F.col("d_e") == 0, F.lit(1.0)).otherwise(1 - F.col("d_o") / F.col("d_e")))


def per_category_agreement(counts: DataFrame, raters: int) -> DataFrame:
    """Agreement of each label: pairs of ratings that agree on it, of pairs in which it occurs; NaN where there are none."""
    n = F.col("n").cast("double")
    pairs, rest = raters * (raters - 1) / 2, (raters - n) * (raters - n - 1) / 2
    sums = counts.groupBy("label").agg(F.sum(n * (n - 1) / 2).alias("agreeing"), F.sum(pairs - rest).alias("eligible"))
    return sums.select("label", F.when(F.col("eligible") == 0, F.lit(float("nan"))).otherwise(F.col("agreeing") / F.col("eligible")).alias("agreement"))


def metric_row(df: DataFrame, name: Column, value: str, n: str, lo: str | None = None, hi: str | None = None) -> DataFrame:
    empty = F.lit(None).cast("double")
    return df.select(name.alias("metric"), F.col(value).cast("double").alias("value"), (F.col(lo) if lo else empty).alias("ci_lo"), (F.col(hi) if hi else empty).alias("ci_hi"), F.col(n).cast("bigint").alias("n"))


def agreement_bundle(pairs: DataFrame, item: str, true: str = "true", pred: str = "pred", batch_id: str = "batch") -> DataFrame:
    """Metric rows of a batch against its reference: accuracy with interval, Cohen's kappa, Krippendorff's alpha, Fleiss' kappa of the two raters, agreement by label."""
    known = pairs.where(F.col(true).isNotNull() & F.col(pred).isNotNull())
    cells = confusion(known, true, pred)
    counts = counts_of(known.select(F.col(item).alias("item_id"), F.explode(F.array(true, pred)).alias("label")))
    total = cells.agg(F.sum("n").alias("n"))
    rows = [
        metric_row(accuracy(cells), F.lit("accuracy_vs_ref"), "accuracy", "n", "ci_lo", "ci_hi"),
        metric_row(cohen_kappa(cells, float("nan")), F.lit("cohens_kappa_vs_ref"), "kappa", "n"),
        metric_row(krippendorff_alpha(counts), F.lit("krippendorff_alpha_vs_ref"), "alpha", "n_units"),
        metric_row(fleiss_kappa(counts), F.lit("fleiss_kappa_2rater"), "kappa", "n_items"),
        metric_row(per_category_agreement(counts, 2).crossJoin(F.broadcast(total)), F.concat(F.lit("per_category_agreement:"), "label"), "agreement", "n"),
    ]
    return reduce(DataFrame.unionByName, rows).select(F.lit(batch_id).alias("batch_id"), "metric", "value", "ci_lo", "ci_hi", "n")
