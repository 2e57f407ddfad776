"""The study's results as one document, and the tables that a dashboard takes from it. All that reaches the driver has a row per label, bin or quartile."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.operators import agreement, annotate, baseline, evaluate
from labelwright.plans.materialize import cut

SEED = 20261002
QUARTILES = ("Q1 (shortest)", "Q2", "Q3", "Q4 (longest)")


def scored(abstracts: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations that could be read, joined with their abstracts on pmid and topic: pmid, true, pred, confidence, correct, text, n_words and tokens. A missing prediction is wrong."""
    read = annotations.where(F.col("parsed_ok").cast("int") == 1)
    joined = abstracts.select("pmid", "topic", "text", "n_words").join(read, ["pmid", "topic"])
    right = F.coalesce(F.col("topic") == F.col("pred_label"), F.lit(False))
    return joined.select("pmid", F.col("topic").alias("true"), F.col("pred_label").alias("pred"), F.col("confidence").cast("double").alias("confidence"), right.alias("correct"), "text", "n_words", "prompt_tokens", "output_tokens")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def _paired(rows: DataFrame, seed: int) -> dict:
    """The trained baseline against the annotator on the baseline's test half."""
    guessed = baseline.predict(rows, "pmid", "text", "true", seed=seed).select(F.col("id").alias("pmid"), (F.col("label") == F.col("predicted")).alias("base_ok"))
    both = cut(guessed.join(rows.select("pmid", F.col("correct").alias("llm_ok")), "pmid"))
    shares = _rows(both.agg(F.count("*").alias("n"), F.count_if("base_ok").alias("base"), F.count_if("llm_ok").alias("llm")))[0]
    interval = _rows(evaluate.accuracy_by(both, F.lit("all"), "base_ok"))[0]
    test = _rows(evaluate.mcnemar(evaluate.discordant(both, "base_ok", "llm_ok")))[0]
    return {
        "name": "TF-IDF and logistic regression, trained on half of the labelled rows",
        "test_n": shares["n"],
        "accuracy": shares["base"] / shares["n"],
        "accuracy_ci95": [interval["ci_lo"], interval["ci_hi"]],
        "llm_accuracy_same_test": shares["llm"] / shares["n"],
        "mcnemar_b01": test["b01"],
        "mcnemar_b10": test["b10"],
        "mcnemar_odds_ratio": test["odds"],
        "mcnemar_p": test["p_value"],
    }


def results(abstracts: DataFrame, annotations: DataFrame, labels: Sequence[str] = annotate.DISEASES, model: str = "cached", seed: int = SEED, with_baseline: bool = True) -> dict:
    """The whole document. Labels outside of `labels` and an empty join are errors; McNemar's b01 counts items where the baseline alone is right."""
    rows = cut(scored(abstracts, annotations))
    cells = cut(agreement.confusion(rows))
    n = rows.count()
    if n == 0:
        raise ValueError("no annotation belongs to an abstract")
    whole = _rows(evaluate.accuracy_by(rows, F.lit("all")))[0]
    by_class = {r.pop("label"): r for r in _rows(agreement.per_class(cells))}
    interval = {s: _rows(evaluate.bootstrap_ci(cells, list(labels), s, seed=seed))[0] for s in ("kappa", "ac1")}
    bins = cut(evaluate.calibration_bins(rows))
    lengths = _rows(evaluate.accuracy_by(evaluate.with_quartile(rows, "n_words"), "quartile").orderBy("group"))
    cost = _rows(evaluate.token_cost(rows, "prompt_tokens", "output_tokens"))[0]
    return {
        "n": n,
        "n_parse_failures": annotations.where(F.col("parsed_ok").cast("int") == 0).count(),
        "seed": seed,
        "model": model,
        "accuracy": whole["accuracy"],
        "accuracy_ci95": [whole["ci_lo"], whole["ci_hi"]],
        "kappa": interval["kappa"]["estimate"],
        "kappa_ci95": [interval["kappa"]["lo"], interval["kappa"]["hi"]],
        "ac1": interval["ac1"]["estimate"],
        "ac1_ci95": [interval["ac1"]["lo"], interval["ac1"]["hi"]],
        "per_class": {x: by_class.get(x, {"precision": 0.0, "recall": 0.0, "f1": 0.0, "support": 0}) for x in labels},
        "ece": evaluate.calibration_error(bins).first()["ece"],
        "calibration_bins": _rows(bins.orderBy("bin")),
        "baseline": _paired(rows, seed) if with_baseline else None,
        "error_by_length": [{"quartile": QUARTILES[r["group"] - 1], "accuracy": r["accuracy"], "n": r["n"], "ci95": [r["ci_lo"], r["ci_hi"]]} for r in lengths if r["group"]],
        "error_by_topic": [{"topic": r["group"], "accuracy": r["accuracy"], "n": r["n"]} for r in _rows(evaluate.accuracy_by(rows, "true").orderBy("group"))],
        "cost": {
            "input_tokens_total": cost["tokens_in"],
            "output_tokens_total": cost["tokens_out"],
            "llm_cost_usd_total": cost["cost"],
            "llm_cost_per_1000_usd": cost["cost_per_1k"],
            "price_input_per_1m": evaluate.PRICE_IN,
            "price_output_per_1m": evaluate.PRICE_OUT,
            "human_cost_per_item_usd_estimate": evaluate.HUMAN_LABEL,
            "human_cost_per_1000_usd_estimate": cost["human_per_1k"],
        },
    }


def write_results(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON document, as text."""
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str) -> dict:
    """A results document, of one line or many."""
    found = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    if len([t for t in found if t.strip()]) != 1:
        raise ValueError(f"{path} holds no single results document")
    return json.loads(next(t for t in found if t.strip()))


def headline(document: dict) -> dict:
    """The headline numbers to 3 places, with the number of correct items."""
    three = lambda x: [round(v, 3) for v in x] if isinstance(x, list) else round(x, 3)
    names = {"accuracy": "accuracy", "kappa": "cohens_kappa", "ac1": "gwets_ac1"}
    out = {"n": document["n"], "n_correct": round(document["accuracy"] * document["n"]), "model": document["model"], "seed": document["seed"]}
    for name, shown in names.items():
        out |= {shown: three(document[name]), f"{shown}_ci95": three(document[f"{name}_ci95"])}
    return out | {"ece": three(document["ece"])}


def one_wrong_in(accuracy: float) -> int | None:
    """Of how many items one is wrong; None if none is."""
    return round(1 / (1 - accuracy)) if accuracy < 1 else None


def label_distribution(abstracts: DataFrame, annotations: DataFrame) -> dict:
    """Counts of true and of predicted labels of the study's items, and parse failures."""
    rows = scored(abstracts, annotations)
    count = lambda c: {r["l"]: r["n"] for r in rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").collect()}
    return {"true_topics": count("true"), "llm_predicted": count("pred"), "parse_failures": annotations.where(F.col("parsed_ok").cast("int") == 0).count()}


def rater_comparison(reference: DataFrame, raters: dict[str, DataFrame]) -> DataFrame:
    """Metric rows for several annotators of the same items: Fleiss' kappa and Krippendorff's alpha of all with the reference, agreement by label, and each annotator's accuracy with its interval.

    `reference` and each annotator are item_id, label, one row an item. Fleiss' kappa and agreement by label take the items
    that all have labelled, alpha takes all. A null label is missing.
    """
    tables = {"reference": reference, **raters}
    long = None
    for name, rows in tables.items():
        one = rows.where("label IS NOT NULL").select("item_id", F.lit(name).alias("rater"), "label")
        long = one if long is None else long.unionByName(one)
    counts = cut(agreement.counts_of(long))
    full = counts.join(counts.groupBy("item").agg(F.sum("n").alias("m")).where(F.col("m") == len(tables)).select("item"), "item", "left_semi")
    n_items = full.select("item").distinct().agg(F.count("*").alias("n"))
    out = agreement.metric_row(agreement.fleiss_kappa(full), F.lit("fleiss_kappa"), "kappa", "n_items")
    out = out.unionByName(agreement.metric_row(agreement.krippendorff_alpha(counts), F.lit("krippendorff_alpha"), "alpha", "n_units"))
    shares = agreement.per_category_agreement(full, len(tables)).crossJoin(F.broadcast(n_items))  # one row on the right
    out = out.unionByName(agreement.metric_row(shares, F.concat(F.lit("per_category_agreement:"), "label"), "agreement", "n"))
    for name, rows in raters.items():
        pairs = reference.select("item_id", F.col("label").alias("true")).join(rows.select("item_id", F.col("label").alias("pred")), "item_id")
        out = out.unionByName(agreement.metric_row(agreement.accuracy(agreement.confusion(pairs)), F.lit(f"accuracy:{name}"), "accuracy", "n", "ci_lo", "ci_hi"))
    return out
