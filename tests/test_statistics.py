"""Hand-computed values of the statistics, and properties that hold for any input."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelwright import queries
from labelwright.functions.intervals import binomial_p, binomial_two_sided, wilson
from labelwright.operators import agreement as A
from labelwright.operators import drift as D
from labelwright.operators import evaluate as E

GOLDEN = [("asthma", "asthma", 62), ("diabetes", "diabetes", 61), ("diabetes", "hypertension", 1), ("hypertension", "diabetes", 9), ("hypertension", "hypertension", 53), ("migraine", "migraine", 62)]
CONFIDENCES = {0.40: 7, 0.45: 3, 0.50: 4, 0.55: 2, 0.60: 1, 0.65: 1, 0.85: 6, 0.95: 20, 0.98: 7, 0.99: 60, 1.0: 137}


def cells(spark, rows):
    return spark.createDataFrame(rows, "true string, pred string, n bigint")


def counts(spark, matrix):
    rows = [(i, f"c{j}", n) for i, row in enumerate(matrix) for j, n in enumerate(row) if n]
    return spark.createDataFrame(rows, "item bigint, label string, n bigint")


def ratings(spark, units):
    return A.counts_of(spark.createDataFrame([(i, x) for i, u in enumerate(units) for x in u], "item_id bigint, label string"))


def test_golden_confusion(spark):
    c = cells(spark, GOLDEN)
    row = A.accuracy(c, clamp=False).first()
    assert (row["n"], row["n_correct"]) == (248, 238)
    assert row["accuracy"] == pytest.approx(0.9596774193548387, abs=1e-12)
    assert (row["ci_lo"], row["ci_hi"]) == pytest.approx((0.9273789323964281, 0.9779525450642839), abs=1e-12)
    assert A.cohen_kappa(c).first()["kappa"] == pytest.approx(0.946236559139785, abs=1e-12)
    assert A.gwet_ac1(c, 4).first()["ac1"] == pytest.approx(0.9462489885562363, abs=1e-12)
    by = {r["label"]: r for r in A.per_class(c).collect()}
    assert [round(by["diabetes"][k], 4) for k in ("precision", "recall", "f1")] == [0.8714, 0.9839, 0.9242]
    assert [round(by["hypertension"][k], 4) for k in ("precision", "recall", "f1")] == [0.9815, 0.8548, 0.9138]
    assert all(r["support"] == 62 for r in by.values())


def test_bootstrap_holds_the_estimate(spark):
    row = E.bootstrap_ci(cells(spark, GOLDEN), ["asthma", "diabetes", "hypertension", "migraine"]).first()
    assert row["estimate"] == pytest.approx(0.946236559139785, abs=1e-12)
    assert row["lo"] == pytest.approx(0.9086, abs=0.01) and row["hi"] == pytest.approx(0.9784, abs=0.01)


def test_kappa_where_chance_agreement_is_one(spark):
    c = cells(spark, [("a", "a", 5)])
    assert A.cohen_kappa(c).first()["kappa"] == 1.0
    assert math.isnan(A.cohen_kappa(c, float("nan")).first()["kappa"])
    assert A.gwet_ac1(c, 1).first()["ac1"] == 1.0


@pytest.mark.parametrize("matrix, kappa", [([[3, 0], [2, 1], [1, 2], [0, 3]], 1 / 3), ([[3, 0], [3, 0], [0, 3]], 1.0)])
def test_fleiss(spark, matrix, kappa):
    assert A.fleiss_kappa(counts(spark, matrix)).first()["kappa"] == pytest.approx(kappa, abs=1e-12)


@pytest.mark.parametrize("matrix", [[[3, 0], [2, 2]], [[1, 0], [0, 1]]])
def test_fleiss_needs_equal_numbers_of_raters_and_two(spark, matrix):
    row = A.fleiss_kappa(counts(spark, matrix)).first()
    assert row["kappa"] is None and row["valid"] is False


@pytest.mark.parametrize("units, alpha", [(["AA", "AB", "BB"], 4 / 9), (["aa", "bbb"], 1.0), ([["a", "a", None], ["b", None, "b"]], 1.0), (["aa", "ab", "bb", "ab", "ba"], -0.08)])
def test_krippendorff(spark, units, alpha):
    assert A.krippendorff_alpha(ratings(spark, units)).first()["alpha"] == pytest.approx(alpha, abs=1e-12)


def test_krippendorff_without_pairs(spark):
    assert A.krippendorff_alpha(ratings(spark, [["a"], ["b"], [None, None]])).first()["alpha"] is None


def test_fleiss_and_alpha_of_disagreeing_raters(spark):
    assert A.fleiss_kappa(ratings(spark, ["aa", "ab", "bb", "ab", "ba"])).first()["kappa"] == pytest.approx(-0.2, abs=1e-12)


def test_per_category(spark):
    got = {r["label"]: r["agreement"] for r in A.per_category_agreement(counts(spark, [[3, 0], [2, 1], [1, 2], [0, 3]]), 3).collect()}
    assert got == {"c0": 0.5, "c1": 0.5}
    got = {r["label"]: r["agreement"] for r in A.per_category_agreement(counts(spark, [[2, 0], [2, 0], [1, 1], [1, 1]]), 2).collect()}
    assert got == {"c0": 0.5, "c1": 0.0}


def test_unknown_labels(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "x"), (2, None)], "item bigint, label string")
    assert [r[0] for r in A.unknown_labels(rows, ["a", "b"]).collect()] == ["x"]


def test_wilson_limits(spark):
    rows = spark.createDataFrame([(0, 10), (10, 10), (11, 10), (0, 0)], "k bigint, n bigint").select("k", "n", wilson(F.col("k"), F.col("n")).alias("ci")).collect()
    got = {(r["k"], r["n"]): r["ci"] for r in rows}
    assert got[0, 10]["lo"] == 0.0 and got[10, 10]["hi"] == pytest.approx(1.0)
    assert got[11, 10] is None and got[0, 0] is None


def test_binomial(spark):
    rows = [(3, 6), (0, 0), (6, 3), (5, 5), (0, 8), (1000, 900)]
    got = [r[0] for r in spark.createDataFrame(rows, "a bigint, b bigint").select(binomial_two_sided(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(0.5078125, abs=1e-12) and got[2] == got[0]
    for p, (a, b) in zip(got, rows):
        n = a + b
        assert p == pytest.approx(min(1.0, 2 * sum(math.comb(n, k) for k in range(min(a, b) + 1)) / 2**n) if n else 1.0, rel=1e-9)


def test_binomial_of_large_counts(spark):
    for a, b in [(1, 1), (1, 2), (0, 5), (3, 1071), (40, 61), (950, 1050), (1200, 3100)]:
        n = a + b
        want = min(1.0, 2 * sum(math.comb(n, k) for k in range(min(a, b) + 1)) / 2**n)
        assert binomial_p(a, b) == pytest.approx(want, rel=1e-11)
    # Beyond an int; there the normal distribution is near enough.
    a, b = 2 * 10**9, 2 * 10**9 + 100_000
    (got,) = spark.createDataFrame([(a, b)], "a bigint, b bigint").select(binomial_two_sided(F.col("a"), F.col("b"))).first()
    assert got == pytest.approx(math.erfc((b - a - 1) / math.sqrt(2 * (a + b))), rel=1e-6)
    assert spark.createDataFrame([(1, None)], "a bigint, b bigint").select(binomial_two_sided(F.col("a"), F.col("b"))).first()[0] is None


def test_paired_raters_use_all_events(spark, tmp_path):
    """Against a loop over the same integer arithmetic, on events whose ids pass 400."""
    at = datetime.datetime(2024, 1, 1)
    events = [(i, i % 7, at, queries.TYPES[i * i % 5]) for i in range(1500)]
    spark.createDataFrame(events, "event_id bigint, user_id bigint, ts timestamp, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    rater = lambda i, t, n, m: None if i % 11 == n else t if i * m % 100 < 85 else queries.TYPES[(i * 17 + n) % 5]
    pairs = [(t, rater(i, t, 1, 7919), rater(i, t, 2, 104729)) for i, _, _, t in events]
    b01 = sum(x == t != y for t, x, y in pairs if x and y)
    b10 = sum(y == t != x for t, x, y in pairs if x and y)
    assert queries.mcnemar_discordant(spark, str(tmp_path)).first() == (b01, b10)
    row = queries.mcnemar_exact_p(spark, str(tmp_path)).first()
    n = b01 + b10
    want = min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b01, b10) + 1)) / 2**n)
    assert (row["b01"], row["b10"], row["odds"], row["p_value"]) == (b01, b10, round(b01 / b10, 9), pytest.approx(want, abs=1e-8))


def test_calibration_bins_hold_upper_edges(spark):
    rows = [(c, True) for c, n in CONFIDENCES.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "confidence double, correct boolean")
    got = {r["bin"]: r["n"] for r in E.calibration_bins(df).collect()}
    assert got == {3: 7, 4: 7, 5: 3, 6: 1, 8: 6, 9: 224}
    zero = spark.createDataFrame([(0.0, True), (None, True), (float("nan"), True), (1.5, True)], "confidence double, correct boolean")
    assert [(r["bin"], r["n"]) for r in E.calibration_bins(zero).collect()] == [(0, 1)]


def test_triage_and_cost(spark):
    df = spark.createDataFrame([(c,) for c, n in CONFIDENCES.items() for _ in range(n)], "confidence double")
    row = E.review_triage(df).first()
    assert (row["n"], row["n_review"]) == (248, 24) and row["cost_per_1k"] == pytest.approx(24.4, abs=0.2)
    cost = E.token_cost(spark.createDataFrame([(126473, 5237)], "i bigint, o bigint"), "i", "o").first()["cost"]
    assert cost == pytest.approx(0.0510344, abs=1e-9)


def test_quartiles_hold_upper_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 2, 3, 4, 5, 6)], "v double")
    got = sorted(r["quartile"] for r in E.with_quartile(df, "v").collect())
    assert got == [1, 1, 1, 1, 3, 3, 4, 4]  # edges 2, 2.5 and 4.25: the second bin is empty


def masses(spark, d):
    return spark.createDataFrame(list(d.items()), "label string, mass double")


def test_psi(spark):
    psi = lambda a, b: D.drift_scores(masses(spark, a), masses(spark, b)).first()["psi"]
    assert psi({"a": 0.5, "b": 0.5}, {"a": 0.9, "b": 0.1}) == pytest.approx(0.8789, abs=1e-3)
    assert psi({"a": 0.5, "b": 0.5}, {"a": 50.0, "b": 50.0}) == pytest.approx(0.0, abs=1e-9)
    assert psi({"a": 1.0}, {"a": 0.9, "b": 0.1}) > 0.25


@pytest.mark.parametrize("counts, level, alert", [({"a": 52.0, "b": 48.0}, "OK", False), ({"a": 90.0, "b": 10.0}, "ALERT", True), ({"a": 590.0, "b": 410.0}, "WATCH", True)])
def test_verdicts(spark, counts, level, alert):
    row = D.check_drift(masses(spark, {"a": 0.5, "b": 0.5}), masses(spark, counts)).first()
    assert (row["level"], row["alert"]) == (level, alert)


def test_chi_square_and_empty_batches(spark):
    row = D.check_drift(masses(spark, {"a": 0.5, "b": 0.5}), masses(spark, {"a": 90.0, "b": 10.0})).first()
    assert row["chi2"] == pytest.approx(64.0) and row["p_value"] < 1e-6
    assert D.chi_square_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert D.chi_square_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    with pytest.raises(ValueError):
        D.check_drift(masses(spark, {"a": 1.0}), spark.createDataFrame([], "label string, mass double"))


def test_statistics_of_stacked_matrices():
    one = np.array([[[5.0, 0], [0, 5]]])
    assert E.kappa_of(one)[0] == 1.0 and E.ac1_of(one)[0] == 1.0
