"""The catalogue of queries for the engine's own operators, and their SQL.

Raters are derived from `events` by integer arithmetic, which is the same in every engine: the event's type is the true
label, `pred` differs in some rows, confidences hit bin edges. Doubles are rounded, as sums come in any order.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.functions import text as T
from labelwright.functions.intervals import wilson
from labelwright.operators import adversarial, agreement, annotate, baseline, chunk, dedup, drift, evaluate, responses, shingling, taxonomy
from labelwright.plans import contracts, study
from labelwright.plans.materialize import shared_folder
from labelwright.plans.runs import RunLog
from labelwright.session import spread, table

TYPES = ("click", "error", "purchase", "signup", "view")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r9(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _pick(n: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TYPES]), (n % 5).cast("int"))


def rated(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, user_id, ts, true, pred, confidence, parsed_ok, correct, and raters r1 to r3 with missing ratings."""
    i = F.col("event_id")
    pred = F.when(i * 7919 % 100 < 88, F.col("event_type")).otherwise(_pick(i * 31))
    rater = lambda n, m: F.when(i % 11 != n, F.when(i * m % 100 < 85, F.col("event_type")).otherwise(_pick(i * 17 + n)))
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("true"), pred.alias("pred"), ((i * 37 % 101) / 100.0).alias("confidence"), (i % 50 != 0).alias("parsed_ok"), rater(1, 7919).alias("r1"), rater(2, 104729).alias("r2"), rater(3, 1299709).alias("r3"))
    return rows.withColumn("correct", F.col("true") == F.col("pred"))


_LIST = "['click','error','purchase','signup','view']"
RATED = f"""rated AS (
  SELECT event_id, user_id, ts, event_type AS true_label, confidence, parsed_ok, r1, r2, r3, pred, event_type = pred AS correct FROM (
    SELECT *, CASE WHEN (event_id * 7919) % 100 < 88 THEN event_type ELSE {_LIST}[(event_id * 31) % 5 + 1] END AS pred,
      ((event_id * 37) % 101) / 100.0::DOUBLE AS confidence, event_id % 50 <> 0 AS parsed_ok,
      CASE WHEN event_id % 11 <> 1 THEN CASE WHEN (event_id * 7919) % 100 < 85 THEN event_type ELSE {_LIST}[(event_id * 17 + 1) % 5 + 1] END END AS r1,
      CASE WHEN event_id % 11 <> 2 THEN CASE WHEN (event_id * 104729) % 100 < 85 THEN event_type ELSE {_LIST}[(event_id * 17 + 2) % 5 + 1] END END AS r2,
      CASE WHEN event_id % 11 <> 3 THEN CASE WHEN (event_id * 1299709) % 100 < 85 THEN event_type ELSE {_LIST}[(event_id * 17 + 3) % 5 + 1] END END AS r3
    FROM events))"""
KNOWN = f"{RATED}, known AS (SELECT * FROM rated WHERE parsed_ok), cells AS (SELECT true_label AS t, pred AS p, count(*)::BIGINT AS n FROM known GROUP BY ALL)"
MARG = f"""{KNOWN}, marg AS (SELECT label, sum(r)::BIGINT AS rw, sum(c)::BIGINT AS cl, sum(h)::BIGINT AS hit FROM (
    SELECT t AS label, n AS r, 0 AS c, CASE WHEN t = p THEN n ELSE 0 END AS h FROM cells UNION ALL SELECT p, 0, n, 0 FROM cells) GROUP BY label)"""
Z = "1.959963984540054"


def _wilson_sql(k: str, n: str, clamp: bool = True) -> tuple[str, str]:
    p = f"({k}::DOUBLE / {n})"
    mid, half = f"({p} + {Z} * {Z} / (2.0 * {n}))", f"{Z} * sqrt({p} * (1 - {p}) / {n} + {Z} * {Z} / (4.0 * {n} * {n}))"
    base = f"(1 + {Z} * {Z} / {n})"
    lo, hi = f"{mid} / {base} - ({half}) / {base}", f"{mid} / {base} + ({half}) / {base}"
    return (f"round(greatest(0.0, {lo}), 9)", f"round(least(1.0, {hi}), 9)") if clamp else (f"round({lo}, 9)", f"round({hi}, 9)")


def cells_of(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.confusion(rated(spark, sf).where("parsed_ok"))


# Lexicon ----------------------------------------------------------------------------------------------------------------
# Words that occur in the invented prose; `best` is in the built-in list too.
DOC_LEXICON = {"positive": ["best", "love", "great"], "negative": ["worthless", "stupid", "trash", "clown", "idiot", "scum", "moron"]}


def _hits_sql(words: list[str]) -> str:
    """Counts of words; these are cut by Unicode classes, as `\\b` of the SQL engine knows ASCII alone."""
    listed = ", ".join(f"'{w}'" for w in words)
    return rf"len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda w: list_contains([{listed}], w)))"


LEX = f"""lex AS (SELECT doc_id, ({_hits_sql(DOC_LEXICON["positive"])})::DOUBLE AS a, ({_hits_sql(DOC_LEXICON["negative"])})::DOUBLE AS b FROM documents),
  ann AS (SELECT doc_id, CASE WHEN a + b = 0 THEN NULL WHEN a >= b THEN 'positive' ELSE 'negative' END AS label,
    CASE WHEN a + b = 0 THEN 0.0 ELSE round(1.0 / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 4) END AS confidence, a + b > 0 AS parsed_ok FROM lex)"""


def lexicon_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return annotate.annotate(docs, ["positive", "negative"], "doc_id", lexicons=DOC_LEXICON).withColumnRenamed("chunk_id", "doc_id")


@query(f"WITH {LEX} SELECT doc_id, label, confidence, parsed_ok FROM ann")
def lexicon_annotate(spark, sf):
    return lexicon_docs(spark, sf).select("doc_id", "label", "confidence", "parsed_ok")


@query(f"WITH {LEX} SELECT count(*)::BIGINT AS n_chunks, count(label)::BIGINT AS n_annotated, (count(*) - count(label))::BIGINT AS n_abstentions FROM ann")
def lexicon_abstention_stats(spark, sf):
    return annotate.batch_counters(lexicon_docs(spark, sf)).drop("mean_latency_ms")


_LO, _HI = _wilson_sql("n_correct", "n")


@query(f"""WITH {LEX}, pairs AS (SELECT CASE toxic WHEN 1 THEN 'negative' ELSE 'positive' END AS t, label AS p FROM ann JOIN labels USING (doc_id) WHERE label IS NOT NULL AND toxic IS NOT NULL),
  s AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (t = p)::BIGINT AS n_correct FROM pairs)
  SELECT n, n_correct, round(n_correct::DOUBLE / n, 9) AS accuracy, {_LO} AS ci_lo, {_HI} AS ci_hi FROM s""")
def lexicon_accuracy_wilson(spark, sf):
    """The flagship: documents joined with their labels, annotated, scored with an interval."""
    truth = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "negative").when(F.col("toxic").isNotNull(), "positive").alias("true"))
    pairs = lexicon_docs(spark, sf).join(truth, "doc_id", "left").where(F.col("parsed_ok") & F.col("true").isNotNull())
    return r9(agreement.accuracy(agreement.confusion(pairs, "true", "label")), "accuracy", "ci_lo", "ci_hi")


# Agreement --------------------------------------------------------------------------------------------------------------
@query(f"WITH {KNOWN} SELECT t AS \"true\", p AS pred, n FROM cells")
def confusion_long(spark, sf):
    return cells_of(spark, sf)


@query(f"WITH {KNOWN} SELECT t AS \"true\", p AS pred, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY t), 9) AS share FROM cells")
def confusion_row_normalized(spark, sf):
    return r9(agreement.row_normalized(cells_of(spark, sf)), "share")


@query(f"WITH {KNOWN}, s AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (t = p)::BIGINT AS n_correct FROM cells) SELECT n, n_correct, round(n_correct::DOUBLE / n, 9) AS accuracy, {_LO} AS ci_lo, {_HI} AS ci_hi FROM s")
def accuracy_wilson(spark, sf):
    return r9(agreement.accuracy(cells_of(spark, sf)), "accuracy", "ci_lo", "ci_hi")


KAPPA = f"{MARG}, k AS (SELECT sum(rw)::BIGINT AS n, sum(hit)::DOUBLE / sum(rw) AS po, sum(rw::DOUBLE * cl) / (sum(rw)::DOUBLE * sum(rw)) AS pe FROM marg)"


@query(f"WITH {KAPPA} SELECT n, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS kappa FROM k")
def cohen_kappa(spark, sf):
    return r9(agreement.cohen_kappa(cells_of(spark, sf)), "po", "pe", "kappa")


@query(f"""WITH {MARG}, s AS (SELECT sum(rw)::BIGINT AS n, sum(hit)::DOUBLE / sum(rw) AS po FROM marg),
  e AS (SELECT sum((rw + cl) / (2.0 * n) * (1 - (rw + cl) / (2.0 * n))) / 4 AS pe FROM marg, s)
  SELECT n, round(po, 9) AS po, round(pe, 9) AS pe, round((po - pe) / (1 - pe), 9) AS ac1 FROM s, e""")
def gwet_ac1(spark, sf):
    return r9(agreement.gwet_ac1(cells_of(spark, sf), 5), "po", "pe", "ac1")


@query(f"""WITH {MARG}, x AS (SELECT label, coalesce(hit::DOUBLE / nullif(cl, 0), 0.0) AS p, coalesce(hit::DOUBLE / nullif(rw, 0), 0.0) AS r, rw FROM marg)
  SELECT label, round(p, 9) AS "precision", round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 9) AS f1, rw AS support FROM x""")
def per_class_prf(spark, sf):
    return r9(agreement.per_class(cells_of(spark, sf)), "precision", "recall", "f1")


def _ratings(spark, sf, item: str = "event_id") -> DataFrame:
    return rated(spark, sf).select(F.col(item).alias("item_id"), F.explode(F.array("r1", "r2", "r3")).alias("label"))


def _rat_sql(item: str, where: str = "TRUE") -> str:
    return f"{RATED}, lng AS (" + " UNION ALL ".join(f"SELECT {item} AS item, r{i} AS label FROM rated WHERE {where}" for i in (1, 2, 3)) + "), cnt AS (SELECT item, label, count(*)::BIGINT AS n FROM lng WHERE label IS NOT NULL GROUP BY ALL)"


_FULL = "r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL"


def _complete(spark, sf) -> DataFrame:
    return agreement.counts_of(rated(spark, sf).where(_FULL).select(F.col("event_id").alias("item_id"), F.explode(F.array("r1", "r2", "r3")).alias("label")))


@query(f"""WITH {_rat_sql("event_id", _FULL)}, it AS (SELECT item, sum(n) AS r, sum(n * (n - 1)) AS agr FROM cnt GROUP BY item),
  a AS (SELECT count(*)::BIGINT AS n_items, min(r)::BIGINT AS raters, avg(agr::DOUBLE / (r * (r - 1))) AS p_bar FROM it),
  b AS (SELECT sum(m * m) / (sum(m) * sum(m)) AS p_e FROM (SELECT sum(n)::DOUBLE AS m FROM cnt GROUP BY label))
  SELECT n_items, raters, round(p_bar, 9) AS p_bar, round(p_e, 9) AS p_e, round((p_bar - p_e) / (1 - p_e), 9) AS kappa, TRUE AS valid FROM a, b""")
def fleiss_kappa(spark, sf):
    return r9(agreement.fleiss_kappa(_complete(spark, sf)), "p_bar", "p_e", "kappa")


def _alpha_sql(item: str) -> str:
    return f"""WITH {_rat_sql(item)}, u AS (SELECT item, sum(n)::DOUBLE AS m, sum(n::DOUBLE * n) AS sq FROM cnt GROUP BY item HAVING sum(n) >= 2),
  o AS (SELECT count(*)::BIGINT AS n_units, sum(m)::BIGINT AS n_values, sum((m * m - sq) / (m - 1)) / sum(m) AS d_o FROM u),
  l AS (SELECT sum(c * c) AS same FROM (SELECT sum(n)::DOUBLE AS c FROM cnt WHERE item IN (SELECT item FROM u) GROUP BY label)),
  e AS (SELECT n_units, n_values, d_o, (n_values::DOUBLE * n_values - same) / (n_values::DOUBLE * (n_values - 1)) AS d_e FROM o, l)
  SELECT n_units, n_values, round(d_o, 9) AS d_o, round(d_e, 9) AS d_e, round(1 - d_o / d_e, 9) AS alpha FROM e"""


@query(_alpha_sql("event_id"))
def krippendorff_alpha(spark, sf):
    return r9(agreement.krippendorff_alpha(agreement.counts_of(_ratings(spark, sf))), "d_o", "d_e", "alpha")


@query(_alpha_sql("user_id"))
def krippendorff_user_items(spark, sf):
    return r9(agreement.krippendorff_alpha(agreement.counts_of(_ratings(spark, sf, "user_id"))), "d_o", "d_e", "alpha")


@query(f"WITH {_rat_sql('event_id', _FULL)} SELECT label, round(sum(n * (n - 1) / 2.0) / sum(3 - (3 - n) * (2 - n) / 2.0), 9) AS agreement FROM cnt GROUP BY label")
def per_category_agreement(spark, sf):
    return r9(agreement.per_category_agreement(_complete(spark, sf), 3), "agreement")


_BUNDLE = f"""WITH {KAPPA}, lng AS (SELECT event_id AS item, true_label AS label FROM known UNION ALL SELECT event_id, pred FROM known),
  cnt AS (SELECT item, label, count(*)::BIGINT AS n FROM lng GROUP BY ALL),
  s AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (t = p)::BIGINT AS n_correct FROM cells),
  it AS (SELECT item, sum(n)::DOUBLE AS m, sum(n::DOUBLE * n) AS sq, sum(n * (n - 1)) AS agr FROM cnt GROUP BY item),
  lb AS (SELECT sum(m * m) AS same, sum(m) AS al FROM (SELECT sum(n)::DOUBLE AS m FROM cnt GROUP BY label)),
  fl AS (SELECT avg(agr / 2.0) AS pb, max(same / (al * al)) AS pf FROM it, lb),
  al AS (SELECT sum((m * m - sq) / (m - 1)) / sum(m) AS d_o, max((al * al - same) / (al * (al - 1))) AS d_e FROM it, lb)
  SELECT 'events' AS batch_id, 'accuracy_vs_ref' AS metric, round(n_correct::DOUBLE / n, 9) AS value, {_LO} AS ci_lo, {_HI} AS ci_hi, n FROM s
  UNION ALL SELECT 'events', 'cohens_kappa_vs_ref', round((po - pe) / (1 - pe), 9), NULL, NULL, n FROM k
  UNION ALL SELECT 'events', 'krippendorff_alpha_vs_ref', round(1 - d_o / d_e, 9), NULL, NULL, n FROM al, s
  UNION ALL SELECT 'events', 'fleiss_kappa_2rater', round((pb - pf) / (1 - pf), 9), NULL, NULL, n FROM fl, s
  UNION ALL SELECT 'events', 'per_category_agreement:' || label, v, NULL, NULL, s.n FROM (SELECT label, round(sum(n * (n - 1) / 2.0) / sum(1 - (2 - n) * (1 - n) / 2.0), 9) AS v FROM cnt GROUP BY label), s"""


@query(_BUNDLE)
def agreement_bundle(spark, sf):
    pairs = rated(spark, sf).where("parsed_ok").select("event_id", "true", "pred")
    return r9(agreement.agreement_bundle(pairs, "event_id", batch_id="events"), "value", "ci_lo", "ci_hi")


_RATERS = ("r1", "r2", "r3")
_COMPARED = f"""WITH {RATED}, lng AS (SELECT event_id AS item, true_label AS label FROM rated UNION ALL {" UNION ALL ".join(f"SELECT event_id, {r} FROM rated" for r in _RATERS)}),
  cnt AS (SELECT item, label, count(*)::BIGINT AS n FROM lng WHERE label IS NOT NULL GROUP BY ALL),
  it AS (SELECT item, sum(n)::DOUBLE AS m, sum(n::DOUBLE * n) AS sq, sum(n * (n - 1)) AS agr FROM cnt GROUP BY item),
  fc AS (SELECT * FROM cnt WHERE item IN (SELECT item FROM it WHERE m = 4)),
  nf AS (SELECT count(*)::BIGINT AS n, avg(agr / 12.0) AS pb FROM it WHERE m = 4),
  lf AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS pe FROM (SELECT sum(n)::DOUBLE AS c FROM fc GROUP BY label)),
  o AS (SELECT count(*)::BIGINT AS n, sum(m) AS v, sum((m * m - sq) / (m - 1)) / sum(m) AS d_o FROM it WHERE m >= 2),
  l AS (SELECT sum(c * c) AS same FROM (SELECT sum(n)::DOUBLE AS c FROM cnt WHERE item IN (SELECT item FROM it WHERE m >= 2) GROUP BY label)),
  ac AS ({" UNION ALL ".join(f"SELECT '{r}' AS r, count({r})::BIGINT AS n, count(*) FILTER ({r} = true_label)::BIGINT AS n_correct FROM rated" for r in _RATERS)})
  SELECT 'fleiss_kappa' AS metric, round((pb - pe) / (1 - pe), 9) AS value, NULL::DOUBLE AS ci_lo, NULL::DOUBLE AS ci_hi, n FROM nf, lf
  UNION ALL SELECT 'krippendorff_alpha', round(1 - d_o / ((v * v - same) / (v * (v - 1))), 9), NULL, NULL, n FROM o, l
  UNION ALL SELECT 'per_category_agreement:' || label, round(x, 9), NULL, NULL, nf.n FROM (SELECT label, sum(n * (n - 1) / 2.0) / sum(6 - (4 - n) * (3 - n) / 2.0) AS x FROM fc GROUP BY label), nf
  UNION ALL SELECT 'accuracy:' || r, round(n_correct::DOUBLE / n, 9), {_LO}, {_HI}, n FROM ac"""


@query(_COMPARED)
def rater_comparison(spark, sf):
    """Three annotators against the reference, by the operator that takes their tables."""
    rows = rated(spark, sf)
    of = lambda c: rows.select(F.col("event_id").alias("item_id"), F.col(c).alias("label"))
    return r9(study.rater_comparison(of("true"), {r: of(r) for r in _RATERS}), "value", "ci_lo", "ci_hi")


@query(f"WITH {KNOWN}, s AS (SELECT sum(n)::BIGINT AS n, sum(n) FILTER (t = p)::BIGINT AS n_correct FROM cells) SELECT 'rule' AS backend, 'events' AS batch_id, {_LIST} AS labels, n AS n_items, 'accuracy' AS metric, round(n_correct::DOUBLE / n, 9) AS value, {_LO} AS ci_lo, {_HI} AS ci_hi FROM s")
def run_log_roundtrip(spark, sf):
    """A run of the raters' accuracy, logged in a fresh log and read back with its metric."""
    got = accuracy_wilson(spark, sf).first()
    log = RunLog(spark, f"{shared_folder(spark)}/runs-{uuid4().hex}")
    log.log(backend="rule", model_id="events", prompt_version="v1", prompt_sha256="0" * 64, batch_id="events", labels=TYPES, n_items=got["n"], metrics={"accuracy": (got["accuracy"], got["ci_lo"], got["ci_hi"])})
    return log.nested().select("backend", "batch_id", "labels", "n_items", F.explode("metrics").alias("m")).select("backend", "batch_id", "labels", "n_items", "m.metric", "m.value", "m.ci_lo", "m.ci_hi")


@query()
def bootstrap_kappa_ci(spark, sf):
    return evaluate.bootstrap_ci(cells_of(spark, sf), list(TYPES), "kappa").unionByName(evaluate.bootstrap_ci(cells_of(spark, sf), list(TYPES), "ac1"))


# Calibration, pairs, slices, cost ----------------------------------------------------------------------------------------
_EDGES = "[" + ", ".join(repr(e) + "::DOUBLE" for e in evaluate.bin_edges()) + "]"
BINS = f"""{RATED}, ed AS (SELECT i - 1 AS bin, {_EDGES}[i] AS lo, {_EDGES}[i + 1] AS hi FROM range(1, 11) AS g(i)),
  bins AS (SELECT bin::INTEGER AS bin, lo, hi, count(*)::BIGINT AS n, avg(confidence) AS mc, avg(correct::INT::DOUBLE) AS ac FROM rated JOIN ed ON (confidence > lo OR (bin = 0 AND confidence = 0)) AND confidence <= hi GROUP BY ALL)"""


@query(f"WITH {BINS} SELECT bin, lo, hi, n, round(mc, 9) AS mean_confidence, round(ac, 9) AS accuracy FROM bins")
def calibration_bins(spark, sf):
    return r9(evaluate.calibration_bins(rated(spark, sf)), "mean_confidence", "accuracy")


@query(f"WITH {BINS} SELECT sum(n)::BIGINT AS n, round(sum(n * abs(ac - mc)) / sum(n), 9) AS ece FROM bins")
def ece(spark, sf):
    return r9(evaluate.calibration_error(evaluate.calibration_bins(rated(spark, sf))), "ece")


@query(f"WITH {RATED}, x AS (SELECT *, count(*) OVER () AS a FROM rated), s AS (SELECT count(*)::BIGINT AS n, count(*) FILTER (confidence <= 0.9)::BIGINT AS n_review FROM rated) SELECT n, n_review, round(n_review::DOUBLE / n, 9) AS share_review, round(n_review::DOUBLE / n * 250 + 0.2058, 9) AS cost_per_1k FROM s")
def review_triage(spark, sf):
    return r9(evaluate.review_triage(rated(spark, sf)), "share_review", "cost_per_1k")


_PAIRED = f"{RATED}, s AS (SELECT count(*) FILTER (true_label = r1 AND true_label <> r2)::BIGINT AS b01, count(*) FILTER (true_label <> r1 AND true_label = r2)::BIGINT AS b10 FROM rated WHERE r1 IS NOT NULL AND r2 IS NOT NULL)"


def _paired(spark, sf) -> DataFrame:
    """Two raters on the same items, joined by item."""
    rows = rated(spark, sf)
    one = rows.where("r1 IS NOT NULL").select("event_id", (F.col("true") == F.col("r1")).alias("first_ok"))
    two = rows.where("r2 IS NOT NULL").select("event_id", (F.col("true") == F.col("r2")).alias("second_ok"))
    return evaluate.discordant(one.join(two, "event_id"), "first_ok", "second_ok")


@query(f"WITH {_PAIRED} SELECT b01, b10 FROM s")
def mcnemar_discordant(spark, sf):
    return _paired(spark, sf)


@query(f"""WITH {_PAIRED}, p AS (SELECT b01, b10, (SELECT sum(exp(lgamma(b01 + b10 + 1) - lgamma(k + 1) - lgamma(b01 + b10 - k + 1) - (b01 + b10) * ln(2.0))) FROM (SELECT unnest(range(0, least(b01, b10) + 1)) AS k)) AS tail FROM s)
  SELECT b01, b10, round(b01::DOUBLE / b10, 9) AS odds, round(least(1.0, 2 * tail), 8) AS p_value FROM p""")
def mcnemar_exact_p(spark, sf):
    return r9(r9(evaluate.mcnemar(_paired(spark, sf)), "odds"), "p_value", places=8)


_GLO, _GHI = _wilson_sql("k", "n", False)


@query(f"WITH {KNOWN}, s AS (SELECT true_label AS grp, count(*)::BIGINT AS n, sum(correct::INT)::BIGINT AS k FROM known GROUP BY 1) SELECT grp AS \"group\", n, round(k::DOUBLE / n, 9) AS accuracy, {_GLO} AS ci_lo, {_GHI} AS ci_hi FROM s")
def accuracy_by_group(spark, sf):
    return r9(evaluate.accuracy_by(rated(spark, sf).where("parsed_ok"), "true"), "accuracy", "ci_lo", "ci_hi")


@query(f"""WITH {LEX}, x AS (SELECT n_chars, (coalesce(label, 'positive') = CASE toxic WHEN 1 THEN 'negative' ELSE 'positive' END)::INT AS ok FROM ann JOIN labels USING (doc_id) JOIN documents USING (doc_id)),
  q AS (SELECT quantile_cont(n_chars::DOUBLE, [0.25, 0.5, 0.75]) AS e FROM x),
  s AS (SELECT CASE WHEN n_chars <= e[1] THEN 1 WHEN n_chars <= e[2] THEN 2 WHEN n_chars <= e[3] THEN 3 ELSE 4 END AS grp, count(*)::BIGINT AS n, sum(ok)::BIGINT AS k FROM x, q GROUP BY 1)
  SELECT grp AS "group", n, round(k::DOUBLE / n, 9) AS accuracy, {_GLO} AS ci_lo, {_GHI} AS ci_hi FROM s""")
def accuracy_by_length_quartile(spark, sf):
    truth = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("true"))
    rows = lexicon_docs(spark, sf).join(truth, "doc_id").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    judged = rows.withColumn("correct", F.coalesce("label", F.lit("positive")) == F.col("true"))
    return r9(evaluate.accuracy_by(evaluate.with_quartile(judged, "n_chars"), "quartile"), "accuracy", "ci_lo", "ci_hi")


@query("""SELECT count(n_chars)::BIGINT AS "count", round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars)::DOUBLE AS "min", round(quantile_cont(n_chars::DOUBLE, 0.25), 6) AS p25,
  round(quantile_cont(n_chars::DOUBLE, 0.5), 6) AS p50, round(quantile_cont(n_chars::DOUBLE, 0.75), 6) AS p75, max(n_chars)::DOUBLE AS "max" FROM documents""")
def describe_lengths(spark, sf):
    return r9(evaluate.describe(table(spark, sf, "documents"), "n_chars"), "mean", "std", "p25", "p50", "p75", places=6)


@query("SELECT event_type AS label, count(*)::BIGINT AS n FROM events GROUP BY 1")
def label_value_counts(spark, sf):
    return drift.label_counts(table(spark, sf, "events"), "event_type").withColumnRenamed("mass", "n").orderBy(F.desc("n"), "label")


@query("""WITH t AS (SELECT ceil(n_chars / 4.0)::BIGINT AS i, 20 AS o FROM documents), s AS (SELECT count(*)::BIGINT AS n, sum(i)::BIGINT AS ti, sum(o)::BIGINT AS tu FROM t)
  SELECT n, ti AS tokens_in, tu AS tokens_out, round(ti / 1e6 * 0.3 + tu / 1e6 * 2.5, 9) AS cost, round((ti / 1e6 * 0.3 + tu / 1e6 * 2.5) * 1000 / n, 9) AS cost_per_1k, 250.0::DOUBLE AS human_per_1k FROM s""")
def token_cost(spark, sf):
    rows = table(spark, sf, "documents").select(F.ceil(F.col("n_chars") / 4.0).alias("i"), F.lit(20).alias("o"))
    return r9(evaluate.token_cost(rows, "i", "o"), "cost", "cost_per_1k")


# Drift ------------------------------------------------------------------------------------------------------------------
DRIFT = """base AS (SELECT event_type AS label, count(*)::DOUBLE AS b FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
  came AS (SELECT CAST(ts AS DATE)::VARCHAR AS day, event_type AS label, count(*)::DOUBLE AS o FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL),
  lab AS (SELECT label FROM base UNION SELECT label FROM came),
  al AS (SELECT day, label, coalesce(b, 0) AS b, coalesce(o, 0) AS o FROM (SELECT DISTINCT day FROM came) CROSS JOIN lab LEFT JOIN came USING (day, label) LEFT JOIN base USING (label)),
  sh AS (SELECT day, label, o, greatest(b / sum(b) OVER (PARTITION BY day), 1e-4) AS e, greatest(o / sum(o) OVER (PARTITION BY day), 1e-4) AS a FROM al),
  sc AS (SELECT day, sum(o) AS n, sum((a - e) * ln(a / e)) AS psi, sum(o * o / e) * sum(e) / sum(o) - sum(o) AS chi2, (count(*) - 1)::BIGINT AS df FROM sh GROUP BY day),
  pv AS (SELECT *, exp(-chi2 / 2) * (1 + chi2 / 2) AS p_value FROM sc)"""


def _drift(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    base = drift.label_counts(e.where("ts < TIMESTAMP '2024-01-16'"), "event_type")
    came = drift.label_counts(e.where("ts >= TIMESTAMP '2024-01-16'").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "event_type", ["day"])
    return drift.drift_scores(base, came, ["day"])


@query(f"WITH {DRIFT} SELECT day, n, round(psi, 9) AS psi FROM pv")
def psi_by_day(spark, sf):
    return r9(_drift(spark, sf).select("day", "n", "psi"), "psi")


@query(f"WITH {DRIFT} SELECT day, n, round(chi2, 6) AS chi2, df, round(p_value, 6) AS p_value FROM pv")
def chi2_by_day(spark, sf):
    return r9(drift.with_p_value(_drift(spark, sf)).select("day", "n", "chi2", "df", "p_value"), "chi2", "p_value", places=6)


@query(f"""WITH {DRIFT} SELECT day, CASE WHEN psi >= 0.25 THEN 'ALERT' WHEN psi >= 0.02 OR p_value < 0.05 THEN 'WATCH' ELSE 'OK' END AS level, psi >= 0.25 OR p_value < 0.05 AS alert FROM pv""")
def drift_verdict_by_day(spark, sf):
    return drift.verdict(drift.with_p_value(_drift(spark, sf)), psi_warn=0.02).select("day", "level", "alert")


# Text -------------------------------------------------------------------------------------------------------------------
NORM = r"norm AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)"


@query(f"WITH {NORM} SELECT doc_id, sha256(t) AS digest FROM norm")
def normalize_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.digest(F.col("text")).alias("digest"))


EXACT = f"{NORM}, ex AS (SELECT doc_id, sha256(t) AS digest, first_value(doc_id) OVER (PARTITION BY t ORDER BY doc_id) AS first_seen FROM norm)"


@query(f"WITH {EXACT} SELECT doc_id, digest, first_seen, CASE WHEN doc_id = first_seen THEN 'kept' ELSE 'exact' END AS status FROM ex")
def exact_dedup(spark, sf):
    return dedup.exact(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").drop("text")


@query(f"WITH {EXACT} SELECT count(*)::BIGINT AS n_input, count(*) FILTER (doc_id = first_seen)::BIGINT AS n_kept, count(*) FILTER (doc_id <> first_seen)::BIGINT AS n_exact FROM ex")
def exact_dedup_stats(spark, sf):
    return dedup.stats(dedup.exact(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")).select("n_input", "n_kept", "n_exact")


SENT = r"sent AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents)"


@query(f"WITH {SENT} SELECT doc_id, len(s)::INTEGER AS n_sentences FROM sent")
def sentence_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


# The windows of a document by a recursive query: the last sentence that still fits, then a step of the share that isn't overlap, rounded half to even.
CHUNK = f"""RECURSIVE {SENT}, one AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM sent),
  pre AS (SELECT doc_id, i, x, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM one),
  lim AS (SELECT doc_id, i, upto - length(x) - 1 AS before, greatest(i, (SELECT max(q.i) FROM pre AS q WHERE q.doc_id = pre.doc_id AND q.upto - (pre.upto - length(pre.x) - 1) <= 1024)) AS last FROM pre),
  win AS (SELECT doc_id, i, coalesce(last, i) AS last FROM lim),
  walk AS (SELECT doc_id, i, last FROM win WHERE i = 1
    UNION ALL SELECT w.doc_id, n.i, n.last FROM walk AS w JOIN win AS n ON n.doc_id = w.doc_id AND n.i = w.i + greatest(1, round_even((w.last - w.i + 1) * 0.85, 0)::BIGINT)),
  txt AS (SELECT w.doc_id, w.i, string_agg(o.x, ' ' ORDER BY o.i) AS text FROM walk AS w JOIN one AS o ON o.doc_id = w.doc_id AND o.i BETWEEN w.i AND w.last GROUP BY ALL),
  chunks AS (SELECT doc_id::VARCHAR AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, text FROM txt WHERE length(text) >= 40)"""


def _chunks(spark, sf) -> DataFrame:
    return chunk.chunk(spread(table(spark, sf, "documents").select("doc_id", "text")))


@query(f"WITH {CHUNK} SELECT doc_id, doc_id || '#c' || chunk_index AS chunk_id, chunk_index::BIGINT AS chunk_index, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM chunks")
def chunk_documents(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_id", "chunk_index", "n_chars", F.md5("text").alias("text_md5"))


@query(f"""WITH {CHUNK} SELECT count(*)::BIGINT AS n, count(*) FILTER (length(text) > 4000)::BIGINT AS too_long, count(*) FILTER (right(text, 1) NOT IN ('.', '!', '?', '"', '''', ')', ']'))::BIGINT AS no_terminal,
  count(*) FILTER (regexp_matches(text, '^\\p{{Ll}}'))::BIGINT AS lower_start, count(*) FILTER (length(text) <= 4000 AND right(text, 1) IN ('.', '!', '?', '"', '''', ')', ']') AND NOT regexp_matches(text, '^\\p{{Ll}}'))::BIGINT AS ok FROM chunks""")
def chunk_boundary_report(spark, sf):
    checked = chunk.with_boundaries(_chunks(spark, sf))
    has = lambda start: F.count_if(F.exists("reasons", lambda r: r.startswith(start)))
    return checked.agg(F.count("*").alias("n"), has("too long").alias("too_long"), has("no terminal").alias("no_terminal"), has("starts in").alias("lower_start"), F.count_if("boundary_ok").alias("ok"))


SHING = f"""{NORM}, w AS (SELECT doc_id, string_split(t, ' ') AS w FROM norm WHERE t <> ''),
  sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w))"""


@query(f"WITH {SHING} SELECT doc_id, count(*)::INTEGER AS n_shingles FROM sh GROUP BY doc_id")
def shingle_counts(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return shingling.counted(docs, "doc_id", "text").select(F.col("id").alias("doc_id"), "n_shingles").where("n_shingles > 0")


@query(f"""WITH {SHING}, ex AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY t ORDER BY doc_id) AS first_seen FROM norm WHERE t IS NOT NULL),
  rp AS (SELECT doc_id, s FROM sh JOIN ex USING (doc_id) WHERE doc_id = first_seen), sz AS (SELECT doc_id, count(*) AS n FROM rp GROUP BY 1),
  pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM rp AS x JOIN rp AS y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)
  SELECT 'near' AS link, a, b, round(c::DOUBLE / (p.n + q.n - c), 9) AS jaccard FROM pr JOIN sz AS p ON p.doc_id = a JOIN sz AS q ON q.doc_id = b WHERE c::DOUBLE / (p.n + q.n - c) >= 0.8
  UNION ALL SELECT 'copy', first_seen, doc_id, 1.0::DOUBLE FROM ex WHERE doc_id <> first_seen""")
def near_dup_pairs_exact(spark, sf):
    return r9(dedup.near_classes(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text"), "jaccard")


@query()
def minhash_band_candidates(spark, sf):
    docs = dedup.exact(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").where("status = 'kept'")
    return dedup.band_candidates(docs, "doc_id", "text")


@query()
def near_dedup_greedy(spark, sf):
    return dedup.deduplicate(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").drop("text")


# Responses, sets, windows -------------------------------------------------------------------------------------------------
def _answers(spark, sf) -> DataFrame:
    """JSON answers synthesised from events: some labels unknown, some confidences out of range or no number."""
    i = F.col("event_id")
    label = F.when(i % 17 == 0, "other").otherwise(F.concat(F.lit(" "), F.upper("event_type")))
    conf = F.when(i % 13 == 0, "1.5").when(i % 19 == 0, '\\"high\\"').otherwise(((i % 101) / 100.0).cast("string"))
    inner = F.concat(F.lit('{\\"label\\": \\"'), label, F.lit('\\", \\"confidence\\": '), conf, F.lit("}"))
    raw = F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":"'), inner, F.lit('"}]}}],"usageMetadata":{"promptTokenCount":'), (i % 500).cast("string"), F.lit("}}"))
    return table(spark, sf, "events").select("event_id", F.when(i % 29 == 0, F.lit("not json")).otherwise(raw).alias("raw"))


@query("""WITH x AS (SELECT event_id, event_type, event_id % 29 = 0 AS no_json, event_id % 13 = 0 AS too_large, event_id % 13 <> 0 AND event_id % 19 = 0 AS no_number, event_id % 17 = 0 AS unknown FROM events),
  y AS (SELECT event_id, CASE WHEN no_json OR no_number OR unknown THEN NULL ELSE event_type END AS label, CASE WHEN no_json OR no_number OR too_large THEN NULL ELSE round((event_id % 101) / 100.0::DOUBLE, 9) END AS confidence, no_json FROM x)
  SELECT event_id, label, confidence, label IS NOT NULL AND confidence IS NOT NULL AS parsed_ok, CASE WHEN no_json THEN 0 ELSE event_id % 500 END::BIGINT AS input_tokens FROM y""")
def response_parse(spark, sf):
    p = responses.parsed(F.col("raw"), TYPES)
    return r9(_answers(spark, sf).withColumn("p", p).select("event_id", "p.label", "p.confidence", F.coalesce("p.parsed_ok", F.lit(False)).alias("parsed_ok"), F.coalesce("p.input_tokens", F.lit(0)).alias("input_tokens")), "confidence")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_antijoin(spark, sf):
    done = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("parsed_ok"))
    return responses.unfinished(table(spark, sf, "documents").select("doc_id", "source"), done, "doc_id")


@query(f"WITH {RATED} SELECT event_id, true_label, r1 AS pred_label FROM rated WHERE r1 IS NULL OR r1 <> true_label")
def disagreements(spark, sf):
    return taxonomy.disagreements(rated(spark, sf).select("event_id", F.col("true").alias("true_label"), F.col("r1").alias("pred_label")))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 10")
def stratified_head(spark, sf):
    return baseline.stratified_head(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 10)


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.5) AS is_test FROM documents")
def stratified_split(spark, sf):
    return baseline.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang")
def first_per_language(spark, sf):
    return dedup.first_per_key(table(spark, sf, "documents").select("lang", "doc_id"), "lang", ["doc_id"])


@query("SELECT doc_id, source, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def union_by_name(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.unionByName(table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url"), allowMissingColumns=True).select("doc_id", "source", "url")


_GRAMS = r"regexp_extract_all(lower(text), '[a-zà-öø-ÿœß0-9_]{2,}')"


@query("""WITH m AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 2) AS w FROM documents),
  tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM m) GROUP BY ALL),
  fr AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  raw AS (SELECT doc_id, lang, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN fr USING (term)),
  nm AS (SELECT doc_id, lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw),
  ag AS (SELECT lang, term, sum(w) / any_value(c) AS weight FROM nm JOIN (SELECT lang, count(*) AS c FROM documents GROUP BY lang) USING (lang) GROUP BY lang, term),
  rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS rank FROM ag)
  SELECT lang AS "group", rank::INTEGER AS rank, term, round(weight, 6) AS weight FROM rk WHERE rank <= 8""")
def tfidf_top_terms(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return r9(taxonomy.top_terms_of(docs, "doc_id", "text", "lang"), "weight", places=6)


def _violations_sql() -> str:
    return """SELECT count(*) FILTER (doc_id IS NULL)::BIGINT AS "null doc_id", count(*) FILTER (text IS NULL)::BIGINT AS "null text", count(*) FILTER (n_chars IS NULL)::BIGINT AS "null n_chars",
  (count(doc_id) - count(DISTINCT doc_id))::BIGINT AS "repeated doc_id", count(*) FILTER (NOT n_chars <= 2000)::BIGINT AS "not n_chars <= 2000", count(*) FILTER (NOT lang IN ('en', 'fr'))::BIGINT AS "not lang in (en, fr)" FROM documents"""


@query(_violations_sql())
def contract_violations(spark, sf):
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
    rules = (("n_chars <= 2000", "n_chars <= 2000"), ("lang in (en, fr)", "lang IN ('en', 'fr')"))
    return contracts.violations(table(spark, sf, "documents"), contracts.Contract("Documents", kinds, frozenset({"lang", "source"}), frozenset({"doc_id"}), rules))


# Adversarial cases, taxonomy, baseline -------------------------------------------------------------------------------------
@query()
def adversarial_by_trap(spark, sf):
    traps = adversarial.by_trap(adversarial.annotated(adversarial.cases(spark)))
    return traps.select("trap_type", "n", "correct", "accuracy", "held", F.transform("misses", lambda m: m["case_id"]).alias("missed"))


@query()
def adversarial_overall(spark, sf):
    return adversarial.overall(adversarial.by_trap(adversarial.annotated(adversarial.cases(spark))))


_THEME_WORDS = {"T1": ["best", "love"], "T2": ["stupid", "idiot", "best"], "T3": ["ation", "worthless"]}


@query("""WITH s AS (SELECT doc_id, (contains(lower(text), 'best')::INT + contains(lower(text), 'love')::INT) AS a, (contains(lower(text), 'stupid')::INT + contains(lower(text), 'idiot')::INT + contains(lower(text), 'best')::INT) AS b,
  (contains(lower(text), 'ation')::INT + contains(lower(text), 'worthless')::INT) AS c FROM documents)
  SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'T0_unassigned' WHEN a = greatest(a, b, c) THEN 'T1' WHEN b = greatest(a, b, c) THEN 'T2' ELSE 'T3' END AS theme FROM s""")
def theme_assignment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", taxonomy.theme(F.col("text"), _THEME_WORDS).alias("theme"))


def _buckets(spark, sf) -> DataFrame:
    """Embeddings in buckets by the signs of three components; bucket 7 stands for noise."""
    sign = lambda n, w: F.when(F.get("embedding", F.lit(n)) > 0, F.lit(w)).otherwise(F.lit(0))
    bucket = sign(0, 1) + sign(1, 2) + sign(2, 4)
    return table(spark, sf, "embeddings").select("label", F.when(bucket == 7, F.lit(-1)).otherwise(bucket).alias("cluster"))


BUCKETS = "bk AS (SELECT label, CASE WHEN b = 7 THEN -1 ELSE b END AS c FROM (SELECT label, (embedding[1] > 0)::INT + 2 * (embedding[2] > 0)::INT + 4 * (embedding[3] > 0)::INT AS b FROM embeddings)), cl AS (SELECT c, label, count(*)::DOUBLE AS n FROM bk GROUP BY ALL)"


@query(f"""WITH {BUCKETS}, a AS (SELECT sum(m * (m - 1) / 2) AS x FROM (SELECT sum(n) AS m FROM cl GROUP BY c)), b AS (SELECT sum(m * (m - 1) / 2) AS y FROM (SELECT sum(n) AS m FROM cl GROUP BY label)),
  t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS z FROM cl)
  SELECT n::BIGINT AS n, round((z - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 3) AS ari FROM a, b, t""")
def adjusted_rand_index(spark, sf):
    return taxonomy.adjusted_rand(_buckets(spark, sf), "label", "cluster")


@query(f"""WITH {BUCKETS}, e AS (SELECT c, max(n) AS m, sum(n) AS s FROM cl GROUP BY c)
  SELECT count(*) FILTER (c <> -1)::BIGINT AS n_clusters, coalesce(sum(s) FILTER (c = -1), 0)::BIGINT AS n_noise, round(avg(m / s) FILTER (c <> -1), 3) AS mean_purity FROM e""")
def cluster_purity(spark, sf):
    return taxonomy.purity(_buckets(spark, sf), "cluster", "label")


@query()
def synthetic_taxonomy(spark, sf):
    """Clusters of the synthetic disagreements with their themes: names, sizes, terms."""
    rows = taxonomy.synthetic_disagreements(spark)
    return taxonomy.describe_clusters(rows, taxonomy.cluster(rows))


@query()
def tfidf_hdbscan(spark, sf):
    """The clusters of the synthetic disagreements, a row each: the largest input that clustering is meant for is a study's disagreements."""
    rows = taxonomy.synthetic_disagreements(spark)
    return taxonomy.cluster(rows).join(rows.select(F.col("row_id").alias("id"), "human_theme"), "id")


@query()
def baseline_lr_accuracy(spark, sf):
    """The trained baseline on the held-out half of the labelled documents."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", "quality")
    got = baseline.predict(rows, "doc_id", "text", "quality")
    return agreement.accuracy(agreement.confusion(got, "label", "predicted"))


@query("SELECT event_type AS label, count(*)::BIGINT AS n FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) GROUP BY 1")
def latest_batch_label_counts(spark, sf):
    """Each day is a batch; the newest is found by its own small aggregation and joined."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    newest = e.agg(F.max("day").alias("day"))
    return drift.label_counts(e.join(F.broadcast(newest), "day"), "event_type").withColumnRenamed("mass", "n")


@query("SELECT event_type AS label FROM events UNION SELECT lang FROM documents")
def label_union(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("label")).union(table(spark, sf, "documents").select("lang")).distinct().orderBy("label")


_OUT = [(3, 10), (0, 10), (10, 10), (238, 248), (11, 10)]


@query("WITH x AS (SELECT unnest([3, 0, 10, 238]) AS k, unnest([10, 10, 10, 248]) AS n) SELECT k::BIGINT AS k, n::BIGINT AS n, " + ", ".join(f"{s} AS {c}" for s, c in zip(_wilson_sql("k", "n"), ("lo", "hi"))) + " FROM x UNION ALL SELECT 11, 10, NULL, NULL")
def wilson_table(spark, sf):
    rows = spark.createDataFrame(_OUT, "k bigint, n bigint")
    ci = wilson(F.col("k"), F.col("n"))
    return rows.select("k", "n", F.round(ci["lo"], 9).alias("lo"), F.round(ci["hi"], 9).alias("hi"))
