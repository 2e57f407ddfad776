"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Small decision trees over statistics of a text are grown on bootstrap samples; every path from a root to a node is a
conjunctive rule. A lasso logistic regression over the rules keeps few of them, and these become one column expression:
the score is 1 / (1 + exp(-(bias + sum of the weights of the rules that hold))). Statistics are column expressions too,
so that scoring is one narrow pass over whole texts without Python.

The model is fitted on at most TRAIN_ROWS labelled rows, those with the smallest MD5 digests of their ids; only the
statistics of these rows, TRAIN_ROWS times 16 numbers, come to the driver. In the query, rows whose crc32(doc_id) mod 5
is 0 are held out of training. Labels, language, source and id are no inputs of a score.

Cases: a null text counts as empty and all its statistics are 0, but for its one empty line; texts of any length are read
whole; labels other than 0 and 1, null labels and null ids are left out of training; a row labelled more than once counts
as often, and of the texts of a repeated id the smallest is trained on; with labels of one kind only, or with none, the
score is the smoothed share of label 1, the same for all; rows that repeat an id are scored each for itself, and so are
rows with a null id; an empty table gives an empty result. `scored` keeps the input's columns, whatever their names, but
for `score`, which is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm.common import words_of
from labelwright.session import spread, table

TRAIN_ROWS = 6000
PREDICT_AT = 0.3
FOLDS = 5
TREES = 40
DEPTH = 3
MIN_LEAF = 20
#: Code points of texts whose matches are held as an array.
SHORT = 100_000


def _count(text: Column, pattern: str) -> Column:
    """Matches of a pattern over words, which are no more than the words; they are held as an array."""
    return F.regexp_count(text, F.lit(pattern))


def _count_chars(text: Column, chars: str) -> Column:
    """Characters of a class. In a text of over SHORT each is written with one more, as an array of all of them may be many times the text."""
    whole = F.make_valid_utf8(text)
    added = F.length(F.regexp_replace(whole, F.lit(chars), F.lit("$0."))) - F.length(whole)
    return F.when(F.length(text) <= SHORT, F.regexp_count(text, F.lit(chars))).otherwise(added)


def statistics(text: Column) -> dict[str, Column]:
    """Raw counts of a text, computed once a row; `derived` makes ratios of them. Null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return {
        "_c_chars": F.length(t),
        "_c_words": F.size(words_of(t)),
        "_c_distinct": F.size(F.array_distinct(words_of(t))),
        "_c_upper": _count_chars(t, "[A-Z]"),
        "_c_symbols": _count_chars(t, r"[#*$%&|<>]"),
        "_c_pipes": F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))),
        "_c_bangs": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
        "_c_digits": _count_chars(t, "[0-9]"),
        "_c_ends": _count_chars(t, "[.?:;]"),
        "_c_commas": F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))),
        "_c_marks": _count_chars(t, r"[@/_=+{}\[\]()\\~^]"),
        "_c_lines": F.size(F.split(t, "\n")),
        "_c_distinct_lines": F.size(F.array_distinct(F.split(t, "\n"))),
        "_c_twice": _count(t, r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D])"),
        "_c_short": _count(t, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,3}(?![^\x20\x09-\x0D])"),
    }


def derived() -> dict[str, Column]:
    """The model's inputs, from the counts; a ratio over nothing is 0."""
    c = lambda name: F.col(f"_c_{name}").cast("double")
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return {
        "n_chars": c("chars"),
        "n_words": c("words"),
        "word_length": per(c("chars"), c("words")),
        "distinct_words": per(c("distinct"), c("words")),
        "upper": per(c("upper"), c("chars")),
        "symbols": per(c("symbols"), c("words")),
        "pipes": per(c("pipes"), c("words")),
        "bangs": per(c("bangs"), c("words")),
        "digits": per(c("digits"), c("chars")),
        "ends": per(c("ends"), c("words")),
        "commas": per(c("commas"), c("words")),
        "marks": per(c("marks"), c("chars")),
        "line_words": per(c("words"), c("lines")),
        "distinct_lines": per(c("distinct_lines"), c("lines")),
        "twice": per(c("twice"), c("words")),
        "short": per(c("short"), c("words")),
    }


#: A condition: input number, True for `at most`, threshold. A rule: conditions that all hold.
Rule = tuple[tuple[int, bool, float], ...]


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, inputs: list[Column]) -> Column:
        """The compiled model."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for at, below, threshold in rule:
                holds = holds & ((inputs[at] <= threshold) if below else (inputs[at] > threshold))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, prefix: Rule = ()) -> list[Rule]:
    """Rules of one tree: at each node the best of some random inputs' quantile thresholds by Gini impurity."""
    if depth == 0 or len(y) < 2 * MIN_LEAF or y.min() == y.max():
        return []
    best = (1e-9, None)
    whole = y.mean() * (1 - y.mean()) * len(y)
    for at in rng.choice(x.shape[1], max(3, x.shape[1] // 2), replace=False):
        column = x[:, at]
        for threshold in np.unique(np.quantile(column, np.linspace(0.03, 0.97, 24), method="nearest")):
            left = column <= threshold
            n = int(left.sum())
            if min(n, len(y) - n) < MIN_LEAF:
                continue
            p, q = y[left].mean(), y[~left].mean()
            gain = whole - p * (1 - p) * n - q * (1 - q) * (len(y) - n)
            if gain > best[0]:
                best = (gain, (int(at), float(threshold), left))
    if best[1] is None:
        return []
    at, threshold, left = best[1]
    below, above = (*prefix, (at, True, threshold)), (*prefix, (at, False, threshold))
    return [below, above, *_paths(x[left], y[left], rng, depth - 1, below), *_paths(x[~left], y[~left], rng, depth - 1, above)]


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for at, below, threshold in rule:
        out &= (x[:, at] <= threshold) if below else (x[:, at] > threshold)
    return out


def _lasso(z: np.ndarray, y: np.ndarray, strength: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute-value penalty, by accelerated proximal steps; the bias is not penalised."""
    a = np.hstack((np.ones((len(z), 1)), z))
    step = 4 * len(y) / max(1e-9, np.linalg.norm(a, 2) ** 2)
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -40, 40)))
        u = v - step * (a.T @ (p - y)) / len(y)
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * strength, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / t2 * (u - w), u, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5, strength: float = 5e-4) -> RuleModel:
    """The rule ensemble for inputs x and labels y."""
    if len(y) == 0 or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    rules: dict[bytes, Rule] = {}
    for _ in range(TREES):
        pick = rng.integers(0, len(y), min(len(y), 2000))
        for rule in _paths(x[pick], y[pick], rng, DEPTH):
            held = _holds(rule, x)
            if MIN_LEAF <= held.sum() <= len(y) - MIN_LEAF:
                rules.setdefault(held.tobytes(), rule)  # of rules that hold on the same rows the first is kept
    every = list(rules.values())
    if not every:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    z = np.stack([_holds(r, x) for r in every], axis=1).astype(float)
    bias, weights = _lasso(z, y.astype(float), strength)
    return RuleModel(bias, tuple((r, float(w)) for r, w in zip(every, weights) if abs(w) > 1e-3))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", rows: int = TRAIN_ROWS) -> RuleModel:
    """Fits on at most `rows` labelled rows of `labels` whose document is in `docs`. Only ids are sorted; a bounded list of them is broadcast."""
    known = labels.where(F.col(quality).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(quality).cast("int").alias("_quality"))
    ids = known.orderBy(F.md5(F.col("_id").cast("string")), "_id", "_quality").limit(rows).collect()
    if not ids:
        return fit(np.empty((0, 0)), np.empty(0))
    picked = docs.sparkSession.createDataFrame(ids, known.schema).groupBy("_id", "_quality").agg(F.count("*").alias("_times"))
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    one = texts.join(F.broadcast(picked), texts["_key"] == picked["_id"]).groupBy("_id", "_quality", "_times").agg(F.min("_text").alias("_text"))
    found = one.withColumns(statistics(F.col("_text"))).select("_id", "_quality", "_times", *[e.alias(f"_s_{n}") for n, e in derived().items()]).collect()
    got = [r for r in sorted(found) for _ in range(r["_times"])]
    if not got:
        return fit(np.empty((0, 0)), np.empty(0))
    return fit(np.array([r[3:] for r in got], float), np.array([r[1] for r in got], int))


def scored(docs: DataFrame, model: RuleModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score in column `out`; a column of that name is replaced, all others are kept, whatever their names.

    The statistics of a row are fields of one struct, and the score comes out of a generator of one element: a filter on
    the score is not pushed below a generator, where it would compute the statistics again for every rule.
    """
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != out]
    counted = docs.select(F.struct("*").alias("_row"), *[e.alias(n) for n, e in statistics(F.col(f"`{text}`")).items()])
    inputs = counted.select("_row", *[e.alias(f"_s_{n}") for n, e in derived().items()])
    score = model.score([F.col(f"_s_{n}") for n in derived()])
    return inputs.select("_row", F.explode(F.array(score)).alias("_score")).select(*kept, F.col("_score").alias(out))


def keep_good(docs: DataFrame, model: RuleModel, text: str = "text", at: float = PREDICT_AT) -> DataFrame:
    """The rows of `docs` whose score is `at` or more, with the columns of `docs`, one that is called `score` too."""
    out = "score"
    while out in docs.columns:
        out += "_"
    return scored(docs, model, text, out).where(F.col(out) >= at).drop(out)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def op8_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    result = scored(spread(docs), train(docs, labels))
    return result.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
