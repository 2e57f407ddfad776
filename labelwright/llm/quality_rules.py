"""Quality rules: counts over a text, and a linear-chain conditional random field that marks its lines.

The field labels each line with a word as content or boilerplate; Viterbi decoding finds the best sequence, and the
share of words on content lines decides retention. Weights are trained here, on sequences whose labels change: a line of
a good document is content, unless it is a notice or equals an earlier line; a line of a bad document is boilerplate; and
runs of lines of one kind are put into documents of the other. The sample is at most TRAIN_PER_CLASS documents of each
label, whole, those with the smallest MD5 digests of their ids; their texts come to the driver. The likelihood's gradient
comes from a forward and backward pass in numpy.

Cases: a null text counts as empty; an empty text has no words and fails the base rules; a text whose lines hold no word
likewise; without training rows of both labels the field marks all lines as content; labels other than 0 and 1, null
labels and null ids are left out of training, and of the texts of a repeated id the smallest is trained on; rows that
repeat an id are judged each for itself; an empty table gives an empty result; texts are processed whole. `judge` returns
the key and the added columns, without one that is named like the key; `keep_good` returns the input's columns.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm.common import slices
from labelwright.session import spread, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CONTENT_SHARE = 0.5
TRAIN_PER_CLASS = 400
#: Lines at most in a run that is put into a document of the other kind.
SPLICE = 6
SPACES = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".!?:;\"')]"
_NOTICE = re.compile(r"licen[sc]ed? under|all rights reserved|copyright|©|cookie|privacy policy|terms of (?:use|service)|https?://|www\.|@", re.I)
N_FEATURES = 13
#: Places of two features.
_SEEN, _IS_NOTICE = 8, 12


def line_features(lines: list[str]) -> np.ndarray:
    """A row of features, all between 0 and 1 or so, for each line; every line has a word."""
    out = np.zeros((len(lines), N_FEATURES))
    seen: set[str] = set()
    for i, line in enumerate(lines):
        raw = line.encode()
        words = raw.split()
        size, n = len(raw), len(words)
        short = len(line)
        repeats = sum(a == b for a, b in zip(words, words[1:]))
        out[i] = (
            1.0,
            (size - len(raw.translate(None, _UPPER))) / size,
            min(1.0, (size - len(raw.translate(None, SYMBOLS))) / n),
            min(1.0, raw.count(b"|") / n),
            min(1.0, raw.count(b"!") / n),
            (size - len(raw.translate(None, _DIGITS))) / size,
            repeats / n,
            len(set(words)) / n,
            line in seen,
            raw.rstrip()[-1] in _STOPS,
            min(1.0, math.log1p(n) / 6),
            min(1.0, short / n / 15),
            bool(_NOTICE.search(line)),
        )
        seen.add(line)
    return out


@dataclass(frozen=True)
class LineField:
    """Weights of the field. Label 1 is content, 0 boilerplate: `emit` scores content over boilerplate, `move[a][b]` a then b."""

    emit: tuple[float, ...]
    move: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, features: np.ndarray) -> list[int]:
        """The best labels by Viterbi; ties go to content."""
        scores = (features @ np.array(self.emit)).tolist()
        (m00, m01), (m10, m11) = self.move
        s0, s1 = 0.0, scores[0]
        back: list[tuple[int, int]] = []
        for x in scores[1:]:
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((int(b >= a), int(d >= c)))
            s0, s1 = max(a, b), x + max(c, d)
        label = int(s1 >= s0)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


ALL_CONTENT = LineField((1.0, *[0.0] * (N_FEATURES - 1)), ((0.0, 0.0), (0.0, 0.0)))


def train_field(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, decay: float = 1e-3, longest: int = 48) -> LineField:
    """Maximum likelihood with Adam over sequences of line features and labels; long ones are cut into runs of `longest` lines."""
    runs = [(x[i : i + longest], y[i : i + longest]) for x, y in sequences for i in range(0, len(x), longest)]
    if len({int(v) for _, y in runs for v in y}) < 2:
        return ALL_CONTENT
    n, t = len(runs), max(len(x) for x, _ in runs)
    xs, mask, ys = np.zeros((n, t, N_FEATURES)), np.zeros((n, t)), np.zeros((n, t))
    for i, (x, y) in enumerate(runs):
        xs[i, : len(x)], mask[i, : len(x)], ys[i, : len(x)] = x, 1, y
    # Each run weighs as much as another, whatever its length, and both kinds of runs as much in all.
    mostly = (ys * mask).sum(axis=1) * 2 >= mask.sum(axis=1)
    share = np.where(mostly, 0.5 / max(1, mostly.sum()), 0.5 / max(1, (~mostly).sum())) / mask.sum(axis=1)
    emit, move = np.zeros(N_FEATURES), np.zeros((2, 2))
    moments = [np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)]
    onehot = np.stack([1 - ys, ys], axis=2) * mask[:, :, None]
    for r in range(1, rounds + 1):
        unary = np.stack([np.zeros((n, t)), xs @ emit], axis=2)
        ahead, behind = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        ahead[:, 0] = unary[:, 0]
        for j in range(1, t):
            step = np.logaddexp(ahead[:, j - 1, 0, None] + move[0], ahead[:, j - 1, 1, None] + move[1])
            ahead[:, j] = np.where(mask[:, j, None] > 0, step + unary[:, j], ahead[:, j - 1])
        for j in range(t - 2, -1, -1):
            after = behind[:, j + 1] + unary[:, j + 1]
            step = np.logaddexp(after[:, 0, None] + move[:, 0], after[:, 1, None] + move[:, 1])
            behind[:, j] = np.where(mask[:, j + 1, None] > 0, step, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        node = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + move + (unary + behind)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        g_emit = np.einsum("n,nt,ntf->f", share, mask * ys - node[:, :, 1], xs)
        seen = np.einsum("n,nta,ntb->ab", share, onehot[:, :-1], onehot[:, 1:])
        g_move = seen - np.einsum("n,ntab->ab", share, pair)
        grad = np.concatenate((g_emit - decay * emit, (g_move - decay * move).ravel()))
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        step = 0.15 * (moments[0] / (1 - 0.9**r)) / (np.sqrt(moments[1] / (1 - 0.999**r)) + 1e-9)
        emit, move = emit + step[:N_FEATURES], move + step[N_FEATURES:].reshape(2, 2)
    return LineField(tuple(emit.tolist()), tuple(map(tuple, move.tolist())))


def lines_with_words(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.encode().strip(SPACES)]


def training_texts(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", quality: str = "quality", per_class: int = TRAIN_PER_CLASS) -> list[tuple[str, int]]:
    """At most `per_class` texts of each label, as (text, label) in a fixed order. Only ids are sorted; a bounded list of them is broadcast."""
    chosen = labels.where(F.col(quality).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_id"), F.col(quality).cast("int").alias("_quality")).distinct()
    order = [F.md5(F.col("_id").cast("string")), F.col("_id"), F.col("_quality")]
    ids = [r for label in (0, 1) for r in chosen.where(F.col("_quality") == label).orderBy(*order).limit(per_class).collect()]
    if not ids:
        return []
    picked = docs.sparkSession.createDataFrame(ids, chosen.schema)
    texts = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(picked), texts["_key"] == picked["_id"]).groupBy("_id", "_quality").agg(F.min("_text").alias("_text")).collect()
    return [(r["_text"], r["_quality"]) for r in sorted(found, key=lambda r: (r["_id"], r["_quality"]))]


def training_sequences(texts: list[tuple[str, int]], seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the lines of each text, and of each with a run of lines of a text of the other label put in at a random place. None unless there are texts of both labels."""
    kinds: tuple[list[list[str]], list[list[str]]] = ([], [])
    for text, label in texts:
        if lines := lines_with_words(text):
            kinds[label].append(lines)
    rng = random.Random(seed)
    out = []
    if not all(kinds):
        return out
    for label, others in ((0, kinds[1]), (1, kinds[0])):
        for lines in kinds[label]:
            whole, other = [(x, label) for x in lines], rng.choice(others)
            at, first = rng.randrange(len(lines) + 1), rng.randrange(len(other))
            run = [(x, 1 - label) for x in other[first : first + rng.randint(1, SPLICE)]]
            for variant in (whole, [*whole[:at], *run, *whole[at:]]):
                x = line_features([line for line, _ in variant])
                y = np.array([kind for _, kind in variant]) * (x[:, _SEEN] == 0) * (x[:, _IS_NOTICE] == 0)
                out.append((x, y))
    return out


def trained_field(docs: DataFrame, labels: DataFrame) -> LineField:
    return train_field(training_sequences(training_texts(docs, labels)))


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines with a word that equal an earlier one, and words in three-word windows that occur twice or more."""
    raw = text.encode()
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = lines_with_words(text)
    repeated = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
        pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
        _, which, counts = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
        again = counts[which] > 1
        inside = np.zeros(len(w), bool)
        for shift in range(3):
            inside[shift : shift + len(again)] |= again
        repeated = int(inside.sum())
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated


def content_share(text: str, field: LineField) -> float:
    """Share of a text's words that stand on content lines; 0 for a text without words."""
    lines = lines_with_words(text)
    if not lines:
        return 0.0
    n = np.array([len(x.encode().split()) for x in lines])
    return float((n * np.array(field.decode(line_features(lines)))).sum() / n.sum())


ADDED = {n: pa.int64() for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": pa.bool_(), "content_share": pa.float64(), "kept": pa.bool_()}


def judge(texts: DataFrame, key: str, text: str, field: LineField) -> DataFrame:
    """Column `key` and the added columns, but one named like the key; the work of a row depends on that row alone."""
    added = {n: t for n, t in ADDED.items() if n != key}

    def one(text: str | None) -> tuple:
        text = text or ""
        counts = text_counts(text)
        failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
        share = content_share(text, field)
        return *counts, failed, share, not failed and share >= CONTENT_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = dict(zip(ADDED, list(zip(*map(one, batch.column("t").to_pylist()))) or [()] * len(ADDED)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(got[n], t) for n, t in added.items())], [key, *added])

    kinds = {pa.int64(): "bigint", pa.bool_(): "boolean", pa.float64(): "double"}
    schema = ", ".join(f"{n} {kinds[t]}" for n, t in added.items())
    return texts.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {dict(texts.dtypes)[key]}, {schema}")


def keep_good(docs: DataFrame, field: LineField, text: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with the columns of `docs`, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text)

    def good(text: str | None) -> bool:
        n, _, _, _, repeated = text_counts(text or "")
        return n >= MIN_WORDS and 100 * repeated <= MAX_REPEAT_PERCENT * n and content_share(text or "", field) >= CONTENT_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(map(good, batch.column(at).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(spread(docs.select("doc_id", "text")), "doc_id", "text", trained_field(docs, table(spark, sf_dir, "labels")))
