"""HTML extraction by a tree-structured graphical model over the DOM.

Every element that is no plain inline markup is a variable, content or not. Unary potentials come from its tag, names and
text, pairwise potentials join parent and child. A message pass upward and one downward (sum-product, exact on a tree)
gives each variable's marginal, and the text of elements with a marginal of 0.5 or more is the page's main text. All
pages of a batch are passed together as one forest, level by level. Weights are trained by maximum likelihood, with the
same passes, on labelled pages; unless others are given, on those that `labelled_pages` writes.

The text has character references decoded, white space within a block turned into one blank and trimmed, and blocks in
page order joined by one blank.

Cases: null and empty html give an empty text; text without any markup is judged as the page's root; broken markup is
read as far as it goes; rows that repeat an id are extracted each for itself; an empty table gives an empty result;
pages are processed whole.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm.html_pages import INLINE, Node, labelled_pages, parse
from labelwright.session import spread, table

TAGS = "#root html head title body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th pre blockquote figure figcaption header footer nav aside form button select option label dialog details address center menu ins script style".split()
#: Words in class, id and role that speak against main text, and for it.
AGAINST = frozenset(
    "ad ads advert adverts advertisement adsbygoogle sponsor sponsored promo promotion promoted banner nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager header masthead footer colophon contentinfo "
    "copyright legal disclaimer sidebar side rail aside complementary widget related recommended recommendations share sharing social newsletter subscribe subscription signup login tags tag cookie cookies consent gdpr notice "
    "popup modal overlay paywall alert comment comments discussion replies reply responses disqus feedback form search author bio skip bottom hidden".split()
)
FOR = frozenset("content article post entry main story body text prose articlebody hentry".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Tags that speak against main text, and for it.
AGAINST_TAGS = frozenset("nav aside footer form dialog button select".split())
FOR_TAGS = frozenset("article main".split())
N_FEATURES = len(TAGS) + 13
KEEP_AT = 0.5


def _names(node: Node) -> set[str]:
    raw = " ".join(node.attributes.get(a, "") for a in ("class", "id", "role"))
    return {x.lower() for x in _PARTS.findall(raw)} if raw.strip() else set()


@dataclass
class Forest:
    """The variables of many pages: features, parents (or -1) and the variables of each level."""

    features: np.ndarray
    parent: np.ndarray
    levels: list[np.ndarray]


def units_of(nodes: list[Node]) -> list[int]:
    """For each element the element whose variable it shares: itself, or for plain inline markup its parent's."""
    unit: list[int] = []
    for i, node in enumerate(nodes):
        unit.append(unit[node.parent] if node.parent >= 0 and node.tag in INLINE and not (_names(node) & AGAINST) else i)
    return unit


def forest_of(pages: list[list[Node]], units: list[list[int]]) -> tuple[Forest, list[dict[int, int]]]:
    """The forest, and for each page the variable of each unit."""
    rows: list[list[float]] = []
    parents: list[int] = []
    depths: list[int] = []
    where: list[dict[int, int]] = []
    spot = {t: i for i, t in enumerate(TAGS)}
    for nodes, unit in zip(pages, units):
        chars, linked, stops = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
        own = [0] * len(nodes)
        in_link = [False] * len(nodes)
        for i, node in enumerate(nodes):
            in_link[i] = node.tag == "a" or (node.parent >= 0 and in_link[node.parent])
            for _, _, text in node.pieces:
                n = len(text.strip())
                chars[i] += n
                own[unit[i]] += n
                linked[i] += n * in_link[i]
                stops[i] += text.count(".") + text.count("!") + text.count("?")
        for i in range(len(nodes) - 1, 0, -1):
            up = nodes[i].parent
            chars[up] += chars[i]
            linked[up] += linked[i]
            stops[up] += stops[i]
        total = max(1, chars[0])
        var: dict[int, int] = {}
        names_of = [_names(node) for node in nodes]
        # Whether an element is, or stands in, a part that speaks for main text, and one that speaks against. Names of
        # elements that hold most of the page's text say nothing against it.
        good_in, bad_in = [False] * len(nodes), [False] * len(nodes)
        for i, node in enumerate(nodes):
            up_good, up_bad = (good_in[node.parent], bad_in[node.parent]) if node.parent >= 0 else (False, False)
            named = bool(names_of[i] & AGAINST) and chars[i] <= 0.7 * total and node.tag not in ("html", "body")
            bad_in[i] = up_bad or named or node.tag in AGAINST_TAGS or (node.tag == "header" and not up_good)
            good_in[i] = up_good or node.tag in FOR_TAGS or (bool(names_of[i] & FOR) and not named)
        for i, node in enumerate(nodes):
            if unit[i] != i:
                continue
            var[i] = len(parents)
            up = var[unit[node.parent]] if node.parent >= 0 else -1
            parents.append(up)
            depths.append(depths[up] + 1 if up >= 0 else 0)
            names = names_of[i]
            row = [0.0] * N_FEATURES
            if node.tag in spot:
                row[spot[node.tag]] = 1.0
            against, good = bool(names & AGAINST), bool(names & FOR)
            row[len(TAGS) :] = [1.0, against, good and not against, linked[i] / max(1, chars[i]), linked[i] > 0.6 * chars[i] > 0, chars[i] == 0, min(1.0, math.log1p(chars[i]) / 8), min(1.0, 30 * stops[i] / max(10, chars[i])), chars[i] / total, own[i] / total, bad_in[i], good_in[i] and not bad_in[i], good_in[i]]
            rows.append(row)
        where.append(var)
    depth = np.array(depths, np.int64)
    order = np.argsort(depth, kind="stable")
    cuts = np.cumsum(np.bincount(depth)) if len(depth) else np.array([], np.int64)
    return Forest(np.array(rows, float).reshape(-1, N_FEATURES), np.array(parents, np.int64), np.split(order, cuts[:-1]) if len(depth) else []), where


@dataclass(frozen=True)
class Potentials:
    unary: tuple[float, ...]
    pair: tuple[tuple[float, float], tuple[float, float]]  # parent's label, child's label


def marginals(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each variable's two marginals, and each edge's four (at the child; zeros at roots), by sum-product."""
    n = len(forest.parent)
    own = np.stack([np.zeros(n), forest.features @ unary], axis=1)
    below = own.copy()  # own potential and all messages from children
    up = np.zeros((n, 2))
    for level in reversed(forest.levels[1:]):
        b = below[level]
        up[level] = np.logaddexp(b[:, 0, None] + pair[:, 0], b[:, 1, None] + pair[:, 1])
        np.add.at(below, forest.parent[level], up[level])
    belief = below.copy()
    edges = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        rest = belief[forest.parent[level]] - up[level]  # the parent's belief without this child
        joint = rest[:, :, None] + pair[None] + below[level][:, None, :]
        belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
        joint -= joint.max(axis=(1, 2), keepdims=True)
        e = np.exp(joint)
        edges[level] = e / e.sum(axis=(1, 2), keepdims=True)
    belief -= belief.max(axis=1, keepdims=True)
    p = np.exp(belief)
    return p / p.sum(axis=1, keepdims=True), edges


def train(pages: list[str], rounds: int = 160, decay: float = 2e-4) -> Potentials:
    """Maximum likelihood over labelled pages by Adam."""
    parsed = [parse(p) for p in pages]
    units = [units_of(p) for p in parsed]
    forest, where = forest_of(parsed, units)
    truth = np.zeros(len(forest.parent), np.int64)
    for nodes, var in zip(parsed, where):
        label = [0] * len(nodes)
        for i, node in enumerate(nodes):
            mark = node.attributes.get("data-main")
            label[i] = int(mark) if mark in ("0", "1") else (label[node.parent] if node.parent >= 0 else 0)
            if i in var:
                truth[var[i]] = label[i]
    child = np.nonzero(forest.parent >= 0)[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[forest.parent[child]], truth[child]), 1)
    unary, pair = np.zeros(N_FEATURES), np.zeros((2, 2))
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for r in range(1, rounds + 1):
        p, edges = marginals(forest, unary, pair)
        g = np.concatenate((forest.features.T @ (truth - p[:, 1]), (seen - edges.sum(axis=0)).ravel())) / len(truth)
        g -= decay * np.concatenate((unary, pair.ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-9)
        unary, pair = unary + step[:N_FEATURES], pair + step[N_FEATURES:].reshape(2, 2)
    return Potentials(tuple(unary.tolist()), tuple(map(tuple, pair.tolist())))


@functools.cache
def default_potentials() -> Potentials:
    return train(labelled_pages())


def extract(pages: list[str], potentials: Potentials) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p) for p in pages]
    units = [units_of(p) for p in parsed]
    forest, where = forest_of(parsed, units)
    if not len(forest.parent):
        return [""] * len(pages)
    main = marginals(forest, np.array(potentials.unary), np.array(potentials.pair))[0][:, 1] >= KEEP_AT
    out = []
    for nodes, unit, var in zip(parsed, units, where):
        kept = sorted(piece for i, node in enumerate(nodes) if main[var[unit[i]]] for piece in node.pieces)
        runs: dict[int, list[str]] = {}
        for _, run, text in kept:
            runs.setdefault(run, []).append(text)
        out.append(" ".join(x for run in sorted(runs) if (x := " ".join("".join(runs[run]).split()))))
    return out


def main_text(pages: DataFrame, html: str = "html", out: str = "text", potentials: Potentials | None = None, forest_pages: int = 64) -> DataFrame:
    """`pages` without the html and with the main text in column `out`."""
    potentials = potentials or default_potentials()
    kept = [c for c in pages.columns if c not in (html, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(len(kept)).to_pylist()
            texts = [t for i in range(0, len(raw), forest_pages) for t in extract([x or "" for x in raw[i : i + forest_pages]], potentials)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, out])

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), f"`{out}` string"])
    return pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{html}`").alias("html")).mapInArrow(run, schema)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
