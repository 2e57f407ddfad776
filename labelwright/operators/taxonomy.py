"""Disagreements, their themes, TF-IDF terms, clusters and how well clusters agree with themes."""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelwright.functions.text import first_best, keywords_present
from labelwright.operators.shingling import slices
from labelwright.plans.materialize import cut
from labelwright.sources.corpora import RESPONSE

# Themes in their order, which decides ties, and their keywords.
THEMES: dict[str, list[str]] = {
    "T1_boundary_diabetes_hypertension": ["diabetes", "diabetic", "hypertension", "hypertensive", "blood", "pressure", "glucose", "insulin"],
    "T2_hypertension_recall": ["hypertension", "hypertensive", "pressure", "mmhg", "systolic", "diastolic"],
    "T3_comorbidity_mention": ["comorbid", "comorbidity", "concomitant", "coexisting", "history", "background"],
    "T4_drug_name_cue": ["metformin", "insulin", "lisinopril", "statin", "medication", "prescribed", "therapy"],
}
NO_THEME = "T0_unassigned"
# The texts of synthetic disagreements, by theme.
SYNTHETIC_TEXTS: dict[str, list[str]] = {
    "T1_boundary_diabetes_hypertension": [
        "Type 2 diabetes with resistant hypertension: intensive blood pressure control reduced events; HbA1c was the primary outcome.",
        "Hypertensive diabetics were randomized to blood pressure targets; glucose medications were held constant throughout.",
        "In diabetic patients, hypertension management improved outcomes; insulin dosing followed standard glycemic protocols.",
    ],
    "T2_hypertension_recall": [
        "Ambulatory monitoring showed a non-dipping blood pressure pattern; mean 24-hour pressure 152/96 mmHg.",
        "Resistant hypertension persisted despite three antihypertensives; systolic pressure remained above 150 mmHg.",
        "New-onset hypertension in pregnancy was managed with labetalol; pressures normalized postpartum.",
    ],
    "T3_comorbidity_mention": [
        "Patients with a history of diabetes and chronic kidney disease were enrolled; the comorbidity burden was high.",
        "Concomitant diabetes was present in half the cohort with coexisting cardiovascular disease.",
        "A background of hypertension complicated the diabetes management plan for these participants.",
    ],
    "T4_drug_name_cue": [
        "Metformin was co-prescribed for metabolic syndrome; the antihypertensive regimen lowered systolic pressure by 11 mmHg.",
        "Participants received lisinopril for renal protection in this diabetes albuminuria trial.",
        "Insulin therapy was initiated; blood pressure medications were unchanged during follow-up.",
    ],
}
#: A short list of English words without content; any other list may be given.
STOP_WORDS = "a about after all also an and any are as at be because been before but by can could did do does for from had has have he her his how i if in into is it its more most my no not of on one only or other our out over she should so some such than that the their them then there these they this those to under up was we were what when where which while who will with would you your".split()
#: Rows that clustering takes; its matrix of distances grows with their square.
MAX_CLUSTER_ROWS = 5000


def theme(text: Column, themes: dict[str, list[str]] = THEMES) -> Column:
    """The theme with the most keywords in the text, the earlier one on a tie; T0_unassigned without any."""
    scores = [(name, keywords_present(text, kws)) for name, kws in themes.items()]
    return F.when(F.greatest(*[s for _, s in scores]) > 0, first_best(scores)).otherwise(F.lit(NO_THEME))


def disagreements(rows: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    """Rows whose prediction isn't the true label; a missing prediction is a disagreement, a missing true label isn't."""
    return rows.where(F.col(true).isNotNull() & (F.col(pred).isNull() | (F.col(pred) != F.col(true))))


def study_disagreements(annotations: DataFrame, abstracts: DataFrame) -> DataFrame:
    """text, true_label, pred_label, confidence, source of annotations (pmid, topic, pred_label, confidence) that aren't the topic, joined with the abstracts' texts on pmid; the annotation's topic is the true one."""
    joined = annotations.join(abstracts.select("pmid", "text"), "pmid")
    rows = joined.select("text", F.col("topic").alias("true_label"), "pred_label", F.col("confidence").try_cast("double").alias("confidence"), F.lit("study").alias("source"))
    return disagreements(rows)


def naming_prompts(described: DataFrame) -> DataFrame:
    """cluster, key, prompt: what a model is asked to name each cluster but noise, and the key of its cached answer."""
    prompt = F.concat(
        F.lit("Texts of this group were all labelled wrongly. Frequent terms: "), F.array_join("top_terms", ", "), F.lit(". Examples: "), F.array_join("exemplars", " | "),
        F.lit(". Answer with a JSON object alone: `name`, a short theme, and `description`, one sentence on how the error probably comes about."),
    )
    return described.where("cluster <> -1").select("cluster", F.concat(F.lit("taxonomy-llm:"), F.col("cluster").cast("string")).alias("key"), prompt.alias("prompt"))


def named_clusters(described: DataFrame, answers: DataFrame) -> DataFrame:
    """Clusters with llm_name and llm_description from cached answers (key_sha256, raw). Noise has fixed ones; an answer without a name leaves the cluster's own, one without a description an empty one. A cluster without a readable answer is an error."""
    asked = naming_prompts(described).select("cluster", F.sha2("key", 256).alias("key_sha256"))
    parts = F.from_json("raw", RESPONSE)["candidates"][0]["content"]["parts"]
    text = F.get(F.filter(parts, lambda p: p["text"].isNotNull()), F.lit(0))["text"]
    read = F.from_json(text, "struct<name: string, description: string, _corrupt_record: string>", {"columnNameOfCorruptRecord": "_corrupt_record"})
    found = asked.join(answers, "key_sha256", "left").select("cluster", read.alias("a"))
    bad = [r["cluster"] for r in found.where("a IS NULL OR a._corrupt_record IS NOT NULL").select("cluster").collect()]  # a row per cluster
    if bad:
        raise ValueError(f"no readable answer for clusters {sorted(bad)}")
    noise = F.col("cluster") == -1
    return described.join(found, "cluster", "left").select(
        *described.columns,
        F.when(noise, F.lit("noise/unclustered")).otherwise(F.coalesce("a.name", "name")).alias("llm_name"),
        F.when(noise, F.lit("Rows that belong to no cluster.")).otherwise(F.coalesce("a.description", F.lit(""))).alias("llm_description"),
    )


def synthetic_disagreements(spark: SparkSession, seed: int = 20261008, n: int = 40) -> DataFrame:
    """Seeded disagreements with their themes, dealt to the themes in turn."""
    rng = random.Random(seed)
    names = list(SYNTHETIC_TEXTS)
    rows = []
    for i in range(n):
        name = names[i % len(names)]
        text = rng.choice(SYNTHETIC_TEXTS[name])
        rows.append((i, text, f"theme:{name}", "theme:misclassified", round(rng.uniform(0.4, 0.95), 2), "synthetic", name))
    return spark.createDataFrame(rows, "row_id bigint, text string, true_label string, pred_label string, confidence double, source string, human_theme string")


def terms(text: Column, stop_words: list[str] | None = None, ngrams: int = 2) -> Column:
    """Lower-case words of two or more word characters that are no stop words, and their n-grams."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    if stop_words:
        stops = F.array(*[F.lit(w) for w in stop_words])
        found = F.filter(found, lambda w: ~F.array_contains(stops, w))

    def grams(w: Column) -> Column:
        parts = [w]
        for n in range(2, ngrams + 1):
            parts.append(F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.get(F.transform(F.array(found), grams), F.lit(0))


def _documents(docs: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None) -> DataFrame:
    """id, w: the words of each row; rows of one id come one after another."""
    return docs.select(F.col(id_col).alias("id"), terms(F.col(text_col), stop_words, 1).alias("w")).repartition("id").sortWithinPartitions("id")


def _term_counts(batches: Iterator[pa.RecordBatch], ngrams: int) -> Iterator[tuple[object, Counter]]:
    """The id and the counts of terms of each document; rows that repeat an id are one."""
    last, counts = None, None
    for batch in slices(batches, "w"):
        for key, w in zip(batch.column("id").to_pylist(), batch.column("w").to_pylist()):
            if counts is None or key != last:
                if counts is not None:
                    yield last, counts
                last, counts = key, Counter()
            counts.update(w)
            for n in range(2, ngrams + 1):
                counts.update(map(" ".join, zip(*(w[i:] for i in range(n)))))
    if counts is not None:
        yield last, counts


#: Different terms whose counts a task gathers before it gives them out.
GATHERED = 300_000


def vocabulary(docs: DataFrame, id_col: str, text_col: str, max_features: int, stop_words: list[str] | None = None, ngrams: int = 2) -> dict[str, float]:
    """The idf, ln((1 + n) / (1 + df)) + 1, of the `max_features` most frequent terms, by term on a tie, in order of terms.

    Tasks sum up the terms of many documents before anything is shuffled; so many terms as are asked for come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        df: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([df[t] for t in total], pa.int64())], ["term", "total", "df"])
        for _, counts in _term_counts(batches, ngrams):
            total.update(counts)
            df.update(counts.keys())
            if len(total) > GATHERED:
                yield give()
                total.clear(), df.clear()
        yield give()

    found = _documents(docs, id_col, text_col, stop_words).mapInArrow(run, "term string, total bigint, df bigint")
    frequent = found.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).orderBy(F.desc("total"), "term").limit(max_features)
    n = docs.count()
    rows = frequent.select("term", (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")).collect()
    return {r["term"]: r["idf"] for r in sorted(rows)}


def vectors(docs: DataFrame, id_col: str, text_col: str, known: dict[str, float], stop_words: list[str] | None = None, ngrams: int = 2, sublinear: bool = False) -> DataFrame:
    """id, at, weight: of each document with a term of `known` the numbers of its terms and their weights, as `tfidf` has them."""
    numbers = {t: i for i, t in enumerate(known)}
    idf = np.fromiter(known.values(), float, len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        ats: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(ats, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], ["id", "at", "weight"])
        for key, counts in _term_counts(batches, ngrams):
            got = sorted((numbers[t], c) for t, c in counts.items() if t in numbers)
            if got and key is not None:
                at, tf = np.array(got, np.int32).T
                w = (1 + np.log(tf) if sublinear else tf) * idf[at]
                ids.append(key), ats.append(at), weights.append(w / np.sqrt((w * w).sum()))
            if len(ids) >= 512:
                yield give()
                ids, ats, weights = [], [], []
        yield give()

    rows = _documents(docs, id_col, text_col, stop_words)
    kind = to_arrow_type(rows.schema["id"].dataType)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, at array<int>, weight array<double>")


def tfidf(docs: DataFrame, id_col: str, text_col: str, max_features: int | None = 2000, stop_words: list[str] | None = None, ngrams: int = 2, sublinear: bool = False, fitted_on: DataFrame | None = None) -> DataFrame:
    """Long form id, term, weight: tf (1 + ln tf if sublinear) times ln((1 + n) / (1 + df)) + 1, each document scaled to length 1. Of the terms the `max_features` most frequent are kept, by term on a tie. Terms, n and df are those of `fitted_on`, if that is given, and else of `docs`."""

    def count(of: DataFrame) -> DataFrame:
        return of.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col), stop_words, ngrams)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))

    counts, fitted = count(docs), docs if fitted_on is None else fitted_on
    frequent = count(fitted).groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    if max_features:
        frequent = frequent.orderBy(F.desc("total"), "term").limit(max_features)
    n = fitted.agg(F.count("*").alias("n"))
    idf = frequent.crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = 1 + F.ln(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = counts.join(idf, "term").select("id", "term", (tf * F.col("idf")).alias("w"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def top_terms(weights: DataFrame, groups: DataFrame, k: int = 8) -> DataFrame:
    """The k terms with the largest mean weight in each group: group, rank, term, weight. `groups` is id, group; a document without a term counts as 0; by term on a tie."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    return _ranked(weights.join(groups, "id").groupBy("group", "term").agg(F.sum("weight").alias("s")).join(sizes, "group"), k)


def _ranked(sums: DataFrame, k: int) -> DataFrame:
    """group, rank, term, weight from group, term, s, size. Weights that differ in their last digits alone tie, as sums come in any order."""
    mean = sums.select("group", "term", (F.col("s") / F.col("size")).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc(F.round("weight", 12)), "term"))
    return mean.withColumn("rank", rank).where(F.col("rank") <= k).select("group", "rank", "term", "weight")


#: Bytes of words, and documents, in a block; characters of texts for each share of the terms' hashes.
BLOCK_BYTES, BLOCK_DOCS, SHARE_CHARS = 2_000_000, 4096, 20_000_000
_BLOCK_ROW = "block bigint, part int, id {0}, group {1}, t binary"


def _by_block(batches: Iterator[pa.RecordBatch], by: str = "block") -> Iterator[tuple[int, list[dict]]]:
    """The rows with equal numbers in `by`, which come one after another."""
    last, rows = None, []
    for batch in slices(batches, "t"):
        for row in batch.to_pylist():
            if rows and row[by] != last:
                yield last, rows
                rows = []
            last = row[by]
            rows.append(row)
    if rows:
        yield last, rows


def _block_terms(rows: list[dict], ngrams: int) -> tuple[list[str], np.ndarray, list[tuple[list, np.ndarray, np.ndarray]]]:
    """The terms of a block's documents, the order of their hashes, and for each id that isn't null its groups, terms by number and their counts."""
    numbers: dict[str, int] = {}
    docs = []
    for same in [list(g) for _, g in groupby(rows, lambda r: r["id"])]:
        counts: Counter = Counter()
        for row in same:
            w = zlib.decompress(row["t"]).decode().split()
            counts.update(w)
            for n in range(2, ngrams + 1):
                counts.update(map(" ".join, zip(*(w[i:] for i in range(n)))))
        at = np.fromiter((numbers.setdefault(t, len(numbers)) for t in counts), np.int64, len(counts))
        docs.append((None if same[0]["id"] is None else [r["group"] for r in same], at, np.fromiter(counts.values(), np.int64, len(counts))))
    h = np.fromiter((xxhash.xxh64_intdigest(t) for t in numbers), np.uint64, len(numbers))
    return list(numbers), h, docs


def top_terms_of(docs: DataFrame, id_col: str, text_col: str, group_col: str, k: int = 8, stop_words: list[str] | None = None, ngrams: int = 2) -> DataFrame:
    """`top_terms` of the weights of `tfidf` over all terms, without a row for each term of each document.

    Documents are dealt in blocks. A block asks for the frequencies of its terms by their hashes (64 bits), a share of the
    hashes at a time, and gets them back in the same order. A term's weights in a group sum up to no more than its
    frequency; so once the sums of frequent terms are known, a term that is in fewer documents than the group's k-th sum so
    far can't be among its k, and only the others are summed up. One row a group comes to the driver.
    """
    n, chars = docs.agg(F.count("*"), F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()
    bits = max(0, int(chars // SHARE_CHARS).bit_length())
    rows = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), F.col(text_col).alias("t")).repartition("id").sortWithinPartitions("id")
    rows = rows.select("id", "group", F.array_join(terms(F.col("t"), stop_words, 1), " ").cast("binary").alias("t"))
    schema = _BLOCK_ROW.format(*(rows.schema[c].dataType.simpleString() for c in ("id", "group")))
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in ("id", "group")]
    batch_of = lambda got: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got) if got else [()] * 5, (pa.int64(), pa.int32(), *kinds, pa.binary()))], ["block", "part", "id", "group", "t"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, held, last = TaskContext.get().partitionId() << 32, 0, 0, None
        for batch in slices(batches, "t"):
            got = []
            for row in batch.to_pylist():
                if row["id"] != last and (size > BLOCK_BYTES or held >= BLOCK_DOCS):
                    block, size, held = block + 1, 0, 0
                size, held, last = size + len(row["t"]), held + 1, row["id"]
                got.append((block, -1, row["id"], row["group"], zlib.compress(row["t"], 1)))
            yield batch_of(got)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, found in _by_block(batches):
            _, h, counted = _block_terms(found, ngrams)
            df = np.bincount(np.concatenate([at for _, at, _ in counted]), minlength=len(h)).astype("<u4") if len(h) else np.empty(0, "<u4")
            order = np.argsort(h, kind="stable")
            h, df = h[order], df[order]
            parts = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1)).tolist() if len(h) else []
            yield batch_of([(block, int(parts[a]), None, None, h[a:b].astype("<u8").tobytes() + zlib.compress(df[a:b].tobytes(), 1) + (b - a).to_bytes(4, "little")) for a, b in zip(edges, edges[1:])])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, asked in _by_block(batches, "part"):
            sizes = [int.from_bytes(r["t"][-4:], "little") for r in asked]
            h = np.concatenate([np.frombuffer(r["t"], "<u8", m) for r, m in zip(asked, sizes)])
            df = np.concatenate([np.frombuffer(zlib.decompress(r["t"][8 * m : -4]), "<u4") for r, m in zip(asked, sizes)])
            at = np.unique(h, return_inverse=True)[1]
            whole = np.bincount(at, weights=df)[at].astype("<u4")
            for first in range(0, len(asked), 256):
                upto = np.cumsum([sum(sizes[:first]), *sizes[first : first + 256]]).tolist()
                yield batch_of([(r["block"], part, None, None, zlib.compress(whole[a:b].tobytes(), 1)) for r, a, b in zip(asked[first:], upto, upto[1:])])

    def sums(least: dict) -> DataFrame:
        """Sums of the weights of terms in at least as many documents as `least` has for the group; least[None] for others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, found in _by_block(batches):
                replies, own = [r for r in found if r["part"] >= 0], [r for r in found if r["part"] < 0]
                names, h, counted = _block_terms(own, ngrams)
                df = np.empty(len(h))
                if len(h):
                    df[np.argsort(h, kind="stable")] = np.concatenate([np.frombuffer(zlib.decompress(r["t"]), "<u4") for r in replies])
                idf = np.log((1 + n) / (1 + df)) + 1
                met: dict = {}
                for groups, at, tf in counted:
                    if groups and len(at):
                        w = tf * idf[at]
                        w /= np.sqrt((w * w).sum())
                        for g in groups:
                            if g is not None and (keep := df[at] >= least.get(g, least[None])).any():
                                met.setdefault(g, []).append((at[keep], w[keep]))
                for g, each in met.items():
                    at, where = np.unique(np.concatenate([a for a, _ in each]), return_inverse=True)
                    s = np.bincount(where, weights=np.concatenate([w for _, w in each]))
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), kinds[1]), pa.array([names[i] for i in at.tolist()], pa.string()), pa.array(s)], ["group", "term", "s"])

        dealt = packed.unionByName(replied).repartition("block").sortWithinPartitions("block", "part", "id")
        return dealt.mapInArrow(run, f"group {rows.schema['group'].dataType.simpleString()}, term string, s double").groupBy("group", "term").agg(F.sum("s").alias("s"))

    packed = cut(rows.mapInArrow(pack, schema))
    replied = cut(packed.mapInArrow(ask, schema).repartition("part").sortWithinPartitions("part").mapInArrow(answer, schema))
    by_sum = Window.partitionBy("group").orderBy(F.desc("s"))
    kth = sums({None: n / 1000}).withColumn("r", F.row_number().over(by_sum)).where(F.col("r") == k).collect()
    best = sums({None: 0} | {r["group"]: r["s"] * (1 - 1e-9) for r in kth})
    sizes = docs.groupBy(F.col(group_col).alias("group")).agg(F.count("*").alias("size"))
    return _ranked(best.join(sizes, "group"), k)


def hdbscan(x: np.ndarray, min_cluster_size: int = 3, min_samples: int = 1) -> np.ndarray:
    """Cluster numbers of the rows of x, -1 for noise: single linkage over mutual reachability, condensed, with the most stable clusters chosen."""
    n = len(x)
    if n < min_cluster_size:
        raise ValueError(f"at least {min_cluster_size} rows are needed")
    squares = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(0.0, squares[:, None] + squares[None] - 2 * x @ x.T))
    np.fill_diagonal(d, 0.0)
    core = np.partition(d, min(min_samples, n - 1), axis=1)[:, min(min_samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    # Prim's tree, its edges by length, joined one by one: node n + i is the i-th join.
    best, via, done = reach[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    done[0] = True
    edges = []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(done, np.inf, best)))
        edges.append((best[j], int(via[j]), j))
        done[j] = True
        closer = ~done & (reach[j] < best)
        best[closer], via[closer] = reach[j][closer], j
    top = list(range(n))

    def find(a: int) -> int:
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    size, kids, height = [1] * n, {}, {}
    for i, (length, a, b) in enumerate(sorted(edges, key=lambda e: e[0])):
        a, b = find(a), find(b)
        top += [n + i]
        top[a] = top[b] = n + i
        size.append(size[a] + size[b])
        kids[n + i], height[n + i] = (a, b), length

    def leaves(a: int) -> list[int]:
        out, stack = [], [a]
        while stack:
            c = stack.pop()
            if c < n:
                out.append(c)
            else:
                stack += kids[c]
        return out

    # Condensed tree: a cluster lives from its birth until it splits into two large parts; points fall out on the way.
    children, born, stability, points = {0: []}, {0: 0.0}, {0: 0.0}, {0: []}
    work = [(2 * n - 2, 0)]
    while work:
        node, c = work.pop()
        if node < n:
            points[c].append(node)
            continue
        density = 1 / height[node] if height[node] > 0 else 1e12
        a, b = kids[node]
        large = [k for k in (a, b) if size[k] >= min_cluster_size]
        if len(large) == 2:
            stability[c] += (density - born[c]) * size[node]
            for k in large:
                new = len(born)
                children[c].append(new)
                children[new], born[new], stability[new], points[new] = [], density, 0.0, []
                work.append((k, new))
        else:
            for k in (a, b):
                if k in large:
                    work.append((k, c))
                else:
                    lost = leaves(k)
                    points[c] += lost
                    stability[c] += (density - born[c]) * len(lost)
    chosen: set[int] = set()
    score = dict(stability)
    for c in sorted(born, reverse=True):
        below = sum(score[k] for k in children[c])
        if c and (not children[c] or stability[c] >= below):
            chosen.add(c)
        else:
            score[c] = below
    labels = np.full(n, -1)
    number = 0
    todo = [0]
    while todo:
        c = todo.pop(0)
        if c in chosen:
            stack = [c]
            while stack:
                k = stack.pop()
                labels[points[k]] = number
                stack += children[k]
            number += 1
        else:
            todo += children[c]
    return labels


def cluster(docs: DataFrame, id_col: str = "row_id", text_col: str = "text", min_cluster_size: int = 3, max_features: int = 2000, stop_words: list[str] | None = STOP_WORDS) -> DataFrame:
    """id, cluster: clusters of TF-IDF vectors, in one task, of at most MAX_CLUSTER_ROWS texts; more are an error."""
    n = docs.count()
    if n > MAX_CLUSTER_ROWS:
        raise ValueError(f"{n} rows; clustering takes at most {MAX_CLUSTER_ROWS}")
    if n < min_cluster_size:
        raise ValueError(f"{n} rows are too few for clusters of {min_cluster_size}")
    weights = tfidf(docs, id_col, text_col, max_features, stop_words)
    every = docs.select(F.col(id_col).alias("id")).join(weights.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("w")), "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("id", ignore_index=True)
        if not len(rows):
            return
        found = [dict(w) if w is not None else {} for w in rows["w"]]
        at = {t: i for i, t in enumerate(sorted({t for w in found for t in w}))}
        x = np.zeros((len(rows), max(1, len(at))))
        for i, w in enumerate(found):
            for t, v in w.items():
                x[i, at[t]] = v
        yield pd.DataFrame({"id": rows["id"], "cluster": hdbscan(x, min_cluster_size).astype("int64")})

    return every.coalesce(1).mapInPandas(run, f"id {dict(docs.dtypes)[id_col]}, cluster bigint")


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the adjusted Rand index of two groupings, to 3 places."""
    two = lambda c: c.cast("double") * (c - 1) / 2
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("both"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(two(F.col("m"))).alias(name))
    joined = total.crossJoin(F.broadcast(side("a", "in_a"))).crossJoin(F.broadcast(side("b", "in_b")))
    expected = F.try_divide(F.col("in_a") * F.col("in_b"), two(F.col("n")))
    top, bottom = F.col("both") - expected, (F.col("in_a") + F.col("in_b")) / 2 - expected
    return joined.select("n", F.round(F.when(bottom == 0, F.lit(1.0)).otherwise(F.try_divide(top, bottom)), 3).alias("ari"))


def purity(rows: DataFrame, cluster_col: str, theme_col: str, noise: int = -1) -> DataFrame:
    """One row: n_clusters, n_noise and the mean over clusters of the largest theme's share, to 3 places; NaN without clusters."""
    cells = rows.groupBy(F.col(cluster_col).alias("c"), F.col(theme_col).alias("t")).agg(F.count("*").alias("n"))
    each = cells.groupBy("c").agg(F.max("n").alias("most"), F.sum("n").alias("size"))
    real = F.col("c") != noise
    mean = F.avg(F.when(real, F.col("most") / F.col("size")))
    return each.agg(F.count_if(real).alias("n_clusters"), F.coalesce(F.sum(F.when(~real, F.col("size"))), F.lit(0)).alias("n_noise"), F.round(F.coalesce(mean, F.lit(float("nan"))), 3).alias("mean_purity"))


def describe_clusters(docs: DataFrame, clusters: DataFrame, id_col: str = "row_id", text_col: str = "text", k: int = 8, max_features: int = 2000, stop_words: list[str] | None = STOP_WORDS) -> DataFrame:
    """One row per cluster: cluster, size, name, top_terms, exemplars (two, of 160 characters at most). `max_features` and `stop_words` should be those of `cluster`."""
    weights = tfidf(docs, id_col, text_col, max_features, stop_words)
    best = top_terms(weights, clusters.select("id", F.col("cluster").alias("group")), k)
    listed = best.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("top_terms"))
    texts = docs.select(F.col(id_col).alias("id"), F.substring(text_col, 1, 160).alias("t")).join(clusters, "id")
    first = Window.partitionBy("cluster").orderBy("id")
    examples = texts.withColumn("r", F.row_number().over(first)).where("r <= 2").groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("exemplars"))
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("size"))
    name = F.when(F.col("cluster") == -1, F.lit("noise/unclustered")).otherwise(F.concat(F.lit("cluster-"), F.col("cluster").cast("string"), F.lit(": "), F.array_join(F.slice("top_terms", 1, 3), ", ")))
    joined = sizes.join(listed.withColumnRenamed("group", "cluster"), "cluster", "left").join(examples, "cluster", "left")
    return joined.select("cluster", "size", name.alias("name"), "top_terms", "exemplars")
