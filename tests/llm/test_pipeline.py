"""The corpus pipeline's stages, each against brute force on what the stage before kept."""

import collections
import os
import random
import subprocess
import sys

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from labelwright.llm import lattice_sampling, mixing, quality_classifier, quality_rules, simhash


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        good = i % 4 > 0
        vocabulary = [f"term{x}" for x in rng.sample(range(4000), 90)]
        lines = [" ".join(vocabulary[j : j + 15]).capitalize() + "." for j in range(0, 90, 15)]
        if not good:
            lines = [" | ".join(x.upper() + "!!" for x in line.split()) for line in lines]
        rows.append((i, "\n".join(lines), "en", f"src{i % 3}", 0))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[i][1], "en", "src0", 0) for i in range(1, 20)] + [(2000 + i, rows[i][1].replace("term", "term", 1) + " extra", "en", "src1", 0) for i in range(1, 20)] + [(3000, None, "en", None, 0), (3001, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns, kept = docs.columns, []
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "simhash near-dedup", "mixing sources", "sentencepiece"]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == columns
        kept.append((before, docs))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    before, after = kept[0]
    judged = quality_rules.judge(before, "doc_id", "text", quality_rules.trained_field(before, labels))
    assert ids(after) == ids(judged.where("kept"))
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert {i for i in ids(after) if i < 1000} == {i for i, q in quality.items() if q}

    before, after = kept[1]
    scored = quality_classifier.scored(before, quality_classifier.train(kept[0][0], labels))
    assert ids(after) == ids(scored.where("score >= 0.3"))

    before, after = kept[2]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert ids(after) == {i for i in root if find(i) == i}

    before, after = kept[3]
    dealt = mixing.with_copies(before, mixing.source_targets(before, mixing.word_count(F.col("text"))))
    assert collections.Counter(r["doc_id"] for r in after.collect()) == {r["doc_id"]: r["_mix_copies"] for r in dealt.collect() if r["_mix_copies"]}

    before, after = kept[4]
    words = lattice_sampling.vocabulary(lattice_sampling.model_path(), lattice_sampling.ALPHA)
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    got = after.collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == 2 * before.count()
    assert all(lattice_sampling.decode(r["ids"], words) == texts[r["doc_id"]] and r["round_trip"] for r in got)
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, got))


def test_workers_give_freed_memory_back():
    """A worker is kept for later stages; what it freed, but held, counted against the executor (an Arrow batch and objects of 180 MB)."""
    code = """
import re
import pyarrow as pa
from labelwright.llm.common import slices
rss = lambda: int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
before = rss()
for part in slices(iter([pa.RecordBatch.from_arrays([pa.array(["x" * 3000] * 20000)], ["t"])])):
    objects = [bytes(900 + i % 7) for i in range(200_000)]
    objects = None
del part
assert rss() - before < 120, (before, rss())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))})
