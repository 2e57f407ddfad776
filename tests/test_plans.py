"""Contracts, settings, sources, the run log, the batch pipeline, reports and the stream."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from labelwright.operators import adversarial, drift
from labelwright.plans import batch, reports, runs
from labelwright.plans.contracts import AGREEMENT_METRICS, ANNOTATION, CHUNK, RAW_ABSTRACT, validate
from labelwright.plans.settings import Settings
from labelwright.sources import corpora
from labelwright.streaming import drift as stream_drift

RAW = "doc_id string, title string, text string, source string, retrieved_at string, ref_label string"
NOW = "2024-01-01T00:00:00+00:00"


def raw(spark, rows):
    return spark.createDataFrame([(i, "", t, "csv", NOW, ref) for i, t, ref in rows], RAW)


@pytest.mark.parametrize("rows, what", [([("1", None, None)], "null text"), ([("1", "a", None), ("1", "b", None)], "repeated doc_id")])
def test_raw_contract(spark, rows, what):
    with pytest.raises(ValueError, match=what):
        validate(raw(spark, rows), RAW_ABSTRACT)


def test_contracts_of_values(spark):
    row = ("c", "rule", "1.0", "m", "v1", "0" * 64, "a", 1.5, True, 0.0, None, None)
    kinds = ", ".join(f"{c} {t}" for c, t in ANNOTATION.columns.items())
    with pytest.raises(ValueError, match="confidence"):
        validate(spark.createDataFrame([row], kinds), ANNOTATION)
    validate(spark.createDataFrame([(*row[:7], 0.5, *row[8:])], kinds), ANNOTATION)
    with pytest.raises(ValueError, match="n_chars > 0"):
        validate(spark.createDataFrame([("d", "c", 0, "x", 0, True, None)], ", ".join(f"{c} {t}" for c, t in CHUNK.columns.items())), CHUNK)
    with pytest.raises(ValueError, match="not allowed extra"):
        validate(raw(spark, [("1", "a", None)]).withColumn("extra", F.lit(1)), RAW_ABSTRACT)


def test_settings():
    assert Settings.from_env({"ANNOT_CHUNK_TOKENS": "64", "OTHER": "x"}).chunk_tokens == 64
    for bad in ({"ANNOT_CHUNK_TOKENS": "8"}, {"ANNOT_DEDUP_THRESHOLD": "1"}, {"ANNOT_CHUNK_OVERLAP": "x"}):
        with pytest.raises(ValueError):
            Settings.from_env(bad)


def test_abstract_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('pmid,topic,text\n1,asthma,"A text,\nof two lines"\n2,,  \n3,,No topic\n')
    got = corpora.read_abstracts_csv(spark, str(tmp_path / "a.csv")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["ref_label"], r["title"]) for r in got] == [("pmid:1", "asthma", "asthma"), ("pmid:3", None, "")]
    validate(corpora.read_abstracts_csv(spark, str(tmp_path / "a.csv")), RAW_ABSTRACT)
    with pytest.raises(ValueError, match="pmid"):
        corpora.abstracts_from(spark.createDataFrame([("x",)], "text string"))


def test_atom(spark, tmp_path):
    entry = "<entry><id>{}</id><title> A\n title </title><summary>{}</summary><published>{}</published></entry>"
    feed = "<feed>" + entry.format("http://x/abs/1v1", "old", "2020-01-01") + entry.format("http://x/abs/2v1", "new", "2021-01-01") + entry.format("", "no id", "2022-01-01") + "</feed>"
    (tmp_path / "feed.xml").write_text(feed)
    got = corpora.read_atom(spark, str(tmp_path / "feed.xml")).collect()
    assert [(r["doc_id"], r["title"], r["text"]) for r in got] == [("arxiv:2v1", "A title", "new"), ("arxiv:1v1", "A title", "old")]


def test_records_from_xml(spark):
    article = "<PubmedArticle><PMID>{}</PMID><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>{}</AbstractText><AbstractText>end</AbstractText></Abstract></PubmedArticle>"
    page = "<Set>" + article.format(7, "word " * 80) + article.format(8, "short") + "</Set>"
    got = corpora.records_from_xml(spark.createDataFrame([(page,)], "xml string")).collect()
    assert [(r["pmid"], r["n_words"]) for r in got] == [(7, 82)]
    assert corpora.search_ids('{"esearchresult": {"idlist": ["1", "2"]}}') == ["1", "2"] and corpora.search_ids("{}") == []


def test_baselines_prompts_and_csv(spark, tmp_path):
    (tmp_path / "bare.json").write_text('{"a": 0.5, "b": 0.5}')
    (tmp_path / "nested.json").write_text('{"note": "n", "distribution": {"a": 1}}')
    read = lambda name: {r["label"]: r["mass"] for r in corpora.read_baseline(spark, str(tmp_path / name)).collect()}
    assert read("bare.json") == {"a": 0.5, "b": 0.5} and read("nested.json") == {"a": 1.0}
    assert corpora.load_prompt("about\n---\nPick {labels}: {text}\n") == "Pick {labels}: {text}" and corpora.load_prompt("plain") == "plain"
    shown = spark.range(1).select(corpora.render_prompt("{labels}|{text}", ["a", "b"], F.lit("x"))).first()[0]
    assert shown == "[a, b]|x"
    for version in ("v1", "v2"):
        (tmp_path / f"{version}_classify.md").write_text(f"about {version}\n---\n{version} {{labels}}: {{text}}\n")
    assert corpora.read_prompt(spark, str(tmp_path), "v2") == ("v2 {labels}: {text}", hashlib.sha256(b"v2 {labels}: {text}").hexdigest())
    with pytest.raises(FileNotFoundError, match="v1, v2"):
        corpora.read_prompt(spark, str(tmp_path), "v3")
    (tmp_path / "d.csv").write_text("text,true_label,pred_label,confidence\nt,a,b,0.5\nu,a,b,bad\n")
    assert [r["confidence"] for r in corpora.read_disagreements_csv(spark, str(tmp_path / "d.csv")).orderBy("text").collect()] == [0.5, None]


def test_chunk_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("d", "d#c0", 0, "text", "a")], corpora.CHUNK_JSON)
    corpora.write_chunks_jsonl(chunks, str(tmp_path / "c"))
    assert corpora.read_chunks_jsonl(spark, str(tmp_path / "c")).collect() == chunks.collect()
    with pytest.raises(ValueError):
        corpora.write_not_empty(chunks.limit(0), str(tmp_path / "e"))


def test_cached_responses(spark, tmp_path):
    (tmp_path / ("a" * 64 + ".json")).write_text('{"x":\n1}')
    row = corpora.read_responses(spark, str(tmp_path)).first()
    assert row["key_sha256"] == "a" * 64 and json.loads(row["raw"]) == {"x": 1}


def test_run_log(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "log"))
    assert log.runs().count() == 0
    kw = dict(backend="rule", model_id="m", prompt_version="v1", prompt_sha256="0" * 64)
    first = log.log(n_items=3, metrics={"acc": (0.5, 0.4, 0.6), "k": 0.1}, config={"b": 1, "a": 2}, **kw)
    second = log.log(n_items=1, metrics={}, **kw)
    assert [r["run_id"] for r in log.runs().collect()] == [second, first]
    shown = log.show(first)
    assert shown["config"] == {"a": 2, "b": 1} and [m["metric"] for m in shown["metrics"]] == ["acc", "k"]
    with pytest.raises(KeyError):
        log.show("none")
    for bad in (dict(n_items=0), dict(n_items=1, prompt_sha256="x")):
        with pytest.raises(ValueError):
            log.log(**{**kw, "metrics": {}, **bad})
    log.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    spark.createDataFrame([("r", 99)], "run_id string, schema_version int").write.mode("append").parquet(str(tmp_path / "log/runs"))
    with pytest.raises(ValueError, match="version"):
        runs.RunLog(spark, str(tmp_path / "log"))


def test_pipeline_end_to_end(spark, tmp_path):
    texts = {
        "diabetes": "Insulin therapy improved glucose control in adults with type 2 diabetes. The trial lasted two years.",
        "hypertension": "Systolic blood pressure fell in the hypertensive group. No change was seen in the control group.",
        "asthma": "Asthma control improved with a new inhaler in children. Wheezing was less frequent at night.",
    }
    rows = [(f"pmid:{i}{k}", t.replace("The", f"The {i}th"), k) for i in range(3) for k, t in texts.items()] + [("pmid:copy", texts["asthma"], "asthma"), ("pmid:none", "A short note about nothing in particular, without any keyword.", None)]
    got = batch.run_pipeline(raw(spark, rows), ["diabetes", "hypertension", "asthma"], str(tmp_path / "b"))
    metrics = {r["metric"]: r["value"] for r in got["metrics"].collect()}
    assert metrics["accuracy_vs_ref"] == 1.0 and metrics["cohens_kappa_vs_ref"] == 1.0
    assert got["dedup"].first()["n_exact"] >= 1
    assert corpora.latest_batch(spark, str(tmp_path / "b")).count() == got["annotations"].count()
    assert runs.RunLog(spark, str(tmp_path / "b/runs")).runs().count() == 1
    validate(got["metrics"], AGREEMENT_METRICS)
    assert "accuracy_vs_ref" in reports.metrics_report(got["metrics"])
    with pytest.raises(ValueError):
        batch.get_backend("none")


def test_batch_of_cached_answers(spark, tmp_path):
    """The prompt's version and digest are stamped and are in the keys of the cache; a text without an answer is an abstention."""
    (tmp_path / "v2_classify.md").write_text("about\n---\nPick {labels}: {text}")
    _, sha = corpora.read_prompt(spark, str(tmp_path), "v2")
    answer = json.dumps({"candidates": [{"content": {"parts": [{"text": '{"label": "asthma", "confidence": 0.75}'}]}}]})
    cache, root = str(tmp_path / "cache"), str(tmp_path / "b")
    corpora.write_responses(spark.createDataFrame([(f"pipeline:v2:{sha[:16]}:c1", answer), ("other", None)], "key string, raw string"), cache)
    chunks = spark.createDataFrame([("c1", "text"), ("c2", "text")], "chunk_id string, text string")
    batch.run_batch(chunks, ["asthma"], root, "gemini", "v2", cache_dir=cache, prompts=str(tmp_path))
    got = {r["chunk_id"]: r for r in corpora.latest_batch(spark, root).collect()}
    assert (got["c1"]["label"], got["c1"]["confidence"], got["c1"]["parsed_ok"]) == ("asthma", 0.75, True) and not got["c2"]["parsed_ok"]
    assert {r["prompt_sha256"] for r in got.values()} == {sha} and {r["prompt_version"] for r in got.values()} == {"v2"}


def test_latest_batch_goes_by_time_not_name(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("zzz", "2024-01-01"), ("aaa", "2024-02-01")], "batch_id string, created_at string").write.parquet(root + "/manifests")
    spark.createDataFrame([("1", "zzz"), ("2", "aaa")], "chunk_id string, batch_id string").write.partitionBy("batch_id").parquet(root + "/annotations")
    assert [r["chunk_id"] for r in corpora.latest_batch(spark, root).collect()] == ["2"]


def test_reports(spark):
    base = spark.createDataFrame([("asthma", 0.25), ("diabetes", 0.25), ("hypertension", 0.25), ("migraine", 0.25)], "label string, mass double")
    came = spark.createDataFrame([("asthma", 15.0), ("diabetes", 20.0), ("hypertension", 55.0), ("migraine", 10.0)], "label string, mass double")
    text = reports.drift_report(drift.check_drift(base, came), drift.aligned(base, came))
    assert "hypertension | 0.250 | 0.550 | +0.300" in text
    traps = adversarial.by_trap(adversarial.annotated(adversarial.cases(spark)))
    text = reports.adversarial_report(traps, adversarial.overall(traps))
    assert "36/52 = 0.692" in text and "sarcastic_review" in text


def test_stream(spark, tmp_path):
    rows = [(f"2024-01-{d:02d} 12:00:00", "ab"[i % 2] if d < 3 else "a") for d in (1, 2, 3, 6) for i in range(20)]
    source = tmp_path / "in"
    spark.createDataFrame(rows, "ts string, label string").select(F.to_timestamp("ts").alias("ts"), "label").coalesce(1).write.parquet(str(source / "one"))
    base = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "label string, mass double")
    seen = []
    stream = spark.readStream.schema("ts timestamp, label string").option("recursiveFileLookup", True).parquet(str(source))
    q = stream_drift.watch(stream, base, lambda v: seen.extend(v.collect()), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = {str(r["day"]): r["level"] for r in seen}
    assert got["2024-01-01"] == "OK" and got["2024-01-03"] == "ALERT"
