"""The study's document, comparison of annotators, cluster names, duplicates by estimates, writers and the programs."""

import json

import pytest
from pyspark.sql import functions as F

from labelwright import cli
from labelwright.operators import dedup, taxonomy
from labelwright.plans import runs, study
from labelwright.sources import corpora

TOPICS = ("asthma", "diabetes", "hypertension", "migraine")


def tables(spark):
    """40 abstracts of four topics; two of them are mislabelled, one annotation can't be read."""
    abstracts, rows = [], []
    for i in range(40):
        topic = TOPICS[i % 4]
        text = " ".join([topic] * 3 + ["study", f"w{i}"] + ["more"] * i)
        abstracts.append((i, topic, "t", "a", text, len(text), 5 + i))
        pred = "migraine" if i in (1, 2) else topic
        rows.append((i, topic, pred, 0.95 if i % 2 else 0.55, 0 if i == 39 else 1, 100, 10))
    rows.append((99, "asthma", "asthma", 0.9, 1, 100, 10))  # has no abstract
    return spark.createDataFrame(abstracts, corpora.ABSTRACT_CSV), spark.createDataFrame(rows, corpora.ANNOTATION_CSV)


def test_results(spark, tmp_path):
    abstracts, rows = tables(spark)
    got = study.results(abstracts, rows, TOPICS)
    assert (got["n"], got["n_parse_failures"]) == (39, 1) and got["accuracy"] == pytest.approx(37 / 39)
    assert got["accuracy_ci95"][0] < got["accuracy"] < got["accuracy_ci95"][1]
    assert got["kappa"] == pytest.approx(study.results(abstracts, rows, TOPICS, with_baseline=False)["kappa"])
    assert got["per_class"]["diabetes"] == {"precision": 1.0, "recall": 0.9, "f1": pytest.approx(18 / 19), "support": 10}
    assert [r["quartile"] for r in got["error_by_length"]] == list(study.QUARTILES) and sum(r["n"] for r in got["error_by_length"]) == 39
    assert sum(b["n"] for b in got["calibration_bins"]) == 39 and got["cost"]["input_tokens_total"] == 3900
    base = got["baseline"]
    assert 0 < base["test_n"] < 39 and base["accuracy"] == 1.0 and base["mcnemar_b10"] == 0
    study.write_results(spark, got, str(tmp_path / "r"))
    back = study.read_results(spark, str(tmp_path / "r"))
    assert back == json.loads(json.dumps(got))
    short = study.headline(back)
    assert (short["n_correct"], short["accuracy"], short["ece"]) == (37, 0.949, round(got["ece"], 3))
    assert study.label_distribution(abstracts, rows)["true_topics"] == {"asthma": 10, "diabetes": 10, "hypertension": 10, "migraine": 9}
    assert study.one_wrong_in(0.9597) == 25 and study.one_wrong_in(1.0) is None
    with pytest.raises(ValueError, match="belongs"):
        study.results(abstracts, rows.where("pmid = 99"), TOPICS)


def test_raters(spark):
    ref = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "item_id bigint, label string")
    other = ref.withColumn("label", F.when(F.col("item_id") == 0, "b").when(F.col("item_id") == 5, None).otherwise(F.col("label")))
    got = {r["metric"]: (r["value"], r["n"]) for r in study.rater_comparison(ref, {"same": ref, "other": other}).collect()}
    assert got["accuracy:same"] == (1.0, 6) and got["accuracy:other"] == (pytest.approx(0.8), 5)
    # Five items are complete: four agree wholly, one has 2 of 3; labels stand 8 to 7.
    p, e = (4 + 1 / 3) / 5, (8**2 + 7**2) / 15**2
    assert got["fleiss_kappa"] == (pytest.approx((p - e) / (1 - e)), 5) and got["krippendorff_alpha"][1] == 6


def test_disagreements_of_the_study(spark):
    abstracts, rows = tables(spark)
    got = taxonomy.study_disagreements(rows.where("pmid < 30"), abstracts).orderBy("true_label").collect()
    assert [(r["true_label"], r["pred_label"], r["source"]) for r in got] == [("diabetes", "migraine", "study"), ("hypertension", "migraine", "study")]


def test_names_from_cached_answers(spark, tmp_path):
    kinds = "cluster bigint, size bigint, name string, top_terms array<string>, exemplars array<string>"
    shown = spark.createDataFrame([(-1, 2, "noise/unclustered", ["x"], ["e"]), (0, 3, "cluster-0: a", ["a"], ["e"]), (1, 3, "cluster-1: b", ["b"], ["e"])], kinds)
    answer = lambda t: json.dumps({"candidates": [{"content": {"parts": [{"text": t}]}}]})
    asked = taxonomy.naming_prompts(shown)
    assert [r["key"] for r in asked.orderBy("cluster").collect()] == ["taxonomy-llm:0", "taxonomy-llm:1"]
    corpora.write_responses(spark.createDataFrame([("taxonomy-llm:0", answer('{"name": "N", "description": "D"}')), ("taxonomy-llm:1", answer("{}"))], "key string, raw string"), str(tmp_path))
    answers = corpora.read_responses(spark, str(tmp_path))
    got = {r["cluster"]: (r["llm_name"], r["llm_description"]) for r in taxonomy.named_clusters(shown, answers).collect()}
    assert got[0] == ("N", "D") and got[1] == ("cluster-1: b", "") and got[-1][0] == "noise/unclustered"
    with pytest.raises(ValueError, match="1"):
        taxonomy.named_clusters(shown, answers.where(F.col("raw").contains("N")))


def test_duplicates_by_estimates_and_the_gate(spark):
    assert dedup.bands_for(0.8, 128) == (9, 13)
    base = "Sentence " + " ".join(f"w{i}" for i in range(120)) + "."
    rows = spark.createDataFrame([("a", base), ("b", base.replace("w60", "other")), ("c", base.upper()), ("d", "Something else " * 9 + "ends.")], "chunk_id string, text string")
    got = {r["chunk_id"]: r for r in dedup.deduplicate(rows, verify=False, min_chunk_chars=40).collect()}
    assert [got[x]["status"] for x in "abcd"] == ["kept", "near", "exact", "kept"] and got["b"]["matched"] == "a" and 0.8 < got["b"]["jaccard"] < 1
    assert dedup.stats_document(dedup.deduplicate(rows)).first().asDict() == {"contract_version": "1.0", "n_input": 4, "n_kept": 2, "n_exact_duplicates": 1, "n_near_duplicates": 1}
    with pytest.raises(ValueError, match="bad chunk boundaries: d"):
        dedup.deduplicate(rows.where("chunk_id = 'd'").withColumn("text", F.lit("short")), min_chunk_chars=40)


def test_writers_labels_and_retries(spark, tmp_path):
    abstracts, rows = tables(spark)
    corpora.write_abstracts_csv(abstracts.union(abstracts), str(tmp_path / "abs"))
    assert sorted(corpora.read_study_csv(spark, str(tmp_path / "abs"), corpora.ABSTRACT_CSV).collect()) == sorted(abstracts.collect())
    for part in (rows.where("pmid < 5"), rows.where("pmid >= 5")):
        corpora.append_annotations_csv(part, str(tmp_path / "ann"))
    assert sorted(corpora.read_study_csv(spark, str(tmp_path / "ann"), corpora.ANNOTATION_CSV).collect()) == sorted(rows.collect())
    assert corpora.parse_labels(" a, ,b,") == ["a", "b"]
    waits, answers = [], [OSError("x"), TimeoutError("y"), b"z"]

    def get():
        if isinstance(x := answers.pop(0), OSError):
            raise x
        return x

    assert corpora.fetch(get, 3, waits.append) == b"z" and waits == [2.0, 4.0]
    answers[:] = [OSError("x")] * 2
    with pytest.raises(ConnectionError):
        corpora.fetch(get, 1, waits.append)


def test_run_fields(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "log"))
    kw = dict(backend="rule", model_id="m", prompt_version="v1", prompt_sha256="0" * 64, n_items=1, metrics={})
    assert log.log(run_id="mine", batch_id="b", labels=["x", "y"], seed=7, prompt_path="p", **kw) == "mine"
    shown = log.show("mine")
    assert (shown["labels"], shown["seed"], shown["batch_id"], shown["prompt_path"], shown["backend_version"]) == (["x", "y"], 7, "b", "p", "1.0")
    with pytest.raises(ValueError, match="already"):
        log.log(run_id="mine", **kw)
    log.log(**kw)
    log.export(str(tmp_path / "one"), "mine")
    assert [r["run_id"] for r in spark.read.json(str(tmp_path / "one")).collect()] == ["mine"]


def test_programs(spark, tmp_path, capsys):
    at = lambda x: str(tmp_path / x)
    run = lambda *a: cli.main(list(a), spark)
    texts = ["Insulin therapy improved glucose control in adults. The trial lasted two years.", "Asthma control improved with a new inhaler in children. It was safe."]
    (tmp_path / "a.csv").write_text("pmid,topic,text\n" + "".join(f"{i},diabetes,{t}\n" for i, t in enumerate([*texts, texts[0]])))
    (tmp_path / "none.csv").write_text("pmid,topic,text\n1,, \n")
    assert run("extract", "--from-csv", at("none.csv"), "--out", at("x")) == 2
    assert run("extract", "--from-csv", at("missing.csv"), "--out", at("x")) == 2
    assert run("extract", "--from-csv", at("a.csv"), "--out", at("raw")) == 0
    assert run("chunk", at("raw"), "--out", at("chunks")) == 0
    capsys.readouterr()
    assert run("dedup", at("chunks"), "--out", at("kept"), "--stats", at("stats")) == 0
    assert json.loads(capsys.readouterr().out) == {"contract_version": "1.0", "n_input": 3, "n_kept": 2, "n_exact_duplicates": 1, "n_near_duplicates": 0}
    assert "ref_label" not in spark.read.json(at("kept")).columns
    assert run("annotate", at("kept"), "--labels", " , ", "--batch-dir", at("b")) == 2
    assert run("annotate", at("kept"), "--batch-id", "one", "--batch-dir", at("b")) == 0
    assert json.loads(capsys.readouterr().out)["n_chunks"] == 2
    (tmp_path / "base.json").write_text('{"distribution": {"a": 0.5, "b": 0.5}}')
    (tmp_path / "came.json").write_text('{"a": 99, "b": 1}')
    assert run("monitor", "--baseline", at("base.json"), "--incoming", at("came.json"), "--report", at("drift.md")) == 0
    assert run("monitor", "--baseline", at("base.json"), "--incoming", at("came.json"), "--fail-on-alert") == 3
    assert run("monitor", "--baseline", at("no.json"), "--incoming", at("came.json")) == 2
    assert "ALERT" in (tmp_path / "drift.md").read_text()
    assert run("experiments", "--db", at("log"), "list") == 0 and run("experiments", "--db", at("log"), "show", "none") == 2
    assert run("adversarial", "--per-trap", "0") == 2 and run("adversarial", "--report", at("adv.md")) == 0
    assert "36/52" in (tmp_path / "adv.md").read_text()
    assert run("taxonomy", "--no-synthetic") == 2 and run("taxonomy", "--report", at("tax.md")) == 0


def test_study_program(spark, tmp_path):
    abstracts, rows = tables(spark)
    corpora.write_abstracts_csv(abstracts, str(tmp_path / "abs"))
    corpora.append_annotations_csv(rows, str(tmp_path / "ann"))
    assert cli.main(["score", str(tmp_path / "abs"), str(tmp_path / "ann"), "--no-baseline", "--out", str(tmp_path / "r")], spark) == 0
    assert study.read_results(spark, str(tmp_path / "r"))["n"] == 39
