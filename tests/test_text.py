"""Text, chunks, annotators, duplicates, taxonomy."""

import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelwright import queries
from labelwright.functions import text as T
from labelwright.operators import adversarial, annotate, baseline, chunk, dedup, responses, shingling, taxonomy

NEAR = "the quick brown fox jumps over the lazy dog near the quiet river bank while the morning sun rises slowly over the distant misty hills and the birds begin to sing their early songs of joy and peace"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def test_normalize_and_shingles(spark):
    assert one(spark, "  Hello   WORLD ", T.normalize) == "hello world"
    assert len(one(spark, "a b c d e f", T.shingles)) == 2
    assert one(spark, "", T.shingles) == [] and one(spark, None, T.shingles) == []
    assert one(spark, "a b", T.shingles) == ["a b"]
    assert one(spark, "a b", T.digest) == hashlib.sha256(b"a b").hexdigest()


def test_sentences(spark):
    assert one(spark, "One. Two! Three?", T.sentences) == ["One.", "Two!", "Three?"]
    assert one(spark, "", T.sentences) == [] and one(spark, None, T.sentences) == []


def chunks_of(spark, text, **kw):
    return [r.asDict() for r in chunk.chunk(spark.createDataFrame([("d", text)], "doc_id string, text string"), **kw).orderBy("chunk_index").collect()]


def brute_chunks(sentences, tokens, overlap, least):
    out, i, budget = [], 0, tokens * 4
    while i < len(sentences):
        taken, size = [], 0
        for s in sentences[i:]:
            if taken and size + len(s) + 1 > budget:
                break
            taken.append(s)
            size += len(s) + 1
        if len(" ".join(taken)) >= least:
            out.append(" ".join(taken))
        i += max(1, round(len(taken) * (1 - overlap)))
    return out


@pytest.mark.parametrize("n, tokens, overlap", [(3, 16, 0.0), (10, 40, 0.5), (8, 12, 0.15), (8, 256, 0.15), (1, 16, 0.15)])
def test_chunks(spark, n, tokens, overlap):
    sentences = [f"Sentence number {i} has quite a few words in it." for i in range(n)]
    got = chunks_of(spark, " ".join(sentences), chunk_tokens=tokens, overlap=overlap)
    assert [c["text"] for c in got] == brute_chunks(sentences, tokens, overlap, 40)
    assert [c["chunk_id"] for c in got] == [f"d#c{i}" for i in range(len(got))]
    assert all(c["text"][-1] in ".!?" and c["n_chars"] == len(c["text"]) for c in got)


def test_chunks_come_a_few_documents_at_a_time():
    """A task that made the windows of a whole Arrow batch at once held thousands of documents as Python objects."""
    sentence = "Sentence with quite a few words in it, and some more of them."
    docs = [(f"d{i}", [f"{i} {sentence}"] * 20, None) for i in range(3000)] + [("long", [sentence] * 200_000, None), ("none", [], None)]
    kinds = pa.schema([("doc_id", pa.string()), ("s", pa.list_(pa.string())), ("ref_label", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*docs), kinds.types)], schema=kinds)
    out = list(chunk.chunked(iter([batch]), 1024, 0.15, 40))
    assert max(len(set(b.column("doc_id").to_pylist())) for b in out) <= shingling.ROWS
    whole = [r for b in out for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "chunk_index", "text")))]
    want = [(d, i, t) for d, s, _ in docs[:40] for i, t in enumerate(brute_chunks(s, 256, 0.15, 40))]
    assert whole[: len(want)] == want and [d for d, i, _ in whole if i == 0] == [d for d, s, _ in docs if s]


def test_chunk_guards(spark):
    assert chunks_of(spark, "   ") == [] and chunks_of(spark, None) == []
    with pytest.raises(ValueError):
        chunks_of(spark, "x", overlap=0.95)


def test_boundaries(spark):
    reasons = lambda t: one(spark, t, chunk.boundary_reasons)
    good = "This is a fine chunk of text that ends as it should."
    assert reasons(good) == [] and reasons("") == ["empty"]
    assert any("lower case" in r for r in reasons("t" + good[1:])) and any("no terminal" in r for r in reasons(good[:-1]))
    assert any("too long" in r for r in reasons("A" * 5000 + ".")) and any("too short" in r for r in reasons("A."))
    with pytest.raises(ValueError, match="d#c0"):
        chunk.with_boundaries(spark.createDataFrame([("d#c0", "bad")], "chunk_id string, text string"), strict=True)


def annotations(spark, texts, labels):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, text string")
    return [(r["label"], r["confidence"], r["parsed_ok"]) for r in annotate.annotate(rows, labels, prompt_sha256="0" * 64).orderBy("chunk_id").collect()]


def test_lexicon(spark):
    got = annotations(spark, ["Insulin and glucose in type 2 diabetes.", "Systolic blood pressure in hypertension.", " ", None, "Nothing here.", "insulin; hypertension"], annotate.DISEASES)
    assert [g[0] for g in got] == ["diabetes", "hypertension", None, None, None, "diabetes"]
    assert [g[2] for g in got] == [True, True, False, False, False, True]
    assert got[5][1] == round(np.exp(1) / (2 * np.exp(1) + 2), 4)
    assert annotations(spark, ["great, I love it"], annotate.REVIEWS)[0][0] == "positive"


def test_a_filter_on_annotations_does_not_search_again(spark):
    rows = annotate.annotate(spark.createDataFrame([("1", "a great day"), ("2", None)], "chunk_id string, text string"), ["positive", "negative"])
    searches = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")
    assert 0 < searches(rows) == searches(rows.where("parsed_ok AND label = 'positive'"))
    assert [r["chunk_id"] for r in rows.where("parsed_ok").collect()] == ["1"] and rows.count() == 2


def test_adversarial_goldens(spark):
    traps = adversarial.by_trap(adversarial.annotated(adversarial.cases(spark)))
    got = {r["trap_type"]: (r["correct"], r["n"]) for r in traps.collect()}
    assert got == {"boundary_comorbidity": (8, 8), "drug_name_trap": (8, 8), "symptom_overlap": (4, 8), "ambiguous_multi_disease": (4, 8), "hedging_language": (8, 8), "sarcastic_review": (4, 12)}
    whole = adversarial.overall(traps).first()
    assert (whole["correct"], whole["n"], whole["accuracy"], whole["weakest"]) == (36, 52, 0.692, "sarcastic_review")


def items(spark, texts):
    return spark.createDataFrame([(f"c{i + 1}", t) for i, t in enumerate(texts)], "chunk_id string, text string")


def test_exact_duplicates(spark):
    got = dedup.exact(items(spark, ["Same  text", "same text ", "other", None, None]), "chunk_id", "text").orderBy("chunk_id").collect()
    assert [(r["status"], r["first_seen"]) for r in got] == [("kept", "c1"), ("exact", "c1"), ("kept", "c3"), ("kept", "c4"), ("kept", "c5")]


def test_near_duplicates(spark):
    got = {r["chunk_id"]: r for r in dedup.deduplicate(items(spark, [NEAR, NEAR.replace("peace", "hope"), "something else altogether", NEAR])).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"c1": "kept", "c2": "near", "c3": "kept", "c4": "exact"}
    assert got["c2"]["matched"] == "c1" and got["c2"]["jaccard"] > 0.8
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            dedup.near_pairs(items(spark, ["a"]), "chunk_id", "text", bad)


def test_first_wins_is_no_component(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (6, 7, 0.8)], "a bigint, b bigint, jaccard double")
    assert sorted((r["id"], r["matched"]) for r in dedup.first_wins(pairs).collect()) == [(2, 1), (4, 3), (7, 6)]
    assert dedup.first_wins(pairs.limit(0)).count() == 0


def test_near_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 40, rng.integers(3, 60))]
        for _ in range(4):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 3)):
                words[at] = f"z{rng.integers(0, 9)}"
            texts.append(" ".join(words))
    sets = {f"c{i + 1}": {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i, t in enumerate(texts) for w in [t.split()]}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(items(spark, texts), "chunk_id", "text").collect()} == want


ODD = [" Ä  b\u00a0C\td e f ", "a b c", "x", "", None, "a b c d e a b c d e a b c d e", NEAR, "İ ß ſ \u2028 q w e r t y"]


def test_shingles_in_arrow_equal_sparks(spark):
    df = items(spark, ODD)
    of = F.transform(T.shingles(F.col("text")), lambda s: F.xxhash64(s))
    want = {r["chunk_id"]: r["h"] for r in df.select("chunk_id", of.alias("h")).collect()}
    assert {r["id"]: r["n_shingles"] for r in shingling.counted(df, "chunk_id", "text").collect()} == {k: len(v) for k, v in want.items()}
    least = F.array(*[F.array_min(F.transform(of, lambda h: F.xxhash64(h, F.lit(p)))) for p in range(20)])
    mins = {r["chunk_id"]: r["m"] for r in df.select("chunk_id", least.alias("m")).collect()}
    assert {r["id"]: r["sig"] for r in shingling.signed(df, "chunk_id", "text", 5, 20).collect()} == mins
    values, sizes = np.random.default_rng(1).integers(-(2**63), 2**63, 40_000), np.array([1, 30_000, 2, 9_997])
    got, ends = shingling.signatures(values, sizes, 3), np.cumsum(sizes)
    assert all((got[i] == shingling.signatures(values[e - n : e], np.array([n]), 3)[0]).all() for i, (e, n) in enumerate(zip(ends, sizes)))


def test_shingle_queries_interpret_no_function_for_each_shingle(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.shingle_counts(spark, str(tmp_path))
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["doc_id"]: r["n_shingles"] for r in df.collect()} == {i: len(shingling.hashes(one(spark, t, T.normalize).encode(), 5)) for i, t in enumerate(ODD) if t}


def test_common_passages_bring_no_pairs_together(spark, monkeypatch):
    """60 texts with a common passage of a third of their words; the shingles of the passage come last."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 80)) for _ in range(60)] + ["", None]
    texts += [texts[0] + " more", texts[1].replace("p7 ", "p8 ")]
    df = items(spark, texts)
    packed = shingling.packed(df, "chunk_id", "text").cache()
    often = shingling.prefixes(packed, 5, 0.8, np.empty(0, np.int64)).groupBy("h").agg(F.count("*").alias("df")).where("df > 16").cache()
    late = shingling.late_ones(often, 1000)
    assert 0 < len(late) == often.count() and len(shingling.late_ones(often, 0)) == 0
    before, after = (shingling.shared_only(shingling.prefixes(packed, 5, 0.8, x)).count() for x in (np.empty(0, np.int64), late))
    assert after < before / 2
    want = {("c1", "c63"), ("c2", "c64")}
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(df, "chunk_id", "text").collect()} == want
    monkeypatch.setattr(dedup, "MOST_LATE", 0)
    assert {(r["a"], r["b"]) for r in dedup.near_pairs(df, "chunk_id", "text").collect()} == want


def test_near_pairs_shuffle_no_sets_of_hashes(spark):
    """Texts go through the exchanges compressed; arrays of hashes took more than the texts."""
    df = dedup.near_pairs(items(spark, [NEAR, NEAR + " now", "other"]), "chunk_id", "text")
    assert "array<bigint>" not in "".join(x.dataType().simpleString() for x in iter_plan(df)) and df.count() == 1


def iter_plan(df):
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return [f for i in range(leaves.size()) for f in [leaves.apply(i).schema().apply(j) for j in range(leaves.apply(i).schema().size())]]


def test_band_candidates_find_very_near_texts(spark):
    got = dedup.band_candidates(items(spark, [NEAR, NEAR, "something else"]), "chunk_id", "text").collect()
    assert [(r["a"], r["b"]) for r in got] == [("c1", "c2")]


def answer(text, usage='"promptTokenCount": 5, "candidatesTokenCount": 2'):
    return '{"candidates": [{"content": {"parts": [{"text": %s}]}}], "usageMetadata": {%s}}' % (text, usage)


def test_responses(spark):
    import json

    raws = [answer(json.dumps(json.dumps(d))) for d in ({"label": " Asthma ", "confidence": 0.9}, {"label": "flu", "confidence": 0.9}, {"label": "asthma", "confidence": "high"}, {"label": "asthma", "confidence": 1.5})] + ["no json", None, answer('"x"', "")]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    strict = [r["p"] for r in df.select("i", responses.parsed(F.col("raw"), ["asthma"]).alias("p")).orderBy("i").collect()]
    assert [(p["label"], p["confidence"], p["parsed_ok"]) for p in strict] == [("asthma", 0.9, True), (None, 0.9, False), (None, None, False), ("asthma", None, False)] + [(None, None, False)] * 3
    text = json.dumps({"label": "ASTHMA", "confidence": "0.5"})
    more = spark.createDataFrame([(i, answer(json.dumps(t))) for i, t in enumerate([text, f"```json\n{text}\n```", text + " and so on", '{"label": "asthma"}', "[1]"])], "i int, raw string")
    got = [r["p"] for r in more.select("i", responses.parsed(F.col("raw"), ["Asthma"]).alias("p")).orderBy("i").collect()]
    assert [(p["label"], p["confidence"]) for p in got] == [("asthma", 0.5)] + [(None, None)] * 4 and got[0]["raw_text"] == text
    assert (strict[0]["input_tokens"], strict[0]["output_tokens"], strict[6]["input_tokens"]) == (5, 2, 0)
    loose = [r["p"] for r in df.select("i", responses.parsed(F.col("raw"), ["asthma"], keep_label=True).alias("p")).orderBy("i").collect()]
    assert [(p["label"], p["confidence"]) for p in loose][:4] == [("asthma", 0.9), (None, 0.9), ("asthma", None), ("asthma", None)]


def test_replay_and_resume(spark):
    key = hashlib.sha256(b"pmid:1").hexdigest()
    cache = spark.createDataFrame([(key, answer('"{\\"label\\": \\"asthma\\", \\"confidence\\": 1}"'))], "key_sha256 string, raw string")
    texts = spark.createDataFrame([("1", "t"), ("2", "t")], "chunk_id string, text string")
    got = responses.replay(texts, cache, ["asthma"], F.concat(F.lit("pmid:"), "chunk_id"), prompt_sha256="0" * 64)
    assert sorted((r["chunk_id"], r["label"], r["parsed_ok"]) for r in got.collect()) == [("1", "asthma", True), ("2", None, False)]
    assert [r["chunk_id"] for r in responses.unfinished(texts, got, "chunk_id").collect()] == ["2"]


def test_themes(spark):
    got = [one(spark, t, taxonomy.theme) for t in ("Hypertension and insulin", "metformin was prescribed", "nothing", None)]
    assert got == ["T1_boundary_diabetes_hypertension", "T4_drug_name_cue", "T0_unassigned", "T0_unassigned"]


def test_hdbscan_finds_clumps():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.05, (20, 2)) for c in ((0, 0), (5, 5), (0, 5))] + [[[20.0, 20.0]]])
    labels = taxonomy.hdbscan(x, 3)
    assert all(len(set(labels[i : i + 20])) <= 3 for i in (0, 20, 40))
    assert not set(labels[:20]) & set(labels[20:40]) - {-1} and not set(labels[20:40]) & set(labels[40:60]) - {-1}
    with pytest.raises(ValueError):
        taxonomy.hdbscan(x[:2], 3)


def test_rand_index_and_purity(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "b"), (-1, "a")], "c bigint, t string")
    assert taxonomy.adjusted_rand(rows.where("c >= 0"), "c", "t").first()["ari"] == 1.0
    got = taxonomy.purity(rows, "c", "t").first()
    assert (got["n_clusters"], got["n_noise"], got["mean_purity"]) == (2, 1, 1.0)


def test_synthetic_taxonomy(spark):
    """Clusters follow the texts' themes for the most part; two texts of different themes may share one."""
    rows = taxonomy.synthetic_disagreements(spark)
    clusters = taxonomy.cluster(rows)
    joined = rows.join(clusters, rows["row_id"] == clusters["id"])
    assert taxonomy.purity(joined, "cluster", "human_theme").first()["mean_purity"] > 0.85
    assert taxonomy.describe_clusters(rows, clusters).count() >= 2


def test_split_and_head(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "i bigint, s string")
    got = baseline.stratified_split(rows, "s", "i").groupBy("s").agg(F.count_if("is_test").alias("n")).collect()
    assert {r["s"]: r["n"] for r in got} == {"a": 5, "b": 5}
    assert baseline.stratified_head(rows, "s", "i", 3).count() == 6


def test_split_ranks_no_stratum_in_one_task(spark):
    rows = [(i if i % 50 else None, "ab"[i % 7 == 0] if i % 9 else None, i) for i in range(900)] + [(3, "a", 900)]
    df = baseline.stratified_split(spark.createDataFrame(rows, "i bigint, s string, row bigint"), "s", "i", 0.3)
    assert "row_number() windowspecdefinition(s#" in (plan := df._jdf.queryExecution().analyzed().toString()) and all("_part#" in x.split(" ASC")[0] for x in plan.split("row_number() windowspecdefinition(")[1:])
    got = {}
    for r in df.collect():
        got.setdefault(r["s"], []).append((r["i"], r["is_test"]))
    for s, found in got.items():
        key = lambda i: (i is not None, hashlib.md5(f"7:{i}".encode()).hexdigest(), i)
        ordered = sorted((i for i, t, _ in rows if t == s), key=key)
        assert sorted((i for i, t in found if t), key=key) == ordered[: int(len(ordered) * 0.3)] and len(found) == len(ordered)


def test_vectors_equal_the_long_form(spark):
    """Counted within tasks, over rows that repeat an id, null ids and texts without terms."""
    texts = ["red apple red", "blue sky über", None, "red sky apple", "apple sky", "zebra"]
    df = spark.createDataFrame([(i % 4 if i < 5 else None, t) for i, t in enumerate(texts)], "id int, text string")
    known = taxonomy.vocabulary(df, "id", "text", 9)
    got = {(r["id"], list(known)[at]): round(w, 9) for r in taxonomy.vectors(df, "id", "text", known, sublinear=True).collect() for at, w in zip(r["at"], r["weight"])}
    n, docs = 6, {0: ["red apple red", "apple sky"], 1: ["blue sky über"], 3: ["red sky apple"], None: ["zebra"]}
    tf = {k: sum((collections.Counter([*w, *map(" ".join, zip(w, w[1:]))]) for w in map(str.split, v)), collections.Counter()) for k, v in docs.items()}
    total, dfs = sum(tf.values(), collections.Counter()), collections.Counter(t for c in tf.values() for t in c)
    kept = sorted(sorted(total, key=lambda t: (-total[t], t))[:9])
    assert list(known) == kept and all(known[t] == pytest.approx(np.log((1 + n) / (1 + dfs[t])) + 1) for t in kept)
    raw = {k: {t: (1 + np.log(c[t])) * known[t] for t in kept if t in c} for k, c in tf.items() if k is not None}
    assert got == {(k, t): pytest.approx(x / np.sqrt(sum(y * y for y in w.values())), abs=1e-8) for k, w in raw.items() for t, x in w.items()}


def test_baseline_learns(spark):
    rows = spark.createDataFrame([(i, ("good fine sunny" if i % 2 else "bad poor rainy") + f" day{i % 5}", "yn"[i % 2]) for i in range(40)], "i bigint, t string, y string")
    got = baseline.predict(rows, "i", "t", "y", max_features=50).collect()
    assert len(got) == 20 and all(r["label"] == r["predicted"] for r in got)


def test_weights_are_fitted_on_the_training_rows_alone(spark):
    """What only the other rows say changes neither the terms nor their weights."""
    train = [(i, "red apple" if i % 2 else "blue sky") for i in range(6)]
    rows = lambda more: spark.createDataFrame([*train, *more], "id int, text string")
    weigh = lambda df: {(r["id"], r["term"]): round(r["weight"], 9) for r in taxonomy.tfidf(df, "id", "text", 4, fitted_on=df.where("id < 6")).collect()}
    one, two = weigh(rows([(9, "red sky")])), weigh(rows([(9, "red sky"), (10, "zebra zebra zebra apple"), (11, "sky sky")]))
    assert one == {k: v for k, v in two.items() if k[0] < 10} and {t for _, t in two} <= {"red", "apple", "red apple", "blue", "sky", "blue sky"}


def test_baseline_query_uses_rare_terms(spark, tmp_path):
    """599 words and bigrams are in every document, the two that tell the labels apart in half of them each."""
    common = " ".join(f"common{i}" for i in range(300))
    spark.createDataFrame([(i, f"{common} {'good' if i % 2 else 'bad'}") for i in range(40)] + [(40, None), (41, "")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(42)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    row = queries.baseline_lr_accuracy(spark, str(tmp_path)).first()
    assert row["n"] == 20 and row["n_correct"] >= 19


def test_top_terms_by_blocks_equal_the_long_form(spark, monkeypatch):
    """Small blocks and shares of hashes; repeated and null ids, null groups, a group of few documents, texts without terms; no exchange of a term's row for each document."""
    rng = np.random.default_rng(9)
    rows = [(i % 90, " ".join(f"w{x}" for x in rng.zipf(1.4, 30) if x < 500), "ab"[i % 2]) for i in range(100)]
    rows += [(None, "w1 w2 lost", "a"), (200, None, "a"), (201, "", "b"), (202, "w1 w3", None), (203, "rare w1 rare", "c")]
    df = spark.createDataFrame(rows, "id int, text string, g string")
    monkeypatch.setattr(taxonomy, "BLOCK_BYTES", 500)
    monkeypatch.setattr(taxonomy, "SHARE_CHARS", 3000)
    of = lambda x: {(r["group"], r["rank"]): (r["term"], round(r["weight"], 9)) for r in x.collect()}
    want = of(taxonomy.top_terms(taxonomy.tfidf(df, "id", "text", None), df.select("id", F.col("g").alias("group")), 8))
    assert of(taxonomy.top_terms_of(df, "id", "text", "g", 8)) == want and len(want) == 8 + 8 + 4


def test_top_terms_of_a_rare_language(spark, tmp_path):
    """Words and bigrams of one language alone outnumber any vocabulary that the other's would have to enter."""
    rows = [(i, " ".join(f"word{j}" for j in range(1200)), "en") for i in range(3)] + [(9, "seltenes wort seltenes wort", "de")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["group"], r["rank"]): (r["term"], r["weight"]) for r in queries.tfidf_top_terms(spark, str(tmp_path)).collect()}
    tf = {"seltenes": 2, "seltenes wort": 2, "wort": 2, "wort seltenes": 1}
    norm = sum(n * n for n in tf.values()) ** 0.5  # the idf is the same for all four
    assert [got[k] for k in sorted(got) if k[0] == "de"] == [(t, pytest.approx(n / norm, abs=1e-6)) for t, n in sorted(tf.items(), key=lambda x: (-x[1], x[0]))]
    assert sum(k[0] == "en" for k in got) == 8
