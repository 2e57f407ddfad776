"""Each query of the subpackage over a folder of odd rows (nulls, repeats, long texts, clashing columns) and over empty tables, against brute force."""

import collections
import glob
import hashlib
import os
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labelwright.llm import html_extract, quality_classifier, quality_rules, registry, simhash, token_counts, url_filters

LONG = "\n".join(" ".join(f"word{(i * j) % 700}" for i in range(60)) + "." for j in range(1, 300))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (5, "another text"), (6, LONG), (7, LONG), (None, "no id here"), (None, None), (8, "abc"), (9, "abcdefgh"),
    (10, "ünïcödé 𝔘 ▁ text <|endoftext|>   space"), (11, "A | B || C!! 12, (x) [y] the the the\nsame line\nsame line\n\nend."), (12, " ".join(f"w{i}" for i in range(60)) + "."),
]
#: Columns that the operators use inside.
CLASH = ["_id", "_node", "_no_id", "node", "key", "root", "least", "digest", "score", "kept", "size", "_mix_size", "_mix_rate", "_mix_source", "_mix_copy", "_mix_copies", "_row", "_at", "_next", "_group", "_text", "_key", "id", "t", "a.b"]
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, toxic int, quality int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
PAGES = [
    (1, None, None), (2, "", ""), (3, "no scheme/net", "plain"), (4, "HTTP://A.Example.NET:80/en/x?y#z", "<article><p>One  &amp;\n two</p></article>"), (5, "https://x.example.com/de/1", "<p>"),
    (6, "https://example.com?q=/de/", "<script>x</script>"), (6, "https://example.com?q=/de/", "<script>x</script>"), (7, "ftp://w.org/fr/1/2/3", None), (8, "://net/", "<p>y"), (None, "https://notexample.com/de/", "z"),
]
CHATS = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>"), (2, None, None, "x"), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (3, 5, "tool", "é" * 9), (None, 0, "user", "u"), (None, 1, "assistant", "a")]


def write(spark, root, rows, kinds, name, clash=()):
    df = spark.createDataFrame(rows, kinds)
    for c in clash:
        df = df.withColumn(c, F.concat(F.lit(f"{c}:"), F.coalesce(F.col("text"), F.lit("null"))))
    df.repartition(2).write.parquet(f"{root}/{name}.parquet")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, None, [None, "s", "t"][n % 3], None) for n, (i, t) in enumerate(TEXTS)]
    labels = [(i, None, q) for i, q in [(None, 1), (1, None), (2, 0), (4, 0), (5, 1), (5, 0), (6, 1), (7, 1), (11, 0), (12, 1), (99, 1), (12, 7)]]
    for name, data in (("documents", rows), ("labels", labels), ("pages", PAGES), ("conversations", CHATS)):
        write(spark, root, data, TABLES[name], name, CLASH if name == "documents" else ())
    return root


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for name, kinds in TABLES.items():
        write(spark, root, [], kinds, name)
    return root


def got(spark, name, root):
    return registry.QUERIES[name](spark, root).collect()


@pytest.mark.parametrize("name", registry.QUERIES)
def test_empty_tables(spark, empty, name):
    rows = got(spark, name, empty)
    assert [r["conv_id"] for r in rows] == ([-1] if name.startswith("op5") else [])


@pytest.mark.parametrize("name", registry.ORACLES)
def test_sql(spark, odd, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({glob.glob(f'{odd}/{t}.parquet/*.parquet')!r})")
    found = con.execute(registry.ORACLES[name])
    columns = sorted(c[0] for c in found.description)
    want = [dict(zip([c[0] for c in found.description], r)) for r in found.fetchall()]
    rows = got(spark, name, odd)
    assert sorted(rows[0].asDict()) == columns
    assert sorted(repr([r[c] for c in columns]) for r in rows) == sorted(repr([r[c] for c in columns]) for r in want)


def _h(x, seed=42):
    """What Spark's xxhash64 gives for a string, a bigint or an int, unsigned."""
    raw = x.encode() if isinstance(x, str) else x
    return xxhash.xxh64_intdigest(raw, seed)


def brute_fingerprint(text):
    """Bins, one at a time: its least hash, or that of the first bin that isn't empty in its own order."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    long = lambda v: v.to_bytes(8, "little")
    number = lambda v: v.to_bytes(4, "little", signed=True)
    if not words:
        return "0" * 256
    if len(words) < 5:
        hashes = [_h(" ".join(words))]
    else:
        each = [_h(w) for w in words]
        hashes = []
        for i in range(len(words) - 4):
            seed = 42
            for v in each[i : i + 5]:
                seed = _h(long(v), seed)
            hashes.append(seed)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    least = {}
    for v in hashes:
        place = ((v >> 56) + 128) % 256
        least[place] = min(least.get(place, 2**63), signed(v))
    out = []
    for k in range(256):
        value = least.get(k)
        for t in range(16):
            if value is None:
                value = least.get(_h(number(t), _h(number(k))) & 255)
        if value is None:
            value = min((signed(_h(number(16), _h(number(j), _h(number(k))))), v) for j, v in least.items())[1]
        digits = f"{value & (2**64 - 1):X}"
        out.append(f"{_h(number(k), _h(digits)) & 15:x}")
    return "".join(out)


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if "0" * 256 in (a, b):
        return 0.0
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (15 / 16))


def test_op2(spark, odd):
    texts = sorted(((i, t or "", brute_fingerprint(t)) for i, t in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    want = []
    for n, (i, text, own) in enumerate(texts):
        after = texts[(n + 1) % len(texts)]
        part = len(text) // 4
        edited = text[: len(text) - part] + after[1][:part]
        other = brute_fingerprint(edited)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, brute_likeness(own, other), brute_likeness(own, after[2])))
    rows = got(spark, "op2_fingerprints", odd)
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    rows = sorted((tuple(r) for r in rows), key=order)
    want.sort(key=order)
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert [v for r in rows for v in r[5:]] == pytest.approx([v for w in want for v in w[5:]])


def test_op3(spark, odd):
    rows = got(spark, "op3_sampled_pieces", odd)
    assert all(r["round_trip"] for r in rows) and {r["doc_id"] for r in rows} == {i for i, _ in TEXTS}
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(tuple(r["ids"]))
    assert len(by[6]) == 2 and len(set(by[6])) == 2


def test_op4(spark, odd):
    rows = got(spark, "op4_url_filter", odd)
    assert len(rows) == len(PAGES)
    rules = (("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/"))
    for r in rows:
        url = next(u for i, u, _ in PAGES if i == r["page_id"])
        head, mark, rest = (url or "").partition("://")
        cut = re.search(r"[/?#]|$", rest).start()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut]) if mark else ""
        path = re.split(r"[?#]", rest[cut:])[0] if mark else ""
        fits = [h + p for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=len, default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule:
            assert r["verdict"] == dict(url_filters.RULES)[rule]
        else:
            assert r["verdict"] == ("block" if r["purity"] >= url_filters.REJECT_AT else "allow")


def test_op6(spark, odd):
    fp = {}
    for t in {t for _, t in TEXTS}:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        bits = [sum(_h(g) >> b & 1 for g in grams) * 2 > len(grams) for b in range(64)]
        fp[t] = sum(v << b for b, v in enumerate(bits))
    root = {f: f for f in fp.values()}
    while any((a ^ b).bit_count() <= 2 and root[a] > root[b] and not root.update({a: root[b]}) for a in root for b in root):
        pass
    least = {}
    for i, t in TEXTS:
        if i is not None:
            least[root[fp[t]]] = min(i, least.get(root[fp[t]], i))
    want = sorted((repr(i), f"{fp[t]:016x}", least.get(root[fp[t]])) for i, t in TEXTS)
    assert sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got(spark, "op6_simhash_neardup", odd)) == want


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_op7(spark, odd):
    rows = got(spark, "op7_quality_rules", odd)
    want = collections.Counter()
    for i, t in TEXTS:
        c = brute_counts(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert collections.Counter(tuple(r)[:7] for r in rows) == want
    assert all(r["kept"] == (not r["base_failed"] and r["content_share"] >= quality_rules.CONTENT_SHARE) for r in rows)


def brute_statistics(text):
    t = text or ""
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
    of = lambda chars: sum(c in chars for c in t)
    twice = i = 0
    while i < len(words) - 1:
        if words[i] == words[i + 1]:
            twice, i = twice + 1, i + 2
        else:
            i += 1
    return {
        "_c_chars": len(t), "_c_words": len(words), "_c_distinct": len(set(words)), "_c_upper": sum("A" <= c <= "Z" for c in t), "_c_symbols": of("#*$%&|<>"), "_c_pipes": of("|"), "_c_bangs": of("!"),
        "_c_digits": sum("0" <= c <= "9" for c in t), "_c_ends": of(".?:;"), "_c_commas": of(","), "_c_marks": of("@/_=+{}[]()\\~^"), "_c_lines": len(lines), "_c_distinct_lines": len(set(lines)), "_c_twice": twice,
        "_c_short": sum(len(w) <= 3 for w in words),
    }


def test_op8(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet").select("text")
    for r in docs.withColumns(quality_classifier.statistics(F.col("text"))).collect():
        assert {k: r[k] for k in brute_statistics("")} == brute_statistics(r["text"]), r["text"]
    rows = got(spark, "op8_quality_score", odd)
    assert sorted(repr(r["doc_id"]) for r in rows) == sorted(repr(i) for i, _ in TEXTS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_op8_learns_from_rows_that_are_not_held_out(spark, odd):
    """Labels of held-out rows change no score."""
    docs, labels = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{odd}/labels.parquet")
    held = quality_classifier.held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.train(docs, labels.where(~held)) == quality_classifier.train(docs, turned.where(~held))


def test_op9(spark, odd):
    rows = got(spark, "op9_html_text", odd)
    by = {r["page_id"]: r["text"] for r in rows}
    assert len(rows) == len(PAGES) and by[1] == by[2] == by[5] == by[6] == by[7] == "" and by[4] == "One & two"
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert all(r["text"] == html_extract.extract([html or ""], html_extract.default_potentials())[0] for r in rows for i, _, html in PAGES if i == r["page_id"])


def test_op10(spark, odd):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_counts.tokenizer_path())
    want = []
    for i, t in TEXTS:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((repr(i), len((t or "").encode()), n, n > 512))
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got(spark, "op10_token_counts", odd)) == sorted(want)


def test_stages_keep_all_columns(spark, odd):
    """Stages give back whole rows, whatever their columns are called."""
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c}:{r['text'] if r['text'] is not None else 'null'}" for c in CLASH)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, odd)
    assert {r["doc_id"] for r in last.collect()} == {i for i, _ in TEXTS}


def test_pipeline_of_empty_tables(spark, empty, odd, tmp_path):
    assert corpus_pipeline.run(spark, empty).collect() == []
    os.symlink(f"{odd}/documents.parquet", tmp_path / "documents.parquet")
    os.symlink(f"{empty}/labels.parquet", tmp_path / "labels.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept <= {6, 12}


def test_near_duplicates_of_queries(spark):
    """Of copies changed in a share of their words, each id that is divisible by 20 finds all near texts, short ones too."""
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for n in [6, 12, 25, 60, 200] * 30:
        words = [f"v{x}" for x in rng.integers(0, 50_000, n)]
        for _ in range(3):
            changed = list(words)
            for place in rng.choice(n, max(1, n // 60), replace=False):
                changed[place] = f"v{rng.integers(0, 50_000)}"
            rows += [(at, " ".join(words)), (at + 1, " ".join(changed))]
            at += 2
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], TABLES["documents"])
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(df).select("doc_id").collect()}
    sets = {i: simhash.shingle_hashes(t, 5) for i, t in rows}
    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for v in s.tolist():
            holders[v].append(i)
    missed = found = 0
    for i in sets:
        if i % 20 == 0:
            near = {j for v in sets[i].tolist() for j in holders[v] if j != i and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))}
            found += len(near)
            missed += sum(i in kept and j in kept for j in near)
    assert found > 50 and missed <= 0.01 * found, (found, missed)
