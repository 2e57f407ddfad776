"""The operators on small inputs, against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labelwright.llm import chat, common, fingerprints, html_extract, html_pages, lattice_sampling, mixing, quality_classifier, quality_rules, simhash, token_counts, url_filters
from labelwright.llm.components import connected_components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 700}" for i in range(30_000))


def docs(spark, rows):
    """rows: (id, text) or (id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, LONG), (None, "no id here"), (7, "ünïcödé ▁ text <|endoftext|>")]


# Components ------------------------------------------------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, 200), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.fixture
def many_partitions(spark):
    """16 shuffle partitions that are not coalesced, so that small graphs are in many tasks too."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield 16
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_components_take_few_tasks(spark, many_partitions):
    """The driver keeps something of every task, so a graph of stars and short paths has to do with few rounds of short plans."""
    rng = random.Random(2)
    edges = [(10**9, i) for i in range(1, 2000)] + [(-5, -i) for i in range(6, 2000)] + [(x + j, x + j + 1) for x in range(10_000, 12_000, 10) for j in range(4)]
    edges += [(rng.randrange(2**40, 2**40 + 500), rng.randrange(2**40, 2**40 + 500)) for _ in range(200)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    context = spark.sparkContext
    context.setJobGroup("components", "components")
    try:
        got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(many_partitions)).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r["node"]: r["root"] for r in got} == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds]
    assert sum(s.numCompletedTasks for s in stages if s) <= 50 * many_partitions


# 1 ---------------------------------------------------------------------------------------------------------------------
def brute_targets(sizes, cap=3):
    """Shares by weight, the excess over cap times the size shared again, step by step."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {s: 0.0 for s in names}, set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = 0.0
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 5, None: 400}, {"a": 7}, {"b": 0, "c": 50, "d": 1}, {"é": 10, "z": 10, "A": 10}])
def test_mix_targets(spark, sizes):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())]
    got = mixing.source_targets(docs(spark, rows), mixing.word_count(F.col("text"))).collect()
    want = brute_targets(sizes)
    assert {r["_mix_source"]: pytest.approx(r["_mix_target"], abs=1e-6) for r in got} == want


def test_mix_repeats(spark):
    rows = [(i, "w " * 20, f"s{i % 3}") for i in range(300)] + [(1000, None, "s0"), (1001, "", None), (None, "w", "s0")]
    df = docs(spark, rows)
    targets = {r["_mix_source"]: r for r in mixing.source_targets(df, mixing.word_count(F.col("text"))).collect()}
    copies = {r["doc_id"]: r["_mix_copies"] for r in mixing.with_copies(df, mixing.source_targets(df, mixing.word_count(F.col("text")))).collect()}
    for i, _, s in rows:
        rate = targets[s]["_mix_rate"]
        u = int(hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        assert copies[i] == math.floor(rate) + (u < rate - math.floor(rate))
    mixed = collections.Counter(r["doc_id"] for r in mixing.mix(df).collect())
    assert mixed == {i: n for i, n in copies.items() if n}
    assert mixing.mix(df).columns == df.columns and mixing.mix(df.limit(0)).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------------
def test_fingerprints_estimate_likeness(spark):
    rng = np.random.default_rng(5)
    rows, truth = [], []
    for i in range(60):
        a = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(8, 300))]
        b = a[: int(len(a) * rng.random())] + [f"v{x}" for x in rng.integers(0, 5000, rng.integers(8, 100))]
        rows.append((i, " ".join(a), " ".join(b)))
        s, t = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (a, b))
        truth.append(len(s & t) / len(s | t))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = df.select("i", fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("x")).orderBy("i").collect()
    error = np.array([r["x"] for r in got]) - np.array(truth)
    assert np.abs(error).max() < 0.15 and abs(error.mean()) < 0.02


def test_fingerprints_of_odd_texts(spark):
    got = docs(spark, ODD).select("doc_id", "text", fingerprints.fingerprint(F.col("text")).alias("f")).collect()
    by = {r["text"]: r["f"] for r in got}
    assert by[None] == by[""] == by[" \n\t "] == "0" * 256 and len(set(by.values())) == 4 + 1
    assert all(len(f) == 256 and set(f) <= set("0123456789abcdef") for f in by.values())
    pairs = spark.createDataFrame([(by["one"], by["one"]), (by["one"], by[""]), (by[""], by[""]), (by["one"], by["no id here"])], "a string, b string")
    assert [r[0] for r in pairs.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()][:3] == [1.0, 0.0, 1.0]


@pytest.mark.parametrize("n", [0, 1, 2, 257])
def test_next_row(spark, n):
    rows = [((i * 37) % 1009, f"t{i}") for i in range(n)]
    got = {(r["doc_id"], r["text"]): r["_next"]["text"] for r in fingerprints.with_next(docs(spark, rows), "doc_id", ["text"]).collect()}
    order = sorted(rows)
    assert got == {r: order[(i + 1) % n][1] for i, r in enumerate(order)}


def test_next_row_with_ties_and_nulls(spark):
    rows = [(None, "n"), (1, "b"), (1, "a"), (2, "c"), (2, "c")]
    got = sorted((r["doc_id"] or 0, r["text"], r["_next"]["text"]) for r in fingerprints.with_next(docs(spark, rows), "doc_id", ["text"]).collect())
    assert got == [(0, "n", "a"), (1, "a", "b"), (1, "b", "c"), (2, "c", "c"), (2, "c", "n")]


# 3 ---------------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def words():
    return lattice_sampling.vocabulary(lattice_sampling.model_path(), 1.0)


def all_segmentations(text, words):
    """Every segmentation of a text with its log-probability."""

    def of(unit):
        if not unit:
            return [((), 0.0)]
        out = []
        for j in range(1, len(unit) + 1):
            if (p := words.ids.get(unit[:j])) is not None:
                out += [((p, *t), words.log_weights[p] + w) for t, w in of(unit[j:])]
        if unit[0] not in words.ids:
            spelt = tuple(words.byte_ids[b] for b in unit[0].encode())
            out += [(spelt + t, sum(words.log_weights[b] for b in spelt) + w) for t, w in of(unit[1:])]
        return out

    found = of("▁" + text.replace(" ", "▁")) if text else [((), 0.0)]
    total = math.log(sum(math.exp(w) for _, w in found))
    return {s: w - total for s, w in found}


@pytest.mark.parametrize("text", ["the cat,", "a\nb", "x", "", "née. it"])
def test_sampling_against_all_segmentations(words, text):
    want, n, k = all_segmentations(text, words), 4000, 3
    lat = lattice_sampling.Lattices(words)
    first, weight = collections.Counter(), collections.Counter()
    for found in lattice_sampling.encode_texts([text] * n, list(range(n)), lat, k):
        rows = collections.defaultdict(list)
        for s in found:
            key = tuple(s.ids.tolist())
            assert s.log_prob == pytest.approx(want[key], abs=1e-9)
            rows[s.row].append(key)
            first[key] += s.rank == 0
            weight[key] += math.exp(s.log_prob - s.log_inclusion) / n
        assert all(len(v) == len(set(v)) == min(k, len(want)) for v in rows.values())
    for key, log_prob in want.items():
        p = math.exp(log_prob)
        assert abs(first[key] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        if p > 0.01:
            assert weight[key] == pytest.approx(p, abs=0.02)


def test_sampling_of_odd_rows(spark, words):
    got = lattice_sampling.sample_segmentations(docs(spark, ODD)).collect()
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) and r["log_inclusion"] <= 0 and 0 <= r["inclusion"] <= 1 for r in got)
    empty = [r for r in got if r["doc_id"] in (1, 2)]
    assert [r["ids"] for r in empty] == [[], []]
    again = [tuple(r["ids"]) for r in got if r["doc_id"] == 5]
    assert len(again) == 4 and len(set(again)) == 2
    assert {r["doc_id"] for r in got} == {i for i, _ in ODD}
    assert lattice_sampling.sample_segmentations(docs(spark, ODD).limit(0)).count() == 0


def units_by_hand(text, words):
    """Words of a text by walking over its characters."""
    out, new, marked, last = [], True, False, ""
    for c in " " + text.replace("▁", " ") if text else "":
        control = ord(c) < 32 and words.controls[ord(c)]
        mark = ord(c) < 128 and words.marks[ord(c)]
        letter = last.isalnum() and not last.isdecimal()
        if new or control or (c == " " and last != " ") or (mark and not marked and letter):
            out.append("")
            marked = marked and not (new or control or c == " ")
        marked = marked or bool(mark)
        if c == " ":
            marked = False
        out[-1] += c
        new, last = control, c
    return out


def test_units_against_a_walk(words):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab9é² \n\t.,!▁_ßЖ中-") for _ in range(rng.randrange(0, 30))) for _ in range(400)]
    some = [" " + t.replace("▁", " ") for t in texts if t]
    blob = "".join(some).encode()
    sizes = [len(t.encode()) for t in some]
    starts = lattice_sampling.unit_starts(np.frombuffer(blob, np.uint8), np.cumsum([0, *sizes[:-1]]), words).tolist()
    got = [blob[a:b].decode() for a, b in zip(starts, [*starts[1:], len(blob)])]
    assert got == [u for t in texts for u in units_by_hand(t, words)]


def test_samples_do_not_depend_on_other_rows(words):
    rng = random.Random(9)
    pool = ["the", "cat,", "née.", "inversion", "x1!", "\n", "中文", "unbelievable"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(60)] + [None, LONG[:9000]]
    keys = list(range(len(texts)))
    view = lambda found, at: (found.rank[at].item(), tuple(found.ids[found.ends[at] : found.ends[at + 1]].tolist()), found.log_prob[at].item(), found.log_inclusion[at].item())
    whole = collections.defaultdict(list)
    for found in lattice_sampling.encode_texts(texts, keys, lattice_sampling.Lattices(words), 3):
        for at, row in enumerate(found.row.tolist()):
            whole[row].append(view(found, at))
    for row, text in enumerate(texts):
        (alone,) = lattice_sampling.encode_texts([text], [keys[row]], lattice_sampling.Lattices(words), 3)
        assert [view(alone, at) for at in range(len(alone.row))] == whole[row] and alone.round_trip.all()


def test_frequent_words_are_built_once(words, monkeypatch):
    rng = random.Random(10)
    often = ["cat", "née", "中文", "Ж☃b", "unbelievable", "x1!"]
    rare = ["".join(rng.choice("abcdeé中") for _ in range(8)) for _ in range(3000)]
    texts = [" ".join([*often, *rare[at : at + 10], *often]) for at in range(0, 3000, 10)]
    view = lambda got: [(f.row.tolist(), f.ids.tolist(), f.ends.tolist(), f.log_prob.tolist(), f.log_inclusion.tolist(), f.round_trip.all()) for f in got]
    monkeypatch.setattr(lattice_sampling, "CHUNK", 1000)
    want = view(lattice_sampling.encode_texts(texts, list(range(len(texts))), lattice_sampling.Lattices(words), 2))
    monkeypatch.setattr(lattice_sampling, "MEMO", 200)
    lat, built, most = lattice_sampling.Lattices(words), collections.Counter(), []
    add = lat.add
    monkeypatch.setattr(lat, "add", lambda units: (built.update(units), most.append(len(lat.first)), add(units)))
    assert view(lattice_sampling.encode_texts(texts, list(range(len(texts))), lat, 2)) == want
    assert all(built[f" {w}".encode()] == 1 for w in often[:-1]) and max(most) <= 200 and built.total() > 3000


# 4 ---------------------------------------------------------------------------------------------------------------------
URLS = ["http://A.Example.NET/en/1?x#y", "https://example.net/fr/2", "http://example.com/de/3", "http://m.example.com/den", "http://x.org/fr/a", "http://notexample.net?q", "net/en", None, "", "ftp://x.net", "http://h.y/a/b//c#d/e", "http://EXAMPLE.net/en/"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in url_filters.RULES:
        name, tail = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, None))


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    got = {r["page_id"]: r for r in url_filters.judge_urls(df).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or "allow")
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_path_templates(spark):
    rows = [("h", f"/post/{w}/x", None) for w in (f"title-{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))] + [("h", f"/spam/{i}", True) for i in range(30)] + [("h", "/about", False)] * 6
    got = {r["template"]: r for r in url_filters.path_templates(spark.createDataFrame(rows, "host string, path string, bad boolean")).collect()}
    assert got["/post/*/x"]["n_urls"] == 60 and not got["/post/*/x"]["rejected"]
    assert got["/spam/<n>"]["rejected"] and got["/spam/<n>"]["purity"] == pytest.approx(31 / 32)
    assert not got["/about"]["rejected"]


def brute_templates(rows):
    """Template, purity of each (host, masked path), one node after another."""
    import re

    leaves = collections.defaultdict(lambda: [0, 0, 0])
    for host, path, bad in rows:
        one = leaves[host, tuple(re.sub("[0-9]+", "<n>", path.removeprefix("/")).split("/"))]
        one[0], one[1], one[2] = one[0] + 1, one[1] + (bad is True), one[2] + (bad is False)
    purity = lambda b, g: (b + 1) / (b + g + 2)
    total = lambda some: [sum(leaves[x][i] for x in some) for i in range(3)]
    done, plains, work = {}, {}, [((), [x for x in leaves if x[0] == h]) for h in sorted({h for h, _ in leaves})]
    while work:
        template, inside = work.pop()
        d = len(template)
        for x in inside:
            if len(x[1]) <= d:
                done[x] = template
        live = [x for x in inside if len(x[1]) > d]
        if len(live) == 1:
            rest = live[0][1][d:]
            done[live[0]] = template + rest
            plains[live[0]] = plains.get(live[0], ()) + rest
            continue
        kids = collections.defaultdict(list)
        for x in live:
            kids[x[1][d]].append(x)
        n = total(live)[0]
        facts, tokens, pools = {}, {}, collections.defaultdict(list)
        for child, some in kids.items():
            kn, kb, kg = total(some)
            after = lambda x: "end" if len(x[1]) == d + 1 else "number" if "<n>" in x[1][d + 1] else "word"
            kind = max((leaves[x][0], after(x)) for x in some)[1]
            p = purity(kb, kg)
            label = "none" if kb + kg == 0 else "bad" if p >= url_filters.REJECT_AT else "good" if p <= 1 - url_filters.REJECT_AT else "mixed"
            variable = len(kids) >= url_filters.FAN_OUT and kn < url_filters.MIN_SHARE * n
            facts[child] = kb, kg, kind, label, variable
            if not variable:
                pools[kind, label].append(child)
        for child in kids:
            kb, kg, kind, label, variable = facts[child]
            token = child
            if variable:
                token = "*"
            else:
                pb, pg = (sum(facts[c][i] for c in pools[kind, label]) for i in (0, 1))
                if kb + kg >= 5 and pb + pg - kb - kg >= 5:
                    q = purity(pb, pg)
                    if abs(purity(kb, kg) - q) <= 1.96 * math.sqrt(q * (1 - q) * (1 / (kb + kg + 2) + 1 / (pb + pg + 2))):
                        token = "{" + kind + ":" + label + "}"
            tokens[child] = token, "*" if variable else child
        same = collections.defaultdict(list)
        for child, some in kids.items():
            token, one = tokens[child]
            same[token] += some
            for x in some:
                plains[x] = plains.get(x, ()) + (one,)
        work += [(template + (token,), some) for token, some in same.items()]

    def prior(x):
        for at in (lambda y: (y[0], plains[y]), lambda y: (plains[y][0], y[0])):
            parts = collections.defaultdict(list)
            for y in leaves:
                if at(y)[1] == at(x)[1] and at(y)[0] != at(x)[0]:
                    parts[at(y)[0]].append(y)
            shares = [b / (b + g) for _, b, g in map(total, parts.values()) if b + g]
            if shares:
                return (sum(shares) + 1) / (len(shares) + 2)
        return 0.5

    out = {}
    for x in leaves:
        _, b, g = total([y for y in leaves if y[0] == x[0] and done[y] == done[x]])
        out[x] = "/" + "/".join(done[x]), purity(b, g) if b + g else prior(x)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_path_templates_against_a_walk_over_nodes(spark, seed):
    rng = random.Random(seed)
    words = ["en", "de", "news", "tag", "x-1", "a.html", ""]
    rows = []
    for _ in range(900):
        host = rng.choice("pqrst")
        path = "/" + "/".join(rng.choice(words) if rng.random() < 0.75 else f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(1, 4)))
        bad = rng.choice([None, None, "de" in path, rng.random() < 0.2])
        rows.append((host, path, bad))
    want = brute_templates(rows)
    got = {(r["_host"], tuple(r["_segments"])): (r["template"], r["purity"]) for r in url_filters.path_templates(spark.createDataFrame(rows, "host string, path string, bad boolean")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [(k, got[k], v) for k, v in want.items() if abs(got[k][1] - v[1]) > 1e-8] == []




def test_templates_of_a_host_without_rules(spark):
    """A path that is bad on other hosts is rejected where nothing is labelled, one that is good there is not, and one bad branch doesn't condemn a host."""
    rows = [(f"h{h}", f"/{kind}/{i}", kind == "spam") for h in range(6) for kind in ("spam", "blog") for i in range(8)]
    rows += [("new", f"/{kind}/{i}", None) for kind in ("spam", "blog", "news") for i in range(5)]
    rows += [("half", f"/trash/{i}", True) for i in range(9)] + [("half", "/about/us", None)]
    rows += [("worse", f"/{kind}/{i}", True) for kind in ("a", "b", "c") for i in range(9)] + [("worse", "/about/me", None)]
    got = {(r["_host"], "/".join(r["_segments"])): r for r in url_filters.path_templates(spark.createDataFrame(rows, "host string, path string, bad boolean")).collect()}
    assert got["new", "spam/<n>"]["purity"] == pytest.approx(7 / 8) and got["new", "spam/<n>"]["rejected"]
    assert got["new", "blog/<n>"]["purity"] == pytest.approx(1 / 8) and not got["new", "blog/<n>"]["rejected"]
    assert got["new", "news/<n>"]["purity"] == pytest.approx(0.5) and not got["new", "news/<n>"]["rejected"]
    assert got["half", "about/us"]["purity"] == pytest.approx(2 / 3) and not got["half", "about/us"]["rejected"]
    assert got["worse", "about/me"]["rejected"]


def test_deep_path_templates(spark):
    """Labels that differ below the eighth segment, variable segments there, and one very deep path."""
    top = "/a/b/c/d/e/f/g/h"
    rows = [("h", f"{top}/spam/{i}/x", True) for i in range(20)] + [("h", f"{top}/blog/{i}", False) for i in range(20)]
    rows += [("h", f"{top}/item/title-{chr(97 + i)}/x", None) for i in range(26)] + [("h", "/deep" * 300, None)]
    got = {r["template"]: r for r in url_filters.path_templates(spark.createDataFrame(rows, "host string, path string, bad boolean")).collect()}
    assert {t: r["n_urls"] for t, r in got.items()} == {f"{top}/spam/<n>/x": 20, f"{top}/blog/<n>": 20, f"{top}/item/*/x": 26, "/deep" * 300: 1}
    assert [t for t, r in got.items() if r["rejected"]] == [f"{top}/spam/<n>/x"]
    page = spark.createDataFrame([(1, f"https://h.io{top}/blog/1")], "page_id bigint, url string")
    assert url_filters.judge_urls(page).first()["template"] == f"{top}/blog/<n>"


# 5 ---------------------------------------------------------------------------------------------------------------------
def test_chats_read_back(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|x|>", "<<|", "<\\\\|", "\n", "", None, "a<|im_end|>\nb", "%0A %25", "$1 \\1"]
    rows = [(i, t, role, text, "clash") for i, text in enumerate(nasty) for t, role in enumerate(("user", "assistant"))]
    rows += [(100, 1, "assistant", "late", ""), (100, 0, "we\nird<|", "x", ""), (100, None, None, "first", ""), (100, 1, "assistant", "late", ""), (None, 0, "user", "u", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    done = chat.format_chats(df)
    got = {r["conv_id"]: r for r in done.select("*", chat.read_turns(F.col("formatted")).alias("back")).collect()}
    want = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        want[c].append((t is not None, t or 0, role or "", text or ""))
    for c, turns in want.items():
        assert [(b["role"], b["text"]) for b in got[c]["back"]] == [x[2:] for x in sorted(turns)]
        assert "".join(s["text"] for s in got[c]["segments"]) == got[c]["formatted"]
        assert got[c]["n_turns"] == len(turns)
    assert got[0]["valid"] and not got[100]["valid"] and got[100]["bad_turn"] == 0
    assert [s["loss"] for s in got[0]["segments"]] == [False, False, False, False, True, False]
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("roles, bad", [(["user", "assistant"], None), (["system", "user"], None), (["assistant"], 0), (["user", "user"], 1), (["user", "assistant", "tool"], 3), (["system"], 1)])
def test_turn_order(spark, roles, bad):
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_chats(df).first()["bad_turn"] == bad


# 6 ---------------------------------------------------------------------------------------------------------------------
def brute_simhash(text, k=3):
    words = [w.decode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts(n, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = [f"w{x}" for x in rng.integers(0, 3000, rng.integers(5, 200))]
        for _ in range(rng.integers(1, 5)):
            w = list(base)
            for at in rng.integers(0, len(w), rng.integers(0, 3)):
                w[at] = f"q{rng.integers(0, 99)}"
            out.append(" ".join(w))
    return out


def components_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_simhash_components(spark):
    rows = [r for r in ODD if r[0] is not None] + [(100 + i, t) for i, t in enumerate(near_texts(60))]
    got = {(r["id"], r["fp"] % 2**64): r["component"] for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps = [brute_simhash(t) for _, t in rows]
    roots = components_of(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    assert got == {(rows[i][0], fps[i]): least[roots[i]] for i in range(len(rows))}
    assert simhash.near_duplicates(docs(spark, rows).limit(0)).count() == 0
    assert simhash.near_duplicates(docs(spark, ODD)).count() == len(ODD)


def test_large_buckets_are_split_exactly(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 25, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 25, dtype=np.uint64)) for s in seeds])).view(np.int64).tolist()
    keyed = spark.createDataFrame([(1, f, [f]) for f in fps], "key bigint, node bigint, fp array<bigint>")
    got = {r["node"]: r["root"] for r in connected_components(simhash.links(keyed, 2, tile=16)).collect()}
    roots = components_of(len(fps), lambda a, b: ((fps[a] ^ fps[b]) % 2**64).bit_count() <= 2)
    groups = collections.defaultdict(list)
    for f, r in zip(fps, roots):
        groups[r].append(f)
    assert got == {f: min(g) for g in groups.values() if len(g) > 1 for f in g}


@pytest.mark.parametrize("n, radius", [(10, 2), (10**6, 2), (10**9, 2), (3 * 10**10, 2)])
def test_bucket_choice(n, radius):
    parts = simhash.parts_for(n, radius)
    assert parts > radius and n / 2.0 ** (64 // parts * (parts - radius)) <= simhash.MEAN_BUCKET


def test_one_of_each_is_kept(spark):
    rows = [(i, t) for i, t in enumerate(near_texts(50, 9))] + [(900, None), (901, ""), (902, "same text"), (903, "same text"), (None, "no id")]
    got = [r["doc_id"] for r in simhash.keep_one_of_each(docs(spark, rows)).collect()]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    alike = lambda a, b: None not in (rows[a][0], rows[b][0]) and (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 if sets[a] | sets[b] else True)
    roots = components_of(len(rows), alike)
    assert sorted(x for x in got if x is not None) == sorted({rows[r][0] for r in roots} - {None}) and None in got
    assert simhash.keep_one_of_each(docs(spark, rows).limit(0)).count() == 0


def test_copies_with_repeated_lines_are_found(spark):
    rng = np.random.default_rng(21)
    rows = []
    for n, times in [(300, 6), (300, 8), (300, 10), (300, 10), (1000, 15), (1000, 15)]:
        words = [f"w{x}" for x in rng.integers(0, 5000, n)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:60] + words[40:60] * times + words[60:]))]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows]
    roots = components_of(len(rows), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    assert sorted(set(roots)) == list(range(0, len(rows), 2))
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs(spark, rows)).collect()) == sorted(set(roots))


def test_one_row_of_each_is_kept(spark):
    """Null ids, repeated rows and an id with two texts."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(1, a), (1, a), (None, a), (None, a + " more"), (None, b), (None, b), (2, c), (5, c + " more"), (5, d), (7, e), (7, e + " more"), (8, e)]
    got = collections.Counter((r["doc_id"], r["text"][0]) for r in simhash.keep_one_of_each(docs(spark, rows)).collect())
    assert got == {(1, "a"): 1, (None, "b"): 1, (2, "c"): 1, (5, "d"): 1, (7, "e"): 1}


# 7 ---------------------------------------------------------------------------------------------------------------------
def brute_counts(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().strip(quality_rules.SPACES)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


@pytest.mark.parametrize("text", ["", " \n ", "a b c a b c", "a a a a", "x\nx\n y\n\ny ", "é|ü <b> #1\x0b2 z", "one two three " * 40, LONG])
def test_counts(text):
    assert quality_rules.text_counts(text) == brute_counts(text)


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(1)
    for _ in range(40):
        field = quality_rules.LineField(tuple(rng.normal(size=quality_rules.N_FEATURES)), tuple(map(tuple, rng.normal(size=(2, 2)))))
        x = rng.normal(size=(rng.integers(1, 7), quality_rules.N_FEATURES))
        score = lambda y: sum((x[i] @ np.array(field.emit)) * y[i] for i in range(len(y))) + sum(field.move[a][b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=len(x)), key=score)
        assert score(field.decode(x)) == pytest.approx(score(best))


GOOD = "The committee met on Tuesday to talk about the budget for the coming year and agreed on most of its points."
BAD = "BUY!! NOW!! CHEAP!! | DEAL | $$$ %%% ### *** BUY!! NOW!!"


def corpus(spark, n=120):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        line = GOOD if i % 3 else BAD
        text = "\n".join(" ".join(rng.sample(line.split(), len(line.split()))) for _ in range(rng.randint(5, 9)))
        rows.append((i, text))
        labels.append((i, int(i % 3 > 0), 0))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality_rules(spark):
    df, labels = corpus(spark)
    field = quality_rules.trained_field(df, labels)
    got = quality_rules.judge(df, "doc_id", "text", field).join(labels, "doc_id").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in got if not r["base_failed"])
    odd = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(docs(spark, ODD), "doc_id", "text", field).collect()}
    assert not odd[1, 0]["kept"] and odd[1, 0]["base_failed"] and len(odd) == len(ODD) - 1
    kept = quality_rules.keep_good(df, field)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert quality_rules.judge(df.limit(0), "doc_id", "text", field).count() == 0
    assert quality_rules.trained_field(df, labels.where("quality = 1")) == quality_rules.ALL_CONTENT
    named = quality_rules.judge(df.withColumnRenamed("doc_id", "kept").withColumn("kept", F.col("kept").cast("string")), "kept", "text", field)
    assert named.count() == df.count() and named.columns.count("kept") == 1


def test_lines_of_mixed_documents_are_told_apart(spark):
    """Documents of known lines, in runs of content and boilerplate, that the field wasn't trained on."""
    df, labels = corpus(spark)
    field = quality_rules.trained_field(df, labels)
    rng = random.Random(11)
    right = total = partly = 0
    for _ in range(60):
        lines, want = [], []
        for _ in range(rng.randint(2, 4)):
            kind = rng.randrange(2)
            for _ in range(rng.randint(2, 5)):
                words = (GOOD if kind else BAD).split()
                lines.append(" ".join(rng.sample(words, len(words))))
                want.append(kind)
        lines.append("All rights reserved.")
        want.append(0)
        got = field.decode(quality_rules.line_features(lines))
        right, total = right + sum(a == b for a, b in zip(got, want)), total + len(want)
        share = quality_rules.content_share("\n".join(lines), field)
        partly += 0 < share < 1
    assert right >= 0.9 * total and partly > 30


def test_training_rows_do_not_depend_on_order_or_repeats(spark):
    df, labels = corpus(spark)
    strings = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    named = labels.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    twice = strings.unionByName(strings.withColumn("text", F.concat("text", F.lit(" zzz")))).unionByName(strings.limit(1).withColumn("doc_id", F.lit(None).cast("string")))
    for f in (quality_rules.trained_field, quality_classifier.train):
        assert f(twice.repartition(7), named.repartition(3)) == f(strings, named)


def test_a_filter_on_the_score_does_not_repeat_the_statistics(spark):
    df, labels = corpus(spark, 300)
    model = quality_classifier.train(df, labels)
    count = lambda x: x._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_extract_all(")
    whole = quality_classifier.scored(df, model)
    assert 0 < count(whole.where("score >= 0.3")) == count(whole)
    clash = df.selectExpr("*", "1 AS _c_words", "2 AS _s_twice", "3 AS _row", "4 AS _score", "5 AS `a.b`", "6 AS score")
    got = quality_classifier.scored(clash, model)
    assert got.columns == [c for c in clash.columns if c != "score"] + ["score"] and got.where("_c_words = 1 AND _row = 3 AND `a.b` = 5").count() == 300


# 8 ---------------------------------------------------------------------------------------------------------------------
def test_quality_classifier(spark):
    df, labels = corpus(spark, 300)
    train = labels.where(~quality_classifier.held_out(F.col("doc_id")))
    model = quality_classifier.train(df, train)
    assert 0 < len(model.rules) < 100
    clash = df.withColumn("score", F.lit("clash"))
    got = quality_classifier.scored(clash, model).join(labels, "doc_id").collect()
    assert all((r["score"] >= 0.5) == (r["quality"] == 1) for r in got)
    odd = quality_classifier.scored(docs(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    constant = quality_classifier.train(df, labels.where("quality = 1"))
    assert constant.rules == () and quality_classifier.scored(df, constant).select("score").distinct().count() == 1
    nothing = quality_classifier.train(df, labels.limit(0))
    assert quality_classifier.scored(df.limit(0), nothing).count() == 0
    import zlib

    held = {r["doc_id"]: r["h"] for r in df.select("doc_id", quality_classifier.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in held}


def test_compiled_rules_are_the_model(spark):
    rng = np.random.default_rng(2)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(int)
    model = quality_classifier.fit(x, y)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array([r[0] for r in df.select(model.score([F.col(c) for c in "abc"])).collect()])
    want = 1 / (1 + np.exp(-(model.bias + sum(w * quality_classifier._holds(r, x) for r, w in model.rules))))
    assert np.allclose(got, want) and ((got > 0.5) == y).mean() > 0.97


def test_counts_of_characters_in_long_texts_hold_no_array(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SHORT", 5, raising=False)
    texts = ["", "A", "AB cd 12! a a a", "x x  y y\ny", "ÀÉ [a](b) ~^ 9.9: ;?", "The the The The #\t# b", None]
    patterns = {"words": r"[^ \t-\r]+", "upper": "[A-Z]", "symbols": r"[#*$%&|<>]", "digits": "[0-9]", "ends": "[.?:;]", "marks": r"[@/_=+{}\[\]()\\~^]", "short": r"(?<![^ \t-\r])[^ \t-\r]{1,3}(?![^ \t-\r])", "twice": r"(?<![^ \t-\r])([^ \t-\r]+)[ \t-\r]+\1(?![^ \t-\r])"}
    df = docs(spark, list(enumerate(texts)))
    counted = df.select("doc_id", *[e.alias(n) for n, e in quality_classifier.statistics(F.col("text")).items()])
    for r in counted.collect():
        assert {n: r[f"_c_{n}"] for n in patterns} == {n: len(list(re.finditer(p, texts[r["doc_id"]] or ""))) for n, p in patterns.items()}
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") >= 5


# 9 ---------------------------------------------------------------------------------------------------------------------
def truth_of(page):
    """The marked text of a labelled page."""
    nodes = html_pages.parse(page)
    label, kept = [0] * len(nodes), []
    for i, node in enumerate(nodes):
        mark = node.attributes.get("data-main")
        label[i] = int(mark) if mark else (label[node.parent] if node.parent >= 0 else 0)
        kept += node.pieces if label[i] else []
    runs = collections.defaultdict(list)
    for _, run, text in sorted(kept):
        runs[run].append(text)
    return " ".join(x for r in sorted(runs) if (x := " ".join("".join(runs[r]).split())))


def test_extraction_of_pages_not_trained_on():
    pages = html_pages.labelled_pages(150, seed=77)
    got = html_extract.extract(pages, html_extract.default_potentials())
    assert np.mean([a == truth_of(p) for a, p in zip(got, pages)]) > 0.95


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    page = "<div><p>a</p><ul><li>b<li>c</ul></div><p>d"
    nodes = html_pages.parse(page)
    forest, _ = html_extract.forest_of([nodes], [html_extract.units_of(nodes)])
    unary, pair = rng.normal(size=html_extract.N_FEATURES), rng.normal(size=(2, 2))
    got = html_extract.marginals(forest, unary, pair)[0][:, 1]
    n = len(forest.parent)
    score = forest.features @ unary
    total, on = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(score[i] * y[i] for i in range(n)) + sum(pair[y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0))
        total += w
        on += w * np.array(y)
    assert np.allclose(got, on / total)


def test_html_oddities(spark):
    pages = [
        (1, "<article><h1>T&amp;t</h1><p>A&nbsp;<b>b</b>c  d<br>e</p><!-- x --><script>var a='<p>';</script><p>Second paragraph of the text, with a few more words. It goes on.</article>"),
        (2, None), (3, ""), (4, "<"), (5, "<p"), (6, "plain text"), (7, "<div " + "<b>" * 500), (8, "</p></div><td>x"),
    ]
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h in pages], "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()}
    assert got[1] == "T&t A bc d e Second paragraph of the text, with a few more words. It goes on."
    assert got[2] == got[3] == "" and len(got) == len(pages)
    assert html_extract.main_text(df.limit(0)).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, tmp_path, name):
    path = token_counts.tokenizer_path(name)
    df = docs(spark, ODD).select("doc_id", "text", F.lit("clash").alias("n_tokens"))
    cache = str(tmp_path / "cache")
    got = token_counts.count_tokens(df, path=path, cache=cache).collect()
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(p.encode(x))
    want = sorted((i or -1, len((x or "").encode()), count(x or ""), count(x or "") > 512) for i, x in ODD)
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({x or "" for _, x in ODD})
    assert sorted(map(str, token_counts.count_tokens(df, path=path, cache=cache).collect())) == sorted(map(str, got))
    assert spark.read.parquet(cache).count() == stored  # all were known
    assert token_counts.count_tokens(df.limit(0), path=path, cache=cache).count() == 0


# Common ------------------------------------------------------------------------------------------------------------------
def test_words_and_hash(spark):
    row = spark.createDataFrame([(" a\tb\x0bc d ", 5)], "t string, i bigint").select(common.words_of(F.col("t")).alias("w"), common.unit_hash(F.col("i"), "x:").alias("u")).first()
    assert row["w"] == ["a", "b", "c d"]
    assert row["u"] == int(hashlib.md5(b"x:5").hexdigest()[:13], 16) / 2**52


# More of 9 and 10 ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p class=it's>hello there my friend, this is it.</p></article>", "hello there my friend, this is it."),
        ('<article><p title="x>hello there, it is me.</p></article>', "hello there, it is me."),
        ("<body>Just some body words, as they come. More words.</body>", "Just some body words, as they come. More words."),
        ("Plain text without any markup. It has two sentences.", "Plain text without any markup. It has two sentences."),
        ("<a href=\"1>2\">link</a> and <b title='a>b'>bold</b> text.", "link and bold text."),
        ("1 < 2 and 3 > 2 <3", "1 < 2 and 3 > 2 <3"),
        ("<body><h1>T</h1><p>Some prose here, and there. More of it.</p><p>And more.</p></body>", "T Some prose here, and there. More of it. And more."),
        ("<nav><ul><li><a href=a>x y</a></li><li><a href=b>z</a></li></ul></nav>", ""),
        ("", ""),
    ],
)
def test_pages_without_an_article_and_with_odd_quotes(page, want):
    assert html_extract.extract([page], html_extract.default_potentials()) == [want]


def test_clashing_columns_of_pages_and_counts(spark):
    df = spark.createDataFrame([(1, "<article><p>One two three four, five.</p></article>", "h", "t")], "page_id bigint, html string, _html string, text string")
    assert html_extract.main_text(df).collect()[0].asDict() == {"page_id": 1, "_html": "h", "text": "One two three four, five."}
    df = spark.createDataFrame([(1, "one two", "d", "e", "f", 5)], "doc_id bigint, text string, digest string, _digest string, `a.b` string, n_tokens int")
    got = token_counts.count_tokens(df)
    assert got.columns == ["doc_id", "digest", "_digest", "a.b", "n_bytes", "n_tokens", "over_limit"]
    assert got.first()["digest"] == "d" and got.first()["n_tokens"] == 2 and token_counts.count_tokens(df.select("text")).first()["n_bytes"] == 7
