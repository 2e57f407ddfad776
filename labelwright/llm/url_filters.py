"""URL filters: explicit rules first, then a path-template tree per host. DataFrame functions only.

A rule names a host, which stands for all its subdomains too, and the start of a path; of the rules that fit a url the
longest decides. The method judges the rest. Urls are first reduced to distinct (host, masked path) with counts, where a
run of digits is masked as `<n>`; a host with a third of all urls is summed before it is shuffled. The tree then grows
level by level over this table:

1. At a node with at least FAN_OUT different children, a child with less than MIN_SHARE of the node's urls is a value of
   a variable segment and becomes the wildcard `*`.
2. Siblings left are merged if they are statistically alike: the same kind of continuation, the same class of label, at
   least MIN_LABELS labels in the sibling and in the others together, and a smoothed share of bad labels within 1.96
   standard errors of that of all of them. Each is compared with their sum, so no pairs of siblings are made. Siblings
   without labels stay apart.

A template's purity is its smoothed share of bad labels, (bad + 1) / (bad + good + 2); at REJECT_AT or more it is rejected.
Where a template has no labels, its paths' purity is a prior. That of a path comes from the same path, with its wildcards
but not its merges, on other hosts: (bad hosts + 1) / (hosts + 2), where each host with labels for it counts once, by its
share of bad labels. Where no other host has labels for it, the host's other branches at the root, unmerged, count likewise, and
where these have none either the prior is 0.5, and such a path is let through. Labels are those given; in the query they are the verdicts of the rules on
the urls that they decide.

Cases: a null url, or one without `://`, has an empty host and an empty path and forms templates like any other; repeated
urls count as often as they occur; the tree grows to the last segment of the deepest path, and a path that is alone at its
node takes its remaining segments at once, as none of them can be split or merged; an empty table gives an empty result.
Columns of the input with the names of columns that `judge_urls` adds are replaced; all others are kept, whatever their
names.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.llm.common import cut, join_counted
from labelwright.session import table

FAN_OUT = 8
MIN_SHARE = 0.05
REJECT_AT = 0.8
Z = 1.96
#: Labels that a branch needs to be compared with others.
MIN_LABELS = 5
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def decide(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """A struct of the longest rule that fits and its verdict, or null."""
    fits = []
    for rule, verdict in rules:
        name, slash, tail = rule.partition("/")
        fit = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def masked_segments(path: Column) -> Column:
    return F.split(F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"[0-9]+", "<n>"), "/")


def _purity(bad: Column, good: Column) -> Column:
    return (bad + 1) / (bad + good + 2)


def path_templates(urls: DataFrame, host: str = "host", path: str = "path", bad: str = "bad") -> DataFrame:
    """One row per host and masked path: `_host`, `_segments`, its `template`, the template's `n_urls`, `n_bad`, `n_good`, and the path's `prior`, `purity`, `rejected`.

    `bad` is a boolean label, null where there is none.
    """
    none = F.array().cast("array<string>")
    tree = (
        urls.groupBy(F.col(host).alias("_host"), masked_segments(F.col(path)).alias("_segments"))
        .agg(F.count("*").alias("n"), F.count_if(F.col(bad)).alias("b"), F.count_if(~F.col(bad)).alias("g"))
        .withColumns({"_template": none, "_plain": none})
    )
    unfinished = F.coalesce(F.size("_segments"), F.lit(0)) > F.size("_template")
    tree = cut(tree)
    done, live, d = [tree.where(~unfinished)], tree.where(unfinished), 0
    while not live.isEmpty():
        grown = cut(_grow(live, d))
        done.append(grown.where(~unfinished))
        live, d = grown.where(unfinished), d + 1
    tree = functools.reduce(DataFrame.unionByName, done)
    tree = cut(_with_prior(functools.reduce(DataFrame.unionByName, done)))
    found = tree.groupBy("_host", "_template").agg(F.sum("n").alias("n_urls"), F.sum("b").alias("n_bad"), F.sum("g").alias("n_good"))
    joined = tree.join(found, ["_host", "_template"]).withColumn("purity", F.when(F.col("n_bad") + F.col("n_good") > 0, _purity(F.col("n_bad"), F.col("n_good"))).otherwise(F.col("prior")))
    template = F.concat(F.lit("/"), F.array_join("_template", "/"))
    return joined.select("_host", "_segments", template.alias("template"), "n_urls", "n_bad", "n_good", "prior", "purity", (F.col("purity") >= REJECT_AT).alias("rejected"))


def _with_prior(tree: DataFrame) -> DataFrame:
    """`tree` with `prior`. Labels are summed by (host, path) and (host, first token) before anything is joined; paths and hosts that are hot are joined where they are."""
    tree = cut(tree.withColumns({"_branch": F.coalesce(F.get("_plain", F.lit(0)), F.lit("")), "_path": F.array_join("_plain", "/")}))
    total = tree.count()
    share = F.try_divide(F.sum("b").cast("double"), (F.sum("b") + F.sum("g")).cast("double"))
    for key, part, name in (("_path", "_host", "path"), ("_host", "_branch", "branch")):
        parts = tree.groupBy(key, part).agg(share.alias("own"), F.count("*").alias("rows"))
        sums = parts.groupBy(key).agg(F.sum("rows").alias("n"), F.coalesce(F.sum("own"), F.lit(0.0)).alias("bad"), F.count("own").alias("labelled"))
        # Of each path and host (or host and branch): what all others say.
        others = join_counted(parts.select(key, part, "own"), sums, key, total).select(
            F.col(key).alias("_k"),
            F.col(part).alias("_p"),
            (F.col("labelled") - F.col("own").isNotNull().cast("int")).alias(f"{name}_labelled"),
            (F.col("bad") - F.coalesce("own", F.lit(0.0))).alias(f"{name}_bad"),
        )
        tree = tree.join(others, (tree[key] == others["_k"]) & (tree[part] == others["_p"])).drop("_k", "_p")
    seen = lambda name: (F.round(f"{name}_bad", 9) + 1) / (F.col(f"{name}_labelled") + 2)
    prior = F.when(F.col("path_labelled") > 0, seen("path")).otherwise(seen("branch"))
    return tree.select("_host", "_segments", "n", "b", "g", "_template", prior.alias("prior"))


def _grow(tree: DataFrame, d: int) -> DataFrame:
    """The tree, of paths with a level d, with the token of level d added to each template; with all that follow where a path is alone at its node."""
    live = tree.withColumn("child", F.get("_segments", F.lit(d)))
    after = F.get("_segments", F.lit(d + 1))
    kind = F.when(after.isNull(), F.lit("end")).when(after.contains("<n>"), F.lit("number")).otherwise(F.lit("word"))
    kids = live.groupBy("_host", "_template", "child").agg(F.sum("n").alias("kn"), F.sum("b").alias("kb"), F.sum("g").alias("kg"), F.max(F.struct("n", kind.alias("k")))["k"].alias("kind"), F.count("*").alias("paths"))
    p = _purity(F.col("kb"), F.col("kg"))
    label = F.when(F.col("kb") + F.col("kg") == 0, F.lit("none")).when(p >= REJECT_AT, F.lit("bad")).when(p <= 1 - REJECT_AT, F.lit("good")).otherwise(F.lit("mixed"))
    kids = kids.withColumn("label", label)
    nodes = kids.groupBy("_host", "_template").agg(F.count("*").alias("fan"), F.sum("kn").alias("total"), (F.sum("paths") == 1).alias("alone"))
    kids = kids.join(nodes, ["_host", "_template"]).withColumn("variable", (F.col("fan") >= FAN_OUT) & (F.col("kn") < MIN_SHARE * F.col("total")))
    pooled = (
        kids.where(~F.col("variable"))
        .groupBy("_host", "_template", "kind", "label")
        .agg(F.sum("kb").alias("pb"), F.sum("kg").alias("pg"))
    )
    kids = kids.join(pooled, ["_host", "_template", "kind", "label"], "left")
    q = _purity(F.col("pb"), F.col("pg"))
    error = F.sqrt(q * (1 - q) * (1 / (F.col("kb") + F.col("kg") + 2) + 1 / (F.col("pb") + F.col("pg") + 2)))
    labels = F.col("kb") + F.col("kg")
    enough = (labels >= MIN_LABELS) & (F.col("pb") + F.col("pg") - labels >= MIN_LABELS)
    alike = enough & (F.abs(p - q) <= Z * error)
    token = F.when(F.col("variable"), F.lit("*")).when(alike, F.concat(F.lit("{"), "kind", F.lit(":"), "label", F.lit("}"))).otherwise(F.col("child"))
    plain = F.when(F.col("variable"), F.lit("*")).otherwise(F.col("child"))
    tokens = kids.select("_host", "_template", "child", "alone", token.alias("token"), plain.alias("plain"))
    named = live.join(tokens, ["_host", "_template", "child"])
    rest = F.slice("_segments", F.lit(d + 1), F.size("_segments"))
    grown = [F.concat(all_, F.when(F.col("alone"), rest).otherwise(F.array(one))).alias(all_) for all_, one in (("_template", "token"), ("_plain", "plain"))]
    return named.select("_host", "_segments", "n", "b", "g", *grown)


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """`pages` with `host`, `path`, `rule`, `verdict`, `template` and `purity`; the last two are of the url's template."""
    own = ["host", "path", "rule", "verdict", "template", "purity"]
    kept = [F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c not in own]
    named = pages.select(F.struct("*").alias("_row"), host_of(F.col(f"`{url}`")).alias("_h"), path_of(F.col(f"`{url}`")).alias("_p"))
    parsed = named.withColumns({"_rule": decide(F.col("_h"), F.col("_p"), rules), "_s": masked_segments(F.col("_p"))})
    labelled = parsed.select(F.col("_h").alias("host"), F.col("_p").alias("path"), (F.col("_rule.verdict") == "block").alias("bad"))
    found = path_templates(labelled).select("_host", "_segments", "template", "purity", "rejected")
    joined = parsed.join(found, (F.col("_h") == F.col("_host")) & (F.col("_s") == F.col("_segments")), "left")
    by_method = F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        *kept, F.col("_h").alias("host"), F.col("_p").alias("path"), F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_method).alias("verdict"), "template", "purity"
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
