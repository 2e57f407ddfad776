"""Readers and writers of corpora, chunks, annotations, caches and baselines. Paths are opened by Spark alone."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelwright.functions.text import word_count
from labelwright.plans.contracts import missing_columns

CHUNK_JSON = "doc_id string, chunk_id string, chunk_index bigint, text string, ref_label string"
ANNOTATION_CSV = "pmid bigint, topic string, pred_label string, confidence double, parsed_ok int, prompt_tokens bigint, output_tokens bigint"
ABSTRACT_CSV = "pmid bigint, topic string, title string, abstract string, text string, n_chars int, n_words int"
RESPONSE = "struct<candidates: array<struct<content: struct<parts: array<struct<text: string>>>>>, usageMetadata: struct<promptTokenCount: bigint, candidatesTokenCount: bigint>>"
ATOM = "id string, title string, summary string, published string, updated string"
_CSV = {"header": True, "multiLine": True, "escape": '"'}


def _now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def filled(text: Column) -> Column:
    """Whether a text is neither null nor blank."""
    return F.coalesce(F.regexp_replace(text, r"(?U)\s+", "") != "", F.lit(False))


def abstracts_from(rows: DataFrame, retrieved_at: Column | None = None) -> DataFrame:
    """Rows with pmid, text and maybe topic, as raw abstracts; blank texts go, nulls stay null."""
    if lacking := missing_columns(rows, ["pmid", "text"]):
        raise ValueError(f"required columns are missing: {', '.join(lacking)}")
    topic = F.col("topic").cast("string") if "topic" in rows.columns else F.lit(None).cast("string")
    return rows.where(filled(F.col("text"))).select(
        F.concat(F.lit("pmid:"), F.col("pmid").cast("string")).alias("doc_id"),
        F.coalesce(topic, F.lit("")).alias("title"),
        F.col("text").cast("string").alias("text"),
        F.lit("csv").alias("source"),
        (retrieved_at if retrieved_at is not None else _now()).alias("retrieved_at"),
        topic.alias("ref_label"),
    )


def read_abstracts_csv(spark: SparkSession, path: str) -> DataFrame:
    return abstracts_from(spark.read.options(**_CSV).csv(path))


def read_study_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A study table by its schema; a value that isn't of its type is null."""
    return spark.read.schema(schema).options(**_CSV).csv(path)


def abstracts_from_atom(entries: DataFrame, retrieved_at: Column | None = None) -> DataFrame:
    """Entries of Atom feeds as raw abstracts, newest first; entries without an id or a summary go. The reference label is null."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", " "))
    ok = filled(F.col("id")) & filled(F.col("summary"))
    return (
        entries.where(ok)
        .orderBy(F.desc("published"), "id")
        .select(
            F.concat(F.lit("arxiv:"), F.element_at(F.split(F.trim("id"), "/"), -1)).alias("doc_id"),
            tidy("title").alias("title"),
            tidy("summary").alias("text"),
            F.lit("arxiv").alias("source"),
            (retrieved_at if retrieved_at is not None else _now()).alias("retrieved_at"),
            F.lit(None).cast("string").alias("ref_label"),
        )
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Saved feeds; fetching is the caller's."""
    return abstracts_from_atom(spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path))


def records_from_xml(pages: DataFrame, xml: str = "xml", min_chars: int = 300) -> DataFrame:
    """Article records of saved XML answers: pmid, title, abstract, text, n_chars, n_words. Records without one of the three, or with a short abstract, go."""
    each = pages.select(F.explode(F.split(F.col(xml), "(?=<PubmedArticle[ >])")).alias("x")).where(F.col("x").startswith("<PubmedArticle"))
    one = F.regexp_extract("x", r"(?s)(<PubmedArticle[ >].*</PubmedArticle>)", 1)
    ready = each.select(one.alias("x")).where("x <> ''")
    parts = ready.select(
        F.expr("xpath_string(x, '//PMID')").alias("pmid"), F.expr("xpath_string(x, '//ArticleTitle')").alias("title"), F.array_join(F.expr("xpath(x, '//AbstractText/text()')"), " ").alias("abstract")
    ).where((F.col("pmid") != "") & (F.col("title") != "") & (F.length("abstract") >= min_chars))
    text = F.concat("title", F.lit("\n"), "abstract")
    return parts.select(F.try_to_number("pmid", F.lit("999999999999")).cast("bigint").alias("pmid"), "title", "abstract", text.alias("text"), F.length(text).alias("n_chars"), word_count(text).alias("n_words"))


def search_ids(answer: str) -> list[str]:
    """The ids of a saved search answer, a small JSON document."""
    return [str(x) for x in json.loads(answer).get("esearchresult", {}).get("idlist", [])]


def read_chunks_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Chunks, one JSON document a line; blank lines give no rows."""
    return spark.read.schema(CHUNK_JSON).json(path).where("chunk_id IS NOT NULL")


def write_chunks_jsonl(chunks: DataFrame, path: str) -> None:
    chunks.select("doc_id", "chunk_id", "chunk_index", "text", "ref_label").write.mode("overwrite").json(path)


def write_not_empty(df: DataFrame, path: str) -> None:
    """Writes Parquet; nothing to write is an error."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    df.write.mode("overwrite").parquet(path)


def read_disagreements_csv(spark: SparkSession, path: str) -> DataFrame:
    """text, true_label, pred_label, confidence; a confidence that is no number is null."""
    rows = spark.read.options(**_CSV).csv(path)
    if lacking := missing_columns(rows, ["text", "true_label", "pred_label"]):
        raise ValueError(f"required columns are missing: {', '.join(lacking)}")
    confidence = F.col("confidence").try_cast("double") if "confidence" in rows.columns else F.lit(None).cast("double")
    return rows.select("text", "true_label", "pred_label", confidence.alias("confidence"), F.lit("user").alias("source"))


def read_baseline(spark: SparkSession, path: str, field: str = "distribution") -> DataFrame:
    """label, mass of a JSON map of labels, or of one under `field`; other fields of such a document are left aside."""
    text = spark.read.text(path, wholetext=True)
    inner = F.from_json(F.get_json_object("value", f"$.{field}"), "map<string,double>")
    bare = F.from_json("value", "map<string,double>")
    return text.select(F.explode(F.coalesce(inner, bare)).alias("label", "mass")).where("mass IS NOT NULL")


def latest_batch(spark: SparkSession, root: str) -> DataFrame:
    """The annotations of the batch that was made last by its manifest, wherever its name sorts. One batch id comes to the driver."""
    newest = spark.read.parquet(f"{root}/manifests").orderBy(F.desc("created_at"), F.desc("batch_id")).select("batch_id").first()
    if newest is None:
        raise ValueError("no batch")
    return spark.read.parquet(f"{root}/annotations").where(F.col("batch_id") == newest[0])


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Cached answers: key_sha256 and raw, the JSON text; from JSON files that are named by the digest, or from the table that `write_responses` makes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/table")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema("key_sha256 string, raw string").parquet(f"{path}/table").dropDuplicates(["key_sha256"])
    name = F.regexp_extract(F.input_file_name(), r"([0-9a-f]{64})[^/]*$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("key_sha256"), F.col("value").alias("raw"))


def load_prompt(text: str) -> str:
    """The template of a prompt file: what follows its first three dashes, or all of it."""
    head, found, rest = text.partition("---")
    return rest.strip() if found else head.strip()


def read_prompt(spark: SparkSession, root: str, version: str) -> tuple[str, str]:
    """The template of a prompt version, the file `<version>_classify.md` under `root`, and its SHA-256; a version that isn't there is an error that names those that are."""
    end = "_classify.md"
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    known = sorted(f.getPath().getName().removesuffix(end) for f in files.listStatus(where) if f.getPath().getName().endswith(end)) if files.exists(where) else []
    if version not in known:
        raise FileNotFoundError(f"no prompt {version}; there are: {', '.join(known) or 'none'}")
    template = load_prompt(spark.read.text(f"{root}/{version}{end}", wholetext=True).first()[0])
    return template, hashlib.sha256(template.encode()).hexdigest()


def write_responses(answers: DataFrame, path: str) -> None:
    """Appends answers (key, raw) to a cache table under the keys' SHA-256, before anything is parsed; answers that are null, as of failed calls, are left out."""
    made = answers.where("raw IS NOT NULL").select(F.sha2("key", 256).alias("key_sha256"), "raw").dropDuplicates(["key_sha256"])
    made.write.mode("append").parquet(f"{path}/table")


def render_prompt(template: str, labels: list[str], text: Column) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{labels}"), F.lit(f"[{', '.join(labels)}]")), F.lit("{text}"), text)


def parse_labels(text: str) -> list[str]:
    """Labels of a comma list, trimmed, without empty ones."""
    return [x.strip() for x in text.split(",") if x.strip()]


def append_annotations_csv(rows: DataFrame, path: str) -> None:
    """Appends annotations, each file with its header; `unfinished` gives the items that are still to be done."""
    names = [f.split()[0] for f in ANNOTATION_CSV.split(", ")]
    rows.select(*names).write.mode("append").options(header=True, escape='"').csv(path)


def write_abstracts_csv(rows: DataFrame, path: str) -> None:
    """The study's abstracts, one row a pmid: the least by topic, title and text."""
    names = [f.split()[0] for f in ABSTRACT_CSV.split(", ")]
    best = rows.groupBy("pmid").agg(F.min(F.struct(*names[1:])).alias("r")).select("pmid", "r.*")
    best.select(*names).write.mode("overwrite").options(header=True, escape='"').csv(path)


def fetch(get: Callable[[], bytes], retries: int = 3, wait: Callable[[float], None] = time.sleep) -> bytes:
    """What `get` gives, tried anew after 2, 4, 8, ... seconds when it raises OSError, as network errors are; after the last attempt a ConnectionError."""
    for attempt in range(retries + 1):
        try:
            return get()
        except OSError as e:
            last = e
            if attempt < retries:
                wait(2.0 * 2**attempt)
    raise ConnectionError(f"no answer in {retries + 1} attempts: {last}") from last
