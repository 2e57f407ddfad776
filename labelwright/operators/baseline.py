"""The trained baseline: stratified split, TF-IDF features and logistic regression."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwright.operators.taxonomy import vectors, vocabulary
from labelwright.plans.materialize import cut


def stratified_head(rows: DataFrame, stratum: str, id_col: str, n: int, seed: int = 7) -> DataFrame:
    """The first n rows of each stratum in a seeded order."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


#: Shares by digest that a stratum is ranked in.
SHARES = 4096


def stratified_split(rows: DataFrame, stratum: str, id_col: str, share: float = 0.5, seed: int = 7) -> DataFrame:
    """Adds `is_test`: of each stratum a share, in a seeded order, rounded down.

    The order is by digest, so a row's rank is its rank among the rows of its stratum whose digest begins alike and the
    number of rows before these; no task gets a whole stratum.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    part = F.coalesce(F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"), F.lit(-1))  # a null id comes first
    marked = rows.withColumns({"_digest": digest, "_part": part})
    parts = marked.groupBy(F.col(stratum).alias("_stratum"), F.col("_part").alias("_in")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("_stratum")
    facts = parts.select("_stratum", "_in", (F.sum("n").over(w.orderBy("_in")) - F.col("n")).alias("_before"), F.sum("n").over(w).alias("_all"))
    joined = marked.join(facts, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_part") == F.col("_in")))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_part").orderBy("_digest", id_col))
    return joined.withColumn("is_test", rank <= F.floor(F.col("_all") * share)).select(*rows.columns, "is_test")


def predict(rows: DataFrame, id_col: str, text_col: str, label_col: str, max_features: int = 5000, c: float = 1.0, seed: int = 7) -> DataFrame:
    """id, label, predicted of the test half; vocabulary and model come from the training half alone.

    Features are a sparse vector a document over at most `max_features` terms, which come to the driver and go to all tasks.
    """
    split = cut(stratified_split(rows.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")), "label", "id", 0.5, seed))
    known = vocabulary(split.where("NOT is_test"), "id", "text", max_features)
    width = max(1, len(known))
    sparse = F.udf(lambda at, weight: Vectors.sparse(width, at or [], weight or []), VectorUDT())
    entries = vectors(split, "id", "text", known, sublinear=True)
    data = cut(split.drop("text").join(entries, "id", "left").select("id", "label", "is_test", sparse("at", "weight").alias("features")))
    train = data.where("NOT is_test")
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(data)
    n = train.count()
    model = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", regParam=1 / (c * max(1, n)), standardization=False, maxIter=2000).fit(index.transform(train))
    names = F.array(*[F.lit(x) for x in index.labels])
    return model.transform(index.transform(data.where("is_test"))).select("id", "label", F.get(names, F.col("prediction").cast("int")).alias("predicted"))
