"""From documents to training shards: quality, near duplicates, benchmark passages, mixture, shards.

Every stage is a function of (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns they were given. ``run`` writes each result as Parquet in the shared folder and reads it again, so
a lost executor costs no more than the stage it was in.

Null and empty texts pass the stages that judge text (they score as the classifier's bias, have no shingles and no
words) and have size 0 in the mixture, where their hash alone decides. An empty table gives empty tables throughout.
Rows that repeat are near duplicates of each other: one stays. Further columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almenara.llm import decontamination, jaccard, mixing, quality, queries, sharding
from almenara.llm.columns import small
from almenara.session import pin, scratch

#: Keys of documents to leave out are broadcast up to this number, else joined by shuffle.
BROADCAST_KEYS = 200_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones outside the held-out third, does not reject."""
    weights = quality.fit(docs, queries.marks(spark, sf_dir, "quality"))
    return quality.score(docs, weights, name="_quality").filter("_quality >= 0.5").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more hang together, the one with the smallest id; of rows that repeat, one.

    Rows are told apart by id and text: an id that stands on two texts is judged by each of them. A null id comes
    last; if no row has an id, or several have the smallest, the smallest hash of a text decides.
    """
    marks = {"_x": F.xxhash64("text"), "_y": F.xxhash64(F.lit(7919), "text")}
    row = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    found = pin(jaccard.join(docs.withColumns(marks).select(row.alias("row"), "text"), "row"))
    gone = found.filter("row <> class_id").select(F.col("row.id").alias("_id"), F.col("row.x").alias("_gx"), F.col("row.y").alias("_gy")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_x") == F.col("_gx")) & (F.col("_y") == F.col("_gy"))
    kept = docs.withColumns(marks).join(small(gone, gone.count(), BROADCAST_KEYS), same, "left_anti").drop(*marks)
    again = found.groupBy("row").count().filter("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark windows."""
    return decontamination.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none to three times."""
    taken = mixing.mix(docs).filter("copies > 0")
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_pass")).drop("_pass")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document that is left; repeats of a document have slots of their own."""
    return sharding.placed(docs).withColumn("law", F.lit("key"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixture),
    ("sharding", shards),
]

#: SQL cannot state a trained classifier; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
