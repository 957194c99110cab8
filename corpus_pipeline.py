"""Training-corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
the documents table; the last returns packed pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate, packing, secret_scan, simhash, toxicity
from cohortloom.llm.shipping import ship
from cohortloom.llm.tokens import word_vocabulary
from cohortloom.session import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the classifier learns from the labelled ones among them."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    return toxicity.score(docs, model, name="_toxic").where(F.col("_toxic") < TOXIC).drop("_toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id; of repeated rows of that id, one.

    Documents without id are never dropped. Only ids of groups with more than one row are matched with the rows."""
    ship(spark)
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    later = durable(found.where("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(later, "doc_id", "left_anti").select(*docs.columns)
    repeated = durable(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(again.dropDuplicates(["doc_id"]))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that they share with benchmark items."""
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cut = decontaminate.find_contamination(docs, benchmark, remove=True)
    n = F.when(F.size("hit_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with marks in place of secrets, live-looking ones told from copied examples."""
    redacted = secret_scan.redact(docs)
    return redacted.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    ship(spark)
    return packing.pack(docs, word_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
#: Hashing, the classifier and the tokenizer have no SQL form; the tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet below the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
