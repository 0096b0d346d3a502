"""A corpus from raw documents to a training mix, one stage after the other.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything the stage before it
kept. ``run`` writes every stage as Parquet in the shared folder and reads it again, so
a stage never recomputes the ones before it and a lost executor costs tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontamination, mixing, near_duplicates, pii, toxicity
from tallymark.session import stage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    return toxicity.score(named, model, keep=("row",)).where("score < 0.5").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: the first by doc_id, then text; null ids come last.

    Rows are told apart by numbers of their own, stored with them, so repeated and null ids count as rows.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = stage(docs.select(F.monotonically_increasing_id().alias("number"), row), "numbered_rows")
    groups = near_duplicates.near_duplicates(rows.select(F.col("number").alias("doc_id"), "row.text"))
    known = rows.select(
        "number", F.struct(F.col("row.doc_id").isNull().alias("unnamed"), "row.doc_id", F.xxhash64("row.text").alias("mark"), "number").alias("place")
    )
    first = (
        groups.select(F.col("doc_id").alias("number"), "component_id").join(known, "number")
        .groupBy("component_id").agg(F.min("place").alias("place")).select("place.number")
    )
    return rows.join(first, "number", "left_semi").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced; ``n_chars`` follows the new text."""
    clean = pii.sanitise(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return clean


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    weights = mixing.quality(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.plan(docs, weights).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixed_to_weights),
]

#: The classifier, the edit-distance search and the disclosure measure are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, function) in enumerate(STAGES, 1):
        docs = function(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = stage(docs, name)
    return docs
