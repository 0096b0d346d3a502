"""Registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import (
    chat,
    decontamination,
    language,
    lattice,
    mixing,
    near_duplicates,
    oracles,
    periodic_runs,
    pii,
    repeated_text,
    toxicity,
    url_trust,
    vantage,
    whitening,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def op1_repeated_text(spark: SparkSession, folder: str) -> DataFrame:
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return repeated_text.without_repeats(_table(spark, folder, "documents")).select(
        "doc_id",
        "n_bytes",
        length.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    parts = chat.rendered(_table(spark, folder, "conversations"))
    spans = F.array_join(F.transform("mask", lambda x: F.concat_ws(":", x["start"], x["stop"])), ",")
    return parts.select("conv_id", "perspective", "band", "part", "n_turns", "text", spans.alias("mask"))


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    weights = mixing.quality(_table(spark, folder, "labels"))
    return mixing.plan(_table(spark, folder, "documents"), weights).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    spans = pii.all_spans(_table(spark, folder, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select(
        "doc_id",
        *(count(kind) for kind in pii.KINDS),
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
        pii.span_text(F.col("spans")).alias("spans"),
    )


def op6_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.linked_vectors(_table(spark, folder, "embeddings"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.fit(docs, usable=~held_out)
    return language.predict(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, _table(spark, folder, "labels"), usable=~held_out)
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op10_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    return url_trust.verdicts(_table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    # The exact deviation as a long; null where only the operator's decimal can hold it.
    deviation = F.expr("try_cast(deviation AS BIGINT)").alias("deviation")
    return whitening.whitened(_table(spark, folder, "embeddings")).select(
        "vec_id", "component", "n", deviation, "whitened", "explained", "identity_error"
    )


def with_periodic_tail(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where every tenth document by checksum repeats its words from some place on.

    Documents with a null id keep their text.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    altered = """
        transform(array(struct(cast(h div 10 AS BIGINT) AS g, cast(size(words) AS BIGINT) AS n)), z ->
        transform(array(struct(z.g % z.n AS a, 1 + (z.n - z.g % z.n) div (3 + z.g % 8) AS p)), y ->
        array_join(transform(words, (w, i) -> if(i < y.a, w, get(words, cast(y.a + (i - y.a) % y.p AS INT)))), ' '))[0])[0]
    """
    return chosen.select("doc_id", F.when(F.size("words") > 0, F.expr(altered)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periodic_tail(_table(spark, folder, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = F.col("top")
    return found.withColumn("top", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        top["length"].alias("length"),
        top["period"].alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return vantage.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {
        q.__name__: q
        for q in (
            op1_repeated_text,
            op2_perspectives,
            op3_mixing,
            op4_near_duplicates,
            op5_pii,
            op6_lattice,
            op7_language,
            op8_decontamination,
            op9_toxicity,
            op10_url_trust,
            op11_whitening,
            op12_periodic_runs,
            op13_nearest,
        )
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
