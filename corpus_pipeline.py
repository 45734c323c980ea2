"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, mixing, packing.

``run`` applies the stages to ``documents``; what a stage returns is written to
the shared folder and read again as the next one's input. No SQL expresses a
fingerprint vote or a trained model, so ``ORACLE_SQL`` is None; the stages are
tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paystrata.llm import lines, mixing, packing, quality, simhash
from paystrata.llm.tokens import vocabulary_path
from paystrata.session import ship_package
from paystrata.sources.staging import staged

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the trees accept."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Of its different texts in the group the one with the smallest hash stays,
    once. Different texts of one doc_id in different groups are judged apart.
    Rows without a doc_id all stay.
    """
    rows = simhash.keyed_groups(docs).filter("doc_id is not null").groupBy("doc_id", "group", "component_id").agg(
        F.count("*").alias("rows"), F.min("text_key").alias("least"), F.collect_set("text_key").alias("keys"))
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("least"))
    touched = staged(rows.filter("doc_id <> component_id or rows > 1").withColumn("text_key", F.explode("keys")).select(
        F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text_key"), stays.alias("__stays")), "near-touched")
    keyed = docs.filter("doc_id is not null").withColumn("__key", F.xxhash64("text"))
    # Decisions grow with the documents, so they are never broadcast: each text is shuffled once, at any size.
    judged = keyed.join(touched.hint("merge"), (F.col("doc_id") == F.col("__doc")) & (F.col("__key") == F.col("__text_key")), "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy("__key"))
    kept = judged.withColumn("__nth", nth).filter("__stays is null or (__stays and __nth = 1)").select(*docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; every document stays."""
    return lines.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences.

    Workers have run the stages before and keep memory from them, so they
    remember fewer words than for packing alone.
    """
    return packing.pack(docs, vocabulary_path(), memo=250_000)


def _shipped(stage):
    """The stage, after the workers have got the package."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [(stage.__name__, _shipped(stage)) for stage in (quality_rules, near_dedup, substring_dedup, mix_sources, pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
