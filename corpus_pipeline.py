"""A training corpus from `documents`: language, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; all but the last return the columns of `docs`.  `run` writes each result to the shared
checkpoint folder as Parquet and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonde.llm import op1, op3, op5, op8, op10, queries
from sonde.llm.common import attach, stored, tune

LEAST_SCORE = 0.5   # a document whose likeliest language has a smaller share is rejected


ROW = F.xxhash64("doc_id", "text")   # what stages judge: a row by its id, null included, and its text


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` under the names of their rows instead of their ids, for operators that answer by doc_id."""
    return docs.withColumn("doc_id", ROW)


def without(docs: DataFrame, bad: DataFrame, row: Column = ROW, once: bool = False) -> DataFrame:
    """The rows of `docs` whose name is not in the stored `bad` (column row), one of each name if `once`."""
    name = "_".join(["row", *docs.columns])   # longer than any column's name
    left = attach(docs.withColumn(name, row), bad.withColumnRenamed("row", name), name, "left_anti")
    return (left.dropDuplicates([name]) if once else left).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects rows without a recognised language, each by its own text; null and repeated ids do not matter."""
    tune(spark)
    model = op1.fit(docs.where(queries.remainder(4) != 2))
    found = op1.identify(keyed(docs), model).where(f"lang_pred = 'und' or score < {LEAST_SCORE}")
    return without(docs, stored(found.select(F.col("doc_id").alias("row")).distinct(), "rejected"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked texts: the smallest doc_id, null ids last, then the smallest name.

    Texts that share an id are judged apart: they are dropped only for links of their own.  Rows equal in
    id and text are kept once.
    """
    groups = op8.join(keyed(tune(spark) and docs))
    ends = F.array(F.struct(F.col("doc_id").alias("row"), "component_id"), F.struct(F.col("component_id").alias("row"), "component_id"))
    group = stored(groups.where("doc_id <> component_id").select(F.inline(ends)).distinct(), "grouped")
    member = stored(attach(docs.select(ROW.alias("row"), "doc_id").distinct(), group, "row", "inner"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = stored(member.groupBy("component_id").agg(first.alias("first")).select("component_id", F.col("first.row").alias("kept")), "kept")
    dropped = attach(member, kept, "component_id", "inner").where("row <> kept").select("row")
    return without(docs, stored(dropped, "dropped"), once=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a window of a benchmark item; other texts of the same id stay."""
    tune(spark)
    found = op3.decontaminate(keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    return without(docs, stored(found.select(F.col("doc_id").alias("row")).distinct(), "contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples rows to the tempered weights of source, language and topic.

    Rows of one id (null ids count as one) share their draw, but each is held against its own cell.
    """
    cell = F.xxhash64("doc_id", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), op5.topic_of(F.col("text")))
    left = op5.mix(docs).where("not sampled").select(F.xxhash64("doc_id", *op5.AXES).alias("row")).distinct()
    return without(docs, stored(left, "unsampled"), cell)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns every remaining row its shard and slot; the shard follows from the id, null counting as one."""
    return op10.shard(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]
ORACLE_SQL = None   # language identification and signatures have no SQL form; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
