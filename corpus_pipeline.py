"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread as the next one's input.

Every stage works on the whole texts of what the stage before kept, and all but the last return the columns they were given.
Null texts count as empty: they are not toxic, duplicate nothing, hold no benchmark words and pack to the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm.common import free_name, fresh_folder, quoted, ship, table, written
from sitewright.llm.decontamination import contaminated, find_phrases
from sitewright.llm.neardup import DOCS_PER_FILE, near_duplicates
from sitewright.llm.packing import pack
from sitewright.llm.toxicity import score, train

TOXIC = 0.5  # score from which a document is rejected
SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of these documents that are not held out."""
    ship(spark)
    name = free_name(docs, "toxicity")
    return score(docs, train(docs, table(spark, sf_dir, "labels")), name=name).where(F.col(name) < TOXIC).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; of rows repeated with id and text, one."""
    ship(spark)
    found = near_duplicates(docs, size=SHINGLE, percent=PERCENT).where("doc_id is not null")
    files = 1 + docs.count() // DOCS_PER_FILE
    rows = found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    away = written(rows.where("not kept or n > 1"), "copies", files=files)  # fewer than those that stay, so the texts seldom have to move
    out = docs.join(away.select("doc_id"), "doc_id", "left_anti")
    more = away.where("kept").select("doc_id")
    if not more.isEmpty():
        out = out.union(docs.join(more, "doc_id", "left_semi").select(*out.columns).dropDuplicates(["doc_id", "text"]))
    return out.select(*map(quoted, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose share of words inside benchmark passages stays below the limit."""
    ship(spark)
    name = free_name(docs, "contamination")
    return find_phrases(docs, table(spark, sf_dir, "benchmark"), name=name).where(~contaminated(F.col(name))).drop(name)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; one row per piece."""
    ship(spark)
    return pack(docs, content="crc32", special=True).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: tokens and learned scores are beyond SQL; tests/llm holds the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
