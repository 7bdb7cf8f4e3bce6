"""A training corpus from `documents`: toxic documents go, one document of each near-duplicate group stays, benchmark passages go, sources are mixed, tokens are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, mixing, near_dup, token_files, toxicity
from barloom.llm.text import free_name
from barloom.session import fresh_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text scores below the threshold. The model learns from labels of these documents. Null and empty texts, and all rows where labels lack a class,
    stay; repeated rows and very long texts are judged like others; all columns pass, whatever their names; no rows give none."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the least id; every document without words stays. Of rows that repeat a kept id, one stays if their texts have words."""
    return near_dup.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item. Null and empty texts stay, repeated rows are judged each, long texts whole; all columns pass; no rows or no items are allowed."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by the tempered weight of their source, shuffled; the columns of `documents`, also those named like the operator's own. A null source is
    one more source; rows that repeat an id draw alike; texts are not looked at; no rows give none."""
    inner = {}
    for c in docs.columns:
        inner[c] = free_name([*docs.columns, *inner.values(), *mixing.OWN], c) if c.lower() in mixing.OWN else c
    return mixing.mixed(docs.withColumnsRenamed(inner)).select(*[F.col(a).alias(c) for c, a in inner.items()])


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as token files; a row for each document copy as read back from them. A null or empty text has its end id alone, repeated rows are written each, long
    texts whole; no rows give none."""
    path = fresh_dir(spark, "tokens")
    token_files.write_tokens(docs, path, token_files.tokenizer_path())
    return token_files.digests(spark, path)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("token_files", write_tokens)]
ORACLE_SQL = None                      # trained scores and MinHash groups have no SQL; tests/llm/test_pipeline.py holds the rows against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each stored and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
