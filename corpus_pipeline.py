"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the stage before it kept, read again from Parquet in the shared folder that
spark.checkpoint.dir names, so that a lost executor costs the tasks that it was running and no earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm import decontam, packing, pii, quality, simhash
from loomgrid.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the cascade."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id, or one without id where none has one."""
    return simhash.keep_one(docs, null_ids=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private data masked."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("private data", private_data), ("packing", best_fit_packing)]
#: SimHash and string tiling are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents. What an earlier stage wrote is removed as soon as the next has been written."""
    shared_folder(spark)
    context = spark.sparkContext
    jvm = context._jvm
    base = f"{context._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        out = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            path = jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        last = out
    return docs
