"""A training-data pipeline over the documents: STAGES in order, and run().

In every stage null texts count as empty, null ids and repeated rows are rows
like any, further columns are kept as they are, and an empty table gives an
empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.arrow import tables
from tessera.llm.decontaminate import keep_clean
from tessera.llm.mixing import repeat_mixed
from tessera.llm.ngram_join import keep_one_of_each
from tessera.llm.quality import graded, keep_accepted
from tessera.llm.sharding import with_shards
from tessera.operators.components import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier accepts; all of them if there are no ratings."""
    return keep_accepted(docs, graded(tables(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard of word 5-grams of 0.8 or more: that of least id. Documents without words stay."""
    return keep_one_of_each(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; all of them if that is empty."""
    return keep_clean(docs, tables(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null is a source of its own."""
    return repeat_mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards, in new columns; rows without an id share one."""
    return with_shards(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Classifier, similarity join and alignment have no SQL form.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written to the shared folder and read again.

    The folder of the stage before is removed once a stage is written; the last
    one's stays, as the result reads it.
    """
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = tables(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
