"""Gold labels of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import unordered


def gold_keys(gold: DataFrame) -> DataFrame:
    """(lo, hi): each gold pair (src, cand) once, whichever way it is given."""
    return gold.select(*unordered("src", "cand")).distinct()


def label_pairs(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds label 1 where the pair is gold in either direction, else 0."""
    marked = pairs.withColumns({"lo": F.least("src_id", "cand_id"), "hi": F.greatest("src_id", "cand_id")})
    return marked.join(gold_keys(gold).withColumn("_gold", F.lit(1)), ["lo", "hi"], "left").withColumn("label", F.coalesce("_gold", F.lit(0))).drop("lo", "hi", "_gold")


def matching(pairs: DataFrame, gold: DataFrame, how: str = "left_semi") -> DataFrame:
    """The pairs in (left_semi) or not in (left_anti) the gold mapping."""
    keys = gold_keys(gold)
    return pairs.join(keys, (F.least("src_id", "cand_id") == keys["lo"]) & (F.greatest("src_id", "cand_id") == keys["hi"]), how)


def label_report(labeled: DataFrame) -> DataFrame:
    return labeled.agg(F.count("*").alias("n_pairs"), F.sum("label").cast("long").alias("n_positive"))
