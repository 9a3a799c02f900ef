"""TF-IDF vectors as long tables (id, term, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_counts(records: DataFrame, terms: Column, id_col: str = "id1") -> DataFrame:
    """(id, term, tf)."""
    return records.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    """Smoothed: as if one more document held every term."""
    return F.log((1 + n) / (1 + df)) + 1


def vocabulary(counts: DataFrame, n: Column, min_df: int = 2, max_df: float = 0.9) -> DataFrame:
    """(term, df, idf) of the terms in at least min_df documents and at most the share max_df of them. n: number of documents."""
    kept = document_frequency(counts).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return kept.withColumn("idf", idf(F.col("df"), n))


def weighted(counts: DataFrame, vocab: DataFrame, sublinear: bool = True, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, term, w) of the vocabulary's terms: frequency times idf, of any length. keep: columns instead of id."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    return counts.join(vocab.select("term", "idf"), "term").select(*keep, "term", (tf * F.col("idf")).alias("w"))


def unit(vectors: DataFrame) -> DataFrame:
    """The vectors (id, term, w) at length 1 over each id."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return vectors.select("id", "term", (F.col("w") / norm).alias("w"))


def unit_vectors(counts: DataFrame, vocab: DataFrame, sublinear: bool = True) -> DataFrame:
    """(id, term, w) of length 1 over each id; ids without a term of the vocabulary are absent."""
    return unit(weighted(counts, vocab, sublinear))


def tfidf(records: DataFrame, terms: Column, min_df: int = 2, max_df: float = 0.9, sublinear: bool = True, id_col: str = "id1") -> DataFrame:
    """Unit TF-IDF vectors of records. The number of records is a one-row scalar, counted in the plan."""
    counts = term_counts(records, terms, id_col)
    n = F.lit(records.count())
    return unit_vectors(counts, vocabulary(counts, n, min_df, max_df), sublinear)
