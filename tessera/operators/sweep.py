"""Quality of blocking for many k: stop words, important tokens, purity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import find_acronyms, sweep_tokens, vector_tokens, word_ngrams
from tessera.operators.blocking import BROADCAST_TEXT, gram_vectors, neighbours
from tessera.operators.components import checkpointed
from tessera.operators.tfidf import vocabulary

KS = (5, 10, 20, 30, 40, 50, 75, 100)


def sweep_vocabulary(records: DataFrame, min_df: int = 2, max_df: float = 0.99) -> DataFrame:
    """A record's terms are told apart where its text is, so texts are dealt out by id, and only counts of terms by term."""
    texts = records.groupBy("id1").agg(F.collect_list("affil1").alias("texts"))
    terms = F.array_distinct(F.flatten(F.transform("texts", lambda t: word_ngrams(vector_tokens(t)))))
    return vocabulary(texts.select(F.explode(terms).alias("term")), F.lit(records.count()), min_df, max_df)


def auto_stopwords(vocab: DataFrame, n: int, quantile: float = 0.20, share: float = 0.20) -> DataFrame:
    """(term): terms of low idf and terms in more than the share of records."""
    cut = vocab.agg(F.percentile("idf", quantile).alias("cut"))
    low = vocab.join(F.broadcast(cut)).filter(F.col("idf") <= F.col("cut")).select("term")
    return low.unionAll(vocab.filter(F.col("df") / n > share).select("term")).distinct()


def important_tokens(records: DataFrame, vocab: DataFrame, stop: DataFrame) -> DataFrame:
    """(id, term): a record's words in the vocabulary, without stop words, and its acronyms."""
    words = records.select(F.col("id1").alias("id"), F.explode(F.array_distinct(sweep_tokens(F.col("affil1")))).alias("term"))
    kept = words.join(vocab.select("term"), "term", "left_semi").join(stop, "term", "left_anti").select("id", "term")
    acronyms = records.select(F.col("id1").alias("id"), F.explode(find_acronyms(F.col("affil1"))).alias("term"))
    return kept.unionAll(acronyms).distinct()


def k_sweep(records: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(k, overlap_purity, jaccard_purity, avg_cosine, reduction_ratio) for each k below the number of records.

    The vocabulary is counted once, and its shuffles are released before the
    neighbours. These are ranked once, to the greatest k, and summed by rank; every
    k reads a prefix. Token sets of up to BROADCAST_TEXT bytes go to the pairs.
    """
    n = records.count()
    ks = tuple(k for k in ks if k < n)
    vocab = checkpointed(sweep_vocabulary(records))
    tokens = checkpointed(important_tokens(records, vocab, auto_stopwords(vocab, n)).groupBy("id").agg(F.collect_set(F.xxhash64("term")).alias("terms")))
    del vocab
    near = neighbours(gram_vectors(records, word_ngrams(vector_tokens(F.col("affil1"))), 0.99), max(ks))
    a, b = tokens.select(F.col("id").alias("src_id"), F.col("terms").alias("ta")), tokens.select(F.col("id").alias("cand_id"), F.col("terms").alias("tb"))
    if (tokens.agg(F.sum(8 * F.size("terms") + 40)).first()[0] or 0) <= BROADCAST_TEXT:
        a, b = F.broadcast(a), F.broadcast(b)
    none = F.array().cast("array<long>")
    joined = near.join(a, "src_id", "left").join(b, "cand_id", "left").withColumns({"ta": F.coalesce("ta", none), "tb": F.coalesce("tb", none)})
    counted = joined.withColumn("shared", F.size(F.array_intersect("ta", "tb"))).withColumn("union", F.size("ta") + F.size("tb") - F.col("shared"))
    judged = counted.select("rank", "cosine_sim", (F.col("shared") > 0).cast("int").alias("hit"), F.when(F.col("union") > 0, F.col("shared") / F.col("union")).otherwise(0.0).alias("jac"))
    ranks = judged.groupBy("rank").agg(F.sum("hit").alias("hit"), F.sum("jac").alias("jac"), F.sum("cosine_sim").alias("cosine_sim"))
    at = ranks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col("rank") <= F.col("k"))
    sums = at.groupBy("k").agg(F.sum("hit").alias("hits"), F.sum("jac").alias("jacs"), F.sum("cosine_sim").alias("sims"))
    cells = F.lit(float(n)) * F.col("k")  # whole numbers of 32 bits overflow from 46,342 records on
    return sums.select("k", (F.col("hits") / cells).alias("overlap_purity"), (F.col("jacs") / cells).alias("jaccard_purity"), (F.col("sims") / cells).alias("avg_cosine"), (1 - cells / F.lit(float(n) * (n - 1))).alias("reduction_ratio"))
