"""Similarity features of record pairs (src_id, cand_id, src_text, cand_text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import kernels
from tessera.functions.text import char_ngrams, jaccard, normalize_text, strip_accents, tokenize_words, vector_tokens, word_ngrams
from tessera.operators.components import checkpointed
from tessera.operators.tfidf import idf

FEATURES = ("edit_ratio", "jaro_winkler", "lcs_ratio", "token_jaccard", "token_cosine", "tfidf_word_cosine", "tfidf_char_cosine", "dmetaphone_match")


def normalized_pairs(pairs: DataFrame) -> DataFrame:
    """Adds src_norm and cand_norm; null texts are empty."""
    return pairs.withColumns({s: normalize_text(F.coalesce(F.col(t).cast("string"), F.lit(""))) for s, t in (("src_norm", "src_text"), ("cand_norm", "cand_text"))})


def token_features(pairs: DataFrame) -> DataFrame:
    """Adds token_jaccard and token_cosine to normalised pairs."""
    a, b = tokenize_words(F.col("src_norm")), tokenize_words(F.col("cand_norm"))
    return pairs.withColumns({"token_jaccard": jaccard(a, b), "token_cosine": kernels.token_cosine("src_norm", "cand_norm")})


def string_features(pairs: DataFrame) -> DataFrame:
    """Adds lcs_ratio, edit_ratio, jaro_winkler and dmetaphone_match to normalised pairs. All four are symmetric."""
    la, lb = F.length("src_norm"), F.length("cand_norm")
    first = lambda c: F.element_at(F.split(c, " "), 1)
    coded = pairs.withColumns({"_lcs": kernels.lcs_len("src_norm", "cand_norm"), "jaro_winkler": kernels.jaro_winkler("src_norm", "cand_norm"), "_ma": kernels.metaphone_code(first("src_norm")), "_mb": kernels.metaphone_code(first("cand_norm"))})
    none = (la == 0) & (lb == 0)
    out = coded.withColumns(
        {
            "lcs_ratio": F.when(none, 1.0).otherwise(F.col("_lcs") / F.greatest(la, lb)),
            "edit_ratio": F.when(none, 1.0).otherwise(2 * F.col("_lcs") / (la + lb)),
            "dmetaphone_match": F.when((la == 0) | (lb == 0), 0.0).otherwise((F.col("_ma") == F.col("_mb")).cast("double")),
        }
    )
    return out.drop("_lcs", "_ma", "_mb")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length; an addition, not one of the eight features."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _key(c: str) -> Column:
    """A short name of a text, for joins."""
    return F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")))


def tfidf_cosine(pairs: DataFrame, terms, sublinear: bool, name: str) -> DataFrame:
    """(src_key, cand_key, name) of the distinct text pairs: TF-IDF cosine, fitted on both sides of all pairs; the keys are md5 of the texts.

    A text counts as often as it stands in a pair, but is split, counted and
    weighed only once, and joined by its key. The pairs are read several times:
    hand over a table or a checkpoint.
    """
    sides = pairs.select(F.col("src_text").alias("t")).unionAll(pairs.select(F.col("cand_text"))).select(F.coalesce("t", F.lit("")).alias("t"))
    texts = sides.groupBy(F.md5("t").alias("key")).agg(F.first("t").alias("t"), F.count("*").alias("mult"))
    counts = texts.select("key", "mult", F.explode(terms(F.col("t"))).alias("term")).groupBy("key", "mult", "term").agg(F.count("*").alias("tf"))
    counts = checkpointed(counts)
    n = F.lit(2 * pairs.count())
    weights = counts.groupBy("term").agg(F.sum("mult").alias("df")).select("term", idf(F.col("df"), n).alias("idf"))
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    vectors = checkpointed(counts.join(weights, "term").select("key", "term", (tf * F.col("idf")).alias("x")))
    norms = vectors.groupBy("key").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    asked = pairs.select(_key("src_text").alias("src_key"), _key("cand_text").alias("cand_key")).distinct()
    a = vectors.select(F.col("key").alias("src_key"), "term", F.col("x").alias("xa"))
    b = vectors.select(F.col("key").alias("cand_key"), "term", F.col("x").alias("xb"))
    dots = asked.join(a, "src_key").join(b, ["cand_key", "term"]).groupBy("src_key", "cand_key").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    na = norms.select(F.col("key").alias("src_key"), F.col("norm").alias("na"))
    nb = norms.select(F.col("key").alias("cand_key"), F.col("norm").alias("nb"))
    full = asked.join(dots, ["src_key", "cand_key"], "left").join(na, "src_key", "left").join(nb, "cand_key", "left")
    return full.select("src_key", "cand_key", F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0)).alias(name))


def with_cosine(pairs: DataFrame, cosines: DataFrame) -> DataFrame:
    """pairs with the cosine of their texts."""
    keyed = pairs.withColumns({"src_key": _key("src_text"), "cand_key": _key("cand_text")})
    return keyed.join(cosines, ["src_key", "cand_key"]).drop("src_key", "cand_key")


def word_terms(c: Column) -> Column:
    return word_ngrams(vector_tokens(c))


def tfidf_word(pairs: DataFrame) -> DataFrame:
    return tfidf_cosine(pairs, word_terms, True, "tfidf_word_cosine")


def tfidf_char(pairs: DataFrame) -> DataFrame:
    return tfidf_cosine(pairs, char_ngrams, False, "tfidf_char_cosine")


def feature_table(pairs: DataFrame, keep_original_cols: bool = True) -> DataFrame:
    """The pairs with all eight features, or the features alone, in the pairs' own rows. The pairs are written once."""
    filled = checkpointed(pairs.withColumns({t: F.coalesce(F.col(t).cast("string"), F.lit("")) for t in ("src_text", "cand_text")}))
    local = string_features(token_features(normalized_pairs(filled))).drop("src_norm", "cand_norm")
    out = with_cosine(with_cosine(local, tfidf_word(filled)), tfidf_char(filled))
    return out.select(*(pairs.columns if keep_original_cols else ()), *FEATURES)


__all__ = ["FEATURES", "feature_table", "levenshtein_ratio", "strip_accents", "string_features", "tfidf_char", "tfidf_word", "token_features", "with_cosine"]
