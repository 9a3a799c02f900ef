"""Every query of the engine with its oracle in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import blocking, evaluation, features, graph, labeling, matcher, ner, sweep, tfidf
from tessera.operators.components import checkpointed, shared_folder
from tessera.plans import oracles as O
from tessera.sources import records as R
from tessera.sources.records import as_records, mentions, profile, table, turns

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its oracle."""

    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n, t in df.dtypes if t == "double"})


def joined(c) -> F.Column:
    return F.array_join(c, " ")


# --- records and text functions


@query(O.with_m("SELECT count(*) AS n_rows, CAST(2 AS BIGINT) AS n_cols, CAST(sum(CASE WHEN trim(affil1) = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_blank, min(affil1) AS first_text FROM m"))
def mentions_profile(spark, sf_dir):
    return profile(mentions(spark, sf_dir))


@query("SELECT p_partkey AS id1, p_name AS affil1 FROM part")
def records_from_part(spark, sf_dir):
    return as_records(table(spark, sf_dir, "part"), "p_name", "p_partkey")


@query(
    "SELECT c.c_custkey AS id1, c.c_name || ', ' || n.n_name || ', ' || r.r_name AS affil1 FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"
)
def structured_records(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    at = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return at.select(F.col("c_custkey").alias("id1"), F.concat(F.col("c_name"), F.lit(", "), F.col("n_name"), F.lit(", "), F.col("r_name")).alias("affil1"))


@query(O.with_m(f"SELECT id1, {O.norm('affil1')} AS norm FROM m"))
def normalize_text(spark, sf_dir):
    return mentions(spark, sf_dir).select("id1", T.normalize_text(F.col("affil1")).alias("norm"))


@query(f"SELECT doc_id AS id1, {O.norm('text')} AS norm FROM documents")
def normalize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id1"), T.normalize_text(F.col("text")).alias("norm"))


@query(O.with_m(f"SELECT id1, array_to_string({O.words('affil1')}, ' ') AS tokens, CAST(len({O.words('affil1')}) AS INTEGER) AS n_tokens FROM m"))
def tokenize_words(spark, sf_dir):
    t = T.tokenize_words(T.normalize_text(F.col("affil1")))
    return mentions(spark, sf_dir).select("id1", joined(t).alias("tokens"), F.size(t).alias("n_tokens"))


@query(O.with_m(f"SELECT id1, array_to_string(list_sort({O.acronyms('affil1')}), ' ') AS acronyms FROM m"))
def acronyms(spark, sf_dir):
    return mentions(spark, sf_dir).select("id1", joined(F.array_sort(T.find_acronyms(F.col("affil1")))).alias("acronyms"))


@query(O.with_m(f"SELECT id1, array_to_string({O.sweep('affil1')}, ' ') AS tokens FROM m"))
def sweep_tokens(spark, sf_dir):
    return mentions(spark, sf_dir).select("id1", joined(T.sweep_tokens(F.col("affil1"))).alias("tokens"))


@query(O.with_turns(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT id1, unnest({O.grams('affil1')}) AS term FROM m) GROUP BY term"))
def word_ngrams_df(spark, sf_dir):
    return tfidf.document_frequency(tfidf.term_counts(turns(spark, sf_dir), features.word_terms(F.col("affil1"))))


@query(O.with_turns(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT id1, unnest({O.char_grams('affil1')}) AS term FROM m) GROUP BY term"))
def char_ngrams_df(spark, sf_dir):
    return tfidf.document_frequency(tfidf.term_counts(turns(spark, sf_dir), T.char_ngrams(F.col("affil1"))))


@query(O.vectors("SELECT term, df, round(idf, 6) AS idf FROM v"))
def tfidf_vocab(spark, sf_dir):
    m = turns(spark, sf_dir)
    return rounded(tfidf.vocabulary(tfidf.term_counts(m, features.word_terms(F.col("affil1"))), F.lit(m.count())))


# --- neighbours and blocks


@query(O.knn(20, "SELECT src_id, cand_id, cosine_sim, CAST(rank AS INTEGER) AS rank FROM k"))
def knn_tfidf_top20(spark, sf_dir):
    return blocking.knn(turns(spark, sf_dir), 20)


@query(O.knn(20, "SELECT src_id, cand_id, cosine_sim, CAST(rank AS INTEGER) AS rank FROM u"))
def knn_undirected(spark, sf_dir):
    return blocking.collapse(blocking.knn(turns(spark, sf_dir), 20), 20)


@query(O.knn(20, "SELECT src_id, cand_id, cosine_sim, CAST(rank AS INTEGER) AS rank FROM k WHERE cosine_sim >= 0.5"))
def knn_min_sim(spark, sf_dir):
    return blocking.knn(turns(spark, sf_dir), 20, min_sim=0.5)


@query(O.knn(20, "SELECT src_id, cand_id, cosine_sim, CAST(rank AS INTEGER) AS rank, s.affil1 AS src_text, c.affil1 AS cand_text FROM k LEFT JOIN m s ON s.id1 = src_id LEFT JOIN m c ON c.id1 = cand_id"))
def knn_enriched(spark, sf_dir):
    m = turns(spark, sf_dir)
    return blocking.enrich(blocking.knn(m, 20), m).select("src_id", "cand_id", "cosine_sim", "rank", "src_text", "cand_text")


@query()
def knn_whole_top20(spark, sf_dir):
    return blocking.knn(mentions(spark, sf_dir), 20)


@query()
def knn_prefix_top20(spark, sf_dir):
    """The approximate backend: every neighbour with a cosine of 0.05 or more."""
    return blocking.knn(turns(spark, sf_dir), 20, backend="prefix")


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
d AS (SELECT a.vec_id AS src_id, b.vec_id AS cand_id, round(list_dot_product(a.v, b.v), 6) AS cosine_sim FROM u a JOIN u b ON a.vec_id <> b.vec_id)
SELECT src_id, cand_id, cosine_sim, CAST(row_number() OVER (PARTITION BY src_id ORDER BY cosine_sim DESC, cand_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10"""
)
def knn_embeddings_exact(spark, sf_dir):
    return blocking.knn_dense(table(spark, sf_dir, "embeddings"), 10)


@query()
def knn_embeddings_lsh(spark, sf_dir):
    return blocking.knn_lsh(table(spark, sf_dir, "embeddings"), 10)


def _blocks(spark, sf_dir):
    m = turns(spark, sf_dir)
    return blocking.token_blocks(m, T.tokenize_words(T.normalize_text(F.col("affil1"))))


@query(O.blocks("SELECT block_key, id FROM b"))
def token_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(O.blocks("SELECT id_left, id_right, n_shared FROM p"))
def block_pairs(spark, sf_dir):
    return blocking.block_pairs(_blocks(spark, sf_dir))


@query(O.blocks("SELECT id_left, id_right, n_shared FROM p WHERE n_shared >= 2"))
def block_pairs_overlap2(spark, sf_dir):
    return blocking.block_pairs(_blocks(spark, sf_dir), 2)


def _whole_blocks(spark, sf_dir):
    """Blocks of whole texts with the operator's own bounds."""
    m = mentions(spark, sf_dir)
    return blocking.token_blocks(m, T.tokenize_words(T.normalize_text(F.col("affil1"))))


@query()
def token_blocks_whole(spark, sf_dir):
    return _whole_blocks(spark, sf_dir)


@query()
def block_pairs_whole(spark, sf_dir):
    return blocking.block_pairs(_whole_blocks(spark, sf_dir))


@query()
def block_pairs_overlap2_whole(spark, sf_dir):
    return blocking.block_pairs(_whole_blocks(spark, sf_dir), 2)


# --- pair features


def _pairs(spark, sf_dir, k: int = 20):
    """The k nearest turns of each turn, with both texts. The ids are written once; the texts are joined where they are read, as each would be written k times."""
    m = turns(spark, sf_dir)
    return blocking.enrich(checkpointed(blocking.knn(m, k).drop("rank")), m)


_KEY = ["src_id", "cand_id"]


@query(O.pairs(f"SELECT src_id, cand_id, round({O.jaccard('a', 'b')}, 6) AS token_jaccard FROM tokens"))
def feat_token_jaccard(spark, sf_dir):
    return rounded(features.token_features(features.normalized_pairs(_pairs(spark, sf_dir))).select(*_KEY, "token_jaccard"))


@query(O.pairs(f"SELECT src_id, cand_id, round({O.token_cosine('a', 'b')}, 6) AS token_cosine FROM tokens"))
def feat_token_cosine(spark, sf_dir):
    return rounded(features.token_features(features.normalized_pairs(_pairs(spark, sf_dir))).select(*_KEY, "token_cosine"))


@query(O.pair_tfidf(O.grams("t"), "1 + ln(tf)", "tfidf_word_cosine"))
def feat_tfidf_word(spark, sf_dir):
    m = turns(spark, sf_dir)
    p = checkpointed(blocking.knn(m, 20).select(*_KEY))
    return rounded(blocking.pair_cosines(p, m, features.word_terms(F.col("affil1")), "tfidf_word_cosine"))


@query(O.pair_tfidf(O.char_grams("t"), "tf", "tfidf_char_cosine"))
def feat_tfidf_char(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return rounded(features.with_cosine(p, features.tfidf_char(p)).select(*_KEY, "tfidf_char_cosine"))


@query()
def feat_lcs_edit(spark, sf_dir):
    p = features.normalized_pairs(_pairs(spark, sf_dir))
    return rounded(features.string_features(p).select(*_KEY, "lcs_ratio", "edit_ratio"))


@query(O.pairs("SELECT src_id, cand_id, round(CASE WHEN na = '' OR nb = '' THEN 0.0 ELSE jaro_winkler_similarity(na, nb) END, 6) AS jaro_winkler FROM normed"))
def feat_jaro_winkler(spark, sf_dir):
    return rounded(features.string_features(features.normalized_pairs(_pairs(spark, sf_dir))).select(*_KEY, "jaro_winkler"))


@query(O.pairs("SELECT src_id, cand_id, round(CASE WHEN greatest(len(na), len(nb)) = 0 THEN 1.0 ELSE 1 - CAST(levenshtein(na, nb) AS DOUBLE) / greatest(len(na), len(nb)) END, 6) AS levenshtein_ratio FROM normed"))
def feat_levenshtein(spark, sf_dir):
    p = features.normalized_pairs(_pairs(spark, sf_dir))
    return rounded(p.select(*_KEY, features.levenshtein_ratio(F.col("src_norm"), F.col("cand_norm")).alias("levenshtein_ratio")))


@query()
def feat_metaphone(spark, sf_dir):
    return features.string_features(features.normalized_pairs(_pairs(spark, sf_dir))).select(*_KEY, "dmetaphone_match")


@query()
def feature_table(spark, sf_dir):
    return rounded(features.feature_table(_pairs(spark, sf_dir)))


# --- labels, folds, evaluation


def _gold(spark, sf_dir):
    """Pairs of turns of one conversation: a mapping that the texts don't tell. A conversation's turns bound its pairs."""
    t = turns(spark, sf_dir).select("id1", F.floor(F.col("id1") / 10_000).alias("conv"))
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, (F.col("a.conv") == F.col("b.conv")) & (F.col("a.id1") < F.col("b.id1"))).select(F.col("a.id1").alias("src"), F.col("b.id1").alias("cand"))


def _copies(spark, sf_dir, pairs: DataFrame) -> DataFrame:
    """Adds label 1 where the token sets of the two whole documents have a Jaccard of 0.7 or more, else 0. Judged for the pairs asked, so groups of any size cost no further pairs; two texts without tokens are no copies."""
    tokens = F.array_distinct(T.tokenize_words(T.normalize_text(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    sets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tokens.alias("set"))
    src = sets.select(F.col("id").alias("src_id"), F.col("set").alias("_a"))
    cand = sets.select(F.col("id").alias("cand_id"), F.col("set").alias("_b"))
    both = pairs.join(src, "src_id", "left").join(cand, "cand_id", "left")
    alike = (F.size("_a") > 0) & (F.size(F.array_intersect("_a", "_b")) * 10 >= F.size(F.array_union("_a", "_b")) * 7)
    return both.withColumn("label", F.coalesce(alike, F.lit(False)).cast("int")).drop("_a", "_b")


def _near(spark, sf_dir, min_sim: float | None = None):
    return blocking.knn(turns(spark, sf_dir), 20, min_sim)


def _scored(spark, sf_dir):
    """Labelled pairs with a score that needs no model: the cosine to three digits. For one reading."""
    p = _near(spark, sf_dir).select("src_id", "cand_id", F.round("cosine_sim", 3).alias("score"))
    return labeling.label_pairs(p, _gold(spark, sf_dir))


def _labeled(spark, sf_dir):
    """The same, written once for several readings."""
    return checkpointed(_scored(spark, sf_dir))


@query(O.labeled("SELECT src, cand FROM gold"))
def gold_pairs(spark, sf_dir):
    return _gold(spark, sf_dir)


@query(O.labeled("SELECT src_id, cand_id, score, label FROM l"))
def label_pairs(spark, sf_dir):
    return _labeled(spark, sf_dir).select("src_id", "cand_id", "score", "label")


@query()
def label_pairs_whole(spark, sf_dir):
    p = blocking.knn(mentions(spark, sf_dir), 5).select("src_id", "cand_id", F.round("cosine_sim", 3).alias("score"))
    return _copies(spark, sf_dir, p).select("src_id", "cand_id", "score", "label")


@query(O.labeled("SELECT src_id, cand_id FROM l WHERE label = 1"))
def label_positives_semi(spark, sf_dir):
    return labeling.matching(_near(spark, sf_dir).select("src_id", "cand_id"), _gold(spark, sf_dir))


@query(O.labeled("SELECT src_id, cand_id FROM l WHERE label = 0"))
def label_negatives_anti(spark, sf_dir):
    return labeling.matching(_near(spark, sf_dir).select("src_id", "cand_id"), _gold(spark, sf_dir), "left_anti")


@query(O.labeled("SELECT count(*) AS n_pairs, CAST(sum(label) AS BIGINT) AS n_positive FROM l"))
def label_report(spark, sf_dir):
    return labeling.label_report(_labeled(spark, sf_dir))


@query(O.labeled("SELECT label, count(*) AS n, round((SELECT count(*) FROM l) / (2.0 * count(*)), 6) AS weight FROM l GROUP BY label"))
def class_weights(spark, sf_dir):
    return rounded(evaluation.class_weights(_labeled(spark, sf_dir)))


@query(O.labeled("SELECT src_id, cand_id, round((score - (SELECT avg(score) FROM l)) / (SELECT stddev_pop(score) FROM l), 6) AS score FROM l"))
def scaled_features(spark, sf_dir):
    rows = _labeled(spark, sf_dir).select("src_id", "cand_id", "score")
    return rounded(evaluation.scaled(rows, evaluation.scaler(rows, ("score",))))


@query(O.labeled("SELECT src_id, cand_id, label, fold FROM f"))
def stratified_folds(spark, sf_dir):
    return evaluation.stratified_folds(_labeled(spark, sf_dir)).select("src_id", "cand_id", "label", "fold")


@query(O.labeled("SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pc"))
def pr_curve(spark, sf_dir):
    return rounded(evaluation.pr_curve(_scored(spark, sf_dir)).select("threshold", "tp", "fp", "precision", "recall"))


@query(O.labeled("""SELECT round((sum(CASE WHEN label = 1 THEN r END) - p * (p + 1) / 2.0) / (p * q), 6) AS roc_auc
FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, sum(label) OVER () AS p, sum(1 - label) OVER () AS q FROM l) GROUP BY p, q"""))
def roc_auc(spark, sf_dir):
    return rounded(evaluation.roc_auc(evaluation.pr_curve(_scored(spark, sf_dir))))


@query(O.labeled("SELECT round(sum((recall - before) * precision), 6) AS average_precision FROM (SELECT *, coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0) AS before FROM pc)"))
def average_precision(spark, sf_dir):
    return rounded(evaluation.average_precision(evaluation.pr_curve(_scored(spark, sf_dir))))


@query(O.labeled("SELECT threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM f1 ORDER BY round(f1, 9) DESC, threshold LIMIT 1"))
def f1_threshold(spark, sf_dir):
    return rounded(evaluation.best_threshold(_scored(spark, sf_dir)))


@query(O.labeled("SELECT threshold, round(g, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM (SELECT *, coalesce(lead(f1) OVER (ORDER BY threshold), 0) AS g FROM f1) ORDER BY round(g, 9) DESC, threshold LIMIT 1"))
def f1_threshold_shifted(spark, sf_dir):
    return rounded(evaluation.best_threshold(_scored(spark, sf_dir), align="shifted"))


@query(O.labeled(O.FOLD_REPORT))
def fold_report(spark, sf_dir):
    return rounded(evaluation.fold_report(evaluation.stratified_folds(_labeled(spark, sf_dir))).select("fold", "n", "positive_rate", "roc_auc", "pr_auc", "threshold", "f1", "precision", "recall"))


def _train(spark, sf_dir, kind: str, **options):
    """All eight features of the pairs; label 1 for turns of one conversation."""
    pairs = features.feature_table(_pairs(spark, sf_dir)).select("src_id", "cand_id", *features.FEATURES)
    labeled = checkpointed(labeling.label_pairs(pairs, _gold(spark, sf_dir)).select("src_id", "cand_id", *features.FEATURES, "label"))
    return matcher.train_matcher(labeled, features.FEATURES, kind, **options)


def _predictions(spark, sf_dir, kind: str, **options):
    trained = _train(spark, sf_dir, kind, **options)
    return trained.predict(trained.oof.drop("score", "fold")).select("src_id", "cand_id", "prob_match", "pred_match")


@query()
def matcher_logreg(spark, sf_dir):
    return _predictions(spark, sf_dir, "logreg")


@query()
def matcher_rf(spark, sf_dir):
    return _predictions(spark, sf_dir, "rf")


@query()
def matcher_gbt(spark, sf_dir):
    return _predictions(spark, sf_dir, "xgb")


@query()
def oof_predictions(spark, sf_dir):
    return _train(spark, sf_dir, "logreg").oof.select("src_id", "cand_id", "label", "fold", "score")


# --- graph


#: Cosine from which two turns are an edge: no two of them are copies.
_EDGE = 0.2


def _edges(spark, sf_dir):
    predicted = _near(spark, sf_dir, _EDGE).select("src_id", "cand_id", F.col("cosine_sim").alias("prob_match"))
    return checkpointed(graph.match_graph(predicted, _EDGE))


@query(O.graph("SELECT u, v, weight FROM e"))
def match_graph(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(O.graph("SELECT id, degree FROM g"))
def vertex_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query(O.graph("SELECT id, component FROM cc"))
def connected_components(spark, sf_dir):
    return graph.components(_edges(spark, sf_dir))


@query(O.graph("SELECT id1 AS id, coalesce(component, id1) AS component FROM m LEFT JOIN cc ON id = id1"))
def components_with_singletons(spark, sf_dir):
    return graph.components(_edges(spark, sf_dir), turns(spark, sf_dir).select(F.col("id1").alias("id")))


@query()
def communities_louvain(spark, sf_dir):
    return graph.communities(_edges(spark, sf_dir))


@query(O.graph(O.SAMPLE))
def graph_sample(spark, sf_dir):
    return graph.sample_nodes(_edges(spark, sf_dir), 50, 20)


@query(O.graph(f"SELECT u, v, weight FROM e WHERE u IN (SELECT id FROM ({O.SAMPLE})) AND v IN (SELECT id FROM ({O.SAMPLE}))"))
def graph_sample_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.induced(e, graph.sample_nodes(e, 50, 20))


@query(O.graph("SELECT g.id AS id, degree, round(200 * (1 + ln(1 + degree)), 6) AS size, CAST(dense_rank() OVER (ORDER BY component) - 1 AS INTEGER) AS color FROM g JOIN cc ON g.id = cc.id"))
def draw_attributes(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return rounded(graph.draw_nodes(e, graph.communities(e, use_louvain=False)))


@query(O.graph("SELECT u, v, weight, round(0.5 + 3 * (weight - lo) / (hi - lo + 1e-9), 6) AS width FROM e, (SELECT min(weight) AS lo, max(weight) AS hi FROM e)"))
def draw_edge_widths(spark, sf_dir):
    return rounded(graph.draw_edges(_edges(spark, sf_dir)))


# --- sweep over k


@query(O.sweep_sql("SELECT term FROM stop"))
def stopwords_auto(spark, sf_dir):
    m = turns(spark, sf_dir)
    return sweep.auto_stopwords(sweep.sweep_vocabulary(m), m.count())


@query(O.sweep_sql("SELECT id, term FROM imp"))
def important_tokens(spark, sf_dir):
    m = turns(spark, sf_dir)
    vocab = sweep.sweep_vocabulary(m)
    return sweep.important_tokens(m, vocab, sweep.auto_stopwords(vocab, m.count()))


@query(O.sweep_sql(O.K_SWEEP))
def k_sweep(spark, sf_dir):
    return rounded(sweep.k_sweep(turns(spark, sf_dir)))


# --- entities


def _extracted(spark, sf_dir, config=None):
    return ner.extract_entities(mentions(spark, sf_dir), config=config)


@query()
def ner_rule_entities(spark, sf_dir):
    return _extracted(spark, sf_dir).select("id1", F.explode("entities").alias("e")).select("id1", "e.text", "e.label", "e.start", "e.end")


@query()
def ner_backoff(spark, sf_dir):
    return _extracted(spark, sf_dir, ner.NerConfig(backoff="acronyms")).select("id1", "total_entities", "error")


@query(O.TOKENS_LABELED)
def tokens_labeled(spark, sf_dir):
    return _acronym_entities(spark, sf_dir).select("id1", ner.tokens_labeled(F.col("entities")).alias("affil_tokens_labeled"), F.col("total_entities").cast("int").alias("total_entities"))


@query(O.TOKENS_PLAIN)
def tokens_plain(spark, sf_dir):
    return _acronym_entities(spark, sf_dir).select("id1", ner.tokens_plain(F.col("entities")).alias("affil_tokens"))


@query(O.TOKENS_MERGED)
def tokens_merged(spark, sf_dir):
    found = _acronym_entities(spark, sf_dir).filter("total_entities > 0")
    out = ner.merge_tokens(mentions(spark, sf_dir), ner.token_table(found))
    return out.select("id1", "affil1", "affil_tokens_labeled", "affil_tokens", F.coalesce(F.col("total_entities").cast("int"), F.lit(0)).alias("total_entities"))


def _acronym_entities(spark, sf_dir):
    return _extracted(spark, sf_dir, ner.NerConfig(entity_types=("ORG",), model_type="acronyms"))


@query(O.TOKENS_MERGED)
def tokens_merged_by_position(spark, sf_dir):
    tokens = ner.token_table(_acronym_entities(spark, sf_dir)).withColumnRenamed("id1", "at")
    out = ner.merge_tokens(mentions(spark, sf_dir), tokens, order=("id1", "at"))
    none = F.col("total_entities") == 0
    return out.select("id1", "affil1", F.when(~none, F.col("affil_tokens_labeled")).alias("affil_tokens_labeled"), F.when(~none, F.col("affil_tokens")).alias("affil_tokens"), F.col("total_entities").cast("int").alias("total_entities"))


# --- sources and sinks


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def csv_round_trip(spark, sf_dir):
    path = _folder(spark, "csv")
    R.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), path)
    kinds = dict(table(spark, sf_dir, "customer").dtypes)
    return R.read_csv(spark, path, ", ".join(f"{c} {kinds[c]}" for c in ("c_custkey", "c_name", "c_nationkey")))


@query("SELECT doc_id, text FROM documents WHERE text <> ''")
def csv_of_many_lines(spark, sf_dir):
    path = _folder(spark, "lines")
    R.write_csv(table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "text"), path)
    return R.read_csv(spark, path, "doc_id long, text string", multi_line=True)


@query("SELECT CAST(p_partkey AS VARCHAR) AS src, p_name AS cand FROM part")
def csv_headerless(spark, sf_dir):
    path = _folder(spark, "gold")
    table(spark, sf_dir, "part").select("p_partkey", "p_name").write.csv(path)
    return R.read_headerless_pairs(spark, path)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def csv_first_existing(spark, sf_dir):
    path = _folder(spark, "nation")
    R.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return R.read_first_existing(spark, [path + "-missing", path])


@query(O.graph(O.GEXF))
def gexf_lines(spark, sf_dir):
    e = _edges(spark, sf_dir)
    lines = R.gexf_lines(graph.degrees(e), e.withColumn("weight", F.round(F.col("weight") * 1_000_000).cast("long")))
    return lines.filter("part in (1, 3)").select("part", "at", "line")


__all__ = ["ORACLE_SQL", "QUERIES"]
