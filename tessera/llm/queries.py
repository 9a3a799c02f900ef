"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from tessera.llm.arrow import tables
from tessera.llm.decontaminate import find_passages
from tessera.llm.fingerprints import fingerprint_documents
from tessera.llm.html_text import extract_pages
from tessera.llm.mixing import mix_documents
from tessera.llm.ngram_join import jaccard_components
from tessera.llm.pii import pseudonymise
from tessera.llm.quality import grade_documents, graded
from tessera.llm.sharding import shard_documents
from tessera.llm.token_counts import count_tokens
from tessera.llm.toxicity import toxicity


def op1_html_text(spark, sf_dir):
    return extract_pages(tables(spark, sf_dir, "pages"))


def op2_quality(spark, sf_dir):
    return grade_documents(tables(spark, sf_dir, "documents"), graded(tables(spark, sf_dir, "labels")))


def op3_pii(spark, sf_dir):
    return pseudonymise(tables(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    return toxicity(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op5_mixing(spark, sf_dir):
    return mix_documents(tables(spark, sf_dir, "documents"))


def op6_fingerprints(spark, sf_dir):
    return fingerprint_documents(tables(spark, sf_dir, "documents"))


def op7_sharding(spark, sf_dir):
    return shard_documents(tables(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    return find_passages(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(tables(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_ngram_join(spark, sf_dir):
    return jaccard_components(tables(spark, sf_dir, "documents"))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_fingerprints": op6_fingerprints,
    "op7_sharding": op7_sharding,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_ngram_join": op10_ngram_join,
}
#: The other operators hash, learn, parse or merge; SQL has no form of them.
ORACLE_SQL: dict[str, str] = {
    "op10_ngram_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
u AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS o FROM documents UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.id)
SELECT n.doc_id AS doc_id, n AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM n JOIN (SELECT id, min(o) AS component_id FROM r GROUP BY id) ON id = doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM e GROUP BY a) ON a = doc_id""",
}
