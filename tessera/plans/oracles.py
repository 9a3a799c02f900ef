"""Oracle SQL, for an engine that reads the same tables."""

from __future__ import annotations

#: Whole documents, and whole turns of conversations.
M = "m AS (SELECT doc_id AS id1, coalesce(text, '') AS affil1 FROM documents)"
TURNS = "m AS (SELECT CAST(conv_id * 10000 + turn AS BIGINT) AS id1, coalesce(text, '') AS affil1 FROM conversations)"


def with_m(select: str) -> str:
    return f"WITH {M} {select}"


def with_turns(select: str) -> str:
    return f"WITH {TURNS} {select}"


def norm(c: str) -> str:
    ascii_ = f"regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace({ascii_}, '[^A-Za-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda t: t <> '')"


def vector_tokens(c: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({c})), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def grams(c: str) -> str:
    t = vector_tokens(c)
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: ({t})[i] || ' ' || ({t})[i + 1]))"


def char_grams(c: str) -> str:
    t = f"regexp_replace(lower({c}), '\\s\\s+', ' ', 'g')"
    of = [f"list_transform(range(1, len({t}) - {n} + 2), lambda i: substring({t}, i, {n}))" for n in (3, 4, 5)]
    return f"list_concat(list_concat({of[0]}, {of[1]}), {of[2]})"


def sweep(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '[A-Za-z0-9]+(?:[.\\-][A-Za-z0-9]+)*'), lambda t: lower(t))"


def acronyms(c: str) -> str:
    runs = f"list_transform(regexp_extract_all({c}, '[A-Z0-9&\\-]{{2,}}'), lambda r: regexp_replace(r, '[^A-Za-z0-9]', '', 'g'))"
    return f"list_distinct(list_transform(list_filter({runs}, lambda r: len(r) >= 2 AND regexp_matches(r, '[A-Z]')), lambda r: lower(r)))"


def vectors(select: str, min_df: int = 2, max_df: float = 0.9, more: str = "") -> str:
    return f"""WITH RECURSIVE {TURNS}, c AS (SELECT id, term, count(*) AS tf FROM (SELECT id1 AS id, unnest({grams('affil1')}) AS term FROM m) GROUP BY id, term),
n AS (SELECT count(*) AS n FROM m),
v AS (SELECT term, count(*) AS df, ln(CAST(1 + n AS DOUBLE) / (1 + count(*))) + 1 AS idf FROM c, n GROUP BY term, n HAVING count(*) >= {min_df} AND count(*) <= {max_df} * n),
x AS (SELECT id, c.term AS term, (1 + ln(tf)) * idf AS x FROM c JOIN v ON c.term = v.term),
nn AS (SELECT id, sqrt(sum(x * x)) AS norm FROM x GROUP BY id),
w AS (SELECT x.id AS id, term, x / norm AS w FROM x JOIN nn ON x.id = nn.id){more}
{select}"""


def _near(k: int) -> str:
    return f""",
p0 AS (SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS sim FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
d AS (SELECT a AS src_id, b AS cand_id, sim AS cosine_sim FROM p0 UNION ALL SELECT b, a, sim FROM p0),
k AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY cosine_sim DESC, cand_id) AS rank FROM d QUALIFY rank <= {k}),
u0 AS (SELECT src_id, cand_id, cosine_sim FROM k QUALIFY row_number() OVER (PARTITION BY least(src_id, cand_id), greatest(src_id, cand_id) ORDER BY cosine_sim DESC, src_id) = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY cosine_sim DESC, cand_id) AS rank FROM u0 QUALIFY rank <= {k})"""


def knn(k: int, select: str, more: str = "") -> str:
    return vectors(select, more=_near(k) + more)


def blocks(select: str) -> str:
    return f"""WITH {TURNS}, t AS (SELECT DISTINCT id1 AS id, unnest({words('affil1')}) AS block_key FROM m),
b AS (SELECT block_key, id FROM t QUALIFY count(*) OVER (PARTITION BY block_key) BETWEEN 2 AND 5000),
p AS (SELECT x.id AS id_left, y.id AS id_right, count(*) AS n_shared FROM b x JOIN b y ON x.block_key = y.block_key AND x.id < y.id GROUP BY 1, 2)
{select}"""


def pairs(select: str) -> str:
    more = f""",
pr AS (SELECT src_id, cand_id, s.affil1 AS src_text, c.affil1 AS cand_text FROM k LEFT JOIN m s ON s.id1 = src_id LEFT JOIN m c ON c.id1 = cand_id),
normed AS (SELECT src_id, cand_id, {norm('src_text')} AS na, {norm('cand_text')} AS nb FROM pr),
tokens AS (SELECT src_id, cand_id, {words('src_text')} AS a, {words('cand_text')} AS b FROM pr)"""
    return knn(20, select, more)


def jaccard(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / {union} END"


def token_cosine(a: str, b: str) -> str:
    def dot(x: str, y: str, over: str) -> str:
        return f"CAST(coalesce(list_sum(list_transform({over}, lambda t: len(list_filter({x}, lambda q: q = t)) * len(list_filter({y}, lambda q: q = t)))), 0) AS DOUBLE)"

    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {dot(a, b, f'list_distinct(list_intersect({a}, {b}))')} / sqrt({dot(a, a, f'list_distinct({a})')} * {dot(b, b, f'list_distinct({b})')}) END"


def pair_tfidf(terms: str, tf: str, name: str) -> str:
    more = f""",
pr AS (SELECT src_id, cand_id, s.affil1 AS src_text, c.affil1 AS cand_text FROM k LEFT JOIN m s ON s.id1 = src_id LEFT JOIN m c ON c.id1 = cand_id),
t0 AS (SELECT t, count(*) AS mult FROM (SELECT src_text AS t FROM pr UNION ALL SELECT cand_text FROM pr) GROUP BY t),
t1 AS (SELECT t, mult, term, count(*) AS tf FROM (SELECT t, mult, unnest({terms}) AS term FROM t0) GROUP BY t, mult, term),
t2 AS (SELECT term, ln(CAST(1 + (SELECT 2 * count(*) FROM pr) AS DOUBLE) / (1 + sum(mult))) + 1 AS idf FROM t1 GROUP BY term),
t3 AS (SELECT t, t1.term AS term, ({tf}) * idf AS x FROM t1 JOIN t2 ON t1.term = t2.term),
t4 AS (SELECT t, sqrt(sum(x * x)) AS norm FROM t3 GROUP BY t),
t5 AS (SELECT src_text, cand_text, sum(a.x * b.x) AS dot FROM (SELECT DISTINCT src_text, cand_text FROM pr) q JOIN t3 a ON a.t = src_text JOIN t3 b ON b.t = cand_text AND a.term = b.term GROUP BY 1, 2)"""
    return knn(20, f"SELECT src_id, cand_id, round(coalesce(dot / (a.norm * b.norm), 0.0), 6) AS {name} FROM pr LEFT JOIN t5 ON pr.src_text = t5.src_text AND pr.cand_text = t5.cand_text LEFT JOIN t4 a ON a.t = pr.src_text LEFT JOIN t4 b ON b.t = pr.cand_text", more)


def labeled(select: str) -> str:
    more = """,
gold AS (SELECT a.id1 AS src, b.id1 AS cand FROM m a JOIN m b ON a.id1 // 10000 = b.id1 // 10000 AND a.id1 < b.id1),
l AS (SELECT src_id, cand_id, round(cosine_sim, 3) AS score, CASE WHEN g.src IS NULL THEN 0 ELSE 1 END AS label FROM k LEFT JOIN gold g ON g.src = least(src_id, cand_id) AND g.cand = greatest(src_id, cand_id)),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', src_id, cand_id, 42)), src_id, cand_id) - 1) % 5 AS INTEGER) AS fold FROM l),
z0 AS (SELECT score AS threshold, sum(label) AS p, count(*) AS n FROM l GROUP BY score),
pc AS (SELECT threshold, sum(p) OVER w AS tp, sum(n) OVER w - sum(p) OVER w AS fp, CAST(sum(p) OVER w AS DOUBLE) / sum(n) OVER w AS precision, CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER () AS recall FROM z0 WINDOW w AS (ORDER BY threshold DESC)),
f1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc)"""
    return knn(20, select, more)


FOLD_REPORT = """, d0 AS (SELECT fold, score AS threshold, sum(label) AS p, count(*) AS n FROM f GROUP BY fold, score),
d1 AS (SELECT fold, threshold, p, n - p AS q, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY fold) AS ps, sum(n - p) OVER (PARTITION BY fold) AS qs FROM d0 WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC)),
d2 AS (SELECT *, CAST(tp AS DOUBLE) / seen AS precision, CAST(tp AS DOUBLE) / ps AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (seen + ps) ELSE 0.0 END AS f1 FROM d1),
d3 AS (SELECT fold, sum(CAST(p AS DOUBLE) / ps * precision) AS pr_auc, sum(q * (2 * tp - p) / 2.0) / (max(ps) * max(qs)) AS roc_auc FROM d2 GROUP BY fold),
d4 AS (SELECT fold, threshold, f1, precision, recall FROM d2 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(f1, 9) DESC, threshold) = 1),
d5 AS (SELECT fold, count(*) AS n, avg(label) AS rate FROM f GROUP BY fold)
SELECT d5.fold AS fold, n, round(rate, 6) AS positive_rate, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, threshold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall FROM d5 JOIN d3 ON d5.fold = d3.fold JOIN d4 ON d5.fold = d4.fold"""


def graph(select: str) -> str:
    more = """,
e AS (SELECT least(src_id, cand_id) AS u, greatest(src_id, cand_id) AS v, max(cosine_sim) AS weight FROM k WHERE cosine_sim >= 0.2 AND src_id <> cand_id GROUP BY 1, 2),
s AS (SELECT u AS id, v AS other FROM e UNION ALL SELECT v, u FROM e),
g AS (SELECT id, count(*) AS degree FROM s GROUP BY id),
r AS (SELECT id, id AS o FROM g UNION SELECT s.other, r.o FROM r JOIN s ON s.id = r.id),
cc AS (SELECT id, min(o) AS component FROM r GROUP BY id)"""
    return knn(20, select, more)


SAMPLE = """SELECT id FROM (SELECT id, min(seed_rank) AS seed_rank, min(seed_rank * 2 + far) % 2 AS far FROM (
  SELECT seed_rank, seed AS id, 0 AS far FROM top
  UNION SELECT seed_rank, s.other, CASE WHEN s.other = seed THEN 0 ELSE 1 END FROM top JOIN s ON s.id = seed
  UNION SELECT seed_rank, s2.other, CASE WHEN s2.other = seed THEN 0 ELSE 1 END FROM top JOIN s ON s.id = seed JOIN s s2 ON s2.id = s.other)
GROUP BY id) ORDER BY seed_rank, far, md5(CAST(id AS VARCHAR)), id LIMIT 50""".replace("FROM top", "FROM (SELECT id AS seed, row_number() OVER (ORDER BY degree DESC, id) AS seed_rank FROM g QUALIFY seed_rank <= 20)")


def sweep_sql(select: str) -> str:
    more = f""",
stop AS (SELECT term FROM v WHERE idf <= (SELECT quantile_cont(idf, 0.2) FROM v) UNION SELECT term FROM v, n WHERE CAST(df AS DOUBLE) / n > 0.2),
tw AS (SELECT DISTINCT id1 AS id, unnest({sweep('affil1')}) AS term FROM m),
ta AS (SELECT id1 AS id, unnest({acronyms('affil1')}) AS term FROM m),
imp AS (SELECT id, term FROM tw WHERE term IN (SELECT term FROM v) AND term NOT IN (SELECT term FROM stop) UNION SELECT id, term FROM ta)"""
    return vectors(select, 2, 0.99, _near(100) + more)


K_SWEEP = """, li AS (SELECT id, list(term) AS terms FROM imp GROUP BY id),
j AS (SELECT k.src_id AS src_id, k.rank AS rank, k.cosine_sim AS cosine_sim, coalesce(a.terms, []) AS ta, coalesce(b.terms, []) AS tb FROM k LEFT JOIN li a ON a.id = k.src_id LEFT JOIN li b ON b.id = k.cand_id),
q AS (SELECT rank, cosine_sim, CASE WHEN len(list_intersect(ta, tb)) > 0 THEN 1 ELSE 0 END AS hit, CASE WHEN len(ta) + len(tb) > 0 THEN CAST(len(list_intersect(ta, tb)) AS DOUBLE) / len(list_distinct(list_concat(ta, tb))) ELSE 0.0 END AS jac FROM j),
ks AS (SELECT CAST(unnest([5, 10, 20, 30, 40, 50, 75, 100]) AS INTEGER) AS kk)
SELECT kk AS k, round(CAST(sum(hit) AS DOUBLE) / (n * kk), 6) AS overlap_purity, round(sum(jac) / (n * kk), 6) AS jaccard_purity, round(sum(cosine_sim) / (n * kk), 6) AS avg_cosine, round(1 - CAST(n * kk AS DOUBLE) / (n * (n - 1)), 6) AS reduction_ratio
FROM ks JOIN q ON q.rank <= kk, n WHERE kk < n GROUP BY kk, n"""

_ENTITIES = "WITH m AS (SELECT doc_id AS id1, coalesce(text, '') AS affil1 FROM documents), x AS (SELECT id1, affil1, regexp_extract_all(affil1, '\\b[A-Z]{2,}\\b') AS e FROM m), o AS (SELECT id1, affil1, e, list_filter(e, lambda t, i: list_position(list_transform(e, lambda q: lower(q)), lower(t)) = i) AS once FROM x) "
TOKENS_LABELED = _ENTITIES + "SELECT id1, coalesce(array_to_string(list_transform(once, lambda t: t || '<ORG>'), '; '), '') AS affil_tokens_labeled, CAST(len(e) AS INTEGER) AS total_entities FROM o"
TOKENS_PLAIN = _ENTITIES + "SELECT id1, coalesce(array_to_string(once, '; '), '') AS affil_tokens FROM o"
TOKENS_MERGED = _ENTITIES + "SELECT id1, affil1, CASE WHEN len(e) > 0 THEN array_to_string(list_transform(once, lambda t: t || '<ORG>'), '; ') END AS affil_tokens_labeled, CASE WHEN len(e) > 0 THEN array_to_string(once, '; ') END AS affil_tokens, CAST(coalesce(len(e), 0) AS INTEGER) AS total_entities FROM o"

GEXF = """SELECT 1 AS part, row_number() OVER (ORDER BY id) - 1 AS at, '<node id="' || id || '" label="' || id || '"><attvalues><attvalue for="0" value="' || degree || '"/></attvalues></node>' AS line FROM g
UNION ALL SELECT 3, row_number() OVER (ORDER BY u, v) - 1, '<edge id="' || (row_number() OVER (ORDER BY u, v) - 1) || '" source="' || u || '" target="' || v || '" weight="' || CAST(round(weight * 1000000) AS BIGINT) || '"/>' FROM e"""
