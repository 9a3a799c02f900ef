import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocking, evaluation, features, graph, labeling, matcher, ner, trees
from tessera.operators.components import connected_components
from tessera.operators.ranks import with_position
from tessera.sources import records as R

SCORES = [(0, 0.10), (1, 0.35), (0, 0.40), (1, 0.80)]


def scored(spark):
    return spark.createDataFrame(SCORES, "label int, score double")


def test_f1_aligned_and_shifted(spark):
    a = evaluation.best_threshold(scored(spark)).first()
    assert (a["threshold"], round(a["f1"], 4)) == (0.35, 0.8)
    b = evaluation.best_threshold(scored(spark), align="shifted").first()
    assert (b["threshold"], round(b["f1"], 4), b["precision"], b["recall"]) == (0.10, 0.8, 0.5, 1.0)


def test_areas(spark):
    curve = evaluation.pr_curve(scored(spark))
    assert evaluation.roc_auc(curve).first()[0] == pytest.approx(0.75)
    assert evaluation.average_precision(curve).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_folds_are_balanced(spark):
    df = spark.range(103).select(F.col("id").alias("src_id"), (F.col("id") + 1).alias("cand_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    n = evaluation.stratified_folds(df).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in n if r["label"] == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_match_graph_and_components(spark):
    p = spark.createDataFrame([(1, 2, 0.8), (2, 1, 0.9), (2, 3, 0.7), (5, 6, 0.95), (4, 4, 1.0), (3, 5, 0.69)], "src_id int, cand_id int, prob_match double")
    e = graph.match_graph(p)
    assert sorted(map(tuple, e.collect())) == [(1, 2, 0.9), (2, 3, 0.7), (5, 6, 0.95)]
    assert sorted(map(tuple, graph.components(e).collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    assert sorted(map(tuple, graph.components(e, spark.range(1, 8)).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 7)]


def test_sample_is_that_of_two_steps_around_the_hubs(spark):
    r = random.Random(8)
    pairs = {(0, i) for i in range(2, 60)} | {(1, i) for i in range(40, 90)}
    pairs |= {tuple(sorted(r.sample(range(200), 2))) for _ in range(90)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "u long, v long, weight double")
    top = sorted(near, key=lambda x: (-len(near[x]), x))[:6]
    at = {}
    for rank, s in enumerate(top):
        reach = {s} | near[s] | {y for x in near[s] for y in near[x]}
        for x in reach:
            at.setdefault(x, (rank, x != s, hashlib.md5(str(x).encode()).hexdigest(), x))
    want = sorted(at, key=at.get)[:70]
    assert [x["id"] for x in graph.sample_nodes(edges, 70, 6).collect()] == want
    assert graph.sample_subgraph(edges, 1000).count() == len(pairs)
    kept = {x["id"] for x in graph.sample_nodes(edges, 70).collect()}
    assert {(e["u"], e["v"]) for e in graph.sample_subgraph(edges, 70).collect()} == {(a, b) for a, b in pairs if a in kept and b in kept}


def test_components_of_random_and_long_graphs(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(1000, i) for i in range(1001, 1100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: root(x) for x in up}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_louvain_refines_components(spark):
    clique = [(a + s, b + s, 1.0) for s in (0, 10) for a in range(5) for b in range(a + 1, 5)] + [(0, 10, 0.7)]
    e = spark.createDataFrame(clique, "u long, v long, weight double")
    found = graph.louvain(e)
    got = dict(map(tuple, found.collect()))
    assert len(set(got.values())) == 2 and got[4] == got[0] and got[14] == got[10]
    whole = graph.components(e).withColumnRenamed("component", "community")
    assert graph.modularity(e, found).first()[0] >= graph.modularity(e, whole).first()[0]


def test_louvain_of_great_components(spark):
    r = random.Random(4)
    rows = {(i, j) for g in range(12) for i in range(g * 20, g * 20 + 20) for j in range(i + 1, g * 20 + 20) if r.random() < 0.5}
    rows |= {(g * 20, (g * 20 + 20) % 240) for g in range(11)} | {tuple(sorted(r.sample(range(240), 2))) for _ in range(40)}
    rows |= {(500, 501), (501, 502)}  # a component that is small enough
    e = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "u long, v long, weight double")
    at_once, in_tasks = graph.louvain(e, task_edges=60), graph.louvain(e)
    got, whole = dict(map(tuple, at_once.collect())), dict(map(tuple, in_tasks.collect()))
    assert at_once.count() == len(got) and set(got) == set(whole) == {x for p in rows for x in p}
    assert all(c == min(x for x in got if got[x] == c) for c in got.values())
    assert got[500] == got[501] == got[502] == 500 and len({c for x, c in got.items() if x < 500}) > 1
    assert graph.modularity(e, at_once).first()[0] >= 0.95 * graph.modularity(e, in_tasks).first()[0]
    # a single edge more than allowed that no move can make smaller stays as it is
    pair = spark.createDataFrame([(1, 2, 1.0)], "u long, v long, weight double")
    assert {x["id"] for x in graph.louvain(pair, task_edges=0).collect()} == {1, 2}


def test_labels(spark):
    gold = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "d")], "src string, cand string")
    pairs = spark.createDataFrame([("a", "b"), ("d", "c"), ("a", "c")], "src_id string, cand_id string")
    assert {(r["src_id"], r["cand_id"]): r["label"] for r in labeling.label_pairs(pairs, gold).collect()} == {("a", "b"): 1, ("d", "c"): 1, ("a", "c"): 0}
    assert labeling.matching(pairs, gold).count() == 2
    assert labeling.matching(pairs, gold, "left_anti").count() == 1


def test_knn_prefix_and_no_self(spark):
    texts = ["ibm almaden research", "ibm almaden research", "ibm research zurich", "mit boston", "mit lab boston", "", "zurich"]
    m = spark.createDataFrame(list(enumerate(texts)), "id1 long, affil1 string")
    three, two = ({(r["src_id"], r["cand_id"]) for r in blocking.knn(m, k).collect()} for k in (3, 2))
    assert two <= three and all(a != b for a, b in three) and (0, 1) in two and not any(5 in p for p in three)
    one = blocking.collapse(blocking.knn(m, 3), 3).collect()
    assert len({frozenset((r["src_id"], r["cand_id"])) for r in one}) == len(one)


def brute_neighbours(texts, k):
    """TF-IDF neighbours one pair at a time."""
    import math
    import re
    from collections import Counter

    words = {i: re.findall(r"\w{2,}", t.lower()) for i, t in texts}
    terms = {i: Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]) for i, w in words.items()}
    df, n = Counter(t for c in terms.values() for t in c), len(texts)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if 2 <= d <= 0.9 * n}
    unit = {}
    for i, c in terms.items():
        v = {t: (1 + math.log(x)) * idf[t] for t, x in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        unit[i] = {t: x / norm for t, x in v.items()}
    out = {}
    for i, v in unit.items():
        sims = sorted((-round(sum(x * w[t] for t, x in v.items() if t in w), 6), j) for j, w in unit.items() if j != i)
        out[i] = [(j, -s) for s, j in sims if s < 0][:k]
    return out


@pytest.mark.parametrize("rows", [2048, 17])
def test_neighbours_by_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(blocking, "BLOCK_ROWS", rows)
    monkeypatch.setattr(blocking.block_count, "__defaults__", (rows,))
    r = random.Random(4)
    texts = [(i, " ".join(r.choices([f"w{j}" for j in range(60)], k=r.randint(0, 12)))) for i in range(90)] + [(200 + i, "same text here") for i in range(30)]
    want = brute_neighbours(texts, 7)
    m = spark.createDataFrame(texts, "id1 long, affil1 string")
    for backend, floor in (("exact", 0), ("prefix", 0.2)):
        got = {}
        for x in blocking.knn(m, 7, backend=backend, floor=floor).orderBy("src_id", "rank").collect():
            got.setdefault(x["src_id"], []).append((x["cand_id"], x["cosine_sim"]))
        for i, near in want.items():
            near = [(j, s) for j, s in near if s >= floor]
            assert [j for j, _ in got.get(i, [])] == [j for j, _ in near] and [s for _, s in got.get(i, [])] == pytest.approx([s for _, s in near], abs=2e-6)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_neighbours_meet_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(blocking.block_count, "__defaults__", (9,))
    texts = [(i, f"alike w{i % 7} v{i % 5}") for i in range(60)]
    near = blocking.knn(spark.createDataFrame(texts, "id1 long, affil1 string"), 3)
    assert "CartesianProduct" in plan_of(near) and "Exchange" not in plan_of(near)
    assert near.count() == 180


def test_groups_of_blocks_agree_with_one_group(spark, monkeypatch):
    monkeypatch.setattr(blocking.block_count, "__defaults__", (9,))
    texts = [(f"r{i}", f"alike w{i % 7} v{i % 5} u{i % 11}") for i in range(100)]
    m = spark.createDataFrame(texts, "id1 string, affil1 string")
    one = sorted(map(tuple, blocking.knn(m, 4).collect()))
    monkeypatch.setattr(blocking, "GROUP_BLOCKS", 2)
    assert one == sorted(map(tuple, blocking.knn(m, 4).collect())) and len(one) == 400


def test_block_pairs_are_not_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(blocking.block_count, "__defaults__", (9,))
    r = random.Random(6)
    sets = {f"r{i}": set(r.sample("abcdefghijkl", r.randint(1, 5))) for i in range(60)}
    blocks = spark.createDataFrame([(t, i) for i, s in sets.items() for t in s] + [("a", "r0")] * 2, "block_key string, id string")
    sets["r0"].add("a")
    for overlap in (1, 2):
        got = blocking.block_pairs(blocks, overlap)
        assert "Exchange" not in plan_of(got) and "CartesianProduct" in plan_of(got)
        assert sorted(map(tuple, got.collect())) == sorted((a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= overlap)


@pytest.mark.parametrize("rows, terms", [(2048, 10**6), (9, 10**6), (9, 0)])
def test_cosines_of_pairs_without_dealing_out_terms(spark, monkeypatch, rows, terms):
    from tessera.operators import features

    monkeypatch.setattr(blocking.block_count, "__defaults__", (rows,))
    monkeypatch.setattr(blocking, "BROADCAST_TERMS", terms)
    r = random.Random(8)
    texts = [(f"r{i}", " ".join(r.choices([f"w{j}" for j in range(30)], k=r.randint(0, 9)))) for i in range(50)] + [("s", "alone here"), ("t", "same text"), ("u", "same text")]
    names = [i for i, _ in texts]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(200)] + [("t", "u"), ("s", "s"), ("s", "r0")]
    m = spark.createDataFrame(texts, "id1 string, affil1 string")
    p = spark.createDataFrame(pairs, "src_id string, cand_id string")
    out = blocking.pair_cosines(p, m, features.word_terms(features.F.col("affil1")), "x")
    got = {(x["src_id"], x["cand_id"]): x["x"] for x in out.collect()}
    filled = blocking.enrich(p, m).localCheckpoint()
    want = {(x["src_id"], x["cand_id"]): x["tfidf_word_cosine"] for x in features.with_cosine(filled, features.tfidf_word(filled)).collect()}
    assert got.keys() == want.keys() == set(pairs) and got == pytest.approx(want) and got["t", "u"] == pytest.approx(1)
    assert "ExplodeNode" not in plan_of(out) and "Generate" not in plan_of(out)


def test_a_text_is_split_once(spark):
    """What came to seven times before: the text function in the plan of its words and pairs of words."""
    from tessera.functions import text as T

    df = spark.createDataFrame([("Ab cd ab",), ("",), ("x",), (None,)], "t string")
    out = df.select(T.word_ngrams(T.vector_tokens(T.F.col("t"))).alias("g"))
    assert plan_of(out).count("regexp_extract_all") == 1
    assert [r[0] for r in out.collect()] == [["ab", "cd", "ab", "ab cd", "cd ab"], [], [], None]
    many = spark.createDataFrame([([5, 3, 5, -2],), ([],)], "t array<long>").select(T.counted(T.F.col("t")).alias("c"))
    assert [(r.c.t, r.c.tf) for r in many.collect()] == [([-2, 3, 5], [1, 1, 2]), ([], [])]


def test_what_led_to_a_checkpoint_is_released(spark, monkeypatch):
    import time

    from tessera.operators import components as C

    monkeypatch.setattr(C, "RELEASE_S", 0.0)
    tracker = spark._jsparkSession.sparkContext().env().mapOutputTracker()
    before = {i for i in range(10_000) if tracker.containsShuffle(i)}
    made = lambda: [i for i in range(10_000) if i not in before and tracker.containsShuffle(i)]
    out = spark.range(1000).selectExpr("id AS k")
    for n in (50, 20, 7):
        out = C.checkpointed(out.selectExpr(f"k % {n} AS k").repartition(3, "k").groupBy("k").count())
    end = time.monotonic() + 20
    while len(made()) > 1 and time.monotonic() < end:
        time.sleep(0.2)
    assert len(made()) <= 1 and out.count() == 7  # the last one may still be referred to


def test_texts_are_not_dealt_out_with_pairs(spark, monkeypatch):
    m = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id1 long, affil1 string").repartition(3)
    pairs = spark.createDataFrame([(0, 1), (3, 4), (2, 99), (99, 0)], "src_id long, cand_id long").repartition(3)
    monkeypatch.setattr(blocking, "BROADCAST_TEXT", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = blocking.enrich(pairs, m).select("src_id", "cand_id", "src_text", "cand_text")
        monkeypatch.setattr(blocking, "BROADCAST_TEXT", 10_000)
        sent = blocking.enrich(pairs, m).select("src_id", "cand_id", "src_text", "cand_text")
        assert "SortMergeJoin" in plan_of(dealt) and "SortMergeJoin" not in plan_of(sent)
        rows = sorted(map(tuple, sent.collect()), key=str)
        assert rows == sorted(map(tuple, dealt.collect()), key=str) and (99, 0, None, "text 0") in rows and (2, 99, "text 2", None) in rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recall_of_the_approximate_backend(spark):
    m = R.turns(spark, "/root/testdata/sf0.01")
    exact, near = ({(x["src_id"], x["cand_id"]) for x in blocking.knn(m, 20, backend=b).collect()} for b in ("exact", "prefix"))
    assert near and len(exact & near) >= 0.9 * len(exact)


def test_backend_follows_from_the_products():
    assert blocking.choose_backend(10) == "exact" and blocking.choose_backend(10, 1e15) == "prefix" and blocking.choose_backend(10**7) == "prefix"
    assert blocking.choose_backend(10, 1e15, "exact") == "exact" and blocking.block_count(2_000_000) == 977 and blocking.block_count(0) == 1
    with pytest.raises(ValueError):
        blocking.choose_backend(10, None, "hnsw")


def test_dense_neighbours_by_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(2)
    x = r.normal(size=(70, 8)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for blocks in (None, 5):
        got = {(q["src_id"], q["rank"]): (q["cand_id"], q["cosine_sim"]) for q in blocking.knn_dense(df, 69, blocks).collect()}
        assert len(got) == 70 * 69
        for i in range(70):
            sims = [(-round(float(u[i] @ u[j]), 6), j) for j in range(70) if j != i]
            for rank, (s, j) in enumerate(sorted(sims), 1):
                assert got[i, rank][1] == pytest.approx(-s, abs=2e-6)


@pytest.mark.parametrize("grower", [trees.Boosting(rounds=60), trees.Forest(trees=40)])
def test_trees_learn_what_no_line_can(spark, grower):
    import numpy as np

    r = np.random.default_rng(1)
    x = r.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    rows = [(i, i, *map(float, v), int(t), 1.0) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "src_id long, cand_id long, a double, b double, c double, label int, w double")
    fit, rest = df.filter("src_id < 400"), df.filter("src_id >= 400")
    model = grower.fit(fit, ("a", "b", "c"), "w")
    got = rest.select("label", model.score(("a", "b", "c")).alias("p")).collect()
    assert sum((q["p"] > 0.5) == q["label"] for q in got) >= 190 and all(0 <= q["p"] <= 1 for q in got)
    assert [q["p"] for q in got] == [q["p"] for q in rest.select(grower.fit(fit, ("a", "b", "c"), "w").score(("a", "b", "c")).alias("p")).collect()]


def test_boosting_first_step_is_newtons():
    """One leaf: minus the gradient over the curvature and the penalty, times the rate."""
    import numpy as np

    y, w = np.array([1.0, 0.0, 1.0, 1.0]), np.array([1.0, 2.0, 1.0, 0.5])
    t = trees.Boosting(rounds=1, rows=1.1, depth=0).grow(np.zeros((4, 1)), y, w)
    g, h = (w * (0.5 - y)).sum(), (w * 0.25).sum()
    assert t.nodes[0][2][0] == pytest.approx(-0.05 * g / (h + 1.0))


def test_curves_over_many_scores(spark):
    """Ranges of scores add up to the curve of one list."""
    r = random.Random(9)
    rows = [(g, int(r.random() < s), s) for g in (0, 1, None) for s in [round(r.random(), 3) for _ in range(700)]]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    got = {(x["g"], x["threshold"]): (x["tp"], x["fp"], x["positives"], x["rows"]) for x in evaluation.pr_curve(df, ("g",)).collect()}
    areas = {x["g"]: x["roc_auc"] for x in evaluation.roc_auc(evaluation.pr_curve(df, ("g",)), ("g",)).collect()}
    for g in (0, 1, None):
        mine = [(y, s) for q, y, s in rows if q == g]
        p = sum(y for y, _ in mine)
        for s in {s for _, s in mine}:
            over = [y for y, z in mine if z >= s]
            assert got[g, s] == (sum(over), len(over) - sum(over), p, 700)
        pairs = sum((a > b) + (a == b) / 2 for y, a in mine for z, b in mine if y > z)
        assert areas[g] == pytest.approx(pairs / (p * (700 - p)))


def test_lsh_recall(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact, near = ({(x["src_id"], x["cand_id"]) for x in f(df, 5).collect()} for f in (blocking.knn_dense, blocking.knn_lsh))
    assert len(exact) == 1000 and len(exact & near) >= 900


def test_features_are_symmetric(spark):
    p = spark.createDataFrame([(1, 2, "IBM Almaden", "IBM Almaden Research"), (2, 1, "IBM Almaden Research", "IBM Almaden"), (3, 4, None, ""), (5, 5, "abc def", "abc def")], "src_id long, cand_id long, src_text string, cand_text string")
    got = {r["src_id"]: r for r in features.feature_table(p).collect()}
    assert all(got[1][f] == pytest.approx(got[2][f]) and 0 <= got[1][f] <= 1 for f in features.FEATURES)
    assert round(got[1]["lcs_ratio"], 6) == 0.55 and round(got[1]["edit_ratio"], 6) == 0.709677
    assert all(got[5][f] == pytest.approx(1) for f in features.FEATURES)
    assert [got[3][f] for f in features.FEATURES] == [1, 0, 1, 1, 0, 0, 0, 0]


def test_matcher(spark):
    r = random.Random(2)
    rows = [(i, i + 1, r.gauss(y, 0.4), r.gauss(-y, 0.6), y) for i in range(200) for y in [i % 3 == 0]]
    df = spark.createDataFrame([(a, b, x, z, int(y)) for a, b, x, z, y in rows], "src_id long, cand_id long, x double, z double, label int")
    t = matcher.train_matcher(df, ("x", "z"))
    assert t.metrics["oof"]["roc_auc"] > 0.9 and len(t.metrics["folds"]) == 5 and t.oof.count() == 200
    out = t.predict(df)
    assert out.filter((F.col("prob_match") >= t.threshold) != (F.col("pred_match") == 1)).count() == 0
    with pytest.raises(ValueError):
        matcher.make_model("svm")
    with pytest.raises(RuntimeError):
        matcher.make_model("xgb", native=True)


def test_ner(spark):
    m = spark.createDataFrame([(1, "IBM Research, San Jose, USA"), (2, "nothing"), (3, " "), (4, "only ACM here"), (5, None)], "id1 long, affil1 string")
    got = {r["id1"]: r for r in ner.extract_entities(m, config=ner.NerConfig(backoff="acronyms")).collect()}
    assert [(e["text"], e["label"]) for e in got[1]["entities"]] == [("IBM Research", "ORG"), ("San Jose", "GPE"), ("USA", "GPE")]
    assert [e["text"] for e in got[4]["entities"]] == ["ACM"] and got[2]["total_entities"] == got[3]["total_entities"] == got[5]["total_entities"] == 0
    with pytest.raises(ValueError):
        ner.extract_entities(m, config=ner.NerConfig(model_type="nope"))
    for missing in (ner.NerConfig(model_type="spacy"), ner.NerConfig(backoff="transformer")):
        with pytest.raises(OSError):
            ner.extract_entities(m, config=missing)
    with pytest.raises(ValueError):
        ner.extract_entities(m, config=ner.NerConfig(batch_size=0))


def test_a_record_that_fails_keeps_its_error(spark, monkeypatch):
    def picky():
        sizes = []

        def extract(text):
            sizes.append(text)
            if "bad" in text:
                raise ValueError("no")
            return [(text, "ORG", 0, len(text), None)]

        return extract

    monkeypatch.setitem(ner.EXTRACTORS, "picky", picky)
    m = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, "fine")], "id1 long, affil1 string")
    got = {r["id1"]: (r["total_entities"], r["error"]) for r in ner.extract_entities(m, config=ner.NerConfig(model_type="picky", batch_size=1)).collect()}
    assert got == {1: (1, None), 2: (0, "ValueError: no"), 3: (1, None)}


def test_tokens_merge_by_id_or_position(spark):
    m = spark.createDataFrame([(10, "a"), (30, "c"), (20, "b")], "id1 long, affil1 string")
    by_id = ner.merge_tokens(m, spark.createDataFrame([(20, "B")], "id1 long, affil_tokens string"))
    assert sorted(map(tuple, by_id.collect())) == [(10, "a", None), (20, "b", "B"), (30, "c", None)]
    tokens = spark.createDataFrame([(2, "B"), (1, "A")], "n long, affil_tokens string")
    by_place = ner.merge_tokens(m, tokens, order=("id1", "n")).select("id1", "affil_tokens")
    assert sorted(map(tuple, by_place.collect())) == [(10, "A"), (20, "B"), (30, None)]
    with pytest.raises(ValueError):
        ner.merge_tokens(m, tokens)


def test_positions(spark):
    got = with_position(spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")), F.desc("x")).collect()
    assert all(r["position"] == 999 - r["x"] for r in got) and len(got) == 1000


def test_token_strings(spark):
    e = spark.createDataFrame([([("IBM", "ORG"), ("ibm", "ORG"), ("San Jose", "GPE"), (" ;", "ORG"), ("IBM", "GPE")],)], "entities array<struct<text:string,label:string>>")
    assert e.select(ner.tokens_labeled(F.col("entities"))).first()[0] == "IBM<ORG>; San Jose<GPE>; IBM<GPE>"
    assert e.select(ner.tokens_plain(F.col("entities"))).first()[0] == "IBM; San Jose"


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text'), (2, None)], "ID1 int, Affil string")
    R.write_csv(df, str(tmp_path / "x"))
    back = R.read_csv(spark, str(tmp_path / "x"), "ID1 int, Affil string")
    assert sorted(map(tuple, back.collect())) == [(1, 'a "quoted", text'), (2, None)]
    assert R.detect_columns(["x", "ID1", "Affil"]) == ("Affil", "ID1") and R.detect_columns(["p", "q"]) == ("p", "q") and R.detect_columns(["p", "q"], text_col="q") == ("q", "q")
    assert R.read_first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "x")]).count() == 2
    with pytest.raises(FileNotFoundError):
        R.read_first_existing(spark, [str(tmp_path / "no")])
    (tmp_path / "gold.csv").write_text("a,b\nc,d\n")
    assert R.read_headerless_pairs(spark, str(tmp_path / "gold.csv")).count() == 2
    assert sorted(map(tuple, R.as_records(df).collect())) == [(1, 'a "quoted", text'), (2, "")]
    nodes, edges = spark.createDataFrame([(1, 0), (2, 0)], "id long, community int"), spark.createDataFrame([(1, 2, 0.9)], "u long, v long, weight double")
    R.write_gexf(nodes, edges, str(tmp_path / "g.gexf"))
    import xml.etree.ElementTree as E

    tree = list(E.parse(tmp_path / "g.gexf").iter())
    assert len([x for x in tree if x.tag.endswith("}edge")]) == 1 and len([x for x in tree if x.tag.endswith("}node")]) == 2
    assert not (tmp_path / "g.gexf.parts").exists()
    odd = spark.createDataFrame([(1, 'a<b & "c"')], "id long, name string")
    R.write_gexf(odd, edges, str(tmp_path / "h.gexf"))
    assert 'a<b & "c"' in [x.get("value") for x in E.parse(tmp_path / "h.gexf").iter()]


def test_star_centres_are_split(spark, monkeypatch):
    from tessera.operators import components

    monkeypatch.setattr(components, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(components, "HOT_CENTRE", 20)
    edges = [(0, i) for i in range(1, 80)] + [(100 + i, 101 + i) for i in range(30)] + [(79, 500), (500, 501)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {v: 0 if v < 80 or v >= 500 else 100 for e in edges for v in e}


def test_a_cluster_must_name_its_folder():
    from types import SimpleNamespace

    from tessera.operators.components import shared_folder

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_folder(fake)
    fake.conf.get = lambda k, d: "hdfs:///shared/"
    assert shared_folder(fake) == "hdfs:///shared"


def test_packed_blocks_take_few_bytes(spark):
    """An entry came to 20 bytes in a packed block, and to 12 in the rows written before it."""
    r = random.Random(3)
    texts = [(i, " ".join(r.choices([f"w{j}" for j in range(400)], k=40))) for i in range(2000)]
    grams = blocking.gram_vectors(spark.createDataFrame(texts, "id1 long, affil1 string"), blocking.word_ngrams(blocking.vector_tokens(F.col("affil1"))))
    columns = [c for c in grams.packs.columns if c not in ("b", "ids")]
    size = grams.packs.agg(F.sum(sum((F.octet_length(c) for c in columns), F.lit(0)))).first()[0]
    entries = grams.vectors().count()
    assert entries > 100_000 and size <= 6 * entries
    pairs = spark.createDataFrame([(t, i) for i in range(300) for t in range(i % 7, 40)], "block_key int, id int")
    packs = blocking.packed_blocks(pairs.groupBy("id").agg(F.collect_set(F.xxhash64("block_key")).alias("t")), 1, lambda d: d.select("_b", "id", F.explode("t").alias("t"), F.lit(1.0).alias("w"))).first()
    assert sum(len(packs[c]) for c in packs.asDict() if c not in ("b", "ids")) <= 6 * pairs.count()


def test_small_arrays_come_back():
    np = blocking.np
    for kind in (np.int32, np.int64, np.float64):
        for x in ([], [7], [-3, 5, 2**31 - 1, -(2**31)]):
            assert blocking._whole(blocking._small(np.array(x, dtype=kind)), kind).tolist() == x
    ends = np.array([-(2**63), -1, 0, 2**63 - 1])
    assert blocking._whole_steps(blocking._small_steps(ends)).tolist() == ends.tolist()


@pytest.mark.parametrize("backend", ["exact", "prefix"])
def test_only_neighbours_over_the_floor_are_handed_on(spark, monkeypatch, backend):
    monkeypatch.setattr(blocking.block_count, "__defaults__", (9,))
    r = random.Random(9)
    m = spark.createDataFrame([(i, " ".join(r.choices([f"w{j}" for j in range(25)], k=9))) for i in range(80)], "id1 long, affil1 string")
    every = blocking.knn(m, 5)
    want = sorted(map(tuple, every.filter("cosine_sim >= 0.3").collect()))
    grams = blocking.gram_vectors(m, blocking.word_ngrams(blocking.vector_tokens(F.col("affil1"))))
    got = sorted(map(tuple, blocking.neighbours(grams, 5, backend, min_sim=0.3).select(every.columns).collect()))
    assert got == want and 0 < len(want) < every.count()


def test_curves_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tell(parts):
        for x in parts:
            seen.add(len(x))
            yield x

    rows = spark.createDataFrame(SCORES, "label int, score double").mapInPandas(tell, "label int, score double")
    assert evaluation.best_threshold(rows).first()["threshold"] == 0.35 and seen.value == len(SCORES)


def test_members_of_blocks_are_not_dealt_out_by_token(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = spark.createDataFrame([(1, "a b b"), (2, "a c"), (3, "a b")], "id1 long, affil1 string")
        got = blocking.token_blocks(m, F.split("affil1", " "), most=2)
        assert "SortMergeJoin" not in plan_of(got) and sorted(map(tuple, got.collect())) == [("b", 1), ("b", 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_neighbours_write_less_than_their_texts(spark):
    """With the counted terms of all blocks it came to 1.27 bytes a byte of text."""
    import os

    from tessera.operators.components import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)
    r = random.Random(6)
    texts = [(i, " ".join(r.choices([f"word{j}" for j in range(3000)], k=60))) for i in range(2000)]
    m = spark.createDataFrame(texts, "id1 long, affil1 string")
    before = size()
    grams = blocking.gram_vectors(m, blocking.word_ngrams(blocking.vector_tokens(F.col("affil1"))))
    written, read = size() - before, sum(len(t) for _, t in texts)
    assert grams.n == 2000 and written <= 0.8 * read


@pytest.mark.parametrize("few", [0, 100_000_000])
def test_kept_texts_come_back_in_their_blocks(spark, monkeypatch, few):
    """With nulls, empty texts and ids of text; frequencies broadcast or joined; several ranges of hashes."""
    monkeypatch.setattr(blocking.block_count, "__defaults__", (9,))
    monkeypatch.setattr(blocking, "COUNTED_BLOCKS", 2)
    monkeypatch.setattr(blocking, "BROADCAST_TEXT", few)
    r = random.Random(8)
    texts = [(i, r.choice(["", "é x", " ".join(r.choices([f"w{j}" for j in range(30)], k=r.randint(1, 9)))])) for i in range(120)]
    want = {(f"r{i}", f"r{j}"): s for i, near in brute_neighbours(texts, 200).items() for j, s in near}
    m = spark.createDataFrame([(f"r{i}", t or None) for i, t in texts], "id1 string, affil1 string")
    got = {(x["src_id"], x["cand_id"]): x["cosine_sim"] for x in blocking.knn(m, 200).collect()}
    assert len(want) > 500 and got == pytest.approx(want, abs=2e-6)


def test_the_last_shuffle_is_released_too(spark, monkeypatch):
    import time

    from tessera.operators import components as C

    monkeypatch.setattr(C, "RELEASE_S", 0.0)
    tracker = spark._jsparkSession.sparkContext().env().mapOutputTracker()
    before = {i for i in range(10_000) if tracker.containsShuffle(i)}
    out = C.checkpointed(spark.range(1000).repartition(3, "id").groupBy("id").count())
    time.sleep(2)
    assert not [i for i in range(10_000) if i not in before and tracker.containsShuffle(i)] and out.count() == 1000
