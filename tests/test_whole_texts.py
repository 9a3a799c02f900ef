"""Queries over whole texts against brute force."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import registry


@pytest.fixture(scope="module")
def docs(tmp_path_factory):
    """Texts that are alike for 400 characters and differ after them, 110 copies of one text among them."""
    head = "common words stand at the head of every text " * 10
    texts = [head + f"Tail{i} NASA{chr(65 + i % 26)}{chr(65 + i // 26)} shared{i // 2}" for i in range(20)] + [head + "copied end UNESCO"] * 110 + ["", "  "]
    path = tmp_path_factory.mktemp("whole")
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), f"{path}/documents.parquet")
    return str(path), texts


def test_blocks_have_every_token_and_the_operators_bounds(spark, docs):
    path, texts = docs
    members = {}
    for i, t in enumerate(texts):
        for w in set(t.lower().split()):
            members.setdefault(w, set()).add(i)
    want = sorted((w, i) for w, ids in members.items() if 2 <= len(ids) <= 5000 for i in ids)
    assert sorted(map(tuple, registry.QUERIES["token_blocks_whole"](spark, path).select("block_key", "id").collect())) == want
    sets = [{w for w in set(t.lower().split()) if len(members[w]) >= 2} for t in texts]
    pairs = sorted((a, b, n) for a in range(len(texts)) for b in range(a + 1, len(texts)) if (n := len(sets[a] & sets[b])))
    assert sorted(map(tuple, registry.QUERIES["block_pairs_whole"](spark, path).collect())) == pairs
    assert sorted(map(tuple, registry.QUERIES["block_pairs_overlap2_whole"](spark, path).collect())) == [p for p in pairs if p[2] >= 2]


def test_terms_and_acronyms_after_400_characters_count(spark, docs):
    path, texts = docs
    near = registry.QUERIES["knn_whole_top20"](spark, path).filter("rank = 1").collect()
    assert {r["src_id"]: r["cand_id"] for r in near if r["src_id"] < 20} == {i: i ^ 1 for i in range(20)}
    want = {i: next((w for w in t.split() if w.isupper()), "") for i, t in enumerate(texts)}
    assert {r["id1"]: r["affil_tokens"] for r in registry.QUERIES["tokens_plain"](spark, path).collect()} == want
    labeled = registry.QUERIES["tokens_labeled"](spark, path).collect()
    assert {r["id1"]: r["affil_tokens_labeled"] for r in labeled} == {i: w and f"{w}<ORG>" for i, w in want.items()}
    ends = {r["id1"]: r["n"] for r in registry.QUERIES["ner_backoff"](spark, path).selectExpr("id1", "total_entities AS n").collect()}
    assert all(ends[i] for i in range(130))


def test_labels_of_copies_in_large_groups(spark, docs):
    path, texts = docs
    got = registry.QUERIES["label_pairs_whole"](spark, path).collect()
    sets = [set(t.lower().split()) for t in texts]
    assert got and all(r["label"] == int(10 * len(sets[r["src_id"]] & sets[r["cand_id"]]) >= 7 * len(sets[r["src_id"]] | sets[r["cand_id"]])) for r in got)
    assert sum(r["label"] for r in got if r["src_id"] >= 20) == 110 * 5
