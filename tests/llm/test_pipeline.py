import pytest

import corpus_pipeline
from tessera.llm import decontaminate, mixing, ngram_join, quality, sharding
from tessera.llm.arrow import tables

SF = "/root/testdata/sf0.001"


def test_stages_do_what_their_operators_say(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    docs = first = tables(spark, SF, "documents")
    labels, bench = tables(spark, SF, "labels"), tables(spark, SF, "benchmark")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        got = sorted(r["doc_id"] for r in after.select("doc_id").collect())
        if name != "shard":
            assert after.columns == first.columns
        if name == "quality":
            want = [r["doc_id"] for r in quality.grade_documents(docs, quality.graded(labels)).filter("accepted").collect()]
        elif name == "near_duplicates":
            want = [r["doc_id"] for r in ngram_join.jaccard_components(docs).filter("doc_id = component_id").collect()]
            assert ngram_join.jaccard_components(after).filter("doc_id <> component_id").count() == 0
        elif name == "decontaminate":
            want = [r["doc_id"] for r in decontaminate.find_passages(docs, bench).filter("not contaminated").collect()]
        elif name == "mix":
            want = [r["doc_id"] for r in mixing.mix_documents(docs).collect() for _ in range(r["taken"] // r["size"] if r["size"] else 0)]
        else:
            want = [r["doc_id"] for r in docs.select("doc_id").collect()]
            shards = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs).collect()}
            assert all(shards[r["doc_id"]] == r["shard"] for r in after.select("doc_id", "shard").collect())
        assert got == sorted(want), name
        docs = after
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()) == pytest.approx(got)


def test_clashing_names_nulls_and_repeats(spark, tmp_path):
    names = ["size", "shard", "stages", "target", "taken", "accepted", "contaminated", "component_id", "id", "sid", "_key", "slot", "Text_Crc32"]
    shape = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    extra = ("x",) * len(names)
    texts = [" ".join(f"word{(i * 7 + j * j) % 997}" for j in range(30 + i)) for i in range(60)]
    rows = [(i, t, "en", "a" if i % 3 else None, len(t), *extra) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1], None, None, None, *extra), (None, None, None, None, None, *extra), (900, "", "en", "b", 0, *extra)]
    docs = spark.createDataFrame(rows, shape)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tables(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    tables(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.collect()
    assert got and all(r[n] == "x" for r in got for n in names)
    assert {(r["doc_id"], r["text"]) for r in got} <= {r[:2] for r in rows}
