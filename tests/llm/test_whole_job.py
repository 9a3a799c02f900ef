"""Cases that the operators once did in part."""

import corpus_pipeline
from tessera.llm import pii


def test_secrets_in_capitals_and_numbers_after_phones(spark):
    rows = [
        (1, 'TOKEN = "9233A8EF17B2"'),
        (2, "Passwd: hunterhunter"),
        (3, "+1 (826) 555-4081 190.137.223.204"),
        (4, "+1 (826) 555-4081 123-45-6789"),
        (5, "+1 (826) 555-4081 4539 1488 0343 6467"),
        (6, "+1 826-555-4081 (731) 555-2485"),
        (7, "+1.826.555.4081"),
    ]
    out = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    kinds = {i: [e["kind"] for e in r["entities"]] for i, r in out.items()}
    assert kinds == {1: ["SECRET"], 2: ["SECRET"], 3: ["PHONE", "IP"], 4: ["PHONE", "SSN"], 5: ["PHONE", "CARD"], 6: ["PHONE", "PHONE"], 7: ["PHONE"]}
    for rest in ("9233A8", "hunterhunter", "223.204", "6789", "6467", "2485", "4081"):
        assert not any(rest in r["text"] for r in out.values())


def test_stage_links_near_copies_of_five_words_and_080(spark):
    words = [f"w{i}" for i in range(50)]
    other = [*words[:25], "changed", *words[26:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "a text of its own")], "doc_id long, text string")
    # 41 of 51 shingles of five words are shared, and 43 of 51 of four
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
