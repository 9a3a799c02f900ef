"""Results that don't depend on the input's size: what a large input would switch is switched here."""

import os

import duckdb
import pytest
from test_queries import SF, TABLES, rows

from tessera.operators import blocking, sweep
from tessera.plans import registry

NEIGHBOURS = [
    "average_precision",
    "class_weights",
    "f1_threshold",
    "f1_threshold_shifted",
    "feat_jaro_winkler",
    "feat_lcs_edit",
    "feat_metaphone",
    "feat_tfidf_word",
    "feat_token_cosine",
    "feat_token_jaccard",
    "fold_report",
    "k_sweep",
    "knn_enriched",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", NEIGHBOURS)
def test_many_products_change_no_result(spark, monkeypatch, name):
    """As SQL has it; without SQL, for the pairs that SQL finds."""

    def prefix(*_):
        pytest.fail("taken without being asked for")

    monkeypatch.setattr(blocking, "EXACT_PRODUCTS", 0)
    monkeypatch.setattr(blocking, "prefix_neighbours", prefix)
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, sql = registry.QUERIES[name](spark, SF).toPandas(), registry.ORACLE_SQL.get(name)
    if not sql:
        got, sql = got[["src_id", "cand_id"]], f"SELECT src_id, cand_id FROM ({registry.ORACLE_SQL['knn_tfidf_top20']})"
    assert len(got) and rows(got) == rows(duck.sql(sql).df())


def test_sweep_over_more_records_than_a_small_square(spark):
    """46,400 squared is beyond 32 bits."""
    n = 46_400
    m = spark.createDataFrame([(i, f"alpha beta w{i}" if i < 3 else "") for i in range(n)], "id1 long, affil1 string")
    row = sweep.k_sweep(m, (5,)).first()
    assert row["reduction_ratio"] == pytest.approx(1 - 5 / (n - 1), abs=1e-12) and row["avg_cosine"] == pytest.approx(6 / (5 * n), abs=1e-9)
