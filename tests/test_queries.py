import duckdb
import pytest

import __spark_entry__ as entry_point
from quillon import registry

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    def plain(v):
        return round(v, 3) if isinstance(v, float) else v

    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(str([plain(r[k]) for k in order]) for r in found)


@pytest.mark.parametrize("name", ["a08_upsert_catalogue", "b05_move_language_tags", "d06_recommend", "f04_semantic_topk_queries", "f06_cover_topk", "f09_refresh_index", "h02_click_log_entries", "k02_preprocess_stored", "w1_ingest", "w2_recommend_page"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "part orders customer nation events embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_entry_and_registration(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(registry.QUERIES) and set(entry_point.oracle_sql()) <= set(entry_point.queries())
