import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["per_base_accuracy", "reliability_curve", "hard_segments_04", "ensemble_merge", "nearest_reference", "suffstats", "estimate_ne", "depth_rank", "split_time", "missing_mask", "paint_pieces", "edge_statistics", "em_fit", "range_count", "first_ancestor"]


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() >= 1


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50


@pytest.mark.parametrize("name", NAMES)
def test_rows_equal_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    places = [want.columns.index(c) for c in df.columns]
    key = lambda r: tuple(repr(round(x, 5) if isinstance(x, float) else x) for x in r)
    assert sorted(map(key, df.collect())) == sorted(key([r[i] for i in places]) for r in want.fetchall())
