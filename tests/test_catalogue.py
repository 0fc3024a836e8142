import duckdb
import pytest

import __spark_entry__
from palimpsest import catalogue

D = "/root/testdata/sf0.001"


def rows(df):
    names = sorted(df.columns)
    clean = df[names].astype(object).where(df[names].notna(), None)
    return sorted(repr(tuple(round(float(v), 9) if isinstance(v, float) else v for v in r)) for r in clean.values.tolist())


@pytest.mark.parametrize("name", ["fp64_embeddings", "hamming_pairs_lt22", "band_join_pairs", "dist128_pairs", "dup_groups", "move_plan", "csv_rows", "resize_r8_9x9_linear", "dhash_r8", "dct_hash_r32", "resize_rgba16_9x9_linear", "dhash_rgba16", "hash_by_name_r32", "hash_specs", "summary_line", "ids_to_paths", "png_kinds_r8", "load_errors_r8", "filter_weights", "file_ids", "compare_target", "knn_hamming", "pivot_join_pairs", "order_statistics_embeddings", "resize_rgba16_9x9_filters", "unpremultiplied_rgba8", "unpremultiplied_rgba16", "ycbcr_planes", "wide_links", "wide_group_members"])
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("embeddings", "pages", "documents"):
        db.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, D).toPandas(), db.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
