"""Every query with SQL gives the same rows as DuckDB; some others are run and counted."""

import pytest
from compare import connect, differences
from conftest import SF_DIR

from marquee.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, ORACLE[name]) is None


@pytest.mark.parametrize(
    "name", ["movie_rating_variance", "movie_features", "user_window_stats", "user_rank_routed_lists"]
)
def test_same_as_sql_on_more_rows(spark, name):
    folder = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name,rows",
    [
        ("user_rank_two_tower", 1500),
        ("user_rank_model", 1500),
        ("user_rank_routed", 1500),
        ("lsh_neighbors", 5),
        ("rating_count_buckets", 200),
        ("chained_features", 200),
        ("crossed_feature", None),
        ("als_user_recs", 1500),
        ("als_item_recs", 2000),
        ("als_subset_recs", 60),
        ("item2vec_synonyms", None),
        ("lsh_neighbors_all", 2500),
        ("user_rank_fm", 1500),
        ("split_random", 2),
        ("split_by_time_approx", 2),
    ],
)
def test_runs(spark, name, rows):
    found = QUERIES[name](spark, SF_DIR).count()
    assert found == rows if rows else found > 0
