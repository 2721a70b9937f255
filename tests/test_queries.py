import pytest
from compare import DATA, check, views


from kartei.oracle import SQL
from kartei.queries import QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    return views(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, tables, name):
    check(spark, tables, DATA, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"folder_audit", "folder_placement"}))
def test_other_queries_run(spark, name):
    QUERIES[name](spark, str(DATA)).collect()


@pytest.mark.parametrize("name", ["era_gaps", "era_dominant", "time_strata", "folder_profiles", "pair_similarity", "closest_similarity", "leave_one_out_fit", "verdict_bands"])
def test_folders_over_the_limit_are_whole(spark, tables, name, monkeypatch):
    from functools import partial

    from kartei import queries as Q
    from kartei.operators import clustering as C

    monkeypatch.setattr(Q, "Settings", partial(Q.Settings, max_files_per_folder=5))
    monkeypatch.setattr(C, "BLOCK", 3, raising=False)
    check(spark, tables, DATA, QUERIES[name], SQL[name])
