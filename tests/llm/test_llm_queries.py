import pytest
from compare import DATA, check, views


from kartei.llm import queries as Q

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    return views(DATA)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_agrees_with_sql(spark, tables, name):
    check(spark, tables, DATA, Q.queries()[name], Q.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_other_queries_run(spark, name):
    Q.queries()[name](spark, str(DATA)).collect()
