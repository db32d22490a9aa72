import pytest

from compare import check, connect
from graphloom.operators import experiment
from graphloom.plans import catalog, oracles


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE_SQL:
        check(df, con, catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_oracles_name_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize(("name", "rows"), [("report_console", experiment.console_rows), ("report_latex", experiment.latex_rows)])
def test_report_of_every_mean(spark, con, name, rows):
    """All means that 200 grades can have, halves of a cent among them, against the SQL's own expression."""
    means = [f"{at} / 200D as {m}" for m, at in zip(experiment.METRICS, ("id", "(1200 - id)", "(id + 1)"), strict=True)]
    summary = spark.range(200, 1001).selectExpr("'arch_' || id as arch", *means)
    given = f"(select 'arch_' || id as arch, {', '.join(means).replace('200D', '200::double')} from range(200, 1001) t(id))"
    sql = oracles.SQL[name].replace(f"with {oracles.RESULTS} ", "").replace(f"({oracles.REPORT})", given)
    assert "benchmark" not in sql
    check(rows(summary), con, sql)
