"""Every query of the subpackage: against its SQL where it has one, else by running it."""

import pytest

from glyphdrift.llm.queries import oracle_sql, queries
from tests.oracle import same_rows

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    if name in SQL:
        same_rows(df, SQL[name], sf_dir)
    else:
        assert df.count() > 0
