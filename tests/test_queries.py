"""Every core query against its SQL, those without SQL by running them."""

import pytest

from glyphdrift.plans.catalog import QUERIES, SQL
from tests.oracle import same_rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_whole_pooled_side(spark, sf_dir):
    """Every clustered record meets the pooled table, the first work's too, and every pooled cluster is relabelled."""
    from glyphdrift.plans.catalog import assignments

    clustered = assignments(spark, sf_dir)
    votes = QUERIES["majority_vote_whole"](spark, sf_dir).groupBy().sum("total_sentences").first()[0]
    assert votes == clustered.count()
    assert QUERIES["dense_relabel_whole"](spark, sf_dir).groupBy().sum("n").first()[0] == clustered.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
