"""Every registered query against its DuckDB equivalent."""

import pytest
from compare import assert_same
from conftest import DATA

from noticeengine import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert_same(QUERIES[name](spark, str(DATA)), duck.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["daily_brief_sections", "bm25_topk", "link_card_versions", "kg_edges"])
def test_partitions_do_not_matter(spark, name):
    def got(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return sorted(map(repr, QUERIES[name](spark, str(DATA)).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert got("1") == got("13")
