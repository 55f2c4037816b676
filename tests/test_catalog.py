"""Every query against its SQL, and every plan against the flagship."""

import pytest
from compare import check_query

from ledgerlight.plans.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    assert check_query(spark, SF, QUERIES[name], ORACLE[name])


def test_prefix(spark):
    from ledgerlight.sources.tables import lineitem, prefix

    df = lineitem(spark, SF, position=True)
    assert prefix(df, 0.1).count() == 60_000
    tenth = prefix(df, 0.1, whole=60_000)
    assert tenth.count() == 6000 and tenth.agg({"row_pos": "max"}).first()[0] == 5999
    # positions restart in each file
    two = df.withColumn("row_file", (df.row_pos >= 25_000).cast("string")).withColumn("row_pos", df.row_pos % 25_000).filter("row_pos < 25000")
    n = two.groupBy("row_file").agg({"row_pos": "max"}).count()
    assert n == 2 and prefix(two.dropDuplicates(["row_file", "row_pos"]), 0.5, whole=50_000).count() == 25_000


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())
