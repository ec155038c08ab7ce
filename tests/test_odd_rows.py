"""Queries against their SQL on rows that the given tables don't have."""

from datetime import datetime

import duckdb
import pytest
from compare import check

from loomgrid.plans.catalogue import QUERIES, SQL


@pytest.fixture
def same_rows(spark, tmp_path):
    def same(name, **tables):
        duck = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
            duck.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        check(QUERIES[name](spark, str(tmp_path)), SQL[name], duck)
        return duck.execute(SQL[name]).fetchall()

    return same


@pytest.mark.parametrize("texts", [["", "a"], [None, "a\n"], ["\n", "a\n\n"], ["a\r\nb", "a\rb\x0bc"]])
def test_text_stats_of_odd_texts(same_rows, texts):
    assert same_rows("a29_text_stats", documents=(list(enumerate(texts)), "doc_id long, text string"))


def test_text_stats_of_repeated_ids(same_rows):
    rows = [(1, "a"), (1, "b\nc"), (2, ""), (2, "d"), (3, None), (None, "e"), (4, None), (4, "f")]
    assert sorted(same_rows("a29_text_stats", documents=(rows, "doc_id long, text string"))) == [(1, 6, 3), (2, 2, 1), (4, 2, 1)]


def test_keyword_search_takes_the_first_twenty(same_rows):
    parts = [(k, "blue bolt" if k % 2 else "red bolt", "Brand#4", "SMALL", (None, 2, 10, 9, 1)[k % 5]) for k in range(1, 61)]
    uses = [(k, datetime(2024, 1, 1)) for k in (1, 1, 2)]
    got = same_rows("p09_keyword_search", part=(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"), lineitem=(uses, "l_partkey long, l_shipdate timestamp"))
    assert len(got) == 20
