"""The training-data queries that SQL can express, and what is registered."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from hostledger.llm import oracle, queries
from verification import compare


def test_one_query_for_each_operator():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run and set(names) <= set(entry.queries())


@pytest.mark.parametrize("name", list(oracle.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    con = compare.connect(sf_dir)
    assert compare.differences(spark, con, sf_dir, queries.queries()[name], oracle.oracle_sql()[name]) is None
