"""Queries with SQL against DuckDB, on rows with nulls, ties, copies and long texts."""

import pytest

from nomina.llm import catalog
from tests.llm.conftest import oracle, rows_of

EMPTY = {"op1_token_counts", "op2_decontaminate", "op3_licence_scan", "op4_host_rules", "op5_histogram_sort", "op6_ngram_jaccard",
         "op7_language_id", "op8_mix_sources", "op9_toxicity", "op10_line_blocks", "op11_simhash", "op12_align_tokens", "op13_prefix_trie"}


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_nasty_rows_match_sql(spark, nasty, name):
    got = catalog.QUERIES[name](spark, nasty).toPandas()
    assert rows_of(got) == rows_of(oracle(catalog.ORACLES[name], nasty))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_driver_rows_match_sql(spark, sf_small, name):
    got = catalog.QUERIES[name](spark, sf_small).toPandas()
    assert rows_of(got) == rows_of(oracle(catalog.ORACLES[name], sf_small))


def test_all_are_registered():
    assert set(catalog.QUERIES) == EMPTY


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables(spark, empty, name):
    got = catalog.QUERIES[name](spark, empty)
    assert got.columns and got.collect() == []
