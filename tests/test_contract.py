"""Driver contract: entry point, registry consistency and a sample of oracle checks."""

import duckdb
import pytest

import __spark_entry__ as E
from nomina.sources.tables import TABLES

ORACLE_SAMPLE = ["agg11_category_stats", "agg10_group_compare", "sta01_gini", "sta02_gini_by_group",
                 "sta08_lorenz", "win01_pct_rank_avg", "joi01_enrich_body", "scl02_money_auto",
                 "val01_row_rules", "gen02_stratified_sample", "str01_progress_upsert", "pip09_inequality_report"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) >= {"categoria_organismo", "n", "promedio", "mediana"}


def test_oracles_are_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 150


def _norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", ORACLE_SAMPLE)
def test_query_matches_oracle(spark, sf_small, duck, key):
    sdf = E.queries()[key](spark, sf_small)
    cur = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(sdf.columns)
    s = sorted("|".join(_norm(r[c]) for c in order) for r in sdf.collect())
    idx = [dcols.index(c) for c in order]
    d = sorted("|".join(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert s == d


PLAN_SAMPLE = ["agg01_summary_stats", "agg11_category_stats", "agg17_share_of_total", "sta01_gini", "sta09_outliers_iqr_top10",
               "sta14_histogram", "sta15_histogram_by_key", "flt02_quantile_trim", "joi09_scalar_compare",
               "win02_running_share", "pip09_inequality_report", "val17_slice_diff", "scl28_money_format"]


@pytest.mark.parametrize("key", PLAN_SAMPLE)
def test_plans_have_no_cross_joins_or_python_udfs(spark, sf_small, key):
    from tools.plan_audit import FORBIDDEN, plan_text

    text = plan_text(E.queries()[key](spark, sf_small))
    assert not [m for m in FORBIDDEN if m in text]


def test_top_k_plans_as_take_ordered(spark, sf_small):
    from tools.plan_audit import plan_text

    assert "TakeOrderedAndProject" in plan_text(E.queries()["srt01_top_salaries"](spark, sf_small))


def test_flagship_pushes_salary_filter_into_parquet(spark, sf_small):
    from tools.plan_audit import plan_text

    text = plan_text(E.queries()["agg11_category_stats"](spark, sf_small))
    assert "GreaterThanOrEqual(sueldo_bruto,100000.0)" in text
