"""How the work of some queries is spread: files of a landing, tables that are read once."""

import contextlib
import glob
import io
import os
import uuid

from pyspark.sql import functions as F

from nomina.operators.clusters import sparse_kmeans
from nomina.plans import catalog
from nomina.plans import pipelines as P
from nomina.plans.q_pipelines import _land_raw
from nomina.session import scratch_path
from tests.conftest import SF_SMALL


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def files(spark, pattern) -> set[str]:
    return set(glob.glob(f"{scratch_path(spark, pattern).replace('file:', '')}", recursive=True))


def test_landed_files_do_not_grow_with_the_range_of_ids(spark):
    at = scratch_path(spark, f"wide-{uuid.uuid4().hex[:8]}")
    for t in ("region", "nation", "customer"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").where("o_orderkey < 100")
    orders.withColumns({"o_orderkey": F.col("o_orderkey") * 8001, "o_orderstatus": F.lit("F"), "o_orderdate": F.lit("1995-03-01").cast("timestamp_ntz")}).write.parquet(f"{at}/orders.parquet")
    n, before = orders.count(), files(spark, "raw-quoted-*/**/*.txt")
    got = catalog.QUERIES["src06_csv_quoted_landing"](spark, at)
    assert n > 20 and got.count() == n and got.select("id").distinct().count() == n
    assert len(files(spark, "raw-quoted-*/**/*.txt") - before) == 2  # one of each dialect


def test_kmeans_joins_small_tables_of_levels_without_a_shuffle(spark):
    rows = [(i, float(i % 7), "abc"[i % 3], "xy"[i % 2]) for i in range(300)]
    out, _ = sparse_kmeans(spark.createDataFrame(rows, "id long, v double, k string, o string"), "v", ("k", "o"), k=3)
    shown = plan(out)
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown
    assert out.count() == 300 and out.columns == ["id", "v", "k", "o", "cluster"]


def test_raw_files_are_parsed_once(spark):
    root = _land_raw(spark, SF_SMALL)
    assert "FileScan csv" not in plan(P.consolidate_month(spark, root, None, "2025-09-30 00:00:00"))
    assert "FileScan csv" not in plan(P.monthly_etl(spark, root, None, "2025-09-30 00:00:00").clean)


def test_a_landing_of_documents_has_a_file_a_split(spark):
    before = files(spark, "landing-chg-*/*.parquet")
    got = catalog.QUERIES["str04_changed_content"](spark, SF_SMALL)
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet"))
    assert got.count() == docs.count() + docs.where("doc_id % 4 = 0").count()
    assert len(files(spark, "landing-chg-*/*.parquet") - before) == 8  # two landings on four cores
