from pyspark.sql import functions as F

from nomina.llm import common


def test_batches_to_python_are_bounded_in_bytes(spark):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    rows = spark.range(0, 6000, 1, 1).select(F.expr("if(id = 5, repeat('y', 3000000), repeat('x', 2000))").alias("text"))
    got = common.map_batches(rows, run, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 6000
    assert sorted(r["size"] for r in got)[-2] <= 1.1 * common.BATCH_BYTES and len(got) > 5
