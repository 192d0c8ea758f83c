"""CSV as other programs write it: Python's csv module writes, the library reads, and back."""

import csv
import io
import os
import random
import uuid


from nomina.session import scratch_path
from nomina.sources import files as FS
from nomina.sources import sinks as SK

ROWS = [["Luis \"x\", hijo", "9"], ["dos\nlíneas", "10"], ["a\n\n\"b\"\n", "11"], [" fuera ", "12"], ["", "13"], ["\"", "14"], ["x,y;z", "15"], [",", "16"]]


def folder(spark) -> str:
    at = scratch_path(spark, f"csv-{uuid.uuid4().hex[:8]}").replace("file:", "")
    os.makedirs(at)
    return at


def written(rows, sep=",", end="\n", before="", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end, quoting=quoting)
    w.writerows([["Nombre", "Sueldo"], *rows])
    return before + out.getvalue()


def values(df):
    return sorted((r.Nombre or "", r.Sueldo) for r in df.collect())


def test_quotes_line_breaks_and_empty_lines(spark):
    want = sorted((a, b) for a, b in ROWS)
    for i, (sep, end, before, encoding) in enumerate([(",", "\n", "", "utf-8"), (";", "\r\n", "\r\n\r\n", "latin-1"), ("\t", "\n", "  \n\n", "utf-8")]):
        at = folder(spark)
        with open(f"{at}/t{i}.csv", "w", encoding=encoding, newline="") as f:
            f.write(written(ROWS, sep, end, before))
        (d,) = FS.file_dialects(spark, at).collect()
        assert (d.sep, d.encoding, d.multi_line) == (sep, "UTF-8" if encoding == "utf-8" else FS.LATIN1, True)
        assert values(FS.csv_dialect_scan(spark, at)) == want
        assert values(FS.csv_scan(spark, at, sep=sep, encoding=d.encoding)) == want


def test_a_file_with_an_empty_first_line_is_read(spark):
    root = folder(spark)
    os.makedirs(f"{root}/sii/2025-09")
    for name, text in (("a.csv", "\n\nNombre,Sueldo\nAna,1\n\nEva,2\n"), ("b.csv", "Nombre,Sueldo\n\"Luis \"\"x\"\", hijo\",9\n"), ("c.csv", "\n\n"), ("d.csv", written(ROWS[1:3]))):
        with open(f"{root}/sii/2025-09/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    got = sorted((r.archivo_origen, r.Nombre, r.Sueldo, r.fuente, r.periodo) for r in FS.month_dir_scan(spark, root).collect())
    assert got == [("a.csv", "Ana", "1", "sii", "2025-09"), ("a.csv", "Eva", "2", "sii", "2025-09"), ("b.csv", 'Luis "x", hijo', "9", "sii", "2025-09"),
                   ("d.csv", "a\n\n\"b\"\n", "11", "sii", "2025-09"), ("d.csv", "dos\nlíneas", "10", "sii", "2025-09")]


def test_delimiters_inside_quotes_do_not_vote(spark):
    at = folder(spark)
    with open(f"{at}/t.csv", "w") as f:
        f.write('Nombre;Sueldo\n"a, b, c";1\n"d, e, f";2\n')
    assert FS.file_dialects(spark, at).first().sep == ";"


def test_records_across_splits(spark):
    """Splits of a few hundred bytes cut records and quoted fields anywhere."""
    r = random.Random(3)
    rows = [["".join(r.choice(["a", "\n", "\"", ",", " ", "é"]) for _ in range(r.randrange(90))), str(i)] for i in range(300)]
    at = folder(spark)
    with open(f"{at}/t.csv", "w", encoding="utf-8", newline="") as f:
        f.write(written(rows, quoting=csv.QUOTE_ALL))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in zip(keys, ("300", "0", "60"), strict=True):
            spark.conf.set(k, v)
        records = FS.csv_records(spark, at)
        assert spark.read.text(at).rdd.getNumPartitions() > 20
        assert values(FS.csv_scan(spark, at)) == sorted((a, b) for a, b in rows)
        assert records.where("_first").count() == 1 and records.count() == 301
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_what_is_written_other_readers_read(spark):
    at = folder(spark)
    df = spark.createDataFrame([(a, b, "2025-09") for a, b in ROWS if a], "Nombre string, Sueldo string, periodo string")
    dated, latest = SK.write_dated_and_latest(df, f"{at}/s")
    df.write.parquet(f"{at}/t")
    for where in (dated, latest, SK.export_csv(spark, f"{at}/t", f"{at}/e")):
        got = []
        for folder_, _, names in os.walk(where.replace("file:", "")):
            for n in names:
                if n.endswith(".csv"):
                    with open(f"{folder_}/{n}", encoding="utf-8", newline="") as f:
                        got += [(x["Nombre"], x["Sueldo"]) for x in csv.DictReader(f)]
        assert sorted(got) == sorted((a, b) for a, b in ROWS if a)
    assert values(FS.csv_scan(spark, latest).select("Nombre", "Sueldo")) == sorted((a, b) for a, b in ROWS if a)


def test_no_file_and_empty_files(spark):
    at = folder(spark)
    open(f"{at}/e.csv", "w").close()
    assert FS.csv_dialect_scan(spark, at) is None
