"""Keyed state in buckets, kept as Parquet between micro-batches.

Keys are dealt into buckets by hash.  A batch reads and rewrites only the buckets of its own
keys (``data/v=<batch>/bucket=<b>``); a commit, written last, says which version of every
bucket counts (``log/v=<batch>``, a row a bucket).  A batch that is replayed finds its commit
and does nothing; one that died before its commit is done again over the same files.
Versions that neither of the last two commits names are removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32


class BucketedState:
    """State under ``base``, keyed by column ``key``.  ``buckets`` is fixed by the first commit."""

    def __init__(self, spark: SparkSession, base: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.base, self.key, self.buckets = spark, base.rstrip("/"), key, buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")

    def _files(self):
        path = self._path("")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        """Numbers of the committed batches, in order."""
        fs = self._files()
        if not fs.exists(self._path("log")):
            return []
        found = [s.getPath() for s in fs.listStatus(self._path("log"))]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and fs.exists(self._path(f"log/{p.getName()}/_SUCCESS")))

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The version of every bucket that has one, after the last commit (``before`` a batch)."""
        own = [c for c in self.commits() if before is None or c < before]
        if not own:
            return {}
        rows = self.spark.read.parquet(f"{self.base}/log/v={own[-1]}").collect()  # a row a bucket
        self.buckets = rows[0]["buckets"] if rows else self.buckets
        return {r["bucket"]: r["version"] for r in rows if r["version"] is not None}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def read(self, versions: dict[int, int] | None = None) -> DataFrame | None:
        """The state, or some buckets of it; None if there is none yet."""
        versions = self.versions() if versions is None else versions
        if not versions:
            return None
        paths = [f"{self.base}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        try:
            return self.spark.read.parquet(*paths)
        except AnalysisException:  # every key of these buckets is gone
            return None

    def update(self, batch_id: int, batch: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> bool:
        """Fold ``batch`` (rows with the key) into the buckets it meets: their next version is
        ``merge(current, batch)``.  False if the batch was committed before."""
        if batch_id in self.commits():
            return False
        versions = self.versions(batch_id)
        met = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # bucket numbers
        current = self.read({b: versions[b] for b in met if b in versions})
        if met:
            out = merge(current, batch).withColumn("bucket", self.bucket())
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/data/v={batch_id}")
        versions |= dict.fromkeys(met, batch_id)
        rows = [(b, versions.get(b), self.buckets) for b in range(self.buckets)]
        self.spark.createDataFrame(rows, "bucket int, version long, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/log/v={batch_id}")
        self._remove_old()
        return True

    def _remove_old(self) -> None:
        """Delete bucket versions that the last two commits do not name, and older commits."""
        done, fs = self.commits(), self._files()
        kept = {(v, b) for c in done[-2:] for b, v in self.versions(c + 1).items()}
        for status in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            name = status.getPath().getName()
            if not name.startswith("v=") or int(name[2:]) > done[-1]:
                continue
            own = [s.getPath() for s in fs.listStatus(status.getPath()) if s.getPath().getName().startswith("bucket=")]
            left = [p for p in own if (int(name[2:]), int(p.getName()[7:])) in kept]
            if not left:
                fs.delete(status.getPath(), True)
                continue
            for p in own:
                if p not in left:
                    fs.delete(p, True)
        for c in done[:-2]:
            fs.delete(self._path(f"log/v={c}"), True)
