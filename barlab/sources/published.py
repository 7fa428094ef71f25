"""Keyed upserts that become visible at once.

Changed partitions are written aside as new versions of themselves; the commit is one small file that names the manifest of
partition versions. Readers follow the newest commit, so a write that stops midway changes nothing that is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from barlab.sources.signals import SIGNAL_KEY, latest_per_key, merge

PARTITION = ("signal_id", "period")


class PublishedSignals:
    """A prediction table at ``path``: ``data`` holds partition versions (signal_id, period, version), ``manifests`` which of them count."""

    def __init__(self, spark: SparkSession, path: str, period: str = "yyyy-MM"):
        self.spark, self.path, self.period = spark, path.rstrip("/"), period
        jvm = spark.sparkContext._jvm
        self._at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._at("commits").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[int]:
        """Numbers of the committed states, oldest first."""
        folder = self._at("commits")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit() and s.getLen() > 0)

    def manifest(self, commit: int | None = None) -> DataFrame | None:
        """(signal_id, period, version) of a committed state, the newest by default; None before the first."""
        known = self.commits()
        if not known:
            return None
        name = self.spark.read.text(f"{self.path}/commits/{known[-1] if commit is None else commit}").first().value
        return self.spark.read.schema("signal_id string, period string, version string").parquet(f"{self.path}/manifests/{name}")

    def read(self, commit: int | None = None) -> DataFrame | None:
        """The table as of a commit. The manifest joins on partition columns, so only the files of its versions are read."""
        manifest = self.manifest(commit)
        if manifest is None:
            return None
        data = self.spark.read.option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        data = data.withColumns({c: F.col(c).cast("string") for c in (*PARTITION, "version")})
        return data.join(manifest, [*PARTITION, "version"], "left_semi").drop("version", "period")

    def upsert(self, incoming: DataFrame, order: str | None = None) -> int:
        """Merge ``incoming`` by key and publish the result; the number of the new commit.

        Of several incoming rows with one key the last by ``order`` stays. Columns or types that differ from the table's raise
        before anything is written. Only touched partitions are read and written again. Of two writers that started from one
        state the second to commit fails and its versions stay unseen.
        """
        known = self.commits()
        now = known[-1] if known else 0
        new = latest_per_key(incoming.withColumn("signal_id", F.col("signal_id").cast("string")), F.col(order) if order else F.lit(1))
        new = new.drop(order) if order else new
        old = self.read(now) if known else None
        if old is not None:
            stored, given = ({f.name: f.dataType for f in df.schema.fields} for df in (old, new))
            if stored != given:
                raise ValueError(f"columns differ from the table's: {given} instead of {stored}")
        version = uuid.uuid4().hex
        placed = lambda df: df.withColumn("period", F.date_format("ts", self.period))
        touched = placed(new).select(*PARTITION).distinct()
        merged = placed(new if old is None else merge(placed(old).join(touched, list(PARTITION), "left_semi").select(*new.columns), new, SIGNAL_KEY))
        self._write_versions(merged.withColumn("version", F.lit(version)))
        written = touched.withColumn("version", F.lit(version))
        manifest = self.manifest(now) if known else None
        if manifest is not None:
            written = manifest.join(touched, list(PARTITION), "left_anti").unionByName(written)
        written.write.parquet(f"{self.path}/manifests/{version}")
        self._commit(now + 1, version)
        return now + 1

    def _write_versions(self, rows: DataFrame) -> None:
        columns: Sequence[str] = (*PARTITION, "version")
        rows.repartition(*columns, F.to_date("ts")).write.mode("append").partitionBy(*columns).parquet(f"{self.path}/data")

    def _commit(self, number: int, version: str) -> None:
        """Create the commit's file, which fails if another writer has it; until it has its content readers pass over it."""
        out = self._fs.create(self._at(f"commits/{number}"), False)
        try:
            out.writeBytes(version)
        finally:
            out.close()
