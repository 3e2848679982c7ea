"""A table with one row a key, kept up by batches: of each key the row that is newest by event time.

Rows lie in buckets by key. A batch reads and writes again the buckets that its keys fall into, and no earlier batch; a manifest then
names for each bucket the version that counts. A batch that runs again after a failure starts from the manifest before it and
gives the same table. A key whose row says that it has nothing any more keeps that row, so that older news about it, coming late,
can't bring back what is gone.

Defined results: of equal times the later batch counts, within a batch the greatest row; a null time is older than any other; null keys
are kept like others; repeated rows are one; an empty batch changes nothing, and a table without batches is empty. Batches may have
columns in any order and further ones, which are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.manifest import Manifests
from ..sources.storage import stored


class Kept:
    """schema has the keys, at (the event time) and whatever else; buckets may grow with the table, up to some thousands."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.columns = [f.name for f in StructType.fromDDL(schema)]
        self.schema = StructType.fromDDL(f"{schema}, batch long")
        self.manifests = Manifests(spark, f"{path}/manifests")

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.columns if c not in self.keys and c != "at"]
        return rows.groupBy(*self.keys, "bucket").agg(F.max(F.struct("at", "batch", *rest)).alias("r")).select(*self.keys, "r.*", "bucket")

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes in the batch of this number; batches come in order of their numbers."""
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets))
        rows = stored(self._newest(batch.select(*self.columns).withColumn("batch", F.lit(number).cast("long")).withColumn("bucket", bucket)))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]
        if not touched:
            return
        versions = self.manifests.newest(below=number)[1].get("buckets", {})
        old = self._of({b: versions[str(b)] for b in touched if str(b) in versions}).withColumn("bucket", bucket)
        merged = self._newest(old.unionByName(rows)).select(*self.columns, "batch", "bucket")
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={number}")
        self.manifests.publish(number, {"buckets": versions | {str(b): number for b in touched}})

    def _of(self, versions: dict) -> DataFrame:
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in versions.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows that count now."""
        return self._of(self.manifests.newest()[1].get("buckets", {})).select(*self.columns)

    def vacuum(self) -> None:
        """Deletes versions of buckets that the newest manifest doesn't name, and older manifests. No reader may be at work on these."""
        number, content = self.manifests.newest()
        named = {(str(v), b) for b, v in content.get("buckets", {}).items()}
        for version in self.manifests.children(f"{self.path}/rows"):
            for b in self.manifests.children(f"{self.path}/rows/{version}"):
                if b.startswith("bucket=") and (version.removeprefix("version="), b.removeprefix("bucket=")) not in named:
                    self.manifests.delete(f"{self.path}/rows/{version}/{b}")
        for n in self.manifests.numbers():
            if n < number:
                self.manifests.delete(f"{self.manifests.folder}/{n}")
