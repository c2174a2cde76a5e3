"""Snapshots in versions: readers see a whole version or the one before it, and a refresh writes only the buckets it touches.

A snapshot's rows are dealt to buckets by a hash of their key and lie in data/version=N/bucket=K. A
manifest per version, put in place by a rename once the data is there, says which version holds
each bucket. Readers take the newest manifest, so there is no moment without a snapshot; data that the
last two manifests don't name is removed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsgraph.session import names, remove


class Snapshot:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: StructType, buckets: int = 64) -> None:
        self.spark, self.folder, self.keys, self.schema, self.buckets = spark, folder.rstrip("/"), keys, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in names(self.spark, f"{self.folder}/manifests") if n.endswith(".json"))

    def manifest(self, version: int) -> dict[int, int]:
        """Which version's folder holds each bucket; a small file, read by the driver."""
        text = self.spark.read.text(f"{self.folder}/manifests/{version}.json", wholetext=True).first()
        return {int(k): v for k, v in json.loads(text.value).items()} if text else {}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest version, or some buckets of it."""
        known = self.versions()
        held = self.manifest(known[-1]) if known else {}
        paths = [f"{self.folder}/data/version={v}/bucket={k}" for k, v in sorted(held.items()) if buckets is None or k in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def write(self, rows: DataFrame) -> int:
        """A whole new version."""
        return self._put(rows, {}, None)

    def replace(self, rows: DataFrame, buckets: list[int]) -> int:
        """A version whose given buckets hold these rows (of these buckets only), and whose others stay as they are."""
        known = self.versions()
        held = self.manifest(known[-1]) if known else {}
        return self._put(rows, {k: v for k, v in held.items() if k not in set(buckets)}, buckets)

    def _put(self, rows: DataFrame, kept: dict[int, int], buckets: list[int] | None) -> int:
        known = self.versions()
        number = (known[-1] if known else 0) + 1
        data = f"{self.folder}/data/version={number}"
        columns = [f.name for f in self.schema.fields]
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn("bucket", self.bucket()).repartition("bucket").select(*columns, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        written = [int(n.removeprefix("bucket=")) for n in names(self.spark, data) if n.startswith("bucket=")]
        self._place(f"{number}.json", json.dumps(kept | {k: number for k in written}))
        self._clean()
        return number

    def _place(self, name: str, text: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = lambda n: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests/{n}")
        fs = path(name).getFileSystem(conf)
        out = fs.create(path(f"_{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(path(f"_{name}"), path(name)):
            raise OSError(f"another refresh has written version {name}")

    def _clean(self) -> None:
        known = self.versions()
        for old in known[:-2]:
            remove(self.spark, f"{self.folder}/manifests/{old}.json")
        named = {v for n in known[-2:] for v in self.manifest(n).values()}
        for folder in names(self.spark, f"{self.folder}/data"):
            if int(folder.removeprefix("version=")) not in named and folder != f"version={known[-1]}":
                remove(self.spark, f"{self.folder}/data/{folder}")
