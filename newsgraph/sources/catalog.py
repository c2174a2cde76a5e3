"""What stored tables are made of, by listing and Parquet footers: no row is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.session import names


def files(spark: SparkSession, path: str) -> list[str]:
    """Paths of a table's data files: a partitioned table's listing, on the driver as Spark's own is."""
    return sorted(spark.read.parquet(path).inputFiles())


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, written, rows, groups) of the Parquet files below a folder; the footers are read where a task opens a file's end."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("written"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            rows, groups = [], []
            for name in batch["path"].to_pylist():
                store, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
                with store.open_input_file(at) as f:
                    found = pq.ParquetFile(f).metadata
                rows.append(found.num_rows)
                groups.append(found.num_row_groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64()), pa.array(groups, pa.int64())], [*batch.schema.names, "rows", "groups"])

    return listed.mapInArrow(run, "path string, bytes long, written timestamp, rows long, groups long")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(name, files, rows, bytes, written) of every table that stands in a folder; one without rows too."""
    every = spark.createDataFrame([(n,) for n in names(spark, folder) if not n.startswith(("_", "."))], "name string")  # a row a table
    base = folder.split(":", 1)[-1].lstrip("/").rstrip("/")
    name = F.split(F.split("path", base + "/")[1], "/")[0]
    told = footers(spark, folder).groupBy(name.alias("name")).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.max("written").alias("written"))
    return every.join(told, "name", "left").na.fill(0, ["files", "rows", "bytes"])
