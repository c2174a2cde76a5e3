"""Article feeds, page snapshots and RSS, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.functions import html, urls
from newsgraph.session import settle

ARTICLE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("url", "outlet", "country", "media", "title", "author", "language", "section", "published", "body", "html", "state")]
    + [T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("opinion", T.BooleanType()), T.StructField("official", T.BooleanType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("_corrupt_record", T.StringType())]
)


def read_articles(spark: SparkSession, path: str, schema: T.StructType = ARTICLE) -> DataFrame:
    """*.json.gz files of one object or an array of objects; a file that can't be read gives no rows. Adds file."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json.gz").option("ignoreCorruptFiles", True).json(path)
    return rows.withColumn("file", F.col("_metadata.file_name")).where("_corrupt_record IS NULL").drop("_corrupt_record")


def stream_articles(spark: SparkSession, path: str, schema: T.StructType = ARTICLE, archive: str | None = None, files: int = 100) -> DataFrame:
    """The same directory as a stream; each file once, by the checkpoint. archive: where read files go."""
    reader = spark.readStream.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json.gz").option("maxFilesPerTrigger", files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(path).where("_corrupt_record IS NULL").drop("_corrupt_record")


def write_feed(rows: DataFrame, path: str, size: int = 500) -> DataFrame:
    """Rows to *.json.gz files of an array of up to so many objects each, nulls left out: (file, rows) of what was written."""

    def run(batches):
        import gzip
        import json
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                part = [{k: v for k, v in row.items() if v is not None} for row in batch.slice(first, size).to_pylist()]
                name = f"{uuid.uuid4().hex}.json.gz"
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(gzip.compress(json.dumps(part, ensure_ascii=False, default=str).encode()))
                yield pa.record_batch({"file": [name], "rows": [len(part)]})

    return settle(rows.mapInArrow(run, "file string, rows long"))


def ingest(spark: SparkSession, path: str, target: str, schema: T.StructType = ARTICLE, archive: str | None = None, files: int = 100, least: int = 0) -> None:
    """All files that a directory holds and hasn't been asked for, as a stream: rows go to target/batches with their file (part=rows); what can't be read, and
    rows with fewer than `least` characters of body, with the file and the reason (part=errors). Goes on from its checkpoint when run again."""
    reader = spark.readStream.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json.gz").option("maxFilesPerTrigger", files).option("ignoreCorruptFiles", True)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)

    def sort_out(batch: DataFrame, number: int) -> None:  # one write, so a batch's files are parsed once; a batch that is run again replaces its own rows
        reason = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(F.length(F.coalesce("body", F.lit(""))) < least, "short_body")
        marked = batch.withColumn("reason", reason).withColumn("row", F.when(reason.isNotNull(), F.coalesce("_corrupt_record", "url")))
        marked.withColumn("part", F.when(reason.isNull(), "rows").otherwise("errors")).drop("_corrupt_record").write.mode("overwrite").partitionBy("part").parquet(f"{target}/batches/batch={number}")

    rows = reader.json(path).withColumn("file", F.col("_metadata.file_name"))
    rows.writeStream.foreachBatch(sort_out).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows, and rows that were set aside (file, reason, row), of what ingest has written."""
    found = spark.read.parquet(f"{target}/batches")
    return found.where("part = 'rows'").drop("part", "reason", "row"), found.where("part = 'errors'").select("file", "reason", "row", "batch")


def read_pages(spark: SparkSession, path: str, rules: dict[str, list[str]] | None = None) -> DataFrame:
    """Stored pages (page_id, url, html) as article rows: url, outlet (the domain), title, body text, language, published."""
    pages = spark.read.parquet(path)
    meta, page = html.metadata(F.col("html")), F.col("html")
    title = html.by_site(page, urls.domain(F.col("url")), rules or {}, [r"(?is)<title[^>]*>(.*?)</title>", r"(?is)<h1[^>]*>(.*?)</h1>"])
    return pages.select("page_id", "url", urls.domain(F.col("url")).alias("outlet"), title.alias("title"), html.to_text(page).alias("body"), meta["language"].alias("language"), meta["publication_date"].alias("published"))


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link, description, published (text), category."""
    schema = "title string, link string, description string, pubDate string, author string, category array<string>"
    return spark.read.format("xml").option("rowTag", "item").schema(schema).load(path).withColumnRenamed("pubDate", "published")
