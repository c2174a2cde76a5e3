"""An inbox of article files as a data source: read in batch or as a stream, each file moved by its outcome.

    spark.dataSource.register(Inbox)
    spark.readStream.format("inbox").options(path=..., state=...).load()

A file of gzip JSON is one object or an array of objects. A row that isn't valid comes with the
reason in `error`; so does a file that can't be read, as one row. A file with at least one valid row
is done, any other is bad. The stream numbers its batches: which files a batch has is written to
`state` before it is read, so a batch that is run again reads the same files, wherever they are by then.
What came of a file is written there by the task that read it; when a batch is committed its files go to
`completed` or `failed` below `state`, under another name if theirs is taken.

Options: path (the inbox), state (a folder of the shared store), files (most per batch), body and
title (least characters), pattern (file name's end). Paths are URIs of any store that pyarrow
opens. Files are read one at a time, so a task holds one.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "url string, outlet string, country string, media string, title string, author string, language string, section string, published string, body string, tags array<string>, opinion boolean, official boolean, metadata map<string,string>, file string, error string"
TEXTS = ("url", "outlet", "country", "media", "title", "author", "language", "section", "published", "body")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _row(found, name: str, title: int, body: int) -> tuple:
    """An object of a file as a row, with the first rule that it breaks."""
    if not isinstance(found, dict):
        return (*[None] * len(TEXTS), None, None, None, None, name, "no_object")
    texts = {c: _text(found.get(c)) for c in TEXTS}
    length = lambda c: len((texts[c] or "").strip())
    missing = [c for c in ("url", "title", "body") if not length(c)]
    error = f"missing_{missing[0]}" if missing else "short_title" if length("title") < title else "short_body" if length("body") < body else None
    tags, flags, more = found.get("tags"), [found.get(c) for c in ("opinion", "official")], found.get("metadata")
    tags = tags.split(",") if isinstance(tags, str) else tags
    tags = [str(t).strip() for t in tags] if isinstance(tags, list) else None
    flags = [f if isinstance(f, bool) else None for f in flags]
    more = {str(k): _text(v) for k, v in more.items()} if isinstance(more, dict) else None
    return (*texts.values(), tags, *flags, more, name, error)


def rows_of(data: bytes, name: str, title: int = 0, body: int = 0) -> list[tuple]:
    """All rows of a file's bytes; one with an error if they can't be read."""
    try:
        found = json.loads(gzip.decompress(data))
    except (OSError, EOFError, ValueError) as e:
        return [(*[None] * len(TEXTS), None, None, None, None, name, f"unreadable: {type(e).__name__}")]
    found = found if isinstance(found, list) else [found]
    return [_row(x, name, title, body) for x in found] or [(*[None] * len(TEXTS), None, None, None, None, name, "empty")]


class File(InputPartition):
    def __init__(self, batch: int, name: str) -> None:
        super().__init__(name)
        self.batch, self.name = batch, name


class _Folder:
    """The inbox and what is known of its files."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")
        self.state = options.get("state", "").rstrip("/")
        self.most, self.pattern = int(options.get("files", 100)), options.get("pattern", ".json.gz")
        self.title, self.body = int(options.get("title", 0)), int(options.get("body", 0))

    def names(self) -> list[str]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name.endswith(self.pattern))

    def put(self, place: str, value) -> None:
        """A file of the state, whole or not at all."""
        store, root = _store(self.state)
        folder, _, name = f"{root}/{place}".rpartition("/")
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_{name}") as out:
            out.write(json.dumps(value).encode())
        store.move(f"{folder}/_{name}", f"{folder}/{name}")

    def get(self, place: str, default=None):
        store, root = _store(self.state)
        try:
            with store.open_input_stream(f"{root}/{place}", compression=None) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return default

    def content(self, name: str, moved: str | None = None) -> bytes:
        """A file's bytes from the inbox, or from where its outcome has brought it."""
        places = [(self.path, name), *([(f"{self.state}/{kind}", moved) for kind in ("completed", "failed")] if moved else [])]
        for base, at in places:
            store, root = _store(base)
            try:
                with store.open_input_stream(f"{root}/{at}", compression=None) as f:
                    return f.read()
            except FileNotFoundError:
                continue
        raise FileNotFoundError(name)


class BatchReader(DataSourceReader):
    """All files that stand in the inbox; none is moved."""

    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def partitions(self) -> list[File]:
        return [File(0, name) for name in self.folder.names()]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition is None:
            return
        yield from rows_of(self.folder.content(partition.name), partition.name, self.folder.title, self.folder.body)


class StreamReader(DataSourceStreamReader):
    """Offsets are numbers of batches; files of a batch are listed in the state before it begins."""

    def __init__(self, options: dict) -> None:
        if not options.get("state"):
            raise ValueError("a stream of an inbox needs the option state")
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        known = self.folder.get("known", {"batch": 0, "names": []})
        taken = set(known["names"])
        fresh = [n for n in self.folder.names() if n not in taken][: self.folder.most]
        if fresh:
            number = known["batch"] + 1
            self.folder.put(f"batches/{number}", fresh)
            self.folder.put("known", {"batch": number, "names": sorted(taken | set(fresh))})
            return {"batch": number}
        return {"batch": known["batch"]}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return [File(k, name) for k in range(start["batch"] + 1, end["batch"] + 1) for name in self.folder.get(f"batches/{k}", [])]

    def read(self, partition: File) -> Iterator[tuple]:
        place = f"outcomes/{partition.batch}/{partition.name}.json"
        before = self.folder.get(place) or {}
        rows = rows_of(self.folder.content(partition.name, before.get("moved")), partition.name, self.folder.title, self.folder.body)
        valid = sum(r[-1] is None for r in rows)
        self.folder.put(place, before | {"rows": valid, "errors": len(rows) - valid})
        yield from rows

    def commit(self, end: dict) -> None:
        """Moves the files of all batches up to this one that have been read; names are free again once a file is moved."""
        done = self.folder.get("moved", 0)
        for k in range(done + 1, end["batch"] + 1):
            names = self.folder.get(f"batches/{k}", [])
            for name in names:
                self._move(k, name)
            known = self.folder.get("known")
            self.folder.put("known", {"batch": known["batch"], "names": sorted(set(known["names"]) - set(names))})
            self.folder.put("moved", k)

    def _move(self, batch: int, name: str) -> None:
        from pyarrow import fs

        place = f"outcomes/{batch}/{name}.json"
        outcome = self.folder.get(place)
        if outcome is None:
            return  # never read: it stays
        store, root = _store(f"{self.folder.state}/{'completed' if outcome['rows'] else 'failed'}")
        store.create_dir(root, recursive=True)
        at = outcome.get("moved")
        if not at:
            at = name
            if store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                stem = name[: -len(self.folder.pattern)]
                at = f"{stem}_{batch}{self.folder.pattern}"
            self.folder.put(place, outcome | {"moved": at})  # before it goes, so that a batch that is run again finds it
        source, source_root = _store(self.folder.path)
        if source.get_file_info(f"{source_root}/{name}").type != fs.FileType.NotFound:
            source.move(f"{source_root}/{name}", f"{root}/{at}")


class Inbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(dict(self.options))


def put_file(path: str, name: str, data: bytes) -> None:
    """Puts a file into an inbox."""
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(data)


def ingest(spark, path: str, target: str, files: int = 100, title: int = 0, body: int = 0) -> None:
    """All that an inbox holds: rows to target/rows by batch and kind (none, or the rule they break), files to target/inbox/completed or failed.

    Each batch's files are read once and its rows written once; run again, it goes on where it stopped.
    """
    from pyspark.sql import functions as F

    spark.dataSource.register(Inbox)
    options = {"path": path, "state": f"{target}/inbox", "files": str(files), "title": str(title), "body": str(body)}

    def sort_out(batch, number: int) -> None:  # a batch that is run again replaces its own rows
        kind = F.coalesce(F.split("error", ":")[0], F.lit("none"))
        batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{target}/rows/batch={number}")

    reader = StreamReader(options)
    while True:  # a run has one batch: Spark asks such a source once for what is available
        rows = spark.readStream.format("inbox").options(**options).load()
        rows.writeStream.foreachBatch(sort_out).option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start().awaitTermination()
        known = reader.folder.get("known", {"batch": 0, "names": []})
        reader.commit({"batch": known["batch"]})  # it is over, and Spark commits a batch only when the next begins
        if not set(reader.folder.names()) - set(known["names"]):
            return


def outcomes(spark, target: str):
    """(file, folder, rows, errors) of all files that were moved."""
    from pyspark.sql import functions as F

    told = spark.read.schema("rows long, errors long, moved string").option("recursiveFileLookup", True).json(f"{target}/inbox/outcomes")
    folder = F.when(F.col("rows") > 0, "completed").otherwise("failed")
    return told.where("moved is not null").select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("file"), folder.alias("folder"), "rows", "errors", "moved")
