"""WARC archives with an index first.

Pages of equal payload are found by digest; the one with the largest id is written as a
response, the others as revisits without payload. Only digests and ids are shuffled for
that; payloads stay where they are read unless repeats are too many to be broadcast, and
short ones always. Each task writes gzip-per-record .warc.gz files to the shared folder and
returns one index row per record: file, offset, length, URL, digest. The index is kept as a
table, so a lost executor costs a task, whose new files get new names and whose old ones are
in no index. Readers select records in the index, sort them by file and offset, coalesce
neighbouring byte ranges and read only those. The archives are the operator's product and
stay until their owner removes the folder.

Payloads below `least` bytes are always responses. Defined results: a null payload is
empty; payloads of any length are one record each; a null URL is written as an empty target;
white space, controls and percent signs of a URL that holds any white space or control are
percent-encoded in its header, and a header of its own says so, so it is read back as it
was; rows that repeat an id and a payload get a response each if they have the largest id,
else revisits; a null id is below all others and never a response while another row has the
payload; an empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Shorter payloads are not made revisits.
LEAST = 1000
#: Archive files are closed at this size; reads join ranges with gaps up to GAP, up to RANGE bytes.
FILE_BYTES, GAP, RANGE = 256 << 20, 64 << 10, 8 << 20
_DATE = "2024-01-01T00:00:00Z"
#: What stays in an encoded URL: all of ASCII that is printed, but the percent sign.
_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def assign(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload (binary), payload_digest, refers_to (null: a response)."""
    picked = common.take(pages, page_id=id_col, url=url_col, payload=payload_col)
    rows = picked.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_same", F.unhex(F.sha2("payload", 256)))
    long, short = rows.where(F.octet_length("payload") >= least), rows.where(F.octet_length("payload") < least)
    narrow = common.settle(long.select("page_id", "_same"))
    groups = narrow.groupBy("_same").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    groups = common.settle(groups.select(F.col("_same").alias("_key"), "_first", "_n"))
    refers = F.when(F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to")
    columns = ("page_id", "url", "payload", F.sha1("payload").alias("payload_digest"))
    if groups.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:  # short payloads go along in one pass over the table
        return rows.join(F.broadcast(groups), (F.col("_same") == F.col("_key")) & (F.octet_length("payload") >= least), "left").select(*columns, refers)
    joined = common.join_hot(long, groups, "_same", narrow.count(), "left").select(*columns, refers)
    return joined.unionByName(short.select(*columns, F.lit(None).cast("long").alias("refers_to")))


def _record(kind: str, page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    odd = any(c.isspace() or ord(c) < 32 for c in url)  # a header line can't hold these
    target = quote(url, safe=_SAFE) if odd else url
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if odd:
        head += ["X-Target-Encoding: percent"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and its payload (empty for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(assigned: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; the index as a stored table: page_id, url, payload_digest, record_type, refers_to, file, offset, length."""
    spark = assigned.sparkSession
    folder = folder or f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        import pyarrow as pa

        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for chunk in common.chunks(batches, "payload"):
                files, offsets, lengths, kinds = [], [], [], []
                for page_id, url, payload, digest, refers_to in zip(*(chunk[c].to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to")), strict=True):
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    kind = "response" if refers_to is None else "revisit"
                    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                    packed = packer.compress(_record(kind, page_id, url, payload, digest, refers_to)) + packer.flush()
                    out.write(packed)
                    files.append(name)
                    offsets.append(at)
                    lengths.append(len(packed))
                    kinds.append(kind)
                    at += len(packed)
                yield pa.record_batch({c: chunk[c] for c in ("page_id", "url", "payload_digest")} | {"record_type": pa.array(kinds, pa.string()), "refers_to": chunk["refers_to"], "file": pa.array(files, pa.string()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())})
        finally:
            if out is not None:
                out.close()

    index = assigned.mapInArrow(run, "page_id long, url string, payload_digest string, record_type string, refers_to long, file string, offset long, length long")
    index.write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index").withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def coalesce(rows, gap: int = GAP, most: int = RANGE):
    """Sorted (file, offset, length) to byte ranges (file, start, [(begin, end) of each record]): neighbours with gaps up to `gap` in one range of `most` bytes."""
    name, start, ends = None, 0, []
    for file, offset, length in rows:
        if name is not None and (file != name or offset > ends[-1][1] + gap or offset + length - start > most):
            yield name, start, ends
            name = None
        if name is None:
            name, start, ends = file, offset, []
        ends.append((offset, offset + length))
    if name is not None:
        yield name, start, ends


def read(selected: DataFrame, gap: int = GAP, most: int = RANGE, keep_payload: bool = True) -> DataFrame:
    """Selected index rows to records: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload."""
    ordered = selected.select("file", "offset", "length").sortWithinPartitions("file", "offset")

    def run(batches):
        import pyarrow as pa

        def records(name, start, ends):
            """Reads one range, which holds the records that end at `ends`."""
            store, path = _filesystem(name)
            with store.open_input_file(path) as source:
                raw = source.read_at(ends[-1][1] - start, start)
            for begin, end in ends:
                yield parse(zlib.decompress(raw[begin - start : end - start], 31))

        def table(found):
            rows = []
            for headers, payload in found:
                own = lambda key: int(x) if (x := headers[key].removeprefix("<urn:page:").rstrip(">")) else None
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                url = unquote(headers["WARC-Target-URI"]) if "X-Target-Encoding" in headers else headers["WARC-Target-URI"]
                rows.append((own("WARC-Record-ID"), url, headers["WARC-Type"], own("WARC-Refers-To") if "WARC-Refers-To" in headers else None, int(headers["X-Payload-Length"]), digest, payload if keep_payload else None))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
            return pa.record_batch({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

        for batch in batches:
            for name, start, ends in coalesce(zip(*(batch[c].to_pylist() for c in ("file", "offset", "length")), strict=True), gap, most):
                yield table(records(name, start, ends))

    return ordered.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(assign(common.table(spark, sf_dir, "pages")))
    return read(index, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= {LEAST} AND page_id < max(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= {LEAST} AND page_id < max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
FROM pages WINDOW g AS (PARTITION BY coalesce(html, ''))
"""
