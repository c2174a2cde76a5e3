"""What the operators share: safe column picking, shared tables, word positions and hashes."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.session import settle, shared_dir  # noqa: F401

#: Java and RE2 class of a word character, by the contracts: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: 10,000 rows of a page or document table are some 30 MB; longer batches are cut to this many bytes.
CHUNK_BYTES = 12 << 20
#: Texts go to Python in Arrow batches of so many bytes (the text that passes it goes along whole), unless the session has a limit of its own.
BATCH_BYTES, BATCH_CONF, BATCH_DEFAULT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Tables of keys (a few numbers or a digest a row) are broadcast up to so many rows.
BROADCAST_ROWS = 200_000
#: Keys of more than 1/HOT of all rows are joined apart from the others.
HOT = 1024
_A = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def take(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under new names. Other columns, whatever they are called, can't clash."""
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_c{names.index(name)}").alias(alias) for alias, name in columns.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def short(keys: DataFrame) -> DataFrame:
    """A stored table of keys, to be broadcast if it is counted to have BROADCAST_ROWS at most; else it is joined by a shuffle."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def join_hot(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Stored rows with the columns of a stored table (_key once each, _n: how many of `rows` have it).

    how: inner or left. A table that is short is broadcast as a whole. Of a longer one, keys of more than total/HOT rows
    (HOT at most) are joined by broadcast, wherever their rows are; only the others are shuffled by key.
    """
    columns = [*rows.columns, *[c for c in table.columns if c not in ("_key", "_n")]]
    met = F.col(key) == F.col("_key")
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), met, how).select(*columns)
    hot = F.broadcast(table.where(F.col("_n") * HOT > total))
    easy = rows.join(hot, met).select(*columns)
    rest = rows.join(hot.select("_key"), met, "left_anti")
    return easy.unionByName(rest.join(table.where(F.col("_n") * HOT <= total), met, how).select(*columns))


def identity(doc_id: Column, key: Column) -> list[Column]:
    """What tells rows apart by id and key; a null id is a value of its own."""
    own = doc_id.cast("long")
    return [F.coalesce(own, F.lit(0)).alias("_id"), own.isNull().alias("_none"), key.alias("_key")]


def prune(docs: DataFrame, gone: DataFrame, twins: DataFrame, id_col: str, key: Callable[[list[Column]], Column], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """docs, all columns, without rows whose identity is in gone, and one row of each identity in twins.

    key makes a row's key of its columns, in order. keep may let go of rows where they are read (by _id, _none, _key).
    """
    flat, on = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))]), ["_id", "_none", "_key"]
    columns = [F.col(c) for c in flat.columns]
    left = keep(flat.select(*columns, *identity(columns[docs.columns.index(id_col)], key(columns)))).join(short(settle(gone.select(*on).distinct())), on, "left_anti")
    twins = settle(twins.select(*on).distinct())
    if not twins.isEmpty():
        twins = short(twins)
        left = left.join(twins, on, "left_anti").unionByName(left.join(twins, on, "left_semi").dropDuplicates(on))
    return left.select(*columns).toDF(*docs.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], id_col: str, text_col: str, label_col: str, rows: int, size: int) -> tuple[dict[int, list[str]], dict[int, int]]:
    """Texts of labelled rows that aren't held out, by label (0 and 1), and how many labelled ids there are.

    At most `rows` texts of each label, in the order of a hash of their ids, and at most `size` bytes of them: a text that
    doesn't fit what is left is skipped, and later ones that fit are taken. Equal rows are one; however many rows an id has,
    no more than `rows` are looked at.
    """
    marked = take(labels, doc_id=id_col, label=label_col).select(F.col("doc_id").cast("long").alias("_id"), F.col("label").cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).withColumn("_h", F.xxhash64("_id"))
    counts = {0: 0, 1: 0} | {r.label: r["count"] for r in marked.groupBy("label").count().collect()}
    picked = [marked.where(F.col("label") == k).orderBy("_h", "_id").limit(rows) for k in (0, 1)]
    chosen = F.broadcast(picked[0].union(picked[1]))  # 2 * rows rows at most
    texts = take(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = texts.join(chosen, F.col("doc_id") == F.col("_id")).select("label", "_h", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("_size", F.octet_length("text").cast("long")).withColumn("_key", F.xxhash64("text")).where(F.col("_size") <= size)
    found = settle(texts)  # read for its sizes, then for the texts that fit
    kept = []
    for k in (0, 1):
        room, seen = size, set()
        for r in found.where(F.col("label") == k).orderBy("_h", "doc_id", "_key").limit(rows).select("doc_id", "_key", "_size").collect():
            if r["_size"] <= room and (r.doc_id, r["_key"]) not in seen:
                seen.add((r.doc_id, r["_key"]))
                room -= r["_size"]
                kept.append((k, r.doc_id, r["_key"]))
    fits = F.broadcast(docs.sparkSession.createDataFrame(kept, "label int, doc_id long, _key long"))  # 2 * rows rows at most
    taken = found.join(fits, ["label", "doc_id", "_key"]).dropDuplicates(["label", "doc_id", "_key"]).select("label", "text", "_h", "doc_id", "_key").collect()
    out: dict[int, list[str]] = {0: [], 1: []}
    for r in sorted(taken, key=lambda r: (r["_h"], r.doc_id, r["_key"])):
        out[r.label].append(r.text)
    return out, counts


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chunks(batches, text: str, limit: int = CHUNK_BYTES):
    """Arrow batches cut so that a chunk's texts hold about `limit` bytes (one longer text is a chunk of its own)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        part, first = size // limit, 0
        for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]:
            yield batch.slice(first, end - first)
            first = end


def give_back() -> None:
    """Hands memory that is free back to the system. A Python worker outlives its task, and what it keeps adds up beside the JVM's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # malloc_trim is glibc's
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow for rows with whole texts: small batches, and an idle worker holds no more than what it remembers."""
    spark = df.sparkSession
    if spark.conf.get(BATCH_CONF, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))

    def lean(batches):
        def each():
            for batch in batches:
                yield batch
                give_back()

        yield from run(each())
        give_back()

    return df.mapInArrow(lean, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = max(1 << 20, n + 1)
        inverse = np.uint64(pow(int(_A), -1, 1 << 64))
        for name, base in (("up", _A), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte buffer begin and end."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + piece)))
        base, stop = int(starts[first]), int(ends[last - 1])
        up, down = _power(stop - base)
        with np.errstate(over="ignore"):
            total = np.empty(stop - base + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[buf[base:stop]] * up[: stop - base], out=total[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            out[first:last] = (total[e] - total[s]) * down[s]
        first = last
    return mix(out)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive entries, in order: one for each start that has n entries."""
    if len(h) < n:
        return h[:0]
    with np.errstate(over="ignore"):
        out, done, power, part, width, scale = None, 0, n, h, 1, _A
        while power:
            if power & 1:
                tail = part[done : done + len(h) - n + 1] if out is not None else part[: len(h) - n + 1]
                out = tail.copy() if out is None else out * scale + tail
                done += width
            power >>= 1
            if power:
                part = part[:-width] * scale + part[width:]
                scale, width = scale * scale, width * 2
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start+1, ... of every range, one range after another."""
    total = int(lengths.sum())
    step = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    if not len(s):
        return step[:0]
    step[0] = s[0]
    step[np.cumsum(n)[:-1]] = s[1:] - s[:-1] - n[:-1] + 1
    return np.cumsum(step)
