"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the least hash among its
`minimiser`-word runs. Consecutive windows of a text that share a minimiser form a
super-k-mer: they travel as one packed string to the minimiser's bucket, so equal windows
always meet, and words are sent about three times instead of once per window. In a bucket
the windows are sorted by hash and equal hashes are verified by their bytes, so counting is
exact; every window but the earliest of its kind marks its words for removal.

Skew: runs of words that make up 2/summary of all runs or more (a mergeable Misra-Gries
summary finds them; at most `summary` hashes, whatever the input) come last in the order of
minimisers, so a frequent line or phrase attracts no windows with a context of their own.
Super-k-mers that repeat within a task are settled there, and only the first travels. The
number of buckets follows the bytes of all texts, and so does the summary up to a bound, so
that a run that is no frequent one stays small against a bucket. Strings are packed by task and
bucket; with many buckets that would leave scraps, so beyond `COARSE` buckets they travel in two steps,
to coarse buckets and from there to their own, and each packed string stays long. A bucket's windows are
sorted in as many passes as its words ask for, each over the windows of some hashes.

Order of documents: by id (null first), then by a hash of the text. Rows that repeat an id
and a text are one document and all get its result; equal ids with different texts are
different documents. Texts of any length are read whole (a longer one is a chunk of its own).
Defined results: null or empty texts have no words (0, 0, the hash of
the empty string); texts of fewer words than a window keep all; an empty table gives an
empty table. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 20
MINIMISER = 3
#: Texts of about so many bytes are taken apart at a time; strings are packed at this zstandard level.
CHUNK, LEVEL = 8 << 20, 6
#: Bytes of text for which there is a bucket, entries of the summary at most, and words of a bucket that are sorted in one pass.
BUCKET_BYTES, SUMMARY, PASS_WORDS = 4 << 20, 1 << 17, 1 << 22
#: Slices of fewer bytes aren't worth compressing.
SMALL = 512
#: More buckets than this are filled in two steps: as many coarse ones first, whose strings are then dealt to their buckets.
COARSE = 2048
#: Bytes of strings that a task of the second step reads, about, and that it takes apart at a time.
STEP_BYTES, STEP_CHUNK = 256 << 20, 16 << 20
_NULL_ID = -(1 << 63)
_HOT = np.uint64(1 << 63)
_BLANKS = bytes(32 if 9 <= b <= 13 else b for b in range(256))


class _Words:
    """The words of a chunk of texts: one buffer, positions, hashes, and the document each belongs to."""

    def __init__(self, texts) -> None:
        import pyarrow as pa
        import pyarrow.compute as pc

        raw = pc.fill_null(texts, "").cast(pa.binary()).to_pylist()
        self.buf = np.frombuffer(b"\n".join(raw).translate(_BLANKS), np.uint8)
        self.starts, self.ends = common.word_bounds(self.buf)
        self.hashes = common.word_hashes(self.buf, self.starts, self.ends)
        size = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        self.doc_first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(size))))  # first word of each document, and the end
        self.counts = np.diff(self.doc_first)


def _runs(words: _Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all m-word runs by start, and which lie within one document."""
    h = common.mix(common.rolled(words.hashes, m))
    h &= ~_HOT
    inside = np.ones(len(h), bool)
    for back in range(1, m):
        at = words.doc_first[1:-1] - back
        inside[at[(at >= 0) & (at < len(h))]] = False
    return h, inside


def frequent_runs(texts: DataFrame, m: int, size: int) -> np.ndarray:
    """Hashes of frequent m-word runs, sorted; at most `size` (texts: a column text).

    A task's counts fall short by up to 1/size of its runs, and 1/size of all is asked of what is left, so a run that makes
    up 2/size of all is always found.
    """

    def summarise(batches):
        import pyarrow as pa

        kept, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for chunk in common.chunks(batches, "text", CHUNK):
            h, inside = _runs(_Words(chunk["text"]), m)
            h, n = np.unique(h[inside], return_counts=True)
            total += int(n.sum())
            both = np.concatenate([kept, h])
            kept, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(kept)).astype(np.int64)
            if len(kept) > size:
                counts -= np.partition(counts, -size - 1)[-size - 1]
                kept, counts = kept[counts > 0], counts[counts > 0]
        if total:
            yield pa.record_batch({"h": pa.array([None, *kept.astype(np.int64).tolist()], pa.int64()), "n": pa.array([total, *counts.tolist()], pa.int64())})

    summed = texts.mapInArrow(summarise, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = summed.orderBy(F.desc("n")).limit(size + 1).collect()  # bounded by the summary's size
    total = next((r.n for r in top if r.h is None), 0)
    return np.array(sorted(r.h for r in top if r.h is not None and r.n * size > total), np.uint64)


def _pack(ids, keys, starts, counts, text: bytes) -> bytes:
    import zstandard

    head = b"".join(np.ascontiguousarray(x, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for x in (ids, keys, starts, counts))
    raw = struct.pack("<qq", len(ids), len(text)) + head + text
    return b"\0" + raw if len(raw) < SMALL else b"\1" + zstandard.ZstdCompressor(level=LEVEL).compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    import zstandard

    raw = blob[1:] if blob[0] == 0 else zstandard.ZstdDecompressor().decompress(blob[1:])
    n, size = struct.unpack_from("<qq", raw)
    head = [np.frombuffer(raw, np.uint8, 8 * n, 16 + 8 * n * i).reshape(8, n).T.copy().view(np.int64).ravel() for i in range(4)]
    return np.stack(head), raw[len(raw) - size :]


def _intervals(ids, keys, starts, window: int):
    """Windows (id, key, start) to merged runs (id, key, first word, end)."""
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts = ids[order], keys[order], starts[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(ids)]])[: len(first)] - 1
    return ids[first], keys[first], starts[first], starts[last] + window


def _same(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, part: int = 1 << 22) -> np.ndarray:
    """Whether buf[a:a+size] and buf[b:b+size] are equal, for each row."""
    equal, first, total = np.ones(len(a), bool), 0, np.cumsum(size)
    while first < len(a):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + part)))
        n = size[first:last]
        differ = buf[common.ranges(a[first:last], n)] != buf[common.ranges(b[first:last], n)]
        edges = np.concatenate(([0], np.cumsum(n)))
        seen = np.concatenate(([0], np.cumsum(differ)))
        equal[first:last] = seen[edges[1:]] == seen[edges[:-1]]
        first = last
    return equal


def _sliced(buf: np.ndarray, kmers: list[np.ndarray], done: list[np.ndarray]):
    """Record batch (bucket, kmers, done): strings (ids, keys, places, words, first byte, bytes, bucket) and settled runs (ids, keys, places, words, bucket), packed by bucket."""
    import pyarrow as pa

    rows: dict[str, list] = {"bucket": [], "kmers": [], "done": []}
    order, d_order = np.argsort(kmers[-1], kind="stable"), np.argsort(done[-1], kind="stable")
    ids, keys, place, count, begin, size, bucket = (x[order] for x in kmers)
    *gone, home = (x[d_order] for x in done)
    met = np.union1d(bucket, home)
    b_edges, h_edges = (np.stack([np.searchsorted(x, met), np.searchsorted(x, met, "right")], 1).tolist() for x in (bucket, home))
    for b, (b_first, b_end), (h_first, h_end) in zip(met.tolist(), b_edges, h_edges, strict=True):
        own, settled = slice(b_first, b_end), slice(h_first, h_end)
        text = buf[common.ranges(begin[own], size[own] + 1) % len(buf)].copy()  # and the byte behind, a word's end
        text[np.cumsum(size[own] + 1) - 1] = 32
        rows["bucket"].append(b)
        rows["kmers"].append(_pack(ids[own], keys[own], place[own], count[own], text.tobytes()) if b_end > b_first else None)
        rows["done"].append(_pack(*[x[settled] for x in gone], b"") if h_end > h_first else None)
    return pa.record_batch({"bucket": pa.array(rows["bucket"], pa.int32()), "kmers": pa.array(rows["kmers"], pa.binary()), "done": pa.array(rows["done"], pa.binary())})


def _marked(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Hashes of runs with frequent ones put last."""
    if not len(hot):
        return h
    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
    return np.where(hot[at] == h, h | _HOT, h)


def dealt(packed: DataFrame, window: int, m: int, hot: np.ndarray, buckets: int, per: int) -> DataFrame:
    """Strings of coarse buckets (`per` buckets each) to their own buckets, by the minimiser that each string's windows share.

    A coarse bucket is read by as many tasks as its size asks for, by a hash of its packed strings.
    """
    tasks = max(1, -(-per * BUCKET_BYTES // (STEP_BYTES // 3)))

    def run(batches):
        held, bytes_held, now = [], 0, None
        for batch in batches:
            for b, kmers, done in zip(batch["bucket"].to_pylist(), batch["kmers"], batch["done"], strict=True):
                if held and (b != now or bytes_held > STEP_CHUNK):
                    yield deal(held)
                    held, bytes_held = [], 0
                now = b
                parts = [_unpack(x.as_py()) if x.is_valid else None for x in (kmers, done)]
                held.append(parts)
                bytes_held += sum(len(p[1]) + p[0].nbytes for p in parts if p)
        if held:
            yield deal(held)

    def deal(held):
        none = np.zeros((4, 0), np.int64)
        ids, keys, place, count = np.concatenate([p[0][0] for p in held if p[0]] or [none], axis=1)
        gone = np.concatenate([p[1][0] for p in held if p[1]] or [none], axis=1)
        buf = np.frombuffer(b"".join(p[0][1] for p in held if p[0]) or b" ", np.uint8)
        starts, ends = common.word_bounds(buf)
        low, begin, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(ids):
            h = _marked(common.mix(common.rolled(common.word_hashes(buf, starts, ends), m)) & ~_HOT, hot)
            offset = np.cumsum(count) - count
            edges = np.stack([offset, offset + window - m + 1], 1).ravel()
            low = np.minimum.reduceat(np.append(h, ~np.uint64(0)), edges)[::2]
            begin = starts[offset]
            size = ends[offset + count - 1] - begin
        fine = (common.mix(low) % np.uint64(buckets)).astype(np.int64)
        home = (common.mix(gone[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        return _sliced(buf, [ids, keys, place, count, begin, size, fine], [*gone, home])

    coarse = -(-buckets // per)
    spread = packed.repartition(coarse * tasks, "bucket", F.pmod(F.xxhash64("kmers", "done"), F.lit(tasks))).sortWithinPartitions("bucket")
    return spread.mapInArrow(run, "bucket int, kmers binary, done binary")


def super_kmers(docs: DataFrame, window: int, m: int, hot: np.ndarray, buckets: int, per: int = 1) -> DataFrame:
    """docs (doc_id, key, text) to packed rows (bucket, kmers, done): super-k-mers and windows settled on the spot, by coarse bucket if it is `per` buckets."""

    def pack(batches):
        for chunk in common.chunks(batches, "text", CHUNK):
            words = _Words(chunk["text"])
            h, _ = _runs(words, m)
            h = _marked(h, hot)
            n = len(words.hashes) - window + 1
            if n < 1:
                continue
            width, low, reach = window - m + 1, h, 1
            while 2 * reach <= width:  # least hash of 1, 2, 4, ... runs
                low, reach = np.minimum(low[:-reach], low[reach:]), 2 * reach
            low = np.minimum(low[:n], low[width - reach : width - reach + n])
            doc = np.repeat(np.arange(len(words.counts)), words.counts)
            whole = doc[:n] == doc[window - 1 :]
            fresh = np.ones(n, bool)
            fresh[1:] = (low[1:] != low[:-1]) | ~whole[:-1]
            first = np.flatnonzero(fresh & whole)
            if not len(first):
                continue
            stop = np.minimum(np.append(first[1:], n), words.doc_first[doc[first] + 1] - window + 1)
            count = stop - first + window - 1  # words
            ids = chunk["doc_id"].fill_null(_NULL_ID).to_numpy()[doc[first]]
            keys = chunk["key"].to_numpy()[doc[first]]
            place = first - words.doc_first[doc[first]]
            begin, size = words.starts[first], words.ends[first + count - 1] - words.starts[first]
            hashed = common.rolled(words.hashes, window)
            with np.errstate(over="ignore"):
                kind = common.mix(hashed[first] * np.uint64(3) + hashed[first + count - window] + np.uint64(1) * count.astype(np.uint64))
            order = np.lexsort((place, keys, ids, size, kind))
            new = np.ones(len(order), bool)
            new[1:] = (kind[order][1:] != kind[order][:-1]) | (size[order][1:] != size[order][:-1])
            leader = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            again = np.zeros(len(order), bool)
            again[~new] = _same(words.buf, begin[order][~new], begin[leader][~new], size[order][~new])
            twin = again & (ids[order] == ids[leader]) & (keys[order] == keys[leader]) & (place[order] == place[leader])
            settled = np.sort(order[again & ~twin])  # a task has met these words earlier: all their windows go
            travel = np.sort(order[~again])
            bucket = (common.mix(low[first]) % np.uint64(buckets)).astype(np.int64)
            home = (common.mix(ids.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            yield _sliced(words.buf, [x[travel] for x in (ids, keys, place, count, begin, size, bucket // per)], [x[settled] for x in (ids, keys, place, count, home // per)])

    return docs.mapInArrow(pack, "bucket int, kmers binary, done binary")


def _later(ids, keys, place, offset, buf, starts, ends, hashed, at, owner, window: int) -> list:
    """Of windows (first words at, of super-k-mers owner): runs covered by those that aren't the earliest of their kind."""
    h = hashed[at]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    pick = np.flatnonzero(twice)
    if not len(pick):
        return []
    own, where, h = owner[pick], at[pick], h[pick]
    start = place[own] + where - offset[own]
    begin = starts[where]
    size = ends[where + window - 1] - begin
    order = np.lexsort((start, keys[own], ids[own], h))
    own, start, begin, size, h = own[order], start[order], begin[order], size[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    squeezed = _squeezed(buf, begin, size)
    lead = np.flatnonzero(new)[group]
    off = np.ones(len(h), bool)
    off[size == size[lead]] = ~_same(buf, begin[size == size[lead]], begin[lead][size == size[lead]], size[size == size[lead]])
    if off.any():  # other white space, or one hash for different words: group by the words themselves
        seen: dict = {}
        for i in np.flatnonzero(np.isin(group, group[off])).tolist():
            lead[i] = seen.setdefault(squeezed(i), i)
    later = (ids[own] != ids[own[lead]]) | (keys[own] != keys[own[lead]]) | (start != start[lead])
    return [_intervals(ids[own[later]], keys[own[later]], start[later], window)] if later.any() else []


def repeated(packed: DataFrame, window: int) -> DataFrame:
    """Packed super-k-mers to (doc_id, key, first, last): runs of words covered by windows that also start earlier."""

    def count(table):
        import pyarrow as pa

        found = []
        for blob in table["done"].drop_null().to_pylist():
            (ids, keys, starts, counts), _ = _unpack(blob)
            found.append((ids, keys, starts, starts + counts))
        parts = [_unpack(blob) for blob in table["kmers"].drop_null().to_pylist()]
        if parts:
            ids, keys, place, counts = np.concatenate([p[0] for p in parts], axis=1)
            buf = np.frombuffer(b"".join(p[1] for p in parts), np.uint8)
            starts, ends = common.word_bounds(buf)
            hashed = common.rolled(common.word_hashes(buf, starts, ends), window)
            offset = np.cumsum(counts) - counts
            n = counts - window + 1
            passes = -(-len(starts) // PASS_WORDS)
            for k in range(passes):  # windows of equal words have equal hashes
                at = common.ranges(offset, n)  # first word of each window
                owner = np.repeat(np.arange(len(ids)), n)
                if passes > 1:
                    mine = hashed[at] % np.uint64(passes) == k
                    at, owner = at[mine], owner[mine]
                found += _later(ids, keys, place, offset, buf, starts, ends, hashed, at, owner, window)
        ids, keys, first, last = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=ids == _NULL_ID), "key": keys, "first": first, "last": last})

    return packed.groupBy("bucket").applyInArrow(count, "doc_id long, key long, first long, last long")


def _squeezed(buf: np.ndarray, begin: np.ndarray, size: np.ndarray):
    return lambda i: b" ".join(buf[begin[i] : begin[i] + size[i]].tobytes().split())


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, buckets: int | None = None, summary: int | None = None, coarse: int = COARSE) -> DataFrame:
    """(doc_id, key, first, last): word runs to remove, possibly overlapping. key is xxhash64 of the text."""
    if not 1 <= minimiser <= window:
        raise ValueError("a minimiser is 1 to `window` words")
    picked = _picked(docs, id_col, text_col).where("text is not null")
    if not buckets:
        size = picked.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first().n
        buckets = max(4 * common.partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    hot = frequent_runs(picked.select("text"), minimiser, summary or min(SUMMARY, max(1024, 2 * buckets)))
    per = -(-buckets // coarse)
    packed = super_kmers(picked, window, minimiser, hot, buckets, per)
    return repeated(dealt(packed, window, minimiser, hot, buckets, per) if per > 1 else packed, window)


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    picked = common.take(docs, doc_id=id_col, text=text_col)
    return picked.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def _packed_texts(picked: DataFrame) -> DataFrame:
    """(doc_id, key, packed): texts compressed for their way to the join; null as empty."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        tool = zstandard.ZstdCompressor(level=3)
        for chunk in common.chunks(batches, "text"):
            packed = [tool.compress(t or b"") for t in chunk["text"].cast(pa.binary()).to_pylist()]
            yield pa.record_batch({"doc_id": chunk["doc_id"], "key": chunk["key"], "packed": pa.array(packed, pa.binary())})

    return picked.mapInArrow(run, "doc_id long, key long, packed binary")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, buckets: int | None = None, summary: int | None = None, keep_text: bool = True, coarse: int = COARSE) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256, and the kept words joined by blanks (keep_text)."""
    gone = spans(docs, id_col, text_col, window, minimiser, buckets, summary, coarse)
    gone = gone.groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("gone"))  # a document's own runs only
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "gone")
    joined = _packed_texts(_picked(docs, id_col, text_col)).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")

    def cut(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for chunk in common.chunks(batches, "packed"):
            total, removed, digests, kept = [], [], [], []
            runs = chunk["gone"]
            for i, packed in enumerate(chunk["packed"].to_pylist()):
                words = unpack.decompress(packed).split()
                total.append(len(words))
                if runs[i].is_valid:
                    covered = np.zeros(len(words) + 1, np.int64)
                    own = runs[i].values
                    np.add.at(covered, own.field("first").to_numpy(), 1)
                    np.add.at(covered, own.field("last").to_numpy(), -1)
                    stay = np.cumsum(covered[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                removed.append(total[-1] - len(words))
                left = b" ".join(words)
                digests.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append(left)
            columns = {"doc_id": chunk["doc_id"], "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
            yield pa.record_batch(columns | ({"kept_text": pa.array(kept, pa.binary()).cast(pa.string())} if keep_text else {}))

    return joined.select("doc_id", "packed", "gone").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(common.table(spark, sf_dir, "documents"), keep_text=False)
