"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most `max_bits`
(3) bits differ in at most three bytes, so at least five positional bytes are equal: that
is the guaranteed minimum of matches. Any five of eight positions hold three of the first
four or three of the last four, so fingerprints are posted under the eight triples of
positions within a half, with their bytes. Within a posting list the positional bytes that
two fingerprints share are tallied; pairs below the minimum are let go, and only pairs that
reach it are verified by their differing bits.

Equal fingerprints are merged first, and a list gives a spanning forest of its links, not
its pairs. Lists longer than `longest` are split, by Spark and before any task reads them:
their fingerprints are posted again under all sets of five positions (the minimum of
matches, so nothing is lost), and where such a list is still too long, also by three of the
six half bytes that are left (three differing bits leave three of six equal). Such a list
has at most 4096 different fingerprints, so no task compares more than that with each
other, however many near copies there are.

Defined results: null and empty texts have fingerprint zero; fewer words than a shingle
make one shingle; texts of any length are read whole, in pieces of shingles; an empty table
gives an empty table; repeated rows link like any equal fingerprints; rows with a null id
get no component root of their own (null is passed over by the minimum) but join the
others'. Other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

MAX_BITS = 3
WORDS = 3
#: Posting lists of more fingerprints are split.
LONGEST = 4096
_TRIPLES = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3), (4, 5, 6), (4, 5, 7), (4, 6, 7), (5, 6, 7)]


def fingerprint(text: str | None, words: int = WORDS, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not tokens:
        return 0
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = min(words, len(tokens))
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    total, count = np.zeros(64, np.int64), len(tokens) - n + 1
    begin, end = starts[:count].tolist(), ends[n - 1 :].tolist()
    for at in range(0, count, 65536):  # bits of so many hashes at a time
        h = np.array([digest(joined[a:b], seed) for a, b in zip(begin[at : at + 65536], end[at : at + 65536], strict=True)], dtype=">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, key (xxhash64 of the text), fp (long with the fingerprint's bits)."""

    def run(batches):
        import pyarrow as pa

        for chunk in common.chunks(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in chunk["text"].to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": chunk["doc_id"], "key": chunk["key"], "fp": pa.array(fps.view(np.int64))})

    picked = common.take(docs, doc_id=id_col, text=text_col)
    return common.map_texts(picked.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text"), run, "doc_id long, key long, fp long")


def shared_bytes(differing: np.ndarray) -> np.ndarray:
    """Tally of equal positional bytes, from the exclusive or of two fingerprints."""
    return (np.ascontiguousarray(differing).view(np.uint8).reshape(*differing.shape, 8) == 0).sum(axis=-1)


def matches(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Places (along all axes, as np.nonzero gives them) of pairs that reach the minimum tally and are then verified."""
    differing = a ^ b
    at = np.nonzero(shared_bytes(differing) >= 8 - max_bits)
    near = np.bitwise_count(differing[at]) <= max_bits
    return [x[near] for x in at]


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links within one posting list of different fingerprints, as a spanning forest (positions in the list)."""
    label, out, rows = np.arange(len(fps)), [], max(1, (1 << 18) // max(1, len(fps)))
    for first in range(0, len(fps) - 1, rows):
        i, j = matches(fps[first : first + rows, None], fps[None, :], max_bits)
        i, j = i[j > i + first] + first, j[j > i + first]
        for one in np.unique(i).tolist():
            near = j[np.searchsorted(i, one) : np.searchsorted(i, one, "right")]
            for other, k in zip(*np.unique(label[near], return_index=True), strict=True):
                if other != label[one]:
                    out.append((one, int(near[k])))
                    label[label == other] = label[one]
    return out


def _linked(posting: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole posting lists, one after another: short lists all at once, longer ones each by its forest."""
    cuts = np.flatnonzero(np.diff(posting)) + 1
    bounds = np.concatenate(([0], cuts, [len(posting)]))
    sizes = np.diff(bounds)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    few = np.repeat(sizes <= 8, sizes)
    for step in range(1, 8):
        at = np.flatnonzero((posting[step:] == posting[:-step]) & few[step:])
        (near,) = matches(fps[at], fps[at + step], max_bits)
        a.append(fps[at[near]])
        b.append(fps[at[near] + step])
    for k in np.flatnonzero(sizes > 8).tolist():
        own = fps[bounds[k] : bounds[k + 1]]
        pairs = np.array(forest(own, max_bits), np.int64).reshape(-1, 2)
        a.append(own[pairs[:, 0]])
        b.append(own[pairs[:, 1]])
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def _compare(posted: DataFrame, max_bits: int) -> DataFrame:
    """posted (posting, fp) to links (a, b) within its lists."""

    def run(batches):
        import pyarrow as pa

        held_p, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:  # sorted by posting; the last list of a batch may go on in the next
            p = np.concatenate([held_p, batch["posting"].to_numpy()])
            f = np.concatenate([held_f, batch["fp"].to_numpy()])
            last = int(np.searchsorted(p, p[-1])) if len(p) else 0
            if last:
                yield pa.record_batch(dict(zip("ab", map(pa.array, _linked(p[:last], f[:last].view(np.uint64), max_bits)), strict=True)))
            held_p, held_f = p[last:], f[last:]
        if len(held_p):
            yield pa.record_batch(dict(zip("ab", map(pa.array, _linked(held_p, held_f.view(np.uint64), max_bits)), strict=True)))

    dealt = posted.select("posting", "fp").repartition(common.partitions(posted.sparkSession), "posting")
    return dealt.sortWithinPartitions("posting").mapInArrow(run, "a long, b long")


def _by_length(posted: DataFrame, longest: int) -> tuple[DataFrame, DataFrame | None]:
    """Postings of lists up to that length, and those of longer lists (None: there is none)."""
    long = common.settle(posted.groupBy("posting").agg(F.count("*").alias("n")).where(F.col("n") > longest).select("posting"))
    if long.isEmpty():
        return posted, None
    long = common.short(long)
    return posted.join(long, "posting", "left_anti"), posted.join(long, "posting", "left_semi")


def links(unique: DataFrame, max_bits: int = MAX_BITS, longest: int = LONGEST) -> DataFrame:
    """unique (fp) without repeats to (a, b): links that connect what is linked at max_bits or fewer bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the positions' sets cover up to three differing bytes")
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255) for p in range(8)]

    def joined(first: int, parts: list) -> Column:
        return reduce(lambda key, part: key * 256 + part, parts, F.lit(first).cast("long"))

    triples = [joined(k, [byte[p] for p in own]) for k, own in enumerate(_TRIPLES)]
    short, long = _by_length(unique.select("fp", F.explode(F.array(*triples)).alias("posting")), longest)
    found = _compare(short, max_bits)
    if long is None:
        return found
    fives = [F.struct(joined(k, [byte[p] for p in own]).alias("posting"), joined(0, [byte[p] for p in range(8) if p not in own]).alias("rest")) for k, own in enumerate(combinations(range(8), 5))]
    again = common.settle(long.select("fp").distinct())
    short, long = _by_length(again.select("fp", F.inline(F.array(*fives))), longest)
    found = found.union(_compare(short, max_bits))
    if long is None:
        return found
    half = [F.shiftright("rest", 4 * p).bitwiseAND(15) for p in range(6)]
    halves = [((F.col("posting") * 32 + k) * 16 + half[x]) * 256 + half[y] * 16 + half[z] for k, (x, y, z) in enumerate(combinations(range(6), 3))]
    return found.union(_compare(long.select("fp", F.explode(F.array(*halves)).alias("posting")), max_bits))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int, longest: int) -> DataFrame:
    """For each row: doc_id, key, fp, root (a fingerprint that stands for the component), component_id."""
    fps = common.settle(fingerprints(docs, id_col, text_col, words))
    unique = common.settle(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")))
    linked = components(links(unique.select("fp"), max_bits, longest))
    rooted = unique.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", "_n", F.coalesce("root", "fp").alias("root"))
    rooted = common.settle(rooted)
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = common.settle(rooted.join(roots, "root").select(F.col("fp").alias("_key"), "_n", "root", "component_id"))
    return common.join_hot(fps, classes, "fp", fps.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS, longest: int = LONGEST) -> DataFrame:
    """For each row: doc_id, fp, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    named = _classes(docs, id_col, text_col, words, max_bits, longest)
    return named.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, max_bits: int = MAX_BITS, longest: int = LONGEST) -> DataFrame:
    """One document of each component, with all columns: the smallest id (a null one comes last), then the least hash of
    the text; of rows that repeat an id and a text one."""
    rows = common.settle(_classes(docs, id_col, text_col, words, max_bits, longest).select(*common.identity(F.col("doc_id"), F.col("key")), "root"))
    place = F.struct("_none", "_id", "_key")
    best = common.settle(rows.groupBy("root").agg(F.min(place).alias("best"), F.count("*").alias("_n")).select(F.col("root").alias("_key"), "best", "_n"))
    crowded = best.where("_n > 1")  # only components of several rows lose any
    several = common.settle(rows.withColumnRenamed("_key", "_text").join(common.short(common.settle(crowded.select("_key"))), F.col("root") == F.col("_key"), "left_semi"))
    told = common.join_hot(several, crowded, "root", several.count()).select("_id", "_none", F.col("_text").alias("_key"), "best")
    gone = told.where(F.struct("_none", "_id", "_key") != F.col("best"))
    twins = told.where(F.struct("_none", "_id", "_key") == F.col("best")).groupBy("_id", "_none", "_key").count().where("count > 1")
    return common.prune(docs, gone, twins, id_col, lambda columns: F.xxhash64(columns[docs.columns.index(text_col)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("fp")
