"""Best-fit packing with large-item matching.

Only the number of pieces of each length (at most `capacity` numbers) is planned centrally:
pieces above a third of the capacity pair at most twice per sequence, the longest with the
longest that still fits; then shorter ones, longest first, go where the remaining gap fits
best. The plan is a list of ranges "the r-th piece of this length goes to that place".
Pieces are numbered within their length by shard (a count per shard and length, a running
sum, and a row number within each), so no task holds all pieces of one length.

Defined results: a null or empty text is its closing id alone; texts of any length are cut
whole, and encoded a bounded chunk of texts at a time (one longer text is a chunk); an empty table gives an
empty table; repeated rows are packed once each; a null id packs like any other. Other
columns are not looked at. Special tokens' strings in a text get the ids that the tokenizer
library gives them.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
END = 0
#: Different words of which a Python worker remembers the ids (some 40 bytes a word); beyond it starts anew.
REMEMBERED = 1_000_000
#: Bytes of text that are looked up together (each look-up goes over all that is remembered), and words or ids that are put together at a time.
LOOKED_UP, AT_ONCE = 16 << 20, 1 << 20


class Known:
    """Different strings in an Arrow array and the ids of each, all in a row."""

    def __init__(self, kind: np.dtype) -> None:
        self.keys, self.ids, self.bounds = None, np.zeros(0, kind), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def places(self, strings, encode) -> np.ndarray:
        """Where each of the strings (an Arrow array, all different) is; encode gives the ids of new ones and the number of each's."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = np.full(len(strings), -1) if self.keys is None else pc.fill_null(pc.index_in(strings, value_set=self.keys), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = strings.take(pa.array(new))
            ids, sizes = encode(fresh)
            at[new] = len(self) + np.arange(len(new))
            self.keys = fresh if self.keys is None else pa.concat_arrays([self.keys, fresh])
            self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        return at

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at these places in a row, and the number of each's."""
        starts = self.bounds[at]
        sizes = self.bounds[at + 1] - starts
        return self.ids[common.ranges(starts, sizes)], sizes


class Encoder:
    """The ids of whole texts. Words between ASCII white space are encoded on their own (this tokenizer drops
    white space, so they don't touch each other), each different one once a worker, and so are stems of letters.
    Words are looked up as Arrow arrays: only those that are new to a worker become Python strings."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "(?i)" + ("|".join(map(re.escape, added)) or "$^")  # a word like that in any case isn't lower-cased here
        self.forget()

    def forget(self) -> None:
        kind = np.uint16 if len(self.closing) <= 1 << 16 else np.uint32
        self.words, self.parts = Known(kind), Known(kind)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in encoded for i in ids], np.int64), np.fromiter(map(len, encoded), np.int64, len(encoded))

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that are one run of letters, which one closing id ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.closing[ids]) + 1
        if len(ends) == len(words) and (not len(ends) or ends[-1] == len(ids)):
            return ids, np.diff(ends, prepend=0)
        return self._each(words)

    def _learn(self, strings, encode) -> np.ndarray:
        """Places in `parts` of an Arrow array of strings, which may repeat."""

        def by_lists(fresh):
            found = [encode(fresh.slice(first, 512).to_pylist()) for first in range(0, len(fresh), 512)]
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))

        coded = strings.dictionary_encode()
        return self.parts.places(coded.dictionary, by_lists)[coded.indices.to_numpy()]

    def _of_words(self, raw) -> tuple[np.ndarray, np.ndarray]:
        """Words that are new to this worker to all their ids in a row and the number of each's."""
        import pyarrow.compute as pc

        # The tokenizer looks for added tokens first, in their own case only, and lower-cases the rest.
        words = pc.if_else(pc.match_substring_regex(raw, self.added), raw, pc.ascii_lower(raw))
        # Letters and then ASCII marks without an apostrophe: the two are encoded apart, as the tokenizer's split does.
        # Only scripts whose letters stay letters when normalised and lower-cased (U+0130 doesn't).
        letters = pc.match_substring_regex(words, r"^\p{L}+[!-&(-/:-@\[-`{-~]*$")
        scripts = pc.match_substring_regex(words, r"^[\p{Latin}\p{Greek}\p{Cyrillic}]+[!-&(-/:-@\[-`{-~]*$")
        plain = pc.and_(pc.and_(letters, scripts), pc.invert(pc.match_substring(words, "\u0130"))).to_numpy(zero_copy_only=False)
        stem = pc.replace_substring_regex(words, r"^(\p{L}+)[!-&(-/:-@\[-`{-~]*$", r"\1")
        marks = pc.replace_substring_regex(words, r"^\p{L}+([!-&(-/:-@\[-`{-~]*)$", r"\1")
        parts = np.full((len(words), 2), -1)
        parts[plain, 0] = self._learn(stem.filter(plain), self._letters)
        parts[~plain, 0] = self._learn(words.filter(~plain), self._each)
        marked = plain & (pc.binary_length(marks).to_numpy() > 0)
        parts[marked, 1] = self._learn(marks.filter(marked), self._each)
        ids, sizes = self.parts.of(parts[parts >= 0])
        own = np.zeros(parts.shape, np.int64)
        own[parts >= 0] = sizes
        return ids, own.sum(axis=1)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """An Arrow array of texts to all ids in a row and the number of each text's."""
        import pyarrow.compute as pc

        if len(self.words) > REMEMBERED:
            self.forget()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        at = self.words.places(coded.dictionary, self._of_words)
        code = coded.indices.to_numpy()
        found = [self.words.of(at[code[first : first + AT_ONCE]]) for first in range(0, max(len(code), 1), AT_ONCE)]
        ids, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        edges = np.concatenate(([0], np.cumsum(sizes)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(edges)


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (keep_ids) the ids of each piece (vocabulary: a tokenizer file that all executors have)."""

    def run(batches):
        import pyarrow as pa

        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        for chunk in common.chunks(batches, "text", LOOKED_UP):
            ids, counts = _encoders[vocabulary].encode(chunk["text"])
            part, at, i = np.cumsum(counts) // (4 * AT_ONCE), 0, 0
            for last in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(counts)]:
                doc, piece, start, length, crc, out = [], [], [], [], [], []
                for i, n in enumerate(counts[i:last].tolist(), i):
                    own = np.append(ids[at : at + n], end).astype("<u4")
                    at += n
                    for k, first in enumerate(range(0, len(own), capacity)):
                        cut = own[first : first + capacity]
                        doc.append(i)
                        piece.append(k)
                        start.append(first)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                        if keep_ids:
                            out.append(cut)
                i = last
                columns = {"doc_id": chunk["doc_id"].take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    offsets = pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32))
                    columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out).astype(np.int32)))
                yield pa.record_batch(columns)

    picked = common.take(docs, doc_id=id_col, text=text_col)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return common.map_texts(picked.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces per length to ranges (length, first rank, end rank, first sequence, offset). Sequences with the same
    contents are planned together, so the plan's size depends on the lengths and not on the number of pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    bins: dict[int, list[list]] = {}  # gap: [how many, contents]

    def put(gap: int, many: int, contents: tuple) -> None:
        if many:
            bins.setdefault(gap, []).append([many, contents])

    third = capacity // 3
    for n in sorted((n for n in left if n > third), reverse=True):
        while left.get(n, 0):
            mate = next((m for m in range(min(n, capacity - n), third, -1) if left.get(m, 0) > (m == n)), 0)
            if not mate:
                put(capacity - n, left.pop(n), (n,))
            elif mate == n:
                put(capacity - 2 * n, left[n] // 2, (n, n))
                left[n] %= 2
            else:
                many = min(left[n], left[mate])
                put(capacity - n - mate, many, (n, mate))
                left[n], left[mate] = left[n] - many, left[mate] - many
    for n in sorted((n for n in left if n <= third), reverse=True):
        c = left[n]
        while c:
            gap = next((g for g in range(n, capacity) if bins.get(g)), capacity)
            if gap == capacity:
                fit = capacity // n
                put(capacity - fit * n, c // fit, (n,) * fit)
                put(capacity - (c % fit) * n, 1 if c % fit else 0, (n,) * (c % fit))
                break
            many, contents = group = bins[gap][-1]
            fit = gap // n
            full = min(many, c // fit)
            if full:
                group[0] -= full
                put(gap - fit * n, full, contents + (n,) * fit)
                c -= full * fit
            else:
                group[0] -= 1
                put(gap - c * n, 1, contents + (n,) * c)
                c = 0
            if not group[0]:
                bins[gap].remove(group)
    used, sequence, out = dict.fromkeys(counts, 0), 0, []
    for gap in sorted(bins):
        for many, contents in bins[gap]:
            offset = 0
            for n in contents:
                out.append((n, used[n], used[n] + many, sequence, offset))
                used[n] += many
                offset += n
            sequence += many
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, shards: int | None = None) -> DataFrame:
    """Pieces (with a column length, 1 to capacity) to themselves with sequence_id and offset."""
    cut = common.settle(cut)
    shards = shards or 4 * common.partitions(cut.sparkSession)
    tagged = cut.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    per = common.settle(tagged.groupBy("length", "_shard").agg(F.count("*").alias("_n")))
    totals = {r.length: r.n for r in per.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # `capacity` rows at most
    rows = sorted(plan(totals, capacity))
    table = np.array(rows, np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)  # `shards` rows at most
    offsets = per.select(F.col("length").alias("_l"), F.col("_shard").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_shard").orderBy("doc_id", "piece", "start")
    ranked = tagged.withColumn("_in", F.row_number().over(order) - 1)
    ranked = ranked.join(offsets, (F.col("length") == F.col("_l")) & (F.col("_shard") == F.col("_s")))
    ranked = ranked.withColumn("_rank", F.col("_in") + F.col("_before")).drop("_l", "_s", "_in", "_before", "_shard")
    columns = [c for c in ranked.columns if c != "_rank"]
    # (length, rank) in one number, to find a piece's range by bisection
    scale = max([1, *totals.values()]) + 1
    keys = table[:, 0] * scale + table[:, 1] if len(table) else np.zeros(0, np.int64)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            row = table[np.searchsorted(keys, length * scale + rank, side="right") - 1] if len(table) else table
            out = {c: batch[c] for c in columns}
            yield pa.record_batch(out | {"sequence_id": pa.array(row[:, 3] + rank - row[:, 1], pa.int64()), "offset": pa.array(row[:, 4], pa.int64())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(common.table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False))
