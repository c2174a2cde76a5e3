"""Spelling variants: words one edit apart by pivotal grams, and the frequent word that each is a form of.

Words are counted on the JVM. All bigrams are ranked from rare to frequent (letters are A-Z, which
are lower-cased, and 64 code points more, so there are at most 90 * 90). A word's prefix is
its three rarest bigrams; dynamic programming picks two disjoint ones of them, the pivots.
One edit leaves one pivot whole at least, and if a word's prefix ends no later in the ranking
than another's, a pivot that is left whole stands in the other's prefix. So each word's pivots
are looked up among the prefixes of all words.

Positions limit what meets: an edit behind the first pivot leaves all up to it in place, an edit
before the second all from it on, counted from the end; one of the two holds. What is left for
the edit is cut in half, and one half of it is equal too. Words thus meet by the
length of the word looked up, the pivot with what is equal beside it, and the equal half: no list of
all words with a bigram is ever paired. Candidates are verified by edit distance.

Defined results: null and empty texts have no words; texts are read whole; without a doc_id no
code point is deleted; repeated rows count each time; equal counts are decided by the smaller
word; a table without words gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RUN, LEAST_LENGTH, LEAST_COUNT, EVERY, TIMES = r"[A-Za-zÀ-ÿ]+", 7, 2, 31, 10
#: Three bigrams hold two disjoint ones, and an edit touches two overlapping ones at most.
PREFIX = 3


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n: runs of letters of all texts, each without one code point where `every` divides the checksum of id and run."""
    if least_length < PREFIX + 1:
        raise ValueError(f"words need {PREFIX + 1} code points for {PREFIX} bigrams")
    picked = common.take(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long").cast("string"))
    runs = picked.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select(common.ascii_lower(F.col("run")).alias("run"), "doc_id")
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(h % every == 0, shorter).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def ranks(counted: DataFrame) -> dict[str, int]:
    """Every bigram's place from rare to frequent (words that hold it): at most 8100 by the alphabet."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    found = counted.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").count().collect()
    return {r.gram: k for k, r in enumerate(sorted(found, key=lambda r: (r["count"], r.gram)))}


def pivots(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Places of the two disjoint bigrams with the least sum of ranks, of (rank, place) pairs.

    best[i] is the rarest of the first bigrams up to i in order of place; each bigram is joined with the best one that ends before it.
    """
    grams = sorted(prefix, key=lambda g: g[1])
    best: list[tuple[int, int]] = []
    chosen = None
    for rank, place in grams:
        before = [b for b, g in zip(best, grams, strict=False) if g[1] + 2 <= place]
        if before and (chosen is None or before[-1][0] + rank < chosen[0]):
            chosen = before[-1][0] + rank, before[-1][1], place
        best.append(min(best[-1], (rank, place)) if best else (rank, place))
    return chosen[1], chosen[2]


def _sides(word: str, head: int, left: int, target: int, kind: str) -> list[str]:
    """What is equal if the edit is behind the first `head` code points, where at least `left` more stand in both words: up to the middle, or from it on."""
    half = left // 2
    return [f"{kind}{target}<{word[: head + half]}", f"{kind}{target}>{word[:head]}|{word[len(word) - left + half :]}"]


def signatures(word: str, rank: dict[str, int]) -> tuple[set[str], set[str]]:
    """(keys that the word is looked up by, keys that it is found by)."""
    size = len(word)
    grams = [(rank[word[i : i + 2]], i) for i in range(size - 1)]
    prefix = sorted(grams)[:PREFIX]
    first, second = pivots(prefix)
    back = word[::-1]
    asks, answers = set(), set()
    for w, place, kind in ((word, first, "a"), (back, size - 2 - second, "b")):
        rest = size - place - 2
        for target in (size - 1, size, size + 1):
            left = min(rest, rest + target - size)
            if left >= 0:
                asks.update(_sides(w, place + 2, left, target, kind))
    for r, i in grams:
        if r <= prefix[-1][0]:  # a bigram that occurs twice counts at both places
            for w, place, kind in ((word, i, "a"), (back, size - 2 - i, "b")):
                rest = size - place - 2
                for left in (rest, rest - 1):  # the other word is as long or longer, or shorter
                    if left >= 0:
                        answers.update(_sides(w, place + 2, left, size, kind))
    return asks, answers


def near(counted: DataFrame, rank: dict[str, int] | None = None) -> DataFrame:
    """Pairs a < b of words one edit apart, once each, with their counts na and nb. counted: stored word, n."""
    rank = ranks(counted) if rank is None else rank

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest = lambda key: xxhash.xxh3_64_intdigest(key.encode())
        for batch in batches:
            rows, keys, asking = [], [], []
            for i, word in enumerate(batch["word"].to_pylist()):
                asks, answers = signatures(word, rank)
                keys += map(digest, asks)
                keys += map(digest, answers)
                asking += [True] * len(asks) + [False] * len(answers)
                rows += [i] * (len(asks) + len(answers))
            at = pa.array(rows, pa.int32())
            yield pa.record_batch({"key": pa.array(np.array(keys, np.uint64).view(np.int64)), "asks": pa.array(asking, pa.bool_()), "word": batch["word"].take(at), "n": batch["n"].take(at)})

    keyed = counted.mapInArrow(run, "key long, asks boolean, word string, n long")
    asks = keyed.where("asks").select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    answers = keyed.where("not asks").select("key", F.col("word").alias("b"), F.col("n").alias("nb"))
    met = asks.join(answers, "key").where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    swap: Column = F.col("a") < F.col("b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("nb")).distinct()


def forms(pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n_near, form, form_n of words with near ones."""
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("other"), F.col("nb").alias("m"))
    both = both.union(pairs.select("b", "nb", "a", "na"))
    best = F.min(F.when(F.col("m") >= times * F.col("n"), F.struct((-F.col("m")).alias("m"), "other")))
    return both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root of words that have a form: the last of the chain. Counts grow from form to form, so it ends; each round doubles the reach."""
    reach = common.settle(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not reach.join(onward, "root", "left_semi").limit(1).count():
            return reach
        reach = common.settle(reach.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root: a row for each word."""
    counted = common.settle(words(docs, id_col, text_col, least_length, least_count, every))
    formed = common.settle(forms(near(counted), times))
    joined = counted.join(formed, "word", "left").join(roots(formed), "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(common.table(spark, sf_dir, "documents"))
