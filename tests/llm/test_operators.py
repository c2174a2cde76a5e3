"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgraph.llm import common, components, exact_dedup, licenses, mixing, near_dedup, packing, quality, spelling, substring_dedup, toxicity, url_filter, vector_search, warc, whitening

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("lang", T.StringType()), ("digest", T.StringType()), ("key", T.LongType()), ("fp", T.LongType()), ("TEXT", T.StringType()), ("score", T.DoubleType()), ("_id", T.LongType()), ("row", T.LongType()))])
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "é", "ñandú", "Δ", "zeta", "eta,", "theta.", "iota!"]


def corpus(n: int = 60, seed: int = 1) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    line = " ".join(r.choice(WORDS) + str(r.randint(0, 9)) for _ in range(40))
    rows: list[tuple[int | None, str | None]] = [(1000, None), (1001, ""), (1002, "   \n\t "), (1003, "one"), (1004, "two words"), (None, "no id at all"), (1005, "word " * 30), (1006, " ".join(str(i) for i in range(9000)) + "\n" + line)]
    for i in range(n):
        body = " ".join(r.choice(WORDS) + r.choice(["", "s", "x" * r.randint(0, 9)]) for _ in range(r.randint(0, 90)))
        rows.append((i, body + ("\n" + line + "\n" if i % 3 == 0 else " ") + body[: r.randint(0, 20)]))
    rows += [(200 + i, rows[10 + i][1]) for i in range(6)]  # copies
    rows += [(300 + i, (rows[12 + i][1] or "") + " more") for i in range(6)]  # near copies
    rows += [rows[9], rows[9], rows[14]]  # repeated rows
    return rows


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None if i is None else f"s{i % 3}", "en", "clash", 7, 8, "CLASH", 0.5, 9, 10) for i, t in rows], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1


def brute_substrings(rows, window):
    order = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, covered = {}, {}
    for i, t in order:
        words = t.encode().split()
        covered[i, t] = np.zeros(len(words), bool)
        for s in range(len(words) - window + 1):
            if first.setdefault(tuple(words[s : s + window]), (i, s)) != (i, s):
                covered[i, t][s : s + window] = True
    out = []
    for i, t in rows:
        words, gone = (t or "").encode().split(), covered.get((i, t), [])
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((i, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "minimiser", "summary"), [(20, 4, None), (5, 5, None), (8, 1, 8), (20, 3, 16)])
def test_substrings(spark, window, minimiser, summary):
    rows = corpus()
    got = substring_dedup.deduplicate(docs(spark, rows), window=window, minimiser=minimiser, summary=summary, buckets=5)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows, window)


@pytest.mark.parametrize(("coarse", "buckets", "tasks"), [(3, 40, 1), (1, 7, 2), (8, 100, 3)])
def test_substrings_in_two_steps(spark, monkeypatch, coarse, buckets, tasks):
    """Coarse buckets first, read by one or more tasks, then each string's own: the same rows, and every string in the bucket that one step gives."""
    monkeypatch.setattr(substring_dedup, "STEP_BYTES", 3 * -(-(-(-buckets // coarse) * substring_dedup.BUCKET_BYTES) // tasks))
    rows = corpus(seed=5)
    got = substring_dedup.deduplicate(docs(spark, rows), window=8, buckets=buckets, coarse=coarse, summary=16)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows, 8)
    picked = substring_dedup._picked(docs(spark, rows), "doc_id", "text").where("text is not null")
    hot, per = substring_dedup.frequent_runs(picked.select("text"), 3, 16), -(-buckets // coarse)

    def held(packed):
        found = Counter()
        for r in packed.collect():
            for kind in ("kmers", "done"):
                if r[kind]:
                    (ids, keys, place, count), text = substring_dedup._unpack(bytes(r[kind]))
                    found.update((r.bucket, kind, *x) for x in zip(ids.tolist(), keys.tolist(), place.tolist(), count.tolist(), strict=True))
                    found.update((r.bucket, kind, w) for w in text.split())
        return found

    one = substring_dedup.super_kmers(picked, 8, 3, hot, buckets)
    assert held(substring_dedup.dealt(substring_dedup.super_kmers(picked, 8, 3, hot, buckets, per), 8, 3, hot, buckets, per)) == held(one)


def test_substrings_in_several_passes_and_many_buckets(monkeypatch):
    """A bucket's windows sorted in passes give what one pass gives; buckets follow the bytes."""
    import pyarrow as pa

    r = random.Random(4)
    line = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(50)) + " " + " ".join(line[a : a + 40]) for a in range(20)]
    words = substring_dedup._Words(pa.array(texts))
    counts = words.counts
    ids, zero = np.arange(len(texts)), np.zeros(len(texts), np.int64)
    offset = np.cumsum(counts) - counts
    hashed = common.rolled(words.hashes, 8)
    at = common.ranges(offset, counts - 7)
    owner = np.repeat(ids, counts - 7)
    whole = substring_dedup._later(ids, zero, zero, offset, words.buf, words.starts, words.ends, hashed, at, owner, 8)
    parts = [substring_dedup._later(ids, zero, zero, offset, words.buf, words.starts, words.ends, hashed, at[m], owner[m], 8) for k in range(5) for m in [hashed[at] % np.uint64(5) == k]]
    covered = lambda runs: {(i, w) for run in runs for i, _, a, b in zip(*(x.tolist() for x in run), strict=True) for w in range(a, b)}
    assert covered(whole) == covered([run for p in parts for run in p]) and len(covered(whole)) > 500


def test_substrings_split_by_other_white_space(spark):
    words = [f"w{i}" for i in range(25)]
    rows = [(1, " ".join(words)), (2, "  \n".join(words)), (3, "x " + "\t".join(words) + " y")]
    got = substring_dedup.deduplicate(docs(spark, rows))
    assert rows_of(got, "doc_id", "n_removed", "kept_text") == [(1, 0, " ".join(words)), (2, 25, ""), (3, 25, "x y")]


# 2


def brute_top(vectors, k, every):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in whole:
        if i % every == 0:
            scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), j) for j, w in whole if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard_rows", "query_rows"), [(4096, 16384), (20, 4)])
def test_top_k(spark, shard_rows, query_rows):
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8))
    vectors = [(i, (centres[i % 6] + 0.1 * r.normal(size=8)).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[4][1]) for i in range(40)]  # one vector many times: ties
    vectors += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] + [0.0] * 7), (2003, [float("inf")] * 8), (2004, []), (2005, [0.0] * 8), (None, [1.0] * 8), (2010, [1e9] * 8), (2020, [0.5, 0.25])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, root int, v int")
    got = vector_search.top_k(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows, query_rows=query_rows)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top(vectors, 5, 10)


def clusters(n: int, dimensions: int, seed: int) -> np.ndarray:
    """Clusters within clusters."""
    r = np.random.default_rng(seed)
    x = 100 * r.normal(size=(8, dimensions))[r.integers(0, 8, n)] + 10 * r.normal(size=(8, dimensions))[r.integers(0, 8, n)] + r.normal(size=(n, dimensions))
    return np.floor(256 * x).astype(np.int64)


def test_cover_trees_hold_their_invariants():
    for x in (clusters(1500, 6, 1), np.zeros((100, 3), np.int64), np.random.default_rng(2).integers(-99, 99, (700, 64)), clusters(1, 4, 3)):
        tree = vector_search.CoverTree(x)
        whole = {}
        for node in range(len(tree.centre) - 1, -1, -1):
            below = [tree.rows[node]] if tree.rows[node] is not None else [whole[c] for c in tree.children[node]]
            whole[node] = np.concatenate(below)
            far = np.sqrt(((x[whole[node]] - x[tree.centre[node]]) ** 2).sum(axis=1))
            assert far.max() <= tree.radius[node] and (tree.level[node] is None or tree.radius[node] <= 2.0 ** tree.level[node] * (1 + 1e-8))
            net = tree.nets[node]
            if net is not None:
                assert net[0] == tree.centre[node]  # nesting
                apart = np.sqrt(((x[net][:, None] - x[net][None]) ** 2).sum(axis=2)) + 1e30 * np.eye(len(net))
                assert apart.min() > 2.0 ** (tree.level[node] - 1)  # separation
                assert np.sqrt(((x[whole[node]][:, None] - x[net][None]) ** 2).sum(axis=2)).min(axis=1).max() <= 2.0 ** (tree.level[node] - 1)  # covering
        assert sorted(whole[0].tolist()) == list(range(len(x)))
        assert len(x) < 1500 or len(tree.centre) > 50


def test_dual_search_prunes_clusters_and_finds_all():
    for x, most in ((clusters(3000, 6, 4), 0.3), (np.random.default_rng(5).integers(-99, 99, (600, 32)), 1.0)):
        ids, q = np.arange(len(x)), np.arange(0, len(x), 5)
        row, names, scores, scored = vector_search.dual_search(q, x[q], np.full(len(q), -np.inf), ids, x, 5)
        product = x[q] @ x.T
        product[np.arange(len(q)), q] = np.iinfo(np.int64).min
        for i in range(len(q)):
            best = np.lexsort((ids, ~product[i]))[:5]  # ~: descending, without overflow
            assert names[row == i].tolist() == best.tolist() and scores[row == i].tolist() == product[i][best].tolist()
        assert scored <= most * len(q) * len(x)


def test_top_k_of_wide_vectors_over_many_shards(spark):
    x = clusters(900, 300, 6) / 256
    vectors = [(i, v) for i, v in enumerate(x.tolist())]
    got = vector_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, shard_rows=60, query_rows=20)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute_top(vectors, 5, 10)


# 3


def test_warc(spark):
    big, huge = "x" * 1000, "é" * 300_000
    pages = [(1, "http://a b/\n", big), (5, "http://a/2", big), (3, None, big), (2, "u", "short"), (4, "v", "short"), (6, "w", None), (7, "", ""), (8, "z", huge), (9, "z", huge), (None, "n", big), (5, "http://a/2", big)]
    df = spark.createDataFrame([(i, u, h, "c", 1) for i, u, h in pages], "page_id long, url string, html string, payload string, file int")
    index = warc.write(warc.assign(df), file_bytes=400)
    got = warc.read(index)
    best = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, -1), i if i is not None else -1)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        refers = best[h] if h in best and best[h] != i else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    kept = {(r.page_id, bytes(r.payload)) for r in got.where("record_type = 'response'").collect()}
    assert (8, huge.encode()) not in kept and (9, huge.encode()) in kept and (6, b"") in kept
    one = warc.read(index.where("page_id = 2"))
    assert [bytes(r.payload) for r in one.collect()] == [b"short"]
    assert rows_of(got, "page_id", "url") == sorted(((i, u or "") for i, u, _ in pages), key=repr)
    some = warc.read(index.where("page_id in (1, 7, 9)"), gap=0)
    assert rows_of(some, "page_id", "payload_bytes") == [(1, 1000), (7, 0), (9, 600_000)]


def test_many_repeats_are_joined_by_a_shuffle(spark, monkeypatch):
    pages = [(i, "u\r\n%20 \u00e9" if i % 2 else "http://a/%20", ("x" * 1200 + str(i % 40)) if i % 3 else "s") for i in range(300)] + [(1000 + i, None, "hot" * 500) for i in range(50)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole = rows_of(warc.assign(df), "page_id", "url", "payload_digest", "refers_to")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(common, "HOT", 10)
    split = warc.assign(df)
    assert rows_of(split, "page_id", "url", "payload_digest", "refers_to") == whole and len(whole) == 350
    assert rows_of(warc.read(warc.write(split)), "page_id", "url") == sorted(((i, u or "") for i, u, _ in pages), key=repr)


def test_ranges_are_coalesced():
    """Neighbours are read at once, up to a size; what lies between selected records only where the gap is small."""
    rows = [("a", 100 * i, 100) for i in range(10)] + [("b", 100 * i, 50) for i in (0, 1, 5, 6)]
    ranges = list(warc.coalesce(rows, gap=60, most=500))
    assert [(f, start, ends[-1][1] - start, len(ends)) for f, start, ends in ranges] == [("a", 0, 500, 5), ("a", 500, 500, 5), ("b", 0, 150, 2), ("b", 500, 150, 2)]
    assert [len(ends) for _, _, ends in warc.coalesce(rows, gap=0, most=10**9)] == [10, 1, 1, 1, 1]
    assert sum(ends[-1][1] - start for _, start, ends in warc.coalesce([("a", 0, 10), ("a", 10**9, 10)], gap=1000)) == 20


# 4


def brute_links(rows):
    fps = [near_dedup.fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)].append(i)
    return sorted(((i, f"{fps[a]:016x}", min(least[root(a)], default=None)) for a, (i, _) in enumerate(rows)), key=repr)


def test_near_duplicates(spark):
    rows = corpus()
    got = near_dedup.near_duplicates(docs(spark, rows))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == brute_links(rows)


def test_fingerprint_is_the_stated_one():
    import xxhash

    text = "The Quick É brown\u00a0fox\tjumps the quick é brown"
    words = "the quick É brown\u00a0fox jumps the quick é brown".split(" ")
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)]
    assert near_dedup.fingerprint(text) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert near_dedup.fingerprint("One Two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert near_dedup.fingerprint(" \n") == near_dedup.fingerprint(None) == 0


@pytest.mark.parametrize("longest", [4096, 50, 12])
def test_links_lose_nothing(spark, longest):
    """Lists of fingerprints that share three, five and more bytes, whole and split."""
    r = np.random.default_rng(3)
    seeds = [int(x) for x in r.integers(0, 1 << 63, 5)]
    fps = {s ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False)) for s in seeds for _ in range(60)} | {0, 7, 15}
    fps |= {seeds[0] ^ int(x) for x in r.integers(0, 1 << 24, 60)} | {seeds[1] ^ sum(1 << int(b) for b in r.choice(24, 3, replace=False)) for _ in range(60)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = near_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), longest=longest)
    got = {r.node: r.root for r in components.components(edges).collect()}
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert near and all(got[a] == got[b] for a, b in near)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in edges.collect())


def test_the_tally_comes_before_the_bits(monkeypatch):
    """Of fingerprints that share three positional bytes, only pairs that share five are verified."""
    r = np.random.default_rng(4)
    fps = np.concatenate([r.integers(0, 1 << 40, 300, dtype=np.uint64), np.uint64(12345) ^ (np.uint64(1) << r.permutation(40)[:20].astype(np.uint64))])
    verified, count = [], np.bitwise_count
    monkeypatch.setattr(near_dedup.np, "bitwise_count", lambda x: verified.append(len(x)) or count(x))
    i, j = near_dedup.matches(fps[:, None], fps[None, :], 3)
    differing = fps[:, None] ^ fps[None, :]
    tally = sum(((differing >> np.uint64(8 * p)) & np.uint64(255)) == 0 for p in range(8))
    assert sum(verified) == int((tally >= 5).sum()) < len(fps) ** 2 // 20
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(count(differing) <= 3)), strict=True))


def test_one_document_of_each_group_stays(spark):
    """Rows that repeat an id, with one text or several, and rows without an id."""
    rows = [(1, "a b c d"), (0, "a b c d"), (1, "q r s t u"), (1, "q r s t u"), (None, "q r s t u"), (None, "only here x"), (None, "only here x"), (4, None), (3, ""), (9, "v w x y z")]
    left = near_dedup.deduplicate(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns
    assert sorted(((r[0], r[1]) for r in left.collect()), key=repr) == sorted([(0, "a b c d"), (1, "q r s t u"), (None, "only here x"), (3, ""), (9, "v w x y z")], key=repr)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components.components(edges).collect()} == {i: 0 for i in range(51)} | {100: 100, 101: 100}


# 5


@pytest.mark.parametrize("summary", [1024, 2])
def test_exact_groups(spark, summary):
    rows = corpus() + [(5000 + i, "hot") for i in range(100)]
    got = exact_dedup.groups(docs(spark, rows), summary=summary).collect()
    size = Counter(t or "" for _, t in rows)
    best: dict = {}
    for i, t in rows:
        if i is not None:
            best[t or ""] = max(best.get(t or "", -1), i)
    want = sorted(((i, best.get(t or ""), size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted({w[3] for w in want}) and all(r.doc_id == r.keep_id for r in kept)
    assert any(r.heavy for r in got)
    left = exact_dedup.deduplicate(docs(spark, rows), summary=summary)
    assert sorted(((r[0], r[1] or "") for r in left.collect()), key=repr) == sorted(((best.get(t), t) for t in size), key=repr)
    assert left.columns == docs(spark, rows).columns and sorted((r[1] or "") for r in left.collect()) == sorted(size)


# 6


def test_mixing(spark):
    rows = corpus(200)
    topics = spark.createDataFrame([(i, str(i % 2)) for i in range(100)], "doc_id long, topic string")
    got = mixing.weigh(docs(spark, rows), topics, budget=0.9).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 and r.sampled == (r.draw < r.probability) for r in got)
    total = sum(r.n_tokens for r in got)
    assert total == sum(len((t or "").encode().split()) for _, t in rows)
    (budget,) = {r.budget for r in got}
    assert 0 < budget < 0.9  # the largest that the targets allow
    for m in mixing.MARGINALS:  # the shares of every value of every marginal
        share, expected = Counter(), defaultdict(float)
        for r in got:
            share[r[m]] += r.n_tokens
            expected[r[m]] += r.n_tokens * r.probability
        weight = sum(n**0.5 for n in share.values())
        for value, n in share.items():
            assert expected[value] == pytest.approx(budget * total * n**0.5 / weight, rel=0.0101), (m, value)
    cells = mixing.rake(mixing.weigh(docs(spark, rows)).groupBy("source", "lang").agg(F.sum("n_tokens").alias("n_tokens")), marginals=("source", "lang"))
    residuals = mixing.marginals_of(cells, marginals=("source", "lang")).collect()
    assert {r.marginal for r in residuals} == {"source", "lang"} and all(abs(r.residual) <= 0.0101 for r in residuals)
    again = mixing.weigh(docs(spark, rows), topics, budget=0.9)
    assert rows_of(again, "doc_id", "sampled") == sorted(((r.doc_id, r.sampled) for r in got), key=repr)
    kept = mixing.sample(docs(spark, rows), topics, budget=0.9)
    assert kept.columns == docs(spark, rows).columns and kept.count() == sum(r.sampled for r in got)


def test_mixing_without_tokens_and_with_clashing_topics(spark):
    got = mixing.weigh(docs(spark, [(1, None), (2, ""), (None, " ")])).collect()
    assert [(r.n_tokens, r.probability) for r in got] == [(0, pytest.approx(0.7))] * 3
    vectors = spark.createDataFrame([(1, [0.5], 3, "x", 1), (1, [0.5], 2, "x", 1), (None, [0.5], 9, "x", 1)], "vec_id long, embedding array<float>, label int, LABEL string, topic int")
    assert rows_of(mixing.embedding_topics(vectors), "doc_id", "topic") == [(1, "2")]


def test_mixing_raises_small_values_as_far_as_they_go(spark):
    """Half of the sample is to be French, but only a tenth of the tokens is: the budget falls to a fifth."""
    rows = [(i, "w " * 10, "s", "fr" if i % 10 == 0 else "en") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5), ("de", 3.0)], "value string, share double")}
    got = {r.lang: (round(r.p, 3), round(r.b, 3)) for r in mixing.weigh(df, None, targets).groupBy("lang").agg(F.max("probability").alias("p"), F.max("budget").alias("b")).collect()}
    assert got == {"fr": (1.0, 0.2), "en": (0.111, 0.2)}


def test_mixing_meets_given_targets(spark):
    rows = [(i, "w " * 10, f"s{i % 2}", "en" if i % 4 < 3 else "fr") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"lang": spark.createDataFrame([("en", 0.5), ("fr", 0.5)], "value string, share double"), "source": spark.createDataFrame([("s0", 0.6), ("s1", 0.4)], "value string, share double")}
    got = mixing.weigh(df, None, targets, budget=0.4, rounds=30).groupBy("lang").agg((F.sum(F.col("n_tokens") * F.col("probability")) / 40000).alias("e")).collect()
    assert {r.lang: round(r.e, 3) for r in got} == {"en": 0.2, "fr": 0.2}


# 7


def test_url_rules(spark):
    urls = ["http://Example.COM/en/7x?q", "https://a.b.com/en/", "http://xcom/en/", "ftp://net/de/1", "http://m.example.net/de/8#f", "http://example.net/de/9", "http://h?x/y", "http://h#f", "no scheme", "", None, "http://org/es", "http://www.org/es/a.html", "x://é.org/es/É", "http://a.org/es/?b=://com/en/", "a\nb://c.com/en/"]
    df = spark.createDataFrame([(i, u, "clash", "c") for i, u in enumerate(urls)] + [(None, urls[1], "", "")], "page_id long, url string, host string, key string")
    got = {r.page_id: r for r in url_filter.judge(df, spark.createDataFrame([("xcom/en",), (None,), ("",)], "key string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("example.com", "/en/7x", "example.com/en/7", "allow"), ("a.b.com", "/en/", "com/en/", "block"), ("xcom", "/en/", None, "block"), ("net", "/de/1", "net/de/", "allow"), ("m.example.net", "/de/8", "example.net/de/8", "block"),
        ("example.net", "/de/9", "net/de/", "allow"), ("h", "", None, "allow"), ("h", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "/es", None, "allow"),
        ("www.org", "/es/a.html", "org/es/", "block"), ("é.org", "/es/É", "org/es/", "block"), ("a.org", "/es/", "org/es/", "block"), ("c.com", "/en/", "com/en/", "block"),
    ]
    assert None in got


@pytest.mark.parametrize("broadcast_blocks", [200_000, 0])
def test_listed_urls_are_found_exactly(spark, broadcast_blocks):
    listed = spark.createDataFrame([(f"h{i}/p{i}",) for i in range(0, 2000, 2)], "key string")
    urls = spark.createDataFrame([(f"h{i}/p{i}", i) for i in range(2000)] + [("h0/p0", -2), ("", 1), (None, 3), ("x" * 300_000, 5)], "key string, n int")
    got = url_filter.listed_hits(urls, listed, broadcast_blocks)
    assert got.columns == ["key", "n", "hit"] and got.count() == 2004 and got.where("hit <> (n % 2 = 0)").count() == 0


# 8


def test_licenses(spark):
    r = random.Random(5)
    filler = lambda n: " ".join(r.choice(["lorem", "the", "license", "under", "of", "version", "ipsum", "dolor"]) for _ in range(n))
    names = sorted(licenses.TEMPLATES)
    rows: list = [(i, f"{filler(300)}\n{licenses.TEMPLATES[n]}\n{filler(300)}") for i, n in enumerate(names)]
    rows += [(100, filler(5000)), (101, None), (102, ""), (103, " ".join([licenses.TEMPLATES["MIT"]] * 3)), (104, "RELEASED, under the (MIT) License."), (None, licenses.TEMPLATES["GPL-3.0"]), (105, "Released " + filler(50) + " MIT License")]
    got = {x.doc_id: x for x in licenses.scan(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, n in enumerate(names):
        assert n in got[i].licenses and got[i].coverage == 1.0, n
    assert [got[i].license for i in (100, 101, 102, 103, 104, None)] == [None, None, None, "MIT", "MIT", "GPL-3.0"]
    assert (got[104].first_word, got[104].end_word) == (0, 5) and got[105].license is None


@pytest.mark.parametrize("copies", [2, 3])
def test_repeated_notices_inside_texts(copies):
    """Each notice several times, back to back or with short gaps, in the middle of a text; whole, or with a word lost or put in."""
    words = {n: licenses.words_of(t) for n, t in licenses.TEMPLATES.items()}
    other = [b"other%d" % i for i in range(30)]
    for name, notice in words.items():
        for gap in (0, 1, len(notice) // 4, len(notice) // 2):
            between = [b"gap%d" % i for i in range(gap)]
            for at in range(0, len(notice), max(1, len(notice) // 6)):
                for one in [notice, notice[:at] + [b"new"] + notice[at:]] + ([notice[:at] + notice[at + 1 :]] if len(notice) >= 5 else []):
                    found = {x[0]: x[1:] for x in licenses.find(other + (one + between) * copies + other, {name: notice})}
                    assert found[name][0] >= min(1, len(one) / len(notice)), (name, gap, at)
                    if one == notice:
                        assert found[name] == (1.0, 30, 30 + len(notice)), (name, gap)


def test_deciding_words_and_whole_licenses(spark):
    text = licenses.TEXTS
    three = text["BSD-3-Clause text"].replace("copyright holder nor", "Example Corporation nor")
    cases = [
        ("Released under the BSD License", "BSD"), ("Released under the Foo License", None), ("Licensed under the Mozilla Public License, Version 2.0", "MPL-2.0"), ("Licensed under the Foo License, Version 2.0", None),
        ("Licensed under CC BY 4.0", "CC-BY-4.0 short"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"), ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"), ("Licensed under CC BY-SA 3.0", None),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0 notice"),
        ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("This work is licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"), (licenses.TEMPLATES["LGPL-3.0 notice"], "LGPL-3.0 notice"),
        (three, "BSD-3-Clause text"), (three + " other words between " * 9 + text["BSD-2-Clause text"], "BSD-2-Clause text"), *[(t, n) for n, t in text.items()], (licenses.TEMPLATES["BSD opening"], "BSD opening"),
    ]
    got = {x.doc_id: x for x in licenses.scan(docs(spark, [(i, "some words before. " * 9 + t + " and some after. " * 9) for i, (t, _) in enumerate(cases)])).collect()}
    wrong = [(want, got[i].licenses) for i, (_, want) in enumerate(cases) if want not in (got[i].licenses or [None])]
    assert not wrong
    for i, (_, want) in enumerate(cases):  # and no other license
        assert {n.split(" ")[0] for n in got[i].licenses} <= ({"BSD-3-Clause", "BSD-2-Clause"} if "between" in cases[i][0] and want == "BSD-2-Clause text" else {str(want).split(" ")[0]}), (want, got[i].licenses)


def prepared():
    words = {n: licenses.words_of(t) for n, t in sorted({**licenses.TEMPLATES, **licenses.TEXTS}.items())}
    must = {n: set(licenses.words_of(licenses.DECIDING.get(n, licenses.DECIDING.get(n.split(" ")[0], "")))) for n in words}
    return words, licenses.Templates(words, must)


def test_several_licenses_in_one_text():
    """All ordered pairs of templates with several gaps: the licenses found are those that each of the two is found as alone."""
    words, known = prepared()
    own = lambda found: {x[0].split(" ")[0] for x in found}
    alone = {n: own(licenses.find(w, known)) for n, w in words.items()}
    assert all(n.split(" ")[0] in found for n, found in alone.items())
    whole = set(licenses.TEXTS)
    for k, a in enumerate(words):
        for m, b in enumerate(words):
            for gap in (0, 40, 800) if not {a, b} & whole else (0, 40) if {a, b} <= whole else ((0, 1, 40)[(k + m) % 3],):
                if {a, b} & {"BSD opening"} and {a, b} & {"BSD-2-Clause text", "BSD-3-Clause text"}:
                    continue  # which open with these words themselves
                text = words[a] + [b"gap%d" % i for i in range(gap)] + words[b]
                assert own(licenses.find(text, known)) == alone[a] | alone[b], (a, b, gap)
    found = {x[0]: x[1:] for x in licenses.find(words["LGPL-3.0 text"] + words["GPL-3.0 text"] + words["AGPL-3.0 notice"], known)}
    at = len(words["LGPL-3.0 text"])
    assert found["LGPL-3.0 text"] == (1.0, 0, at) and found["GPL-3.0 text"][:2] == (1.0, at) and found["AGPL-3.0 notice"][0] == 1.0


def test_long_texts_take_no_longer_per_word():
    """Whole licenses in a row, words of a license in any order, notices and stock phrases over and over: a second or two at most."""
    words, known = prepared()
    r = random.Random(3)
    gpl = words["GPL-3.0 text"]
    mixed = [r.choice(gpl) for _ in range(16000)] + [b"other%d" % r.randrange(999) for _ in range(4000)]
    r.shuffle(mixed)
    for text, want in ((words["GPL-3.0 text"] + words["MPL-2.0 text"], {"GPL-3.0 text", "MPL-2.0 text"}), (mixed, set()), ((words["MIT notice"] + [b"between"]) * 700, {"MIT notice"}), (b"under the terms of the license ".split() * 3000, set()), (gpl * 4, {"GPL-3.0 text"})):
        began = time.time()
        found = {x[0] for x in licenses.find(text, known)}
        assert want <= found and time.time() - began < 10
        assert found or not want


def plain_patience(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment from its definition: equal ends first, then words unique to both sides, the longest increasing
    run of their places (by dynamic programming), and the same within the gaps."""
    n, head = min(len(a), len(b)), 0
    while head < n and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < n - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    ends = [(i, i) for i in range(head)] + [(len(a) - 1 - i, len(b) - 1 - i) for i in range(tail)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    anchors = [(x.index(w), j) for j, w in enumerate(y) if x.count(w) == 1 and y.count(w) == 1]
    length: list[int] = []
    for k, (i, _) in enumerate(anchors):
        length.append(1 + max((length[m] for m in range(k) if anchors[m][0] < i), default=0))
    most, run = max(length, default=0), []
    for want in range(most, 0, -1):
        run.append(next(p for k, p in reversed(list(enumerate(anchors))) if length[k] == want and (not run or p[0] < run[-1][0] and p[1] < run[-1][1])))
    if not run:
        return sorted(ends)
    run.reverse()
    out, before = [], (-1, -1)
    for p in [*run, (len(x), len(y))]:
        out += [(i + before[0] + 1, j + before[1] + 1) for i, j in plain_patience(x[before[0] + 1 : p[0]], y[before[1] + 1 : p[1]])]
        out += [p] if p != (len(x), len(y)) else []
        before = p
    return sorted(ends + [(i + head, j + head) for i, j in out])


def test_alignment_is_what_patience_gives():
    r = random.Random(12)
    for _ in range(400):
        a, b = ([r.choice("abcdefghijklmnop") for _ in range(r.randint(0, 20))] for _ in range(2))
        mine, plain = licenses.align(a, b), plain_patience(a, b)
        assert len(mine) == len(plain) or sorted(mine) != sorted(plain)  # several longest runs may differ
        assert not mine == [] or plain == []
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert len(mine) == len(plain)
    for _ in range(100):
        a = r.sample(range(60), 40)
        b = [w for w in a if r.random() > 0.2]
        assert licenses.align(a, b) == plain_patience(a, b)


def brute_find(words, template, least, dense, must):
    """Every stretch of the text of up to twice the template's length, aligned as a whole: the best coverage that counts as a find."""
    best = 0.0
    for start in range(len(words)):
        for end in range(start + 1, min(len(words), start + int(len(template) / dense) + 1) + 1):
            pairs = plain_patience(words[start:end], template)
            if pairs and len(pairs) >= least * len(template) and len(pairs) >= dense * (pairs[-1][0] - pairs[0][0] + 1) and must <= {template[j] for _, j in pairs}:
                best = max(best, len(pairs) / len(template))
    return best


def test_finds_are_those_of_a_plain_search():
    """Short notices among other and common words, damaged or not: found if and only if a search of every stretch finds them, and as well."""
    r = random.Random(13)
    names = ["MIT", "BSD", "CC-BY-4.0 short", "Apache-2.0", "GPL-3.0"]
    for k in range(60):
        name = names[k % len(names)]
        template = licenses.words_of(licenses.TEMPLATES[name])
        must = set(licenses.words_of(licenses.DECIDING[name]))
        text = [r.choice([b"license", b"the", b"under", b"lorem", b"ipsum", b"version"]) for _ in range(r.randint(0, 12))]
        for _ in range(r.randint(1, 2)):
            notice = list(template)
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(notice))
                notice[at : at + 1] = r.choice([[], [b"new"], [notice[at], b"new"]])
            text += notice + [r.choice([b"the", b"license", b"dolor"]) for _ in range(r.randint(0, 6))]
        want = brute_find(text, template, licenses.LEAST, licenses.DENSE, must)
        got = licenses.find(text, {name: template}, deciding={name: must})
        assert (got[0][1] if got else 0.0) == pytest.approx(want), (name, text)


def test_alignment_is_increasing_and_equal():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.align(list("abcde"), list("abXde"))) == 4


# 9


def test_quality_sample_skips_what_does_not_fit(spark):
    """The first text of each label is over the bound, and one in the middle over what is left: the others are still fitted on."""
    ids = [r.id for r in spark.range(200).where(~quality.held_out(F.col("id"))).orderBy(F.xxhash64("id")).collect()]
    size = lambda k: 9000 if k < 2 else 4000 if k in (20, 21) else 40
    rows = [(i, ("good " if k % 2 else "poor ") * (size(k) // 5)) for k, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    seen = []
    original, quality.fit_texts = quality.fit_texts, lambda good, bad, *more: seen.append((good, bad)) or original(good, bad, *more)
    try:
        assert quality.fit(docs(spark, rows), labels, sample_bytes=4100) is not None
    finally:
        quality.fit_texts = original
    for got, first in zip(seen[0], (1, 0), strict=True):
        want, room = [], 4100
        for k, (_, t) in enumerate(rows):
            if k % 2 == first and len(t) <= room:
                want, room = [*want, t], room - len(t)
        assert got == want and len(want) > 50
    few, many = (quality.fit_texts(["good " * 4000], ["poor " * 4000], n) for n in (2, 50))
    assert len(few.good) < len(many.good)


def test_quality(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "in", "ti"]) for _ in range(r.randint(1, 4)))
    good = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(r.randint(2, 40)))
    bad = lambda: " ".join(word().upper() + r.choice(["!!", "$$$", "###", "***"]) for _ in range(r.randint(20, 300)))
    rows = [(i, good() if i % 3 else bad()) for i in range(900)] + [(2000, None), (2001, ""), (None, good()), (2002, "x" * 200_000), (5, "repeated id")]
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, None) for i in range(900)] + [(2000, None, 1), (None, 1, 1), (3, 7, 1)], "doc_id long, quality int, toxic int")
    frame = docs(spark, rows)
    model = quality.fit(frame, labels)
    got = [x for x in quality.score(frame, model).collect()]
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in got)
    for x in got:
        assert x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
    tested = [x for x in got if x.held_out and x.doc_id < 900 and x.doc_id != 5]
    assert sum(x.predicted == (x.doc_id % 3 > 0) for x in tested) >= 0.97 * len(tested)
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(x.predicted for x in got)
    nothing = quality.fit(frame, labels.where("false"))
    assert nothing is None and {x.score for x in quality.score(frame, nothing).collect()} == {0.5}


def test_scores_are_the_stated_ones():
    """A plain recomputation: sizes by zstandard's own simple calls, and the logistic formula."""
    import math

    import zstandard

    r = random.Random(11)
    text = lambda good: " ".join(r.choice(["about", "river", "stone", "light"] if good else ["$$$", "BUY", "now!!", "click"]) + str(r.randint(0, 99)) for _ in range(r.randint(1, 200)))
    good, bad = [text(True) for _ in range(300)], [text(False) for _ in range(300)]
    model = quality.fit_texts(good, bad)
    for t in [*good[:20], *bad[:20], "", "x", "é" * 1000, "word " * 4000]:
        raw, sizes = t.encode(), []
        for dictionary in (model.good, model.bad):
            own = zstandard.ZstdCompressionDict(dictionary)
            sizes.append(sum(len(zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=False, write_dict_id=False).compress(raw[k : k + 256])) for k in range(0, max(1, len(raw)), 256)))
        terms = [(sizes[1] - sizes[0]) / (len(raw) + 32), 1 / math.sqrt(len(raw) + 32)]
        z = sum(w * (x - c) / s for w, x, c, s in zip(model.weights, terms, model.centre, model.scale, strict=False)) + model.weights[-1]
        assert model.scores([t])[0] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, z)))), abs=1e-9)
    assert model.weights[0] > 0  # the better the good dictionary does, the better the score


def test_held_out_documents_are_told_apart(spark):
    """The registered query against the labels that the fit doesn't see."""
    labels = common.table(spark, "/root/testdata/sf0.1", "labels").select("doc_id", "quality")
    got = [(r.score, r.predicted, r.quality) for r in quality.query(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()]
    good, bad = [x for x in got if x[2] == 1], [x for x in got if x[2] == 0]
    assert len(good) > 500 and len(bad) > 50
    assert sum(x[1] for x in good) >= 0.98 * len(good) and sum(1 - x[1] for x in bad) >= 0.9 * len(bad)
    assert sum(g[0] > b[0] for g in good for b in bad) >= 0.99 * len(good) * len(bad)  # area under the curve


# 10


def test_texts_go_to_python_in_small_batches(spark):
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.num_rows]), "b": pa.array([batch.nbytes])})

    docs = spark.range(0, 24, 1, 1).selectExpr("id AS doc_id", "repeat('word ', IF(id = 5, 4000000, 200000)) AS text")  # 1 MB each and one of 20 MB
    model = quality.fit_texts(["some good words"] * 30, ["!! ?? !!"] * 30)
    try:
        for built in (lambda: packing.pieces(docs, packing.vocabulary()), lambda: near_dedup.fingerprints(docs), lambda: quality.score(docs, model), lambda: quality.keep_good(docs, model)):
            spark.conf.unset(common.BATCH_CONF)
            built()
            assert spark.conf.get(common.BATCH_CONF) == str(common.BATCH_BYTES)
        found = common.map_texts(docs, sizes, "n long, b long").collect()
        assert len(found) > 2 and sum(r.n for r in found) == 24 and sum(r.b for r in found) >= 43_000_000
        assert sorted(r.b for r in found)[-2] < common.BATCH_BYTES + 1_100_000 and max(r.b for r in found) < common.BATCH_BYTES + 20_100_000
        spark.conf.set(common.BATCH_CONF, "1m")  # a session's own limit stays
        common.map_texts(docs, sizes, "n long, b long")
        assert spark.conf.get(common.BATCH_CONF) == "1m"
    finally:
        spark.conf.unset(common.BATCH_CONF)


def test_free_memory_is_given_back():
    def held() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1])

    before = held()
    words, last = [str(i) * 3 for i in range(1_500_000)], "z" * 90  # the last keeps the heap from shrinking by itself
    full = held()
    words = words[-1:]
    common.give_back()
    assert full - before > 80_000 and held() < before + (full - before) // 2 and words and last


def test_encoder_is_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    own, whole = packing.Encoder(packing.vocabulary()), Tokenizer.from_file(packing.vocabulary())
    r = random.Random(8)
    alphabet = list("abcXYZ 'sStTdm0123.,!&$#*|\n\t-éÉßñİıſ\u0301\u0338\u00a0\u2028中文ﬁ①٣<>Ⅷªक़שׁДκΐ") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|endofTEXT|>X", "it's", "'ll", "don't"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(800)] + [None, "", "word " * 5000]
    ids, counts = own.encode(pa.array(texts))
    ends = np.cumsum(counts)
    for t, n, end in zip(texts, counts, ends, strict=True):
        assert ids[end - n : end].tolist() == whole.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_known_words_are_not_looked_at_again(monkeypatch):
    """Words that a worker has met aren't matched anew with a later chunk's, whatever it has forgotten meanwhile."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    own, whole = packing.Encoder(packing.vocabulary()), Tokenizer.from_file(packing.vocabulary())
    r, looked_at, match = random.Random(3), [], pc.match_substring_regex
    monkeypatch.setattr(pc, "match_substring_regex", lambda x, *a, **k: (looked_at.append(len(x)), match(x, *a, **k))[1])
    texts = [" ".join(r.choice(["stone", "Stone,", "don't", "rivers", "river.", "x9-y"]) + r.choice(["", "s", "!"]) for _ in range(30)) for _ in range(40)]

    def check(some):
        ids, counts = own.encode(pa.array(some, pa.string()))
        ends = np.cumsum(counts)
        assert [ids[end - n : end].tolist() for n, end in zip(counts, ends, strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in some]

    monkeypatch.setattr(packing, "AT_ONCE", 7, raising=False)
    check(texts)
    met = sum(looked_at)
    check(texts[::-1])
    assert met and sum(looked_at) == met
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    for k in range(0, 40, 10):
        check(texts[k : k + 10])
    check([])
    check(["", " "])


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = corpus(150)
    cut = packing.pieces(docs(spark, rows), packing.vocabulary(), capacity=128)
    got = packing.pack(cut, 128).collect()
    whole, want = Tokenizer.from_file(packing.vocabulary()), []
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k, k * 128, ids[k * 128 : (k + 1) * 128]) for k in range(-(-len(ids) // 128))]
    assert sorted(((r.doc_id, r.piece, r.start, list(r.ids)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.05 * sum(r.length for r in got) / 128 + 2


def test_plan_places_every_piece_once():
    r = random.Random(9)
    for capacity in (1, 2, 3, 10, 100):
        counts = {r.randint(1, capacity): r.randint(1, 50) for _ in range(30)}
        used, spots = defaultdict(list), defaultdict(list)
        for n, a, b, first, offset in packing.plan(counts, capacity):
            used[n] += range(a, b)
            for k in range(a, b):
                spots[first + k - a].append((offset, n))
        assert {n: sorted(v) for n, v in used.items()} == {n: list(range(c)) for n, c in counts.items()}
        for parts in spots.values():
            parts.sort()
            assert all(x + n == y for (x, n), (y, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(n for _, n in parts) <= capacity
            assert sum(n > capacity // 3 for _, n in parts) <= 2


# all


# 11


INSULTS = ["blorgish", "blorgen", "blorgix", "snarlik", "snarlen", "snarlot"]


def marked(n: int, seed: int = 4, least: int = 2) -> list[tuple[int, str, int]]:
    """Texts of invented words, a quarter of them with insults, some in forms that are seen once."""
    r = random.Random(seed)
    syllables = ["an", "er", "tion", "he", "re", "th", "ou", "es", "ble", "sn", "bl"]
    rows = []
    for i in range(n):
        body = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(5, 200))]
        toxic = int(i % 4 == 0)
        for _ in range(r.randint(least, 5) if toxic else 0):
            body.insert(r.randrange(len(body)), r.choice([*INSULTS, "blorg" + r.choice(syllables)]))
        rows.append((i, " ".join(body), toxic))
    return rows


def brute_chain(z, turns):
    """Marginals and the log probability of no toxic word, by all tag sequences."""
    import itertools

    weights, t = {}, [[0.0, turns[0]], [turns[1], turns[2]]]
    for tags in itertools.product((0, 1), repeat=len(z)):
        w = sum(z[i] for i, k in enumerate(tags) if k) + turns[3] * tags[0] + sum(t[a][b] for a, b in zip(tags, tags[1:], strict=False))
        weights[tags] = np.exp(w)
    total = sum(weights.values())
    return [sum(w for tags, w in weights.items() if tags[i]) / total for i in range(len(z))], np.log(weights[(0,) * len(z)] / total)


def test_marginals_are_those_of_all_tag_sequences():
    r = np.random.default_rng(5)
    for _ in range(20):
        texts = [" ".join("abc"[k % 3] for k in range(n)) for n in r.integers(0, 8, 5)]
        tokens = toxicity.Tokens(texts)
        z, turns = r.normal(0, 2, len(tokens)), r.normal(0, 1, 4)
        p, odds, _, _ = toxicity.chain(tokens, z, turns)
        clean = toxicity._log_clean(tokens, odds, turns)
        for d, t in enumerate(texts):
            own = tokens.doc == d
            assert own.sum() == len(t.split())
            if own.any():
                want, none = brute_chain(z[own], turns)
                assert np.allclose(p[own], want) and np.isclose(clean[d], none)
            else:
                assert clean[d] == 0


def test_long_chains_are_scanned_in_blocks():
    r = np.random.default_rng(6)
    a, b, c, d = r.random(5000), r.random(5000), r.random(5000) + 0.1, r.random(5000)
    want, x = [], 0.0
    for i in range(5000):
        x = (a[i] + b[i] * x) / (c[i] + d[i] * x)
        want.append(x)
    assert np.allclose(toxicity.scan(a, b, c, d), want)


def test_words_look_alike_wherever_they_stand():
    tokens = toxicity.Tokens(["An Éclair, (eclair) été.", "ÉTÉ! éclair -- x", None, ""])
    words = [tokens.buf[s:e].tobytes().decode() for s, e in zip(tokens.starts, tokens.ends, strict=True)]
    assert words == ["An", "Éclair,", "(eclair)", "été.", "ÉTÉ!", "éclair", "--", "x"] and tokens.doc.tolist() == [0, 0, 0, 0, 1, 1, 1, 1]
    same = lambda a, b: tokens.hashes[:8, a].tolist() == tokens.hashes[:8, b].tolist()
    assert same(1, 5) and same(3, 4) and not same(1, 2)
    other = toxicity.Tokens(["x " * 500 + "éclair"])
    assert other.hashes[:8, -1].tolist() == tokens.hashes[:8, 5].tolist()


def test_toxicity(spark):
    rows = marked(400)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5, 7), (None, 1)], "doc_id long, toxic int")
    texts = [(i, t) for i, t, _ in rows] + [(None, rows[0][1]), (1000, None), (1001, ""), (1002, "... !!!"), (1003, rows[0][1]), (1003, rows[0][1]), (1004, "blorgish " + rows[1][1]), (1005, "an er tion " * 40000 + "you snarlik blorgix")]
    table = docs(spark, texts)
    field = toxicity.fit(table, labels)
    got = toxicity.score(table, field).collect()
    assert len(got) == len(texts) and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got)
    by_id = {g.doc_id: g for g in got}
    y = {i: k for i, _, k in rows}
    held = [g for g in got if g.held_out]
    assert {g.doc_id for g in held} == {i for i in [*y, *range(1000, 1006)] if zlib.crc32(str(i).encode()) % 3 == 1}
    judged = [(g.predicted, y[g.doc_id]) for g in held if g.doc_id in y]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)
    assert by_id[1001].score == by_id[1000].score < 0.7 and by_id[1002].score < 0.7 and by_id[1003].score == by_id[0].score and not by_id[None].held_out
    text = {i: t for i, t in texts}
    for i in (0, 4, 1005):  # spans are where the insults stand
        assert by_id[i].predicted == 1
        for s in by_id[i].spans:
            assert all(w.startswith(("blorg", "snar")) for w in text[i][s.start : s.end].split()), (i, s)
    assert by_id[1005].spans[-1].end == len(text[1005])  # at the end of a long text
    assert sum(len(by_id[i].spans) for i, _, k in rows if not k) <= 3
    # labels, and no other column, decide; without both kinds of labels nothing is known
    assert toxicity.fit(table, labels.where("toxic = 0")) is None
    assert {g.score for g in toxicity.score(table, None).collect()} == {0.5}
    few = toxicity.fit(table, labels, sample_rows=30, sample_bytes=20000)
    assert few is not None and toxicity.score(table, few).count() == len(texts)


def test_labelled_sample_is_bounded_with_repeated_ids(spark):
    """An id with many rows gives no more than the bound, and equal rows are one."""
    rows = [(7, f"text {k}") for k in range(50)] + [(8, "same")] * 40 + [(9, "other"), (None, "x")]
    labels = spark.createDataFrame([(7, 1), (8, 0), (9, 0), (9, 2)], "doc_id long, quality int")
    got, counts = common.labelled_sample(docs(spark, rows), labels, lambda c: F.lit(False), "doc_id", "text", "quality", 10, 1 << 20)
    assert len(got[1]) == 10 and set(got[1]) <= {t for _, t in rows} and sorted(got[0]) in (["other", "same"], ["same"]) and counts == {0: 2, 1: 1}
    got, _ = common.labelled_sample(docs(spark, rows), labels, lambda c: F.lit(False), "doc_id", "text", "quality", 60, 20)
    assert 14 <= sum(map(len, got[1])) <= 20 and sorted(got[0]) == ["other", "same"]


# 12


def brute_variants(rows, least=7):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += len(w) >= least
    count = {w: n for w, n in count.items() if n >= 2}
    near = {w: {v for v in count if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)} for w in count}
    form = {w: min((v for v in near[w] if count[v] >= 10 * count[w]), key=lambda v: (-count[v], v), default=None) for w in count}
    out = []
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], count.get(form[w]), root))
    return sorted(out, key=repr)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k:] == b[k + 1 :] or len(a) == len(b) and a[k + 1 :] == b[k + 1 :]


def test_spelling_variants(spark):
    r = random.Random(8)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(6, 12))) for _ in range(60)] + ["aaaaaaaa", "abababab", "ÀÉÎÕÜÿß×÷ab"]

    def damaged(w):
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            k = r.randrange(len(w) + 1)
            w = r.choice([w[:k] + r.choice("abcéz") + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice("abcéz") + w[k + 1 :]])
        return w

    rows = [(i, " ".join(r.choice([str.upper, str.lower])(damaged(base[int(len(base) * r.random() ** 3)])) + r.choice(["", ",", "1", "_"]) for _ in range(120))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "short words only 12"), rows[0], (None, rows[1][1]), (103, "abcabcab " * 3000), (104, "chainabc " * 2 + "chainabcd " * 25 + "chainabcde " * 260)]
    got = rows_of(spelling.variants(docs(spark, rows)), "word", "n", "n_near", "form", "form_n", "root")
    want = brute_variants(rows)
    assert got == want and len(got) > 300
    assert sum(1 for w in want if w[3]) > 50 and any(w[5] != w[3] and w[3] for w in want)  # and chains of forms


def test_pivots_are_two_disjoint_rare_bigrams():
    r = random.Random(2)
    for _ in range(300):
        w = "".join(r.choice("abcd") for _ in range(r.randint(7, 12)))
        rank = {g: k for k, g in enumerate(r.sample([a + b for a in "abcd" for b in "abcd"], 16))}
        prefix = sorted((rank[w[i : i + 2]], i) for i in range(len(w) - 1))[:3]
        a, b = spelling.pivots(prefix)
        pairs = [(x[0] + y[0]) for x in prefix for y in prefix if x[1] + 2 <= y[1]]
        assert a + 2 <= b and rank[w[a : a + 2]] + rank[w[b : b + 2]] == min(pairs)


def test_every_word_one_edit_away_is_met():
    """For random words and any ranking, one of two words is looked up by a key that the other is found by."""
    r = random.Random(3)
    for _ in range(3000):
        w = "".join(r.choice("abc") for _ in range(r.randint(7, 11)))
        k = r.randrange(len(w) + 1)
        v = r.choice([w[:k] + r.choice("abcd") + w[k:], w[:k] + w[k + 1 :], w[:k] + r.choice("abcd") + w[k + 1 :]])
        if v == w or len(v) < 7:
            continue
        grams = [a + b for a in "abcd" for b in "abcd"]
        rank = {g: i for i, g in enumerate(r.sample(grams, 16))}
        (asks, answers), (asks_v, answers_v) = spelling.signatures(w, rank), spelling.signatures(v, rank)
        assert asks & answers_v or asks_v & answers, (w, v)


# 13


@pytest.mark.parametrize("kind", ["random", "equal eigenvalues", "low rank", "diagonal", "wide range", "ones"])
def test_divide_and_conquer_gives_the_eigenvectors(kind):
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 33, 64):
        b = r.normal(size=(n, n))
        q, _ = np.linalg.qr(b)
        a = {"random": b @ b.T, "equal eigenvalues": q @ np.diag(np.round(np.linspace(1, 4, n))) @ q.T, "low rank": b[:, : n // 3] @ b[:, : n // 3].T, "diagonal": np.diag(np.arange(n) * 1.0), "wide range": q @ np.diag(10.0 ** -np.arange(n)) @ q.T, "ones": np.ones((n, n))}[kind]
        values, vectors = whitening.eigen(a)
        size = max(1e-300, np.abs(np.linalg.eigvalsh(a)).max())
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-12 * size
        assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12 and np.abs(a @ vectors - vectors * values).max() <= 1e-12 * size
    u = whitening.polar(np.diag([3.0, -2.0, 1e-9]))
    assert np.allclose(u, np.diag([1.0, -1.0, 1.0]), atol=1e-12)


def brute_whitening(rows, components):
    width = max(len(v) for _, v in rows)
    x = [(i, [int(np.floor(64 * c)) + 1000000 for c in v] + [1000000] * (width - len(v))) for i, v in rows]
    distinct = sorted({tuple(v) for _, v in x})
    n, sums = len(distinct), [sum(v[k] for v in distinct) for k in range(width)]
    d = np.array([[v[k] - sums[k] / n for k in range(width)] for v in distinct])
    values, vectors = np.linalg.eigh(d.T @ d / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:components] > 1e-9).sum())
    out = {}
    for i, v in x:
        z = (np.array(v) - np.array(sums) / n) @ vectors[:, :kept] / np.sqrt(values[:kept])
        out.setdefault(i, []).append((n, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), np.abs(z), values[:kept] / values.sum()))
    return out, kept


def test_whitening(spark):
    r = np.random.default_rng(2)
    rows = [(i, list(map(float, r.normal(size=20) * np.linspace(0.2, 3, 20)))) for i in range(300)]
    rows += [(500 + i, rows[0][1]) for i in range(200)]  # copies are fitted once
    rows += [(3, rows[3][1]), (None, rows[4][1]), (700, rows[5][1][:12]), (701, [])]
    odd = [(800, None), (801, [None] + rows[0][1][1:]), (802, [float("nan")] + rows[0][1][1:]), (803, [float("inf")] * 20)]
    frame = spark.createDataFrame([(i, v, "clash", 7) for i, v in rows + odd], "vec_id long, embedding array<double>, x string, n int")
    got = whitening.whiten(frame, whitening.fit(frame)).collect()
    want, kept = brute_whitening(rows, 16)
    assert kept == 16 and len(got) == 16 * len(rows)
    cells = {}
    for g in got:
        cells.setdefault((g.vec_id, g.component), []).append(g)
    assert {i for i, _ in cells} == {i for i, _ in rows}
    signs = {}
    for (i, c), found in cells.items():
        assert len(found) == len(want[i])
        for g in found:
            n, deviation, z, explained = want[i][0]
            assert (g.n, g.deviation) == (n, deviation) and abs(abs(g.whitened) - z[c - 1]) < 1e-8 and abs(g.explained - explained[c - 1]) < 1e-12 and g.identity_error < 1e-10
            signs.setdefault(c, []).append(g.whitened)
    few = whitening.whiten(frame, whitening.fit(frame, components=3))
    assert few.count() == 3 * len(rows)


def test_whitening_of_tables_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.fit(spark.createDataFrame([], schema)) is None
    for rows in ([(1, [0.5, 1.5])], [(1, [0.5, 1.5])] * 3, [(1, []), (2, [])]):
        frame = spark.createDataFrame(rows, schema)
        assert whitening.whiten(frame, whitening.fit(frame)).count() == 0
    line = spark.createDataFrame([(i, [i * 1.0, 2.0 * i, 5.0]) for i in range(6)], schema)  # one direction only
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert {g.component for g in got} == {1} and len(got) == 6 and abs(got[0].explained - 1) < 1e-12
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 4.0])], schema)  # held at a long's bounds
    got = whitening.whiten(far, whitening.fit(far)).collect()
    assert got and all(np.isfinite(g.whitened) for g in got) and max(g.deviation for g in got) == 2**63 - 1


def test_empty_tables(spark):
    none = docs(spark, []).limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        substring_dedup.deduplicate(none), vector_search.top_k(vectors, F.col("vec_id") % 50 == 0), warc.read(warc.write(warc.assign(pages))), near_dedup.near_duplicates(none), exact_dedup.groups(none), mixing.weigh(none),
        url_filter.judge(pages, url_filter.tracked(pages)), licenses.scan(none), quality.score(none, quality.fit(none, labels)), packing.pack(packing.pieces(none, packing.vocabulary())), exact_dedup.deduplicate(none), near_dedup.deduplicate(none), mixing.sample(none),
        toxicity.score(none, toxicity.fit(none, labels.withColumnRenamed("quality", "toxic"))), spelling.variants(none), whitening.whiten(vectors, whitening.fit(vectors)),
    ):
        assert df.collect() == []
