"""The pipeline's rows against a plain version of every stage, each on its predecessor's rows."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from newsgraph.llm import common, mixing, near_dedup, packing, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline(spark, sf, tmp_path):
    docs = common.table(spark, sf, "documents")
    plain = docs.toPandas()
    labels = common.table(spark, sf, "labels")
    embeddings = common.table(spark, sf, "embeddings").toPandas()
    frames = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(docs.toPandas())
    assert all(list(f.columns) == COLUMNS for f in frames[:4])

    model = quality.fit(common.table(spark, sf, "documents"), labels)
    plain = plain[model.scores(plain.text.tolist()) >= 0.3]
    assert set(frames[0].doc_id) == set(plain.doc_id) and len(frames[0]) == len(plain) > 100

    plain = plain[plain.doc_id == plain.groupby("text").doc_id.transform("max")]
    assert set(frames[1].doc_id) == set(plain.doc_id) and len(frames[1]) == len(plain)

    fps = np.array([near_dedup.fingerprint(t) for t in plain.text], np.uint64)
    ids, label = plain.doc_id.to_numpy(), plain.doc_id.to_numpy().copy()
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = label[i], label[j]
            label[(label == a) | (label == b)] = min(a, b)
    plain = plain[label == ids]
    assert set(frames[2].doc_id) == set(plain.doc_id) and len(frames[2]) == len(plain)

    con = duckdb.connect()
    con.register("documents", plain)
    con.register("embeddings", embeddings)
    chosen = con.sql(mixing.ORACLE_SQL).df()
    plain = plain[plain.doc_id.isin(chosen[chosen.sampled].doc_id)]
    assert set(frames[3].doc_id) == set(plain.doc_id) and 0 < len(plain) < len(frames[2])

    whole, want = Tokenizer.from_file(packing.vocabulary()), []
    for i, t in zip(plain.doc_id, plain.text, strict=True):
        own = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, 2048 * k, len(own[2048 * k : 2048 * k + 2048]), zlib.crc32(own[2048 * k : 2048 * k + 2048].tobytes())) for k in range(-(-len(own) // 2048))]
    got = frames[4]
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 2048
    assert isinstance(frames[4], pd.DataFrame) and got.sequence_id.nunique() <= 1.05 * got.length.sum() / 2048 + 1


ODD = "doc_id long, text string, lang string, source string, n_chars long, fp string, _c0 string, _id long, key string, label int, digest string"


def odd_rows():
    long = " ".join(f"word{i}" for i in range(30_000))
    texts = [(1, None), (2, ""), (None, None), (3, "  \n"), (4, "one"), (5, long), (6, long), (6, long), (7, long + " more"), (None, "no id here at all"), (None, "no id here at all"), (8, "one"), (9, "Some words, and some more. " * 5), (9, "other text of the same id")]
    return [(i, t, None if i == 4 else "en", None if i in (5, 9) else "s", 0, "clash", "c", 7, "k", 1, "d") for i, t in texts]


@pytest.mark.parametrize("labelled", [True, False])
def test_stages_on_odd_rows(spark, tmp_path, labelled):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns, at every stage."""
    rows = odd_rows()
    spark.createDataFrame([(i, k % 2) for k, i in enumerate(range(1, 10))] if labelled else [], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, [0.5], 3, "x"), (9, [0.5], 2, "x"), (None, [0.5], 1, "x")], "vec_id long, embedding array<float>, label int, topic string").write.parquet(f"{tmp_path}/embeddings.parquet")
    docs = spark.createDataFrame(rows, ODD)
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append([tuple(r) for r in docs.collect()])
        assert k == 4 or (docs.columns == spark.createDataFrame([], ODD).columns and all(r in rows for r in kept[-1]))
    assert labelled or len(kept[0]) == len(rows)
    model = quality.fit(spark.createDataFrame(rows, ODD), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = [r for r in rows if model is None or model.scores([r[1]])[0] >= 0.3]
    assert sorted(map(repr, kept[0])) == sorted(map(repr, good))
    best: dict = {}
    for r in good:
        best[r[1] or ""] = max([best.get(r[1] or "", -1), -1 if r[0] is None else r[0]])
    assert sorted((r[1] or "", -1 if r[0] is None else r[0]) for r in kept[1]) == sorted(best.items())
    fps = {t: near_dedup.fingerprint(t) for t in best}
    least = sorted(min((b == -1, b, u) for u, b in best.items() if (fps[u] ^ fps[t]).bit_count() <= 3) for t in best)  # here links are no chains
    assert sorted((r[0] is None, -1 if r[0] is None else r[0], r[1] or "") for r in kept[2]) == sorted(set(least))
    assert all(r in kept[2] for r in kept[3])
    packed = pd.DataFrame(kept[4], columns=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    assert len(packed[packed.piece == 0]) == len(kept[3])


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([], ODD).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_gives_the_last_stage(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
