"""What plans may not do on larger tables, and the same results on odd inputs."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgraph import registry
from newsgraph.operators import extraction, graph, series, similar
from newsgraph.plans import extraction as extraction_plans
from newsgraph.streaming import jobs, joins, keyed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "most"), [("explode_facts", 1), ("explode_entities", 1), ("explode_quotes", 1), ("explode_figures", 1), ("relations_valid", 1), ("payload_refs", 1), ("fragment_counts", 1), ("reconciliation", 1), ("relation_index", 1), ("relation_kinds", 1), ("phase_chain", 2)])
def test_replies_are_shuffled_once(spark, sf, name, most):
    text = plan(registry.QUERIES[name](spark, sf))
    assert text.count("Exchange hashpartitioning") <= most and "Scan ExistingRDD" not in text and "Window" not in text


def test_items_of_replies(spark):
    reply = '{"hechos": [{"id": null, "contenido": "x"}, {"id": 2, "contenido": "b"}, {"id": 1, "contenido": " "}, {"id": 2, "contenido": "c"}, {"id": 3, "contenido": "d"}], "citas_textuales": [{"id": 1, "cita": "q", "hecho_id": 9}, {"id": 2, "cita": "r", "hecho_id": null}, {"id": 3, "cita": "s", "hecho_id": 3}]}'
    df = spark.createDataFrame([("a", reply), ("b", f"text ```json\n{reply}\n``` }}"), ("c", None), ("d", "}{"), ("e", "{}")], "k string, reply string")
    got = [(r.k, r.fact, r.number, r.content) for r in extraction.facts(df, "k", "reply").orderBy("k", "number").collect()]
    assert got == [(k, *x) for k in "ab" for x in ((2, 1, "b"), (3, 3, "d"))]
    counts = {r.k: (r.facts, r.quotes) for r in extraction.reply_counts(df, "k", "reply", "facts", "quotes").collect()}
    assert counts == {"a": (2, 3), "b": (2, 3), "c": (0, 0), "d": (0, 0), "e": (0, 0)}
    lost = extraction.dangling({"quotes": (extraction.quotes(df, "k", "reply"), "fact")}, extraction.facts(df, "k", "reply"), "k", "fact")
    assert sorted(map(tuple, extraction.reply_dangling(df, "k", "reply", quotes="hecho_id").collect())) == sorted(map(tuple, lost.collect())) == [("a", "quotes", 9), ("b", "quotes", 9)]
    assert sorted(map(tuple, extraction.reply_reconcile(df, "k", "reply", "facts", "quotes").collect())) == [("a", "facts", 5, 2), ("b", "facts", 5, 2)]


def test_tags_are_not_searched_once_a_tag(spark):
    words = [f"w{i}" for i in range(3000)] + ["B", "b", " a ", "A", "", " "]
    df = spark.createDataFrame([(1, words), (2, None), (3, [])], "k int, t array<string>").select("k", similar.unique_tags(F.col("t")).alias("t"))
    assert "array_position" not in plan(df)
    assert {r.k: r.t for r in df.collect()} == {1: [*words[:3000], "B", "a"], 2: None, 3: []}


def test_trigrams_are_made_once_a_text(spark, sf):
    assert plan(registry.QUERIES["trigram_similarity"](spark, sf)).count("regexp_extract_all") <= 2  # a side each, none above the join


def test_pairs_are_dealt_by_the_size_of_the_table(spark):
    rows = [(f, e) for f in range(200) for e in range(f % 5)]
    mentions = spark.createDataFrame(rows, "fact_id long, entity_id long")
    facts = spark.createDataFrame([(f, f, dt.datetime(2024, 1, 1)) for f in range(200)], "id long, importance long, ingested timestamp")
    assert graph.parts(mentions, 50) == 8 and graph.parts(mentions) == 4
    met = graph.edges(mentions, facts, n=37)
    assert plan(met).count("hashpartitioning(fact_id") >= 2 and ", 37)" in plan(met) and ", 4)" not in plan(met)
    got = {(r.a, r.b): (r.meetings, r.importance) for r in met.collect()}
    assert got == {(a, b): (len(own), sum(own) / len(own)) for b in range(1, 4) for a in range(b) for own in [[f for f in range(200) if f % 5 > b]]}


def test_trends_at_the_bound_are_mixed():
    """Days and mentions whose trend is exactly 3/10: no last bit may put it beyond."""
    import itertools

    days = np.arange(11000, 11035, 7)
    found = 0
    for m in itertools.product((2.0, 3.0, 4.0, 5.0, 6.0, 7.0), repeat=5):
        n, d, x = 5, [int(v) for v in days], [int(v) for v in m]
        cov, vd, vx = n * sum(map(int.__mul__, d, x)) - sum(d) * sum(x), n * sum(v * v for v in d) - sum(d) ** 2, n * sum(v * v for v in x) - sum(x) ** 2
        if vx and 100 * cov * cov == 9 * vd * vx:
            one, row = np.ones((1, 5)), np.array([m])
            trend = series.pair_figures(one, row, one, row, days.astype(float))["trend_a"][0, 0]
            assert not trend > 0.3 and not trend < -0.3
            found += 1
    assert found


def test_stream_joins_meet_stretches_of_time(spark, tmp_path):
    """Joined by a stretch of time as well as by metric; moments on either side of its bounds are met once."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    spark.createDataFrame([(k, at(m), "m") for k, m in enumerate((1, 119, 120, 121, 239, 240, 241, 360, 481))], "id long, ts timestamp, metric string").coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.createDataFrame([(at(m), "m", 1.0) for m in (0, 121, 360)], "ts timestamp, metric string, value double").coalesce(1).write.parquet(f"{tmp_path}/b")
    for name in "ab":
        for k in (1, 2):
            last = spark.read.parquet(f"{tmp_path}/{name}").limit(1).withColumns({"ts": F.lit(at(90_000 * k)), "metric": F.lit("")})
            last.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    a, b = jobs.source(spark, f"{tmp_path}/a", files=1), jobs.source(spark, f"{tmp_path}/b", files=1)
    joined = joins.suppressed(a, b.select("ts", "metric"), 7200)
    assert "_cell" in joined._jdf.queryExecution().analyzed().toString()
    got = jobs.drain(joined, f"{tmp_path}/out")
    assert sorted(r.id for r in got.where("metric = 'm'").collect()) == [2, 6, 8]


def test_texts_are_written_once_whatever_they_meet(spark, sf, tmp_path):
    """A block is one file, read where it meets another; pairs are judged there and neither joined nor shuffled."""
    text = plan(registry.QUERIES["near_duplicates"](spark, sf))
    assert "MapInArrow" in text and "CoGroup" not in text and "hashpartitioning(item" not in text
    pairs = text[: text.index("MapInArrow")]
    assert "Exchange" not in pairs and "Join" not in pairs
    items = spark.createDataFrame([(k, "x", list(range(k % 7, 40 + k % 7))) for k in range(300)], "item long, block string, grams array<long>").repartition(5)
    blocks = similar._blocks(items, f"file://{tmp_path}/blocks", 0.5, 50).collect()
    files = list((tmp_path / "blocks").iterdir())
    assert len(blocks) == 6 and {b.file.rsplit("/")[-1] for b in blocks} <= {f.name for f in files}
    loaded = [similar._load(b.file) for b in blocks]
    assert sorted(i for t, _ in loaded for i in t["item"].to_pylist()) == list(range(300))
    assert sum(len(places) for _, (_, places, _) in loaded) == 300 * 40


def test_keys_are_decided_a_bucket_at_a_time(spark):
    """A call for a bucket of keys, not one a key; all pass as one by one."""
    rows = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.col("value").alias("id"), F.col("value").alias("user"))
    seen = keyed.first_seen(rows.withWatermark("ts", "1 hour"), "user", seconds=60, tie="id")
    assert "_bucket" in seen._jdf.queryExecution().analyzed().toString() and seen.columns == ["ts", "id", "user"]
    r = np.random.default_rng(5)
    for time in (0, 1, 7, 1000):
        number, at = r.integers(0, 9, 400), np.sort(r.integers(0, 300, 400))
        last = np.where(np.arange(9) % 2, np.iinfo(np.int64).min // 2, 5)
        want, before = [], last.copy()
        for k, t in zip(number, at, strict=True):
            want.append(bool(t - before[k] >= time))
            if want[-1]:
                before[k] = t
        assert keyed.passing(number, at, last, time).tolist() == want and last.tolist() == before.tolist()


def test_replies_are_written_and_unwrapped_in_plain_expressions(spark, sf):
    """An order's items are written line by line, without a function of arrays that makes structs of them, and JSON alone isn't searched for its ends."""
    text = plan(extraction_plans._reply(spark, sf))
    assert "StructsToJson" not in text and "lambdafunction" not in text
    df = spark.createDataFrame([("{}",), ('{"a": "```"}',), ('{"a": "```{\\"b\\": 1}```"}',), ("{x} y",), ("y {x}",), ("{",), ("}",), ("}{",), ("",), (None,), ("```json\n{1}\n```",)], "r string")
    got = [r.j for r in df.select(extraction.unfenced(F.col("r")).alias("j")).collect()]
    assert got == ["{}", '{"a": "```"}', '{\\"b\\": 1}', "{x}", "{x}", None, None, None, None, None, "{1}"]
    assert "startswith" in plan(df.select(extraction.unfenced(F.col("r")))).lower()


def test_partners_are_dealt_by_the_size_of_the_table(spark):
    """Nothing above the edges is left to the session's number of partitions."""
    edges = spark.createDataFrame([(a, b, a + b, dt.datetime(2024, 1, 1)) for b in range(8) for a in range(b)], "a long, b long, meetings long, latest timestamp")
    names = spark.createDataFrame([(k, f"n{k}") for k in range(8)], "id long, name string")
    lists = graph.partner_lists(edges, names, n=37)
    assert plan(lists).count(", 37)") >= 3 and ", 4)" not in plan(lists)
    assert {r.entity: [p.partner for p in r.partners] for r in lists.collect()} == {e: sorted(set(range(8)) - {e}, reverse=True)[:5] for e in range(8)}
