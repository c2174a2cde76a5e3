"""Snapshots in versions, refreshes from changes, the catalog, and retention by periods."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from newsgraph.operators import graph
from newsgraph.operators import incremental as inc
from newsgraph.session import names
from newsgraph.sources import catalog, sinks


def graph_of(spark, seed=1, facts=60, entities=12):
    r = random.Random(seed)
    rows = [(f, e) for f in range(facts) for e in r.sample(range(entities), r.randint(1, 4))]
    told = [(f, 1 + f % 10, dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(60)), "abc"[f % 3]) for f in range(facts)]
    return rows, spark.createDataFrame(told, "id long, importance int, ingested timestamp, kind string")


def table(spark, rows):
    return spark.createDataFrame(rows, "fact_id long, entity_id long")


def test_refreshed_edges_are_those_made_anew(spark, tmp_path):
    """Several rounds of inserts and deletes, edges that vanish, and edges that lose their latest fact."""
    rows, facts = graph_of(spark)
    store = inc.edge_store(spark, f"file://{tmp_path}/edges", 16)
    now = [m for m in rows if m[0] % 5]
    inc.build_edges(store, table(spark, now), facts)
    r = random.Random(2)
    for k in range(3):
        came = [m for m in rows if m not in now and r.random() < 0.5]
        went = [m for m in now if r.random() < 0.15]
        inc.refresh_edges(store, table(spark, now), facts, table(spark, came), table(spark, went))
        now = [m for m in now if m not in went] + came
        want = {(e.a, e.b): (e.meetings, round(e.importance, 9), e.latest) for e in graph.edges(table(spark, now), facts, 1).collect()}
        assert {(e.a, e.b): (e.meetings, round(e.importance, 9), e.latest) for e in inc.edges(store, 1).collect()} == want, k
    assert store.versions() == [3, 4]


def test_a_refresh_reads_and_writes_the_buckets_of_its_keys_only(spark, tmp_path):
    rows, facts = graph_of(spark, 3, 400, 80)
    store = inc.edge_store(spark, f"file://{tmp_path}/edges", 32)
    inc.build_edges(store, table(spark, rows), facts)
    every, before = store.read().count(), store.manifest(1)
    fact = next(f for f in range(400) if sum(m[0] == f for m in rows) == 2)
    told = inc.refresh_edges(store, table(spark, rows), facts, table(spark, []), table(spark, [m for m in rows if m[0] == fact]))
    assert told["buckets"] == 1 and 0 < told["rows"] < every / 8
    after = store.manifest(2)
    assert sum(after.get(k) != v for k, v in before.items()) == 1 and len(names(spark, f"file://{tmp_path}/edges/data/version=2")) <= 2
    reader = store.read()  # of version 2, while the next is written
    inc.refresh_edges(store, table(spark, [m for m in rows if m[0] != fact]), facts, table(spark, [m for m in rows if m[0] == fact]), table(spark, []))
    assert reader.count() in (every, every - 1) and store.read().count() == every


def test_refreshed_days_give_the_weeks_made_anew(spark, tmp_path):
    rows, facts = graph_of(spark, 5)
    store = inc.day_store(spark, f"file://{tmp_path}/days", 8)
    entities = spark.createDataFrame([(e, None) for e in range(12)], "id long, merged_into long")
    stood, came, went = [m for m in rows if m[0] % 4], [m for m in rows if m[0] % 4 == 0 and m[0] % 3], [m for m in rows if m[0] % 7 == 1 and m[0] % 4]
    inc.build_days(store, table(spark, stood), facts)
    inc.refresh_days(store, table(spark, stood), facts, table(spark, came), table(spark, went))
    now = [m for m in stood if m not in went] + came
    joined = table(spark, now).join(facts, F.col("fact_id") == F.col("id")).groupBy("entity_id", F.to_date(F.date_trunc("week", "ingested")).alias("week")).agg(F.count("*").alias("n"), F.round(F.avg("importance"), 9).alias("i"), F.countDistinct("kind").alias("k")).where("n >= 2")
    got = inc.weekly(store, entities, F.lit(dt.date(2024, 3, 1))).select("entity", "week", "mentions", F.round("importance", 9), "kinds")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, joined.collect()))


def test_catalog_tells_rows_from_footers(spark, tmp_path):
    for name, n in (("one", 10), ("two", 1000), ("none", 0)):
        spark.range(n).repartition(3).write.parquet(f"file://{tmp_path}/all/{name}")
    got = {r.name: (r.rows, r.files > 0, r.bytes > 0, r.written is not None) for r in catalog.snapshots(spark, f"file://{tmp_path}/all").collect()}
    assert got["one"] == (10, True, True, True) and got["two"] == (1000, True, True, True) and got["none"][0] == 0


def test_whole_periods_go_without_being_read(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * k)) for k in range(200)] + [(999, None)]
    path = f"file://{tmp_path}/events"
    sinks.write_by_period(spark.createDataFrame(rows, "id long, ts timestamp"), path, "ts", "month")
    before = catalog.files(spark, path)
    bound = dt.datetime(2024, 2, 10, 12)
    told = sinks.drop_before(spark, path, "ts", "month", bound)
    assert told == {"dropped": ["2024-01"], "rewritten": ["2024-02"]}
    assert sorted((r.id for r in spark.read.parquet(path).collect())) == sorted(i for i, t in rows if t is None or t >= bound)
    later = lambda files: [f for f in files if "2024-01" not in f and "2024-02" not in f]
    assert later(before) == later(catalog.files(spark, path))
    assert sinks.drop_before(spark, path, "ts", "month", bound) == {"dropped": [], "rewritten": ["2024-02"]}


def test_sketches_merge_to_what_all_values_give(spark, tmp_path):
    """Hours in several parts, nulls, a group without values; the error in rank stays below 1 %."""
    from newsgraph.operators import sketches

    r = random.Random(4)
    rows = [(dt.datetime(2024, 1, 1 + k % 3, k % 24), "ab"[k % 2], r.lognormvariate(0, 2) if k % 50 else None) for k in range(20000)] + [(dt.datetime(2024, 1, 1), "c", None)]
    path = f"file://{tmp_path}/sketches"
    for part in (rows[:7000], rows[7000:]):
        sketches.append(sketches.hourly(spark.createDataFrame(part, "ts timestamp, kind string, value double")), path)
    told = {x.kind: x for x in sketches.report(sketches.stored(spark, path), {"p50": 0.5, "p99": 0.99}, "kind").collect()}
    assert set(told) == {"a", "b"}
    for kind, row in told.items():
        own = sorted(x for _, k, x in rows if k == kind and x is not None)
        assert row.n == len(own) and (row.least, row.most) == (own[0], own[-1]) and abs(row["mean"] - sum(own) / len(own)) < 1e-6
        for name, p in (("p50", 0.5), ("p99", 0.99)):
            assert abs(sum(x <= row[name] for x in own) / len(own) - p) < 0.01
