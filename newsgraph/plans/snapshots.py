"""Registered queries over stored snapshots: refreshed from changes, told of by the catalog, and let go by whole periods."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsgraph.operators import incremental as inc
from newsgraph.operators import reports, sketches
from newsgraph.plans import model
from newsgraph.registry import query
from newsgraph.session import remove, settle, shared_dir
from newsgraph.sources import catalog, sinks


def _folder(spark, kind):
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def _changes(mentions):
    """What stands at first, what comes and what goes: every tenth fact is late, every 17th is withdrawn, and of every 23rd one entity is."""
    late, gone = F.col("fact_id") % 10 == 3, (F.col("fact_id") % 17 == 0) | ((F.col("fact_id") % 23 == 0) & (F.col("entity_id") % 2 == 0))
    return mentions.where(~late), mentions.where(late & ~gone), mentions.where(~late & gone)


_LEFT = "m AS (SELECT * FROM m0 WHERE NOT (fact_id % 17 = 0 OR (fact_id % 23 = 0 AND entity_id % 2 = 0)))"


@query(f"""WITH {model.DATED}, {model.PART_MENTIONS.replace("m AS", "m0 AS", 1)}, {_LEFT}
SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS meetings, round(avg(importance), 6) AS importance, max(ingested)::DATE AS latest
FROM m x JOIN m y ON x.fact_id = y.fact_id AND x.entity_id < y.entity_id JOIN f ON f.id = x.fact_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def edges_refresh(spark, sf_dir):
    """Edges stored without the late facts, then refreshed from what came and went: as if made anew."""
    stood, came, went = _changes(settle(model.mentions(spark, sf_dir)))  # read many times
    facts, folder = model.dated_facts(spark, sf_dir), _folder(spark, "edges")
    store = inc.edge_store(spark, folder)
    inc.build_edges(store, stood, facts)
    inc.refresh_edges(store, stood, facts, came, went)
    found = settle(inc.edges(store).withColumn("importance", F.round("importance", 6)).withColumn("latest", F.to_date("latest")))
    remove(spark, folder)
    return found


@query(f"""WITH {model.DATED}, {model.SUPPLIER_MENTIONS.replace("m AS", "m0 AS", 1)}, {_LEFT}
SELECT entity_id AS entity, date_trunc('week', ingested)::DATE AS week, count(*) AS mentions, round(avg(importance), 6) AS importance, count(DISTINCT kind) AS kinds
FROM m JOIN f ON f.id = fact_id WHERE ingested::DATE >= (SELECT max(ingested) FROM f)::DATE - 180 GROUP BY 1, 2 HAVING count(*) >= 2""")
def series_refresh(spark, sf_dir):
    """Weekly series from daily counts that were refreshed from what came and went."""
    stood, came, went = _changes(model.mentions(spark, sf_dir, "l_suppkey"))
    facts, folder = model.dated_facts(spark, sf_dir), _folder(spark, "days")
    store = inc.day_store(spark, folder, 16)
    inc.build_days(store, stood, facts)
    inc.refresh_days(store, stood, facts, came, went)
    now = facts.agg(F.to_date(F.max("ingested")).alias("now")).first().now
    found = settle(inc.weekly(store, model.supplier_entities(spark, sf_dir), F.lit(now)).withColumn("importance", F.round("importance", 6)))
    remove(spark, folder)
    return found


@query("""WITH s AS (SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'orders', count(*) FILTER (o_orderkey % 2 = 0) FROM orders UNION ALL SELECT 'none', 0)
SELECT name, rows, rows > 0 AS filled, true AS dated, CASE WHEN rows = 0 THEN 'warning' ELSE 'healthy' END AS status, 'fresh' AS age, 'fresh' AS freshness FROM s""")
def snapshot_catalog(spark, sf_dir):
    """Snapshots just written, as the catalog tells of them from their files' footers and listing."""
    folder = _folder(spark, "catalog")
    docs, orders = model.table(spark, sf_dir, "documents").select("doc_id", "lang"), model.table(spark, sf_dir, "orders")
    sinks.refresh_all({"documents": docs, "orders": orders.where("o_orderkey % 2 = 0"), "none": docs.limit(0)}, folder)
    told = settle(catalog.snapshots(spark, folder))
    remove(spark, folder)
    status = reports.snapshot_status(told.withColumnRenamed("written", "refreshed"), F.current_timestamp())
    return status.select("name", "rows", (F.col("bytes") > 0).alias("_b"), "refreshed", "status", "age", "freshness").select("name", "rows", (F.col("_b") & (F.col("rows") > 0)).alias("filled"), F.col("refreshed").isNotNull().alias("dated"), "status", "age", "freshness")


@query("""WITH n AS (SELECT max(ts) - INTERVAL 10 DAY AS cut FROM events), k AS (SELECT event_id, ts::DATE AS day FROM events, n WHERE ts >= cut),
d AS (SELECT ts::DATE AS day, bool_and(ts < cut) AS old, bool_or(ts < cut) AS any_old FROM events, n GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, (SELECT count(*) FROM k WHERE k.day = d.day) AS rows, CASE WHEN old THEN 'dropped' WHEN any_old THEN 'rewritten' ELSE 'untouched' END AS result FROM d""")
def retention_by_period(spark, sf_dir):
    """Events laid out by day less those older than ten days: whole days go without being read, the day of the bound is written anew, files of later days stay as they are."""
    folder = _folder(spark, "retained")
    events = model.table(spark, sf_dir, "events").select("event_id", "ts")
    sinks.write_by_period(events, folder, "ts", "day")
    before = catalog.files(spark, folder)
    bound = events.agg((F.max("ts") - F.expr("INTERVAL 10 DAYS")).alias("bound")).first().bound
    sinks.drop_before(spark, folder, "ts", "day", bound)
    after = catalog.files(spark, folder)
    day = lambda files: {f.split("/day=")[1].split("/")[0] for f in files}
    result = [(d, "dropped" if d not in day(after) else "untouched" if {f for f in before if f"/day={d}/" in f} == {f for f in after if f"/day={d}/" in f} else "rewritten") for d in sorted(day(before))]  # a row a day
    left = settle(spark.read.parquet(folder).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("rows")))
    remove(spark, folder)
    return spark.createDataFrame(result, "day string, result string").join(left, "day", "left").na.fill(0, ["rows"])


@query("""WITH p AS (SELECT event_type AS kind, strftime(ts, '%Y-%m-%d') AS day, value FROM events UNION ALL SELECT event_type, 'all', value FROM events)
SELECT kind, day, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, share, true AS within FROM p, (SELECT unnest(['p50', 'p95', 'p99']) AS share) GROUP BY kind, day, share""")
def stored_percentiles(spark, sf_dir):
    """Percentiles of each day and of the whole time from hourly sketches that were stored in two parts, and whether each is within 1 % in rank of the exact one."""
    folder, shares = _folder(spark, "sketches"), {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    events = model.table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("kind"), "value")
    for half in (0, 1):
        sketches.append(sketches.hourly(events.where(F.col("event_id") % 2 == half)), folder)
    kept = sketches.stored(spark, folder)
    told = sketches.report(kept, shares, "kind", F.date_format("day", "yyyy-MM-dd").alias("day")).unionByName(sketches.report(kept, shares, "kind", F.lit("all").alias("day")))
    told = settle(told.select("kind", "day", "n", F.round("mean", 6).alias("mean"), "least", "most", F.explode(F.create_map(*[x for name in shares for x in (F.lit(name), F.col(name))])).alias("share", "_q")))
    remove(spark, folder)
    each = events.select("kind", "value", F.explode(F.array(F.date_format("ts", "yyyy-MM-dd"), F.lit("all"))).alias("day"))
    ranks = each.join(told.select("kind", "day", "share", "_q"), ["kind", "day"]).groupBy("kind", "day", "share").agg(F.count_if(F.col("value") < F.col("_q")).alias("_below"), F.count_if(F.col("value") <= F.col("_q")).alias("_upto"))
    goal = F.col("n") * F.element_at(F.create_map(*[x for name, p in shares.items() for x in (F.lit(name), F.lit(p))]), F.col("share"))
    room = F.greatest(F.lit(1.0), F.col("n") * 0.01)
    joined = told.join(ranks, ["kind", "day", "share"])
    return joined.select("kind", "day", "n", "mean", "least", "most", "share", ((F.col("_below") <= goal + room) & (F.col("_upto") >= goal - room)).alias("within"))
