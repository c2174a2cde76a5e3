"""Registered queries over data quality. The tables hold no nulls, so some values are taken for missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgraph.operators import quality as op
from newsgraph.plans import model
from newsgraph.registry import query


def _articles(spark, sf_dir):
    docs = model.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.nullif("lang", F.lit("es")).alias("lang"), F.nullif("source", F.lit("src0")).alias("source"), "text", "n_chars")


@query("""SELECT count(*) AS total, round(count(nullif(lang, 'es')) * 100.0::DOUBLE / count(*), 2) AS lang_percent,
  round(count(nullif(source, 'src0')) * 100.0::DOUBLE / count(*), 2) AS source_percent, round(count(text) * 100.0::DOUBLE / count(*), 2) AS text_percent FROM documents""")
def completeness(spark, sf_dir):
    return op.completeness(_articles(spark, sf_dir), ["lang", "source", "text"])


@query("""SELECT count(*) FILTER (length(text) < 100) AS short_texts, count(*) FILTER (length(text) > 1000) AS long_texts, count(*) FILTER (n_chars <> length(text)) AS wrong_lengths,
  count(*) FILTER (source = 'src0') AS without_source FROM documents""")
def quality_counters(spark, sf_dir):
    text = F.length("text")
    return op.counters(_articles(spark, sf_dir), {"short_texts": text < 100, "long_texts": text > 1000, "wrong_lengths": F.col("n_chars") != text, "without_source": F.col("source").isNull()})


@query("""SELECT 'order_customer' AS edge, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'label_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def orphans(spark, sf_dir):
    t = lambda name: model.table(spark, sf_dir, name)
    english = t("documents").where("lang = 'en'")  # labels of other languages count as orphans here
    edges = {"order_customer": (t("orders"), "o_custkey", t("customer"), "c_custkey"), "line_part": (t("lineitem"), "l_partkey", t("part"), "p_partkey"), "line_order": (t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), "label_document": (t("labels"), "doc_id", english, "doc_id")}
    return op.orphans(edges)


@query("""SELECT count(*) FILTER (l_quantity NOT BETWEEN 2 AND 49) AS quantity_outside, count(*) FILTER (abs(l_extendedprice) > 90000) AS extreme_prices,
  count(*) FILTER (l_shipdate > TIMESTAMP '2001-01-01' OR l_shipdate < TIMESTAMP '1996-01-01') AS odd_dates FROM lineitem""")
def outliers(spark, sf_dir):
    odd = (F.col("l_shipdate") > F.lit("2001-01-01").cast("timestamp_ntz")) | (F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return op.counters(model.table(spark, sf_dir, "lineitem"), {"quantity_outside": ~F.col("l_quantity").between(2, 49), "extreme_prices": F.abs("l_extendedprice") > 90000, "odd_dates": odd})


@query("""SELECT count(*) FILTER (l_shipdate < o_orderdate - INTERVAL 1 DAY) AS shipped_early, count(*) FILTER (l_shipdate > o_orderdate + INTERVAL 365 DAY) AS shipped_late
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def temporal_consistency(spark, sf_dir):
    lines = model.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    joined = lines.join(model.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return op.counters(joined, {"shipped_early": F.col("l_shipdate") < F.col("o_orderdate") - F.expr("INTERVAL 1 DAY"), "shipped_late": F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")})


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN NOT p_size BETWEEN 1 AND 40 THEN 'size' END, CASE WHEN NOT p_retailprice < 1500 THEN 'price' END,
  CASE WHEN NOT regexp_matches(p_brand, '^Brand#[1-9]$') THEN 'brand' END) AS broken FROM part
WHERE NOT p_size BETWEEN 1 AND 40 OR NOT p_retailprice < 1500 OR NOT regexp_matches(p_brand, '^Brand#[1-9]$')""")
def domain_violations(spark, sf_dir):
    rules = {"size": F.col("p_size").between(1, 40), "price": F.col("p_retailprice") < 1500, "brand": F.col("p_brand").rlike(r"^Brand#[1-9]$")}
    return op.violations(model.table(spark, sf_dir, "part"), "p_partkey", rules).withColumn("broken", F.array_join("broken", ","))


@query("SELECT count(url) - count(DISTINCT url) AS duplicate_urls FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS url FROM pages)")
def duplicate_hosts(spark, sf_dir):
    return op.duplicate_urls(model.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("url")), "url")


@query("""WITH r AS (SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans,
  (SELECT count(*) FROM lineitem WHERE l_quantity NOT BETWEEN 1 AND 49) AS invalid, 0::BIGINT AS inconsistent, (SELECT count(url) - count(DISTINCT url) FROM pages) AS duplicate_urls,
  (SELECT 300.0::DOUBLE + round(count(nullif(lang, 'es')) * 100.0::DOUBLE / count(*), 2) FROM documents) AS completeness, 100.0::DOUBLE AS content_percent),
s AS (SELECT *, orphans + invalid + inconsistent AS faults FROM r)
SELECT orphans, invalid, inconsistent, duplicate_urls, completeness, content_percent,
  round(least(100.0, greatest(0.0, 100 - orphans * 2 - invalid - inconsistent * 3 - duplicate_urls * 0.5 - completeness / 20))::DECIMAL(20, 6), 0)::INTEGER AS score,
  CASE WHEN faults = 0 AND content_percent >= 95 THEN 'excelente' WHEN faults <= 5 AND content_percent >= 90 THEN 'buena' WHEN faults <= 20 AND content_percent >= 80 THEN 'aceptable' ELSE 'necesita_atencion' END AS level,
  CASE WHEN orphans > 0 THEN 'corregir_referencias' WHEN invalid > 0 THEN 'validar_rangos' WHEN inconsistent > 0 THEN 'revisar_fechas' WHEN duplicate_urls > 10 THEN 'revisar_duplicados' ELSE 'en_buen_estado' END AS advice FROM s""")
def quality_summary(spark, sf_dir):
    t = lambda name: model.table(spark, sf_dir, name)
    found = op.orphans({"line_order": (t("lineitem"), "l_orderkey", t("orders"), "o_orderkey")}).select("orphans")
    invalid = op.counters(t("lineitem"), {"invalid": ~F.col("l_quantity").between(1, 49)}).withColumn("inconsistent", F.lit(0).cast("long"))
    full = op.completeness(_articles(spark, sf_dir), ["lang", "text"]).select((F.col("lang_percent") + 300).alias("completeness"), F.col("text_percent").alias("content_percent"))
    one_row = found.crossJoin(F.broadcast(invalid)).crossJoin(F.broadcast(op.duplicate_urls(t("pages"), "url"))).crossJoin(F.broadcast(full))  # each a single row
    return op.score(one_row)


@query("""WITH d AS (SELECT source, doc_id, text, lang, vec_id FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = doc_id),
r AS (SELECT source, count(*) FILTER (text IS NULL) AS orphans, count(*) FILTER (lang NOT IN ('en', 'fr', 'de', 'es')) AS invalid, 0::BIGINT AS inconsistent, count(text) - count(DISTINCT text) AS duplicate_urls,
  round(count(text) * 100.0::DOUBLE / count(*), 2) AS content_percent, round(count(vec_id) * 100.0::DOUBLE / count(*), 2) AS embedding_percent FROM d GROUP BY 1),
s AS (SELECT *, orphans + invalid + inconsistent AS faults, content_percent + embedding_percent + 200 AS completeness FROM r)
SELECT source, embedding_percent, round(least(100.0, greatest(0.0, 100 - orphans * 2 - invalid - inconsistent * 3 - duplicate_urls * 0.5 - completeness / 20))::DECIMAL(20, 6), 0)::INTEGER AS score,
  CASE WHEN faults = 0 AND content_percent >= 95 THEN 'excelente' WHEN faults <= 5 AND content_percent >= 90 THEN 'buena' WHEN faults <= 20 AND content_percent >= 80 THEN 'aceptable' ELSE 'necesita_atencion' END AS level,
  CASE WHEN orphans > 0 THEN 'corregir_referencias' WHEN invalid > 0 THEN 'validar_rangos' WHEN inconsistent > 0 THEN 'revisar_fechas' WHEN embedding_percent < 50 THEN 'mejorar_embeddings' WHEN duplicate_urls > 10 THEN 'revisar_duplicados' ELSE 'en_buen_estado' END AS advice FROM s""")
def outlet_quality(spark, sf_dir):
    """Score, level and advice for each outlet's documents; those with the id of a vector have an embedding, equal texts count as duplicates."""
    docs, vectors = model.table(spark, sf_dir, "documents"), model.table(spark, sf_dir, "embeddings").select("vec_id").distinct()
    joined = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select("source", F.when(F.col("text").isNotNull(), F.sha2("text", 256)).alias("digest"), "lang", "vec_id")
    texts = joined.groupBy("source", "digest").agg(F.count("*").alias("n"), F.count("vec_id").alias("embedded"), F.count_if(~F.col("lang").isin("en", "fr", "de", "es")).alias("invalid"))  # a row a text: an outlet isn't one task's
    here = F.col("digest").isNotNull()
    rows = texts.groupBy("source").agg(F.sum(F.when(~here, F.col("n")).otherwise(0)).alias("orphans"), F.sum("invalid").alias("invalid"), F.lit(0).cast("long").alias("inconsistent"), F.sum(F.when(here, F.col("n") - 1).otherwise(0)).alias("duplicate_urls"), F.round(F.sum(F.when(here, F.col("n")).otherwise(0)) * 100.0 / F.sum("n"), 2).alias("content_percent"), F.round(F.sum("embedded") * 100.0 / F.sum("n"), 2).alias("embedding_percent"))
    return op.score(rows.withColumn("completeness", F.col("content_percent") + F.col("embedding_percent") + 200)).select("source", "embedding_percent", "score", "level", "advice")


@query("""WITH x AS (SELECT event_id, event_id % 13 AS relevance, event_id % 7 AS grade, value / 100 AS confidence, CASE WHEN event_id % 4 = 0 THEN 'ftp://x' ELSE 'https://h/' || event_id END AS url, CASE WHEN event_id % 3 = 0 THEN lower(event_type[1:2]) ELSE upper(event_type[1:2]) END AS country, value AS percent, event_id % 12 AS importance FROM events)
SELECT event_id, concat_ws(',', CASE WHEN relevance > 10 THEN 'relevance' END, CASE WHEN grade NOT IN (1, 2, 3, 4, 5) THEN 'grade' END, CASE WHEN confidence > 1 OR confidence < 0 THEN 'confidence' END, CASE WHEN event_id % 4 = 0 THEN 'url' END,
  CASE WHEN country <> upper(country) THEN 'country' END, CASE WHEN percent > 100 OR percent < 0 THEN 'percent' END, CASE WHEN importance NOT BETWEEN 1 AND 10 THEN 'importance' END) AS broken FROM x
WHERE relevance > 10 OR grade NOT IN (1, 2, 3, 4, 5) OR confidence > 1 OR confidence < 0 OR event_id % 4 = 0 OR country <> upper(country) OR percent > 100 OR percent < 0 OR importance NOT BETWEEN 1 AND 10""")
def domain_checks(spark, sf_dir):
    """The model's domains on values made of events."""
    e, n = model.table(spark, sf_dir, "events"), F.col("event_id")
    code = F.substring("event_type", 1, 2)
    rows = e.select("event_id", (n % 13).alias("relevance"), (n % 7).alias("grade"), (F.col("value") / 100).alias("confidence"), F.when(n % 4 == 0, "ftp://x").otherwise(F.concat(F.lit("https://h/"), "event_id")).alias("url"), F.when(n % 3 == 0, F.lower(code)).otherwise(F.upper(code)).alias("country"), F.col("value").alias("percent"), (n % 12).alias("importance"))
    rules = op.domain_rules(relevance="relevance", grade="grade", confidence="confidence", url="url", country="country", percent="percent", importance="importance")
    return op.violations(rows, "event_id", rules).withColumn("broken", F.array_join("broken", ","))


@query("""WITH n AS (SELECT TIMESTAMP '2000-06-01' AS now) SELECT count(*) FILTER (o_orderdate > now) AS future, count(*) FILTER (o_orderdate < TIMESTAMP '1990-01-01') AS ancient, count(*) FILTER (o_orderdate >= now - INTERVAL 7 DAY) AS last_7d,
  count(*) FILTER (o_orderdate >= now - INTERVAL 30 DAY) AS last_30d, count(*) FILTER (o_orderdate >= now - INTERVAL 90 DAY) AS last_90d, count(*) FILTER (o_orderstatus = 'F') AS with_errors, count(*) FILTER (o_orderstatus = 'O') AS complete FROM orders, n""")
def date_counters(spark, sf_dir):
    """Orders dated against a moment; open ones count as complete, the others' states tell of errors."""
    state = F.when(F.col("o_orderstatus") == "F", "error_red").when(F.col("o_orderstatus") == "O", "completado").otherwise("pendiente")
    rules = op.date_counters(F.col("o_orderdate").cast("timestamp"), F.lit("2000-06-01").cast("timestamp"), state)
    return op.counters(model.table(spark, sf_dir, "orders"), rules)


@query("""SELECT count(*) FILTER (l_shipdate < TIMESTAMP '2000-01-01' AND l_linenumber % 3 <> 0) AS overdue FROM lineitem""")
def overdue_events(spark, sf_dir):
    """Lines are planned events that end when they are shipped; every third is done or cancelled."""
    n = F.col("l_linenumber")
    state = F.when(n % 6 == 0, "cancelado").when(n % 3 == 0, "realizado").otherwise("programado")
    return op.counters(model.table(spark, sf_dir, "lineitem"), {"overdue": op.overdue(F.col("l_shipdate").cast("timestamp"), F.lit("2000-01-01").cast("timestamp"), state)})
