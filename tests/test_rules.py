"""Hand-made cases: the rules of operators on tiny frames."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsgraph.functions import dates, html, similarity, text, urls
from newsgraph.operators import alerts, articles, extraction, graph, monitoring, quality, review, series, similar, vectors


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_trigrams(spark):
    assert sorted(one(spark, "word", similarity.trigrams)) == ["  w", " wo", "ord", "rd ", "wor"]
    assert one(spark, None, similarity.trigrams) == []
    df = spark.createDataFrame([("word", "word", 1.0), ("abc", "xyz", 0.0), ("", None, 0.0), ("word", "two words", 4 / 11)], "a string, b string, s double")
    assert [round(r.v - r.s, 9) for r in df.select("s", similarity.similarity(F.col("a"), F.col("b")).alias("v")).collect()] == [0, 0, 0, 0]


@pytest.mark.parametrize(("url", "want"), [("http://h/a?utm_source=x&id=1#top", "http://h/a?id=1"), ("https://h/a/", "https://h/a"), ("https://h/a/?utm_x=1#f", "https://h/a"), ("http://h", "http://h"), (None, None)])
def test_clean_urls(spark, url, want):
    assert one(spark, url, urls.normal_cleaned) == want


def test_domain_and_class(spark):
    assert one(spark, "HTTP://u@Host.Com:80/x", urls.domain) == "host.com:80" and one(spark, "nothing", urls.domain) is None
    assert [one(spark, u, urls.url_class) for u in ("http://h/a.pdf", "http://h/archive/1", "http://h/section/x", "http://h/2024/01/15/x", "http://h/", "http://h/news/x?feed=/rss", "http://h/2024/05/", "http://h/TAG/x", "http://h/p/a-b", "http://h/Blog/post.webp", None)] == ["excluded", "archive", "category", "article", "other", "excluded", "archive", "category", "article", "excluded", "other"]
    assert [one(spark, u, urls.is_article) for u in ("http://h/story/1", "http://h/login/story/1", "http://h/x-12.html", None)] == [True, False, True, False]


@pytest.mark.parametrize(
    ("written", "want"),
    [("hace 2 días", "2024-01-13T00:00:00Z"), ("15/01/2024", "2024-01-15T00:00:00Z"), ("junk", None), ("", None), (None, None), ("ayer", "2024-01-14T00:00:00Z"), ("Hace 3 horas", "2024-01-15T07:00:00Z"), ("hace 90 minutos", "2024-01-15T08:30:00Z"),
     ("2024-01-05T10:00:00-05:00", "2024-01-05T15:00:00Z"), ("5 de enero de 2024", "2024-01-05T00:00:00Z"), ("Mon, 15 Jan 2024 10:30:00 GMT", "2024-01-15T10:30:00Z"), ("2024-02-30", None),
     ("05/01/69", "1969-01-05T00:00:00Z"), ("5/1/68", "2068-01-05T00:00:00Z"), ("13/14/2024", None), ("01/15/2024", "2024-01-15T00:00:00Z"), ("01/15/2024 02:30 PM", "2024-01-15T14:30:00Z"), ("January 5, 2024 2:30 p.m.", "2024-01-05T14:30:00Z"), ("Jan 5, 2024", "2024-01-05T00:00:00Z"), ("05-01-2024 10:20:30", "2024-01-05T10:20:30Z"),
     ("5 de Enero de 2024 10:20", "2024-01-05T10:20:00Z"), ("viernes, 5 de enero de 2024 10:20:30", "2024-01-05T10:20:30Z"), ("5 enero 2024", "2024-01-05T00:00:00Z"), ("Fri, 05 Jan 2024 10:00:00 +0200", "2024-01-05T08:00:00Z"), ("2024-01-05T10:00:00+0200", "2024-01-05T08:00:00Z"), ("xhace 2 días", None), ("01-15-2024", "2024-01-15T00:00:00Z")],
)
def test_dates(spark, written, want):
    now = F.lit("2024-01-15 10:00:00").cast("timestamp")
    assert one(spark, written, lambda c: dates.iso(dates.parse(c, now))) == want


def test_ranges_and_hours(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 1), dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 1))], "a date, b date")
    assert [(r.s.lower, r.s.upper) for r in df.select(dates.ordered_range(F.col("a"), F.col("b")).alias("s")).collect()] == [(dt.date(2024, 1, 1), dt.date(2024, 2, 1)), (None, dt.date(2024, 1, 1))]
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3, 5, 30))], "a timestamp, b timestamp")
    assert tuple(t.select(dates.hours_between(F.col("a"), F.col("b")), dates.hours_between(F.col("a"), F.col("b"), True)).first()) == (53, 5)


def test_text_functions(spark):
    assert one(spark, " a​b  “c”\tÃ© ", text.clean_stored) == 'ab "c" é'
    assert one(spark, "a\x07b  c\r\n d ", lambda c: text.clean_piped(c, True)) == "a b c\nd"
    assert one(spark, "What?!! Yes... \n\n\n\n no", text.tidy_marks) == "What?! Yes.\n\nno"
    assert one(spark, "Por Dr. ana díaz y JUAN PÉREZ-o'neil @x, x@y.z; Sra.Eva", text.authors) == "Ana Díaz, Juan Pérez-O'Neil, Eva"
    assert one(spark, "Autor: " + "x" * 300, text.first_author) == "x" * 197 + "..." and one(spark, "Derek Porter", text.first_author) == "Derek Porter"
    assert one(spark, 'Uno; "dos"|uno,', text.list_items) == ["uno", "dos"]
    assert [one(spark, x, text.language_code) for x in ("Español", "EN", "pt-BR", "spa", "français", "x", "", None)] == ["es", "en", "pt", "sp", "fr", "es", "es", "es"]
    assert [one(spark, x, text.media_type) for x in ("TV", "blog", "zine", None, "government", "Gobierno", "revista")] == ["televisión", "blog", "otro", "otro", "oficial", "oficial", "otro"]
    assert one(spark, "¡Año Nuevo, vida nueva!", text.slug) == "ano-nuevo-vida-nueva"
    assert one(spark, "w " * 500, text.reading_minutes) == 2 and one(spark, "", text.reading_minutes) == 1
    assert one(spark, '<a href="x">&\'', text.escape_html) == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    assert tuple(one(spark, "f1#fact#3", text.reference_parts)) == ("f1", "fact", "3") and tuple(one(spark, "bad", text.reference_parts)) == (None, None, None)


def test_html(spark):
    page = '<html lang="es"><title>T &amp; t</title><script>x</script><p class="a">Uno <b>dos</b></p><!-- c --><img src="i"></html>'
    assert one(spark, page, html.to_text) == "T & t Uno dos" and one(spark, page, html.paragraph_length) == 7
    f = one(spark, page, html.fields)
    assert (f.title, f.language, f.images, f.links, f.author) == ("T & t", "es", 1, 0, None)
    assert html.sanitised('<p onclick="x" title="t">a<script>b</script><svg><path/></svg>&amp;</p>') == "<p>a&amp;</p>" and html.sanitised(None) is None
    assert html.sanitised('<div> <p class="x"></p> <a href="h" rel="n" title="t">l <img src="i" onload="e"></a><a href="h"><img src="i"></a><br/><input><span> </span><em>u</div>') == '<div><a href="h" title="t">l <img src="i"></a><br><em>u</em></div>'


def test_meta_tags(spark):
    page = """<html lang="fr"><meta content="it's" property="og:title"/><meta name='author' content='A "B"'><meta name="dateless" content="x"><meta name="sailthru.date" content="2024-05-06 07:08:09"><meta property="og:type" content="">"""
    m = one(spark, page, html.metadata)
    assert (m.og_title, m.author, m.og_type, m.description, m.language, str(m.publication_date)) == ("it's", 'A "B"', None, None, "fr", "2024-05-06 07:08:09") and len(m) == 16
    df = spark.createDataFrame([("s1", "<h2>a</h2><h3>b</h3>"), ("s1", "<h3>b</h3>"), ("s2", "<h2>a</h2><h3>b</h3>"), (None, "<h3></h3>")], "site string, html string")
    rules = {"s1": [r"(?is)<h2>(.*?)</h2>", r"(?is)<h3>(.*?)</h3>"]}
    assert [r.v for r in df.select(html.by_site(F.col("html"), F.col("site"), rules, [r"(?is)<h3>(.*?)</h3>"]).alias("v")).collect()] == ["a", "b", "b", None]


def test_normal_forms(spark):
    """What Spark sends to Python, and no more, is what Python changes."""
    import unicodedata

    letters = [chr(c) for c in range(1, 0x300)] + ["e\u0301", "\ufb01", "\u212b", "\uff21", "中", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(letters)], "i int, c string")
    for form in ("NFC", "NFKC", "NFKD"):
        got = [r.v for r in df.orderBy("i").select(text.normal(F.col("c"), form).alias("v")).collect()]
        assert got == [c and unicodedata.normalize(form, c) for c in letters]
    assert one(spark, "Ángel Ñúñez & Co. (S.A.) <x>, \"l'hôtel\"", text.entity_name) == "Angel Nunez Co. S.A. x, &quot;l&#x27;hotel&quot;"
    assert one(spark, "e\u0301  x", text.clean_loaded) == "é x" and one(spark, "\ufb01n ², Ã¡", text.clean_stored) == "fin 2, á"


def test_checksums_and_ids(spark):
    import hashlib

    df = spark.createDataFrame([("b", None, 3)], "x string, a string, m int")
    got = df.select(text.checksum(x=F.col("x"), a=F.col("a"), m=F.col("m")).alias("p"), text.checksum(m=F.col("m"), x=F.col("x"), a=F.col("a")).alias("q"), text.stable_id(F.col("x")).alias("i"), text.stable_id(F.lit("b")).alias("j")).first()
    assert got.p == got.q == hashlib.md5(b'{"a":null,"m":3,"x":"b"}').hexdigest() and got.i == got.j and 0 <= got.i < 1_000_000
    checks = df.select(text.valid_fields(F.lit(1.5), F.lit(3), F.lit(2), F.lit("ftp://x"), F.lit("2024-02-30"), F.lit("https://www.wikidata.org/wiki/Q42")).alias("v")).first().v
    assert tuple(checks) == (False, False, False, False, True)
    assert one(spark, "x", lambda c: text.message(F.lit("k" * 300), F.lit(1.0), F.lit(0.0))) == "k" * 200


def test_centrality_score(spark):
    edges = spark.createDataFrame([(1, 2, 6), (1, 3, 2)], "a long, b long, meetings long")
    entities = spark.createDataFrame([(1, "n", "k", 5, None), (2, "n", "k", 1, None), (3, "n", "k", 1, 2), (4, "n", "k", 7, None), (5, "n", "k", 1, None)], "id long, name string, kind string, relevance int, merged_into long")
    got = {r.id: (r.degree, r.strong_degree, r.strength, r.score, r["class"]) for r in graph.centrality(edges, entities).collect()}
    assert got == {1: (2, 1, 4.0, 75, "central"), 2: (1, 1, 6.0, 63, "central"), 4: (0, 0, 0.0, 21, "periferica")}


def test_rolling_scores(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 5, 5.0)], "day date, facts long, importance double")
    assert series.rolling(days).first().z_volume == 0
    flat = spark.createDataFrame([(dt.date(2024, 1, i), 5, 5.0) for i in range(1, 9)], "day date, facts long, importance double")
    assert {r.z_volume for r in series.rolling(flat).collect()} == {0.0}


def test_entity_changes(spark):
    now = dt.datetime(2024, 6, 1)
    facts = [(i, now - dt.timedelta(days=d), 7 if e == 2 else 5) for i, (e, d) in enumerate([(1, 1)] * 6 + [(2, 1)] * 8 + [(2, 40)] * 2 + [(3, 1)] * 2)]
    named = [(i, e) for i, (e, _) in enumerate([(1, 1)] * 6 + [(2, 1)] * 8 + [(2, 40)] * 2 + [(3, 1)] * 2)]
    got = {r.entity: (r.ratio, r.score) for r in series.entity_changes(spark.createDataFrame(named, "fact_id long, entity_id long"), spark.createDataFrame([(e, "n", None) for e in (1, 2, 3)], "id long, name string, merged_into long"), spark.createDataFrame(facts, "id long, ingested timestamp, importance int")).collect()}
    assert got == {1: (10.0, 75.0), 2: (4.0, 100.0)}


@pytest.mark.parametrize(("ratio", "want"), [(3.0, "spike_extremo"), (2.9, "spike_alto"), (1.5, "crecimiento_notable"), (1.0, "normal"), (0.7, "decrecimiento_notable"), (0.5, "caida_alta"), (0.3, "caida_extrema")])
def test_spikes(spark, ratio, want):
    assert one(spark, ratio, series.spike_class, "double") == want


def test_quality(spark):
    empty = spark.createDataFrame([], "a string")
    assert quality.completeness(empty, ["a"]).first().a_percent is None
    row = spark.createDataFrame([(0, 0, 0, 0, 400.0, 100.0)], "orphans long, invalid long, inconsistent long, duplicate_urls long, completeness double, content_percent double")
    assert quality.score(row).first().score == 80 and quality.score(row, corrected=True).first().score == 100


def test_prefix_join_is_brute_force(spark, sf):
    lines = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("item"), F.col("lang").alias("block"), F.regexp_extract("text", r"^[^\n]*", 0).alias("text"))
    rows = [(r.item, r.block, set(r.g)) for r in lines.select("item", "block", similarity.trigrams(F.col("text")).alias("g")).collect()]
    for t in (0.3, 0.6, 0.8):
        want = {(a, b) for a, x, g in rows for b, y, h in rows if a < b and x == y and g | h and len(g & h) / len(g | h) > t}
        assert {(r.a, r.b) for r in similar.similar_pairs(lines, None, t).collect()} == want and want


def test_resolution(spark):
    stored = spark.createDataFrame([(1, "Juan Pérez", "PERSONA"), (2, "Juan Perez", "PERSONA"), (3, "Banco", "ORG")], "id long, name string, kind string")
    names = spark.createDataFrame([("Juan Pérez", "PERSONA"), ("Banco", "PERSONA"), ("Zzz", "ORG"), ("Juan Pérez", "PERSONA")], "name string, kind string")
    got = {(r.name, r.kind): (r.entity, r.score, r.is_new) for r in similar.resolve(names, stored, 0.7).collect()}
    assert got == {("Juan Pérez", "PERSONA"): (1, 1.0, False), ("Banco", "PERSONA"): (None, 0.0, True), ("Zzz", "ORG"): (None, 0.0, True)}


def test_triage(spark):
    replies = ['```json\n{"relevancia": 9, "alcance": 1, "actualidad": 2, "impacto": 3, "fiabilidad": 4, "total": 40}\n```', "Relevancia: 5\nAlcance: 4\nActualidad: 4\nImpacto: 2\nFiabilidad: 2", "", None]
    got = [tuple(r)[1:] for r in extraction.triage(spark.createDataFrame(list(enumerate(replies)), "k int, reply string"), "k", "reply").select("k", "relevancia", "total", "decision", "relevant").orderBy("k").collect()]
    assert got == [(5, 25, "PROCESAR", True), (5, 17, "PROCESAR", True), (None, 0, "ERROR_TRIAGE", True), (None, 0, "ERROR_TRIAGE", True)]


def test_relations_need_known_ends(spark):
    reply = '{"hechos": [{"id": 1, "contenido": "a"}, {"id": 2, "contenido": "b"}], "entidades": [{"id": 7, "nombre": "n"}], "r": {"hecho_entidad": [{"hecho_id": 1, "entidad_id": 7, "tipo_relacion": "x", "relevancia": 99}, {"hecho_id": 9, "entidad_id": 7, "tipo_relacion": "otro", "relevancia": 1}], "hecho_relacionado": [{"hecho_origen_id": 1, "hecho_destino_id": 1, "tipo_relacion": "c", "fuerza": 1}], "contradicciones": [{"hecho_principal_id": 1, "hecho_contradictorio_id": 2, "tipo": "?", "grado": 9}]}}'
    df = spark.createDataFrame([("f", reply)], "k string, reply string")
    got = extraction.relations(df, "k", "reply", extraction.facts(df, "k", "reply"), extraction.entities(df, "k", "reply"))
    assert sorted(tuple(r) for r in got.collect()) == [("f", "contradiction", 1, 2, "contenido", 3), ("f", "fact_entity", 1, 7, "otro", 5)]


def test_relations_in_the_form_of_replies(spark):
    reply = """{"hechos": [{"id": 1, "contenido": "a"}, {"id": 2, "contenido": "b"}], "entidades": [{"id": 7, "nombre": "n"}, {"id": 8, "nombre": "m"}],
      "hecho_entidad": [{"hecho_id": 1, "entidad_id": 7, "tipo_relacion": "afectado", "relevancia_en_hecho": 9}], "hecho_relacionado": [{"hecho_origen_id": 1, "hecho_destino_id": 2, "tipo_relacion": "causa", "fuerza_relacion": 8}],
      "entidad_relacion": [{"entidad_origen_id": 7, "entidad_destino_id": 8, "tipo_relacion": "Miembro_de", "fuerza_relacion": 2}, {"entidad_origen_id": 7, "entidad_destino_id": 7, "tipo_relacion": "aliado_con"}, {"entidad_origen_id": 1, "entidad_destino_id": 8, "tipo_relacion": "aliado_con"},
        {"entidad_origen_id": 8, "entidad_destino_id": 7, "tipo_relacion": "raro"}, {"entidad_origen_id": 8, "entidad_destino_id": 7, "tipo_relacion": "aliado_con", "fuerza_relacion": 11}],
      "contradicciones": [{"hecho_principal_id": 1, "hecho_contradictorio_id": 2, "tipo_contradiccion": "valor", "grado_contradiccion": 4}]}"""
    df = spark.createDataFrame([("f", reply)], "k string, reply string")
    got = extraction.relations(df, "k", "reply", extraction.facts(df, "k", "reply"), extraction.entities(df, "k", "reply"))
    want = [("f", "contradiction", 1, 2, "valor", 4), ("f", "entity_entity", 7, 8, "miembro_de", 2), ("f", "entity_entity", 8, 7, "aliado_con", 5), ("f", "fact_entity", 1, 7, "afectado", 9), ("f", "fact_fact", 1, 2, "causa", 8)]
    assert sorted(tuple(r) for r in got.collect()) == want
    index = {(r.side, r.id): [tuple(x) for x in r.related] for r in extraction.relation_index(got, "k").collect()}
    assert index["entity", 8] == [("entity_entity", 7), ("entity_entity", 7)] and index["entity", 7] == [("entity_entity", 8), ("entity_entity", 8), ("fact_entity", 1)] and ("fact", 7) not in index


def stamps(spark, minutes, key="m"):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), key) for i, m in enumerate(minutes)], "id long, ts timestamp, metric string")


def test_flood_control(spark):
    got = alerts.flood_control(stamps(spark, [0, 2, 4, 6, 8, 61, 62]), "metric").orderBy("id").collect()
    assert [r.allowed for r in got] == [True, True, True, False, False, True, True] and [r.escalates for r in got] == [False] * 4 + [True, False, False]


@pytest.mark.parametrize("bound", [1, 10_000])
def test_all_rules_match(spark, bound):
    rows = [(0, "info", "m0"), (1, "critical", "m7"), (2, None, "m2"), (3, "warning", None)]
    some = [(f"r{i}", *x) for i, x in enumerate([(None, None), (["critical", "critical", "info"], None), (["warning"], ["m1"]), (None, ["m2", "m7"]), ([], None), (["critical", None], ["m7"]), (["warning"], None)])]
    many = some + [(f"x{i}", ["none"], None) for i in range(11_000)] + [("last", ["info"], ["m0"])]
    rules = spark.createDataFrame(many, "rule string, severities array<string>, metrics array<string>")
    got = alerts.matching(spark.createDataFrame(rows, "id int, severity string, metric string"), rules, {"severity": "severities", "metric": "metrics"}, bound)
    holds = lambda array, x: array is None or (x is not None and x in array)
    assert sorted((r.id, r.rule) for r in got.collect()) == sorted((i, r) for i, s, m in rows for r, a, b in many if holds(a, s) and holds(b, m))


def test_channels_cool_down(spark):
    every = [1, 2, 3, 4, 5, 6, 7]
    channels = spark.createDataFrame([("a", True, every, 0, 24, 2, 10), ("b", True, every, 0, 24, 2, None), ("c", False, every, 0, 24, 2, 10)], "channel string, enabled boolean, days array<int>, from_hour int, to_hour int, per_hour int, cooldown int")
    rows = stamps(spark, [0, 5, 10, 30, 60, 61, 75]).withColumn("severity", F.lit("critical"))
    got = {(r.channel, r.id): r.decision for r in alerts.channel_decisions(rows, channels, bound=1).collect()}
    assert [got["a", i] for i in range(7)] == ["sent", "skipped", "sent", "throttled", "sent", "skipped", "sent"]
    assert [got["b", i] for i in range(7)] == ["sent", "sent", "throttled", "throttled", "sent", "sent", "throttled"] and {got["c", i] for i in range(7)} == {"skipped"}


def test_all_channels_decide(spark):
    channels = spark.range(10_001).select(F.col("id").cast("string").alias("channel"), F.lit(True).alias("enabled"), F.array(F.lit(1)).alias("days"), F.lit(0).alias("from_hour"), F.lit(24).alias("to_hour"), F.lit(1).alias("per_hour"))
    assert alerts.channel_decisions(stamps(spark, [0]).withColumn("severity", F.lit("info")), channels).where("decision = 'sent'").count() == 10_001


def test_throttle(spark):
    assert [r.allowed for r in alerts.throttle(stamps(spark, [0, 0.5, 1, 1.5, 2.2]), "metric").orderBy("id").collect()] == [True, False, True, False, True]


def test_streamed_flood_control_is_the_batch_one(spark, sf):
    from newsgraph.plans import alerts as batch
    from newsgraph.plans import streams

    assert sorted(streams.stream_flood_control(spark, sf).collect()) == sorted(batch.flood_control(spark, sf).collect())


def test_rate_limits(spark):
    rows = stamps(spark, [0, 1, 2, 61])
    assert [r.allowed for r in alerts.window_limit(rows, ["metric"], "ts", 2, 60, "id").orderBy("id").collect()] == [True, True, False, True]
    assert [r.before for r in alerts.trailing_limit(rows, ["metric"], "ts", 2, 3600).orderBy("id").collect()] == [0, 1, 2, 2]


def test_merge_keeps_values_that_the_batch_lacks(spark):
    stored = spark.createDataFrame([("u1", "a", 1), ("u2", "b", 2)], "url string, title string, n int")
    batch = spark.createDataFrame([("u1", None, 9, 1), ("u1", "z", None, 0), ("u3", "c", 3, 1)], "url string, title string, n int, v int")
    got = articles.merge(stored, articles.latest(batch, "url", F.col("v")), "url")
    assert sorted(tuple(r) for r in got.collect()) == [("u1", "a", 9), ("u2", "b", 2), ("u3", "c", 3)]
    _, lost = articles.update(stored, spark.createDataFrame([("u9", "x")], "url string, title string"), "url")
    assert lost.count() == 1


def test_quarantine(spark):
    df = spark.createDataFrame([("http://h/a", "A title that is long", "m", "b" * 100), ("x", "short", None, "")], "url string, title string, outlet string, body string")
    valid, bad = articles.split_valid(df)
    assert valid.count() == 1 and bad.first().errors == ["missing_outlet", "missing_body", "short_title", "bad_url"] and bad.first().error_type == "missing_outlet"


def test_review_checks(spark):
    facts = spark.createDataFrame([(1, 5)], "id int, importance int")
    with pytest.raises(ValueError):
        review.review_filter(facts, least=5, most=4)
    with pytest.raises(ValueError):
        review.page(facts, 1, 101, "id")
    assert tuple(review.page_info(facts, 1, 10).first()) == (1, 1, False, False)


def test_lists_find_most_neighbours(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = rows.where("vec_id % 20 = 0")
    index, centres = vectors.lists(rows, 4)
    near = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact = near(vectors.nearest(rows, asked, 10))
    assert len(exact & near(vectors.nearest_by_lists(index, centres, asked, 10, probes=3))) >= 0.9 * len(exact)


def test_embedding_failures_are_marked(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return vectors.hashing_embedder(8)(texts)

    got = vectors.embed(spark.createDataFrame([(1, "good text"), (2, "bad"), (3, None)], "id long, t string"), "id", "t", model, 8)
    assert {r.id: r.status for r in got.collect()} == {1: "ok", 2: "failed", 3: "empty"}


def test_status_counts_keep_zeros(spark):
    jobs = spark.createDataFrame([("a",), ("a",)], "status string")
    assert {r.status: r.n for r in monitoring.status_counts(jobs, ["a", "b"]).collect()} == {"a": 2, "b": 0}


def test_feeds(spark, tmp_path):
    import gzip
    import json

    from newsgraph.sources import feeds, sinks

    for name, body in (("one", json.dumps({"url": "u1", "title": "t"})), ("many", json.dumps([{"url": "u2"}, {"url": "u3", "tags": ["x"]}])), ("broken", "{nothing")):
        (tmp_path / f"{name}.json.gz").write_bytes(gzip.compress(body.encode()))
    (tmp_path / "raw.json.gz").write_bytes(b"not gzip")
    assert sorted(r.url for r in feeds.read_articles(spark, str(tmp_path)).collect()) == ["u1", "u2", "u3"]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>http://h</link><pubDate>Mon, 15 Jan 2024 10:30:00 GMT</pubDate></item></channel></rss>")
    assert feeds.read_rss(spark, str(tmp_path / "feed.xml")).first().published.startswith("Mon")
    log = sinks.refresh_all({"a": spark.range(3), "b": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))}, str(tmp_path / "snapshots"), {"a": 1})
    assert [(x["status"], x["rows"], x["change"]) for x in log] == [("SUCCESS", 3, 2), ("ERROR", None, None)]
    kept, gone = sinks.retained(spark.createDataFrame([(dt.datetime(2024, 1, 1), "open"), (dt.datetime(2024, 1, 1), "closed"), (None, "closed")], "ts timestamp, s string"), "ts", F.lit("2024-03-01").cast("timestamp"), 30, F.col("s") == "open")
    assert kept.count() == 2 and gone.first().deleted == 1


def test_alerts_in_the_order_of_time(spark):
    """Flood control, throttling, suppression and readings as of a moment, against plain loops over each key."""
    import random

    from newsgraph.operators import monitoring

    r = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(600):
        t += r.choice([0, 1, 30, 400, 90_000 if i % 50 == 0 else 10])
        rows.append((i, start + dt.timedelta(seconds=t), r.choice("ab")))
    df = spark.createDataFrame(rows, "id long, ts timestamp, metric string")
    want_flood, want_throttle = {}, {}
    for m in "ab":
        state, last = None, float("-inf")
        for i, ts, _ in sorted((x for x in rows if x[2] == m), key=lambda x: (x[1], x[0])):
            seconds = ts.timestamp()
            state, ok, up = alerts.flood_step(state, seconds, 3, 3600, 5)
            want_flood[i] = (ok, up)
            want_throttle[i] = seconds - last >= 600
            last = seconds if want_throttle[i] else last
    assert {x.id: (x.allowed, x.escalates) for x in alerts.flood_control(df, "metric", minutes=60).collect()} == want_flood
    assert {x.id: x.allowed for x in alerts.throttle(df, "metric", 600).collect()} == want_throttle
    old = [x for x in rows if x[0] % 7 == 0]
    active = spark.createDataFrame(old, "id long, ts timestamp, metric string")
    left = {x.id for x in alerts.suppressed(df, active, 900).collect()}
    assert left == {i for i, ts, m in rows if not any(n == m and ts - dt.timedelta(seconds=900) < u <= ts for _, u, n in old)}
    versions = spark.createDataFrame([(m, u, i) for i, u, m in {(m, u): (i, u, m) for i, u, m in old}.values()], "metric string, ts timestamp, value long")
    found = {x.id: x.last_value for x in alerts.as_of_join(df.select("metric", "ts", "id"), versions, "metric", "ts", ["value"], seconds=1000).collect()}
    newest = {(m, u): i for i, u, m in old}
    assert found == {i: max(((u, v) for (n, u), v in newest.items() if n == m and u <= ts), default=(None, None))[1] for i, ts, m in rows}
    lagged = {x.id: x.before for x in monitoring.changes(df.withColumn("v", F.col("id") * 1.0), "metric", "ts", "v", 3, "id").collect()}
    for m in "ab":
        own = sorted((x for x in rows if x[2] == m), key=lambda x: (x[1], x[0]))
        assert [lagged[x[0]] for x in own] == [None, None, None, *[float(x[0]) for x in own[:-3]]]


def test_streams_keep_their_state_from_batch_to_batch(spark, tmp_path):
    """Files come one a batch, in order: a key is let through again only once its time to live is over, also batches later; what a batch runs again isn't kept twice."""
    import time

    from newsgraph.streaming import jobs, keyed

    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    parts = ([(1, "a", day(1)), (2, "a", day(1, 5))], [(3, "a", day(1, 12)), (4, "b", day(5))], [(5, "b", day(5, 1))], [(6, "a", day(6)), (7, "a", day(6, 1)), (8, "b", day(6))])
    for rows in parts:
        spark.createDataFrame(rows, "id long, key string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    source = lambda: jobs.source(spark, f"{tmp_path}/in", watermark="1 hours", files=1)
    seen = jobs.drain(keyed.first_seen(source(), "key", seconds=86_400, tie="id"), f"file://{tmp_path}/seen").collect()
    assert sorted(r.id for r in seen) == [1, 4, 6, 8]
    told = jobs.drain(keyed.throttle(source(), "key", 12 * 3600), f"file://{tmp_path}/told").collect()
    assert sorted(r.id for r in told if r.allowed) == [1, 3, 4, 6, 8] and len(told) == 8
    states = lambda: {r.job: (r.status, r.created, r.updated) for r in jobs.job_states(source().select(F.col("key").alias("job"), F.col("id").cast("string").alias("status"), "ts"), f"file://{tmp_path}/jobs").collect()}
    assert states() == {"a": ("7", day(1), day(6, 1)), "b": ("8", day(5), day(6))}
    spark.createDataFrame([(9, "c", day(7))], "id long, key string, ts timestamp").write.mode("append").parquet(f"{tmp_path}/in")
    assert states() == {"a": ("7", day(1), day(6, 1)), "b": ("8", day(5), day(6)), "c": ("9", day(7), day(7))}  # goes on where it stopped
    assert states()["c"][0] == "9"  # and nothing new changes nothing


def test_inbox_moves_files_by_their_outcome(spark, tmp_path):
    """Two runs, several batches, broken files, a name that comes again, and a batch that is read again after its files have moved."""
    import gzip
    import json
    import os

    from newsgraph.sources import inbox

    (tmp_path / "in").mkdir()
    put = lambda name, found: (tmp_path / "in" / f"{name}.json.gz").write_bytes(found if isinstance(found, bytes) else gzip.compress(json.dumps(found).encode()))
    good = lambda k: {"url": f"http://h/{k}", "title": f"title {k}", "body": "b" * 20, "tags": "x, y", "metadata": {"k": 1}}
    put("a", [good(1), {"url": "http://h/2", "title": "no body"}])
    put("b", good(3))
    put("c", b"broken")
    put("d", [{"url": "http://h/4"}])
    put("e", [])
    put("f", ["no object", good(5) | {"opinion": "maybe", "body": "short"}])
    (tmp_path / "in" / "other.txt").write_text("not a feed")
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    inbox.ingest(spark, source, target, files=2, body=10)
    folders = lambda: {k: sorted(os.listdir(tmp_path / "out" / "inbox" / k)) for k in ("completed", "failed")}
    assert os.listdir(tmp_path / "in") == ["other.txt"]
    assert folders() == {"completed": ["a.json.gz", "b.json.gz"], "failed": ["c.json.gz", "d.json.gz", "e.json.gz", "f.json.gz"]}
    rows = lambda: sorted((r.file, r.url or "", r.kind) for r in spark.read.parquet(f"{target}/rows").collect())
    first = rows()
    assert first == [("a.json.gz", "http://h/1", "none"), ("a.json.gz", "http://h/2", "missing_body"), ("b.json.gz", "http://h/3", "none"), ("c.json.gz", "", "unreadable"), ("d.json.gz", "http://h/4", "missing_title"), ("e.json.gz", "", "empty"), ("f.json.gz", "", "no_object"), ("f.json.gz", "http://h/5", "short_body")]
    put("a", [good(9)])
    inbox.ingest(spark, source, target, files=2, body=10)
    assert folders()["completed"] == ["a.json.gz", "a_4.json.gz", "b.json.gz"] and rows() == sorted([*first, ("a.json.gz", "http://h/9", "none")])
    again = inbox.StreamReader({"path": source, "state": f"{target}/inbox", "body": "10"})
    part = again.partitions({"batch": 3}, {"batch": 4})
    assert [p.name for p in part] == ["a.json.gz"] and [r[0] for r in again.read(part[0])] == ["http://h/9"]  # from where it is now
    again.commit({"batch": 4})
    assert folders()["completed"] == ["a.json.gz", "a_4.json.gz", "b.json.gz"]
    told = {(r.file, r.moved): (r.folder, r.rows, r.errors) for r in inbox.outcomes(spark, target).collect()}
    assert told["a.json.gz", "a_4.json.gz"] == ("completed", 1, 0) and told["f.json.gz", "f.json.gz"] == ("failed", 0, 2)
    spark.dataSource.register(inbox.Inbox)
    put("z", [good(7), good(8)])
    assert sorted(r.url for r in spark.read.format("inbox").option("path", source).load().collect()) == ["http://h/7", "http://h/8"]


def test_ingest_sets_aside_what_cannot_be_read(spark, tmp_path):
    """Objects, arrays and broken files, on two runs of which the second has one new file."""
    import gzip
    import json

    from newsgraph.sources import feeds

    put = lambda name, text: (tmp_path / "in" / name).write_bytes(gzip.compress(text.encode()))
    (tmp_path / "in").mkdir()
    put("one.json.gz", json.dumps({"url": "http://a/1", "body": "x" * 50}))
    put("two.json.gz", json.dumps([{"url": "http://a/2", "body": "y" * 50}, {"url": "http://a/3", "body": "short"}]))
    put("bad.json.gz", "{ no json")
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    feeds.ingest(spark, source, target, least=10)
    put("new.json.gz", json.dumps({"url": "http://a/4", "body": "z" * 50}))
    feeds.ingest(spark, source, target, least=10)
    assert sorted((r.url, r.file) for r in feeds.ingested(spark, target)[0].collect()) == [("http://a/1", "one.json.gz"), ("http://a/2", "two.json.gz"), ("http://a/4", "new.json.gz")]
    assert sorted((r.file, r.reason) for r in feeds.ingested(spark, target)[1].collect()) == [("bad.json.gz", "unreadable"), ("two.json.gz", "short_body")]
    assert sorted(r.url for r in feeds.read_articles(spark, source).collect()) == ["http://a/1", "http://a/2", "http://a/3", "http://a/4"]


def test_reports(spark):
    from newsgraph.operators import reports

    now = spark.createDataFrame([(dt.datetime(2024, 1, 2),)], "now timestamp")
    samples = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), 91.0, 50.0, 10.0, 1.0, 1.0) for h in range(12, 24)] + [(dt.datetime(2023, 1, 1), 99.0, 99.0, 99.0, 99.0, 99.0)], "ts timestamp, cpu double, memory double, connections double, api double, storage double")
    alerts = spark.createDataFrame([(dt.datetime(2024, 1, 1, 20), "warning", None), (dt.datetime(2023, 1, 1), "critical", None)], "ts timestamp, severity string, resolved_at timestamp")
    row = reports.executive(samples, alerts, now, 24, minutes=60).first()
    assert (row.uptime, row.peak_cpu, row.alerts, row.health, row.hours_open, row.advice[0]) == (50.0, 91.0, 1, "monitoring_recommended", 4.0, "escalar_recursos")
    assert reports.executive(samples.limit(0), alerts.limit(0), now, 24).first().advice[0] == "sistema_optimo"
    snapshots = spark.createDataFrame([("a", 0, 5, dt.datetime(2024, 1, 1, 23)), ("b", 9, 2 << 30, dt.datetime(2024, 1, 1, 19)), ("c", 9, 5, None)], "name string, rows long, bytes long, refreshed timestamp")
    told = reports.snapshot_status(snapshots, F.lit("2024-01-02").cast("timestamp"))
    assert {r.name: (r.status, r.age, r.freshness) for r in told.collect()} == {"a": ("warning", "fresh", "fresh"), "b": ("warning", "recent", "acceptable"), "c": ("healthy", "never", "never_refreshed")}
    sizes = reports.stored_sizes(spark, {"documents": "/root/testdata/sf0.001/documents.parquet"}).first()
    assert sizes.name == "documents" and sizes.bytes > 1000 and sizes.written is not None


def test_percentiles_are_exact(spark):
    """Ties, small and large groups, nulls: what Spark's own exact percentile gives."""
    import random

    from newsgraph.operators import monitoring

    r = random.Random(8)
    rows = [("a", float(r.randint(0, 50))) for _ in range(3000)] + [("b", r.random()) for _ in range(40_000)] + [("c", 1.0), ("c", 2.0), ("d", None), ("e", 5.0)] + [("b", 0.95)] * 500
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {x.k: [x[n] for n in shares] for x in monitoring.percentiles(df, "k", "v", shares).collect()}
    want = {x.k: x.p for x in df.groupBy("k").agg(F.percentile("v", list(shares.values())).alias("p")).collect() if x.p}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_archives_name_the_files_of_their_own_call(spark, tmp_path):
    import gzip
    import json

    from newsgraph.sources import sinks

    for call in (1, 2):
        pages = spark.createDataFrame([(f"u{call}{i}", f"o{i % 2}", "2024-01-0" + str(call), f"<p>{i}</p>") for i in range(4)], "url string, outlet string, day string, html string")
        rows = sinks.write_archive(pages, f"file://{tmp_path}").collect()
        assert sorted(r.url for r in rows) == [f"u{call}{i}" for i in range(4)] and "html" not in rows[0].asDict()
        for r in rows:
            held = [json.loads(line) for line in gzip.open("/" + r.storage_path.split(":", 1)[1].lstrip("/")).read().decode().splitlines()]
            assert [h["html"] for h in held if h["url"] == r.url] == [f"<p>{r.url[-1]}</p>"]
    kept, deleted = sinks.maintained({"alerts": (spark.createDataFrame([(dt.datetime(2024, 1, 1), True), (dt.datetime(2024, 1, 1), False)], "ts timestamp, open boolean"), "ts")}, F.lit("2024-06-01").cast("timestamp"), "dashboard", F.col("open"))
    assert kept["alerts"].count() == 1 and deleted.first().deleted == 1


def test_feed_files_whose_names_begin_as_bad_ones_do(spark, sf, monkeypatch):
    """Names of feed files are hexadecimal, so one of 4096 begins with "bad"; its rows are documents all the same."""
    from pathlib import Path
    from urllib.parse import urlsplit

    from newsgraph import registry
    from newsgraph.sources import feeds

    write = feeds.write_feed

    def renamed(rows, path, *more):
        told = write(rows, path, *more)
        for f in Path(urlsplit(path).path).glob("*.json.gz"):
            f.rename(f.with_name("bad" + f.name[3:]))
        return told

    monkeypatch.setattr(feeds, "write_feed", renamed)
    got = [r.doc_id for r in registry.QUERIES["feed_outcomes"](spark, sf).collect()]
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(docs) + 2 and set(got) == docs | {None}


@pytest.mark.parametrize("name", ["feed_outcomes", "prepared_texts"])
def test_documents_without_text(spark, tmp_path, name):
    """Empty and missing texts, sources and lengths, as the query's SQL has them."""
    import duckdb

    from newsgraph import registry

    rows = [(1, "", "en", "src1", 0), (2, None, "fr", "src2", None), (3, "   ", "de", "src3", 3), (4, "x" * 100, "es", "", 100), (5, "y" * 99, "en", None, 99), (6, " " + "z" * 99, None, "src4", 100), (7, "", "en", "", 0)]
    rows = [r for r in rows if r[3] is not None or name != "feed_outcomes"]  # without a source there is no address
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = registry.QUERIES[name](spark, str(tmp_path)).collect(), con.sql(registry.ORACLES[name]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
