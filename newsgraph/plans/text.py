"""Registered queries over text, URL, date and HTML functions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from newsgraph.functions import dates, html, text, urls
from newsgraph.plans import model
from newsgraph.registry import query


def _sql_collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


_SWAPS = "text"  # no text of the tables changes in NFKC but by NFC, which DuckDB has
for _a, _b in text.MOJIBAKE.items():
    _SWAPS = f"replace({_SWAPS}, '{_a}', '{_b}')"
_QUOTES = f"""regexp_replace(regexp_replace({_SWAPS}, '[“”„«»]', '"', 'g'), '[‘’‚]', '''', 'g')"""


@query(rf"""SELECT doc_id, md5({_sql_collapse("regexp_replace(" + _QUOTES + ", '[​‌‍﻿]', '', 'g')")}) AS stored,
  md5({_sql_collapse(r"regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')")}) AS loaded,
  greatest(1, round_even(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) / 200.0, 0)::INTEGER) AS minutes FROM documents""")
def clean_articles(spark, sf_dir):
    t = F.col("text")
    return model.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_stored(t)).alias("stored"), F.md5(text.clean_loaded(t)).alias("loaded"), text.reading_minutes(t).alias("minutes"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages),
k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|fbclid|gclid|ref|source)(=|$)')), '&') AS k1,
  array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*)(=|$)')), '&') AS k2 FROM p)
SELECT page_id, base || CASE WHEN k1 <> '' THEN '?' || k1 ELSE '' END || frag AS loaded, regexp_replace(base, '([^/:])/+$', '\1') || CASE WHEN k2 <> '' THEN '?' || k2 ELSE '' END AS cleaned, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS domain FROM k""")
def url_normalise(spark, sf_dir):
    u = F.col("url")
    return model.table(spark, sf_dir, "pages").select("page_id", urls.normal_loaded(u).alias("loaded"), urls.normal_cleaned(u).alias("cleaned"), urls.domain(u).alias("domain"))


@query("""WITH v AS (SELECT page_id * 20 + k AS visit, regexp_extract(lower(url), '^[^?#]*') || s AS u FROM pages,
  (SELECT * FROM (VALUES (0, ''), (1, '/feed'), (2, '/wp-admin/x'), (3, '/a.webp'), (4, '/2024/05/07/x'), (5, '/2024/05/'), (6, '/2024/'), (7, '/blog/x'), (8, '/topic/x'), (9, '/tags/x/news/y'), (10, '/archives/x'), (11, '-12345.html'), (12, '/p/a-b'), (13, '/print/story/1'))) t(k, s)),
f AS (SELECT *, string_split(u, '/') AS parts FROM v),
g AS (SELECT *, list_has_any(['pdf', 'jpg', 'jpeg', 'png', 'gif', 'webp', 'svg', 'mp3', 'mp4', 'avi', 'mov', 'zip', 'rar', 'gz', 'tar'], [list_last(string_split(u, '.'))]) AND contains(u, '.') OR contains(u, '/print/')
    OR len(list_filter(['search', 'login', 'register', 'signup', 'signin', 'logout', 'admin', 'wp-admin', 'feed', 'rss'], lambda w: contains(u, '/' || w))) > 0 AS out,
  len(list_filter(['article', 'articles', 'news', 'story', 'post', 'blog'], lambda w: contains(u, '/' || w || '/'))) > 0 OR u SIMILAR TO '.*/[0-9]{4}/[0-9]{2}/[0-9]{2}/.*' OR u SIMILAR TO '.*-[0-9]+[.]html' OR u SIMILAR TO '.*/p/[a-z0-9_-]+.*' AS art,
  len(list_filter(['category', 'categories', 'section', 'sections', 'topic', 'tag', 'tags'], lambda w: contains(u, '/' || w || '/'))) > 0 AS cat,
  contains(u, '/archive/') OR contains(u, '/archives/') OR u SIMILAR TO '.*/[0-9]{4}/([0-9]{2}/)?' AS arc FROM f)
SELECT visit, CASE WHEN out THEN 'excluded' WHEN art THEN 'article' WHEN cat THEN 'category' WHEN arc THEN 'archive' ELSE 'other' END AS class FROM g""")
def url_class(spark, sf_dir):
    """Every page's address, and it with endings that other classes have."""
    endings = ["", "/feed", "/wp-admin/x", "/a.webp", "/2024/05/07/x", "/2024/05/", "/2024/", "/blog/x", "/topic/x", "/tags/x/news/y", "/archives/x", "-12345.html", "/p/a-b", "/print/story/1"]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("e")) for k, e in enumerate(endings)]))
    visits = model.table(spark, sf_dir, "pages").select("page_id", "url", each.alias("x"))
    return visits.select((F.col("page_id") * 20 + F.col("x.k")).alias("visit"), urls.url_class(F.concat(F.regexp_extract("url", r"^[^?#]*", 0), F.col("x.e"))).alias("class"))


def _sql_unescape(c: str) -> str:
    for name, mark in html._ENTITIES:
        c = "replace({}, '{}', '{}')".format(c, name, mark.replace("'", "''"))
    return c


@query(rf"""SELECT page_id, nullif({_sql_collapse(_sql_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))}, '') AS title, nullif(regexp_extract(html, '(?is)<html[^>]*\blang=["'']?([A-Za-z-]+)', 1), '') AS language,
  len(regexp_extract_all(html, '(?is)<a\s[^>]*href='))::INTEGER AS links, len(regexp_extract_all(html, '(?is)<img\s'))::INTEGER AS images,
  md5({_sql_collapse(_sql_unescape(r"regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"))}) AS text_md5 FROM pages""")
def page_fields(spark, sf_dir):
    f = html.fields(F.col("html"))
    return model.table(spark, sf_dir, "pages").select("page_id", f["title"].alias("title"), f["language"].alias("language"), f["links"].alias("links"), f["images"].alias("images"), F.md5(html.to_text(F.col("html"))).alias("text_md5"))


@query(r"""SELECT page_id, (NOT regexp_matches(url, '(?i)/(search|login|register|signup|signin|logout|admin|wp-admin|feed|rss|print/)|\.(pdf|jpg|jpeg|png|gif|webp|svg|mp3|mp4|avi|mov|zip|rar|gz|tar)$')
    AND regexp_matches(url, '(?i)/\d{4}/\d{2}/\d{2}/|/(articles?|news|story|post|blog)/|-\d+\.html$|/p/[\w-]+')) OR regexp_matches(html, '(?is)schema\.org/(News)?Article|property=["'']article:|og:type["''][^>]*content=["'']article')
  OR coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda p: length(regexp_replace(p, '(?s)<[^>]*>', '', 'g')))), 0) > 500 AS is_article FROM pages""")
def page_is_article(spark, sf_dir):
    return model.table(spark, sf_dir, "pages").select("page_id", html.is_article(F.col("url"), F.col("html"), urls.is_article).alias("is_article"))


@query()
def html_exact(spark, sf_dir):
    """Sanitised HTML by the standard parser."""
    clean = model.table(spark, sf_dir, "pages").select("page_id", html.sanitise("html").alias("html"))
    return clean.select("page_id", F.length("html").alias("characters"), F.sha2("html", 256).alias("sha256"))


@query("""WITH t AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS d, o_orderkey % 30 AS form FROM orders),
u AS (SELECT *, date_trunc('day', d) AS day, 3600 * (o_orderkey % 12 + 1) AS h FROM t)
SELECT o_orderkey, strftime(CASE WHEN form = 29 THEN day - INTERVAL 2 DAY WHEN form IN (0, 1, 2, 3, 5, 8, 11, 14, 17, 20, 23, 26) THEN day + to_seconds(h) ELSE day END, '%Y-%m-%dT%H:%M:%SZ') AS parsed FROM u""")
def date_parsing(spark, sf_dir):
    """Order dates written in thirty ways and read again; a relative one counts from the date itself."""
    orders = model.table(spark, sf_dir, "orders").select("o_orderkey", F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("day"))
    t = F.col("day") + F.make_dt_interval(F.lit(0), (F.pmod("o_orderkey", F.lit(12)) + 1).cast("int"))
    form, month = (lambda p: F.date_format(t, p)), (lambda names: F.element_at(F.array(*[F.lit(m) for m in names]), F.month(t)))
    day = F.dayofmonth(t)
    spanish = F.concat_ws(" de ", day, month(dates.MONTHS), F.year(t))
    written = {
        0: form("yyyy-MM-dd'T'HH:mm:ss'Z'"), 1: form("yyyy-MM-dd'T'HH:mm:ss'+0000'"), 2: form("yyyy-MM-dd'T'HH:mm:ss"), 3: form("yyyy-MM-dd HH:mm:ss"), 4: form("yyyy-MM-dd"), 5: form("dd/MM/yyyy HH:mm:ss"), 6: form("dd/MM/yyyy"), 7: form("d/M/yyyy"), 8: form("dd/MM/yyyy HH:mm"),
        9: form("dd-MM-yyyy"), 10: form("dd.MM.yyyy"), 11: form("dd-MM-yyyy HH:mm:ss"), 12: spanish, 13: F.concat(F.lit("lunes, "), spanish), 14: F.concat(spanish, F.lit(" "), form("HH:mm")), 15: F.concat_ws(" ", day, month(dates.MONTHS), F.year(t)), 16: form("dd/MM/yy"), 17: form("dd/MM/yy HH:mm"),
        18: F.concat(month(dates.ENGLISH), F.lit(" "), day, F.lit(", "), F.year(t)), 19: F.concat(F.substring(month(dates.ENGLISH), 1, 3), F.lit(" "), day, F.lit(", "), F.year(t)), 20: F.concat(month(dates.ENGLISH), F.lit(" "), day, F.lit(", "), F.year(t), F.lit(" "), form("hh:mm"), F.when(F.hour(t) < 12, " AM").otherwise(" PM")),
        21: F.concat_ws("/", F.year(t), form("MM"), form("dd")), 22: F.concat(F.lit("Mon, "), day, F.lit(" "), F.substring(month(dates.ENGLISH), 1, 3), F.lit(" "), F.year(t)), 23: F.concat(F.lit("Mon, "), day, F.lit(" "), F.substring(month(dates.ENGLISH), 1, 3), F.lit(" "), F.year(t), F.lit(" "), form("HH:mm:ss"), F.lit(" +0000")),
        24: F.concat(F.lit("viernes, "), spanish), 25: form("yyyy-M-d"), 26: F.concat(spanish, F.lit(" "), form("HH:mm:ss")), 27: form("d-M-yyyy"), 28: F.concat(F.lit("  "), form("dd/MM/yyyy"), F.lit(" ")), 29: F.lit("hace 2 días"),
    }
    text_of = F.coalesce(*[F.when(F.pmod("o_orderkey", F.lit(30)) == k, c) for k, c in written.items()])
    return orders.select("o_orderkey", dates.iso(dates.parse(text_of, F.col("day"))).alias("parsed"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(text, '\pC|\s+', ' ', 'g').regexp_replace('\s+', ' ', 'g'))) AS plain,
  md5(trim(regexp_replace(regexp_replace(text.regexp_replace('!{2,}', '!', 'g').regexp_replace('[?]{2,}', '?', 'g').regexp_replace('[.]{2,}', '.', 'g').regexp_replace(',{2,}', ',', 'g').regexp_replace(';{2,}', ';', 'g').regexp_replace(':{2,}', ':', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS tidy,
  list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[,;|]'), lambda x: lower(trim(regexp_replace(x, '["'']', '', 'g'), ' '))), lambda x: x <> '')).len() AS items FROM documents""")
def text_forms(spark, sf_dir):
    """Cleaned as the pipeline does, marks made single, and the items of a list."""
    t = F.col("text")
    return model.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_piped(t)).alias("plain"), F.md5(text.tidy_marks(t)).alias("tidy"), F.size(text.list_items(t)).cast("long").alias("items"))


@query("""SELECT s_suppkey, s_name || ', Ana Del-Río, O''Neil' AS authors, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE left(repeat(s_name || ' ', 20), 197) || '...' END AS first_author,
  CASE s_suppkey % 5 WHEN 0 THEN 'oficial' WHEN 1 THEN 'diario' WHEN 2 THEN 'otro' WHEN 3 THEN 'televisión' ELSE 'blog' END AS media, CASE s_suppkey % 5 WHEN 0 THEN 'es' WHEN 1 THEN 'fr' WHEN 2 THEN 'sp' WHEN 3 THEN 'pt' ELSE 'es' END AS language FROM supplier""")
def byline_fields(spark, sf_dir):
    """Bylines with titles, addresses and several names; kinds of media and languages under other names."""
    s, k = model.table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 5
    line = F.concat(F.lit("Por Dr. "), F.upper("s_name"), F.lit(" y ana DEL-río @ana, x@y.org o'neil"))
    one = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Author: "), "s_name")).otherwise(F.concat(F.lit("By "), F.repeat(F.concat("s_name", F.lit(" ")), F.lit(20))))
    media, language = F.array(*map(F.lit, ("Government", "newspaper", "zine", "TV", " blog"))), F.array(*map(F.lit, (" ", "français", "spa", "pt-BR", "Español")))
    return s.select("s_suppkey", text.authors(line).alias("authors"), text.first_author(one).alias("first_author"), text.media_type(F.get(media, k.cast("int"))).alias("media"), text.language_code(F.get(language, k.cast("int"))).alias("language"))


@query(r"""WITH m AS (SELECT page_id, url, '<html lang="es-ES"><head><meta property="og:title" content="T ' || page_id || '"><meta content="D" name="description"><meta name=''twitter:site'' content=''@s''>' ||
  CASE page_id % 4 WHEN 0 THEN '<meta property="article:published_time" content="2024-01-05T10:00:00-05:00">' WHEN 1 THEN '<meta name="date" content="2024-02-03">' WHEN 2 THEN '<meta name="pubdate" content="2024-03-01T99">' ELSE '' END AS head FROM pages)
SELECT page_id, 'T ' || page_id AS og_title, 'D' AS description, '@s' AS twitter_site, NULL::VARCHAR AS og_image, 'es-ES' AS language,
  CASE page_id % 4 WHEN 0 THEN '2024-01-05 15:00:00' WHEN 1 THEN '2024-02-03 00:00:00' WHEN 2 THEN '2024-03-01 00:00:00' END AS published FROM m""")
def page_metadata(spark, sf_dir):
    """Meta tags, either attribute first, put before every stored page."""
    k = F.col("page_id") % 4
    date = F.when(k == 0, '<meta property="article:published_time" content="2024-01-05T10:00:00-05:00">').when(k == 1, '<meta name="date" content="2024-02-03">').when(k == 2, '<meta name="pubdate" content="2024-03-01T99">').otherwise("")
    head = F.concat(F.lit('<html lang="es-ES"><head><meta property="og:title" content="T '), "page_id", F.lit("""\"><meta content="D" name="description"><meta name='twitter:site' content='@s'>"""), date, "html")
    m = html.metadata(F.col("head"))
    return model.table(spark, sf_dir, "pages").select("page_id", head.alias("head")).select("page_id", *[m[c].alias(c) for c in ("og_title", "description", "twitter_site", "og_image", "language")], F.date_format(m["publication_date"], "yyyy-MM-dd HH:mm:ss").alias("published"))


@query("""SELECT doc_id, concat_ws(' | ', nullif(source, ''), 'Tipo: ' || lang, 'Etiquetas: a, b') AS facts, concat_ws(' | ', 'Sección: ' || source, text) = t AS fragment, source || '/2024/01/' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '/' || lang || '.html.gz' AS path,
  'Medio ' || source || ': ' || printf('%.2f', n_chars::DOUBLE) || ' (límite ' || printf('%.2f', 1000.0) || ', ' || round_even(n_chars / 10.0, 0)::INTEGER || '%)' AS message, '&lt;' || lang || '&gt; &amp; &#x27;' || source AS escaped
FROM (SELECT *, 'Sección: ' || source || ' | ' || text AS t FROM documents)""")
def prepared_texts(spark, sf_dir):
    """Texts for vectors of two tables, storage paths, alert messages and escaped texts."""
    docs = model.table(spark, sf_dir, "documents")
    facts = text.combined("hechos", {"contenido": F.col("source"), "tipo_hecho": F.col("lang"), "etiquetas": F.lit("a, b"), "pais": F.lit(None).cast("string")})
    fragment = text.combined("fragmentos_extensos", {"titulo_seccion": F.col("source"), "contenido": F.col("text")})
    titled, content = F.nullif(F.concat(F.lit("Sección: "), "source"), F.lit("Sección: ")), F.nullif("text", F.lit(""))
    told = lambda c, *names: F.when(~reduce(or_, [F.col(n).isNull() for n in names]), c)
    whole = told(fragment == F.concat_ws(" | ", titled, content), "source", "text")  # empty fields are left out
    day = F.make_date(F.lit(2024), F.lit(1), (F.pmod("doc_id", F.lit(28)) + 1).cast("int"))
    return docs.select(
        "doc_id", facts.alias("facts"), whole.alias("fragment"), told(text.storage_path(F.col("source"), day, F.col("lang")), "source", "lang").alias("path"),
        told(text.message(F.concat(F.lit("Medio "), "source"), F.col("n_chars").cast("double"), F.lit(1000.0)), "source", "n_chars").alias("message"), text.escape_html(F.concat(F.lit("<"), "lang", F.lit("> & '"), "source")).alias("escaped"),
    )


@query("""SELECT event_id, (props->>'k')::BIGINT AS k, json_array_length(('[' || event_id % 7 || ',' || user_id || ']')::JSON)::INTEGER AS n, '{"kind":"' || event_type || '","at":[' || event_id || ',' || user_id || ']}' AS built FROM events""")
def json_access(spark, sf_dir):
    """JSON read by path and by length, and built."""
    events = model.table(spark, sf_dir, "events")
    listed = F.to_json(F.array(F.col("event_id") % 7, F.col("user_id")))
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.json_array_length(listed).alias("n"), F.to_json(F.struct(F.col("event_type").alias("kind"), F.array("event_id", "user_id").alias("at"))).alias("built"))


@query(r"""SELECT doc_id, lower(coalesce(nullif(regexp_replace(left(ltrim(regexp_replace(translate(lower(source || ' ' || lang), 'áàâäéèêëíìîïóòôöúùûüñç', 'aaaaeeeeiiiioooouuuunc'), '[^a-z0-9]+', '-', 'g'), '-'), 100), '-+$', ''), ''), '')) AS slug,
  lang AS code, (doc_id || '#fact#' || n_chars) AS reference, left(trim(regexp_replace(concat_ws(' | ', source, lang), '\s+', ' ', 'g')), 512) AS embedding_text,
  replace(replace('Medio {{source}}: {{n}} caracteres', '{{source}}', source), '{{n}}', n_chars::VARCHAR) AS message FROM documents""")
def names_and_templates(spark, sf_dir):
    docs = model.table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", text.slug(F.concat_ws(" ", "source", "lang")).alias("slug"), text.language_code(F.col("lang")).alias("code"), text.global_reference(F.col("doc_id").cast("string"), F.lit("fact"), F.col("n_chars")).alias("reference"),
        text.embedding_text(F.col("source"), F.col("lang")).alias("embedding_text"), text.fill(F.lit("Medio {{source}}: {{n}} caracteres"), {"source": F.col("source"), "n": F.col("n_chars")}).alias("message"),
    )


@query(r"""WITH e AS (SELECT event_id, value / 300 AS c, event_id % 10 AS a, event_id * 7 % 15 AS b, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://h/x' ELSE 'https://h/' || event_id END AS url,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '2024-02-30' WHEN 2 THEN '2024-1-3' ELSE strftime(ts, '%Y-%m-%d') END AS day, CASE event_id % 3 WHEN 0 THEN 'https://www.wikidata.org/wiki/Q' || event_id WHEN 1 THEN 'https://www.wikidata.org/wiki/P' || event_id END AS q, event_id % 5 AS d, event_id % 4 AS u, event_id % 3 AS w FROM events)
SELECT event_id, c <= 1 AS confidence, b >= a AS offsets, u <> 1 AS url, d NOT IN (1, 2) AS day, w <> 1 AS wikidata FROM e""")
def field_checks(spark, sf_dir):
    """Checks of confidence, offsets, addresses, days and Wikidata entities; nulls pass."""
    e, n = model.table(spark, sf_dir, "events"), F.col("event_id")
    url = F.when(n % 4 == 1, "ftp://h/x").when(n % 4 > 1, F.concat(F.lit("https://h/"), "event_id"))
    day = F.when(n % 5 == 1, "2024-02-30").when(n % 5 == 2, "2024-1-3").when(n % 5 > 2, F.date_format("ts", "yyyy-MM-dd"))
    wikidata = F.when(n % 3 == 0, F.concat(F.lit("https://www.wikidata.org/wiki/Q"), "event_id")).when(n % 3 == 1, F.concat(F.lit("https://www.wikidata.org/wiki/P"), "event_id"))
    return e.select("event_id", text.valid_fields(F.col("value") / 300, n % 10, n * 7 % 15, url, day, wikidata).alias("v")).select("event_id", "v.*")


@query("""SELECT o_orderkey, md5('{"key":' || o_orderkey || ',"note":' || CASE WHEN o_orderkey % 3 = 0 THEN '"x' || o_orderkey || '"' ELSE 'null' END || ',"state":"' || o_orderstatus || '"}') AS checksum FROM orders""")
def row_checksums(spark, sf_dir):
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x"), "o_orderkey"))
    return model.table(spark, sf_dir, "orders").select("o_orderkey", text.checksum(state=F.col("o_orderstatus"), note=note, key=F.col("o_orderkey")).alias("checksum"))


@query("""SELECT event_id, ((epoch_us(now) // 1000000 - epoch_us(ts) // 1000000) // 3600)::BIGINT AS total, ((epoch_us(now) // 1000000 - epoch_us(ts) // 1000000) // 3600 % 24)::BIGINT AS field FROM events, (SELECT max(ts) AS now FROM events)""")
def alert_ages(spark, sf_dir):
    """Hours that an event is old: in all, and the field that wraps at a day."""
    events = model.table(spark, sf_dir, "events")
    dated = events.crossJoin(model.as_of(events, "ts"))
    return dated.select("event_id", *[dates.hours_between(F.col("ts"), F.col("now"), f).cast("long").alias(name) for f, name in ((False, "total"), (True, "field"))])


@query("""SELECT l_orderkey, l_linenumber, 'f' || l_orderkey AS fragment, l_returnflag AS kind, l_linenumber::VARCHAR AS number FROM lineitem WHERE l_linenumber % 3 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, NULL, NULL, NULL FROM lineitem WHERE l_linenumber % 3 = 0""")
def reference_fields(spark, sf_dir):
    """References made and taken apart again; every third is none."""
    made = F.when(F.col("l_linenumber") % 3 != 0, text.global_reference(F.concat(F.lit("f"), "l_orderkey"), F.col("l_returnflag"), F.col("l_linenumber"))).otherwise(F.concat(F.lit("f#"), "l_linenumber"))
    return model.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.reference_parts(made).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query(r"""SELECT p_partkey, 'Nandu &quot;' || p_name || '&quot; O&#x27;Neil - ' || p_partkey || ', ltd.' AS name FROM part""")
def entity_names(spark, sf_dir):
    """Names with accents, marks that go and marks that are escaped."""
    raw = F.concat(F.lit('  Ñandú  <&"'), "p_name", F.lit("\"  O'Neil@ - "), "p_partkey", F.lit(",\nltd.!"))
    return model.table(spark, sf_dir, "part").select("p_partkey", text.entity_name(raw).alias("name"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, html FROM pages), d AS (SELECT *, regexp_extract(host, '[^.]+[.][^.]+$') AS domain FROM p)
SELECT page_id, nullif(CASE WHEN domain = 'example.com' THEN coalesce(nullif(regexp_extract(html, 'track[(]([0-9]+)[)]', 1), ''), '') WHEN domain = 'example.net' THEN coalesce(nullif(regexp_extract(html, '<!-- none ([0-9]+) -->', 1), ''), regexp_extract(html, '<!-- ad ([0-9]+) -->', 1)) ELSE regexp_extract(html, '<html lang="([a-z]+)"', 1) END, '') AS field FROM d""")
def site_fields(spark, sf_dir):
    """A field by the patterns of each page's site, the first that gives something, and by the general ones elsewhere."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    rules = {"example.com": [r"track[(]([0-9]+)[)]"], "example.net": [r"<!-- none ([0-9]+) -->", r"<!-- ad ([0-9]+) -->"]}
    return model.table(spark, sf_dir, "pages").select("page_id", html.by_site(F.col("html"), F.regexp_extract(host, r"[^.]+[.][^.]+$", 0), rules, ['<html lang="([a-z]+)"']).alias("field"))
