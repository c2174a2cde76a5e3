"""Text functions on columns: cleaning, authors, lists, language and media names, paths, reading time, validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sequences of wrongly decoded UTF-8 and what they stand for.
MOJIBAKE = {"Ã¡": "á", "Ã©": "é", "Ã­": "í", "Ã³": "ó", "Ãº": "ú", "Ã±": "ñ"}
#: Names of languages and of media, and the kinds of media that are allowed.
LANGUAGES = {"español": "es", "spanish": "es", "english": "en", "inglés": "en", "portugués": "pt", "portuguese": "pt", "français": "fr", "french": "fr", "francés": "fr"}
MEDIA = {"newspaper": "diario", "periodico": "diario", "periódico": "diario", "tv": "televisión", "television": "televisión", "agency": "agencia", "web": "digital", "website": "digital", "government": "oficial", "gobierno": "oficial"}
MEDIA_KINDS = ("diario", "agencia", "televisión", "radio", "digital", "oficial", "blog", "otro")
#: Characters that a form of normalisation may change, by itself or with its neighbours (tests try all below U+0300).
_CHANGED = {
    "NFC": r"[^\x{0}-\x{2FF}]",
    "NFKC": r"[\x{A0}\x{A8}\x{AA}\x{AF}\x{B2}-\x{B5}\x{B8}-\x{BA}\x{BC}-\x{BE}\x{132}\x{133}\x{13F}\x{140}\x{149}\x{17F}\x{1C4}-\x{1CC}\x{1F1}-\x{1F3}\x{2B0}-\x{2B8}\x{2D8}-\x{2DD}\x{2E0}-\x{2E4}]|[^\x{0}-\x{2FF}]",
    "NFKD": r"[^\x{0}-\x{9F}]",
}


def normal(c: Column, form: str) -> Column:
    """Unicode normalisation. Spark has no function for it, so texts that it may change, and no others, go through Arrow."""
    import unicodedata

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return F.coalesce(run(F.when(c.rlike(_CHANGED[form]), c)), c)


def collapse(c: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_loaded(c: Column) -> Column:
    """As fields are loaded: composed (NFC), without escape characters, white space collapsed."""
    return collapse(F.regexp_replace(normal(c, "NFC"), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def clean_stored(c: Column) -> Column:
    """As fields are cleaned: compatible forms (NFKC), quotes made plain, zero-width characters out, wrongly decoded letters put right."""
    c = normal(c, "NFKC")
    c = F.translate(c, "“”„«»‘’‚\u200b\u200c\u200d\ufeff", '"' * 5 + "'" * 3)  # what has no counterpart goes
    right = c
    for wrong, letter in MOJIBAKE.items():
        right = F.replace(right, F.lit(wrong), F.lit(letter))
    return collapse(F.when(c.contains("Ã"), right).otherwise(c))


def clean_piped(c: Column, lines: bool = False) -> Column:
    """Control characters to blanks; with `lines`, lines stay and are collapsed each."""
    if not lines:
        return collapse(F.regexp_replace(c, r"\p{C}", " "))
    kept = F.regexp_replace(c, r"[\p{C}&&[^\n\r\t]]", " ")
    return F.trim(F.array_join(F.transform(F.split(kept, r"\r?\n"), lambda x: collapse(x)), "\n"))


def tidy_marks(c: Column) -> Column:
    """Repeated marks to one, no blanks around line ends, two line ends at most."""
    c = F.regexp_replace(c, r"([!?.,;:])\1+", "$1")
    c = F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n")
    return F.trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def first_author(c: Column, most: int = 200) -> Column:
    """Cleaned, without a leading word like 'by' or 'por', at most 200 characters, of which the last three are dots if it was cut."""
    bare = collapse(clean_loaded(c))
    for word in (r"Por\b", r"By\b", r"De\b", r"From\b", "Autor:", "Author:"):
        bare = F.trim(F.regexp_replace(bare, f"^{word}", ""))
    return F.when(F.length(bare) > most, F.concat(F.substring(bare, 1, most - 3), F.lit("..."))).otherwise(bare)


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first, whatever stands before it (initcap looks for blanks only)."""
    parts = F.split(c, r"(?<=[^\p{L}])(?=\p{L})|(?<=\p{L})(?=[^\p{L}])")
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def authors(c: Column) -> Column:
    """Several authors in one field: a leading word out, split, titles, mail addresses and handles out, in title case, joined by commas."""
    c = F.regexp_replace(c, r"^(Por|By|De|From)\s", "")
    parts = F.split(c, r"\s+y\s+|\s+and\s+|\s*&\s*|,\s*|;\s*")
    bare = lambda p: title_case(collapse(F.regexp_replace(F.regexp_replace(p, r"(Dr|Prof|Sr|Sra|Mr|Mrs|Ms)\. ?", ""), r"\S+@\S+|@\w+", "")))
    return F.array_join(F.filter(F.transform(parts, bare), lambda p: p != ""), ", ")


def list_items(c: Column) -> Column:
    """Entries between , ; or |, without quotes, in lower case, each once."""
    items = F.transform(F.split(c, r"[,;|]"), lambda x: F.lower(F.trim(F.regexp_replace(x, "[\"']", ""))))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def _mapped(c: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(c)))


def language_code(c: Column) -> Column:
    """Two letters for a language: by its name, else the first two of its code (es-ES, spa); Spanish where there is none."""
    code = F.lower(F.trim(c))
    return F.coalesce(_mapped(c, LANGUAGES), F.when(F.length(code) >= 2, F.substring(code, 1, 2)), F.lit("es"))


def media_type(c: Column) -> Column:
    """A known kind of media; 'otro' for others."""
    kind = F.lower(F.trim(c))
    return F.coalesce(_mapped(c, MEDIA), F.when(kind.isin(*MEDIA_KINDS), kind), F.lit("otro"))


def slug(c: Column, most: int = 100) -> Column:
    plain = F.translate(F.lower(c), "áàâäéèêëíìîïóòôöúùûüñç", "aaaaeeeeiiiioooouuuunc")
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+", ""), 1, most), "-+$", "")


def storage_path(outlet: Column, day: Column, title: Column) -> Column:
    """outlet/yyyy/mm/dd/slug.html.gz"""
    return F.concat_ws("/", slug(outlet), F.date_format(day, "yyyy/MM/dd"), F.concat(slug(title), F.lit(".html.gz")))


def reading_minutes(c: Column) -> Column:
    words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.bround(words / 200.0).cast("int"))


def embedding_text(*parts: Column, most: int = 512) -> Column:
    """Parts joined by bars (nulls skipped), collapsed, cut to what a model takes."""
    return F.substring(collapse(F.concat_ws(" | ", *parts)), 1, most)


def escape_html(c: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def entity_name(c: Column) -> Column:
    """Letters, digits, white space and - _ . , ' " of a decomposed name (NFKD: accents go), collapsed and escaped."""
    return escape_html(collapse(F.regexp_replace(normal(c, "NFKD"), r"""[^\p{L}\p{N}\s\-_.,'"]""", "")))


#: Which fields of a table are joined for its vector, with what stands before each.
COMBINED = {
    "entidades": (("nombre", ""), ("tipo", "Tipo: "), ("descripcion", ""), ("alias", "También conocido como: ")),
    "hilos_narrativos": (("titulo", ""), ("descripcion", ""), ("descripcion_hilo_curada", "Enfoque editorial: "), ("puntos_clave_novedades", "Novedades: "), ("etiquetas_principales", "Temas: ")),
    "citas_textuales": (("cita", ""), ("contexto", "Contexto: "), ("etiquetas", "Etiquetas: ")),
    "fragmentos_extensos": (("titulo_seccion", "Sección: "), ("contenido", "")),
    "datos_cuantitativos": (("indicador", ""), ("categoria", "Categoría: "), ("valor", "Valor: "), ("ambito_geografico", "Ámbito: "), ("fuente_especifica", "Fuente: "), ("notas", "Notas: ")),
    "hechos": (("contenido", ""), ("tipo_hecho", "Tipo: "), ("paises", "Países: "), ("pais", "País: "), ("etiquetas", "Etiquetas: ")),
}


def combined(table: str, values: dict[str, Column]) -> Column:
    """The text of a row for its vector: fields that have a value, in order, between bars. Lists are columns already joined by commas."""
    parts = [F.when(F.coalesce(values[f], F.lit("")) != "", F.concat(F.lit(before), values[f])) for f, before in COMBINED[table] if f in values]
    return F.concat_ws(" | ", *parts)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """{{name}} to values, nulls to nothing."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def stable_id(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(1_000_000))


def global_reference(fragment: Column, kind: Column, number: Column) -> Column:
    return F.concat_ws("#", fragment, kind, number.cast("string"))


def reference_parts(c: Column) -> Column:
    """fragment, kind and number of a global reference; nulls where it isn't one."""
    return F.struct(*[F.nullif(F.regexp_extract(c, r"^([^#]+)#([^#]+)#(\d+)$", i), F.lit("")).alias(n) for i, n in ((1, "fragment"), (2, "kind"), (3, "number"))])


def valid_fields(confidence: Column, start: Column, end: Column, url: Column, day: Column, wikidata: Column) -> Column:
    """A struct of checks; null values pass."""
    return F.struct(
        F.coalesce(confidence.between(0, 1), F.lit(True)).alias("confidence"), F.coalesce((start >= 0) & (end >= start), F.lit(True)).alias("offsets"), F.coalesce(url.rlike("^https?://[^\\s/]+"), F.lit(True)).alias("url"),
        (day.isNull() | (day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull())).alias("day"), F.coalesce(wikidata.rlike(r"^https?://www\.wikidata\.org/(wiki|entity)/Q\d+$"), F.lit(True)).alias("wikidata"),
    )


def checksum(**parts: Column) -> Column:
    """MD5 of the parts as JSON with sorted keys, nulls among them."""
    return F.md5(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}))


def message(kind: Column, value: Column, limit: Column, most: int = 200) -> Column:
    """An alert's line: kind, value and limit with two places, and the share of the limit in percent; at most 200 characters."""
    return F.left(F.format_string("%s: %.2f (límite %.2f, %s%%)", kind, value, limit, F.coalesce(F.bround(F.try_divide(value * 100, limit)).cast("int").cast("string"), F.lit("-"))), F.lit(most))
