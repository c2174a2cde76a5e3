"""Dates from text: absolute forms, and Spanish ones relative to a moment."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order in which they are tried. Days and months may have one figure, months' names may be Spanish or English.
FORMATS = [
    "yyyy-M-d'T'H:m:sXXX", "yyyy-M-d'T'H:m:sxx", "yyyy-M-d'T'H:m:s.SSSXXX", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d",
    "d/M/yyyy H:m:s", "d/M/yyyy H:m", "d/M/yyyy", "d-M-yyyy H:m:s", "d-M-yyyy H:m", "d-M-yyyy", "d MMMM yyyy H:m:s", "d MMMM yyyy H:m", "d MMMM yyyy", "d/M/yy H:m:s", "d/M/yy H:m", "d/M/yy",
    "MMMM d yyyy h:m a", "MMMM d yyyy", "M/d/yyyy h:m a", "M/d/yyyy", "M-d-yyyy", "d MMMM yyyy H:m:s xx", "d MMMM yyyy H:m:s z", "d.M.yyyy H:m:s", "d.M.yyyy H:m", "d.M.yyyy", "yyyy/M/d",
]
MONTHS = ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"]
ENGLISH = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


_LETTERS = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": r"\p{L}+", "SSS": r"\d{3}", "XXX": r"(Z|[+-]\d\d:\d\d)", "xx": r"[+-]\d{4}", "z": "[A-Z]{2,5}", "a": "[AP]M", "'T'": "T", ".": r"\."}


def _shape(form: str) -> str:
    """A pattern of what a format may look like."""
    return "^" + re.sub(r"yyyy|yy|MMMM|SSS|XXX|xx|z|a|'T'|\.|[MdHhms]", lambda m: _LETTERS.get(m[0], r"\d{1,2}"), form) + "$"


def absolute(text: Column) -> Column:
    """A timestamp by the formats, or null. A weekday in front, commas and 'de' don't count; years of two figures are 1969 to 2068."""
    c = F.regexp_replace(F.trim(text), r"(?i)^((monday|tuesday|wednesday|thursday|friday|saturday|sunday|lunes|martes|mi[eé]rcoles|jueves|viernes|s[aá]bado|domingo),?|(mon|tue|wed|thu|fri|sat|sun|lun|mar|mi[eé]|jue|vie|s[aá]b|dom)\.?,)\s+(?=\d)", "")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, ",", " "), r"(?i)\s+de\s+", " "), r"\s+", " ")
    for spanish, english in zip(MONTHS, ENGLISH, strict=True):
        c = F.regexp_replace(c, rf"(?i)\b({spanish}|{english}|{english[:3]})\b\.?", english)
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)(?<=\d) ?a\.? ?m\.?$", " AM"), r"(?i)(?<=\d) ?p\.? ?m\.?$", " PM")

    def tried(c: Column) -> Column:
        found = []
        for form in FORMATS:
            moment = F.when(c.rlike(_shape(form)), F.try_to_timestamp(c, F.lit(form)))  # what can't be read is thrown, which is slow
            found.append(F.when(F.year(moment) >= 2069, moment - F.make_ym_interval(F.lit(100))).otherwise(moment) if "yyyy" not in form else moment)
        return F.coalesce(*found)

    return F.transform(F.array(c), tried)[0]  # bound once, so that the text isn't made ready anew for every format


def parse(text: Column, now: Column) -> Column:
    """A timestamp, or null for what is no date. Relative forms count from `now`; days start at midnight."""
    t = F.lower(F.trim(text))
    n = F.try_to_number(F.nullif(F.regexp_extract(t, r"^hace\s+(\d{1,6})\s", 1), F.lit("")), F.lit("999999")).cast("int")
    day = F.date_trunc("day", now)
    relative = F.when(t.startswith("hoy"), day).when(t.startswith("ayer"), day - F.expr("INTERVAL 1 DAY")).when(t.rlike(r"^hace\s+\d{1,6}\s+d[ií]as?$"), day - F.make_dt_interval(n))
    relative = relative.when(t.rlike(r"^hace\s+\d{1,6}\s+horas?$"), now - F.make_dt_interval(F.lit(0), n)).when(t.rlike(r"^hace\s+\d{1,6}\s+minutos?$"), now - F.make_dt_interval(F.lit(0), F.lit(0), n))
    return F.coalesce(relative, absolute(text))


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def ordered_range(start: Column, end: Column) -> Column:
    """A range whose ends are swapped where they are the wrong way round; open ends stay."""
    wrong = start.isNotNull() & end.isNotNull() & (start > end)
    return F.struct(F.when(wrong, end).otherwise(start).alias("lower"), F.when(wrong, start).otherwise(end).alias("upper"))


def hours_between(a: Column, b: Column, field: bool = False) -> Column:
    """Whole hours from a to b; field: only the hour field of the difference, which wraps at a day."""
    seconds = F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))
    hours = F.floor(seconds / 3600)
    return F.pmod(hours, F.lit(24)) if field else hours
