"""Scalars: times, names, numbers in texts, and the standard functions of graph-pattern expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_time(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def format_time(ms: Column, pattern: str, offset_minutes: int = 0) -> Column:
    """Text of a time; the client's offset is subtracted."""
    return F.date_format(F.timestamp_millis(ms - 60_000 * offset_minutes), pattern)


def expand_name(name: Column, prefixes: dict[str, str]) -> Column:
    """prefix:rest with a known prefix as a full URI; other names stay."""
    if not prefixes:
        return name
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    base = F.element_at(table, F.substring_index(name, ":", 1))
    return F.when(name.contains(":") & base.isNotNull(), F.concat(base, F.regexp_replace(name, "^[^:]*:", ""))).otherwise(name)


def relative(uri: Column) -> Column:
    """A relative URI without the scheme that marks it."""
    return F.regexp_replace(uri, "^r:", "")


def is_uri(uri: Column) -> Column:
    """Not empty and without white space."""
    return uri.isNotNull() & (uri != "") & ~uri.rlike(r"\s")


def checked_uri(uri: Column) -> Column:
    return F.when(is_uri(uri), uri).otherwise(F.raise_error(F.concat(F.lit("invalid URI: "), F.coalesce(uri, F.lit("null")))))


def number_in(text: Column) -> Column:
    """A number as written in one of several habits; null if it is none.

    1234.5 as it is; otherwise the separator that comes last, comma or point, is the decimal one: 1,234.5 and 1.234,5.
    """
    point_last = F.regexp_like(text, F.lit(r",[^,]*\.[^,]*$"))
    cleaned = F.when(point_last, F.replace(text, F.lit(","))).otherwise(F.replace(F.replace(text, F.lit(".")), F.lit(","), F.lit(".")))
    return F.coalesce(text.try_cast("double"), F.when(text.contains(","), cleaned.try_cast("double")))


def aas_uri(identifier: Column) -> Column:
    """URI of a shell or submodel: its id in URL-safe base64 without padding."""
    code = F.translate(F.base64(F.encode(identifier, "UTF-8")), "+/", "-_")
    return F.concat(F.lit("urn:aas:"), F.regexp_replace(code, "[=\\s]+", ""))


def aas_id(uri: Column) -> Column:
    code = F.translate(F.regexp_replace(uri, "^urn:aas:", ""), "-_", "+/")
    return F.decode(F.unbase64(F.concat(code, F.repeat(F.lit("="), F.pmod(-F.length(code), F.lit(4))))), "UTF-8")


#: Functions by their name in expressions.
STANDARD: dict[str, Callable[..., Column]] = {
    "STRLEN": F.length,
    "SUBSTR": lambda s, start, n=None: F.substr(s, start.cast("int"), n.cast("int")) if n is not None else F.substr(s, start.cast("int")),
    "UCASE": F.upper,
    "LCASE": F.lower,
    "CONTAINS": F.contains,
    "STRSTARTS": F.startswith,
    "STRENDS": F.endswith,
    "STRBEFORE": lambda s, x: F.when(F.instr(s, x) > 0, F.substr(s, F.lit(1), F.instr(s, x) - 1)).otherwise(""),
    "STRAFTER": lambda s, x: F.when(F.instr(s, x) > 0, F.substr(s, F.instr(s, x) + F.length(x))).otherwise(""),
    "REPLACE": lambda s, pattern, to: F.regexp_replace(s, pattern, to),
    "REGEX": lambda s, pattern, flags=None: F.regexp_like(s, pattern if flags is None else F.concat(F.lit("(?"), flags, F.lit(")"), pattern)),
    "CONCAT": F.concat,
    "ABS": F.abs,
    "ROUND": F.round,
    "CEIL": F.ceil,
    "FLOOR": F.floor,
    "RAND": F.rand,
    "NOW": F.current_timestamp,
    "YEAR": F.year,
    "MONTH": F.month,
    "DAY": F.dayofmonth,
    "HOURS": F.hour,
    "MINUTES": F.minute,
    "SECONDS": F.second,
    "MD5": F.md5,
    "SHA1": F.sha1,
    "SHA256": lambda x: F.sha2(x, 256),
    "SHA384": lambda x: F.sha2(x, 384),
    "SHA512": lambda x: F.sha2(x, 512),
    "COALESCE": F.coalesce,
    "IF": lambda c, a, b: F.when(c, a).otherwise(b),
    "BOUND": lambda x: x.isNotNull(),
    "STR": lambda x: x.cast("string"),
    "IRI": lambda x: x,
    "URI": lambda x: x,
    "ENCODE_FOR_URI": lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")),
    "SAMETERM": lambda a, b: a == b,
    "STRUUID": F.uuid,
    "UUID": lambda: F.concat(F.lit("urn:uuid:"), F.uuid()),
    "ISNUMERIC": lambda x: x.try_cast("double").isNotNull(),
    "DATETIME": date_time,
}
AGGREGATES: dict[str, Callable[..., Column]] = {
    "COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max,
    "SAMPLE": lambda x: F.first(x, ignorenulls=True), "GROUP_CONCAT": lambda x: F.listagg(x, F.lit(" ")),
}
