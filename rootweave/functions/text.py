"""Text functions: patterns of paths, typed literals, keys and numbers in names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a typed field of a pattern matches, and the Spark type it becomes.
FIELD = {"int": ("([0-9]*)", "bigint"), "float": (r"([-+]?[0-9]*\.?[0-9]+)", "double")}


def path_pattern(pattern: str) -> tuple[str, list[tuple[str, str]]]:
    """Regular expression and ``(name, type)`` fields of a pattern such as
    ``[age:str]/Photo_[id:int].jpg``; what stands between fields is literal."""
    parts = re.split(r"\[([^\]:]+)(?::([^\]]*))?\]", pattern)
    regex, fields = "^" + re.escape(parts[0]), []
    for name, kind, literal in zip(parts[1::3], parts[2::3], parts[3::3]):
        kind = (kind or "str").strip()
        regex += FIELD.get(kind, ("(.*)",))[0] + re.escape(literal)
        fields.append((name.strip(), kind))
    return regex, fields


def field(path: Column, regex: str, index: int, kind: str, date_format: str = "yyyy-MM-dd") -> Column:
    """Typed value of a capture group; null where the text does not match or cast."""
    raw = F.when(path.rlike(regex), F.regexp_extract(path, regex, index))
    if kind == "date":
        return F.try_to_timestamp(raw, F.lit(date_format))
    return raw.try_cast(FIELD[kind][1]) if kind in FIELD else raw


def format_pattern(pattern: str) -> tuple[str, list[tuple[str, str]]]:
    """As ``path_pattern`` for ``str.format`` style: ``{name:d}``, ``{name:f}``, ``{name}``."""
    parts = re.split(r"\{([^}:]*)(?::([^}]*))?\}", pattern)
    regex, fields = "^" + re.escape(parts[0]), []
    for i, (name, spec, literal) in enumerate(zip(parts[1::3], parts[2::3], parts[3::3])):
        kind = {"d": "int", "f": "float"}.get((spec or "")[-1:], "str")
        regex += {"int": "([-+]?[0-9]+)", "float": r"([-+]?[0-9]*\.?[0-9]+)"}.get(kind, "(.+)") + re.escape(literal)
        fields.append((name or f"_{i}", kind))
    return regex + "$", fields


def format_scan(text: Column, pattern: str) -> Column:
    """Struct of the fields of a format-style pattern, null where it does not match."""
    regex, fields = format_pattern(pattern)
    values = [field(text, regex, i, kind).alias(name) for i, (name, kind) in enumerate(fields, 1)]
    return F.when(text.rlike(regex), F.struct(*values))


def literal_kind(text: Column) -> Column:
    """``int``, ``float``, ``list``, ``dict`` or ``str``: what a literal would be read as."""
    t = F.trim(text)
    return (
        F.when(t.rlike(r"^[-+]?\d+$"), "int")
        .when(t.try_cast("double").isNotNull() & ~t.rlike("(?i)[fd]$"), "float")
        .when(t.rlike(r"(?s)^[\[(].*[\])]$"), "list")
        .when(t.rlike(r"(?s)^\{.*\}$"), "dict")
        .otherwise("str")
    )


def item_key(path: Column, base: str = "") -> Column:
    """Key of a path: without the base folder and the extension."""
    own = F.when(path.startswith(base), path.substr(F.lit(len(base) + 1), F.length(path))).otherwise(path) if base else path
    return F.regexp_replace(F.regexp_replace(own, r"^/+", ""), r"\.[^./]*$", "")


def safe_key(key: Column) -> Column:
    return F.translate(key, "/", "_")


def absolute(path: Column, base: str) -> Column:
    """Absolute paths and urls stay, others are taken from ``base``."""
    return F.when(path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def url_scheme(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")


def last_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)\D*$", 1).try_cast("bigint")


def numbered(text: Column, name: str) -> Column:
    """Number after ``name`` and an optional blank, such as ``Boite 12``."""
    return F.regexp_extract(text, rf"(?i){re.escape(name)} ?(\d+)", 1).try_cast("bigint")


def relocate(c: Column, old: str, new: str) -> Column:
    """Replace a path prefix."""
    return F.when(c.startswith(old), F.concat(F.lit(new), c.substr(F.lit(len(old) + 1), F.length(c)))).otherwise(c)


def typed_literal(text: Column) -> Column:
    """A literal's value by kind: ``struct(kind, number, items, text)`` with the number of
    an ``int`` or ``float`` and the trimmed items of a flat list."""
    kind = literal_kind(text)
    inner = F.regexp_replace(F.trim(text), r"^[\[(]|[\])]$", "")
    items = F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        kind.alias("kind"), F.when(kind.isin("int", "float"), text.try_cast("double")).alias("number"), F.when(kind == "list", items).alias("items"), F.when(kind == "str", text).alias("text")
    )
