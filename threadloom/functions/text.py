"""Scalar expressions over text and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prose(text: Column) -> Column:
    """Text without fenced code, inline code and addresses."""
    out = F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", " ")
    out = F.regexp_replace(out, "`[^`]*`", " ")
    return F.regexp_replace(out, r"https?://\S+", " ")


def dominant_script(text: Column) -> Column:
    """ko, en or null: Hangul letters weigh two and a half Latin ones."""
    p = prose(text)
    hangul = F.length(F.regexp_replace(p, r"[^\x{AC00}-\x{D7A3}]", "")) * 2.5
    latin = F.length(F.regexp_replace(p, "[^A-Za-z]", ""))
    return F.when(hangul > latin, "ko").when(latin > hangul, "en")


def normalized_fact(text: Column) -> Column:
    """Lower case, single spaces, no closing stops (stops that white space follows stay), then trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s\x{0b}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+", " "), r"[.!。]+\z", ""))


def storage_key(path: Column) -> Column:
    """A file-safe base name and eight digits of the path's hash."""
    base = F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), "[^A-Za-z0-9._-]", "-")
    return F.concat(base, F.lit("--"), F.substring(F.sha2(path, 256), 1, 8))


def workstream_id(*parts: Column) -> Column:
    return F.concat(F.lit("ws-"), F.substring(F.sha2(F.concat(*(F.concat(p, F.lit("\0")) for p in parts)), 256), 1, 32))


def first_json(text: Column) -> Column:
    """The first JSON object or array of a model's answer, fenced or not; null if it does not parse."""
    body = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once: inside a fold every mention of an expression costs its evaluation."""
    return F.element_at(F.transform(F.array(value), use), 1)
