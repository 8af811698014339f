"""Text and hash functions as Columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000  # microseconds


def utc_day(ts: Column) -> Column:
    """The date of an instant in UTC; a cast to date would take the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts.cast("timestamp")) / _DAY).cast("int"))


def utc_time(ts: Column) -> Column:
    """ISO text of an instant in UTC, with milliseconds only where there are any microseconds."""
    micros = F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(_DAY))
    part = lambda size, of: F.floor(micros / size).cast("long") % of
    clock = (utc_day(ts).cast("string"), part(3_600_000_000, 24), part(60_000_000, 60), part(1_000_000, 60))
    whole = F.format_string("%sT%02d:%02d:%02dZ", *clock)
    broken = F.format_string("%sT%02d:%02d:%02d.%03dZ", *clock, part(1000, 1000))
    return F.when(micros % 1_000_000 == 0, whole).when(ts.isNotNull(), broken)

#: Words that say nothing as a label on their own.
GENERIC_WORDS = [
    "customer", "customers", "feedback", "general", "issue", "issues", "misc", "miscellaneous", "other", "request",
    "requests", "support", "topic", "topics",
]
LEAST_TOKENS = 3


def rendered_fields(fields: dict[str, Column]) -> Column:
    """``name: value`` lines; null and empty values are left out. Arrays are joined beforehand."""
    lines = (F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in fields.items())
    return F.concat_ws("\n", *lines)


def rendered_template(template: str, fields: dict[str, Column]) -> Column:
    """``{name}`` becomes the field, or nothing if there is no such field or value."""
    parts = [F.lit(p) if i % 2 == 0 else F.coalesce(fields[p], F.lit("")) if p in fields else F.lit("") for i, p in enumerate(re.split(r"\{(\w+)\}", template))]
    return F.concat(*parts)


def joined(array: Column) -> Column:
    return F.array_join(array, ", ")


def first_tokens(text: Column, n: int) -> Column:
    """The text's first n tokens by white space, one space between; shorter texts stay as they are."""
    tokens = F.split(F.trim(text), r"[ \t\n\r]+")
    return F.when(F.size(tokens) > n, F.array_join(F.slice(tokens, 1, n), " ")).otherwise(text)


def token_count(text: Column) -> Column:
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"[ \t\n\r]+")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def label_tokens(label: Column) -> Column:
    return F.regexp_extract_all(F.lower(label), F.lit("[a-z0-9]+"), F.lit(0))


def normalised_label(label: Column) -> Column:
    return F.array_join(label_tokens(label), " ")


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if one is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def label_flags(label: Column) -> Column:
    """Struct of short (fewer than LEAST_TOKENS tokens) and generic (no token says anything, or there is none)."""
    tokens = label_tokens(label)
    plain = F.size(F.array_except(tokens, F.array(*map(F.lit, GENERIC_WORDS)))) == 0
    return F.struct((F.size(tokens) < LEAST_TOKENS).alias("short"), plain.alias("generic"))


def labelled_lines(fields: dict[str, Column]) -> Column:
    """``name: value`` lines with ``(none)`` for null."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(c, F.lit("(none)"))) for k, c in fields.items()))


def utf16_slice(text: Column, pos: Column, n: Column) -> Column:
    """Struct of text and error: n UTF-16 code units from pos; a range outside or a split pair is an error."""
    raw = F.encode(text, "UTF-16LE")
    size = F.octet_length(raw) / 2
    cut = F.substring(raw, pos * 2 + 1, n * 2)

    def unit(at: Column) -> Column:
        return F.conv(F.hex(F.substring(raw, at * 2 + 2, F.lit(1))), 16, 10).cast("int")

    low = (n > 0) & unit(pos).between(0xDC, 0xDF)
    high = (n > 0) & unit(pos + n - 1).between(0xD8, 0xDB)
    error = F.when((pos < 0) | (n < 0) | (pos + n > size), "out of range").when(low | high, "splits a surrogate pair")
    return F.struct(F.when(error.isNull(), F.decode(cut, "UTF-16LE")).alias("text"), error.alias("error"))


def identity_hash(*parts: Column) -> Column:
    """SHA-256 of the compact JSON array of strings."""
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with its keys in order and nulls written out."""
    row = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def fixed_fields(names: Sequence[str]) -> dict[str, Column]:
    return {n: F.col(n) for n in names}
