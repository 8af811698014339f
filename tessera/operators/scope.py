"""Scopes: named predicates over records, compiled to one Column that Catalyst pushes down."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scope key and the column it names.
LISTS = {"source_types": "source_type", "source_names": "source_name", "products": "product", "skus": "sku", "sentiments": "sentiment"}
KEYS = {*LISTS, "ratings", "time_range", "tags_any", "metadata_equals"}


def one_of(column: str, values: Sequence[str]) -> Column:
    """Membership; null never matches, and an empty list matches nothing."""
    return F.coalesce(F.col(column).isin(list(values)), F.lit(False)) if values else F.lit(False)


def rating_range(low: float | None, high: float | None) -> Column:
    """Inclusive; null bounds are open, null ratings are outside."""
    out = F.col("rating").isNotNull()
    if low is not None:
        out = out & (F.col("rating") >= low)
    return out & (F.col("rating") <= high) if high is not None else out


def time_range(start_ms: int | None, end_ms: int | None) -> Column:
    """Inclusive at both ends, in milliseconds."""
    out = F.lit(True)
    if start_ms is not None:
        out = out & (F.col("timestamp_ms") >= start_ms)
    return out & (F.col("timestamp_ms") <= end_ms) if end_ms is not None else out


def tags_any(values: Sequence[str]) -> Column:
    """Any of the tags; null tags are none, an empty list matches nothing."""
    if not values:
        return F.lit(False)
    return F.coalesce(F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isin(list(values))), F.lit(False))


def metadata_equals(column: str, key: str, value: str | bool | int | float | None) -> Column:
    """Typed equality on a top-level key of JSON text: the number 5 isn't the text "5". Null matches nothing."""
    if value is None:
        return F.lit(False)
    if isinstance(value, (list, dict)):
        raise ValueError("metadata_equals takes scalar values")
    parsed = F.try_parse_json(F.col(column))
    path = "$['" + key.replace("'", "\\'") + "']"
    kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    if isinstance(value, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(parsed, path, "boolean") == value), F.lit(False))
    if isinstance(value, str):
        return F.coalesce((kind == "STRING") & (F.try_variant_get(parsed, path, "string") == value), F.lit(False))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.coalesce(number & (F.try_variant_get(parsed, path, "double") == float(value)), F.lit(False))


def millis(text: str) -> int:
    """Epoch milliseconds of an ISO time; without an offset it is UTC."""
    at = datetime.fromisoformat(text)
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp() * 1000)


def predicate(scope: dict) -> Column:
    """All parts of a scope, and that the record is active."""
    if unknown := set(scope) - KEYS:
        raise ValueError(f"unknown scope keys: {sorted(unknown)}")
    parts = [F.col("is_active")]
    parts += [one_of(column, scope[key]) for key, column in LISTS.items() if key in scope]
    if "ratings" in scope:
        parts.append(rating_range(scope["ratings"].get("min"), scope["ratings"].get("max")))
    if "time_range" in scope:
        ends = [scope["time_range"].get(k) for k in ("start", "end")]
        parts.append(time_range(*(None if e is None else millis(e) for e in ends)))
    if "tags_any" in scope:
        parts.append(tags_any(scope["tags_any"]))
    parts += [metadata_equals("metadata", k, v) for k, v in scope.get("metadata_equals", {}).items()]
    return reduce(lambda a, b: a & b, parts)


def scoped(records: DataFrame, scope: dict) -> DataFrame:
    return records.where(predicate(scope))


def focused(records: DataFrame, members: DataFrame, cluster_id: int) -> DataFrame:
    """Records that are members of one topic."""
    keys = members.where(F.col("cluster_id") == cluster_id).select("record_id")
    return records.join(keys, "record_id", "left_semi")


def searched(records: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which the columns, joined by spaces without nulls, hold the text in any case."""
    return records.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.lower())))


def gated(summaries: DataFrame, include_junk: bool = False) -> DataFrame:
    """Rows that have a summary and, unless junk is wanted, whose junk_type is none."""
    have = summaries.where("summary is not null")
    return have if include_junk else have.where("junk_type = 'none'")


def gate_report(summaries: DataFrame, include_junk: bool = False) -> DataFrame:
    """kept, missing and skipped counts of gated()."""
    junk = F.col("summary").isNotNull() & (F.coalesce("junk_type", F.lit("")) != "none")
    skipped = F.lit(False) if include_junk else junk
    return summaries.agg(
        F.count_if(F.col("summary").isNotNull() & ~skipped).alias("kept"),
        F.count_if(F.col("summary").isNull()).alias("missing"),
        F.count_if(skipped).alias("skipped"),
    )
