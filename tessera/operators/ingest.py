"""Strict validation of JSON records, keyed upserts, and what is kept of rejects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import utc_time

REQUIRED = ["recordId", "sourceType", "sourceName", "sourceRecordId", "customerText"]
OPTIONAL = ["title", "recordUrl", "product", "sku", "sentiment"]
ALLOWED = [*REQUIRED, "timestamp", *OPTIONAL, "rating", "tags", "metadata"]
#: ISO 8601 as it is taken: a date, or a date and a time with an optional offset, extended or basic.
_DATE, _BASIC_DATE = r"\d{4}-\d{2}-\d{2}", r"\d{8}"
_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2})?)?"
ISO = rf"^(?:{_DATE}(?:[T ]\d{{2}}(?::\d{{2}}(?::\d{{2}}(?:[.,]\d{{1,9}})?)?)?{_OFFSET})?|{_BASIC_DATE}(?:[T ]\d{{2}}(?:\d{{2}}(?:\d{{2}}(?:[.,]\d{{1,9}})?)?)?{_OFFSET})?)$"

#: The form that most texts have: the steps below would leave it as it is.
_PLAIN = rf"^{_DATE}T\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d{{1,6}})?(?:Z|[+-]\d{{2}}:\d{{2}})$"


def parsed_timestamp(text: Column) -> Column:
    """Timestamp of ISO text, null if it is none. Without an offset it is UTC; dates are midnight."""
    basic = F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})(?=$|[T ])", "$1-$2-$3")
    basic = F.regexp_replace(basic, r"([T ])(\d{2})(\d{2})(\d{2})?(?=$|[.,Z+-])", "$1$2:$3:$4")
    basic = F.regexp_replace(F.regexp_replace(basic, r":(?=$|[Z+-])", ":00"), ",", ".")
    hours = F.regexp_replace(basic, r"([T ]\d{2})(?=$|[Z+-])", "$1:00")
    hours = F.regexp_replace(hours, r"([T ]\d{2}:\d{2})(?=[Z+-])", "$1:00")
    offset = F.regexp_replace(F.regexp_replace(hours, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"(:\d{2}(?:\.\d+)?[+-]\d{2})$", "$1:00")
    short = F.regexp_replace(offset, r"(\.\d{6})\d+", "$1")
    # the texts are of the form above, so the rest is a date, or ends in a time; each step is written once, as Catalyst repeats what is named twice
    timed = F.regexp_replace(short, r"^([^T ]*)\z", "$1T00:00:00Z")
    whole = F.regexp_replace(F.regexp_replace(timed, r"([T ]\d{2}:\d{2})$", "$1:00"), r"([T ][^Z+-]*)\z", "$1Z")
    return F.when(text.rlike(_PLAIN), F.try_to_timestamp(text)).when(text.rlike(ISO), F.try_to_timestamp(whole))


def timestamp_text(ts: Column) -> Column:
    """UTC text with milliseconds only where there are any microseconds."""
    return utc_time(ts)


def _error(name: str, message: str, when: Column) -> Column:
    """An array of one error, or an empty one."""
    return F.when(when, F.array(F.struct(F.lit(name).alias("field"), F.lit(message).alias("message")))).otherwise(F.array().cast("array<struct<field: string, message: string>>"))


def _once(*columns: Column) -> Column:
    """The columns behind a generator of one row, through which Catalyst doesn't push what is asked of them: each is worked out once."""
    return F.inline(F.array(F.struct(*columns)))


def _unpacked(lines: DataFrame, line_col: str) -> DataFrame:
    """lines with _v (the line's variant), and for each key its variant, its type's name and its text, once: g_, k_ and t_ and the key.

    Null and missing have no type.
    """
    kept = [F.col(f"`{c}`") for c in lines.columns]
    rows = lines.withColumn("_v", F.try_parse_json(line_col))
    rows = rows.select(*kept, "_v", _once(*(F.try_variant_get("_v", f"$.{n}", "variant").alias(f"g_{n}") for n in ALLOWED)))
    kinds = [F.nullif(F.schema_of_variant(f"g_{n}"), F.lit("VOID")).alias(f"k_{n}") for n in ALLOWED]
    texts = [F.try_variant_get(f"g_{n}", "$", "string").alias(f"t_{n}") for n in (*REQUIRED, *OPTIONAL, "timestamp")]
    rows = rows.select(*kept, "_v", "g_rating", "g_tags", "g_metadata", _once(*kinds, *texts))
    return rows.select("*", _once(parsed_timestamp(F.col("t_timestamp")).alias("_ts")))


def validated(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """lines with every record field, ts, normalized_json and errors (all that there are, in order).

    A line that is not a JSON object has one error without a field. Explicit null is absent.
    customer_text is trimmed, other text is kept as it is.
    """
    rows = _unpacked(lines, line_col)
    kind = {n: F.col(f"k_{n}") for n in ALLOWED}
    text = {n: F.col(f"t_{n}") for n in (*REQUIRED, *OPTIONAL, "timestamp")}
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    unknown = F.transform(
        F.array_sort(F.array_except(F.coalesce(F.json_object_keys(line_col), F.array().cast("array<string>")), F.array(*map(F.lit, ALLOWED)))),
        lambda k: F.struct(k.alias("field"), F.lit("is not a field of records").alias("message")),
    )
    errors = []
    for name in REQUIRED:
        blank = F.coalesce(text[name], F.lit("")).rlike(r"^\s*$")
        errors += [
            _error(name, "is missing", kind[name].isNull()),
            _error(name, "is no text", kind[name] != "STRING"),
            _error(name, "is blank", (kind[name] == "STRING") & blank),
        ]
    errors += [
        _error("timestamp", "is missing", kind["timestamp"].isNull()),
        _error("timestamp", "is no text with an ISO 8601 time", kind["timestamp"] != "STRING"),
        _error("timestamp", "names no ISO 8601 time", (kind["timestamp"] == "STRING") & F.col("_ts").isNull()),
    ]
    errors += [_error(n, "is given and no text", kind[n] != "STRING") for n in OPTIONAL]
    errors.append(_error("rating", "is given and no number", ~(kind["rating"].isin("BIGINT", "DOUBLE", "FLOAT") | kind["rating"].startswith("DECIMAL"))))
    errors.append(_error("tags", "are given and no list of texts", ~kind["tags"].isin("ARRAY<STRING>", "ARRAY<VOID>")))
    errors.append(_error("metadata", "are given and no object", ~kind["metadata"].startswith("OBJECT")))
    found = F.flatten(F.array(*errors))  # not a filter, under which all of these would be interpreted
    not_object = F.array(F.struct(F.lit("").alias("field"), F.lit("the line is no object").alias("message")))
    snake = {n: "".join(f"_{c.lower()}" if c.isupper() else c for c in n) for n in ALLOWED}
    return rows.select(
        *(F.col(f"`{c}`") for c in lines.columns),
        F.when(kind["recordId"] == "STRING", text["recordId"]).alias("record_key"),
        *(text[n].alias(snake[n]) for n in [*REQUIRED[1:4], *OPTIONAL]),
        F.trim(text["customerText"]).alias("customer_text"),
        F.try_variant_get("g_rating", "$", "double").alias("rating"),
        F.try_variant_get("g_tags", "$", "array<string>").alias("tags"),
        F.to_json("g_metadata").alias("metadata"),
        F.col("_ts").alias("ts"),
        F.unix_millis("_ts").alias("timestamp_ms"),
        F.to_json("_v").alias("normalized_json"),
        F.when(is_object, F.concat(unknown, found)).otherwise(not_object).alias("errors"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("errors") == 0).drop("errors")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("errors") > 0)


def admitted(rows: DataFrame, on_invalid: str = "reject") -> DataFrame:
    """Valid rows; with ``reject`` any invalid row fails the batch before anything is written."""
    if on_invalid not in ("reject", "skip"):
        raise ValueError("on_invalid is reject or skip")
    if on_invalid == "reject" and not rejected(rows).isEmpty():
        raise ValueError("the batch holds invalid records")
    return accepted(rows)


def admission_counts(rows: DataFrame) -> DataFrame:
    """valid, n: rows that ``skip`` admits and rows that it leaves out, from one pass over the lines."""
    return rows.groupBy((F.size("errors") == 0).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


def upserted(
    current: DataFrame, batch: DataFrame, now: Column, key: str = "record_key", order: str = "batch_index", dealt: tuple[Callable[[DataFrame], DataFrame], str] | None = None
) -> DataFrame:
    """The table after the batch: the last row of a key wins, created_at stays, rows become active.

    change is created, updated or kept. current has the batch's columns without ``order``, and
    created_at, updated_at, is_active. dealt: a function that deals rows out by their key, and the column that it adds and
    deals by; both sides are joined where it puts them.
    """
    values = [c for c in batch.columns if c not in (key, order)]
    newest = batch.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_row")).select(key, "_row.*")  # a task's rows of a key are one before they meet
    same, at = F.col(key) == F.col("_key"), []
    if dealt is not None:
        deal, place = dealt
        newest, current, at = deal(newest), deal(current), [F.col(place).alias("_at")]
        same &= F.col(place) == F.col("_at")
    old = current.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in [*values, "created_at", "updated_at", "is_active"]), *at)
    both = newest.withColumn("_hit", F.lit(True)).join(old, same, "full")
    hit = F.col("_hit").isNotNull()
    return both.select(
        F.coalesce(key, "_key").alias(key),
        *(F.when(hit, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in values),
        F.coalesce("_created_at", now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("_updated_at")).alias("updated_at"),
        (hit | F.col("_is_active")).alias("is_active"),
        F.when(hit & F.col("_key").isNull(), "created").when(hit, "updated").otherwise("kept").alias("change"),
    )


def upsert_counts(current: DataFrame, batch: DataFrame, key: str = "record_key") -> DataFrame:
    """created and updated rows of a batch: a key's first row is created, its later ones are updates."""
    n = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(current.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left")
    fresh = F.col("_key").isNull()
    return n.agg(
        F.coalesce(F.sum(fresh.cast("long")), F.lit(0)).alias("created"),
        F.coalesce(F.sum(F.col("_n") - fresh.cast("long")), F.lit(0)).alias("updated"),
    )


def encoded_row(tags: Column, metadata: Column) -> Column:
    """Tags and metadata as JSON text with sorted keys."""
    return F.struct(F.to_json(tags).alias("tags_json"), F.to_json(F.try_parse_json(metadata)).alias("metadata_json"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as they are, for validated()."""
    return spark.read.text(path)
