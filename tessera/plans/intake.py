"""Queries of ingest, text functions, providers and the run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import ingest, ledger, providers
from tessera.operators import topics as tp
from tessera.plans import scripted
from tessera.plans.book import query
from tessera.plans.fixture import RECORDS, members, records, with_ctes
from tessera.plans.records import BEST, LABELS_ALL, SUMMARY, some_labels, summary_of
from tessera.plans.trends import BASE
from tessera.session import fresh_path

NOW = "timestamp'2024-03-01'"


def json_lines(spark, sf_dir) -> DataFrame:
    """Records as JSON lines; every 17th lacks its text, every 19th has a key too many, every 23rd a wrong rating."""
    e = F.col("event_id")
    r = records(spark, sf_dir)
    head = F.to_json(
        F.struct(
            F.col("record_id").alias("recordId"),
            F.col("source_type").alias("sourceType"),
            F.col("source_name").alias("sourceName"),
            F.col("record_id").alias("sourceRecordId"),
            F.when(e % 17 != 0, F.concat(F.lit("  "), "customer_text", F.lit(" "))).alias("customerText"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
            "tags",
        )
    )
    tail = F.concat(
        F.when(e % 19 == 0, F.lit(',"extra":1')).otherwise(""),
        F.when(e % 23 == 0, F.lit(',"rating":true')).otherwise(F.concat(F.lit(',"rating":'), F.col("rating").cast("string"))),
        F.concat(F.lit(',"metadata":'), "metadata"),
    )
    return r.select("event_id", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), tail, F.lit("}")).alias("value"))


_BAD = """SELECT event_id, record_id,
  list_filter([CASE WHEN event_id % 19 = 0 THEN 'extra' END, CASE WHEN event_id % 17 = 0 THEN 'customerText' END, CASE WHEN event_id % 23 = 0 THEN 'rating' END], lambda x: x IS NOT NULL) AS bad FROM records"""


@query("i01_validation", with_ctes(RECORDS, select=f"SELECT record_id, array_to_string(bad, ',') AS fields FROM ({_BAD})"))
def i01(spark, sf_dir) -> DataFrame:
    rows = ingest.validated(json_lines(spark, sf_dir))
    return rows.select(F.col("record_key").alias("record_id"), F.array_join(F.transform("errors", lambda e: e["field"]), ",").alias("fields"))


@query("i02_timestamps", with_ctes(RECORDS, select="SELECT record_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, epoch_ms(date_trunc('second', ts)) AS timestamp_ms FROM records"))
def i02(spark, sf_dir) -> DataFrame:
    text = F.date_format(F.from_utc_timestamp("ts", "+02:00"), "yyyyMMdd'T'HHmmss'+0200'")
    ts = ingest.parsed_timestamp(text)
    return records(spark, sf_dir).select("record_id", ingest.timestamp_text(ts).alias("timestamp_utc"), F.unix_millis(ts).alias("timestamp_ms"))


@query("i03_skip_invalid", with_ctes(RECORDS, select=f"SELECT len(bad) = 0 AS valid, count(*) AS n FROM ({_BAD}) GROUP BY 1"))
def i03(spark, sf_dir) -> DataFrame:
    return ingest.admission_counts(ingest.validated(json_lines(spark, sf_dir)))


def _snapshots(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("record_key"), "source", "lang")
    start = F.lit("2024-01-01").cast("timestamp")
    current = d.where("record_key % 10 <> 0").select("*", start.alias("created_at"), start.alias("updated_at"), (F.col("record_key") % 3 != 0).alias("is_active"))
    batch = d.where("record_key % 10 <> 1").withColumn("batch_index", F.lit(1)).union(d.where("record_key % 10 = 2").withColumn("source", F.lit("moved")).withColumn("batch_index", F.lit(2)))
    return current, batch


@query("i04_upsert", """SELECT doc_id AS record_key, CASE WHEN doc_id % 10 = 2 THEN 'moved' ELSE source END AS source, lang, CAST(CASE WHEN doc_id % 10 = 0 THEN DATE '2024-03-01' ELSE DATE '2024-01-01' END AS VARCHAR) AS created,
  CAST(CASE WHEN doc_id % 10 <> 1 THEN DATE '2024-03-01' ELSE DATE '2024-01-01' END AS VARCHAR) AS updated, doc_id % 10 <> 1 OR doc_id % 3 <> 0 AS is_active,
  CASE WHEN doc_id % 10 = 0 THEN 'created' WHEN doc_id % 10 <> 1 THEN 'updated' ELSE 'kept' END AS change FROM documents""")  # fmt: skip
def i04(spark, sf_dir) -> DataFrame:
    out = ingest.upserted(*_snapshots(spark, sf_dir), F.expr(NOW))
    day = lambda c, name: F.to_date(c).cast("string").alias(name)
    return out.select("record_key", "source", "lang", day("created_at", "created"), day("updated_at", "updated"), "is_active", "change")


@query("i04_upsert_counts", "SELECT count(*) FILTER (doc_id % 10 = 0) AS created, count(*) FILTER (doc_id % 10 NOT IN (0, 1)) + count(*) FILTER (doc_id % 10 = 2) AS updated FROM documents")
def i04c(spark, sf_dir) -> DataFrame:
    return ingest.upsert_counts(*_snapshots(spark, sf_dir))


@query("i05_row_encoding", with_ctes(RECORDS, select="""SELECT record_id, CASE WHEN tags IS NOT NULL THEN concat('["', tags[1], '","', tags[2], '"]') END AS tags_json, concat('{"k":', json_extract(metadata, '$.k'), '}') AS metadata_json FROM records"""))
def i05(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).select("record_id", ingest.encoded_row(F.col("tags"), F.col("metadata")).alias("e")).select("record_id", "e.*")


@query("s01_json_source", with_ctes(RECORDS, select=f"SELECT count(*) FILTER (len(bad) = 0) AS valid, count(*) FILTER (len(bad) > 0) AS rejected FROM ({_BAD})"))
def s01(spark, sf_dir) -> DataFrame:
    path = fresh_path(spark, "lines")
    json_lines(spark, sf_dir).select("value").write.text(path)
    rows = ingest.validated(ingest.read_lines(spark, path))
    return rows.agg(F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("rejected"))




@query("x01_rendered_fields", with_ctes(RECORDS, select="SELECT record_id, concat_ws(chr(10), concat('source: ', source_name), CASE WHEN sentiment <> '' THEN concat('sentiment: ', sentiment) END, CASE WHEN len(tags) > 0 THEN concat('tags: ', array_to_string(tags, ', ')) END) AS text FROM records"))
def x01(spark, sf_dir) -> DataFrame:
    fields = {"source": F.col("source_name"), "sentiment": F.col("sentiment"), "tags": tx.joined(F.col("tags"))}
    return records(spark, sf_dir).select("record_id", tx.rendered_fields(fields).alias("text"))


@query("x02_rendered_template", with_ctes(RECORDS, select="SELECT record_id, concat(source_type, ' :: ', ' :: ', coalesce(sentiment, '')) AS text FROM records"))
def x02(spark, sf_dir) -> DataFrame:
    fields = {"kind": F.col("source_type"), "mood": F.col("sentiment")}
    return records(spark, sf_dir).select("record_id", tx.rendered_template("{kind} :: {missing} :: {mood}", fields).alias("text"))


@query("x03_first_tokens", r"SELECT doc_id, CASE WHEN len(t) > 20 THEN array_to_string(t[1:20], ' ') ELSE text END AS text, CAST(len(t) AS BIGINT) AS tokens FROM (SELECT doc_id, text, regexp_split_to_array(trim(text), '[ \t\n\r]+') AS t FROM documents)")
def x03(spark, sf_dir) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", tx.first_tokens(F.col("text"), 20).alias("text"), tx.token_count(F.col("text")).cast("long").alias("tokens"))


@query("x04_content_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def x04(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.content_hash(F.col("text")).alias("text_hash"))


@query("x05_ellipsis", "SELECT doc_id, CASE WHEN length(text) > 120 THEN concat(substring(text, 1, 117), '...') ELSE text END AS text FROM documents")
def x05(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.ellipsis(F.col("text"), 120).alias("text"))


@query("x10_label_tokens", with_ctes(LABELS_ALL, select="SELECT id, array_to_string(regexp_extract_all(lower(label), '[a-z0-9]+'), ' ') AS norm FROM labels_all"))
def x10(spark, sf_dir) -> DataFrame:
    return some_labels(spark, sf_dir).select("id", tx.normalised_label(F.col("label")).alias("norm"))


@query("x11_overlap", "SELECT event_id, round(len(list_intersect(a, b)) * 1.0 / least(len(a), len(b)), 6) AS overlap FROM (SELECT event_id, list_distinct(regexp_extract_all(lower(event_type || ' by ' || user_id), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all('view by ' || event_id % 7 || ' again', '[a-z0-9]+')) AS b FROM events)")
def x11(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    a = tx.label_tokens(F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")))
    b = tx.label_tokens(F.concat(F.lit("view by "), (F.col("event_id") % 7).cast("string"), F.lit(" again")))
    return e.select("event_id", F.round(tx.overlap(a, b), 6).alias("overlap"))


@query("x12_label_flags", """SELECT c_custkey AS id, len(t) < 3 AS short, len(list_filter(t, lambda x: x NOT IN ('customer', 'customers', 'feedback', 'general', 'issue', 'issues', 'misc', 'miscellaneous', 'other', 'request', 'requests', 'support', 'topic', 'topics'))) = 0 AS generic
FROM (SELECT c_custkey, regexp_extract_all(lower(CASE WHEN c_custkey % 4 = 0 THEN 'Customer issue' WHEN c_custkey % 4 = 1 THEN '---' ELSE c_name || ' ' || c_mktsegment || ' topic' END), '[a-z0-9]+') AS t FROM customer)""")  # fmt: skip
def x12(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey") % 4
    label = F.when(k == 0, "Customer issue").when(k == 1, "---").otherwise(F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" topic")))
    return c.select(F.col("c_custkey").alias("id"), tx.label_flags(label).alias("f")).select("id", "f.*")


@query("x13_labelled_lines", with_ctes(RECORDS, select="SELECT record_id, concat('Issue: ', source_type, chr(10), 'Sentiment: ', coalesce(sentiment, '(none)')) AS text FROM records"))
def x13(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).select("record_id", tx.labelled_lines({"Issue": F.col("source_type"), "Sentiment": F.col("sentiment")}).alias("text"))


@query("x15_representative_blocks", with_ctes(BASE, BEST, select="SELECT b.cluster_id, rank, concat('Record ', rank, chr(10), 'Source: ', source_name, chr(10), CASE WHEN product IS NOT NULL THEN concat('Title: ', product, chr(10)) ELSE '' END, 'Text: ', CASE WHEN length(customer_text) > 80 THEN concat(substring(customer_text, 1, 77), '...') ELSE customer_text END) AS block FROM best b JOIN records r ON r.record_id = b.record_id WHERE rank <= 3"))
def x15(spark, sf_dir) -> DataFrame:
    rows = tp.representatives(members(spark, sf_dir), 3).join(records(spark, sf_dir).select("record_id", "source_name", "product", "customer_text"), "record_id")
    return rows.select("cluster_id", "rank", providers.representative_block(F.col("rank"), F.col("source_name"), F.col("product"), F.col("customer_text"), 80).alias("block"))


@query("x16_utf16_slice", "SELECT doc_id, CASE WHEN length(text) >= 25 THEN substring(text, 6, 20) END AS text, CASE WHEN length(text) < 25 THEN 'out of range' END AS error FROM documents")
def x16(spark, sf_dir) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", tx.utf16_slice(F.col("text"), F.lit(5), F.lit(20)).alias("s")).select("doc_id", "s.*")


@query("x17_identity_hash", """SELECT doc_id, sha256(concat('["chunk","', source, '","', doc_id, '"]')) AS id FROM documents""")
def x17(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", tx.identity_hash(F.lit("chunk"), F.col("source"), F.col("doc_id")).alias("id"))


@query("x18_canonical_hash", """SELECT event_id, sha256(concat('{"sentiment":', CASE event_id % 4 WHEN 0 THEN '"positive"' WHEN 1 THEN '"neutral"' WHEN 2 THEN '"negative"' ELSE 'null' END, ',"type":"', event_type, '","user":', user_id, '}')) AS version FROM events""")
def x18(spark, sf_dir) -> DataFrame:
    fields = {"user": F.col("user_id"), "type": F.col("source_type"), "sentiment": F.col("sentiment")}
    return records(spark, sf_dir).select("event_id", tx.canonical_hash(fields).alias("version"))


_KINDS = ["null", '""', '"text"', "true", "12", '{"b":1,"a":"x"}', "[1,2]"]


@query("x19_json_text", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN '(none)' WHEN 1 THEN '(none)' WHEN 2 THEN 'text' WHEN 3 THEN 'true' WHEN 4 THEN '12' WHEN 5 THEN '{\"a\":\"x\",\"b\":1}' ELSE '[1,2]' END AS value FROM events")
def x19(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 7).cast("int"))
    variant = F.try_parse_json(value)
    return e.select("event_id", F.when(F.schema_of_variant(variant) == "VOID", "(none)").otherwise(tp.json_text(variant)).alias("value"))


@query("x20_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def x20(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").alias("k"))


def _cache(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


VECTORS = "model string, dims int, text_hash string, vector array<float>"


@query("e01_embed_reuse", "SELECT count(*) AS records, count(DISTINCT text) AS misses, 0 AS misses_again FROM documents")
def e01(spark, sf_dir) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("record_id"), "text")
    items, fresh = providers.embedded(d, F.col("text"), _cache(spark, VECTORS), scripted.SeededEmbedder())
    _, again = providers.embedded(d, F.col("text"), fresh, scripted.SeededEmbedder())
    one = items.agg(F.count(F.lit(1)).alias("records"))
    return one.crossJoin(fresh.agg(F.count(F.lit(1)).alias("misses"))).crossJoin(again.agg(F.count(F.lit(1)).cast("int").alias("misses_again")))


_AXIS = " + ".join(f"{16**i} * (instr('0123456789abcdef', substr(h, {3 - i}, 1)) - 1)" for i in range(3))
HASHED = f"""w AS (SELECT doc_id, md5(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS h FROM documents),
s AS (SELECT doc_id, ({_AXIS}) % 16 AS axis, sum(CASE WHEN instr('0123456789abcdef', substr(h, 4, 1)) <= 8 THEN 1 ELSE -1 END) AS v FROM w GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY 1)"""


@query("e02_hashed_vectors", with_ctes(HASHED, select="SELECT s.doc_id, CAST(axis AS BIGINT) AS axis, round(v / norm, 6) AS value FROM s JOIN n ON n.doc_id = s.doc_id WHERE v <> 0"))
def e02(spark, sf_dir) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    v = vx.hashed(d.select(F.col("doc_id").alias("id"), "text"), 16)
    rows = v.select(F.col("id").alias("doc_id"), F.posexplode("vector").alias("axis", "value")).where("value <> 0")
    return rows.select("doc_id", F.col("axis").cast("long").alias("axis"), F.round("value", 6).alias("value"))


@query("e03_summary_representation", with_ctes(RECORDS, SUMMARY, select="SELECT record_id, sha256(summary) AS text_hash FROM summary_of WHERE summary IS NOT NULL AND junk_type = 'none'"))
def e03(spark, sf_dir) -> DataFrame:
    from tessera.operators.scope import gated

    return gated(summary_of(spark, sf_dir)).select("record_id", tx.content_hash(F.col("summary")).alias("text_hash"))


@query("e04_summarize_reuse", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN contains(t, 'fail') THEN 'failed' WHEN p_partkey % 5 = 0 OR t IN (SELECT concat(p_type, CASE WHEN p_size % 9 = 0 THEN ' fail' ELSE '' END) FROM part WHERE p_partkey % 5 = 0) THEN 'reused' ELSE 'summarized' END AS status FROM (SELECT p_partkey, concat(p_type, CASE WHEN p_size % 9 = 0 THEN ' fail' ELSE '' END) AS t FROM part)) GROUP BY status")
def e04(spark, sf_dir) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat("p_type", F.when(F.col("p_size") % 9 == 0, " fail").otherwise(""))
    rows = p.select(F.col("p_partkey").alias("record_id"), text.alias("text"))
    cache = _cache(spark, "model string, prompt_hash string, text_hash string, issue string, junk_type string")
    _, fresh = providers.summarised(rows.where("record_id % 5 = 0"), F.col("text"), cache, scripted.KeywordSummariser(), "p1")
    items, _ = providers.summarised(rows, F.col("text"), fresh, scripted.KeywordSummariser(), "p1")
    return items.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("e05_summary_validation", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'unknown keys' WHEN 1 THEN 'issue must be a non-empty string' WHEN 2 THEN 'keyCustomerPhrases must have an entry' WHEN 3 THEN 'junkType is invalid' END AS error FROM events")
def e05(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 5
    value = F.concat(
        F.lit('{"issue":"'), F.when(k == 1, " ").otherwise(F.col("event_type")), F.lit('","product":null,"keyCustomerPhrases":'),
        F.when(k == 2, '[" "]').otherwise('["a b"]'), F.lit(',"junkType":"'), F.when(k == 3, "other").otherwise("none"), F.lit('"'), F.when(k == 0, ',"more":1').otherwise(""), F.lit("}"),
    )
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", value.alias("value"))
    return providers.checked_summaries(rows).select("event_id", "error")


@query("e06_label_targets", with_ctes(BASE, BEST, select="SELECT cluster_id, string_agg(b.record_id || '=' || customer_text, '|' ORDER BY rank) AS texts FROM best b JOIN records r ON r.record_id = b.record_id WHERE rank <= 5 GROUP BY cluster_id"))
def e06(spark, sf_dir) -> DataFrame:
    r = records(spark, sf_dir).withColumn("customer_text", F.concat("record_id", F.lit("="), "customer_text"))
    return providers.label_targets(tp.representatives(members(spark, sf_dir), 20), r, None, 5).select("cluster_id", F.array_join("texts", "|").alias("texts"))


@query("e07_label_source", with_ctes(BASE, BEST, SUMMARY, select="SELECT b.cluster_id, string_agg(coalesce(summary, customer_text), '|' ORDER BY rank) AS texts, count(*) FILTER (summary IS NULL) AS fallbacks FROM best b JOIN records r ON r.record_id = b.record_id JOIN summary_of s ON s.record_id = b.record_id WHERE rank <= 5 GROUP BY b.cluster_id"))
def e07(spark, sf_dir) -> DataFrame:
    out = providers.label_targets(tp.representatives(members(spark, sf_dir), 20), records(spark, sf_dir), summary_of(spark, sf_dir).select("record_id", "summary"), 5)
    return out.select("cluster_id", F.array_join("texts", "|").alias("texts"), "fallbacks")


@query("e08_label_run", with_ctes(BASE, BEST, """t AS (SELECT b.cluster_id, customer_text FROM best b JOIN records r ON r.record_id = b.record_id WHERE rank <= 5),
w AS (SELECT cluster_id, unnest(regexp_split_to_array(lower(customer_text), '\\s+')) AS w FROM t), c AS (SELECT cluster_id, w, count(*) AS n FROM w WHERE length(w) > 4 GROUP BY 1, 2),
top AS (SELECT cluster_id, arg_min(w, (-n, w)) AS w FROM c GROUP BY 1), f AS (SELECT cluster_id, bool_or(customer_text = 'signup') AS failed FROM t GROUP BY 1)""",
    select="SELECT f.cluster_id, CASE WHEN NOT failed THEN concat('about ', coalesce(w, 'empty'), ' texts') END AS label, CASE WHEN NOT failed THEN w IS NOT NULL END AS coherent, CASE WHEN failed THEN 'scripted failure' END AS error FROM f LEFT JOIN top ON top.cluster_id = f.cluster_id"))
def e08(spark, sf_dir) -> DataFrame:
    """A topic among whose texts is a bare ``signup`` fails, and only that topic; the others' labels are appended, beside those of a run before."""
    targets = providers.label_targets(tp.representatives(members(spark, sf_dir), 20), records(spark, sf_dir), None, 5)
    path = fresh_path(spark, "labels")
    providers.label_run(targets.where("cluster_id < 2"), scripted.KeywordLabeller(), path, "r1")
    items = providers.label_run(targets, scripted.KeywordLabeller("signup"), path, "r2")
    kept = spark.read.parquet(path).where("run_id = 'r2'").select("cluster_id", "label", "coherent", F.lit(None).cast("string").alias("error"))
    return kept.union(items.where("error is not null").select("cluster_id", "label", "coherent", "error"))


@query("e09_label_validation", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'tags must be a list of strings' WHEN 1 THEN 'coherent must be true or false' WHEN 2 THEN 'label must be a non-empty string' END AS error FROM events")
def e09(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 4
    value = F.concat(
        F.lit('{"summary":"s","keySignals":[],"label":'), F.when(k == 2, "7").otherwise('"a label"'), F.lit(',"tags":'), F.when(k == 0, '"t"').otherwise('["t"]'), F.lit(',"coherent":'), F.when(k == 1, "1").otherwise("true"), F.lit("}"),
    )
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", value.alias("value"))
    return providers.checked_labels(rows).select("event_id", "error")


@query("e10_label_report", with_ctes(BASE, BEST, SUMMARY, select="""SELECT cluster_id, rank, record_id, sha256(concat('Record ', rank, chr(10), 'Source: ', source_name, chr(10), CASE WHEN product IS NOT NULL THEN concat('Title: ', product, chr(10)) ELSE '' END,
  'Text: ', CASE WHEN length(t) > 500 THEN concat(substring(t, 1, 497), '...') ELSE t END)) AS block_hash, length(t) > 500 AS truncated, summary IS NOT NULL AS from_summary, sha256('Name the topic.') AS prompt_hash
FROM (SELECT b.cluster_id, rank, b.record_id, source_name, product, coalesce(summary, customer_text) AS t, summary FROM best b JOIN records r ON r.record_id = b.record_id JOIN summary_of s ON s.record_id = b.record_id WHERE rank <= 10)"""))  # fmt: skip
def e10(spark, sf_dir) -> DataFrame:
    best = tp.representatives(members(spark, sf_dir), 20)
    report = providers.label_report(best, records(spark, sf_dir), summary_of(spark, sf_dir).select("record_id", "summary"), "Name the topic.")
    return report.select("cluster_id", "rank", "record_id", F.sha2("block", 256).alias("block_hash"), "truncated", "from_summary", "prompt_hash")


@query("e12_summary_report", with_ctes(RECORDS, SUMMARY, select="SELECT record_id, status, CASE WHEN status = 'summarized' THEN junk_type END AS junk_type, CASE WHEN status = 'summarized' THEN summary END AS summary FROM summary_of WHERE status IS NOT NULL"))
def e12(spark, sf_dir) -> DataFrame:
    s = summary_of(spark, sf_dir)
    made = s.where("summary is not null").select("record_id", "junk_type", "summary", F.lit("summarized").alias("status"))
    return s.where("status is not null").select("record_id", "status").join(made, ["record_id", "status"], "left").select("record_id", "status", "junk_type", "summary")


@query("e13_keyword_rules", with_ctes(RECORDS, select="SELECT record_id, CASE WHEN contains(lower(customer_text), 'license') THEN 'license' WHEN contains(lower(customer_text), 'error') THEN 'error' ELSE 'none' END AS label FROM records"))
def e13(spark, sf_dir) -> DataFrame:
    low = F.lower("customer_text")
    return records(spark, sf_dir).select("record_id", F.when(F.contains(low, F.lit("license")), "license").when(F.contains(low, F.lit("error")), "error").otherwise("none").alias("label"))


@query("a09_token_usage", with_ctes(BASE, BEST, select="SELECT CAST(sum(n) AS BIGINT) AS prompt, 3 * count(*) AS completion, CAST(sum(n) AS BIGINT) + 3 * count(*) AS total, count(*) AS calls FROM (SELECT b.cluster_id, sum(length(customer_text)) AS n, bool_or(customer_text = 'signup') AS failed FROM best b JOIN records r ON r.record_id = b.record_id WHERE rank <= 5 GROUP BY 1) WHERE NOT failed"))
def a09(spark, sf_dir) -> DataFrame:
    """What the calls of a label run report; a call that fails reports nothing."""
    targets = providers.label_targets(tp.representatives(members(spark, sf_dir), 20), records(spark, sf_dir), None, 5)
    return providers.token_usage(providers.labelled(targets, scripted.KeywordLabeller("signup")))


# the ledger: a run for each order, chained by keys

RUNS = """runs AS (
  SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'embed' WHEN 1 THEN 'cluster' ELSE 'trend' END AS type, CASE WHEN o_custkey % 4 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
         o_custkey % 20 AS view_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(o_orderdate AS TIMESTAMP) + to_days(CAST(o_custkey % 3 AS INT)) AS completed_at,
         CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey - 1 END AS input_run FROM orders)"""


def runs(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 3
    day = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(k == 0, "embed").when(k == 1, "cluster").otherwise("trend").alias("type"),
        F.when(F.col("o_custkey") % 4 == 0, "failed").otherwise("succeeded").alias("status"),
        (F.col("o_custkey") % 20).alias("view_id"),
        day.alias("created_at"),
        (day + F.expr("make_dt_interval(cast(o_custkey % 3 as int))")).alias("completed_at"),
        F.to_json(F.struct(F.when(k > 0, F.col("o_orderkey") - 1).alias("run_id"))).alias("input_refs"),
    )


@query("f13_run_list", with_ctes(RUNS, select="SELECT id FROM runs WHERE type = 'cluster' AND status = 'succeeded' ORDER BY created_at, id"))
def f13(spark, sf_dir) -> DataFrame:
    return ledger.listed(runs(spark, sf_dir), "cluster", "succeeded").select("id")


@query("r02_latest_run", with_ctes(RUNS, select="SELECT view_id, type, id FROM (SELECT *, row_number() OVER (PARTITION BY view_id, type ORDER BY completed_at DESC, created_at DESC, id DESC) AS rn FROM runs WHERE status = 'succeeded') WHERE rn = 1"))
def r02(spark, sf_dir) -> DataFrame:
    return ledger.latest(runs(spark, sf_dir)).select("view_id", "type", "id")


RUNS4 = """runs4 AS (
  SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'embed' WHEN 1 THEN 'cluster' WHEN 2 THEN 'trend' ELSE 'label' END AS type, CASE WHEN o_custkey % 4 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
         o_orderkey // 4 % 50 AS view_id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 3 THEN o_orderkey - 2 ELSE o_orderkey - 1 END AS input_run, CASE WHEN o_orderkey % 4 = 2 AND o_custkey % 3 > 0 THEN o_custkey % 3 END AS version FROM orders)"""


def runs4(spark, sf_dir) -> DataFrame:
    """A run for each order, four of which make a chain in one view; the greater id is the later run."""
    k, at = F.col("o_orderkey") % 4, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("o_orderkey") * 60)
    input_run = F.when(k == 3, F.col("o_orderkey") - 2).when(k > 0, F.col("o_orderkey") - 1)
    version = F.when((k == 2) & (F.col("o_custkey") % 3 > 0), F.col("o_custkey") % 3)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("id"), F.when(k == 0, "embed").when(k == 1, "cluster").when(k == 2, "trend").otherwise("label").alias("type"), F.when(F.col("o_custkey") % 4 == 0, "failed").otherwise("succeeded").alias("status"),
        (F.floor(F.col("o_orderkey") / 4) % 50).alias("view_id"), at.alias("created_at"), at.alias("completed_at"), F.to_json(F.struct(input_run.alias("run_id"))).alias("input_refs"), F.to_json(F.struct(version.alias("mathVersion"))).alias("stats"),
    )


@query("l01_append_run", with_ctes(BASE, select="""SELECT 1 AS id, 'cluster' AS type, 'succeeded' AS status, '{"k": 15}' AS params, '{"run_id": 0}' AS input_refs, concat('members.noise=', count(*) FILTER (is_noise), ',members.rows=', count(*), ',topics.rows=', count(DISTINCT CASE WHEN NOT is_noise THEN cluster_id END)) AS stats, 'read,write' AS phases, NULL AS error FROM members
UNION ALL SELECT 2, 'layout', 'failed', '{}', '{}', '', 'write', 'no place to write to'"""))  # fmt: skip
def l01(spark, sf_dir) -> DataFrame:
    """A run that writes members and topics, whose rows are counted on the way, and one that fails."""
    path, out = fresh_path(spark, "ledger"), fresh_path(spark, "run")
    with ledger.Recorder(spark, path, 1, 7, "cluster", {"k": 15}, {"run_id": 0}) as run:
        with run.phase("read"):
            m = members(spark, sf_dir)
        with run.phase("write"):
            run.watched(m, "members", noise=F.count_if("is_noise")).write.parquet(f"{out}/members")
            run.watched(spark.read.parquet(f"{out}/members").where("not is_noise").groupBy("cluster_id").count(), "topics").write.parquet(f"{out}/topics")
    try:
        with ledger.Recorder(spark, path, 2, 7, "layout") as run, run.phase("write"):
            run.watched(spark.range(3), "places")
            raise OSError("no place to write to")
    except OSError:
        pass
    pairs = F.array_sort(F.transform(F.map_entries("stats"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    timed = F.aggregate(F.map_values("phases"), F.lit(True), lambda ok, s: ok & (s >= 0))
    rows = spark.read.schema(ledger.RUN).parquet(path).where(timed & (F.col("completed_at") >= F.col("created_at")))
    return rows.select(F.col("id").cast("int").alias("id"), "type", "status", "params", "input_refs", F.array_join(pairs, ",").alias("stats"), F.array_join(F.array_sort(F.map_keys("phases")), ",").alias("phases"), "error")


@query("l02_resolve_run", with_ctes(RUNS, select="SELECT v.view_id, v.wanted AS run_id, r.id IS NOT NULL AS usable FROM (SELECT view_id, max(id) AS wanted FROM runs GROUP BY view_id) v LEFT JOIN runs r ON r.id = v.wanted AND r.view_id = v.view_id AND r.status = 'succeeded' AND r.type = 'cluster'"))
def l02(spark, sf_dir) -> DataFrame:
    r = runs(spark, sf_dir)
    views = r.groupBy("view_id").agg(F.max("id").alias("default_run"))
    return ledger.resolved(views.withColumn("requested_run", F.lit(None).cast("long")), r, "cluster")


@query("l03_lineage", with_ctes(RUNS, select="SELECT c.id AS run_id, e.id AS input_id, e.type AS input_type FROM runs c JOIN runs e ON e.id = c.input_run"))
def l03(spark, sf_dir) -> DataFrame:
    return ledger.lineage(runs(spark, sf_dir))


@query("l04_matching_runs", with_ctes(RUNS, select="SELECT t.id AS run_id, t.input_run = l.id AS matches FROM runs t LEFT JOIN (SELECT view_id, id FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY completed_at DESC, created_at DESC, id DESC) AS rn FROM runs WHERE status = 'succeeded' AND type = 'cluster') WHERE rn = 1) l ON l.view_id = t.view_id WHERE t.type = 'trend'"))
def l04(spark, sf_dir) -> DataFrame:
    r = runs(spark, sf_dir)
    defaults = ledger.latest(r).where("type = 'cluster'").select("view_id", F.col("id").alias("default_run"))
    return ledger.matching(r.where("type = 'trend'"), defaults)


@query("l05_view_delete", with_ctes(BASE, RUNS, select="""SELECT 'run' AS part, id, NULL AS n FROM runs WHERE view_id <> 3
UNION ALL SELECT 'output', r.id, (SELECT count(*) FROM members WHERE cluster_id = r.view_id) FROM runs r WHERE view_id <> 3 AND id IN (SELECT max(id) FROM runs WHERE view_id IN (2, 3, 4) GROUP BY view_id)"""))
def l05(spark, sf_dir) -> DataFrame:
    """Three views' newest runs have an output; one view goes."""
    path, out = fresh_path(spark, "ledger"), fresh_path(spark, "outputs")
    rows = runs(spark, sf_dir)
    rows.write.parquet(path)
    newest = rows.where("view_id in (2, 3, 4)").groupBy("view_id").agg(F.max("id").alias("run_id"))
    written = members(spark, sf_dir).join(newest, F.col("cluster_id") == F.col("view_id")).select("record_id", "run_id")
    written.write.partitionBy("run_id").parquet(out)
    left = ledger.delete_view(spark, path, [out], 3)
    kept = spark.read.schema("record_id string, run_id long").parquet(out).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return left.select(F.lit("run").alias("part"), "id", F.lit(None).cast("long").alias("n")).union(kept.select(F.lit("output"), F.col("run_id"), "n"))


@query("l07_space_collection", "SELECT vec_id FROM embeddings e WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND lang <> 'en')")
def l07(spark, sf_dir) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    left = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang <> 'en'").select(F.col("doc_id").alias("vec_id"))
    return ledger.referenced(v, left, "vec_id").select("vec_id")


_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY id DESC) AS rn FROM runs4 WHERE status = 'succeeded' AND type = '{}') WHERE rn = 1"


@query("v11_health_warnings", with_ctes(RUNS4, select=f"""SELECT view_id, array_to_string(list_filter([CASE WHEN c IS NULL THEN 'no cluster run' END, CASE WHEN n IS NULL THEN 'no labels' END, CASE WHEN named <> c THEN 'label run is of another cluster run' END,
  CASE WHEN t IS NULL THEN 'no trend run' END, CASE WHEN ref <> c THEN 'trend run is of another cluster run' END, CASE WHEN t IS NOT NULL AND coalesce(version, 1) < 2 THEN 'trend run is of version 1, not 2' END], lambda x: x IS NOT NULL), ';') AS warnings FROM (
  SELECT v.view_id, c.id AS c, t.id AS t, t.input_run AS ref, t.version, n.id AS n, n.input_run AS named FROM (SELECT DISTINCT view_id FROM runs4) v
  LEFT JOIN ({_NEWEST.format('cluster')}) c ON c.view_id = v.view_id LEFT JOIN ({_NEWEST.format('trend')}) t ON t.view_id = v.view_id LEFT JOIN ({_NEWEST.format('label')}) n ON n.view_id = v.view_id)"""))  # fmt: skip
def v11(spark, sf_dir) -> DataFrame:
    return ledger.warnings(runs4(spark, sf_dir))
