"""Queries of scopes, projections, joins, aggregates, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import scope as sc
from tessera.operators import topics as tp
from tessera.plans.book import query
from tessera.plans.fixture import LABELS, RECORDS, labels_of, members, records, with_ctes
from tessera.plans.trends import BASE, LATEST, mixes

IDS = "record_id"


def _rec(where: str) -> str:
    return with_ctes(RECORDS, select=f"SELECT record_id FROM records WHERE {where}")


def _scoped(name: str, where: str, column) -> None:
    """A filter over the records that returns the ids that pass."""
    query(name, _rec(where))(lambda spark, sf_dir: records(spark, sf_dir).where(column()).select(IDS))


_scoped("f01_in_lists", "source_type IN ('click', 'error') AND product IN ('en', 'fr')", lambda: sc.one_of("source_type", ["click", "error"]) & sc.one_of("product", ["en", "fr"]))
_scoped("f01_empty_list", "false", lambda: sc.one_of("source_type", []))
_scoped("f02_ratings", "rating >= 5 AND rating <= 20.5", lambda: sc.rating_range(5, 20.5))
_scoped(
    "f03_time_range",
    "timestamp_ms >= epoch_ms(TIMESTAMP '2024-01-05 00:00:00') AND timestamp_ms <= epoch_ms(TIMESTAMP '2024-01-07 12:00:00')",
    lambda: sc.time_range(sc.millis("2024-01-05T00:00:00Z"), sc.millis("2024-01-07T12:00:00")),
)
_scoped("f04_tags_any", "list_has_any(coalesce(tags, []), ['u1', 'signup'])", lambda: sc.tags_any(["u1", "signup"]))
_scoped("f05_metadata_equals", "CAST(json_extract(metadata, '$.k') AS BIGINT) = 7", lambda: sc.metadata_equals("metadata", "k", 7))
_SCOPE = {
    "source_types": ["click", "view"],
    "ratings": {"min": 1.0, "max": None},
    "time_range": {"start": "2024-01-03T00:00:00Z", "end": None},
    "tags_any": ["u0", "u2"],
}
SCOPE_SQL = "is_active AND source_type IN ('click', 'view') AND rating >= 1 AND timestamp_ms >= epoch_ms(TIMESTAMP '2024-01-03') AND list_has_any(coalesce(tags, []), ['u0', 'u2'])"
_scoped("f06_scope", SCOPE_SQL, lambda: sc.predicate(_SCOPE))
_scoped(
    "f07_list_filters",
    "source_type = 'view' AND sentiment = 'neutral' AND timestamp_ms <= epoch_ms(TIMESTAMP '2024-01-20')",
    lambda: (F.col("source_type") == "view") & (F.col("sentiment") == "neutral") & sc.time_range(None, sc.millis("2024-01-20")),
)
_scoped("i06_point_lookup", "event_id = 42 OR record_id = '00000043'", lambda: (F.col("event_id") == 42) | (F.col("record_id") == "00000043"))


@query("f08_focus", with_ctes(BASE, select=f"SELECT record_id FROM records WHERE {SCOPE_SQL} AND record_id IN (SELECT record_id FROM members WHERE cluster_id = 5)"))
def f08(spark, sf_dir) -> DataFrame:
    return sc.focused(sc.scoped(records(spark, sf_dir), _SCOPE), members(spark, sf_dir), 5).select(IDS)


@query("f11_noise", with_ctes(BASE, select="SELECT record_id, cluster_id FROM members WHERE NOT (is_noise OR cluster_id = -1)"))
def f11(spark, sf_dir) -> DataFrame:
    return members(spark, sf_dir).where("not (is_noise or cluster_id = -1)").select(IDS, "cluster_id")


SUMMARY = """summary_of AS (
  SELECT record_id, source_type, CASE WHEN event_id % 7 <> 0 THEN concat('About ', source_type) END AS summary,
         CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ooo' WHEN 2 THEN 'newsletter' ELSE 'none' END AS junk_type,
         CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 7 <> 0 THEN 'summarized' END AS status FROM records)"""


def summary_of(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 7
    return records(spark, sf_dir).select(
        "record_id",
        "event_id",
        "source_type",
        F.when(k != 0, F.concat(F.lit("About "), "source_type")).alias("summary"),
        F.when(k == 1, "ooo").when(k == 2, "newsletter").when(k != 0, "none").alias("junk_type"),
        F.when(F.col("event_id") % 11 == 0, "failed").when(k != 0, "summarized").alias("status"),
    )


@query(
    "f10_junk_gate",
    with_ctes(RECORDS, SUMMARY, select="SELECT count(*) FILTER (summary IS NOT NULL AND junk_type = 'none') AS kept, count(*) FILTER (summary IS NULL) AS missing, count(*) FILTER (summary IS NOT NULL AND junk_type <> 'none') AS skipped FROM summary_of"),
)
def f10(spark, sf_dir) -> DataFrame:
    return sc.gate_report(summary_of(spark, sf_dir))


@query(
    "f12_explore",
    with_ctes(BASE, select="SELECT r.record_id FROM records r JOIN members m ON m.record_id = r.record_id WHERE cluster_id = 4 AND r.source_type = 'view' AND CAST(r.ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-25' AND contains(lower(concat_ws(' ', r.record_id, customer_text, r.source_type, product, sentiment)), 'neutral')"),
)
def f12(spark, sf_dir) -> DataFrame:
    keys = members(spark, sf_dir).where("cluster_id = 4").select(IDS)
    rows = records(spark, sf_dir).join(keys, IDS, "left_semi")
    rows = rows.where((F.col("source_type") == "view") & F.to_date("ts").between(F.lit("2024-01-02").cast("date"), F.lit("2024-01-25").cast("date")))
    return sc.searched(rows, "Neutral", ["record_id", "customer_text", "source_type", "product", "sentiment"]).select(IDS)


@query("p01_record_projection", with_ctes(RECORDS, select="SELECT record_id, source_type, source_name, product, rating, sentiment, array_to_string(tags, ', ') AS tags, CAST(json_extract(metadata, '$.k') AS BIGINT) AS k FROM records"))
def p01(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).select(
        IDS, "source_type", "source_name", "product", "rating", "sentiment", F.array_join("tags", ", ").alias("tags"), F.from_json("metadata", "k bigint")["k"].alias("k")
    )


@query("p02_topic_record_projection", with_ctes(BASE, select="SELECT r.record_id, r.source_type, r.source_name, customer_text, cluster_id, probability, outlier_score, is_noise FROM records r JOIN members m ON m.record_id = r.record_id"))
def p02(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir).select(IDS, "cluster_id", "probability", "outlier_score", "is_noise")
    return records(spark, sf_dir).join(m, IDS).select(IDS, "source_type", "source_name", "customer_text", "cluster_id", "probability", "outlier_score", "is_noise")


_SHORT = "CASE WHEN length(customer_text) > 300 THEN concat(substring(customer_text, 1, 297), '...') ELSE customer_text END"


@query("p03_map_rows", with_ctes(BASE, select=f"SELECT r.record_id, {_SHORT} AS text, round(rating / 7, 4) AS x, round(probability, 4) AS probability, round(outlier_score, 4) AS outlier_score FROM records r JOIN members m ON m.record_id = r.record_id"))
def p03(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir).select(IDS, "probability", "outlier_score")
    rows = records(spark, sf_dir).join(m, IDS)
    return rows.select(IDS, tp.shortened(F.col("customer_text")).alias("text"), F.round(F.col("rating") / 7, 4).alias("x"), F.round("probability", 4).alias("probability"), F.round("outlier_score", 4).alias("outlier_score"))


BEST = "best AS (SELECT cluster_id, record_id, row_number() OVER (PARTITION BY cluster_id ORDER BY probability DESC, record_id) AS rank FROM members WHERE NOT is_noise)"
SUMMARIES = """sums AS (
  SELECT cluster_id, count(*) AS size, avg(probability) AS mean_probability FROM members WHERE NOT is_noise GROUP BY cluster_id),
reps AS (SELECT cluster_id, string_agg(record_id, ',' ORDER BY rank) AS representatives FROM best WHERE rank <= 20 GROUP BY cluster_id)"""
MIX = """mixes AS (SELECT cluster_id, string_agg(concat(source_type, '=', n), ',' ORDER BY source_type) AS mix FROM (SELECT cluster_id, source_type, count(*) AS n FROM members WHERE NOT is_noise GROUP BY cluster_id, source_type) GROUP BY cluster_id)"""


def flat(summaries: DataFrame) -> DataFrame:
    pairs = F.transform(F.map_entries("source_mix"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return summaries.select(
        "cluster_id", "size", F.round("mean_probability", 6).alias("mean_probability"), F.array_join(F.array_sort(pairs), ",").alias("mix"), F.array_join("representatives", ",").alias("representatives")
    )


@query(
    "p04_topic_projection",
    with_ctes(BASE, BEST, SUMMARIES, MIX, LABELS, LATEST, select="SELECT s.cluster_id, l.label, l.summary, size, round(mean_probability, 6) AS mean_probability, mix, representatives FROM sums s JOIN reps r ON r.cluster_id = s.cluster_id JOIN mixes m ON m.cluster_id = s.cluster_id LEFT JOIN latest l ON l.cluster_id = s.cluster_id"),
)
def p04(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir)
    labels = tp.latest_labels(labels_of(m)).select("cluster_id", "label", "summary")
    return flat(tp.summaries(m)).join(labels, "cluster_id", "left").select("cluster_id", "label", "summary", "size", "mean_probability", "mix", "representatives")


@query("a02_topic_summary", with_ctes(BASE, BEST, SUMMARIES, MIX, select="SELECT s.cluster_id, size, round(mean_probability, 6) AS mean_probability, mix, representatives FROM sums s JOIN reps r ON r.cluster_id = s.cluster_id JOIN mixes m ON m.cluster_id = s.cluster_id"))
def a02(spark, sf_dir) -> DataFrame:
    return flat(tp.summaries(members(spark, sf_dir)))


ITEMS = """items AS (SELECT record_id, event_id % 500 AS vec, CASE WHEN event_id % 9 = 0 THEN 'm2' ELSE 'm1' END AS model FROM records),
vectors AS (SELECT vec_id, 'm1' AS model, len(embedding) AS dims, embedding, label FROM embeddings WHERE vec_id % 6 <> 0)"""


def items(spark, sf_dir) -> DataFrame:
    model = F.when(F.col("event_id") % 9 == 0, "m2").otherwise("m1")
    return records(spark, sf_dir).select(IDS, "event_id", (F.col("event_id") % 500).alias("vec"), model.alias("model"))


def vectors(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 6 <> 0")
    return rows.select("vec_id", F.lit("m1").alias("model"), F.size("embedding").alias("dims"), "embedding", "label")


_ON = "v.vec_id = i.vec AND v.model = i.model"


@query("j01_items_vectors", with_ctes(RECORDS, ITEMS, select=f"SELECT record_id, vec_id, dims, label FROM items i JOIN vectors v ON {_ON}"))
def j01(spark, sf_dir) -> DataFrame:
    i, v = items(spark, sf_dir), vectors(spark, sf_dir)
    return i.join(v, (v["vec_id"] == i["vec"]) & (v["model"] == i["model"])).select(IDS, "vec_id", F.col("dims").cast("long").alias("dims"), "label")


@query("j01_missing_vectors", with_ctes(RECORDS, ITEMS, select=f"SELECT count(*) AS missing FROM items i WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE {_ON})"))
def j01m(spark, sf_dir) -> DataFrame:
    i, v = items(spark, sf_dir), vectors(spark, sf_dir)
    return i.join(v, (v["vec_id"] == i["vec"]) & (v["model"] == i["model"]), "left_anti").agg(F.count(F.lit(1)).alias("missing"))


@query("j02_members_records", with_ctes(BASE, select="SELECT cluster_id, r.sentiment, count(*) AS n FROM members m JOIN records r ON r.record_id = m.record_id GROUP BY ALL"))
def j02(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir).select(IDS, "cluster_id")
    return m.join(records(spark, sf_dir).select(IDS, "sentiment"), IDS).groupBy("cluster_id", "sentiment").agg(F.count(F.lit(1)).alias("n"))


LAYOUT = "layout AS (SELECT record_id, sin(event_id % 100) AS x, cos(event_id % 100) AS y FROM records WHERE event_id % 3 <> 0)"


@query("j03_layout_members_records", with_ctes(BASE, LAYOUT, select="SELECT r.record_id, round(x, 4) AS x, round(y, 4) AS y, cluster_id, r.source_type FROM layout l JOIN members m ON m.record_id = l.record_id JOIN records r ON r.record_id = l.record_id ORDER BY r.timestamp_ms, r.record_id"))
def j03(spark, sf_dir) -> DataFrame:
    r = records(spark, sf_dir)
    layout = r.where("event_id % 3 <> 0").select(IDS, F.sin(F.col("event_id") % 100).alias("x"), F.cos(F.col("event_id") % 100).alias("y"))
    rows = layout.join(members(spark, sf_dir).select(IDS, "cluster_id"), IDS).join(r.select(IDS, "timestamp_ms", "source_type"), IDS)
    return rows.orderBy("timestamp_ms", IDS).select(IDS, F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "cluster_id", "source_type")


@query("j04_records_summaries", with_ctes(RECORDS, SUMMARY, select="SELECT r.record_id, s.status, t.summary FROM records r LEFT JOIN (SELECT record_id, status FROM summary_of WHERE status IS NOT NULL) s ON s.record_id = r.record_id LEFT JOIN (SELECT record_id, summary FROM summary_of WHERE summary IS NOT NULL) t ON t.record_id = s.record_id AND s.status = 'summarized'"))
def j04(spark, sf_dir) -> DataFrame:
    s = summary_of(spark, sf_dir)
    status = s.where("status is not null").select(IDS, "status")
    made = s.where("summary is not null").select(IDS, "summary", F.lit("summarized").alias("status"))
    return records(spark, sf_dir).select(IDS).join(status, IDS, "left").join(made, [IDS, "status"], "left").select(IDS, "status", "summary")


@query("j06_cache_misses", with_ctes(RECORDS, select="SELECT DISTINCT sha256(customer_text) AS text_hash FROM records WHERE sha256(customer_text) NOT IN (SELECT sha256(customer_text) FROM records WHERE event_id % 3 = 0)"))
def j06(spark, sf_dir) -> DataFrame:
    hashes = records(spark, sf_dir).select("event_id", tx.content_hash(F.col("customer_text")).alias("text_hash"))
    cached = hashes.where("event_id % 3 = 0").select("text_hash").distinct()
    return hashes.select("text_hash").distinct().join(cached, "text_hash", "left_anti")


@query("j07_ordered_representatives", with_ctes(BASE, BEST, select="SELECT b.cluster_id, rank - 1 AS pos, b.record_id, r.source_type FROM best b JOIN records r ON r.record_id = b.record_id WHERE rank <= 20"))
def j07(spark, sf_dir) -> DataFrame:
    ids = tp.summaries(members(spark, sf_dir)).select("cluster_id", "representatives")
    return tp.ordered_records(ids, records(spark, sf_dir)).select("cluster_id", F.col("pos").cast("long").alias("pos"), IDS, "source_type")


LABELS_ALL = "labels_all AS (SELECT min(p_partkey) AS id, concat(p_type, CASE WHEN min(p_partkey) % 3 = 0 THEN ' shop' ELSE '' END) AS label FROM part GROUP BY p_type)"
TOKENS = LABELS_ALL + """,
tok AS (SELECT id, array_to_string(regexp_extract_all(lower(label), '[a-z0-9]+'), ' ') AS norm, list_sort(list_distinct(regexp_extract_all(lower(label), '[a-z0-9]+'))) AS toks, label FROM labels_all)"""


def some_labels(spark, sf_dir) -> DataFrame:
    """A topic for each type of part, labelled by it."""
    topics = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_type").agg(F.min("p_partkey").alias("id"))
    return topics.select("id", F.concat("p_type", F.when(F.col("id") % 3 == 0, " shop").otherwise("")).alias("label"))


def near_labels(labels: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs a < b whose token overlap is high and whose normalised labels differ; by shared tokens, not all pairs."""
    rows = labels.select("id", tx.normalised_label(F.col("label")).alias("norm"), F.array_distinct(tx.label_tokens(F.col("label"))).alias("toks"))
    rows = rows.withColumn("n", F.size("toks"))
    words = rows.select("id", "norm", "n", F.explode("toks").alias("tok"))
    other = words.select(F.col("id").alias("b"), F.col("norm").alias("norm_b"), F.col("n").alias("n_b"), "tok")
    shared = words.join(other, "tok").where("id < b and norm <> norm_b").groupBy("id", "b", "n", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    part = F.col("shared") / F.least("n", "n_b")
    return shared.where(part >= least).select(F.col("id").alias("a"), "b", F.round(part, 3).alias("overlap"))


_NEAR = "SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.toks, y.toks)) * 1.0 / least(len(x.toks), len(y.toks)), 3) AS overlap FROM tok x JOIN tok y ON x.id < y.id WHERE x.norm <> y.norm AND len(list_intersect(x.toks, y.toks)) * 1.0 / least(len(x.toks), len(y.toks)) >= {}"


@query("j08_near_labels", with_ctes(TOKENS, select=_NEAR.format(0.5)))
def j08(spark, sf_dir) -> DataFrame:
    return near_labels(some_labels(spark, sf_dir), 0.5)


@query("e11_label_quality", with_ctes(TOKENS, select=f"""SELECT 'near' AS finding, concat(a, '-', b) AS ids, CAST(overlap AS VARCHAR) AS detail FROM ({_NEAR.format(0.6)})
UNION ALL SELECT 'duplicate', string_agg(CAST(id AS VARCHAR), '-' ORDER BY id), norm FROM (SELECT id, split_part(norm, ' ', 3) AS norm FROM tok) GROUP BY norm HAVING count(*) > 1
UNION ALL SELECT 'very_short', CAST(id AS VARCHAR), label FROM tok WHERE len(regexp_extract_all(lower(label), '[a-z0-9]+')) < 3"""))  # fmt: skip
def e11(spark, sf_dir) -> DataFrame:
    labels = some_labels(spark, sf_dir)
    near = near_labels(labels, 0.6).select(F.lit("near").alias("finding"), F.concat_ws("-", "a", "b").alias("ids"), F.col("overlap").cast("string").alias("detail"))
    norm = F.split_part(tx.normalised_label(F.col("label")), F.lit(" "), F.lit(3))
    same = labels.groupBy(norm.alias("detail")).agg(F.array_sort(F.collect_list("id")).alias("g")).where(F.size("g") > 1)
    same = same.select(F.lit("duplicate"), F.array_join(F.transform("g", lambda x: x.cast("string")), "-"), "detail")
    short = labels.where(tx.label_flags(F.col("label"))["short"]).select(F.lit("very_short"), F.col("id").cast("string"), "label")
    return near.union(same).union(short)


@query("a01_record_counts", with_ctes(RECORDS, select=f"SELECT count(*) FILTER (is_active) AS active, count(*) FILTER ({SCOPE_SQL}) AS scoped FROM records"))
def a01(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir).agg(F.count_if("is_active").alias("active"), F.count_if(sc.predicate(_SCOPE)).alias("scoped"))


@query("a03_run_stats", with_ctes(BASE, select="""SELECT count(*) AS scoped_records, count(*) FILTER (e) AS population, count(*) FILTER (NOT e) AS missing_embeddings,
  count(DISTINCT CASE WHEN e AND NOT is_noise THEN cluster_id END) AS clusters, count(*) FILTER (e AND is_noise) AS noise, count(*) FILTER (e AND is_noise) * 1.0 / count(*) FILTER (e) AS noise_ratio
FROM (SELECT r.event_id % 8 <> 0 AS e, m.is_noise, m.cluster_id FROM records r JOIN members m ON m.record_id = r.record_id WHERE is_active)"""))  # fmt: skip
def a03(spark, sf_dir) -> DataFrame:
    r = records(spark, sf_dir)
    return tp.run_stats(sc.scoped(r, {}).select(IDS), members(spark, sf_dir), r.where("event_id % 8 <> 0"))


def _facet_sql(value: str, extra: str = "") -> str:
    return with_ctes(BASE, f"""v AS (SELECT cluster_id, coalesce(nullif({value}, ''), '(none)') AS value FROM members m JOIN (SELECT * FROM records{extra}) r ON r.record_id = m.record_id WHERE NOT m.is_noise),
c AS (SELECT cluster_id, value, count(*) AS count FROM v GROUP BY cluster_id, value),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, value) AS rn FROM c)""",
        select="SELECT cluster_id, value, count FROM k WHERE rn <= 20 UNION ALL SELECT cluster_id, '(other)', CAST(sum(count) AS BIGINT) FROM k WHERE rn > 20 GROUP BY cluster_id")


def _facet(name: str, facet: str, sql: str) -> None:
    query(name, sql)(lambda spark, sf_dir: tp.facets(members(spark, sf_dir), records(spark, sf_dir).drop("source_type", "source_name"), facet))


_facet("a04_facet_column", "product", _facet_sql("product"))
_facet("a04_facet_metadata", "metadata.k", _facet_sql("json_extract_string(metadata, '$.k')"))
_facet("u02_facets_and_other", "sentiment", _facet_sql("sentiment"))


@query("a04_facet_tags", with_ctes(BASE, """v AS (SELECT cluster_id, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['(none)'] END) AS value FROM members m JOIN records r ON r.record_id = m.record_id WHERE NOT m.is_noise)""", select="SELECT cluster_id, value, count(*) AS count FROM v GROUP BY cluster_id, value"))
def a04t(spark, sf_dir) -> DataFrame:
    return tp.facets(members(spark, sf_dir), records(spark, sf_dir).select(IDS, "tags"), "tags")


@query("a05_junk_counts", with_ctes(RECORDS, SUMMARY, select="SELECT junk_type, count(*) AS n FROM summary_of WHERE junk_type IS NOT NULL GROUP BY junk_type"))
def a05(spark, sf_dir) -> DataFrame:
    return summary_of(spark, sf_dir).where("junk_type is not null").groupBy("junk_type").agg(F.count(F.lit(1)).alias("n"))


@query("a06_embed_stats", with_ctes(RECORDS, select="""SELECT count(*) AS records, count(DISTINCT h) AS unique_texts, count(*) FILTER (c) AS reused_records, count(DISTINCT CASE WHEN NOT c THEN h END) AS to_embed
FROM (SELECT sha256(customer_text) AS h, sha256(customer_text) IN (SELECT sha256(customer_text) FROM records WHERE event_id % 3 = 0) AS c FROM records)"""))  # fmt: skip
def a06(spark, sf_dir) -> DataFrame:
    hashes = records(spark, sf_dir).select("event_id", tx.content_hash(F.col("customer_text")).alias("h"))
    cached = hashes.where("event_id % 3 = 0").select("h", F.lit(True).alias("c")).distinct()
    have = F.coalesce("c", F.lit(False))
    return hashes.join(cached, "h", "left").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("h").alias("unique_texts"), F.count_if(have).alias("reused_records"), F.countDistinct(F.when(~have, F.col("h"))).alias("to_embed")
    )


@query("a07_freshness", with_ctes(RECORDS, select="SELECT count(*) AS late FROM records WHERE is_active AND created_at > TIMESTAMP '2024-01-20 10:00:00'"))
def a07(spark, sf_dir) -> DataFrame:
    return sc.scoped(records(spark, sf_dir), {}).where("created_at > timestamp'2024-01-20 10:00:00'").agg(F.count(F.lit(1)).alias("late"))


@query("a08_fingerprint", with_ctes(BASE, LABELS, select="""SELECT sha256(concat('{"records":', n, ',"latest_ms":', t, ',"labels":', l, ',"run":"cluster-1"}')) AS fingerprint
FROM (SELECT count(*) AS n, max(epoch_us(ts) // 1000) AS t FROM members), (SELECT count(*) AS l FROM labels_of)"""))  # fmt: skip
def a08(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir)
    both = m.agg(F.count(F.lit(1)).alias("records"), F.max(F.unix_millis("ts")).alias("latest_ms")).crossJoin(labels_of(m).agg(F.count(F.lit(1)).alias("labels")))
    return both.select(F.sha2(F.to_json(F.struct("records", "latest_ms", "labels", F.lit("cluster-1").alias("run"))), 256).alias("fingerprint"))


@query("a13_majority_truth", with_ctes(BASE, select="SELECT cluster_id, truth, n FROM (SELECT cluster_id, r.source_name AS truth, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, r.source_name) AS rn FROM members m JOIN records r ON r.record_id = m.record_id WHERE NOT is_noise GROUP BY 1, 2) WHERE rn = 1"))
def a13(spark, sf_dir) -> DataFrame:
    counted = members(spark, sf_dir).where("not is_noise").groupBy("cluster_id", F.col("source_name").alias("truth")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "truth"))
    return counted.withColumn("_n", place).where("_n = 1").drop("_n")


@query("a15_extent", with_ctes(RECORDS, select="SELECT CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS lo, CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS hi, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS source_types FROM records"))
def a15(spark, sf_dir) -> DataFrame:
    day = F.to_date("ts")
    return records(spark, sf_dir).agg(F.min(day).cast("string").alias("lo"), F.max(day).cast("string").alias("hi"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"))


@query("a16_visible_counts", with_ctes(BASE, select="SELECT t.cluster_id, count(m.record_id) AS visible FROM (SELECT DISTINCT cluster_id FROM members WHERE NOT is_noise) t LEFT JOIN members m ON m.cluster_id = t.cluster_id AND m.source_type = 'purchase' AND m.ts < TIMESTAMP '2024-01-02' GROUP BY t.cluster_id"))
def a16(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir)
    return tp.visible_counts(m.where("not is_noise").select("cluster_id").distinct(), m.where("source_type = 'purchase' and ts < timestamp'2024-01-02'"))


@query("a17_compact_mix", with_ctes(BASE, select="""SELECT cluster_id, concat(string_agg(concat(source_type, ' ', format('{:,}', n)), ' · ' ORDER BY rn) FILTER (rn <= 2), CASE WHEN max(rn) > 2 THEN concat(' · +', max(rn) - 2, ' more') ELSE '' END) AS mix
FROM (SELECT cluster_id, source_type, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, source_type) AS rn FROM members WHERE NOT is_noise GROUP BY 1, 2) GROUP BY cluster_id"""))  # fmt: skip
def a17(spark, sf_dir) -> DataFrame:
    return tp.compact_mix(members(spark, sf_dir).where("not is_noise").groupBy("cluster_id", "source_type").count())


@query("r01_latest_labels", with_ctes(BASE, LABELS, LATEST, select="SELECT cluster_id, label_id, label FROM latest"))
def r01(spark, sf_dir) -> DataFrame:
    return tp.latest_labels(labels_of(members(spark, sf_dir))).select("cluster_id", "label_id", "label")


@query("r03_outliers", with_ctes(BASE, select="SELECT record_id, is_noise, outlier_score FROM members ORDER BY is_noise DESC, outlier_score DESC, record_id LIMIT 50"))
def r03(spark, sf_dir) -> DataFrame:
    return tp.outliers(members(spark, sf_dir)).select(IDS, "is_noise", "outlier_score")


@query("r04_topic_list", with_ctes(BASE, select="SELECT cluster_id, count(*) AS size FROM members WHERE NOT is_noise GROUP BY 1 ORDER BY size DESC, cluster_id"))
def r04(spark, sf_dir) -> DataFrame:
    return members(spark, sf_dir).where("not is_noise").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "cluster_id")


@query("r05_page", with_ctes(RECORDS, select="SELECT record_id, (SELECT count(*) FROM records WHERE is_active) AS total FROM records WHERE is_active ORDER BY timestamp_ms, record_id LIMIT 25 OFFSET 50"))
def r05(spark, sf_dir) -> DataFrame:
    rows = sc.scoped(records(spark, sf_dir), {})
    return tp.page(rows, 50, 25).select(IDS).crossJoin(rows.agg(F.count(F.lit(1)).alias("total")))


@query("r06_canonical_ids", with_ctes(BASE, select="SELECT record_id, CASE WHEN m.cluster_id = -1 THEN -1 ELSE rank END AS canonical_id FROM members m LEFT JOIN (SELECT cluster_id, row_number() OVER (ORDER BY min(record_id)) - 1 AS rank FROM members WHERE cluster_id <> -1 GROUP BY cluster_id) k ON k.cluster_id = m.cluster_id"))
def r06(spark, sf_dir) -> DataFrame:
    return tp.canonical_ids(members(spark, sf_dir)).select(IDS, F.col("canonical_id").cast("long").alias("canonical_id"))


@query("r07_topic_search", with_ctes(BASE, LABELS, LATEST, MIX, select="SELECT l.cluster_id, label FROM latest l JOIN mixes m ON m.cluster_id = l.cluster_id WHERE contains(lower(concat_ws(' ', label, summary, mix)), 'topic 1')"))
def r07(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir)
    return sc.searched(tp.latest_labels(labels_of(m)).join(mixes(m), "cluster_id"), "Topic 1", ["label", "summary", "mix"]).select("cluster_id", "label")


@query("r08_noise_sample")
def r08(spark, sf_dir) -> DataFrame:
    return tp.noise_sample(members(spark, sf_dir)).select(IDS)


@query("u03_centroid_members", with_ctes(BASE, BEST, select="""SELECT cluster_id, record_id FROM best WHERE rank <= 20 AND CAST(record_id AS INT) % 40 = 1
UNION ALL SELECT cluster_id, record_id FROM members m WHERE NOT is_noise AND NOT EXISTS (SELECT 1 FROM best b WHERE b.cluster_id = m.cluster_id AND rank <= 20 AND CAST(record_id AS INT) % 40 = 1)"""))  # fmt: skip
def u03(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir).where("not is_noise").select("cluster_id", IDS, "is_noise", "probability")
    have = tp.representatives(m, 20).where(F.col(IDS).cast("int") % 40 == 1).select("cluster_id", IDS)
    return have.union(m.select("cluster_id", IDS).join(have.select("cluster_id").distinct(), "cluster_id", "left_anti"))


@query("v14_topic_records", with_ctes(BASE, BEST, select="SELECT b.cluster_id, rank, b.record_id, source_type FROM best b JOIN records r ON r.record_id = b.record_id WHERE rank <= 12 AND b.cluster_id = 3"))
def v14(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir).where("cluster_id = 3")
    return tp.representatives(m, 12).join(records(spark, sf_dir).select(IDS, "source_type"), IDS).select("cluster_id", "rank", IDS, "source_type")


@query("v13_topics", with_ctes(BASE, LABELS, LATEST, MIX, select="SELECT s.cluster_id, size, label, mix FROM (SELECT cluster_id, count(*) AS size FROM members WHERE NOT is_noise GROUP BY 1) s LEFT JOIN latest l ON l.cluster_id = s.cluster_id JOIN mixes m ON m.cluster_id = s.cluster_id"))
def v13(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir)
    sizes = m.where("not is_noise").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    labels = tp.latest_labels(labels_of(m)).select("cluster_id", "label")
    return sizes.join(labels, "cluster_id", "left").join(mixes(m), "cluster_id").select("cluster_id", "size", "label", "mix")
