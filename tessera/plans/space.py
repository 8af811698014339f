"""Queries of vectors, clustering, layout and of evidence that rests on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as vx
from tessera.operators import chunks as ck
from tessera.operators import cluster as cl
from tessera.operators import evidence as ev
from tessera.operators import quality
from tessera.operators import snapshot as sn
from tessera.operators import topics as tp
from tessera.operators import trend
from tessera.operators.dendrogram import numbered
from tessera.plans.book import query
from tessera.plans.fixture import LABELS, labels_of, members, records, with_ctes
from tessera.plans.imports import population
from tessera.plans.intake import RUNS4, runs4
from tessera.plans.records import BEST, LAYOUT
from tessera.plans.trends import BASE, LATEST, MIX, points_sql
from tessera.session import fresh_path, stored, table
from tessera.sources import sinks

PLANTED = """raw AS (
  SELECT vec_id AS id, label, list_transform(range(1, 65), lambda i: 0.3 * CAST(embedding[i] AS DOUBLE) + CASE WHEN i - 1 = label THEN 1.0 ELSE 0.0 END) AS r FROM embeddings),
planted AS (SELECT id, label, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS v FROM raw)"""
NEAR = """near AS (
  SELECT id, neighbour, similarity, rank FROM (
    SELECT a.id, b.id AS neighbour, list_dot_product(a.v, b.v) AS similarity,
           row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.id) AS rank
    FROM planted a JOIN planted b ON a.id <> b.id) WHERE rank <= 15)"""
REACH = """core AS (SELECT id, greatest(max(CASE WHEN rank <= 5 THEN 1 - similarity END), 0) AS core FROM near GROUP BY id),
und AS (SELECT least(id, neighbour) AS a, greatest(id, neighbour) AS b, min(1 - similarity) AS d FROM near GROUP BY 1, 2),
reach AS (SELECT a, b, greatest(d, x.core, y.core) AS w FROM und JOIN core x ON x.id = a JOIN core y ON y.id = b)"""


def planted(spark, sf_dir) -> DataFrame:
    """id, label, vector: unit vectors around ten directions."""
    e = table(spark, sf_dir, "embeddings")
    one = F.transform(F.col("embedding"), lambda x, i: x.cast("double") * 0.3 + F.when(i == F.col("label"), 1.0).otherwise(0.0))
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), vx.normalised(one).alias("vector"))


def _near(spark, sf_dir) -> DataFrame:
    return stored(vx.exact_neighbours(planted(spark, sf_dir), 15), "near")


@query("x06_normalise", with_ctes(PLANTED, select="SELECT id, round(v[1], 6) AS x, round(list_dot_product(v, v), 6) AS norm FROM planted"))
def x06(spark, sf_dir) -> DataFrame:
    v = F.col("vector")
    return planted(spark, sf_dir).select("id", F.round(F.get(v, F.lit(0)), 6).alias("x"), F.round(vx.dot(v, v), 6).alias("norm"))


@query("x07_vector_bytes", "SELECT vec_id, len(embedding) * 4 AS bytes, true AS same FROM embeddings")
def x07(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("raw", sn.vector_bytes(F.col("embedding")))
    back = e.withColumn("back", sn.vector_values(F.col("raw")))
    return back.select("vec_id", F.octet_length("raw").cast("long").alias("bytes"), (F.to_json(F.struct(F.col("back").alias("v"))) == F.to_json(F.struct(F.col("embedding").alias("v")))).alias("same"))


@query("x08_dot", with_ctes(PLANTED, select="SELECT p.id, round(list_dot_product(p.v, q.v), 6) AS similarity FROM planted p, (SELECT v FROM planted WHERE id = 0) q"))
def x08(spark, sf_dir) -> DataFrame:
    p = planted(spark, sf_dir)
    q = p.where("id = 0").select(F.col("vector").alias("q"))  # the question: one row
    return p.crossJoin(F.broadcast(q)).select("id", F.round(vx.dot(F.col("vector"), F.col("q")), 6).alias("similarity"))


CENTROIDS = """sums AS (SELECT label, i, avg(v[i]) AS m FROM planted, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i),
flat AS (SELECT label, list(m ORDER BY i) AS m FROM sums GROUP BY label),
centroids AS (SELECT label AS cluster_id, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS c FROM flat)"""


@query("x09_centroids", with_ctes(PLANTED, CENTROIDS, select="SELECT cluster_id, round(c[1], 6) AS x, round(c[64], 6) AS y FROM centroids"))
def x09(spark, sf_dir) -> DataFrame:
    c = vx.means(planted(spark, sf_dir), "label", "vector")
    return c.select(F.col("label").alias("cluster_id"), F.round(F.get("centroid", F.lit(0)), 6).alias("x"), F.round(F.get("centroid", F.lit(63)), 6).alias("y"))


_SIM = "round(list_dot_product(c, q.v), 6) AS similarity"
SEARCH = f"question AS (SELECT v FROM planted WHERE id = 1),\nfound AS (SELECT cluster_id, {_SIM} FROM centroids, question q)"


def topic_search(spark, sf_dir, k: int = 5) -> DataFrame:
    p = planted(spark, sf_dir)
    question = p.where("id = 1").select(F.col("vector").alias("q"))  # one row
    found = vx.means(p, "label", "vector").crossJoin(question)
    near = found.select(F.col("label").alias("cluster_id"), F.round(vx.dot(F.col("centroid"), F.col("q")), 6).alias("similarity"))
    return near.orderBy(F.desc("similarity"), "cluster_id").limit(k)


query("j09_question_centroids", with_ctes(PLANTED, CENTROIDS, SEARCH, select="SELECT * FROM found"))(lambda spark, sf_dir: topic_search(spark, sf_dir, 1000))
query("x21_rounded_similarity", with_ctes(PLANTED, CENTROIDS, SEARCH, select="SELECT similarity FROM found"))(lambda spark, sf_dir: topic_search(spark, sf_dir, 1000).select("similarity"))
query("v06_topic_search", with_ctes(PLANTED, CENTROIDS, SEARCH, select="SELECT * FROM found ORDER BY similarity DESC, cluster_id LIMIT 5"))(topic_search)


PROVENANCE = """provenance AS (SELECT record_id, CASE WHEN event_id % 4 = 0 THEN 'i9' ELSE concat('i', event_id % 3) END AS import_id FROM records WHERE event_id % 5 <> 0)"""


def provenance(spark, sf_dir) -> DataFrame:
    """Records that came by an import: the selected one holds every fourth, the others were introduced by one of three."""
    r = records(spark, sf_dir).where("event_id % 5 <> 0").select("record_id", "event_id")
    versions = r.select("record_id", F.concat(F.lit("i"), (F.col("event_id") % 3).cast("string")).alias("introduced_by"))
    imports = spark.range(10).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("import_id"))
    items = r.where("event_id % 4 = 0").select(F.lit("i9").alias("import_id"), "record_id")
    return sn.provenance(r.select("record_id"), versions, imports, items, "i9")


FACETS = "facets AS (SELECT cluster_id, string_agg(concat(v, '=', n), ',' ORDER BY v) AS facets FROM (SELECT cluster_id, coalesce(sentiment, '(none)') AS v, count(*) AS n FROM members m JOIN records r ON r.record_id = m.record_id WHERE NOT is_noise GROUP BY 1, 2) GROUP BY cluster_id)"
TRENDS = """trends AS (SELECT p.cluster_id, string_agg(concat(CAST(p.bucket AS VARCHAR), '=', p.count), ',' ORDER BY p.bucket) AS series,
  max(CASE WHEN b.spike > 0 THEN CAST(b.bucket AS VARCHAR) END) AS spike_bucket, round(greatest(max(b.spike), 0), 6) AS spike
  FROM points p JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY spike DESC, count DESC, bucket DESC) AS rn FROM points) WHERE rn = 1) b ON b.cluster_id = p.cluster_id GROUP BY p.cluster_id)"""
TOLD = """told AS (SELECT b.cluster_id, string_agg(concat_ws(':', rank, b.record_id, r.source_name, coalesce(product, ''), sha256(customer_text), timestamp_ms, coalesce(import_id, '')), '|' ORDER BY rank) AS representatives
  FROM best b JOIN records r ON r.record_id = b.record_id LEFT JOIN provenance v ON v.record_id = b.record_id WHERE rank <= 10 GROUP BY b.cluster_id)"""
EVIDENCE = """evidence AS (SELECT s.cluster_id, label, l.summary AS label_summary, s.size, round(s.mean_probability, 6) AS mean_probability, mix, representatives, series, spike, spike_bucket, facets
  FROM (SELECT cluster_id, count(*) AS size, avg(probability) AS mean_probability FROM members WHERE NOT is_noise GROUP BY 1) s JOIN mixes m ON m.cluster_id = s.cluster_id JOIN told t ON t.cluster_id = s.cluster_id
  JOIN trends p ON p.cluster_id = s.cluster_id JOIN facets f ON f.cluster_id = s.cluster_id LEFT JOIN latest l ON l.cluster_id = s.cluster_id)"""
_EVIDENCE = (BASE, BEST, LABELS, LATEST, MIX, points_sql(), PROVENANCE, FACETS, TRENDS, TOLD, EVIDENCE)


def evidence(spark, sf_dir) -> DataFrame:
    """topic_evidence() with its lists as text."""
    m, r = members(spark, sf_dir), records(spark, sf_dir)
    facet = tp.facets(m, r.select("record_id", "sentiment"), "sentiment")
    rows = ev.topic_evidence(m, r, labels_of(m), trend.points(m, "day"), 10, provenance(spark, sf_dir), facet)
    pairs = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    line = lambda x: F.concat_ws(":", x["rank"].cast("string"), x["record_id"], x["source_name"], F.coalesce(x["title"], F.lit("")), F.sha2(x["text"], 256), F.unix_millis(x["ts"]).cast("string"), F.coalesce(x["import_id"], F.lit("")))
    step = lambda x: F.concat_ws("=", x["bucket"].cast("string"), x["count"].cast("string"))
    return rows.select(
        "cluster_id", "label", "label_summary", "size", F.round("mean_probability", 6).alias("mean_probability"), pairs("source_mix").alias("mix"), F.array_join(F.transform("representatives", line), "|").alias("representatives"),
        F.array_join(F.transform("series", step), ",").alias("series"), F.round("spike", 6).alias("spike"), F.col("spike_bucket").cast("string").alias("spike_bucket"), pairs("facets").alias("facets"),
    )


query("v05_topic_evidence", with_ctes(*_EVIDENCE, select="SELECT * FROM evidence"))(evidence)


@query("v07_question_evidence", with_ctes(*_EVIDENCE, PLANTED, CENTROIDS, SEARCH, select="""SELECT f.cluster_id, similarity, matched, label, size, representatives, series, spike, facets FROM (
  SELECT *, row_number() OVER (ORDER BY similarity DESC, cluster_id) = 1 AND similarity >= 0.2 AS matched FROM (SELECT * FROM found ORDER BY similarity DESC, cluster_id LIMIT 5)) f LEFT JOIN evidence e ON e.cluster_id = f.cluster_id AND matched"""))
def v07(spark, sf_dir) -> DataFrame:
    found = ev.question_evidence(topic_search(spark, sf_dir), evidence(spark, sf_dir))
    return found.select("cluster_id", "similarity", "matched", "label", "size", "representatives", "series", "spike", "facets")


_ROUND4 = "round(x, 4) AS x, round(y, 4) AS y, round(probability, 4) AS probability, round(outlier_score, 4) AS outlier_score"
ARTIFACT = """topics AS (SELECT s.cluster_id, label, s.size, s.mean_probability, mix, reps, CASE WHEN p.spike > 0 THEN CAST(p.bucket AS VARCHAR) END AS bucket, round(greatest(p.spike, 0), 6) AS spike
  FROM (SELECT cluster_id, count(*) AS size, round(avg(probability), 4) AS mean_probability FROM members WHERE NOT is_noise GROUP BY 1) s JOIN mixes m ON m.cluster_id = s.cluster_id
  JOIN (SELECT cluster_id, string_agg(record_id, ',' ORDER BY rank) AS reps FROM best WHERE rank <= 20 GROUP BY 1) b ON b.cluster_id = s.cluster_id LEFT JOIN latest l ON l.cluster_id = s.cluster_id
  JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY spike DESC, count DESC, bucket) AS rn FROM points) WHERE rn = 1) p ON p.cluster_id = s.cluster_id),
chosen AS (SELECT max(id) AS id FROM runs4 WHERE type = 'cluster' AND status = 'succeeded'),
refs AS (SELECT 'cluster_run' AS ref, id FROM chosen UNION ALL SELECT 'embed_run', input_run FROM runs4 WHERE id = (SELECT id FROM chosen) UNION ALL SELECT 'layout_run', NULL
  UNION ALL SELECT t || '_run', (SELECT max(id) FROM runs4 WHERE type = t AND status = 'succeeded' AND input_run = (SELECT id FROM chosen)) FROM (SELECT unnest(['trend', 'label']) AS t))"""
ARTIFACT_ROWS = f"""SELECT 'topic' AS part, CAST(cluster_id AS VARCHAR) AS id, cluster_id, label AS text, concat(mix, '|', reps) AS more, size, NULL AS x, NULL AS y, mean_probability AS probability, NULL AS outlier_score, NULL AS is_noise, bucket AS at, spike FROM topics
UNION ALL SELECT 'row', r.record_id, cluster_id, CASE WHEN length(customer_text) > 300 THEN concat(substring(customer_text, 1, 297), '...') ELSE customer_text END,
  concat_ws('|', r.source_type, r.source_name, coalesce(product, ''), coalesce(sentiment, ''), array_to_string(coalesce(tags, []), ','), timestamp_ms), NULL, {_ROUND4}, is_noise, import_id, NULL
  FROM layout l JOIN records r ON r.record_id = l.record_id JOIN members m ON m.record_id = l.record_id LEFT JOIN provenance v ON v.record_id = l.record_id
UNION ALL SELECT 'ref', ref, NULL, CAST(id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM refs
UNION ALL SELECT 'stat', 'noise', NULL, 'raw', NULL, count(*) FILTER (is_noise), NULL, NULL, round(count(*) FILTER (is_noise) * 1.0 / count(*), 4), NULL, NULL, NULL, NULL FROM members"""
_ARTIFACT = (BASE, BEST, LABELS, LATEST, MIX, points_sql(), PROVENANCE, LAYOUT, RUNS4, ARTIFACT)


def artifact(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics, rows and header of the artifact of the newest cluster run."""
    m, r, runs = members(spark, sf_dir), records(spark, sf_dir), runs4(spark, sf_dir)
    layout = r.where("event_id % 3 <> 0").select("record_id", F.sin(F.col("event_id") % 100).alias("x"), F.cos(F.col("event_id") % 100).alias("y"))
    newest = runs.where("type = 'cluster' and status = 'succeeded'").agg(F.max("id")).first()[0]
    return ev.artifact_topics(m, labels_of(m), trend.points(m, "day")), ev.artifact_rows(r, m, layout, provenance(spark, sf_dir)), ev.artifact_refs(runs, newest, m)


def _one_table(topics: DataFrame, rows: DataFrame, refs: DataFrame) -> DataFrame:
    """The three parts below each other, lists as text."""
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("source_mix"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    top = topics.select(
        F.lit("topic").alias("part"), F.col("cluster_id").cast("string").alias("id"), "cluster_id", F.col("label").alias("text"), F.concat(pairs, F.lit("|"), F.array_join("representatives", ",")).alias("more"), "size", no("double", "x"), no("double", "y"),
        F.round("mean_probability", 4).alias("probability"), no("double", "outlier_score"), no("boolean", "is_noise"), F.col("spike_bucket").cast("string").alias("at"), F.round("spike", 6).alias("spike"),
    )
    facts = [F.col("source_type"), F.col("source_name"), F.coalesce("product", F.lit("")), F.coalesce("sentiment", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ","), F.col("timestamp_ms").cast("string")]
    data = rows.select(F.lit("row"), "record_id", "cluster_id", "text", F.concat_ws("|", *facts), no("long", "size"), "x", "y", "probability", "outlier_score", "is_noise", "import_id", no("double", "spike"))
    names = ["cluster_run", "embed_run", "layout_run", "trend_run", "label_run"]
    blank = [no("string", "more"), no("long", "size"), *(no("double", c) for c in ("x", "y", "probability", "outlier_score")), no("boolean", "is_noise"), no("string", "at"), no("double", "spike")]
    each = refs.select(F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(n).cast("string").alias("v")) for n in names))).alias("r"))
    each = each.select(F.lit("ref"), "r.n", no("long", "cluster_id"), "r.v", *blank)
    stat = refs.select(F.lit("stat"), F.lit("noise"), no("long", "cluster_id"), "representation", no("string", "more"), "noise_count", no("double", "x"), no("double", "y"), F.round("noise_ratio", 4), *blank[5:])
    return top.union(data).union(each).union(stat)


@query("v12_artifact", with_ctes(*_ARTIFACT, select=ARTIFACT_ROWS))
def v12(spark, sf_dir) -> DataFrame:
    return _one_table(*artifact(spark, sf_dir))


@query("s08_artifact", with_ctes(*_ARTIFACT, select=ARTIFACT_ROWS))
def s08(spark, sf_dir) -> DataFrame:
    """Written as JSON, and read back."""
    path, parts = fresh_path(spark, "artifact"), artifact(spark, sf_dir)
    sinks.write_artifact(*parts, path)
    read = [spark.read.schema(x.schema).json(f"{path}/{name}") for name, x in zip(("topics", "data", "header"), parts, strict=True)]
    return _one_table(*read)


@query("j12_summary_facets", with_ctes(BASE, """s AS (SELECT record_id, concat('About ', source_type) AS issue FROM records WHERE event_id % 7 <> 0)""", select="SELECT cluster_id, coalesce(issue, '(none)') AS value, count(*) AS count FROM members m LEFT JOIN s ON s.record_id = m.record_id WHERE NOT is_noise GROUP BY ALL"))
def j12(spark, sf_dir) -> DataFrame:
    r = records(spark, sf_dir)
    issue = r.where("event_id % 7 <> 0").select("record_id", F.concat(F.lit("About "), "source_type").alias("issue"))
    return tp.facets(members(spark, sf_dir), r.select("record_id").join(issue, "record_id", "left"), "issue")


@query("c01_reduced")
def c01(spark, sf_dir) -> DataFrame:
    return vx.reduced(planted(spark, sf_dir), 10).select("id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("c02_exact_neighbours", with_ctes(PLANTED, NEAR, select="SELECT id, neighbour, round(similarity, 6) AS similarity, rank FROM near"))
def c02(spark, sf_dir) -> DataFrame:
    return vx.exact_neighbours(planted(spark, sf_dir), 15).select("id", "neighbour", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("c03_approximate_neighbours")
def c03(spark, sf_dir) -> DataFrame:
    return vx.approximate_neighbours(planted(spark, sf_dir), 15)


@query("c04_reachability", with_ctes(PLANTED, NEAR, REACH, select="SELECT a, b, round(w, 6) AS w FROM reach"))
def c04(spark, sf_dir) -> DataFrame:
    return cl.reachability(_near(spark, sf_dir), 5).select("a", "b", F.round("w", 6).alias("w"))


@query("c05_spanning_forest")
def c05(spark, sf_dir) -> DataFrame:
    return cl.spanning_forest(stored(cl.reachability(_near(spark, sf_dir), 5), "reach"))


@query("c06_flat_cut", "WITH RECURSIVE " + ",\n".join([PLANTED, NEAR, REACH, """e AS (SELECT a, b FROM reach WHERE w <= 0.075 UNION SELECT b, a FROM reach WHERE w <= 0.075),
r(id, p) AS (SELECT id, id FROM planted UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.p),
parts AS (SELECT id, min(p) AS part FROM r GROUP BY id), sizes AS (SELECT part, count(*) AS n FROM parts GROUP BY part)"""]) + "\nSELECT id, CASE WHEN n >= 5 THEN part ELSE -1 END AS cluster FROM parts JOIN sizes USING (part)")  # fmt: skip
def c06(spark, sf_dir) -> DataFrame:
    forest = stored(cl.spanning_forest(stored(cl.reachability(_near(spark, sf_dir), 5), "reach")), "forest")
    return cl.flat_cut(planted(spark, sf_dir).select("id"), forest, 0.075, 5).select("id", "cluster")


def topics_of(spark, sf_dir, **options) -> DataFrame:
    return cl.clustered(planted(spark, sf_dir), **options)


@query("c07_hierarchy")
def c07(spark, sf_dir) -> DataFrame:
    """Of vectors reduced first."""
    return topics_of(spark, sf_dir, dims=25).select("record_id", "cluster_id", "is_noise")


@query("c08_probabilities")
def c08(spark, sf_dir) -> DataFrame:
    return topics_of(spark, sf_dir, method="leaf").select("record_id", "cluster_id", F.round("probability", 6).alias("probability"))


@query("c09_outlier_scores")
def c09(spark, sf_dir) -> DataFrame:
    """Over approximate neighbours."""
    return topics_of(spark, sf_dir, search=vx.approximate_neighbours).select("record_id", F.round("outlier_score", 6).alias("outlier_score"), "is_noise")


def _labelled(spark, sf_dir) -> DataFrame:
    """Planted labels as members, with a made probability."""
    p = planted(spark, sf_dir)
    return p.select("id", F.col("label").alias("cluster_id"), (F.col("id") * 37 % 101 / 100).alias("probability"))


@query("c10_representatives", with_ctes(PLANTED, """m AS (SELECT *, label AS cluster_id, id * 37 % 101 / 100.0 AS probability FROM planted),
cand AS (SELECT m.* FROM m JOIN (SELECT cluster_id, max(probability) AS best FROM m GROUP BY 1) b ON b.cluster_id = m.cluster_id WHERE best < 0.7 OR probability >= 0.7),
av AS (SELECT cluster_id, i, avg(v[i]) AS x FROM cand, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
ce AS (SELECT cluster_id, list(x ORDER BY i) AS c FROM av GROUP BY 1)""", select="SELECT cluster_id, id, rank FROM (SELECT cand.cluster_id, id, row_number() OVER (PARTITION BY cand.cluster_id ORDER BY round(list_dot_product(v, c) / sqrt(list_dot_product(c, c)), 9) DESC, id) AS rank FROM cand JOIN ce ON ce.cluster_id = cand.cluster_id) WHERE rank <= 20"))  # fmt: skip
def c10(spark, sf_dir) -> DataFrame:
    return cl.central(_labelled(spark, sf_dir), planted(spark, sf_dir).select("id", "vector"))


@query("c12_focus_recluster")
def c12(spark, sf_dir) -> DataFrame:
    focus = planted(spark, sf_dir).join(_labelled(spark, sf_dir).where("cluster_id = 3").select("id"), "id", "left_semi")
    return cl.clustered(focus, min_cluster_size=5, min_samples=3).select("record_id", "cluster_id", F.lit(3).alias("parent_cluster"))


@query("c14_layout")
def c14(spark, sf_dir) -> DataFrame:
    return cl.layout(planted(spark, sf_dir), search=vx.approximate_neighbours).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("m06_chunk_analysis")
def m06(spark, sf_dir) -> DataFrame:
    """The population's distinct texts, their words as vectors, clustered and laid out; copies follow their canonical chunk."""
    rows = stored(ck.texts(population(spark, sf_dir)).where("chunk_len > 0").select("hash", "seq", "text", "fingerprint"), "chunks")
    copies = ck.duplicates(rows)
    first = (F.col("hash") == F.col("canonical_hash")) & (F.col("seq") == F.col("canonical_seq"))
    name = F.concat_ws("_", "canonical_hash", F.col("canonical_seq").cast("string")).alias("record_id")
    # a text has a number, in the order of names: millions of pairs are of numbers and not of names
    names = stored(numbered(copies.where(first).select("canonical_hash", "canonical_seq", name), ("record_id",), "id"), "chunk-names")
    own = rows.join(names.select(F.col("canonical_hash").alias("hash"), F.col("canonical_seq").alias("seq"), "id"), ["hash", "seq"])
    vectors = stored(vx.hashed(own, 32), "chunk-vectors")
    near = stored(vx.approximate_neighbours(vectors, 15), "near")  # for topics and places
    search = lambda rows, k: near.where(F.col("rank") <= k)
    found = stored(cl.clustered(vectors, search=search).withColumnRenamed("record_id", "id"), "topics")
    places = cl.layout(vectors, search=search)
    ranks = cl.central(found.select("id", "cluster_id", "probability"), vectors, 50).select("id", "rank")
    made = names.join(found, "id").join(ranks, "id", "left").join(places, "id")
    return copies.select("hash", "seq", "canonical_hash", "canonical_seq").join(made, ["canonical_hash", "canonical_seq"]).select("hash", "seq", "record_id", "cluster_id", "is_noise", "rank", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


TRUTH = "m AS (SELECT vec_id, label AS truth, CASE WHEN vec_id % 7 = 0 THEN -1 WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS cluster_id FROM embeddings), t AS (SELECT truth, cluster_id, CAST(count(*) AS DOUBLE) AS n FROM m WHERE cluster_id <> -1 GROUP BY 1, 2), a AS (SELECT truth, sum(n) AS n FROM t GROUP BY 1), b AS (SELECT cluster_id, sum(n) AS n FROM t GROUP BY 1), s AS (SELECT sum(n) AS n FROM t)"


def _truth(spark, sf_dir) -> DataFrame:
    k = F.col("vec_id")
    cluster = F.when(k % 7 == 0, -1).when(k % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("truth"), cluster.alias("cluster_id"))


@query("a11_adjusted_rand", with_ctes(TRUTH, select="SELECT round((ij - x) / ((a + b) / 2 - x), 6) AS ari FROM (SELECT ij, a, b, a * b / (n * (n - 1) / 2) AS x FROM (SELECT sum(n * (n - 1) / 2) AS ij FROM t), (SELECT sum(n * (n - 1) / 2) AS a FROM a), (SELECT sum(n * (n - 1) / 2) AS b FROM b), s)"))
def a11(spark, sf_dir) -> DataFrame:
    return quality.adjusted_rand(_truth(spark, sf_dir)).select(F.round("ari", 6).alias("ari"))


@query("a12_normalised_information", with_ctes(TRUTH, select="SELECT round(mi / ((ha + hb) / 2), 6) AS nmi FROM (SELECT sum(t.n / s.n * ln(t.n * s.n / (a.n * b.n))) AS mi FROM t JOIN a ON a.truth = t.truth JOIN b ON b.cluster_id = t.cluster_id, s), (SELECT sum(-a.n / s.n * ln(a.n / s.n)) AS ha FROM a, s), (SELECT sum(-b.n / s.n * ln(b.n / s.n)) AS hb FROM b, s)"))
def a12(spark, sf_dir) -> DataFrame:
    return quality.normalised_information(_truth(spark, sf_dir)).select(F.round("nmi", 6).alias("nmi"))


@query("a14_one_space", "SELECT count(DISTINCT len(embedding)) AS spaces, count(DISTINCT len(embedding)) = 1 AS homogeneous FROM embeddings")
def a14(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").agg(F.countDistinct(F.size("embedding")).alias("spaces")).withColumn("homogeneous", F.col("spaces") == 1)
