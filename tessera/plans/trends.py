"""Queries of the time series and of the evidence ranked from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import topics as tp
from tessera.operators import trend
from tessera.plans.book import query
from tessera.plans.fixture import LABELS, RECORDS, labels_of, members, members_sql, records, with_ctes

WINDOW = ("2024-01-16", "2024-01-24")
LATE = ("2024-01-22", "2024-01-30")


def points_sql(unit: str = "day") -> str:
    return f"""b AS (SELECT cluster_id, is_noise, CAST(date_trunc('{unit}', ts) AS DATE) AS bucket FROM members),
spine AS (
  SELECT CAST(x AS DATE) AS bucket, row_number() OVER (ORDER BY x) - 1 AS pos FROM (
    SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 1 {unit})) AS x)),
totals AS (SELECT bucket, count(*) AS total FROM b GROUP BY bucket),
cl AS (SELECT DISTINCT cluster_id FROM b WHERE NOT is_noise),
cnt AS (SELECT cluster_id, bucket, count(*) AS n FROM b WHERE NOT is_noise GROUP BY cluster_id, bucket),
filled AS (
  SELECT cl.cluster_id, spine.bucket, spine.pos, coalesce(n, 0) AS count, coalesce(total, 0) AS total
  FROM cl CROSS JOIN spine LEFT JOIN cnt ON cnt.cluster_id = cl.cluster_id AND cnt.bucket = spine.bucket
  LEFT JOIN totals ON totals.bucket = spine.bucket),
based AS (
  SELECT *, CASE WHEN total > 0 THEN count * 1.0 / total ELSE 0 END AS share, coalesce(avg(count) OVER k, 0) AS mean,
         coalesce(stddev_pop(count) OVER k, 0) AS std
  FROM filled WINDOW k AS (PARTITION BY cluster_id ORDER BY bucket ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
points AS (
  SELECT *, CASE WHEN pos >= 3 THEN (count - mean) / greatest(std, sqrt(mean), 1.0) ELSE 0.0 END AS spike FROM based)"""


def window_sql(start: str, end: str) -> str:
    return f"""firsts AS (SELECT min(pos) AS first FROM points WHERE bucket BETWEEN DATE '{start}' AND DATE '{end}'),
w AS (SELECT points.*, bucket BETWEEN DATE '{start}' AND DATE '{end}' AS in_window, pos < first AND pos >= first - 8 AS in_previous, first > 0 AS has_previous
      FROM points, firsts WHERE first IS NOT NULL)"""


BASE = f"{RECORDS},\n{members_sql()}"
DRIFT = f"{RECORDS},\n{members_sql(drift=True)}"


def day(name: str = "bucket"):
    return F.col(name).cast("string").alias(name)


def r6(name: str):
    return F.round(name, 6).alias(name)


@query(
    "t01_bucket_start",
    with_ctes(RECORDS, select="SELECT record_id, CAST(CAST(date_trunc('day', ts) AS DATE) AS VARCHAR) AS day, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month FROM records"),
)
def t01(spark, sf_dir) -> DataFrame:
    units = (trend.bucket_start(F.col("ts"), u).cast("string").alias(u) for u in ("day", "week", "month"))
    return records(spark, sf_dir).select("record_id", *units)


@query("t02_spine", with_ctes(BASE, points_sql("week"), select="SELECT CAST(bucket AS VARCHAR) AS bucket, pos FROM spine"))
def t02(spark, sf_dir) -> DataFrame:
    return trend.spine(members(spark, sf_dir), "week").select(day(), "pos")


@query("t03_zero_filled_counts", with_ctes(DRIFT, points_sql(), select="SELECT cluster_id, CAST(bucket AS VARCHAR) AS bucket, count FROM filled"))
def t03(spark, sf_dir) -> DataFrame:
    return trend.filled(members(spark, sf_dir, drift=True), "day").select("cluster_id", day(), "count")


@query("t04_shares", with_ctes(BASE, points_sql(), select="SELECT cluster_id, CAST(bucket AS VARCHAR) AS bucket, count, total, round(share, 6) AS share FROM points"))
def t04(spark, sf_dir) -> DataFrame:
    return trend.points(members(spark, sf_dir), "day").select("cluster_id", day(), "count", "total", r6("share"))


@query("t05_baselines", with_ctes(BASE, points_sql(), select="SELECT cluster_id, CAST(bucket AS VARCHAR) AS bucket, round(mean, 6) AS mean, round(std, 6) AS std FROM points"))
def t05(spark, sf_dir) -> DataFrame:
    return trend.points(members(spark, sf_dir), "day").select("cluster_id", day(), r6("mean"), r6("std"))


@query("t06_spikes", with_ctes(BASE, points_sql(), select="SELECT cluster_id, CAST(bucket AS VARCHAR) AS bucket, round(spike, 6) AS spike FROM points"))
def t06(spark, sf_dir) -> DataFrame:
    return trend.points(members(spark, sf_dir), "day").select("cluster_id", day(), r6("spike"))


@query(
    "t07_window",
    with_ctes(BASE, points_sql(), window_sql(*WINDOW), select="SELECT cluster_id, CAST(bucket AS VARCHAR) AS bucket, in_window, in_previous, has_previous FROM w"),
)
def t07(spark, sf_dir) -> DataFrame:
    w = trend.windowed(trend.points(members(spark, sf_dir), "day"), *WINDOW)
    return w.select("cluster_id", day(), "in_window", "in_previous", "has_previous")


def _window(spark, sf_dir, days=WINDOW, drift=True) -> DataFrame:
    return trend.windowed(trend.points(members(spark, sf_dir, drift), "day"), *days)


SURPRISING = "surprising AS (SELECT cluster_id, spike, bucket, count FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY spike DESC, count DESC, bucket DESC) AS rn FROM w WHERE in_window) WHERE rn = 1 AND spike > 0)"
NEW = """fresh AS (
  SELECT cluster_id, min(CASE WHEN count > 0 THEN bucket END) AS first_bucket, min(CASE WHEN count > 0 THEN pos END) AS first_pos,
         CAST(sum(CASE WHEN in_window THEN count ELSE 0 END) AS BIGINT) AS count FROM w GROUP BY cluster_id),
new_topics AS (SELECT f.cluster_id, first_bucket, f.count FROM fresh f JOIN w ON w.cluster_id = f.cluster_id AND w.pos = f.first_pos WHERE in_window AND first_pos > 0 AND f.count >= 5)"""
VANISHING = """gone AS (
  SELECT cluster_id, sum(CASE WHEN in_window THEN count ELSE 0 END) AS n, avg(CASE WHEN in_previous THEN count END) AS baseline_mean
  FROM w WHERE has_previous GROUP BY cluster_id),
vanishing AS (SELECT cluster_id, baseline_mean FROM gone WHERE n = 0 AND baseline_mean >= 1)"""
CHANGES = """changes AS (
  SELECT cluster_id, avg(CASE WHEN in_window THEN share END) - avg(CASE WHEN in_previous THEN share END) AS delta_share,
         avg(CASE WHEN in_window THEN share END) AS window_share, avg(CASE WHEN in_previous THEN share END) AS previous_share
  FROM w WHERE has_previous GROUP BY cluster_id)"""


@query("t08_surprising", with_ctes(BASE, points_sql(), window_sql(*WINDOW), SURPRISING, select="SELECT cluster_id, round(spike, 6) AS spike, CAST(bucket AS VARCHAR) AS bucket, count FROM surprising"))
def t08(spark, sf_dir) -> DataFrame:
    return trend.surprising(_window(spark, sf_dir, drift=False)).select("cluster_id", r6("spike"), day(), "count")


@query("t09_new_topics", with_ctes(DRIFT, points_sql(), window_sql(*WINDOW), NEW, select="SELECT cluster_id, CAST(first_bucket AS VARCHAR) AS first_bucket, count FROM new_topics"))
def t09(spark, sf_dir) -> DataFrame:
    return trend.new_topics(_window(spark, sf_dir)).select("cluster_id", day("first_bucket"), "count")


@query("t10_vanishing", with_ctes(DRIFT, points_sql(), window_sql(*LATE), VANISHING, select="SELECT cluster_id, round(baseline_mean, 6) AS baseline_mean FROM vanishing"))
def t10(spark, sf_dir) -> DataFrame:
    return trend.vanishing(_window(spark, sf_dir, LATE)).select("cluster_id", r6("baseline_mean"))


_SHARES = "cluster_id, round(delta_share, 6) AS delta_share, round(window_share, 6) AS window_share, round(previous_share, 6) AS previous_share"


@query("t11_rising", with_ctes(DRIFT, points_sql(), window_sql(*WINDOW), CHANGES, select=f"SELECT {_SHARES} FROM changes WHERE delta_share > 0"))
def t11(spark, sf_dir) -> DataFrame:
    return trend.rising(_window(spark, sf_dir)).select("cluster_id", *map(r6, ("delta_share", "window_share", "previous_share")))


@query("t12_falling", with_ctes(DRIFT, points_sql(), window_sql(*WINDOW), CHANGES, select=f"SELECT {_SHARES} FROM changes WHERE delta_share < 0"))
def t12(spark, sf_dir) -> DataFrame:
    return trend.falling(_window(spark, sf_dir)).select("cluster_id", *map(r6, ("delta_share", "window_share", "previous_share")))


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY created_at DESC, label_id DESC) AS rn FROM labels_of) WHERE rn = 1)"


@query(
    "t14_labelled_series",
    with_ctes(BASE, points_sql(), LABELS, LATEST, select="SELECT p.cluster_id, label, string_agg(concat(CAST(bucket AS VARCHAR), '=', count), ',' ORDER BY bucket) AS series FROM points p LEFT JOIN latest l ON l.cluster_id = p.cluster_id GROUP BY p.cluster_id, label"),
)
def t14(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir)
    step = F.struct("bucket", F.concat(F.col("bucket").cast("string"), F.lit("="), F.col("count").cast("string")).alias("t"))
    series = trend.points(m, "day").groupBy("cluster_id").agg(F.array_sort(F.collect_list(step)).alias("_s"))
    labels = tp.latest_labels(labels_of(m)).select("cluster_id", "label")
    return series.join(labels, "cluster_id", "left").select("cluster_id", "label", F.array_join(F.transform("_s", lambda x: x["t"]), ",").alias("series"))


@query(
    "t15_snapshot",
    with_ctes(BASE, points_sql(), window_sql(*WINDOW), select="""SELECT cluster_id, CASE WHEN spike > 0 THEN CAST(bucket AS VARCHAR) END AS bucket, count, round(greatest(spike, 0), 6) AS spike FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY spike DESC, count DESC, bucket) AS rn FROM w WHERE in_window) WHERE rn = 1"""),
)
def t15(spark, sf_dir) -> DataFrame:
    best = trend.best_points(_window(spark, sf_dir, drift=False).where("in_window"), latest=False)
    some = F.col("spike") > 0
    return best.select("cluster_id", F.when(some, F.col("bucket").cast("string")).alias("bucket"), "count", F.round(F.greatest("spike", F.lit(0.0)), 6).alias("spike"))


@query(
    "t16_bucket_overlap",
    with_ctes(BASE, points_sql("week"), select="SELECT cluster_id, CAST(bucket AS VARCHAR) AS bucket, count FROM points WHERE bucket < DATE '2024-01-17' + INTERVAL 1 day AND bucket + INTERVAL 7 day > DATE '2024-01-10'"),
)
def t16(spark, sf_dir) -> DataFrame:
    return trend.overlapping(trend.points(members(spark, sf_dir), "week"), "week", "2024-01-10", "2024-01-17").select("cluster_id", day(), "count")


@query(
    "t17_window_spike",
    with_ctes(BASE, points_sql(), select="""SELECT cluster_id, CAST(bucket AS VARCHAR) AS bucket, round(spike, 6) AS spike FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY spike DESC, bucket) AS rn FROM points WHERE bucket BETWEEN DATE '2024-01-10' AND DATE '2024-01-17') WHERE rn = 1 AND spike > 0.5"""),
)
def t17(spark, sf_dir) -> DataFrame:
    inside = trend.overlapping(trend.points(members(spark, sf_dir), "day"), "day", "2024-01-10", "2024-01-17")
    best = trend.best_points(inside.withColumn("count", F.lit(0)), latest=False)
    return best.where("spike > 0.5").select("cluster_id", day(), r6("spike"))


@query(
    "t18_tidy_series",
    with_ctes(DRIFT, points_sql("week"), select="""SELECT cluster_id, CAST(bucket AS VARCHAR) AS bucket, count, bucket < lo OR bucket + INTERVAL 7 day > hi AS partial FROM (
  SELECT *, min(CASE WHEN count > 0 THEN pos END) OVER (PARTITION BY cluster_id) AS seen FROM points), (SELECT min(ts) AS lo, max(ts) AS hi FROM members)
WHERE seen IS NULL OR pos >= seen"""),
)
def t18(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir, drift=True)
    extent = m.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return trend.tidy(trend.points(m, "week"), extent, "week").select("cluster_id", day(), "count", "partial")


@query(
    "t19_presets",
    with_ctes(RECORDS, select="SELECT concat(d, 'd') AS preset, CAST(greatest(lo, hi - CAST(d - 1 AS INT)) AS VARCHAR) AS start, CAST(hi AS VARCHAR) AS \"end\" FROM (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM records), (SELECT unnest([7, 30, 90]) AS d)"),
)
def t19(spark, sf_dir) -> DataFrame:
    days = F.to_date("ts")
    return trend.presets(records(spark, sf_dir).agg(F.min(days).alias("lo"), F.max(days).alias("hi"))).select("preset", day("start"), day("end"))


@query(
    "t20_peaks",
    with_ctes(BASE, points_sql(), select="SELECT cluster_id, CAST(bucket AS VARCHAR) AS bucket, count FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY count DESC, bucket) AS rn FROM points) WHERE rn = 1"),
)
def t20(spark, sf_dir) -> DataFrame:
    return trend.peaks(trend.points(members(spark, sf_dir), "day")).select("cluster_id", day(), "count")


MIX = """mix AS (SELECT cluster_id, source_type, count(*) AS n FROM members WHERE NOT is_noise GROUP BY cluster_id, source_type),
mixes AS (SELECT cluster_id, string_agg(concat(source_type, '=', n), ',' ORDER BY source_type) AS mix FROM mix GROUP BY cluster_id)"""


def mixes(m: DataFrame) -> DataFrame:
    """Source mixes as text, one row per topic."""
    counted = m.where("not is_noise").groupBy("cluster_id", "source_type").count()
    parts = F.array_sort(F.collect_list(F.concat_ws("=", "source_type", F.col("count").cast("string"))))
    return counted.groupBy("cluster_id").agg(F.array_join(parts, ",").alias("mix"))


def enriched(ranked: DataFrame, m: DataFrame) -> DataFrame:
    """Ranked topics with their latest label and source mix."""
    labels = tp.latest_labels(labels_of(m)).select("cluster_id", "label")
    return ranked.join(labels, "cluster_id", "left").join(mixes(m), "cluster_id", "left")


_ENRICH = "LEFT JOIN latest l ON l.cluster_id = x.cluster_id LEFT JOIN mixes ON mixes.cluster_id = x.cluster_id"

SURPRISING_SQL = with_ctes(
    BASE, points_sql(), window_sql("2024-01-01", "2024-01-30"), SURPRISING, LABELS, LATEST, MIX,
    select=f"SELECT x.cluster_id, round(spike, 6) AS spike, CAST(bucket AS VARCHAR) AS bucket, count, label, mix FROM surprising x {_ENRICH} ORDER BY spike DESC, count DESC, x.cluster_id LIMIT 10",
)


def surprising_by_day(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir)
    top = trend.surprising(trend.windowed(trend.points(m, "day"))).orderBy(F.desc("spike"), F.desc("count"), "cluster_id").limit(10)
    return enriched(top, m).select("cluster_id", r6("spike"), day(), "count", "label", "mix")


query("surprising_topics_by_day", SURPRISING_SQL)(surprising_by_day)
query("v01_surprising_topics", SURPRISING_SQL)(surprising_by_day)


@query(
    "v02_new_topics",
    with_ctes(DRIFT, points_sql(), window_sql(*WINDOW), NEW, LABELS, LATEST, MIX, select=f"SELECT x.cluster_id, CAST(first_bucket AS VARCHAR) AS first_bucket, count, label, mix FROM new_topics x {_ENRICH} ORDER BY first_bucket, x.cluster_id LIMIT 10"),
)
def v02(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir, drift=True)
    top = trend.new_topics(_window(spark, sf_dir)).orderBy("first_bucket", "cluster_id").limit(10)
    return enriched(top, m).select("cluster_id", day("first_bucket"), "count", "label", "mix")


@query(
    "v03_vanishing_topics",
    with_ctes(DRIFT, points_sql(), window_sql(*LATE), VANISHING, LABELS, LATEST, MIX, select=f"SELECT x.cluster_id, round(baseline_mean, 6) AS baseline_mean, label, mix FROM vanishing x {_ENRICH} ORDER BY baseline_mean DESC, x.cluster_id LIMIT 10"),
)
def v03(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir, drift=True)
    top = trend.vanishing(_window(spark, sf_dir, LATE)).orderBy(F.desc("baseline_mean"), "cluster_id").limit(10)
    return enriched(top, m).select("cluster_id", r6("baseline_mean"), "label", "mix")


@query(
    "v04_rising_topics",
    with_ctes(DRIFT, points_sql(), window_sql(*WINDOW), CHANGES, LABELS, LATEST, MIX, select=f"SELECT x.cluster_id, round(delta_share, 6) AS delta_share, label, mix FROM changes x {_ENRICH} WHERE delta_share > 0 ORDER BY delta_share DESC, x.cluster_id LIMIT 10"),
)
def v04(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir, drift=True)
    top = trend.rising(_window(spark, sf_dir)).orderBy(F.desc("delta_share"), "cluster_id").limit(10)
    return enriched(top, m).select("cluster_id", r6("delta_share"), "label", "mix")


@query(
    "v08_topic_trend",
    with_ctes(BASE, points_sql(), select="""SELECT p.cluster_id, string_agg(concat(CAST(p.bucket AS VARCHAR), '=', p.count), ',' ORDER BY p.bucket) AS series,
  max(CASE WHEN b.spike > 0 THEN CAST(b.bucket AS VARCHAR) END) AS top_bucket, round(greatest(max(b.spike), 0), 6) AS spike
FROM points p JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY spike DESC, count DESC, bucket DESC) AS rn FROM points) WHERE rn = 1) b ON b.cluster_id = p.cluster_id
GROUP BY p.cluster_id"""),
)
def v08(spark, sf_dir) -> DataFrame:
    step = F.struct("bucket", F.concat(F.col("bucket").cast("string"), F.lit("="), F.col("count").cast("string")).alias("t"))
    best = F.max_by(F.struct("bucket", "spike"), F.struct("spike", "count", "bucket"))
    p = trend.points(members(spark, sf_dir), "day").groupBy("cluster_id").agg(F.array_sort(F.collect_list(step)).alias("_s"), best.alias("_b"))
    return p.select(
        "cluster_id",
        F.array_join(F.transform("_s", lambda x: x["t"]), ",").alias("series"),
        F.when(F.col("_b.spike") > 0, F.col("_b.bucket").cast("string")).alias("top_bucket"),
        F.round(F.greatest("_b.spike", F.lit(0.0)), 6).alias("spike"),
    )


@query(
    "v09_enriched_topics",
    with_ctes(BASE, LABELS, LATEST, MIX, select=f"SELECT x.cluster_id, size, label, mix FROM (SELECT cluster_id, count(*) AS size FROM members WHERE NOT is_noise GROUP BY cluster_id) x {_ENRICH}"),
)
def v09(spark, sf_dir) -> DataFrame:
    m = members(spark, sf_dir)
    sizes = m.where("not is_noise").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return enriched(sizes, m).select("cluster_id", "size", "label", "mix")


@query(
    "v10_compare_periods",
    with_ctes(BASE, points_sql(), select="""SELECT cluster_id, count_a, count_b, count_b - count_a AS delta_count, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b, round(share_b - share_a, 6) AS delta_share FROM (
  SELECT cluster_id, CAST(coalesce(sum(CASE WHEN a THEN count END), 0) AS BIGINT) AS count_a, CAST(coalesce(sum(CASE WHEN b THEN count END), 0) AS BIGINT) AS count_b,
         coalesce(avg(CASE WHEN a THEN share END), 0) AS share_a, coalesce(avg(CASE WHEN b THEN share END), 0) AS share_b
  FROM (SELECT *, bucket BETWEEN DATE '2024-01-03' AND DATE '2024-01-10' AS a, bucket BETWEEN DATE '2024-01-20' AND DATE '2024-01-27' AS b FROM points) GROUP BY cluster_id)
ORDER BY abs(share_b - share_a) DESC, cluster_id LIMIT 10"""),
)
def v10(spark, sf_dir) -> DataFrame:
    found = trend.compare_periods(trend.points(members(spark, sf_dir), "day"), ("2024-01-03", "2024-01-10"), ("2024-01-20", "2024-01-27"))
    top = found.orderBy(F.abs("delta_share").desc(), "cluster_id").limit(10)
    return top.select("cluster_id", "count_a", "count_b", "delta_count", *map(r6, ("share_a", "share_b", "delta_share")))
