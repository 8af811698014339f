"""Topic summaries, facets, labels, rankings and record lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Facet values that are told apart, and what the others are called.
TOP_FACETS, OTHER, NONE = 20, "(other)", "(none)"
#: Members with this probability are candidates to represent a topic.
LEAST_PROBABILITY = 0.7


def _noiseless(members: DataFrame) -> DataFrame:
    return members.where("not is_noise and cluster_id <> -1")


def representatives(members: DataFrame, k: int, by: str = "probability") -> DataFrame:
    """cluster_id, record_id, rank: the first k members by the column, then by id.

    Ranks come from one windowed pass that keeps k rows of each topic before they meet.
    """
    order = Window.partitionBy("cluster_id").orderBy(F.desc(by), "record_id")
    ranked = _noiseless(members).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("cluster_id", "record_id", F.col("rank").cast("long").alias("rank"))


def summaries(members: DataFrame, k: int = 20) -> DataFrame:
    """cluster_id, size, mean_probability, source_mix (map by name), representatives (ids in order)."""
    rows = _noiseless(members)
    sizes = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.avg("probability").alias("mean_probability"))
    mix = (
        rows.groupBy("cluster_id", "source_type")
        .count()
        .groupBy("cluster_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "count")))).alias("source_mix"))
    )
    best = representatives(members, k).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "record_id"))).alias("_r"))
    best = best.select("cluster_id", F.transform("_r", lambda x: x["record_id"]).alias("representatives"))
    return sizes.join(mix, "cluster_id").join(best, "cluster_id")


def run_stats(scoped: DataFrame, members: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row: scoped_records, population, missing_embeddings, clusters, noise, noise_ratio."""
    have = scoped.join(embedded.select("record_id", F.lit(1).alias("_e")).dropDuplicates(["record_id"]), "record_id", "left")
    got = have.join(members.select("record_id", "cluster_id", "is_noise"), "record_id", "left")
    population = F.count_if(F.col("_e").isNotNull())
    noise = F.count_if(F.col("_e").isNotNull() & F.col("is_noise"))
    return got.agg(
        F.count(F.lit(1)).alias("scoped_records"),
        population.alias("population"),
        F.count_if(F.col("_e").isNull()).alias("missing_embeddings"),
        F.countDistinct(F.when(F.col("_e").isNotNull() & ~F.col("is_noise"), F.col("cluster_id"))).alias("clusters"),
        noise.alias("noise"),
        F.coalesce(F.try_divide(noise, population), F.lit(0.0)).alias("noise_ratio"),
    )


def json_text(variant: Column) -> Column:
    """A JSON value as facet text: null and "" are none, booleans in lower case, nested values as JSON."""
    kind = F.schema_of_variant(variant)
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    text = F.when(nested, F.to_json(variant)).otherwise(F.try_variant_get(variant, "$", "string"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NONE))


def facet_values(rows: DataFrame, facet: str) -> DataFrame:
    """rows with value: of a column, of each tag, or of a key of the metadata."""
    if facet == "tags":
        return rows.withColumn("value", F.explode_outer("tags")).withColumn("value", F.coalesce(F.nullif("value", F.lit("")), F.lit(NONE)))
    if facet.startswith("metadata."):
        key = facet.removeprefix("metadata.").replace("'", "\\'")
        variant = F.try_variant_get(F.try_parse_json("metadata"), f"$['{key}']", "variant")
        return rows.withColumn("value", F.when(variant.isNull(), F.lit(NONE)).otherwise(json_text(variant)))
    return rows.withColumn("value", F.coalesce(F.nullif(F.col(facet).cast("string"), F.lit("")), F.lit(NONE)))


def facets(members: DataFrame, records: DataFrame, facet: str, clusters: Sequence[int] = (), top: int = TOP_FACETS) -> DataFrame:
    """cluster_id, value, count: the first ``top`` values by count, then value; the rest as one, if any.

    The rest is what is left of the topic's total. A value that is called as the rest is counted with it, so no
    name comes twice. Noise is left out; no clusters means all of them.
    """
    rows = _noiseless(members).select("cluster_id", "record_id")
    if clusters:
        rows = rows.where(F.col("cluster_id").isin(list(clusters)))
    counted = facet_values(rows.join(records, "record_id"), facet).groupBy("cluster_id", "value").agg(F.count(F.lit(1)).alias("count"))
    # a limit on a rank: each task keeps its own first ones of a topic before they meet
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("count"), "value"))
    first = counted.withColumn("_n", place).where(F.col("_n") <= top).select("cluster_id", "value", "count")
    told = first.select("cluster_id", (-F.col("count")).alias("count"))
    rest = counted.select("cluster_id", "count").union(told).groupBy("cluster_id").agg(F.sum("count").alias("count")).where(F.col("count") > 0)
    both = first.unionByName(rest.select("cluster_id", F.lit(OTHER).alias("value"), "count"))
    return both.groupBy("cluster_id", "value").agg(F.sum("count").alias("count"))


def latest_labels(labels: DataFrame) -> DataFrame:
    """The newest label of each topic; of equal times the greatest id."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("created_at"), F.desc("label_id"))
    return labels.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def outliers(members: DataFrame, k: int = 50) -> DataFrame:
    return members.orderBy(F.desc("is_noise"), F.desc("outlier_score"), "record_id").limit(k)


def noise_sample(members: DataFrame, k: int = 20, seed: int = 1) -> DataFrame:
    """k noise records in a hashed order, the same for the same seed."""
    return members.where("is_noise").orderBy(F.xxhash64(F.lit(seed), F.col("record_id")), "record_id").limit(k)


def canonical_ids(members: DataFrame) -> DataFrame:
    """Topics numbered by their smallest member; noise stays -1. One row per topic is ranked."""
    firsts = members.where("cluster_id <> -1").groupBy("cluster_id").agg(F.min("record_id").alias("_first"))
    ranks = firsts.select("cluster_id", (F.row_number().over(Window.orderBy("_first")) - 1).alias("_rank"))
    return members.join(ranks, "cluster_id", "left").withColumn("canonical_id", F.coalesce("_rank", F.lit(-1))).drop("_rank")


def compact_mix(mix: DataFrame, n: int = 2) -> DataFrame:
    """cluster_id, mix: "name count" of the n largest sources, and how many more there are."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("count"), "source_type"))
    ranked = mix.where("count > 0").withColumn("_n", place)
    told = F.when(F.col("_n") <= n, F.concat_ws(" ", "source_type", F.format_number("count", 0)))
    out = ranked.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.when(told.isNotNull(), F.struct("_n", told.alias("t"))))).alias("_t"), F.max("_n").alias("_all")
    )
    more = F.when(F.col("_all") > n, F.array(F.concat(F.lit("+"), (F.col("_all") - n).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return out.select("cluster_id", F.array_join(F.concat(F.transform("_t", lambda x: x["t"]), more), " · ").alias("mix"))


def visible_counts(topics: DataFrame, shown: DataFrame) -> DataFrame:
    """Every topic with the number of its records that a filter lets through."""
    counted = shown.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("visible"))
    return topics.join(counted, "cluster_id", "left").withColumn("visible", F.coalesce("visible", F.lit(0)))


def ordered_records(ids: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of an array of ids in its order: cluster_id, pos, and the record; ids without a record go."""
    return ids.select("cluster_id", F.posexplode("representatives").alias("pos", "record_id")).join(records, "record_id")


def page(records: DataFrame, offset: int, limit: int) -> DataFrame:
    return records.orderBy("timestamp_ms", "record_id").offset(offset).limit(limit)


def shortened(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)
