"""Clustering, layout and reuse on planted data."""

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vx
from tessera.operators import cluster as cl
from tessera.operators import dendrogram as dg
from tessera.operators import providers, quality
from tessera.operators.components import components
from tessera.plans import registry, scripted
from tessera.session import stored, table


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((4, 16))
    rows = []
    for i in range(200):
        v = centers[i % 4] / np.linalg.norm(centers[i % 4]) + rng.normal(0, 0.05, 16)
        rows.append((i, i % 4, (v / np.linalg.norm(v)).tolist()))
    return spark.createDataFrame(rows, "id long, truth int, vector array<double>").cache()


@pytest.mark.parametrize(("n", "want"), [(1000, (15, 10)), (5000, (25, 10)), (20_000, (100, 10)), (100_000, (150, 10))])
def test_parameters(n, want):
    assert cl.parameters(n) == want
    assert cl.parameters(n, 8) == (8, 8)


def brute_neighbours(v, k):
    sim = v @ v.T
    np.fill_diagonal(sim, -np.inf)
    return [sorted((j for j in range(len(v)) if j != i), key=lambda j: (-round(sim[i, j], 12), j))[:k] for i in range(len(v))]  # noqa: B023


def neighbour_lists(found):
    got = {}
    for r in found.collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["neighbour"]
    return {i: [ranks[x] for x in sorted(ranks)] for i, ranks in got.items()}


@pytest.mark.parametrize("pivots", [1, 7, 60])
def test_exact_neighbours_are_exact(planted, monkeypatch, pivots):
    monkeypatch.setattr(vx, "BLOCK_ROWS", 60)
    v = np.array([r["vector"] for r in planted.orderBy("id").collect()])
    assert neighbour_lists(vx.exact_neighbours(planted, 5, pivots=pivots)) == dict(enumerate(brute_neighbours(v, 5)))


def test_exact_neighbours_of_vectors_of_any_length(spark):
    """Copies, zero vectors, long and short ones; more neighbours than a cell has rows."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((90, 5)) * rng.choice([0.0, 0.3, 1.0, 4.0], (90, 1))
    v[40:55] = v[3]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    assert neighbour_lists(vx.exact_neighbours(rows, 12, pivots=9)) == dict(enumerate(brute_neighbours(v, 12)))
    assert vx.exact_neighbours(rows.limit(0), 3).count() == 0


def test_pruned_cells_are_fewer_pairs(spark):
    """On rows in groups a row asks few cells beside its own; pairs compared are a small part of all."""
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((20, 16)) * 3
    v = centers[np.arange(1000) % 20] + rng.normal(0, 0.1, (1000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    own, asked = vx.pruned_cells(rows, 8, 40)
    sizes = own.groupBy("cell").count()
    pairs = own.select("cell").unionByName(asked.select("cell")).join(sizes, "cell").agg(F.sum("count")).first()[0]
    assert pairs <= 0.2 * 1000**2
    assert neighbour_lists(vx.exact_neighbours(rows, 8, pivots=40)) == dict(enumerate(brute_neighbours(v, 8)))


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of 2,400 rows in one narrow group, 300 of them equal, the others spread."""
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.standard_normal(12) * 2 + rng.normal(0, 0.2, (1600, 12)), rng.standard_normal((800, 12))])
    v[:300] = v[0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").cache(), v


def test_cells_are_bounded_whatever_the_rows(skewed):
    rows, _ = skewed
    tree = stored(vx.cell_tree(vx._data(rows, "id", "vector"), 6), "tree")
    own = tree.where("rank = 1")
    assert own.count() == own.select("id").distinct().count() == 2400
    assert own.groupBy("cell").count().agg(F.max("count")).first()[0] <= vx.CELL_MOST
    assert tree.groupBy("id").count().agg(F.max("count")).first()[0] <= 6


def test_approximate_recall_on_skewed_cells(skewed):
    """Judged by similarity, as any of equal rows is as good a neighbour as the next."""
    rows, v = skewed
    sim = v @ v.T
    np.fill_diagonal(sim, -np.inf)
    least = np.sort(sim, axis=1)[:, -10]
    got = vx.approximate_neighbours(rows, 10).collect()
    assert len(got) == 24_000
    assert np.mean([sim[r["id"], r["neighbour"]] >= least[r["id"]] - 1e-9 for r in got]) >= 0.9


def test_approximate_recall_at_15_on_the_table(spark):
    """As registered: over all rows of the table, against the exact search."""
    rows = registry.queries()
    got = rows["c03_approximate_neighbours"](spark, "/root/testdata/sf0.1").select("id", "neighbour")
    exact = rows["c02_exact_neighbours"](spark, "/root/testdata/sf0.1").select("id", "neighbour")
    assert got.groupBy("id").count().where("count = 15").count() == 2000
    assert exact.intersect(got).count() >= 0.9 * exact.count()


def test_approximate_finds_k_for_rows_alone_in_their_cells(spark, planted, monkeypatch):
    monkeypatch.setattr(vx, "CELL_ROWS", 4)
    monkeypatch.setattr(vx, "CELL_MOST", 8)
    rng = np.random.default_rng(3)
    far = [(1000 + i, 9, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.standard_normal((6, 16)))]
    rows = planted.union(spark.createDataFrame(far, planted.schema)).select("id", "vector")
    got = vx.approximate_neighbours(rows, 12, probes=1).groupBy("id").count()
    assert got.count() == 206 and got.where("count <> 12").isEmpty()
    assert vx.approximate_neighbours(rows.limit(0), 3).count() == 0


def brute_condensed(edges, size):
    """Single linkage over sets of points: ({id: (lam, chain)}, {chain: (lam, size, parts, parent, born)})."""
    part = {x: (frozenset([x]), None) for a, b, _ in edges for x in (a, b)}
    falls, chains, parent = {}, {}, {}
    for rank, (a, b, w) in enumerate(sorted(edges, key=lambda e: (e[2], e[0], e[1]))):
        (one, left), (two, right) = part[a], part[b]
        whole, lam = one | two, 1 / max(w, 1e-9)
        chain = left if right is None else right
        if len(whole) >= size and (left is None) == (right is None):
            chain = rank
            chains[rank] = [lam, len(whole), 0]
        if left is not None and right is not None:
            chains[rank][2] = 2
            parent[left] = parent[right] = (rank, lam)
        if len(whole) >= size:
            falls |= {x: (lam, chain) for side, its in ((one, left), (two, right)) if its is None for x in side}
        for x in whole:
            part[x] = (whole, chain)
    return falls, {c: (*v, *parent.get(c, (None, 0.0))) for c, v in chains.items()}


def grouped_rows(spark):
    """Groups within groups, of unlike density: chains that split twice, rows that fall out early, and several roots."""
    rng = np.random.default_rng(8)
    rows = []
    for g, spread in enumerate((0.02, 0.03, 0.02, 0.08, 0.05, 0.02)):
        center = np.array([g // 2 * 3.0, 1.0 + g % 2 * 0.45, 1.0])
        rows += [center + rng.normal(0, spread, 3) for _ in range(40)]
    rows += list(rng.normal(0, 2, (20, 3)))
    data = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rows)], "id long, vector array<double>")
    return stored(cl.spanning_forest(cl.reachability(stored(vx.exact_neighbours(data, 10), "near"), 4)), "forest")


@pytest.fixture(scope="module")
def grouped_forest(spark):
    return grouped_rows(spark)


def in_python(tree):
    falls = {r["id"]: (r["lam"], r["chain"]) for r in tree.falls.collect()}
    return falls, {r["chain"]: (r["lam"], r["size"], r["parts"], r["parent"], r["born"]) for r in tree.chains.collect()}


@pytest.mark.parametrize("edges", [9, 40, 100_000])
def test_condensed_tree_is_single_linkage(grouped_forest, monkeypatch, edges):
    """In one bucket and in many, the tree that a walk over all merges gives."""
    monkeypatch.setattr(dg, "BUCKET_EDGES", edges)
    want = brute_condensed([tuple(r) for r in grouped_forest.select("a", "b", "w").collect()], 8)
    assert len(want[1]) > 8 and {v[2] for v in want[1].values()} == {0, 2}
    tree = dg.condensed(grouped_forest, 8)
    assert in_python(tree) == want
    if edges == 9:
        assert grouped_forest.count() > 20 * edges


def test_condensed_tree_of_chains_stars_and_equal_weights(spark, monkeypatch):
    """A chain of rising weights, a star of one weight, names that are no numbers, trees too small for a cluster, none at all."""
    monkeypatch.setattr(dg, "BUCKET_EDGES", 6)
    edges = [(f"c{i:02d}", f"c{i + 1:02d}", 0.1 * (i + 1)) for i in range(30)] + [("hub", f"s{i:02d}", 0.5) for i in range(20)]
    edges += [(min(a, b), max(a, b), 0.0) for a, b in [("s03", "t0"), ("t0", "t1"), ("c00", "hub"), ("z1", "z2")]]
    forest = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in edges], "a string, b string, w double")
    for size in (2, 5):
        assert in_python(dg.condensed(forest, size)) == brute_condensed([tuple(r) for r in forest.collect()], size)
    assert dg.condensed(forest, 500).chains.isEmpty()
    assert dg.condensed(forest.limit(0), 5) is None


def brute_selected(falls, chains, method, allow_single):
    """Walks the chains with dictionaries: {id: (cluster or None, lam, deep)}."""
    below = {c: [d for d in chains if chains[d][3] == c] for c in chains}
    own = {c: sum(lam - born for lam, at in falls.values() if at == c) + (size * (end - born) if parts else 0) for c, (end, size, parts, _, born) in chains.items()}
    roots = [c for c in chains if chains[c][3] is None]
    best, take, deep = {}, {}, {}

    def weigh(c):
        for d in below[c]:
            weigh(d)
        rest = sum(best[d] for d in below[c])
        whole = roots == [c] and not allow_single and below[c]
        take[c] = not below[c] if method == "leaf" else own[c] >= rest and not whole
        best[c] = own[c] if take[c] else rest
        deep[c] = max([chains[c][0]] + [deep[d] for d in below[c]])

    for c in roots:
        weigh(c)

    def cluster(c):
        up = chains[c][3]
        return (cluster(up) if up is not None else None) or (c if take[c] else None)

    return {i: (cluster(c), lam, deep[c]) for i, (lam, c) in falls.items()}


@pytest.mark.parametrize(("method", "allow_single"), [("eom", False), ("eom", True), ("leaf", False)])
def test_selection_against_brute_force(grouped_forest, method, allow_single):
    tree = dg.condensed(grouped_forest, 8)
    got = {r["id"]: (r["cluster"], r["lam"], r["deep"]) for r in cl.selected(tree, method, allow_single).collect()}
    want = brute_selected(*in_python(tree), method, allow_single)
    assert len({c for c, _, _ in want.values()}) > 2
    assert got == want


def test_outlier_scores_say_more_than_noise(spark):
    """Members of dense cores have less of it than those at the rim; noise that was in a group has less than 1."""
    found = registry.queries()["c09_outlier_scores"](spark, "/root/testdata/sf0.01").collect()
    scores = [r["outlier_score"] for r in found]
    assert len(found) == 500 and all(0 <= x <= 1 for x in scores) and len(set(scores)) > 5


def test_chunk_analysis_covers_the_population(spark, sf):
    """Every chunk has its canonical chunk's topic and place, ranks are 1 to 50 at most, and copies agree."""
    rows = stored(registry.queries()["m06_chunk_analysis"](spark, sf), "analysis")
    chunks = registry.queries()["m04_chunk_texts"](spark, sf)
    assert rows.count() == chunks.count() == rows.join(chunks, ["hash", "seq"]).count()
    assert rows.where("x is null or y is null or is_noise <> (cluster_id = -1) or (is_noise and rank is not null)").isEmpty()
    assert rows.groupBy("record_id").agg(F.countDistinct("cluster_id", "x", "y").alias("n")).where("n > 1").isEmpty()
    ranks = rows.where("rank is not null").select("cluster_id", "rank").distinct().groupBy("cluster_id").agg(F.max("rank").alias("m"), F.count("rank").alias("n"))
    assert ranks.where("m <> n or m > 50").isEmpty() and not ranks.isEmpty()


def test_rounds_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "a long, b long, w double")
    nodes = spark.range(41).select("id")
    with pytest.raises(RuntimeError):
        components(nodes, chain, max_rounds=1)
    with pytest.raises(RuntimeError):
        cl.spanning_forest(chain, max_rounds=1)


def test_forest_has_least_weight(planted):
    edges = stored(cl.reachability(stored(vx.exact_neighbours(planted, 8), "near"), 4), "reach")
    got = cl.spanning_forest(edges).collect()
    top = list(range(200))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    want = 0.0
    for a, b, w in sorted(((r["a"], r["b"], r["w"]) for r in edges.collect()), key=lambda e: (e[2], e[0], e[1])):
        p, q = find(a), find(b)
        if p != q:
            top[p] = q
            want += w
    trees = len({find(i) for i in range(200)})
    assert len(got) == 200 - trees
    assert sum(r["w"] for r in got) == pytest.approx(want)


@pytest.mark.parametrize("method", ["eom", "leaf"])
def test_planted_clusters(planted, method):
    found = stored(cl.clustered(planted.select("id", "vector"), min_cluster_size=12, min_samples=5, method=method), "found")
    rows = found.join(planted.select(F.col("id").alias("record_id"), "truth"), "record_id")
    assert quality.adjusted_rand(rows).first()[0] >= 0.8
    assert found.count() == 200
    assert found.where("is_noise <> (cluster_id = -1) or probability not between 0 and 1").isEmpty()
    firsts = [r["f"] for r in found.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("record_id").alias("f")).orderBy("cluster_id").collect()]
    assert firsts == sorted(firsts)


@pytest.mark.parametrize("name", ["c07_hierarchy", "c08_probabilities"])
def test_registered_topics_on_2000_planted_rows(spark, name):
    sf = "/root/testdata/sf0.1"
    found = stored(registry.queries()[name](spark, sf), "found")
    truth = table(spark, sf, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("label").alias("truth"))
    rows = found.join(truth, "record_id")
    assert rows.count() == 2000
    assert quality.adjusted_rand(rows).first()[0] >= 0.8
    assert found.where("cluster_id = -1").count() <= 40


def test_repulsion_counts_every_other_row_once(spark):
    """And is near the sum over all pairs; rows in one place, in a line, and far off."""
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(6, 0.2, (80, 2)), np.tile([[2.0, -3.0]], (20, 1)), [[25.0, 25.0]]])
    at = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {r["id"]: r for r in cl.repulsion(at, len(xy)).collect()}
    assert {r["others"] for r in got.values()} == {len(xy) - 1}
    diff = xy[:, None] - xy[None]
    d2 = (diff**2).sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        push = np.where(d2 > 0, 2 * cl.CURVE_B / ((0.001 + d2) * (1 + cl.CURVE_A * d2**cl.CURVE_B)), 0)
    want = np.clip(push[..., None] * diff, -cl.FORCE, cl.FORCE).sum(1) / (len(xy) - 1)
    found = np.array([[got[i]["qx"], got[i]["qy"]] for i in range(len(xy))])
    assert np.corrcoef(found.ravel(), want.ravel())[0, 1] >= 0.9
    for n in (3, 5):
        assert {r["others"] for r in cl.repulsion(at.where(F.col("id") < n), n).collect()} == {n - 1}


def test_layout_keeps_neighbours_better_than_components(spark):
    """Of each row's ten nearest, how many are among the ten nearest on the map."""
    rng = np.random.default_rng(13)
    v = np.eye(24)[np.arange(300) % 8] + rng.normal(0, 0.12, (300, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    want = brute_neighbours(v, 10)

    def kept(places):
        xy = np.array([[x, y] for _, x, y in sorted(places)])
        d = ((xy[:, None] - xy[None]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        return np.mean([len({*np.argsort(d[i])[:10].tolist()} & {*want[i]}) / 10 for i in range(300)])

    flat = kept([(r["id"], *r["vector"]) for r in vx.reduced(rows, 2).collect()])
    moved = kept([(r["id"], r["x"], r["y"]) for r in cl.layout(rows, k=10).collect()])
    assert moved >= 1.25 * flat


def test_layout(spark, planted):
    got = cl.layout(planted.select("id", "vector"), steps=2).collect()
    assert len(got) == 200 and np.isfinite([[r["x"], r["y"]] for r in got]).all()
    xy = {r["id"]: np.array([r["x"], r["y"]]) for r in got}
    means = [np.mean([xy[i] for i in range(t, 200, 4)], axis=0) for t in range(4)]
    nearest = [min(range(4), key=lambda t: np.linalg.norm(xy[i] - means[t])) for i in range(200)]  # noqa: B023
    assert np.mean([nearest[i] == i % 4 for i in range(200)]) >= 0.9
    # equal vectors are pushed apart
    same = cl.layout(spark.createDataFrame([(i, [1.0, 0.0, 0.0]) for i in range(30)] + [(99, [0.0, 1.0, 0.0])], "id long, vector array<double>"), steps=3).collect()
    assert len({(round(r["x"], 3), round(r["y"], 3)) for r in same}) > 25
    two = planted.where("id < 2").select("id", "vector")
    assert sorted((r["x"], r["y"]) for r in cl.layout(two).collect()) == [(-1.0, 0.0), (1.0, 0.0)]
    assert [(r["x"], r["y"]) for r in cl.layout(two.limit(1)).collect()] == [(0.0, 0.0)]


def test_embedding_reuse(spark):
    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "one")], "record_id string, text string")
    cache = spark.createDataFrame([], "model string, dims int, text_hash string, vector array<float>")
    items, fresh = providers.embedded(rows, F.col("text"), cache, scripted.SeededEmbedder(4))
    assert fresh.count() == 2 and {r["status"] for r in items.collect()} == {"embedded"}
    more = rows.union(spark.createDataFrame([("d", "three")], rows.schema))
    items, again = providers.embedded(more, F.col("text"), fresh, scripted.SeededEmbedder(4))
    assert again.count() == 1 and items.where("status = 'reused'").count() == 3


def test_text_goldens(spark):
    """Nulls and empty lists leave no line, lists are joined, and a template's unknown names are empty."""
    row = spark.createDataFrame([("Kettle", "It whistles at night", ["kitchen", "noise"], None)], "title string, text string, tags array<string>, color string")
    fields = {"name": F.col("title"), "body": F.col("text"), "color": F.col("color"), "tags": tx.joined(F.col("tags"))}
    assert row.select(tx.rendered_fields(fields)).first()[0] == "name: Kettle\nbody: It whistles at night\ntags: kitchen, noise"
    assert row.select(tx.rendered_template("<{name}> {nothing}/{tags}", fields)).first()[0] == "<Kettle> /kitchen, noise"


def test_utf16_slices(spark):
    rows = spark.createDataFrame([("a😀bc", p, n) for p, n in ((0, 1), (1, 2), (2, 1), (1, 1), (3, 2), (4, 2), (0, 0))], "t string, p int, n int")
    got = [tuple(r[0]) for r in rows.select(tx.utf16_slice(F.col("t"), F.col("p"), F.col("n"))).collect()]
    split = "splits a surrogate pair"
    assert got == [("a", None), ("😀", None), (None, split), (None, split), ("bc", None), (None, "out of range"), ("", None)]


def test_a_worker_holds_few_rows_at_once():
    batches = [pd.DataFrame({"id": range(lo, lo + n)}) for lo, n in ((0, 10_000), (10_000, 0), (10_000, 3))]
    cut = list(vx._slices(iter(batches)))
    assert max(map(len, cut)) <= vx.SLICE_ROWS and min(map(len, cut)) > 0
    assert pd.concat(cut)["id"].tolist() == list(range(10_003))


def test_a_norm_is_worked_out_once(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<double>").select(vx.normalised(F.col("v")).alias("u"))
    assert [r["u"] for r in rows.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
    assert rows._jdf.queryExecution().analyzed().toString().lower().count("sqrt(") == 1


def test_a_question_goes_to_every_task(spark, sf, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as large tables are joined
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    plan = registry.queries()["x08_dot"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_vectors_move_once_to_where_blocks_meet(spark, planted):
    rows = vx._data(planted, "id", "vector").withColumn("cell", F.col("id") % 5)
    plan = vx._met(rows, rows, 3)._jdf.queryExecution()
    told = plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    dealt = [x for x in told.split("\n\n") if re.match(r"\s*\(\d+\) Exchange", x)]
    assert len(dealt) >= 2 and sum(bool(re.search(r"\b(v|a_v|b_v)#", x)) for x in dealt) <= 2  # one for each side


def test_chains_are_chosen_level_by_level(spark):
    rows = [(0, 1, None, None, 1.0, 1.0), (1, 2, 0, 1, 5.0, 2.0), (1, 3, 0, 1, 1.0, 3.0), (2, 4, 1, 3, 2.0, 4.0), (2, 5, 1, 3, 3.0, 7.0)]
    nodes = spark.createDataFrame(rows, "n_level int, n_part long, up_level int, up_part long, own double, top double")
    found = {r["n_part"]: (r["cluster"]["n_part"] if r["cluster"] else None, r["deep"]) for r in cl._chosen(nodes, [0, 1, 2], "eom", False).collect()}
    assert found == {1: (None, 7.0), 2: (2, 2.0), 3: (None, 7.0), 4: (4, 4.0), 5: (5, 7.0)}


def test_deep_chains_take_few_passes(spark, monkeypatch):
    """A tree of 60 levels is weighed and placed by bands of levels: a handful of tables and not two for each level; in bands of any size as in one."""
    rows = [(0, 0, None, None, 1.0, 1.0)]
    for level in range(1, 60):
        rows += [(level, 2 * level, level - 1, 2 * level - 2, float(level * 7 % 5), 1.0 + level), (level, 2 * level + 1, level - 1, 2 * level - 2, float(level % 3), 2.0 + level)]
    nodes = stored(spark.createDataFrame(rows, "n_level int, n_part long, up_level int, up_part long, own double, top double"), "nodes")
    made = []
    monkeypatch.setattr(cl, "stored", lambda df, what: made.append(what) or stored(df, what))
    found = [sorted(map(tuple, cl._chosen(nodes, list(range(60)), "eom", False).collect()))]
    assert len(made) <= 4 and len(found[0]) == 119
    for most in (1, 50):
        monkeypatch.setattr(cl, "BAND_CHAINS", most)
        found.append(sorted(map(tuple, cl._chosen(nodes, list(range(60)), "eom", False).collect())))
    assert found[0] == found[1] == found[2]


def test_a_level_of_cells_moves_no_row(spark, skewed, monkeypatch):
    """Rows go down the tree where they are, and find the same cells whether workers hold all centres at once or few."""
    data = stored(vx._data(skewed[0], "id", "vector"), "data")
    plans = []
    monkeypatch.setattr(vx, "replaced", lambda old, new, what: plans.append(new._jdf.queryExecution().executedPlan().toString()) or stored(new, what))
    whole = sorted(map(tuple, vx.cell_tree(data, 6).select("id", "cell", "rank").collect()))
    assert plans and not any("Exchange" in x for x in plans)
    monkeypatch.setattr(vx, "HELD_BYTES", 1000)
    assert sorted(map(tuple, vx.cell_tree(data, 6).select("id", "cell", "rank").collect())) == whole


@pytest.mark.parametrize("most", [7, 32_000])
def test_asked_cells_against_brute_force(spark, skewed, monkeypatch, most):
    """Of the cells that each row asks the k best rows, ties to the smaller; a cell that many ask comes to several workers; ids that are no numbers too."""
    monkeypatch.setattr(vx, "ASK_ROWS", most)
    rows, v = skewed
    data = rows.select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"), F.col("vector").alias("v"), (F.col("id") % 40).alias("cell")).where("id < 'r00800'")
    asked = data.withColumn("cell", F.explode(F.array("cell", (F.col("cell") + 1) % 40)))
    got = neighbour_lists(vx._merged(vx._asked(asked, data, 9), 9))
    sim = v[:800] @ v[:800].T
    for i in range(0, 800, 13):
        among = [j for j in range(800) if j != i and (j - i) % 40 in (0, 1)]
        assert got[f"r{i:05d}"] == [f"r{j:05d}" for j in sorted(among, key=lambda j: (-round(sim[i, j], 12), j))[:9]]  # noqa: B023
    assert len(got) == 800


def test_runs_stay_whole():
    batches = [pa.RecordBatch.from_pydict({"k": x, "v": x}) for x in ([1, 1, 2], [2], [], [2, 2], [3], [4, 4, 5])]
    cut = [x.column(0).to_pylist() for x in vx.whole_runs(iter(batches))]
    assert sum(cut, []) == [1, 1, 2, 2, 2, 2, 3, 4, 4, 5]
    assert all(a[-1] != b[0] for a, b in zip(cut, cut[1:], strict=False))


def test_hashed_words(spark):
    """Each word's axis and sign, summed and brought to unit length."""
    texts = ["a b b 7", "B, zz-zz!", "", None, "ünï", *(f"w{i} w{i % 3}" for i in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for i, got in vx.hashed(rows, 8).collect():
        want = np.zeros(8)
        for word in re.findall("[a-z0-9]+", (texts[i] or "").lower()):
            h = hashlib.md5(word.encode()).hexdigest()
            want[int(h[:3], 16) % 8] += 1 if h[3] < "8" else -1
        assert got == pytest.approx((want / (np.linalg.norm(want) or 1)).tolist())
