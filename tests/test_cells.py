"""Cells, pruned links, numbered ids and seeded draws against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import cells as C
from lodestone.operators import evaluate as E
from lodestone.operators import knowledge as K
from lodestone.operators import merge as M


def clustered(n, dims=12, groups=15, spread=0.15, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (groups, dims))
    return base[rng.integers(0, groups, n)] + rng.normal(0, spread, (n, dims))


def test_index_of_cells_is_exact_and_leaves_cells_out(spark, tmp_path):
    x = clustered(1500)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (None, x[0].tolist()), (6000, [0.0] * 12)], "id long, v array<double>")
    index = C.VectorIndex(spark, str(tmp_path / "cells")).build(rows, cell_rows=50)
    ids = [3, 70, 900, 1499]
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in ids] + [(9999, [0.0] * 12), (9998, None)], "query long, v array<double>")
    got = index.search(queries, 6).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for k in ids:
        s = np.round(u @ u[k], 6)
        s[k] = -9
        want = np.lexsort((np.arange(len(s)), -s))[:6]
        own = sorted((r["rank"], r["doc"], r["score"]) for r in got if r["query"] == k)
        assert [d for _, d, _ in own] == want.tolist() and np.allclose([s for *_, s in own], s[want], atol=2e-6)
    assert sum(r["query"] == 9999 for r in got) == 6  # all cosines are 0
    index.search(queries.where("query < 9000"), 6).collect()
    assert 0 < index.read_share < 0.7
    assert C.VectorIndex(spark, str(tmp_path / "none")).build(rows.limit(0)).search(queries, 3).count() == 0


def test_links_connect_what_all_pairs_do(spark):
    x = clustered(500, spread=0.05, groups=8, seed=3)
    names = [" ".join(np.random.default_rng(k).choice(["red", "black", "tree", "heap", "list"], 2)) for k in range(500)]
    rows = [(k, "ab"[k % 2] if k % 9 else None, names[k], v.tolist()) for k, v in enumerate(x)] + [(600, "a", None, x[0].tolist()), (601, "a", "x", None), (602, "a", "x", [0.0] * 12)]
    reps = spark.createDataFrame(rows, "id long, block string, name string, v array<double>").repartition(3)
    pairs = M.similar_pairs(reps.withColumn("block", F.coalesce("block", F.lit("none"))).withColumn("name", F.coalesce("name", F.lit(""))), 0.95)
    want = sorted(map(tuple, K.components(pairs).collect()))
    for tile in (1024, 12):
        links = C.similar_links(reps, 0.95, tile)
        assert sorted(map(tuple, K.components(links).collect())) == want
    assert links.count() < pairs.count()
    placed, meets = C.tiles(reps.where("id < 500").select("id", F.coalesce("block", F.lit("")).alias("block"), "name", "v"), 0.95, 6)
    whole = placed.groupBy("block").agg(F.countDistinct("tile", "part").alias("n")).agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0]
    assert meets.count() < 0.7 * whole  # decided before vectors are shuffled
    with pytest.raises(ValueError):
        C.similar_links(reps, 0.0)


def test_contrasts_in_tasks_are_the_columns_own(spark):
    words = ["tree", "red tree", "red black tree", "black tree tree", "", "red", "tree red", "heap list", None]
    rows = [(a, b) for a in words for b in words if a is not None and b is not None]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.contrast("a", "b").alias("c")).collect()
    assert all(C.contrasts(r["a"], r["b"]) == r["c"] for r in got) and not C.contrasts(None, "red")


def test_ids_of_clashing_names(spark):
    names = ["c", "c++", "c 2", "C#", "heap", "heap", "c 2 2", "c-3", "list 2", "list", "list"]
    got = {r["group"]: r["id"] for r in M.numbered_ids(spark.createDataFrame([*enumerate(names)], "group long, name string")).collect()}
    slugs = [r[0] for r in sorted(spark.createDataFrame([*enumerate(names)], "k int, name string").select(F.struct("k", T.slug("name").alias("s")).alias("x")).selectExpr("x.s", "x.k").collect(), key=lambda r: r[1])]
    used, want = set(), {}
    for k, slug in enumerate(slugs):
        own, n = slug, 2
        while own in used:
            own, n = f"{slug}-{n}", n + 1
        used.add(own)
        want[k] = own
    assert got == want and len(set(got.values())) == len(names)


def test_concepts_whose_slugs_clash_are_merged(spark):
    rows = [(k, k, 0, n, [], "t", n, 0.5, None) for k, n in enumerate(["c", "c++", "c 2"])]
    items = spark.createDataFrame(rows, "pos long, chunk long, source long, name string, aliases array<string>, type string, definition string, confidence double, start double")
    concepts, mentions, _ = M.merge_concepts(items)
    assert len({r["id"] for r in concepts.collect()}) == concepts.count() == mentions.select("concept").distinct().count() == 3


@pytest.mark.parametrize("draw", ["choices", "randrange"])
def test_seeded_draws_are_pythons(spark, draw):
    rng = np.random.default_rng(0)
    rows = [(f"g{k % 7}", int(rng.integers(-1, 2))) for k in range(60)]
    got = E.seeded_bootstrap(spark.createDataFrame(rows, "cluster string, value int").withColumn("size", F.lit(1)), 300, 0, draw).first()
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    keys, r, means = sorted(by), random.Random(0), []
    for _ in range(300):
        drawn = r.choices(keys, k=len(keys)) if draw == "choices" else [keys[r.randrange(len(keys))] for _ in keys]
        own = [v for g in drawn for v in by[g]]
        means.append(sum(own) / len(own))
    means.sort()
    assert (got["low"], got["high"]) == pytest.approx((means[7], means[291])) and got["mean"] == pytest.approx(sum(v for _, v in rows) / 60)
    assert E.seeded_bootstrap(spark.createDataFrame([], "cluster string, value int, size int")).count() == 0
