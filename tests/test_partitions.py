"""Partition comparison, association, Pareto front, names, colours and density clustering on small cases."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prismlake.functions.numeric import STABILITY, granularity_band, neighbour_count, stability_band
from prismlake.operators import association as A
from prismlake.operators import colours as K
from prismlake.operators import models as M
from prismlake.operators import naming as N
from prismlake.operators import partition as P


def table(spark, a, b):
    return spark.createDataFrame(list(zip(a, b)), "a int, b int").groupBy("a", "b").agg(F.count("*").alias("observed"))


def brute_best(a, b):
    """For each cluster of a: the most similar of b by sets, its Jaccard and the share of a it holds."""
    out = {}
    for x in sorted(set(a) - {-1}):
        own = {i for i, v in enumerate(a) if v == x}
        sets = {y: {i for i, v in enumerate(b) if v == y} for y in sorted(set(b) - {-1})}
        y = max(sets, key=lambda k: (len(own & sets[k]) / len(own | sets[k]), -k))
        out[x] = (y, pytest.approx(len(own & sets[y]) / len(own | sets[y])), pytest.approx(len(own & sets[y]) / len(own)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_best_match_is_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-1, 5, 90).tolist(), rng.integers(-1, 4, 90).tolist()
    got = {r["a"]: (r["b"], r["jaccard"], r["recall"]) for r in P.best_match(table(spark, a, b)).collect()}
    assert got == brute_best(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_other_names_for_the_same_clusters(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-1, 6, 120).tolist()
    new = dict(zip(range(6), (rng.permutation(6) + 20).tolist())) | {-1: -1}
    t = table(spark, a, [new[x] for x in a])
    assert P.rand_index(t).first()["ari"] == pytest.approx(1) and P.mutual_information(t) == pytest.approx(1)
    assert P.mapped_agreement(t).first()["mapped_agreement"] == 1 and P.jaccard_summary(t).first()["jaccard_weighted"] == 1
    assert P.optimal_mapping(t) == {new[x]: x for x in set(a) - {-1}}


def test_agreement_of_unequal_noise(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 3, 200)
    b = np.where(rng.random(200) < 0.3, -1, a)
    r = P.mapped_agreement(table(spark, a.tolist(), b.tolist())).first()
    assert r["mapped_agreement"] == pytest.approx((b >= 0).mean()) and r["noise_agreement"] == pytest.approx((b >= 0).mean())
    assert P.optimal_mapping(table(spark, [-1], [-1])) == {}


def test_assign_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for n, m in ((4, 4), (3, 5), (5, 3)):
        c = rng.random((n, m))
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(rows, cols)) for rows in permutations(range(n), k) for cols in permutations(range(m), k))
        got = P.assign(c)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == k
        assert sum(c[i, j] for i, j in got) == pytest.approx(best)


def test_pareto_is_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (40, 2)).tolist()
    want = {i: not any(p[0] >= q[0] and p[1] <= q[1] and p != q for p in x) for i, q in enumerate(x)}
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k int, gain double, cost double")
    assert {r["k"]: r["front"] for r in P.pareto(rows, "k", ["gain"], ["cost"]).collect()} == want


def test_bands(spark):
    edges = [(c + d,) for c in (0.60, 0.75, 0.85) for d in (-1e-9, 0.0)] + [(None,)]
    got = [r[0] for r in spark.createDataFrame(edges, "j double").coalesce(1).select(stability_band(F.col("j"))).collect()]
    assert got == [STABILITY[0], STABILITY[1], STABILITY[1], STABILITY[2], STABILITY[2], STABILITY[3], None]
    assert [r[0] for r in spark.createDataFrame([(30,), (31,), (60,), (61,)], "k int").coalesce(1).select(granularity_band(F.col("k"))).collect()] == ["broad", "balanced", "balanced", "detailed"]


def test_neighbour_count(spark):
    got = [r[0] for r in spark.createDataFrame([("7",), ("0",), ("999",), ("x",), (None,), ("-3",), ("12.9",)], "t string").select(neighbour_count(F.col("t"))).collect()]
    assert got == [7, 1, 50, 1, 1, 1, 12]


def test_association_identity(spark):
    t = table(spark, [0] * 50 + [1] * 50, [0] * 50 + [1] * 50)
    assert A.corrected_v(A.cells(t)).first()["v"] == pytest.approx(1, abs=0.02)


def test_association_symmetric(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, 300)
    b = (a + rng.integers(0, 2, 300)) % 5
    v = A.corrected_v(A.cells(table(spark, a.tolist(), b.tolist()))).first()["v"]
    w = A.corrected_v(A.cells(table(spark, b.tolist(), a.tolist()))).first()["v"]
    assert v == pytest.approx(w) and 0 < v < 1


def test_noise_kept_missing_dropped(spark):
    rng = np.random.default_rng(6)
    cluster, meta = rng.integers(-1, 3, 80).tolist(), rng.integers(-1, 4, 80).tolist()
    lenses = spark.createDataFrame([("c", "hdbscan"), ("m", "metadata")], "lens_id string, algorithm string")
    rows = [(i, "c", x) for i, x in enumerate(cluster)] + [(i, "m", x) for i, x in enumerate(meta)]
    cells = {(r["a"], r["b"]): r["observed"] for r in A.cells(A.contingency(A.eligible(spark.createDataFrame(rows, "paper int, lens_id string, label int"), lenses), "c", "m")).collect()}
    want = Counter((x, y) for x, y in zip(cluster, meta) if y >= 0)
    assert {k: v for k, v in cells.items() if v} == dict(want) and any(x == -1 for x, _ in want)


def test_density_two_blobs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (60, 2)), rng.normal(5, 0.1, (60, 2)), [[2.5, 30.0]]])
    labels, member, persistence = M.density_labels(x, 10, 5)
    assert set(labels[:60]) == {0} and set(labels[60:120]) == {1} and labels[120] == -1
    assert len(persistence) == 2 and ((0 <= member) & (member <= 1)).all()
    assert (M.density_labels(x[:5], 10, 5)[0] == -1).all()
    with pytest.raises(ValueError):
        M.density_labels(np.zeros((M.MAX_POINTS + 1, 2)), 10, 5)


def test_topic_names(spark):
    terms = {0: ["metaphysics", "metaphysic", "metaphysical", "ocr of scans"], 1: ["ai"], 2: ["ai", "artificial life", "court"], 3: ["court", "courts"]}
    rows = [(g, i, t) for g, ts in terms.items() for i, t in enumerate(ts, 1)]
    got = {r["group"]: r["name"] for r in N.topic_names(spark.createDataFrame(rows, "group int, place int, term string")).collect()}
    assert got == {0: "Metaphysics · OCR Of Scans", 1: "AI", 2: "AI · Court", 3: "Court"}


def test_inherited_names(spark):
    best = spark.createDataFrame([(3, "Ethics", 0.95), (1, "Ethics", 0.70), (2, "Law", 0.69), (4, None, None), (5, "Ethics", 0.8)], "group int, reference string, jaccard double")
    terms = spark.createDataFrame([(1, 1, "duty"), (3, 1, "duty"), (3, 2, "virtue"), (2, 1, "statute"), (5, 1, "duty")], "group int, place int, term string")
    got = {r["group"]: r["name"] for r in N.inherited_names(best, terms).collect()}
    assert got == {1: "Ethics", 2: "Statute", 3: "Ethics · Duty", 4: "Unlabelled topic", 5: "Ethics"}


def test_pool_like_the_standard_library(spark):
    import colorsys

    got = {r["place"]: r["colour"] for r in K.pool(spark, "#000000", 0.0).collect()}
    for place, c in got.items():
        row, hue = divmod(place, 360)
        want = colorsys.hls_to_rgb(hue / 360, K.LIGHTNESS[row // 3], K.SATURATION[row % 3])
        assert max(abs(int(c[k : k + 2], 16) - 255 * w) for k, w in zip((1, 3, 5), want)) <= 0.5 + 1e-6


def test_colours(spark):
    pool = K.pool(spark, "#101418", 3.0).toPandas()
    rows = pd.DataFrame([("l", 0, "x", 9), ("l", 1, "y", 5), ("r", 0, "x", 2), ("r", 1, "z", 1), ("s", 0, "w", 1)], columns=["lens", "label", "family", "size"])
    got = K.assign(rows, pool)
    assert set(got) == set("wxyz") and len(set(got.values())) == 4 and got["x"] == pool.sort_values("place")["colour"].iloc[0]
    with pytest.raises(ValueError):
        K.assign(rows.assign(family="x"), pool)
    with pytest.raises(ValueError):
        K.assign(rows, pool.head(2))


def test_medoid_and_gini(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.1)], "left_run string, right_run string, ari double")
    assert P.medoid(pairs).first()["run"] == "a"
    s = P.cluster_summary(spark.createDataFrame([(x,) for x in [0, 0, 0, 1, -1]], "label int")).first()
    assert s["noise_count"] == 1 and s["size_gini"] == pytest.approx(0.25) and s["coverage"] == pytest.approx(0.8)
    assert P.cluster_summary(spark.createDataFrame([(-1,)], "label int")).first()["cluster_count"] == 0


def test_interval(spark):
    x = np.random.default_rng(2).normal(size=41)
    r = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.percentile("x", 0.025), F.percentile("x", 0.975)).first()
    assert list(r) == pytest.approx(list(np.percentile(x, [2.5, 97.5])))
