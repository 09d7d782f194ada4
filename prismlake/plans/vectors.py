"""Neighbours, centroids, purity and projection quality over the embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import vectors as V
from ..session import cut
from ..tables import table

K = 5


def _e(spark, sf):
    return table(spark, sf, "embeddings")


def _queries(spark, sf):
    return _e(spark, sf).where("vec_id % 20 = 0")


def normalised_vectors(spark, sf):
    return _e(spark, sf).select("vec_id", F.round(V.norm(V.normalised(F.col("embedding"))), 6).alias("norm"), F.round(V.normalised(F.col("embedding"))[0], 6).alias("first"))


def knn_exact(spark, sf):
    return V.knn(_e(spark, sf), _queries(spark, sf), K).select("query", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def knn_euclidean(spark, sf):
    return V.knn(_e(spark, sf), _queries(spark, sf), K, metric="euclidean").select("query", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def knn_approximate(spark, sf):
    """Rows only: found neighbours and their recall against the exact ones."""
    exact = V.knn(_e(spark, sf), _queries(spark, sf), K)
    return V.recall(exact, V.approximate_knn(_e(spark, sf), _queries(spark, sf), K), K)


def knn_recall_self(spark, sf):
    """Recall of the five nearest among the ten nearest by distance: 1 for unit vectors."""
    exact, other = V.knn(_e(spark, sf), _queries(spark, sf), K), V.knn(_e(spark, sf), _queries(spark, sf), 2 * K, metric="euclidean")
    return V.recall(exact, other, K).agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.min("recall"), 6).alias("min_recall"))


def without_self(spark, sf):
    """Neighbour lists with self and repeats taken out, order kept."""
    n = V.knn(_e(spark, sf), _queries(spark, sf), K).groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))), lambda s: s["neighbour"]).alias("n"))
    messy = n.select("query", F.concat(F.array("query"), "n", "n", F.array("query")).alias("n"))
    return messy.select("query", F.concat_ws(",", F.transform(V.without_self(F.col("n"), F.col("query"), 3), lambda x: x.cast("string"))).alias("first_three"))


def neighbour_overlap(spark, sf):
    """Overlap of the neighbours in the first and second half of the dimensions."""
    e = _e(spark, sf)
    half = lambda a: e.select("vec_id", F.slice("embedding", a, 32).alias("embedding"))
    q = lambda d: d.where("vec_id % 20 = 0")
    l, r = (V.knn(d, q(d), K).groupBy("query").agg(F.collect_list("neighbour").alias("n")) for d in (half(1), half(33)))
    o = l.withColumnRenamed("n", "ln").join(r, "query").select((F.size(F.array_intersect("ln", "n")) / float(K)).alias("o"))
    return o.agg(F.round(F.avg("o"), 6).alias("mean"), F.round(F.percentile("o", 0.5), 6).alias("median"), F.round(F.percentile("o", 0.05), 6).alias("q05"), F.round(F.percentile("o", 0.95), 6).alias("q95"))


def cluster_centroids(spark, sf):
    c = V.centroids(_e(spark, sf), "label")
    return c.select("label", F.posexplode("c").alias("i", "x")).where("i < 8").select("label", "i", F.round("x", 6).alias("x"))


def centroid_assign(spark, sf):
    e = _e(spark, sf)
    return V.nearest_centroid(e, V.centroids(e, "label"), "label").select("vec_id", "own", "nearest")


def centroid_margin(spark, sf):
    e = _e(spark, sf)
    return V.nearest_centroid(e, V.centroids(e, "label"), "label").select("vec_id", F.round("own_score", 6).alias("own_score"), F.round("other_score", 6).alias("other_score"), F.round("margin", 6).alias("margin"))


def centroid_accuracy(spark, sf):
    e = _e(spark, sf)
    n = V.nearest_centroid(e, V.centroids(e, "label"), "label")
    return n.groupBy("own").agg(F.round(F.avg((F.col("own") == F.col("nearest")).cast("double")), 6).alias("accuracy"), F.round(F.avg("own_score"), 6).alias("cohesion"), F.round(F.avg("margin"), 6).alias("margin"))


def representatives_top10(spark, sf):
    e = _e(spark, sf)
    return V.representatives(e, V.centroids(e, "label"), "label").select("label", F.col("place").cast("long").alias("place"), "vec_id", F.round("score", 6).alias("score"))


def _purity(spark, sf):
    labels = _e(spark, sf).select(F.col("vec_id").alias("id"), "label")
    return V.purity(V.knn(_e(spark, sf), _queries(spark, sf), K), labels)


def knn_purity_micro_macro(spark, sf):
    p = _purity(spark, sf)
    macro = p.groupBy("label").agg(F.avg("purity").alias("p")).agg(F.round(F.avg("p"), 6).alias("macro"))
    return p.agg(F.round(F.avg("purity"), 6).alias("micro")).crossJoin(macro)


def permutation_null(spark, sf):
    """Purity under a hundred permutations that keep label sizes: mean, sd, z and the empirical p. Hash streams have no SQL
    twin."""
    labels = _e(spark, sf).select(F.col("vec_id").alias("id"), "label")
    n = cut(V.knn(_e(spark, sf), _queries(spark, sf), K))
    seen = V.purity(n, labels).agg(F.avg("purity").alias("seen"))
    s = V.null_purity(n, labels, 100).crossJoin(seen).groupBy("seen").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count_if(F.col("x") >= F.col("seen")).alias("above"), F.count("*").alias("n"))
    return s.select(F.round("seen", 6).alias("seen"), F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(F.try_divide(F.col("seen") - F.col("mean"), F.col("sd")), 6).alias("z"), ((1 + F.col("above")) / (1 + F.col("n"))).alias("p"))


def _whole(spark, sf):
    return _e(spark, sf).select("vec_id", "label", "embedding", F.slice("embedding", 1, 3).alias("shown"))


def silhouette(spark, sf):
    s = V.silhouette(_whole(spark, sf), "vec_id", "embedding", "label")
    return s.groupBy("label").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"), F.count("*").alias("n"))


def trustworthiness(spark, sf):
    return V.trustworthiness(_whole(spark, sf), "vec_id", "embedding", "shown", K).select(F.round("trustworthiness", 6).alias("trustworthiness"), "n")


def distance_spearman(spark, sf):
    """Over 100,000 random pairs of all rows."""
    return V.spearman(V.pair_distances(_whole(spark, sf), "vec_id", "embedding", "shown", 100_000, "spearman"), "d", "e").select(F.round("rho", 6).alias("rho"))



def projection_agreement(spark, sf):
    """Mean neighbour overlap of all rows over all pairs of three projections (dimension triples)."""
    e = _e(spark, sf)
    lists = []
    for i in range(3):
        d = e.select("vec_id", F.slice("embedding", 1 + 3 * i, 3).alias("embedding"))
        lists.append(V.knn(d, d, K, metric="euclidean").groupBy("query").agg(F.collect_list("neighbour").alias(f"n{i}")))
    j = lists[0].join(lists[1], "query").join(lists[2], "query")
    o = sum((F.size(F.array_intersect(f"n{a}", f"n{b}")) / float(K) for a, b in ((0, 1), (0, 2), (1, 2))), F.lit(0.0)) / 3.0
    return j.agg(F.round(F.avg(o), 6).alias("agreement"))


def shape_balance(spark, sf):
    xyz = _e(spark, sf).select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return spark.createDataFrame([(round(V.shape_balance(xyz, ["x", "y", "z"]), 9),)], "balance double")


def array_differences(spark, sf):
    """Agreement of two stored arrays place by place: correlation, mean and largest difference."""
    e = _e(spark, sf).select("vec_id", F.posexplode("embedding").alias("i", "x"))
    other = e.select("vec_id", F.col("i").alias("j"), (F.col("x").cast("double") * 0.5 + F.col("i") * 0.001).alias("y"))
    j = e.join(other, (e["vec_id"] == other["vec_id"]) & (F.col("i") == F.col("j")))
    d = F.abs(F.col("x").cast("double") - F.col("y"))
    return j.agg(F.round(F.corr(F.col("x").cast("double"), F.col("y")), 6).alias("correlation"), F.round(F.avg(d), 6).alias("mean_difference"), F.round(F.max(d), 6).alias("max_difference"))


_N = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, v, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS u FROM e)"
_KNN = _N + f""", s AS (SELECT q.vec_id AS query, c.vec_id AS neighbour, round(list_dot_product(q.u, c.u), 9) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM s) WHERE rank <= {K})"""
_CENT = _N + """, p AS (SELECT label, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM u), ps AS (SELECT label, i, sum(x) AS x FROM p GROUP BY ALL), cl AS (SELECT label, list(x ORDER BY i) AS s FROM ps GROUP BY 1),
c AS (SELECT label, list_transform(s, lambda x: x / greatest(sqrt(list_dot_product(s, s)), 1e-12)) AS c FROM cl),
sc AS (SELECT u.vec_id, u.label AS own, c.label AS centroid, round(list_dot_product(u.u, c.c), 9) AS score FROM u CROSS JOIN c),
nc AS (SELECT vec_id, own, max(centroid) FILTER (place = 1) AS nearest, max(score) FILTER (own = centroid) AS own_score, max(score) FILTER (own <> centroid) AS other_score FROM
 (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, centroid) AS place FROM sc) GROUP BY ALL)"""
_D2 = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_PUR = _KNN + ", pu AS (SELECT query, o.label, avg(CASE WHEN o.label = n.label THEN 1.0 ELSE 0.0 END::DOUBLE) AS purity FROM kn JOIN embeddings o ON o.vec_id = query JOIN embeddings n ON n.vec_id = neighbour GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (
    normalised_vectors, knn_exact, knn_euclidean, knn_approximate, knn_recall_self, without_self, neighbour_overlap, cluster_centroids, centroid_assign, centroid_margin, centroid_accuracy, representatives_top10,
    knn_purity_micro_macro, permutation_null, silhouette, trustworthiness, distance_spearman, projection_agreement, shape_balance, array_differences,
)}
SQL = {
    "normalised_vectors": _N + " SELECT vec_id, round(sqrt(list_dot_product(u, u)), 6) AS norm, round(u[1], 6) AS first FROM u",
    "knn_exact": _KNN + " SELECT query, neighbour, rank, round(score, 6) AS score FROM kn",
    "knn_euclidean": _N + f""", s AS (SELECT q.vec_id AS query, c.vec_id AS neighbour, round({_D2('q.v', 'c.v')}, 9) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
 SELECT query, neighbour, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, neighbour) AS rank FROM s) WHERE rank <= {K}""",
    "without_self": _KNN + " SELECT query, string_agg(CAST(neighbour AS VARCHAR), ',' ORDER BY rank) AS first_three FROM kn WHERE rank <= 3 GROUP BY 1",
    "cluster_centroids": _CENT + " SELECT label, CAST(i - 1 AS INT) AS i, round(x, 6) AS x FROM (SELECT label, generate_subscripts(c, 1) AS i, unnest(c) AS x FROM c) WHERE i <= 8",
    "centroid_assign": _CENT + " SELECT vec_id, own, nearest FROM nc",
    "centroid_margin": _CENT + " SELECT vec_id, round(own_score, 6) AS own_score, round(other_score, 6) AS other_score, round(own_score - other_score, 6) AS margin FROM nc",
    "centroid_accuracy": _CENT + " SELECT own, round(avg(CASE WHEN own = nearest THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS accuracy, round(avg(own_score), 6) AS cohesion, round(avg(own_score - other_score), 6) AS margin FROM nc GROUP BY 1",
    "representatives_top10": _CENT + " SELECT own AS label, place, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS place FROM sc WHERE own = centroid AND own >= 0) WHERE place <= 10",
    "knn_purity_micro_macro": _PUR + " SELECT (SELECT round(avg(purity), 6) FROM pu) AS micro, (SELECT round(avg(p), 6) FROM (SELECT avg(purity) AS p FROM pu GROUP BY label)) AS macro",
    "silhouette": _N + f""", s AS (SELECT * FROM e), d AS (SELECT a.vec_id AS x, a.label AS lx, b.label AS ly, avg(sqrt({_D2('a.v', 'b.v')})) AS d FROM s a JOIN s b ON a.vec_id <> b.vec_id GROUP BY ALL),
 m AS (SELECT x, lx, max(d) FILTER (lx = ly) AS a, min(d) FILTER (lx <> ly) AS b FROM d GROUP BY ALL) SELECT lx AS label, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n FROM m GROUP BY 1""",
    "trustworthiness": _N + f""", s AS (SELECT vec_id, v, v[1:3] AS t FROM e), d AS (SELECT a.vec_id AS x, b.vec_id AS y, round({_D2('a.v', 'b.v')}, 9) AS ds, round({_D2('a.t', 'b.t')}, 9) AS dt FROM s a JOIN s b ON a.vec_id <> b.vec_id),
 r AS (SELECT x, row_number() OVER (PARTITION BY x ORDER BY ds, y) AS rs, row_number() OVER (PARTITION BY x ORDER BY dt, y) AS rt FROM d), n AS (SELECT count(*)::DOUBLE AS n FROM s)
 SELECT round(1.0::DOUBLE - 2.0::DOUBLE * sum(CASE WHEN rt <= {K} AND rs > {K} THEN rs - {K} ELSE 0 END) / (any_value(n) * {K} * (2.0::DOUBLE * any_value(n) - 3.0::DOUBLE * {K} - 1.0::DOUBLE)), 6) AS trustworthiness, CAST(any_value(n) AS BIGINT) AS n FROM r CROSS JOIN n""",
    "distance_spearman": _N + f""", s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS number, v, v[1:3] AS t FROM e), c AS (SELECT count(*) AS n FROM s),
 q AS (SELECT CAST('0x' || substr(sha256('spearman:l:' || i), 1, 13) AS BIGINT) % c.n AS l, CAST('0x' || substr(sha256('spearman:r:' || i), 1, 13) AS BIGINT) % c.n AS r FROM range(100000) t(i) CROSS JOIN c),
 d AS (SELECT round({_D2('a.v', 'b.v')}, 6) AS d, round({_D2('a.t', 'b.t')}, 6) AS e FROM q JOIN s a ON a.number = q.l JOIN s b ON b.number = q.r WHERE q.l <> q.r),
 r AS (SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0::DOUBLE AS ry FROM d) SELECT round(corr(rx, ry), 6) AS rho FROM r""",
    "array_differences": """WITH e AS (SELECT generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), d AS (SELECT x, x * 0.5::DOUBLE + i * 0.001::DOUBLE AS y FROM e)
 SELECT round(corr(x, y), 6) AS correlation, round(avg(abs(x - y)), 6) AS mean_difference, round(max(abs(x - y)), 6) AS max_difference FROM d""",
}
