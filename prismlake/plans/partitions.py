"""Comparison of two clusterings of the vectors: the given labels and the nearest centroid, the latter with noise."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import granularity_band, stability_band
from ..operators import partition as P
from ..session import cut
from ..tables import table


def _labels(spark, sf):
    """(a, b) per vector: the given label, and one shifted by a hash of the id; one in eleven is noise on either side."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    a = F.when(F.col("vec_id") % 11 == 0, -1).otherwise(F.col("label"))
    b = F.when(F.col("vec_id") % 7 == 0, -1).when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 10).otherwise(9 - F.col("label"))
    return e.select("vec_id", a.cast("int").alias("a"), b.cast("int").alias("b"))


def _counts(spark, sf):
    return cut(_labels(spark, sf).groupBy("a", "b").agg(F.count("*").alias("observed")))  # labels x labels rows, read several times


def contingency_noise(spark, sf):
    return _counts(spark, sf)


def cluster_overlap_edges(spark, sf):
    return P.overlap_edges(_counts(spark, sf), 0.30).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


def best_match_jaccard(spark, sf):
    return P.best_match(_counts(spark, sf)).select("a", "b", F.round("jaccard", 9).alias("jaccard"), F.round("recall", 9).alias("recall"))


def modal_overlap(spark, sf):
    return P.modal_overlap(_counts(spark, sf)).select("a", "b", "n", F.round("jaccard", 9).alias("jaccard"))


def partition_ari(spark, sf):
    return P.rand_index(_counts(spark, sf)).select(F.round("ari", 9).alias("ari"), "papers")


def partition_ari_assigned(spark, sf):
    """Over the rows that neither side calls noise."""
    return P.rand_index(_counts(spark, sf).where("a <> -1 AND b <> -1")).select(F.round("ari", 9).alias("ari"), "papers")


def partition_ami(spark, sf):
    return spark.createDataFrame([(round(P.mutual_information(_counts(spark, sf)), 9),)], "ami double")


def mapped_agreement(spark, sf):
    return P.mapped_agreement(_counts(spark, sf)).select(F.round("mapped_agreement", 9).alias("mapped_agreement"), F.round("noise_agreement", 9).alias("noise_agreement"))


def optimal_mapping(spark, sf):
    return spark.createDataFrame(sorted(P.optimal_mapping(_counts(spark, sf)).items()), "b int, a int")


def jaccard_summary(spark, sf):
    return P.jaccard_summary(_counts(spark, sf)).select(*[F.round(c, 9).alias(c) for c in ("jaccard_mean", "jaccard_median", "jaccard_weighted")])


def cluster_summary(spark, sf):
    s = P.cluster_summary(_labels(spark, sf).select(F.col("a").alias("label")))
    return s.select("papers", "cluster_count", "noise_count", F.round("noise_pct", 6).alias("noise_pct"), F.round("coverage", 9).alias("coverage"), "size_min", "size_median", "size_max", F.round("size_gini", 9).alias("size_gini"))


def membership_summary(spark, sf):
    """Membership from the first place of a vector, persistence from its mean in the cluster."""
    e = table(spark, sf, "embeddings").join(_labels(spark, sf).select("vec_id", F.col("a").alias("own")), "vec_id").select(F.col("own").alias("label"), F.round(F.abs(F.col("embedding")[0].cast("double")), 6).alias("membership"))
    s = P.membership_summary(e, e.where("label <> -1").groupBy("label").agg(F.round(F.avg("membership"), 6).alias("persistence")))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def partition_filter(spark, sf):
    """Sources whose number of documents in a year lies in the range of usable cluster counts."""
    d = table(spark, sf, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count_distinct("pub_year").alias("k"))
    return d.where(F.col("k").between(5, 250)).select("source", "k", granularity_band(F.col("k")).alias("band"))


def _runs(spark, sf):
    """A run per (ship mode like group): lineitem suppliers as runs of a study, one value per order key bucket."""
    l = table(spark, sf, "lineitem")
    return l.groupBy((F.col("l_suppkey") % 12).alias("run"), (F.col("l_linenumber")).alias("dimension")).agg(F.count("*").alias("clusters"), F.round(F.avg("l_discount") * 10, 9).alias("ari"), F.round(100 * F.avg("l_tax"), 9).alias("noise_pct"))


def run_summary(spark, sf):
    r = _runs(spark, sf)
    return r.groupBy("dimension").agg(
        F.percentile("clusters", 0.5).alias("clusters_median"), F.min("clusters").alias("clusters_min"), F.max("clusters").alias("clusters_max"),
        F.round(F.avg("ari"), 6).alias("ari_mean"), F.round(F.percentile("ari", 0.5), 6).alias("ari_median"), F.round(F.min("ari"), 6).alias("ari_min"),
        F.round(F.percentile("noise_pct", 0.1), 6).alias("noise_q10"), F.round(F.percentile("noise_pct", 0.9), 6).alias("noise_q90"),
    )


def percentile_interval(spark, sf):
    """95 % interval of the runs' values by linear interpolation."""
    r = _runs(spark, sf)
    return r.groupBy("dimension").agg(F.round(F.percentile("ari", 0.025), 6).alias("low"), F.round(F.percentile("ari", 0.975), 6).alias("high"))


def stability_bands(spark, sf):
    return _runs(spark, sf).select("dimension", "run", stability_band(F.col("ari") * 1.5).alias("band"))


def cluster_stability(spark, sf):
    """Each label of the vectors over four relabelled runs, some of whose members are noise."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    runs = [F.struct(F.lit(m).alias("run"), F.when(F.col("vec_id") % (m + 4) == 0, -1).when(F.col("vec_id") % m == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("b")) for m in (2, 3, 5, 8)]
    counts = e.select(F.col("label").alias("a"), F.inline(F.array(*runs))).groupBy("run", "a", "b").agg(F.count("*").alias("observed"))
    s = P.cluster_stability(counts)
    return s.select("a", "runs", "size", *[F.round(c, 9).alias(c) for c in ("jaccard_mean", "jaccard_median", "jaccard_min", "low", "high")], "band")


def resampling_summary(spark, sf):
    """Means over all runs and over those that did not collapse, with the number of collapsed ones."""
    r = _runs(spark, sf).withColumn("k", F.col("clusters") % 9)
    return r.groupBy("dimension").agg(F.count_if(F.col("k") < 5).alias("collapsed"), F.round(F.avg("ari"), 6).alias("ari_mean"), F.round(F.avg(F.when(F.col("k") >= 5, F.col("ari"))), 6).alias("ari_kept"), F.round(F.percentile("ari", 0.1), 6).alias("ari_q10"))


def _pair_runs(spark, sf):
    r = _runs(spark, sf).groupBy("run").agg(F.avg("ari").alias("x"))
    return r.alias("l").join(r.alias("r"), F.col("l.run") < F.col("r.run")).select(F.col("l.run").alias("left_run"), F.col("r.run").alias("right_run"), F.round(1 - F.abs(F.col("l.x") - F.col("r.x")), 6).alias("ari"))


def run_pairs(spark, sf):
    return _pair_runs(spark, sf)


def medoid_run(spark, sf):
    return P.medoid(_pair_runs(spark, sf)).select("run", F.round("mean_ari", 6).alias("mean_ari"))


def per_paper_agreement(spark, sf):
    """Share of three relabelled runs that agree with the reference label of each vector; the reference counts as one."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    runs = [F.when(F.col("vec_id") % m == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")) for m in (3, 5, 8)]
    same = sum(((r == F.col("label")).cast("int") for r in runs), F.lit(1))
    return e.select("vec_id", F.round(same / 4.0, 6).alias("agreement"))


def consensus(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    votes = None
    for m in (3, 5, 8):  # a vector takes part in most, not all, resamples
        v = e.where(F.col("vec_id") % 4 != m % 4).select(F.col("vec_id").alias("paper"), F.col("label").alias("cluster"), (F.col("vec_id") % m != 0).alias("correct"))
        votes = v if votes is None else votes.unionAll(v)
    return P.consensus(votes).select("cluster", "papers", F.round("consistency", 6).alias("consistency"), F.round("low_pct", 6).alias("low_pct"), F.round("p10", 6).alias("p10"))


def pareto_front(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (-F.col("s_acctbal")).alias("cost"), (F.col("s_suppkey") % 17).alias("quality"))
    return P.pareto(s, "s_suppkey", ["quality"], ["cost"]).select("s_suppkey", "front")


_L = """WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 11 = 0 THEN -1 ELSE label END AS INT) AS a,
 CAST(CASE WHEN vec_id % 7 = 0 THEN -1 WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE 9 - label END AS INT) AS b FROM embeddings),
t AS (SELECT a, b, count(*) AS observed FROM e GROUP BY ALL),
ra AS (SELECT a, sum(observed) AS sa FROM t GROUP BY 1), cb AS (SELECT b, sum(observed) AS sb FROM t GROUP BY 1),
j AS (SELECT a, b, observed, sa, sb, observed::DOUBLE / (sa + sb - observed) AS jac FROM t JOIN ra USING (a) JOIN cb USING (b) WHERE a <> -1 AND b <> -1),
best AS (SELECT ra.a, coalesce(j.b, (SELECT min(b) FROM t WHERE b <> -1)) AS b, coalesce(jac, 0.0::DOUBLE) AS jac, coalesce(observed::DOUBLE / ra.sa, 0.0::DOUBLE) AS recall, ra.sa FROM ra
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY a ORDER BY jac DESC, b) AS rn FROM j) j ON j.a = ra.a AND rn = 1 WHERE ra.a <> -1)
"""
_ARI = """SELECT round(coalesce((pab - pa * pb / (n * (n - 1) / 2)) / nullif((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2), 0), 1.0::DOUBLE), 9) AS ari, CAST(n AS BIGINT) AS papers FROM
 (SELECT sum(observed * (observed - 1) / 2.0)::DOUBLE AS pab, sum(observed)::DOUBLE AS n FROM t0) CROSS JOIN
 (SELECT sum(s * (s - 1) / 2.0)::DOUBLE AS pa FROM (SELECT sum(observed)::DOUBLE AS s FROM t0 GROUP BY a)) CROSS JOIN (SELECT sum(s * (s - 1) / 2.0)::DOUBLE AS pb FROM (SELECT sum(observed)::DOUBLE AS s FROM t0 GROUP BY b))"""
_R = """WITH r AS (SELECT l_suppkey % 12 AS run, l_linenumber AS dimension, count(*) AS clusters, round(avg(l_discount) * 10, 9) AS ari, round(100 * avg(l_tax), 9) AS noise_pct FROM lineitem GROUP BY ALL),
x AS (SELECT run, avg(ari) AS x FROM r GROUP BY 1), p AS (SELECT l.run AS left_run, q.run AS right_run, round(1 - abs(l.x - q.x), 6) AS ari FROM x l JOIN x q ON l.run < q.run)
"""

QUERIES = {f.__name__: f for f in (
    contingency_noise, cluster_overlap_edges, best_match_jaccard, modal_overlap, partition_ari, partition_ari_assigned, partition_ami, mapped_agreement, optimal_mapping,
    jaccard_summary, cluster_summary, membership_summary, partition_filter, run_summary, percentile_interval, stability_bands, cluster_stability, resampling_summary, run_pairs, medoid_run, per_paper_agreement, consensus, pareto_front,
)}
SQL = {
    "contingency_noise": _L + "SELECT * FROM t",
    "cluster_overlap_edges": _L + "SELECT a, b, round(jac, 9) AS jaccard FROM j WHERE jac >= 0.30",
    "best_match_jaccard": _L + "SELECT a, b, round(jac, 9) AS jaccard, round(recall, 9) AS recall FROM best",
    "modal_overlap": _L + "SELECT ra.a, coalesce(j.b, -1) AS b, coalesce(observed, 0) AS n, round(coalesce(jac, 0.0::DOUBLE), 9) AS jaccard FROM ra LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY a ORDER BY observed DESC, b) AS rn FROM j) j ON j.a = ra.a AND rn = 1 WHERE ra.a <> -1",
    "partition_ari": _L + ", t0 AS (SELECT * FROM t) " + _ARI,
    "partition_ari_assigned": _L + ", t0 AS (SELECT * FROM t WHERE a <> -1 AND b <> -1) " + _ARI,
    "jaccard_summary": _L + "SELECT round(avg(jac), 9) AS jaccard_mean, round(quantile_cont(jac, 0.5), 9) AS jaccard_median, round(sum(jac * sa) / sum(sa), 9) AS jaccard_weighted FROM best",
    "cluster_summary": _L + """, s AS (SELECT a, count(*) AS s FROM e GROUP BY 1), k AS (SELECT s FROM s WHERE a <> -1)
SELECT (SELECT count(*) FROM e) AS papers, (SELECT count(*) FROM k) AS cluster_count, (SELECT count(*) FROM e WHERE a = -1) AS noise_count,
 round(100.0::DOUBLE * (SELECT count(*) FROM e WHERE a = -1) / (SELECT count(*) FROM e), 6) AS noise_pct, round(1.0::DOUBLE - (SELECT count(*) FROM e WHERE a = -1)::DOUBLE / (SELECT count(*) FROM e), 9) AS coverage,
 (SELECT min(s) FROM k) AS size_min, (SELECT quantile_cont(s, 0.5) FROM k) AS size_median, (SELECT max(s) FROM k) AS size_max,
 round((SELECT avg(abs(x.s - y.s)) FROM k x, k y) / (2 * (SELECT avg(s) FROM k)), 9) AS size_gini""",
    "partition_filter": "SELECT source, k, CASE WHEN k <= 30 THEN 'broad' WHEN k <= 60 THEN 'balanced' ELSE 'detailed' END AS band FROM (SELECT source, count(DISTINCT pub_year) AS k FROM documents WHERE source IS NOT NULL GROUP BY 1) WHERE k BETWEEN 5 AND 250",
    "run_summary": _R + """SELECT dimension, quantile_cont(clusters, 0.5) AS clusters_median, min(clusters) AS clusters_min, max(clusters) AS clusters_max, round(avg(ari), 6) AS ari_mean, round(quantile_cont(ari, 0.5), 6) AS ari_median,
 round(min(ari), 6) AS ari_min, round(quantile_cont(noise_pct, 0.1), 6) AS noise_q10, round(quantile_cont(noise_pct, 0.9), 6) AS noise_q90 FROM r GROUP BY 1""",
    "percentile_interval": _R + "SELECT dimension, round(quantile_cont(ari, 0.025), 6) AS low, round(quantile_cont(ari, 0.975), 6) AS high FROM r GROUP BY 1",
    "membership_summary": """WITH e AS (SELECT label, round(abs(embedding[1]::DOUBLE), 6) AS m FROM embeddings WHERE vec_id % 11 <> 0), p AS (SELECT label, count(*) AS s, round(avg(m), 6) AS p FROM e GROUP BY 1)
 SELECT (SELECT round(avg(m), 6) FROM e) AS membership_mean, (SELECT round(median(m), 6) FROM e) AS membership_median, (SELECT round(avg(p), 6) FROM p) AS persistence_mean,
 (SELECT round(median(p), 6) FROM p) AS persistence_median, (SELECT round(sum(s * p) / sum(s), 6) FROM p) AS persistence_weighted""",
    "cluster_stability": """WITH c AS (SELECT run, label AS a, CASE WHEN vec_id % (run + 4) = 0 THEN -1 WHEN vec_id % run = 0 THEN (label + 1) % 10 ELSE label END AS b, count(*) AS n FROM embeddings CROSS JOIN (VALUES (2), (3), (5), (8)) r(run) GROUP BY ALL),
 j AS (SELECT run, a, b, n::DOUBLE / (sum(n) OVER (PARTITION BY run, a) + sum(n) OVER (PARTITION BY run, b) - n) AS j, sum(n) OVER (PARTITION BY run, a) AS size FROM c),
 m AS (SELECT run, a, max(size) AS size, coalesce(max(j) FILTER (b <> -1), 0) AS j FROM j WHERE a <> -1 GROUP BY ALL),
 s AS (SELECT a, count(*) AS runs, CAST(max(size) AS BIGINT) AS size, avg(j) AS mean, median(j) AS med, min(j) AS low_j, quantile_cont(j, 0.025) AS lo, quantile_cont(j, 0.975) AS hi FROM m GROUP BY a)
 SELECT a, runs, size, round(mean, 9) AS jaccard_mean, round(med, 9) AS jaccard_median, round(low_j, 9) AS jaccard_min, round(lo, 9) AS low, round(hi, 9) AS high,
 CASE WHEN mean < 0.60 THEN 'below_0.60' WHEN mean < 0.75 THEN '0.60_to_0.75' WHEN mean < 0.85 THEN '0.75_to_0.85' ELSE 'at_least_0.85' END AS band FROM s""",
    "stability_bands": _R + "SELECT dimension, run, CASE WHEN ari * 1.5::DOUBLE < 0.60 THEN 'below_0.60' WHEN ari * 1.5::DOUBLE < 0.75 THEN '0.60_to_0.75' WHEN ari * 1.5::DOUBLE < 0.85 THEN '0.75_to_0.85' ELSE 'at_least_0.85' END AS band FROM r",
    "resampling_summary": _R + "SELECT dimension, count(*) FILTER (clusters % 9 < 5) AS collapsed, round(avg(ari), 6) AS ari_mean, round(avg(ari) FILTER (clusters % 9 >= 5), 6) AS ari_kept, round(quantile_cont(ari, 0.1), 6) AS ari_q10 FROM r GROUP BY 1",
    "run_pairs": _R + "SELECT * FROM p",
    "medoid_run": _R + "SELECT run, round(m, 6) AS mean_ari FROM (SELECT run, avg(ari) AS m FROM (SELECT left_run AS run, ari FROM p UNION ALL SELECT right_run, ari FROM p) GROUP BY 1) ORDER BY m DESC, run LIMIT 1",
    "per_paper_agreement": "SELECT vec_id, round((1 + CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END + CASE WHEN vec_id % 8 <> 0 THEN 1 ELSE 0 END) / 4.0::DOUBLE, 6) AS agreement FROM embeddings",
    "consensus": """WITH v AS (SELECT vec_id, label, m, CASE WHEN vec_id % m <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS ok FROM embeddings CROSS JOIN (VALUES (3), (5), (8)) x(m) WHERE vec_id % 4 <> m % 4),
 p AS (SELECT vec_id, label, avg(ok) AS c FROM v GROUP BY ALL)
 SELECT label AS cluster, count(*) AS papers, round(avg(c), 6) AS consistency, round(100.0::DOUBLE * count(*) FILTER (c < 0.5) / count(*), 6) AS low_pct, round(quantile_cont(c, 0.1), 6) AS p10 FROM p GROUP BY 1""",
    "pareto_front": """WITH s AS (SELECT s_suppkey, -s_acctbal AS cost, s_suppkey % 17 AS quality FROM supplier)
 SELECT s_suppkey, NOT EXISTS (SELECT 1 FROM s o WHERE o.quality >= m.quality AND o.cost <= m.cost AND (o.quality > m.quality OR o.cost < m.cost)) AS front FROM s m""",
}
