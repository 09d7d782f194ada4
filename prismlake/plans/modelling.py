"""Models over the embeddings and titles. Streams of random numbers differ between engines, so most have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import granularity_band
from ..operators import colours as K
from ..operators import models as M
from ..operators import naming as N
from ..operators import partition as P
from ..operators import textstats as S
from ..operators import vectors as V
from ..tables import table
from .base import papers


def _e(spark, sf):
    return table(spark, sf, "embeddings")


def model_pca(spark, sf):
    """Variance along the first three components."""
    p = M.pca(_e(spark, sf), "vec_id", "embedding", 3)
    return p.select(F.posexplode("scores").alias("component", "x")).groupBy("component").agg(F.round(F.var_samp("x"), 6).alias("variance"), F.round(F.avg("x"), 6).alias("mean"))


def model_kmeans(spark, sf):
    k = M.kmeans(_e(spark, sf), "vec_id", "embedding", 10)
    return k.groupBy("label").agg(F.count("*").alias("n"))


def refit_agreement(spark, sf):
    """A fit repeated with the same seed against the first: their Rand index, the gate for keeping memberships."""
    a = M.kmeans(_e(spark, sf), "vec_id", "embedding", 10).withColumnRenamed("label", "a")
    b = M.kmeans(_e(spark, sf), "vec_id", "embedding", 10).withColumnRenamed("label", "b")
    r = P.rand_index(a.join(b, "vec_id").groupBy("a", "b").agg(F.count("*").alias("observed")))
    return r.select((F.col("ari") >= 0.98).alias("accepted"), (F.col("ari") >= 0.999).alias("keeps_memberships"))


def model_lda(spark, sf):
    """Topics of the titles: documents, leading terms and label of each topic."""
    docs = papers(spark, sf).select(F.col("paper_id").alias("doc"), "title")
    tf = S.counts(docs, "doc", S.word_list(F.col("title"), 4))
    vocab = [r["term"] for r in S.bounded(tf, docs.count(), 5, 0.5, 20_000).orderBy("term").collect()]
    model, feats = M.lda(tf, vocab, {"topics": 8, "alpha": 0.125, "eta": 0.125}, 3, 5)
    n = M.dominant(model, feats).groupBy("topic").agg(F.count("*").alias("documents"))
    terms = M.topic_terms(model, vocab, 10).select(F.col("topic").alias("group"), "place", "term")
    listed = terms.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda s: s["term"]).alias("t"))
    named = listed.join(N.topic_names(terms), "group").withColumnRenamed("group", "topic")
    return n.join(named, "topic").select("topic", "documents", F.concat_ws("; ", "t").alias("terms"), F.col("name").alias("label"))


def lda_configurations(spark, sf):
    g = spark.createDataFrame([(i, c["topics"], c["alpha"], c["eta"]) for i, c in enumerate(M.lda_grid())], "config int, topics int, alpha double, eta double")
    return g.groupBy(granularity_band(F.col("topics")).alias("band")).agg(F.count("*").alias("configurations"), F.min("topics").alias("least"), F.max("topics").alias("most"))


def density_grid(spark, sf):
    """Density clustering of three dimensions of the embeddings, all points, over a grid of parameters; raises above MAX_POINTS."""
    x = _e(spark, sf).select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])
    grid = spark.createDataFrame([(f"mcs{a}_ms{b}_{m}", a, b, m) for a in (8, 15) for b in (3, 5) for m in ("eom", "leaf")], "config string, min_size int, min_samples int, method string")
    runs = M.density_grid(x, "vec_id", ["x", "y", "z"], grid)
    return runs.groupBy("config").agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"), F.count_if(F.col("label") < 0).alias("noise"), F.count("*").alias("points"))


def finalists(spark, sf):
    runs = spark.createDataFrame([(f"c{i:02d}", c["topics"], float((i * 7919) % 101) / 100) for i, c in enumerate(M.lda_grid())], "config string, topics int, score double").withColumn("band", granularity_band(F.col("topics")))
    return M.pick_finalists(runs).select("band", "config", "score", F.col("place").cast("long").alias("place"))


def colour_families(spark, sf):
    """Colours of two clusterings' categories: strong overlaps share one."""
    e = _e(spark, sf).select(F.col("label").alias("a"), F.when(F.col("vec_id") % 13 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("b"))
    c = e.groupBy("a", "b").agg(F.count("*").alias("observed"))
    import pandas as pd

    edges = P.overlap_edges(c, 0.70).toPandas()
    comp = P.components_small(pd.DataFrame([(f"l{a}", f"r{b}") for a, b in edges[["a", "b"]].itertuples(index=False)], columns=["x", "y"]))
    sizes = c.groupBy(F.lit("l").alias("lens"), F.col("a").alias("label")).agg(F.sum("observed").alias("size")).unionAll(c.groupBy(F.lit("r").alias("lens"), F.col("b").alias("label")).agg(F.sum("observed").alias("size")))
    nodes = sizes.toPandas()  # categories of two lenses
    nodes["family"] = [comp.get(f"{l}{i}", f"{l}{i}") for l, i in zip(nodes["lens"], nodes["label"])]
    colours = K.assign(nodes, K.pool(spark, "#101418", 3.0).toPandas())
    return spark.createDataFrame([(l, int(i), colours[f]) for l, i, f in nodes[["lens", "label", "family"]].itertuples(index=False)], "lens_id string, label int, colour string")


def topic_stability(spark, sf):
    """Mean similarity of centroids matched one to one between two halves of the vectors."""
    import numpy as np

    halves = []
    for h in (0, 1):
        c = V.centroids(_e(spark, sf).where(f"vec_id % 2 = {h}"), "label").orderBy("label").toPandas()
        halves.append(np.array(c["c"].to_list()))
    return spark.createDataFrame([(round(M.topic_similarity(*halves), 6),)], "stability double")


QUERIES = {f.__name__: f for f in (model_pca, model_kmeans, refit_agreement, model_lda, lda_configurations, density_grid, finalists, colour_families, topic_stability)}
SQL = {
    "refit_agreement": "SELECT true AS accepted, true AS keeps_memberships",
    "lda_configurations": "SELECT * FROM (VALUES ('broad', 8::BIGINT, 10, 30), ('balanced', 11::BIGINT, 40, 60), ('detailed', 1::BIGINT, 80, 80)) v(band, configurations, least, most)",
    "finalists": """WITH c(i, topics) AS (VALUES (0,10),(1,15),(2,20),(3,30),(4,40),(5,50),(6,60),(7,80),(8,20),(9,20),(10,20),(11,20),(12,40),(13,40),(14,40),(15,40),(16,60),(17,60),(18,60),(19,60)),
 r AS (SELECT 'c' || lpad(CAST(i AS VARCHAR), 2, '0') AS config, CASE WHEN topics <= 30 THEN 'broad' WHEN topics <= 60 THEN 'balanced' ELSE 'detailed' END AS band, ((i * 7919) % 101)::DOUBLE / 100 AS score FROM c)
 SELECT band, config, score, place FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY score DESC, config) AS place FROM r) WHERE place <= 2""",
}
