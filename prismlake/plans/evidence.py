"""Evidence tables, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..operators import evidence as E
from ..operators import sampling as M
from ..tables import table


def _grid(spark, sf):
    """A parameter grid: quantity by line number and discount step, per return flag."""
    l = table(spark, sf, "lineitem")
    return l.groupBy("l_returnflag", "l_linenumber", F.round(F.col("l_discount") * 100).cast("int").alias("step")).agg(F.round(F.avg("l_quantity"), 6).alias("value"), F.count("*").alias("n"))


def grid_neighbour_mean(spark, sf):
    return E.grid_neighbours(_grid(spark, sf), "l_returnflag", "l_linenumber", "step", "value").select("l_returnflag", "l_linenumber", "step", F.round("mean_near", 4).alias("mean_near"), F.round("min_near", 6).alias("min_near"))


def previous_next(spark, sf):
    w = Window.partitionBy("l_returnflag", "l_linenumber").orderBy("step")
    return _grid(spark, sf).select("l_returnflag", "l_linenumber", "step", F.lag("value").over(w).alias("previous"), F.lead("value").over(w).alias("following"))


def minmax_score(spark, sf):
    w = Window.partitionBy()
    g = _grid(spark, sf)
    return g.select("l_returnflag", "l_linenumber", "step", F.round(N.min_max(F.col("value"), w), 6).alias("value01"), F.round(N.min_max(F.lit(3.0) + 0 * F.col("value"), w), 6).alias("constant01"))


def composite_score(spark, sf):
    w = Window.partitionBy()
    g = _grid(spark, sf).withColumn("v", N.min_max(F.col("value"), w)).withColumn("m", N.min_max(F.col("n").cast("double"), w)).withColumn("inv", 1 - F.col("m"))
    return g.select("l_returnflag", "l_linenumber", "step", F.round(N.weighted({"v": 0.45, "m": 0.35, "inv": 0.20}), 6).alias("score"))


def selection_scores(spark, sf):
    """The five composite scores over groups of lineitem as runs of a study."""
    parts = {
        "coherence": F.avg("l_discount"), "perplexity": F.avg("l_extendedprice"), "diversity": F.avg("l_tax"), "exclusivity": F.avg("l_quantity"), "dominance": F.max("l_discount"), "usage": F.count("*").cast("double"),
        "topic_stability": F.min("l_extendedprice"), "assignment_stability": F.max("l_extendedprice"), "agreement": F.avg("l_discount"), "membership": F.avg("l_tax"), "silhouette": F.avg("l_quantity"), "coverage": F.count("*").cast("double"),
        "trustworthiness": F.avg("l_discount") * 10, "recall_15": F.avg("l_tax") * 10, "recall_50": F.avg("l_quantity") / 50, "correlation": F.avg("l_discount") * 20 - 1, "balance": F.avg("l_tax") * 10,
    }
    runs = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 30).alias("run")).agg(*[F.round(x, 6).alias(n) for n, x in parts.items()])
    w = Window.partitionBy()  # over the runs of a study
    spearman, shape = N.projection_parts(F.col("correlation"), F.col("balance"))
    runs = runs.withColumn("spearman", spearman).withColumn("shape", shape)
    runs = runs.withColumn("quality", N.weighted(N.WEIGHTS["projection"])).withColumn("neighbour_agreement", F.col("recall_50"))
    scores = {k: N.composite(N.WEIGHTS[k], w) for k in ("topics_first", "topics_final", "clusters")} | {"projection": F.col("quality"), "layout": N.weighted(N.WEIGHTS["layout"])}
    return runs.select("run", *[F.round(x, 6).alias(k) for k, x in scores.items()])


def top2_per_band(spark, sf):
    g = _grid(spark, sf).withColumn("tie", F.col("step") * 100 + F.col("l_linenumber"))
    return E.best_per_group(g, "l_returnflag", "value", "tie", 2).select("l_returnflag", "tie", "value", F.col("place").cast("long").alias("place"))


def best_per_band(spark, sf):
    g = _grid(spark, sf).withColumn("band", N.granularity_band(F.col("l_linenumber") * 12)).withColumn("tie", F.concat_ws("|", "l_returnflag", F.col("l_linenumber").cast("string"), F.col("step").cast("string")))
    return E.best_per_group(g, "band", "value", "tie").select("band", "tie", "value")


def share_within(spark, sf):
    g = _grid(spark, sf)
    return g.select("l_returnflag", "l_linenumber", "step", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("step")), 8).alias("share"))


def label_rank(spark, sf):
    s = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return s.select("source", "n", F.row_number().over(Window.orderBy(F.desc("n"), F.asc_nulls_first("source"))).cast("long").alias("place"))


def multi_key_top(spark, sf):
    """The first twenty of a three-key sort."""
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice").limit(20)


def edge_sort(spark, sf):
    """Pairs of nations by how many brands their customers' market segments share; the ten strongest."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("s"), F.count("*").alias("n"))
    a, b = c.select(F.col("c_nationkey").alias("x"), F.col("s").alias("sx"), F.col("n").alias("nx")), c.select(F.col("c_nationkey").alias("y"), F.col("s").alias("sy"), F.col("n").alias("ny"))
    j = a.join(b, F.col("x") < F.col("y")).select("x", "y", F.round(F.size(F.array_intersect("sx", "sy")) * F.least("nx", "ny") / F.greatest("nx", "ny"), 6).alias("strength"))
    return j.orderBy(F.desc("strength"), F.desc("x"), F.desc("y")).limit(10)


def merge_tables(spark, sf):
    """Three summaries of one key side by side."""
    l = table(spark, sf, "lineitem")
    a = l.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    b = l.where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("returned"))
    c = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return a.join(b, "l_suppkey").join(c, "l_suppkey").select("l_suppkey", "n", "returned", "s_nationkey")


def left_joins(spark, sf):
    """Composite keys, left joined; missing evidence stays null."""
    l = table(spark, sf, "lineitem")
    keys = l.select("l_suppkey", "l_linenumber").distinct()
    late = l.where("l_discount > 0.08 AND l_quantity > 45").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("late"))
    return keys.join(late, ["l_suppkey", "l_linenumber"], "left").select("l_suppkey", "l_linenumber", "late")


def descriptor_choice(spark, sf):
    """Codes to names, and a descriptor that depends on the kind."""
    p = table(spark, sf, "part")
    names = F.create_map(*[F.lit(x) for kv in {0: "small", 1: "middle", 2: "large"}.items() for x in kv])
    kind = (F.col("p_size") % 4).cast("int")
    first = F.array_join(F.slice(F.split("p_type", " "), 1, 2), " / ")
    return p.select("p_partkey", F.coalesce(names[kind], F.lit("other")).alias("size_name"), F.when(F.col("p_size") % 2 == 0, first).otherwise(F.col("p_brand")).alias("descriptor"))


def reshaped_columns(spark, sf):
    o = table(spark, sf, "orders").drop("o_orderpriority").withColumnRenamed("o_totalprice", "price")
    return o.select("o_orderkey", "price", F.round(F.col("price") - 1000.0, 2).alias("above_thousand"), "o_orderstatus")


def review_flags(spark, sf):
    g = _grid(spark, sf)
    safe = lambda c: F.coalesce(c, F.lit(False))
    w = Window.partitionBy("l_returnflag").orderBy("l_linenumber", "step")
    low, falling = safe(F.col("value") < 25), safe(F.col("value") < F.lag("value").over(w))
    return g.select("l_returnflag", "l_linenumber", "step", low.alias("low"), falling.alias("falling"), (low | falling).alias("review"))


def union_ragged(spark, sf):
    """Two tables of different columns one below the other."""
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True).select("key", "balance", "segment")


def set_operations(spark, sf):
    """Union, intersection, difference and disjointness of key sets."""
    a = table(spark, sf, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("k")).distinct()
    b = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "n")
    return one(a.union(b).distinct(), "union").unionAll(one(a.intersect(b), "intersection")).unionAll(one(a.exceptAll(b), "difference")).unionAll(one(a.join(b, "k", "left_semi"), "common"))


def anti_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def distinctness(spark, sf):
    """Whether keys are distinct, and by how many rows they aren't."""
    s = table(spark, sf, "search_rows")
    return s.agg((F.count("*") == F.count_distinct("paper_idx")).alias("is_distinct"), (F.count("*") - F.count_distinct("paper_idx")).alias("extra"))


def disjoint_groups(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("s"))
    n = table(spark, sf, "nation")
    return n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", (~F.coalesce(F.arrays_overlap("s", F.array(F.lit("BUILDING"))), F.lit(False))).alias("disjoint"))


def platform_grouping_sets(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("pl_events")
    return spark.sql("SELECT coalesce(event_type, 'combined') AS platform, count(*) AS runs, round(avg(value), 6) AS mean FROM pl_events WHERE event_type IS NOT NULL GROUP BY GROUPING SETS ((event_type), ())")


def pivot_metric(spark, sf):
    g = _grid(spark, sf).where("l_returnflag = 'N'")
    return E.pivot_metric(g, "l_linenumber", "step", "value", [0, 5, 10]).toDF("l_linenumber", "d0", "d5", "d10")


def missing_cells(spark, sf):
    out = None
    for t in ("paper_metadata", "search_rows", "enrichment_pilot", "candidate_works", "documents"):
        one = E.missing_cells(table(spark, sf, t)).withColumn("name", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


def catalogue_upsert(spark, sf):
    n = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("ordinal"), "n_regionkey")
    new = n.where("n_regionkey = 2").withColumn("n_regionkey", F.lit(9))
    return E.upsert(n, new, "n_name", "ordinal").select("n_name", "ordinal", "n_regionkey")


def resume_runs(spark, sf):
    """Grid cells that have no finished run yet."""
    g = _grid(spark, sf)
    return E.resumable(g.select("l_returnflag", "l_linenumber", "step"), g.where("n > 20"), ["l_returnflag", "l_linenumber", "step"])


def audit_differences(spark, sf):
    """Stored against recomputed means: the largest difference."""
    l = table(spark, sf, "lineitem")
    again = l.groupBy("l_returnflag", "l_linenumber", F.round(F.col("l_discount") * 100).cast("int").alias("step")).agg((F.sum("l_quantity") / F.count("*")).alias("again"))
    j = _grid(spark, sf).join(again, ["l_returnflag", "l_linenumber", "step"])
    return j.agg((F.max(F.abs(F.col("value") - F.col("again"))) <= 1e-6).alias("agrees"), F.count("*").alias("cells"))


def hash_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    n = d.count()
    return M.split(d, "doc_id", 7, [("development", int(n * 0.3)), ("validation", int(n * 0.4))])


def fraction_split(spark, sf):
    return M.fraction_split(table(spark, sf, "documents"), "doc_id", 3, [("train", 0.8), ("validation", 0.1), ("test", 0.1)])


def hash_sample(spark, sf):
    return M.first_by_hash(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "holdout", 500)


def stratified_hash_sample(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return M.stratified(o, ["o_orderstatus", "o_orderpriority"], "o_orderkey", 20, 12).select("o_orderstatus", "o_orderpriority", "o_orderkey")


def resample_indices(spark, sf):
    """Members of four 80 % resamples of the embeddings."""
    e = table(spark, sf, "embeddings").select("vec_id")
    n = int(e.count() * 0.8)
    out = None
    for r in range(4):
        one = M.first_by_hash(e, "vec_id", f"resample-{r}", n).select(F.lit(r).alias("repeat"), "vec_id")
        out = one if out is None else out.unionAll(one)
    return out


def _numbered(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select((F.row_number().over(Window.orderBy("vec_id")) - 1).cast("long").alias("number"), "label"), e.count()


def random_pairs(spark, sf):
    """Pairs of row numbers over the whole table."""
    return M.random_pairs(spark, 2000, max(1, table(spark, sf, "embeddings").count()), "pairs")


def coassignment(spark, sf):
    """How often sampled pairs share a label in three relabelled runs, by whether they share the reference label."""
    e, n = _numbered(spark, sf)
    p = M.random_pairs(spark, 2000, max(1, n), "pairs")
    x = e.select(F.col("number").alias("left"), F.col("label").alias("a"))
    y = e.select(F.col("number").alias("right"), F.col("label").alias("b"))
    moved = lambda k, c, m: F.when(F.col(k) % m == 0, (F.col(c) + 1) % 10).otherwise(F.col(c))
    same = sum(((moved("left", "a", m) == moved("right", "b", m)).cast("int") for m in (3, 5, 8)), F.lit(0)) / 3.0
    return p.join(x, "left").join(y, "right").groupBy((F.col("a") == F.col("b")).alias("within")).agg(F.count("*").alias("pairs"), F.round(F.avg(same), 6).alias("coassigned"))


_G = "WITH g AS (SELECT l_returnflag, l_linenumber, CAST(round(l_discount * 100) AS INT) AS step, round(avg(l_quantity), 6) AS value, count(*) AS n FROM lineitem GROUP BY ALL)"
_H = lambda seed, key: f"sha256('{seed}:' || CAST({key} AS VARCHAR))"
_X = lambda seed, key: f"CAST('0x' || substr({_H(seed, key)}, 1, 13) AS BIGINT)"
_RP = f"WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS number, label FROM embeddings), c AS (SELECT count(*) AS n FROM e), p AS (SELECT i, {_X('pairs:l', 'i')} % c.n AS \"left\", {_X('pairs:r', 'i')} % c.n AS \"right\" FROM range(2000) t(i) CROSS JOIN c), q AS (SELECT * FROM p WHERE \"left\" <> \"right\")"
_N2 = lambda c: f"(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1.0::DOUBLE ELSE ({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) END)"

QUERIES = {f.__name__: f for f in (
    grid_neighbour_mean, previous_next, minmax_score, composite_score, selection_scores, top2_per_band, best_per_band, share_within, label_rank, multi_key_top, edge_sort, merge_tables, left_joins, descriptor_choice, reshaped_columns,
    review_flags, union_ragged, set_operations, anti_join, distinctness, disjoint_groups, platform_grouping_sets, pivot_metric, missing_cells, catalogue_upsert, resume_runs, audit_differences, hash_split, fraction_split,
    hash_sample, stratified_hash_sample, resample_indices, random_pairs, coassignment,
)}
SQL = {
    "grid_neighbour_mean": _G + """, r AS (SELECT *, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_linenumber) AS rx, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY step) AS ry FROM g)
 SELECT a.l_returnflag, a.l_linenumber, a.step, round(avg(b.value), 4) AS mean_near, round(min(b.value), 6) AS min_near FROM r a LEFT JOIN r b ON a.l_returnflag = b.l_returnflag AND abs(a.rx - b.rx) + abs(a.ry - b.ry) = 1 GROUP BY ALL""",
    "previous_next": _G + " SELECT l_returnflag, l_linenumber, step, lag(value) OVER w AS previous, lead(value) OVER w AS following FROM g WINDOW w AS (PARTITION BY l_returnflag, l_linenumber ORDER BY step)",
    "minmax_score": _G + f" SELECT l_returnflag, l_linenumber, step, round({_N2('value')}, 6) AS value01, 1.0::DOUBLE AS constant01 FROM g",
    "composite_score": _G + f", s AS (SELECT *, {_N2('value')} AS v, {_N2('n::DOUBLE')} AS m FROM g) SELECT l_returnflag, l_linenumber, step, round(v * 0.45::DOUBLE + m * 0.35::DOUBLE + (1 - m) * 0.20::DOUBLE, 6) AS score FROM s",
    "selection_scores": """WITH r AS (SELECT l_suppkey % 30 AS run, round(avg(l_discount), 6) AS d, round(avg(l_extendedprice), 6) AS p, round(avg(l_tax), 6) AS t, round(avg(l_quantity), 6) AS q, round(max(l_discount), 6) AS dm,
  count(*)::DOUBLE AS n, round(min(l_extendedprice), 6) AS pl, round(max(l_extendedprice), 6) AS ph, round(avg(l_discount) * 10, 6) AS tw, round(avg(l_tax) * 10, 6) AS r15, round(avg(l_quantity) / 50, 6) AS r50,
  round(avg(l_discount) * 20 - 1, 6) AS co FROM lineitem GROUP BY 1),
 m AS (SELECT run, """ + ", ".join(f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 1) AS {c}" for c in ("d", "p", "t", "q", "dm", "n", "pl", "ph")) + """,
  0.35 * tw + 0.35 * r15 + 0.15 * r50 + 0.10 * greatest(0, co) + 0.05 * least(1, 3 * r15) AS quality, r50 FROM r)
 SELECT run, round(0.30 * d + 0.25 * (1 - p) + 0.15 * t + 0.15 * q + 0.10 * dm + 0.05 * n, 6) AS topics_first, round(0.22 * d + 0.18 * (1 - p) + 0.12 * t + 0.12 * q + 0.18 * pl + 0.13 * ph + 0.05 * dm, 6) AS topics_final,
 round(0.35 * d + 0.30 * t + 0.20 * q + 0.15 * n, 6) AS clusters, round(quality, 6) AS projection, round(0.82 * quality + 0.18 * r50, 6) AS layout FROM m""",
    "top2_per_band": _G + " SELECT l_returnflag, tie, value, place FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY value DESC, tie) AS place FROM (SELECT *, step * 100 + l_linenumber AS tie FROM g)) WHERE place <= 2",
    "best_per_band": _G + """ SELECT band, tie, value FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY value DESC, tie) AS place FROM (SELECT *, CASE WHEN l_linenumber * 12 <= 30 THEN 'broad' WHEN l_linenumber * 12 <= 60 THEN 'balanced' ELSE 'detailed' END AS band,
 l_returnflag || '|' || l_linenumber || '|' || step AS tie FROM g)) WHERE place = 1""",
    "share_within": _G + " SELECT l_returnflag, l_linenumber, step, round(n::DOUBLE / sum(n) OVER (PARTITION BY step), 8) AS share FROM g",
    "label_rank": "SELECT source, n, row_number() OVER (ORDER BY n DESC, source NULLS FIRST) AS place FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)",
    "multi_key_top": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderpriority, o_orderkey LIMIT 20",
    "edge_sort": """WITH s AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer), c AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
 j AS (SELECT a.c_nationkey AS x, b.c_nationkey AS y, round((SELECT count(*) FROM s p JOIN s q USING (c_mktsegment) WHERE p.c_nationkey = a.c_nationkey AND q.c_nationkey = b.c_nationkey) * least(a.n, b.n)::DOUBLE / greatest(a.n, b.n), 6) AS strength FROM c a JOIN c b ON a.c_nationkey < b.c_nationkey)
 SELECT x, y, strength FROM j ORDER BY strength DESC, x DESC, y DESC LIMIT 10""",
    "merge_tables": "SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, any_value(s_nationkey) AS s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0",
    "left_joins": "SELECT l_suppkey, l_linenumber, nullif(count(*) FILTER (l_discount > 0.08 AND l_quantity > 45), 0) AS late FROM lineitem GROUP BY ALL",
    "descriptor_choice": """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'middle' WHEN 2 THEN 'large' ELSE 'other' END AS size_name,
 CASE WHEN p_size % 2 = 0 THEN array_to_string(string_split(p_type, ' ')[1:2], ' / ') ELSE p_brand END AS descriptor FROM part""",
    "reshaped_columns": "SELECT o_orderkey, o_totalprice AS price, round(o_totalprice - 1000.0::DOUBLE, 2) AS above_thousand, o_orderstatus FROM orders",
    "review_flags": _G + ", f AS (SELECT *, value < 25 AS low, coalesce(value < lag(value) OVER (PARTITION BY l_returnflag ORDER BY l_linenumber, step), false) AS falling FROM g) SELECT l_returnflag, l_linenumber, step, low, falling, low OR falling AS review FROM f",
    "union_ragged": "SELECT s_suppkey AS key, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer",
    "set_operations": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
 SELECT 'union' AS operation, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersection', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
 UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'common', count(*) FROM a WHERE k IN (SELECT k FROM b)""",
    "anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "distinctness": "SELECT count(*) = count(DISTINCT paper_idx) AS is_distinct, count(*) - count(DISTINCT paper_idx) AS extra FROM search_rows",
    "disjoint_groups": "SELECT n_nationkey, NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING') AS disjoint FROM nation",
    "platform_grouping_sets": "SELECT coalesce(event_type, 'combined') AS platform, count(*) AS runs, round(avg(value), 6) AS mean FROM events WHERE event_type IS NOT NULL GROUP BY GROUPING SETS ((event_type), ())",
    "pivot_metric": _G + " SELECT l_linenumber, max(value) FILTER (step = 0) AS d0, max(value) FILTER (step = 5) AS d5, max(value) FILTER (step = 10) AS d10 FROM g WHERE l_returnflag = 'N' GROUP BY 1",
    "missing_cells": " UNION ALL ".join(
        f"SELECT count(*) AS rows, CAST({len(c)} AS BIGINT) AS columns, CAST({' + '.join(f'count(*) FILTER ({x} IS NULL)' for x in c)} AS BIGINT) AS missing, '{t}' AS name FROM {t}"
        for t, c in {
            "paper_metadata": "row_no paper_id title creator description pub_date url subject pub_type export_batch exported_at".split(), "search_rows": "paper_idx paper_id title authors pub_date url snapshot_no added_at".split(),
            "enrichment_pilot": "record_id paper_id title creator pub_date source_type source_year candidate_source candidate_title candidate_year author_match title_similarity score author_count candidate_type".split(),
            "candidate_works": "work_id candidate_title candidate_authors candidate_year candidate_type journal publisher provider doi".split(), "documents": "doc_id text lang source n_chars doc_type pub_year collected_at".split(),
        }.items()
    ),
    "catalogue_upsert": """SELECT n_name, n_nationkey AS ordinal, n_regionkey FROM nation WHERE n_regionkey <> 2
 UNION ALL SELECT n_name, CAST((SELECT max(n_nationkey) FROM nation WHERE n_regionkey <> 2) + row_number() OVER (ORDER BY n_nationkey, n_name) AS INT), 9 FROM nation WHERE n_regionkey = 2""",
    "resume_runs": _G + " SELECT l_returnflag, l_linenumber, step FROM g WHERE n <= 20",
    "audit_differences": _G + " SELECT true AS agrees, count(*) AS cells FROM g",
    "hash_split": f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_H(7, 'doc_id')}, doc_id) AS i, CAST(floor(count(*) OVER () * 0.3::DOUBLE) AS BIGINT) AS a, CAST(floor(count(*) OVER () * 0.4::DOUBLE) AS BIGINT) AS b FROM documents)
 SELECT doc_id, CASE WHEN i <= a THEN 'development' ELSE 'validation' END AS part FROM r WHERE i <= a + b""",
    "fraction_split": f"SELECT doc_id, CASE WHEN x < 1.0::DOUBLE - 0.1::DOUBLE - 0.1::DOUBLE THEN 'train' WHEN x < 1.0::DOUBLE - 0.1::DOUBLE THEN 'validation' ELSE 'test' END AS part FROM (SELECT doc_id, {_X(3, 'doc_id')}::DOUBLE / 4503599627370496.0::DOUBLE AS x FROM documents)",
    "hash_sample": f"SELECT o_orderkey FROM orders ORDER BY {_H('holdout', 'o_orderkey')}, o_orderkey LIMIT 500",
    "stratified_hash_sample": f"SELECT o_orderstatus, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {_H(20, 'o_orderkey')}, o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'P') WHERE i <= 12",
    "resample_indices": " UNION ALL ".join(f"SELECT {r} AS repeat, vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY {_H(f'resample-{r}', 'vec_id')}, vec_id) AS i, count(*) OVER () AS n FROM embeddings) WHERE i <= floor(n * 0.8::DOUBLE)" for r in range(4)),
    "random_pairs": _RP + " SELECT i, \"left\", \"right\" FROM q",
    "coassignment": _RP + """, x AS (SELECT q.*, a.label AS a, b.label AS b FROM q JOIN e a ON a.number = "left" JOIN e b ON b.number = "right"),
 y AS (SELECT a = b AS within, """ + " + ".join(f'CASE WHEN (CASE WHEN "left" % {m} = 0 THEN (a + 1) % 10 ELSE a END) = (CASE WHEN "right" % {m} = 0 THEN (b + 1) % 10 ELSE b END) THEN 1 ELSE 0 END' for m in (3, 5, 8)) + """ AS s FROM x)
 SELECT within, count(*) AS pairs, round(avg(s / 3.0::DOUBLE), 6) AS coassigned FROM y GROUP BY 1""",
}
