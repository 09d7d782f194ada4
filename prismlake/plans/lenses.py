"""Lens counts, associations and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as A
from .base import LABELS_CTE, labels, lenses


def lens_counts(spark, sf):
    return labels(spark, sf).groupBy("lens_id", "label").agg(F.count("*").alias("n"))


def lens_category_rows(spark, sf):
    """Categories without noise, with their display names."""
    named = labels(spark, sf).where("label >= 0").groupBy("lens_id", "label").agg(F.count("*").alias("n")).join(F.broadcast(lenses(spark)), "lens_id")
    return named.select("lens_id", "label", "n", A.category_label(F.col("label"), F.lit(None).cast("string"), F.col("algorithm")).alias("display"))


def lens_display_labels(spark, sf):
    seen = labels(spark, sf).select("lens_id", "label").distinct().join(F.broadcast(lenses(spark)), "lens_id")
    return seen.select("lens_id", "label", A.category_label(F.col("label"), F.lit(None).cast("string"), F.col("algorithm")).alias("display"))


def lens_eligible(spark, sf):
    return A.eligible(labels(spark, sf), lenses(spark)).groupBy("lens_id").agg(F.count("*").alias("papers"))


def lens_short_labels(spark, sf):
    """Short names by algorithm and parameters."""
    l = lenses(spark)
    short = F.when(F.col("algorithm") == "hdbscan", F.concat(F.lit("HDBSCAN · "), F.col("name"))).when(F.col("algorithm") == "kmeans", F.concat(F.lit("k-means · "), F.col("name"))).when(F.col("algorithm") == "lda", F.concat(F.lit("LDA · "), F.col("name"))).otherwise(F.col("name"))
    return l.select("lens_id", short.alias("short_label"))


def _cells(spark, sf, left="batch", right="period"):
    return A.cells(A.contingency(A.eligible(labels(spark, sf), lenses(spark)), left, right))


def association_cells(spark, sf):
    c = _cells(spark, sf)
    return c.select("a", "b", "observed", "row_n", "col_n", F.round("expected", 6).alias("expected"), F.round("residual", 6).alias("residual"))


def association_v(spark, sf):
    return A.corrected_v(_cells(spark, sf, "subject", "type")).select(F.round("v", 6).alias("v"), "papers")


def association_overview(spark, sf):
    return A.overview(labels(spark, sf), lenses(spark)).select("left_id", "right_id", F.round("v", 6).alias("v"), "papers")


def association_pair_lookup(spark, sf):
    """Pairs under a key that doesn't depend on the order of the two names."""
    o = A.overview(labels(spark, sf), lenses(spark))
    return o.select(F.concat_ws("|", F.least("left_id", "right_id"), F.greatest("left_id", "right_id")).alias("pair_key"), F.round("v", 6).alias("v"))


def association_visible(spark, sf):
    return A.visible_margins(A.contingency(A.eligible(labels(spark, sf), lenses(spark)), "batch", "period"), 4)


def selection_distribution(spark, sf):
    chosen = labels(spark, sf).where("lens_id = 'batch' AND label IN (1, 2)")
    return A.distribution(labels(spark, sf), chosen, "period")


def distribution_top_rest(spark, sf):
    own = labels(spark, sf)
    return A.top_and_rest(A.distribution(own, own.where("lens_id = 'subject' AND label = 0"), "batch"), 5)


def first_members(spark, sf):
    """The first ten members of each category, the sample that stands in for missing representatives."""
    from pyspark.sql import Window

    w = Window.partitionBy("lens_id", "label").orderBy("paper")
    return labels(spark, sf).where("label >= 0").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10").select("lens_id", "label", "paper", "place")


def visible_points(spark, sf):
    """Which points a view with one highlighted category shows."""
    own = labels(spark, sf).where("lens_id = 'batch'")
    highlighted, show_noise, some = F.col("label").isin(3), F.lit(False), F.lit(False)
    return own.where(highlighted | ((F.col("label") >= 0) | show_noise) & ~some).select("paper", "label")


_CELLS = """, t AS (SELECT x.label AS a, y.label AS b, count(*) AS observed FROM el x JOIN el y USING (paper) WHERE x.lens_id = '{l}' AND y.lens_id = '{r}' GROUP BY ALL),
c AS (SELECT ra.a, cb.b, CAST(coalesce(t.observed, 0) AS BIGINT) AS observed, row_n, col_n, n, row_n::DOUBLE * col_n / n AS expected FROM
 (SELECT a, CAST(sum(observed) AS BIGINT) AS row_n FROM t GROUP BY 1) ra CROSS JOIN (SELECT b, CAST(sum(observed) AS BIGINT) AS col_n FROM t GROUP BY 1) cb
 CROSS JOIN (SELECT CAST(sum(observed) AS BIGINT) AS n FROM t) LEFT JOIN t ON t.a = ra.a AND t.b = cb.b)"""
_V = """CASE WHEN r < 2 OR k < 2 THEN 0.0::DOUBLE ELSE sqrt(greatest(0.0::DOUBLE, chi2 / n - (r - 1) * (k - 1) / (n - 1)) /
 (least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1)) END"""
_S = "sum((observed - expected) * (observed - expected) / expected) AS chi2, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS k, any_value(n)::DOUBLE AS n"
_OVER = """, t AS (SELECT x.lens_id AS left_id, y.lens_id AS right_id, x.label AS a, y.label AS b, count(*) AS observed FROM el x JOIN el y USING (paper) WHERE x.ordinal < y.ordinal GROUP BY ALL),
c AS (SELECT ra.left_id, ra.right_id, ra.a, cb.b, coalesce(t.observed, 0) AS observed, n, row_n::DOUBLE * col_n / n AS expected FROM
 (SELECT left_id, right_id, a, sum(observed) AS row_n FROM t GROUP BY ALL) ra JOIN (SELECT left_id, right_id, b, sum(observed) AS col_n FROM t GROUP BY ALL) cb USING (left_id, right_id)
 JOIN (SELECT left_id, right_id, sum(observed) AS n FROM t GROUP BY ALL) USING (left_id, right_id)
 LEFT JOIN t ON t.left_id = ra.left_id AND t.right_id = ra.right_id AND t.a = ra.a AND t.b = cb.b)"""
_DISPLAY = "CASE WHEN label < 0 AND algorithm = 'metadata' THEN 'Metadata unavailable' WHEN label < 0 THEN 'Unclustered' ELSE 'Category ' || label END"

QUERIES = {f.__name__: f for f in (
    lens_counts, lens_category_rows, lens_display_labels, lens_eligible, lens_short_labels, association_cells, association_v, association_overview,
    association_pair_lookup, association_visible, selection_distribution, distribution_top_rest, first_members, visible_points,
)}
SQL = {
    "lens_counts": f"WITH {LABELS_CTE} SELECT lens_id, label, count(*) AS n FROM labels GROUP BY ALL",
    "lens_category_rows": f"WITH {LABELS_CTE} SELECT lens_id, label, count(*) AS n, 'Category ' || label AS display FROM labels WHERE label >= 0 GROUP BY ALL",
    "lens_display_labels": f"WITH {LABELS_CTE} SELECT DISTINCT lens_id, label, {_DISPLAY} AS display FROM labels JOIN lenses USING (lens_id)",
    "lens_eligible": f"WITH {LABELS_CTE} SELECT lens_id, count(*) AS papers FROM el GROUP BY 1",
    "lens_short_labels": "SELECT * FROM (VALUES ('batch', 'HDBSCAN · Export batch'), ('subject', 'k-means · Subject field'), ('type', 'Publication type'), ('period', 'Publication period')) v(lens_id, short_label)",
    "association_cells": f"WITH {LABELS_CTE}{_CELLS.format(l='batch', r='period')} SELECT a, b, observed, row_n, col_n, round(expected, 6) AS expected, round((observed - expected) / sqrt(expected), 6) AS residual FROM c",
    "association_v": f"WITH {LABELS_CTE}{_CELLS.format(l='subject', r='type')} SELECT round({_V}, 6) AS v, CAST(n AS BIGINT) AS papers FROM (SELECT {_S} FROM c)",
    "association_overview": f"WITH {LABELS_CTE}{_OVER} SELECT left_id, right_id, round({_V}, 6) AS v, CAST(n AS BIGINT) AS papers FROM (SELECT left_id, right_id, {_S} FROM c GROUP BY ALL)",
    "association_pair_lookup": f"WITH {LABELS_CTE}{_OVER} SELECT least(left_id, right_id) || '|' || greatest(left_id, right_id) AS pair_key, round({_V}, 6) AS v FROM (SELECT left_id, right_id, {_S} FROM c GROUP BY ALL)",
    "association_visible": f"""WITH {LABELS_CTE}{_CELLS.format(l='batch', r='period')},
 m AS (SELECT 'a' AS side, a AS label, CAST(sum(observed) AS BIGINT) AS n FROM t GROUP BY a UNION ALL SELECT 'b', b, CAST(sum(observed) AS BIGINT) FROM t GROUP BY b)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, label) AS place FROM m) WHERE place <= 4""",
    "selection_distribution": f"WITH {LABELS_CTE} SELECT label, count(*) AS n FROM labels WHERE lens_id = 'period' AND paper IN (SELECT paper FROM labels WHERE lens_id = 'batch' AND label IN (1, 2)) GROUP BY 1",
    "distribution_top_rest": f"""WITH {LABELS_CTE}, d AS (SELECT label, count(*) AS n FROM labels WHERE lens_id = 'batch' AND paper IN (SELECT paper FROM labels WHERE lens_id = 'subject' AND label = 0) GROUP BY 1)
 SELECT CASE WHEN place <= 5 THEN CAST(label AS VARCHAR) ELSE 'rest' END AS category, CAST(sum(n) AS BIGINT) AS n, count(*) AS categories FROM (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS place FROM d) GROUP BY 1""",
    "first_members": f"WITH {LABELS_CTE} SELECT lens_id, label, paper, place FROM (SELECT *, row_number() OVER (PARTITION BY lens_id, label ORDER BY paper) AS place FROM labels WHERE label >= 0) WHERE place <= 10",
    "visible_points": f"WITH {LABELS_CTE} SELECT paper, label FROM labels WHERE lens_id = 'batch' AND label >= 0",
}
