"""Coordinates, picking, framing and camera; integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as A
from ..operators import projection as P
from ..operators import quality as Q
from ..operators import vectors as V
from ..tables import table
from .base import LABELS_CTE, labels

VIEW = P.View(-0.5, 0.5, -0.5, 0.5, 900, 600, 2.0, 15.0, -10.0)


def _xyz(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def coordinate_bounds(spark, sf):
    return P.bounds(_xyz(spark, sf), ["x", "y"])


def rounded_coordinates(spark, sf):
    return _xyz(spark, sf).select("vec_id", *[F.round(F.col(c), 5).alias(c) for c in "xyz"])


def normalised_projection(spark, sf):
    return P.unit_radius(_xyz(spark, sf), ["x", "y", "z"]).select("vec_id", *[F.round(c, 6).alias(c) for c in "xyz"])


def screen_positions(spark, sf):
    x, y = VIEW.to_screen(F.col("x"), F.col("y"))
    return _xyz(spark, sf).select("vec_id", F.round(x, 4).alias("screen_x"), F.round(y, 4).alias("screen_y"))


def _picks(spark, sf):
    return _xyz(spark, sf).select((F.col("vec_id") + 100_000).alias("pick"), (F.col("x") + 0.004).alias("x"), (F.col("y") - 0.003).alias("y"))


def spatial_nearest(spark, sf):
    return P.nearest_points(_xyz(spark, sf).select("vec_id", "x", "y"), _picks(spark, sf), VIEW, "vec_id").select("pick", "vec_id", F.round("distance", 5).alias("distance"))


def frame_groups(spark, sf):
    f = P.frame(_xyz(spark, sf), ["x", "y", "z"], "label")
    return f.select("label", *[F.round(c, 6).alias(c) for c in ("c_x", "c_y", "c_z", "radius")])


def project_3d(spark, sf):
    c = P.Camera().orbit(40, -12).zoom(0.8)
    return c.project(_xyz(spark, sf), 800, 600).select("vec_id", F.round("screen_x", 4).alias("screen_x"), F.round("screen_y", 4).alias("screen_y"), F.round("depth", 6).alias("depth"), "visible")


def violations_duplicate_keys(spark, sf):
    return Q.require_unique(table(spark, sf, "search_rows"), "paper_idx")


def violations_catalogue(spark, sf):
    own = labels(spark, sf)
    listed = own.where("label >= 0").groupBy("lens_id", "label").agg(F.count("*").alias("n")).withColumn("n", F.when((F.col("lens_id") == "batch") & (F.col("label") == 1), F.col("n") + 1).otherwise(F.col("n")))
    return Q.catalogue_mismatches(own, listed)


def _colours(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.concat(F.lit("lens-"), F.col("n_regionkey").cast("string")).alias("lens_id"), F.col("n_nationkey").alias("label"), F.concat(F.lit("#"), F.substring(F.md5("n_name"), 1, F.when(F.col("n_nationkey") == 7, 5).otherwise(6))).alias("colour"))


def violations_colours(spark, sf):
    return Q.colour_problems(_colours(spark, sf), "#ffffff", 3.0, 0.12)


def violations_overlap_colours(spark, sf):
    """Strong overlaps of two clusterings whose ends differ in colour."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("a"), F.when(F.col("vec_id") % 9 == 0, 0).otherwise(F.col("label")).alias("b"))
    from ..operators.partition import jaccard

    j = jaccard(e.groupBy("a", "b").agg(F.count("*").alias("observed"))).select(F.lit("l").alias("left_lens"), "a", F.lit("r").alias("right_lens"), "b", "jaccard")
    lab = spark.range(10).select(F.col("id").cast("int").alias("label"))
    c = lab.select(F.lit("l").alias("lens_id"), "label", F.lit("#111111").alias("colour")).unionAll(lab.select(F.lit("r").alias("lens_id"), "label", F.when(F.col("label") == 3, "#222222").otherwise("#111111").alias("colour")))
    return Q.overlap_colour_conflicts(j, c, 0.6).select("a", "b", "ca", "cb")


def violations_drift(spark, sf):
    """Means of lineitem kept with two digits against the means computed again: those further off than 0.004, and groups
    that one side lacks."""
    l = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    stored = l.where("l_suppkey % 5 <> 0 OR l_linenumber <> 7").withColumn("v", F.round("v", 2))
    d = Q.value_drift(stored, l.where("l_suppkey % 7 <> 0 OR l_linenumber <> 1"), ["l_suppkey", "l_linenumber"], "v", 0.004)
    return d.select("l_suppkey", "l_linenumber", F.round("stored", 6).alias("stored"), F.round("again", 6).alias("again"))


def violations_neighbours(spark, sf):
    """Made-up neighbour lists of all vectors, many of them broken in one way or another."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    n = e.count()
    i = F.col("id")
    lists = F.when(i % 17 == 0, F.array((i + 1) % n, (i + 2) % n)).otherwise(F.array(i * 3 % (n + 5), (i + 7) % n, i * i % n))
    return Q.neighbour_problems(e.withColumn("n", lists), "id", "n", 3, n)


def violations_representatives(spark, sf):
    e = table(spark, sf, "embeddings")
    r = V.representatives(e, V.centroids(e, "label"), "label").withColumn("label", F.when((F.col("label") == 2) & (F.col("place") == 4), 3).otherwise(F.col("label")))
    return Q.representative_problems(r, e.select("vec_id", "label")).where("problem = 'member'").select("label", "problem")


def violations_projection(spark, sf):
    raw, fixed = _xyz(spark, sf), P.unit_radius(_xyz(spark, sf), ["x", "y", "z"])
    return Q.projection_problems(raw, ["x", "y", "z"]).withColumn("which", F.lit("raw")).unionAll(Q.projection_problems(fixed, ["x", "y", "z"]).withColumn("which", F.lit("fixed")))


_X = "WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_U = _X + ", c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM e), m AS (SELECT vec_id, x - cx AS x, y - cy AS y, z - cz AS z FROM e CROSS JOIN c), r AS (SELECT max(sqrt(x * x + y * y + z * z)) AS r FROM m)"
_S = repr(VIEW.scale) + "::DOUBLE"
_M = P.Camera().orbit(40, -12).zoom(0.8).matrix(800 / 600)
_ROW = lambda r: " + ".join(f"{c} * ({float(_M[r, i])!r})::DOUBLE" for i, c in enumerate("xyz")) + f" + ({float(_M[r, 3])!r})::DOUBLE"

QUERIES = {f.__name__: f for f in (
    coordinate_bounds, rounded_coordinates, normalised_projection, screen_positions, spatial_nearest, frame_groups, project_3d, violations_duplicate_keys, violations_catalogue, violations_colours, violations_overlap_colours,
    violations_drift, violations_neighbours, violations_representatives, violations_projection,
)}
SQL = {
    "coordinate_bounds": _X + " SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM e",
    "rounded_coordinates": _X + " SELECT vec_id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM e",
    "normalised_projection": _U + " SELECT vec_id, round(x / r, 6) AS x, round(y / r, 6) AS y, round(z / r, 6) AS z FROM m CROSS JOIN r",
    "screen_positions": _X + f" SELECT vec_id, round(x * {_S} + 450 + 15.0::DOUBLE, 4) AS screen_x, round(-y * {_S} + 300 - 10.0::DOUBLE, 4) AS screen_y FROM e",
    "spatial_nearest": _X + f""", p AS (SELECT vec_id + 100000 AS pick, x + 0.004::DOUBLE AS px, y - 0.003::DOUBLE AS py FROM e),
 d AS (SELECT pick, vec_id, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)) * {_S}, 9) AS distance FROM p JOIN e ON abs(x - px) * {_S} <= 11 AND abs(y - py) * {_S} <= 11)
 SELECT pick, vec_id, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY pick ORDER BY distance, vec_id) AS rn FROM d WHERE distance <= 11) WHERE rn = 1""",
    "frame_groups": _X + """, b AS (SELECT label, (min(x) + max(x)) / 2 AS c_x, (min(y) + max(y)) / 2 AS c_y, (min(z) + max(z)) / 2 AS c_z FROM e GROUP BY 1)
 SELECT label, round(any_value(c_x), 6) AS c_x, round(any_value(c_y), 6) AS c_y, round(any_value(c_z), 6) AS c_z, round(max(sqrt((x - c_x) ** 2 + (y - c_y) ** 2 + (z - c_z) ** 2)), 6) AS radius FROM e JOIN b USING (label) GROUP BY 1""",
    "project_3d": _X + f""", c AS (SELECT vec_id, {_ROW(0)} AS a, {_ROW(1)} AS b, {_ROW(2)} AS d, {_ROW(3)} AS w FROM e)
 SELECT vec_id, round(CASE WHEN w > 0 THEN (a / w * 0.5 + 0.5) * 800 ELSE 0 END, 4) AS screen_x, round(CASE WHEN w > 0 THEN (0.5 - b / w * 0.5) * 600 ELSE 0 END, 4) AS screen_y, round(w, 6) AS depth,
 w > 0 AND d / w BETWEEN -1 AND 1 AND a / w BETWEEN -1.08 AND 1.08 AND b / w BETWEEN -1.08 AND 1.08 AS visible FROM c""",
    "violations_duplicate_keys": "SELECT paper_idx, count(*) AS n FROM search_rows GROUP BY 1 HAVING count(*) > 1",
    "violations_catalogue": f"WITH {LABELS_CTE} SELECT lens_id, label, count(*) + 1 AS listed, count(*) AS counted FROM labels WHERE lens_id = 'batch' AND label = 1 GROUP BY ALL",
    "violations_overlap_colours": """WITH e AS (SELECT label AS a, CASE WHEN vec_id % 9 = 0 THEN 0 ELSE label END AS b FROM embeddings), t AS (SELECT a, b, count(*) AS n FROM e GROUP BY ALL),
 j AS (SELECT a, b, n::DOUBLE / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n) AS j FROM t) SELECT a, b, '#111111' AS ca, '#222222' AS cb FROM j WHERE j >= 0.6 AND b = 3""",
    "violations_drift": """WITH l AS (SELECT l_suppkey, l_linenumber, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL),
 j AS (SELECT l_suppkey, l_linenumber, s.v AS stored, a.v AS again FROM (SELECT l_suppkey, l_linenumber, round(v, 2) AS v FROM l WHERE l_suppkey % 5 <> 0 OR l_linenumber <> 7) s
  FULL JOIN (SELECT * FROM l WHERE l_suppkey % 7 <> 0 OR l_linenumber <> 1) a USING (l_suppkey, l_linenumber))
 SELECT l_suppkey, l_linenumber, round(stored, 6) AS stored, round(again, 6) AS again FROM j WHERE stored IS NULL OR again IS NULL OR abs(stored - again) > 0.004""",
    "violations_neighbours": """WITH c AS (SELECT count(*) AS m FROM embeddings), e AS (SELECT vec_id AS id, m, CASE WHEN vec_id % 17 = 0 THEN [(vec_id + 1) % m, (vec_id + 2) % m] ELSE [vec_id * 3 % (m + 5), (vec_id + 7) % m, vec_id * vec_id % m] END AS n FROM embeddings CROSS JOIN c),
 p AS (SELECT id, CASE WHEN len(n) <> 3 THEN 'count' WHEN list_contains(n, id) THEN 'self' WHEN len(list_distinct(n)) <> len(n) THEN 'repeat' WHEN len(list_filter(n, lambda x: x >= m)) > 0 THEN 'range' END AS problem FROM e)
 SELECT id, problem FROM p WHERE problem IS NOT NULL""",
    "violations_representatives": "SELECT 3 AS label, 'member' AS problem WHERE (SELECT count(*) FROM embeddings WHERE label = 2) >= 4",
}
