"""Integrity checks as queries: each returns the rows that violate a rule; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import contrast, oklab


def violations(df: DataFrame, rule: str, bad) -> DataFrame:
    return df.where(bad).select(F.lit(rule).alias("rule"))


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return df


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that stand for more than one row."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def catalogue_mismatches(labels: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(lens_id, label, listed, counted): categories whose listed count isn't the labels' count, or that miss on a side."""
    counted = labels.where("label >= 0").groupBy("lens_id", "label").agg(F.count("*").alias("counted"))
    j = catalogue.select("lens_id", "label", F.col("n").alias("listed")).join(counted, ["lens_id", "label"], "full")
    return j.where(~F.col("listed").eqNullSafe(F.col("counted")))


def colour_problems(colours: DataFrame, background: str, least_contrast: float, least_distance: float) -> DataFrame:
    """(lens_id, label, problem): malformed, repeated, faint or too similar colours within a lens."""
    fine = colours.where(F.col("colour").rlike("^#[0-9a-fA-F]{6}$"))
    malformed = colours.where(~F.coalesce(F.col("colour").rlike("^#[0-9a-fA-F]{6}$"), F.lit(False))).select("lens_id", "label", F.lit("malformed").alias("problem"))
    faint = fine.where(contrast(F.col("colour"), F.lit(background)) < least_contrast).select("lens_id", "label", F.lit("faint").alias("problem"))
    l, a, b = oklab(F.col("colour"))
    lab = fine.select("lens_id", "label", l.alias("l"), a.alias("a"), b.alias("b"))
    x, y = lab.alias("x"), lab.alias("y")
    d = F.sqrt(sum(((F.col(f"x.{c}") - F.col(f"y.{c}")) ** 2 for c in "lab"), F.lit(0.0)))
    near = x.join(y, (F.col("x.lens_id") == F.col("y.lens_id")) & (F.col("x.label") < F.col("y.label"))).where(d < least_distance).select(F.col("x.lens_id").alias("lens_id"), F.col("y.label").alias("label"), F.lit("similar").alias("problem"))
    return malformed.unionAll(faint).unionAll(near.distinct())


def overlap_colour_conflicts(edges: DataFrame, colours: DataFrame, least: float = 0.70) -> DataFrame:
    """Edges (left_lens, a, right_lens, b, jaccard) of strong overlap whose ends differ in colour."""
    l = colours.select(F.col("lens_id").alias("left_lens"), F.col("label").alias("a"), F.col("colour").alias("ca"))
    r = colours.select(F.col("lens_id").alias("right_lens"), F.col("label").alias("b"), F.col("colour").alias("cb"))
    return edges.where(F.col("jaccard") >= least).join(l, ["left_lens", "a"]).join(r, ["right_lens", "b"]).where("ca <> cb")


def value_drift(stored: DataFrame, again: DataFrame, keys: list[str], value: str, most: float) -> DataFrame:
    """Rows whose stored value differs from the recomputed one by more than `most`, or that miss on a side."""
    j = stored.select(*keys, F.col(value).alias("stored")).join(again.select(*keys, F.col(value).alias("again")), keys, "full")
    return j.where(F.col("stored").isNull() | F.col("again").isNull() | (F.abs(F.col("stored") - F.col("again")) > most))


def neighbour_problems(rows: DataFrame, key: str, neighbours: str, k: int, n: int) -> DataFrame:
    """(key, problem): rows with a wrong number of neighbours, self, repeats or numbers out of range."""
    v = F.col(neighbours)
    problem = (
        F.when(F.size(v) != k, "count").when(F.array_contains(v, F.col(key)), "self").when(F.size(F.array_distinct(v)) != F.size(v), "repeat")
        .when(F.exists(v, lambda x: (x < 0) | (x >= n)), "range")
    )
    return rows.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def representative_problems(reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, vec_id, problem): representatives of another category, repeated, or with rising scores."""
    w = Window.partitionBy("label").orderBy("place")
    j = reps.join(labels.select("vec_id", F.col("label").alias("own")), "vec_id", "left").withColumn("before", F.lag("score").over(w)).withColumn("times", F.count("*").over(Window.partitionBy("label", "vec_id")))
    problem = F.when(~F.col("own").eqNullSafe(F.col("label")), "member").when(F.col("times") > 1, "repeat").when(F.col("score") > F.col("before"), "order")
    return j.select("label", "vec_id", problem.alias("problem")).where("problem IS NOT NULL")


def projection_problems(rows: DataFrame, axes: list[str], tolerance: float = 1e-5) -> DataFrame:
    """(rule): rules that centred coordinates of unit radius break."""
    size = F.sqrt(sum((F.col(a) ** 2 for a in axes), F.lit(0.0)))
    s = rows.agg(*[F.avg(a).alias(f"m_{a}") for a in axes], F.max(size).alias("radius"), F.count_if(sum((F.isnan(a).cast("int") for a in axes), F.lit(0)) > 0).alias("nan"))
    checks = F.array(
        F.when(F.greatest(*[F.abs(F.col(f"m_{a}")) for a in axes]) > tolerance, "centre"), F.when(F.abs(F.col("radius") - 1) > tolerance, "radius"), F.when(F.col("nan") > 0, "finite")
    )
    return s.select(F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("rule"))
