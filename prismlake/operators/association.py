"""Lenses over one set of rows: labels, contingency, residuals and bias-corrected Cramér's V.

Labels come as a long table (paper, lens_id, label). A label of -1 is noise in a clustering and stays a category of its
own; in a metadata lens it means that the value isn't known, and the row is left out of every association.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def eligible(labels: DataFrame, lenses: DataFrame) -> DataFrame:
    """Labels that count: all of clusterings, the known ones of metadata lenses. lenses: (lens_id, algorithm)."""
    return labels.join(F.broadcast(lenses.select("lens_id", "algorithm")), "lens_id").where((F.col("algorithm") != "metadata") | (F.col("label") >= 0)).drop("algorithm")


def category_label(label: Column, name: Column, algorithm: Column) -> Column:
    """Display name of a category."""
    return (
        F.when((label < 0) & (algorithm == "metadata"), "Metadata unavailable").when(label < 0, "Unclustered")
        .otherwise(F.coalesce(name, F.concat(F.lit("Category "), label.cast("string"))))
    )


def contingency(labels: DataFrame, left: str, right: str, key: str = "paper") -> DataFrame:
    """(a, b, observed): rows by the labels of two lenses; one scan and one shuffle on the key, no join."""
    side = lambda lens: F.max(F.when(F.col("lens_id") == lens, F.col("label")))
    both = labels.where(F.col("lens_id").isin(left, right)).groupBy(key).agg(side(left).alias("a"), side(right).alias("b"))
    return both.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("observed"))


def cells(counts: DataFrame) -> DataFrame:
    """Every cell, empty ones too: observed, expected, Pearson residual. The table of counts, whose size is labels x
    labels, is written once, as it is read four times."""
    counts = cut(counts)
    rows = counts.groupBy("a").agg(F.sum("observed").alias("row_n"))
    cols = counts.groupBy("b").agg(F.sum("observed").alias("col_n"))
    n = counts.agg(F.sum("observed").alias("n"))
    dense = rows.crossJoin(cols).crossJoin(n).join(counts, ["a", "b"], "left")
    expected = F.col("row_n").cast("double") * F.col("col_n") / F.col("n")
    observed = F.coalesce("observed", F.lit(0).cast("long"))
    return dense.select("a", "b", observed.alias("observed"), "row_n", "col_n", "n", expected.alias("expected"), ((observed - expected) / F.sqrt(expected)).alias("residual"))


def corrected_v(cell: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Bias-corrected Cramér's V from dense cells; 0 where a side has fewer than two categories."""
    stats = cell.groupBy(*(by or [])).agg(
        F.sum(F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)) / F.col("expected")).alias("chi2"),
        F.count_distinct("a").cast("double").alias("r"), F.count_distinct("b").cast("double").alias("k"), F.first("n").alias("n"),
    )
    n = F.col("n").cast("double")
    phi = F.greatest(F.lit(0.0), F.col("chi2") / n - (F.col("r") - 1) * (F.col("k") - 1) / F.nullif(n - 1, F.lit(0.0)))
    rc = F.col("r") - F.pow(F.col("r") - 1, F.lit(2.0)) / F.nullif(n - 1, F.lit(0.0))
    kc = F.col("k") - F.pow(F.col("k") - 1, F.lit(2.0)) / F.nullif(n - 1, F.lit(0.0))
    least = F.least(rc, kc) - 1
    v = F.when((F.col("r") < 2) | (F.col("k") < 2) | (least <= 0), F.lit(0.0)).otherwise(F.sqrt(phi / F.nullif(least, F.lit(0.0))))
    return stats.select(*(by or []), F.coalesce(v, F.lit(0.0)).alias("v"), F.col("n").alias("papers"))


def overview(labels: DataFrame, lenses: DataFrame, key: str = "paper") -> DataFrame:
    """(left_id, right_id, v, papers) of all unordered lens pairs.

    A row's labels come together in one shuffle on the key; its pairs, at most lenses x lenses, are made inside the row.
    """
    own = eligible(labels, lenses).join(F.broadcast(lenses.select("lens_id", "ordinal")), "lens_id")
    lists = own.groupBy(key).agg(F.collect_list(F.struct("ordinal", "lens_id", "label")).alias("l"))
    made = lambda x: F.transform(F.filter("l", lambda y: y["ordinal"] > x["ordinal"]), lambda y: F.struct(x["lens_id"].alias("left_id"), y["lens_id"].alias("right_id"), x["label"].alias("a"), y["label"].alias("b")))
    pair = ["left_id", "right_id"]
    counts = cut(lists.select(F.inline(F.flatten(F.transform("l", made)))).groupBy(*pair, "a", "b").agg(F.count("*").alias("observed")))
    rows = counts.groupBy(*pair, "a").agg(F.sum("observed").alias("row_n"))
    cols = counts.groupBy(*pair, "b").agg(F.sum("observed").alias("col_n"))
    n = counts.groupBy(*pair).agg(F.sum("observed").alias("n"))
    dense = rows.join(cols, pair).join(n, pair).join(counts, [*pair, "a", "b"], "left")
    expected = F.col("row_n").cast("double") * F.col("col_n") / F.col("n")
    dense = dense.withColumn("observed", F.coalesce("observed", F.lit(0).cast("long"))).withColumn("expected", expected)
    return corrected_v(dense, pair)


def visible_margins(counts: DataFrame, limit: int) -> DataFrame:
    """The `limit` largest rows and columns (count, then label)."""
    out = None
    for side in ("a", "b"):
        m = counts.groupBy(F.col(side).alias("label")).agg(F.sum("observed").alias("n"))
        m = m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).where(F.col("place") <= limit)
        m = m.select(F.lit(side).alias("side"), "label", "n", F.col("place").cast("long").alias("place"))
        out = m if out is None else out.unionByName(m)
    return out


def distribution(labels: DataFrame, selection: DataFrame, lens: str, key: str = "paper") -> DataFrame:
    """(label, n) of the selected rows under a lens."""
    return labels.where(F.col("lens_id") == lens).join(selection.select(key), key, "left_semi").groupBy("label").agg(F.count("*").alias("n"))


def top_and_rest(dist: DataFrame, top: int = 10) -> DataFrame:
    """The largest `top` categories by name, and one row for the rest."""
    placed = dist.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
    name = F.when(F.col("place") <= top, F.col("label").cast("string")).otherwise("rest")
    return placed.groupBy(name.alias("category")).agg(F.sum("n").alias("n"), F.count("*").alias("categories"))
