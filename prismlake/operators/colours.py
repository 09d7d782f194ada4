"""Colours for families of categories: a pool that stands out from the background, and a choice far apart in OKLab."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import contrast, oklab

#: Lightness and saturation of the pool's rows, degrees between its hues, weight of the distance from all.
LIGHTNESS, SATURATION, HUE_STEP = [0.48, 0.57, 0.66, 0.74], [0.58, 0.72, 0.86], 3
ALL_WEIGHT = 0.12


def pool(spark: SparkSession, background: str, least_contrast: float) -> DataFrame:
    """(place, colour, l, a, b): the pool, each colour once, with its OKLab coordinates. At most 4 x 3 x 120 rows."""
    hues = spark.range(360 // HUE_STEP).select((F.col("id") * HUE_STEP).alias("hue"))
    grid = spark.createDataFrame([(i, j, x, y) for i, x in enumerate(LIGHTNESS) for j, y in enumerate(SATURATION)], "i int, j int, light double, full double")
    chroma = (1 - F.abs(2 * F.col("light") - 1)) * F.col("full")

    def channel(shift: int):  # the usual closed form of HSL, f(n) = L - C/2 max(-1, min(k - 3, 9 - k, 1))
        k = F.pmod(F.lit(shift) + F.col("hue") / 30, F.lit(12.0))
        x = F.col("light") - chroma / 2 * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        return F.lpad(F.lower(F.hex(F.bround(255 * x).cast("long"))), 2, "0")

    colour = F.concat(F.lit("#"), channel(0), channel(8), channel(4))
    rows = grid.crossJoin(hues).select(((F.col("i") * 3 + F.col("j")) * 360 + F.col("hue")).alias("place"), colour.alias("colour"))
    kept = rows.where(contrast(F.col("colour"), F.lit(background)) >= least_contrast).groupBy("colour").agg(F.min("place").alias("place"))
    return kept.select("place", "colour", *[x.alias(n) for x, n in zip(oklab(F.col("colour")), "lab")])


def assign(families: pd.DataFrame, colours: pd.DataFrame) -> dict:
    """family -> colour. families: (lens, label, family, size), one row per category; colours: (place, colour, l, a, b).

    Families choose in the order of their largest category, then their number of categories. Each takes the free colour
    whose distance from the families it shares a lens with, plus ALL_WEIGHT times that from all families, is the
    greatest; a distance from nobody counts 1. Both distances are kept per colour and lowered by each choice. Raises if
    a family has two categories in a lens or the pool is too small.
    """
    if families.duplicated(["lens", "family"]).any():
        raise ValueError("a family has two categories in a lens")
    order = families.groupby("family").agg(size=("size", "max"), n=("size", "count")).reset_index().sort_values(["size", "n", "family"], ascending=False)["family"].tolist()
    if len(order) > len(colours):
        raise ValueError("the pool of colours is too small")
    colours = colours.sort_values("place", ignore_index=True)
    at = colours[["l", "a", "b"]].to_numpy(float)
    apart = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))  # pool x pool
    lenses = families.groupby("family")["lens"].agg(set).to_dict()
    number = {f: i for i, f in enumerate(order)}
    meets = np.array([[bool(lenses[f] & lenses[g]) and f != g for g in order] for f in order]).reshape(len(order), len(order))
    from_rivals, from_all = np.full((len(order), len(at)), np.inf), np.full(len(at), np.inf)
    free, out = np.zeros(len(at)), {}
    for f in order:
        i = number[f]
        gain = np.where(np.isinf(from_rivals[i]), 1.0, from_rivals[i]) + ALL_WEIGHT * np.where(np.isinf(from_all), 1.0, from_all)
        k = int((gain + free).argmax())
        out[f], free[k] = colours["colour"][k], -np.inf
        from_all = np.minimum(from_all, apart[k])
        from_rivals[meets[i]] = np.minimum(from_rivals[meets[i]], apart[k])
    return out
