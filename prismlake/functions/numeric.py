"""Scalar numbers: bands, scores, colours, view transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Names of the bands of a mean Jaccard, from below 0.60 on.
STABILITY = ["below_0.60", "0.60_to_0.75", "0.75_to_0.85", "at_least_0.85"]


def stability_band(j: Column) -> Column:
    return F.when(j < 0.60, STABILITY[0]).when(j < 0.75, STABILITY[1]).when(j < 0.85, STABILITY[2]).when(j >= 0.85, STABILITY[3])


def granularity_band(k: Column) -> Column:
    return F.when(k <= 30, "broad").when(k <= 60, "balanced").otherwise("detailed")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def neighbour_count(text: Column) -> Column:
    """A number typed by a user, 1 if it is none, kept within 1 and 50."""
    return clamp(F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(-?\d{1,9})", 1), F.lit("S999999999")).cast("int"), F.lit(1)), 1, 50).cast("int")


def min_max(x: Column, over) -> Column:
    """0 at the smallest, 1 at the largest; 1 everywhere if all are equal."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high == low, F.lit(1.0)).otherwise((x - low) / F.nullif(high - low, F.lit(0.0)))


#: Weights of composite scores. The parts are scaled to 0..1 by min_max over all runs (perplexity: one
#: less that), but those of "projection", which are shares already; see projection_parts for two of them.
WEIGHTS = {
    "topics_first": {"coherence": 0.30, "perplexity": 0.25, "diversity": 0.15, "exclusivity": 0.15, "dominance": 0.10, "usage": 0.05},
    "topics_final": {"coherence": 0.22, "perplexity": 0.18, "diversity": 0.12, "exclusivity": 0.12, "topic_stability": 0.18, "assignment_stability": 0.13, "dominance": 0.05},
    "clusters": {"agreement": 0.35, "membership": 0.30, "silhouette": 0.20, "coverage": 0.15},
    "projection": {"trustworthiness": 0.35, "recall_15": 0.35, "recall_50": 0.15, "spearman": 0.10, "shape": 0.05},
    "layout": {"quality": 0.82, "neighbour_agreement": 0.18},
}


#: Parts of which less is better.
INVERSE = {"perplexity"}


def composite(parts: dict[str, float], over) -> Column:
    """The weighted sum of the named columns, each scaled to 0..1 over all rows of the window, those of INVERSE reversed."""
    total = None
    for name, w in parts.items():
        x = min_max(F.col(name), over)
        term = (1 - x if name in INVERSE else x) * F.lit(w)
        total = term if total is None else total + term
    return total


def projection_parts(spearman: Column, balance: Column) -> tuple[Column, Column]:
    """A negative rank correlation counts 0, a shape balance three times and up to 1."""
    return F.greatest(F.lit(0.0), spearman), F.least(F.lit(1.0), 3 * balance)


def weighted(parts: dict[str, float]) -> Column:
    """Weighted sum of columns, added in the order given."""
    total = None
    for name, w in parts.items():
        term = F.col(name) * F.lit(w)
        total = term if total is None else total + term
    return total


def _linear(channel: Column) -> Column:
    c = F.conv(channel, 16, 10).cast("double") / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_rgb(colour: Column) -> tuple[Column, Column, Column]:
    """Linear light of '#rrggbb'."""
    return tuple(_linear(F.substring(colour, at, 2)) for at in (2, 4, 6))


def luminance(colour: Column) -> Column:
    r, g, b = linear_rgb(colour)
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def oklab(colour: Column) -> tuple[Column, Column, Column]:
    """OKLab of '#rrggbb' (published matrices)."""
    r, g, b = linear_rgb(colour)
    l = F.cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b)
    m = F.cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b)
    s = F.cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b)
    return (
        0.2104542553 * l + 0.7936177850 * m - 0.0040720468 * s,
        1.9779984951 * l - 2.4285922050 * m + 0.4505937099 * s,
        0.0259040371 * l + 0.7827717662 * m - 0.8086757660 * s,
    )
